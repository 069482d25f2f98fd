"""Windows of flat binary products: a table of windows drives the reads, and only what a window touches is read."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrakey.operators import kernels as k
from terrakey.sources.raster import dtype_of

#: Bytes of a page, the unit of reading, pages that a task keeps, and bytes of small windows that leave it together.
PAGE, HELD, OUT = 1 << 18, 256, 1 << 22
#: What a row of the table of windows says: the product and the half-open window; bands are null for a plain image.
PRODUCT = ["path", "dtype", "lines", "samples", "bands"]
WINDOW = ["sample0", "line0", "sample1", "line1", "band_lo", "band_hi"]


def opened(path: str) -> fs.FileSystem | tuple:
    """(file system, path in it) of a path or an address."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class Pages:
    """A file read by pages: those that lie side by side and are missing come in one read, the last ones used are kept."""

    def __init__(self, path: str):
        system, inner = opened(path)
        self.file = system.open_input_file(inner)
        self.size = self.file.size()
        self.held: OrderedDict[int, bytes] = OrderedDict()
        self.reads = 0

    def read(self, offset: int, length: int) -> bytes:
        first, end = offset // PAGE, (offset + length - 1) // PAGE + 1
        got: dict[int, bytes] = {}
        page = first
        while page < end:
            if page in self.held:
                got[page] = self.held[page]
                self.held.move_to_end(page)
                page += 1
                continue
            stop = page
            while stop < end and stop not in self.held and stop - page < HELD:
                stop += 1
            data = self.file.read_at(min(self.size, stop * PAGE) - page * PAGE, page * PAGE)
            self.reads += 1
            for i in range(page, stop):
                got[i] = self.held[i] = data[(i - page) * PAGE : (i - page + 1) * PAGE]
            page = stop
        while len(self.held) > HELD:
            self.held.popitem(last=False)
        whole = got[first] if end - first == 1 else b"".join(got[i] for i in range(first, end))
        return whole[offset - first * PAGE : offset - first * PAGE + length]


def plane(pages: Pages, dtype: np.dtype, lines: int, samples: int, band: int, box: tuple[int, int, int, int]) -> np.ndarray:
    """One band of a clipped window (sample0, line0, sample1, line1); full rows come as one range."""
    s0, l0, s1, l1 = box
    base, item = band * lines * samples, dtype.itemsize
    if s1 - s0 == samples:
        return np.frombuffer(pages.read((base + l0 * samples) * item, (l1 - l0) * samples * item), dtype).reshape(l1 - l0, samples)
    out = np.empty((l1 - l0, s1 - s0), dtype)
    for i, line in enumerate(range(l0, l1)):
        out[i] = np.frombuffer(pages.read((base + line * samples + s0) * item, (s1 - s0) * item), dtype)
    return out


def clip(row: dict, lines: int, samples: int) -> tuple[int, int, int, int]:
    s0, l0, s1, l1 = (int(row[c]) for c in WINDOW[:4])
    return max(0, s0), max(0, l0), min(samples, s1), min(lines, l1)


def band_range(row: dict, bands: int) -> tuple[int, int]:
    """Bands asked for, brought within the product: at least one, at most all."""
    lo = max(0, min(bands - 1, int(row["band_lo"])))
    return lo, max(lo + 1, min(bands, int(row["band_hi"])))


def one_window(pages: Pages, row: dict) -> tuple[np.ndarray, tuple[int, int, int, int]]:
    """The window's pixels in the product's type, or the mean of its bands in 32 bits, summed band by band."""
    dtype, lines, samples = dtype_of(row["dtype"] or "UnsignedByte"), int(row["lines"]), int(row["samples"])
    bands = 1 if pd.isna(row["bands"]) else int(row["bands"])
    box = clip(row, lines, samples)
    if box[2] <= box[0] or box[3] <= box[1]:
        raise ValueError("empty window")
    if pages.size < lines * samples * bands * dtype.itemsize:
        raise ValueError(f"shorter than {lines * samples * bands * dtype.itemsize} bytes")
    if pd.isna(row["band_lo"]) or pd.isna(row["band_hi"]):
        return plane(pages, dtype, lines, samples, 0, box), box
    lo, hi = band_range(row, bands)
    total = np.zeros((box[3] - box[1], box[2] - box[0]))
    for band in range(lo, hi):
        total += plane(pages, dtype, lines, samples, band, box)
    return (total / (hi - lo)).astype(np.float32), box


def read_windows(windows: DataFrame, keep: list[str], eight_bit: bool = False) -> DataFrame:
    """``keep`` and (sample0, line0, sample1, line1, h, w, pixel_type, pixels, error) of every window of the table.

    ``windows`` has ``PRODUCT`` and ``WINDOW``; with ``to_h`` and ``to_w`` as well, an image of that size is given, by means over
    what a cell covers. Windows are clipped to the product, bands to those there are. Rows are dealt by file and first byte and read in that order, so
    neighbouring windows share pages; a task holds one window, or several small ones, and some pages. ``eight_bit`` stretches between the 1st and 99th percentile. A window that
    is empty or names an unknown type, a missing or a short file gives a row with the error and without pixels; so does a null in what is needed.
    """
    sized = {"to_h", "to_w"} <= set(windows.columns)
    kinds = {f.name: f.dataType.simpleString() for f in windows.schema.fields}
    columns = [*keep, "sample0", "line0", "sample1", "line1", "h", "w", "pixel_type", "pixels", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, pages, held, size = None, None, [], 0
        for pdf in batches:
            for row in pdf.to_dict("records"):
                out = dict.fromkeys(columns) | {c: row[f"_k_{c}"] for c in keep}
                try:
                    if any(pd.isna(row[c]) for c in ("path", "lines", "samples", *WINDOW[:4])):
                        raise ValueError("incomplete window")
                    if row["path"] != path:
                        path, pages = None, Pages(row["path"])
                        path = row["path"]
                    v, box = one_window(pages, row)
                    if eight_bit:
                        v = k.stretch8(v)
                    if sized and not pd.isna(row["to_h"]):
                        v = k.area(v, (int(row["to_h"]), int(row["to_w"])))
                    out |= dict(zip(WINDOW[:4], box, strict=True)) | {"h": v.shape[0], "w": v.shape[1], "pixel_type": v.dtype.str, "pixels": v.tobytes()}
                except (OSError, ValueError) as e:
                    out["error"] = f"{type(e).__name__}: {e}"
                held.append(out)
                size += len(out["pixels"] or b"")
                if size > OUT or len(held) >= 500:
                    yield pd.DataFrame(held, columns=columns)
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    at = (F.coalesce("band_lo", F.lit(0)).cast("long") * F.col("lines") + F.greatest(F.lit(0), F.col("line0"))) * F.col("samples")
    rows = windows.select(*(F.col(c).alias(f"_k_{c}") for c in keep), *PRODUCT, *WINDOW, *(["to_h", "to_w"] if sized else []), at.alias("_at"))
    spark = windows.sparkSession
    # Rows are short, but what they ask for is not: not to be joined by their bytes, and enough for all cores to end at about the same time.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = rows.repartitionByRange(parts, "path", "_at").sortWithinPartitions("path", "_at").drop("_at")
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return rows.mapInPandas(run, f"{schema}, sample0 int, line0 int, sample1 int, line1 int, h int, w int, pixel_type string, pixels binary, error string")


def write_rasters(images: DataFrame, root: str, name: str = "name") -> DataFrame:
    """(name, path, bytes): each image's pixels as a flat file below ``root``, which every executor must reach. Written again by a repeated task, the file is the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, pixels in zip(pdf[name], pdf["pixels"], strict=True):
                path = f"{root}/{key}.img"
                system, inner = opened(path)
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                with system.open_output_stream(inner) as f:
                    f.write(pixels)
                rows.append((str(key), path, len(pixels)))
            yield pd.DataFrame(rows, columns=["name", "path", "bytes"])

    return images.select(name, "pixels").mapInPandas(run, "name string, path string, bytes long")

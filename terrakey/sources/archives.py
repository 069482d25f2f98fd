"""Archives unpacked member by member, and small images that are made again when their source is newer."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrakey.operators.rounds import cut
from terrakey.sources.windows import opened, read_windows, write_rasters

#: Bytes of a member that are held at once.
CHUNK = 1 << 20
#: Fixed value: the long side of a small image.
SMALL = 320


def listed(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, name, modified) of the files below a folder; only listed, not read. None where there is no such folder."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, name string, modified timestamp")
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"))


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["archive", "member", "size", "error"]
    for pdf in batches:
        for path in pdf["path"]:
            system, inner = opened(path)
            rows: list[tuple] = []
            try:
                if system.get_file_info(inner[: -len(".zip")]).type != fs.FileType.NotFound:
                    continue  # unpacked before
                with system.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
                    rows = [(path, m.filename, m.file_size, None) for m in z.infolist() if not m.is_dir()]
            except (OSError, ValueError, zipfile.BadZipFile, NotImplementedError) as e:
                rows = [(path, None, None, f"{type(e).__name__}: {e}")]
            yield pd.DataFrame(rows, columns=columns, dtype=object)


def _inflated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row in pdf.to_dict("records"):
            path, done, error = None, None, row["error"]
            if error is None:
                system, inner = opened(row["archive"])
                folder = inner[: -len(".zip")]
                parts = [p for p in row["member"].split("/") if p not in ("", ".")]
                try:
                    if ".." in parts:
                        raise ValueError("a member outside its archive")
                    path = "/".join([folder, *parts])
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    done = 0
                    with system.open_input_file(inner) as f, zipfile.ZipFile(f) as z, z.open(row["member"]) as member, system.open_output_stream(path) as out:
                        while piece := member.read(CHUNK):
                            out.write(piece)
                            done += len(piece)
                except (OSError, ValueError, zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
                    error = f"{type(e).__name__}: {e}"
            yield pd.DataFrame([(row["archive"], row["member"], path, done, error)], columns=["archive", "member", "path", "bytes", "error"], dtype=object)


def unpack(spark: SparkSession, root: str) -> DataFrame:
    """(archive, member, path, bytes, error): every member of the .zip archives below ``root`` that were not unpacked before, written beside them.

    Members are dealt out one by one, so a large archive is many tasks' work, and inflated in pieces. An archive or member that is broken gives a
    row with the error and harms no other. Folders of installed packages are passed over. A repeated task writes the same file again. The members are listed
    before the first is written; the result is a plan, and its rows are the members as they are written.
    """
    archives = listed(spark, root, "*.zip").where(~F.col("path").contains("node_modules")).select("path")
    members = archives.repartition("path").mapInPandas(_members, "archive string, member string, size long, error string")
    return cut(members).repartition("archive", "member").mapInPandas(_inflated, "archive string, member string, path string, bytes long, error string")


def refresh_small(images: DataFrame, root: str, folder: str, most: int = SMALL) -> DataFrame:
    """(name, path, bytes) of the small images that were missing or older than their source, now written below ``folder``.

    ``images`` has (name, path, lines, samples) of 8-bit flat images below ``root``. Modification times of both folders meet in a join; what is fresh is not
    read. The long side becomes ``most``, by means over what a cell covers; smaller images keep their size. An image that is not there, or cannot be read, has none.
    """
    spark = images.sparkSession
    bare = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    times = listed(spark, root).select(bare("path").alias("_path"), F.col("modified").alias("source_time"))
    made = listed(spark, folder).select(F.regexp_replace("name", r"\.img$", "").alias("name"), F.col("modified").alias("made_time"))
    rows = images.withColumn("_path", bare("path")).join(times, "_path").join(made, "name", "left")
    stale = cut(rows.where("made_time is null or made_time < source_time"))
    scale = F.least(F.lit(1.0), most / F.greatest("lines", "samples"))
    none, zero = F.lit(None).cast("int"), F.lit(0)
    box = [zero.alias("sample0"), zero.alias("line0"), F.col("samples").alias("sample1"), F.col("lines").alias("line1"), none.alias("band_lo"), none.alias("band_hi")]
    sizes = [F.greatest(F.lit(1), F.bround(F.col(c) * scale)).cast("int").alias(t) for c, t in (("lines", "to_h"), ("samples", "to_w"))]
    windows = stale.select("name", "path", F.lit("UnsignedByte").alias("dtype"), "lines", "samples", none.alias("bands"), *box, *sizes)
    return write_rasters(read_windows(windows, ["name"]).where("pixels is not null"), folder)

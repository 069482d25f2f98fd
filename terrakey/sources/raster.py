"""Flat binary rasters as a Spark data source: tiles, read window by window."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

#: Pixel types by name.
DTYPES = {
    "UnsignedByte": "u1", "SignedByte": "i1", "UnsignedLSB2": "<u2", "SignedLSB2": "<i2", "UnsignedMSB2": ">u2",
    "SignedMSB2": ">i2", "UnsignedLSB4": "<u4", "SignedLSB4": "<i4", "IEEE754LSBSingle": "<f4",
}


def dtype_of(name: str) -> np.dtype:
    if name not in DTYPES:
        raise ValueError(f"unknown pixel type {name!r}")
    return np.dtype(DTYPES[name])


@dataclass
class Tile(InputPartition):
    row: int
    col: int
    band: int


class RasterReader(DataSourceReader):
    """One partition per tile and band; equality on tile_row, tile_col and band leaves out partitions before they are read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.dtype = options["path"], dtype_of(options.get("dtype", "UnsignedByte"))
        self.lines, self.samples, self.bands = int(options["lines"]), int(options["samples"]), int(options.get("bands", "1"))
        self.size = int(options.get("tile", "1024"))
        self.only: dict[str, int] = {}
        if min(self.lines, self.samples, self.bands, self.size) <= 0:
            raise ValueError("sizes must be positive")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ("tile_row", "tile_col", "band"):
                self.only[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        rows, cols = -(-self.lines // self.size), -(-self.samples // self.size)
        return [
            Tile(r, c, b) for r in range(rows) for c in range(cols) for b in range(self.bands)
            if all(self.only.get(k, v) == v for k, v in (("tile_row", r), ("tile_col", c), ("band", b)))
        ] or [Tile(-1, -1, -1)]

    def read(self, partition: Tile) -> Iterator[tuple]:
        if partition.row < 0:
            return
        line0, sample0 = partition.row * self.size, partition.col * self.size
        h, w = min(self.size, self.lines - line0), min(self.size, self.samples - sample0)
        need = self.lines * self.samples * self.bands * self.dtype.itemsize
        if os.path.getsize(self.path) < need:
            raise ValueError(f"{self.path} is shorter than {need} bytes")
        data = np.memmap(self.path, self.dtype, "r", shape=(self.bands, self.lines, self.samples))
        pixels = np.array(data[partition.band, line0 : line0 + h, sample0 : sample0 + w])
        yield self.path, partition.row, partition.col, partition.band, h, w, self.dtype.str, pixels.tobytes()


class RasterSource(DataSource):
    """``spark.read.format("flat_raster")`` with path, lines, samples, bands, dtype and tile."""

    @classmethod
    def name(cls) -> str:
        return "flat_raster"

    def schema(self) -> str:
        return "path string, tile_row int, tile_col int, band int, h int, w int, dtype string, pixels binary"

    def reader(self, schema: object) -> RasterReader:
        return RasterReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``flat_raster`` known to a session and lets filters on tile columns reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)

"""How evenly points cover an image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(x: Column, size: float, grid: int) -> Column:
    """Cell number of a coordinate among ``grid`` equal cells; what lies outside counts for the outermost."""
    return F.greatest(F.least(F.floor(x / size * grid), F.lit(grid - 1)), F.lit(0)).cast("int")


def placed(points: DataFrame) -> DataFrame:
    """Points with both coordinates; one without a place covers nothing."""
    return points.where(F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False)))


def matched_points(keypoints: DataFrame, matches: DataFrame) -> DataFrame:
    """The first image's points (run, idx, x, y) of matches (run, idx_a, ...), with the matches' other columns."""
    return matches.join(keypoints.select("run", F.col("idx").alias("idx_a"), "x", "y"), ["run", "idx_a"])


def cell_counts(points: DataFrame, by: list[str], width: float, height: float, grid: int) -> DataFrame:
    return placed(points).groupBy(*by, cell(F.col("x"), width, grid).alias("cx"), cell(F.col("y"), height, grid).alias("cy")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"))


def uniformity_even(points: DataFrame, by: list[str], width: float, height: float, grid: int = 4) -> DataFrame:
    """Mean over all cells of a cell's count against its even share, at most 1."""
    cells = cell_counts(points, by, width, height, grid)
    total = cells.groupBy(*by).agg(F.sum("n").alias("total"))
    share = F.least(F.col("n") / (F.col("total") / grid**2), F.lit(1.0))
    return cells.join(total, by).groupBy(*by).agg((F.sum(share) / grid**2).alias("uniformity"))


def uniformity_cells(points: DataFrame, by: list[str], width: float, height: float, grid: int = 4) -> DataFrame:
    """Share of cells that hold a point."""
    return cell_counts(points, by, width, height, grid).groupBy(*by).agg((F.count(F.lit(1)) / grid**2).alias("unif_cells"))


def blur(field: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur by rows and columns; the kernel reaches four sigma, borders mirror without repeating the edge."""
    reach = (int(round(8 * sigma + 1)) | 1) // 2
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for _ in range(2):
        wide = np.pad(field, ((reach, reach), (0, 0)), mode="reflect") if field.shape[0] > 1 else np.repeat(field, 2 * reach + 1, axis=0)
        # One weighted sum of shifted rows per tap, then the other axis.
        field = sum(k * wide[i : i + field.shape[0]] for i, k in enumerate(kernel)).T
    return field


def density_cells(points: DataFrame, by: str, width: int, height: int, grid: int = 8, sigma_share: float = 0.04) -> DataFrame:
    """Mean point density of each of grid x grid cells: (``by``, row, col, x, y, w, h, density).

    Weights (0.5 where null) are summed by pixel, coordinates cut to whole pixels within the image, then blurred with a sigma of
    ``sigma_share`` of the longer side, at least 3 pixels, and divided by the highest value. Cells have a whole number of
    pixels; what is left over at the right and lower edges counts for none. Sums of pixels come before the shuffle, so that a
    task holds at most one image of a run, however many points it has. Points without a place count for none.
    """
    pixel = lambda c, size: F.greatest(F.least(F.col(c), F.lit(float(size - 1))), F.lit(0.0)).cast("int")
    pixels = placed(points).groupBy(by, pixel("x", width).alias("px"), pixel("y", height).alias("py")).agg(F.sum(F.coalesce(F.col("weight").cast("double"), F.lit(0.5))).alias("v"))
    w, h = max(1, width // grid), max(1, height // grid)

    def cells(pdf: pd.DataFrame) -> pd.DataFrame:
        field = np.zeros((height, width))
        field[pdf["py"], pdf["px"]] = pdf["v"]
        field = blur(field, max(3.0, sigma_share * max(width, height)))
        peak = field.max()
        field = field / peak if peak > 0 else field
        rows = []
        for row in range(grid):
            for col in range(grid):
                patch = field[row * h : (row + 1) * h, col * w : (col + 1) * w]
                rows.append((pdf[by].iloc[0], row, col, col * w, row * h, w, h, float(patch.mean()) if patch.size else 0.0))
        return pd.DataFrame(rows, columns=[by, "row", "col", "x", "y", "w", "h", "density"])

    kind = points.schema[by].dataType.simpleString()
    return pixels.groupBy(by).applyInPandas(cells, f"{by} {kind}, row int, col int, x int, y int, w int, h int, density double")


def _outline(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise."""
    p = np.unique(p, axis=0)
    if len(p) < 3:
        return p
    half = []
    for side in (p, p[::-1]):
        out: list[np.ndarray] = []
        for q in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                out.pop()
            out.append(q)
        half += out[:-1]
    return np.array(half)


def hull_area(points: DataFrame, by: str, width: float, height: float) -> DataFrame:
    """Area of the convex hull against the image: hulls of batches first, then the hull of those, so no group is gathered whole."""
    schema = f"{by} {points.schema[by].dataType.simpleString()}, x double, y double"

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, g in pdf.groupby(by, dropna=False):
                yield pd.DataFrame({by: key, **dict(zip("xy", _outline(g[["x", "y"]].to_numpy(float)).T, strict=True))})

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _outline(pdf[["x", "y"]].to_numpy(float))
        x, y = c.T
        twice = abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) if len(c) > 2 else 0.0
        return pd.DataFrame({by: [pdf[by].iloc[0]], "hull": [twice / 2 / (width * height)]})

    corners = points.select(by, F.col("x").cast("double"), F.col("y").cast("double")).mapInPandas(reduce_batches, schema)
    return corners.groupBy(by).applyInPandas(area, f"{by} {points.schema[by].dataType.simpleString()}, hull double")

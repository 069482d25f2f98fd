"""3x3 projective maps as arrays of nine numbers, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

H = list[Column]


def entries(h: Column) -> H:
    return [F.get(h, F.lit(i)) for i in range(9)]


def apply(h: H, x: Column, y: Column) -> tuple[Column, Column]:
    """The image of a point; null where it lies at infinity."""
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def product(a: H, b: H) -> H:
    return [a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)]


def determinant(h: H) -> Column:
    return h[0] * (h[4] * h[8] - h[5] * h[7]) - h[1] * (h[3] * h[8] - h[5] * h[6]) + h[2] * (h[3] * h[7] - h[4] * h[6])


def inverse(h: H) -> H:
    """By the adjugate; nulls for a singular map."""
    d = determinant(h)
    minors = [(4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3)]
    return [F.try_divide(h[a] * h[b] - h[c] * h[e], d) for a, b, c, e in minors]


def normalised(h: H) -> H:
    """Divided by the last entry unless that is all but zero."""
    by = F.when(F.abs(h[8]) > 1e-12, h[8]).otherwise(F.lit(1.0))
    return [x / by for x in h]


def decompose(h: H) -> dict[str, Column]:
    a, b, tx, c, d, ty, px, py, _ = normalised(h)
    return {
        "scale_x": F.hypot(a, c),
        "scale_y": F.hypot(b, d),
        "rotation_deg": F.degrees(F.atan2(c, a)),
        "shear_deg": F.degrees(F.atan2(a * b + c * d, a * d - b * c)),
        "tx": tx,
        "ty": ty,
        "perspective_x": px,
        "perspective_y": py,
    }


def similarity(scale: Column, degrees: Column, dx: Column, dy: Column, width: Column, height: Column) -> H:
    """Scale and rotation about the image's middle, then a shift."""
    c, s = scale * F.cos(F.radians(degrees)), scale * F.sin(F.radians(degrees))
    mx, my = width / 2, height / 2
    zero, one = F.lit(0.0), F.lit(1.0)
    return [c, -s, mx - c * mx + s * my + dx, s, c, my - s * mx - c * my + dy, zero, zero, one]


def with_tilt(h: H, tilt: Column) -> H:
    return [*h[:6], h[6] + tilt, h[7] + 0.4 * tilt, h[8]]


def rescaled(h: H, sa: Column, sb: Column) -> H:
    """The same map between grids whose pixels are ``sa`` and ``sb`` times finer on its two sides."""
    zero, one = F.lit(0.0), F.lit(1.0)
    up = [sb, zero, zero, zero, sb, zero, zero, zero, one]
    down = [1 / sa, zero, zero, zero, 1 / sa, zero, zero, zero, one]
    return product(product(up, h), down)

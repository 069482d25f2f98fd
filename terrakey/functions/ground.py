"""Ground geometry of image footprints as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Moon's radius in metres and the metres of a degree of latitude on it.
MOON_RADIUS_M = 1_737_400.0
M_PER_DEG_LAT = 2 * math.pi * MOON_RADIUS_M / 360.0


def m_per_deg_lon(lat: Column) -> Column:
    return F.lit(M_PER_DEG_LAT) * F.cos(F.radians(lat))


@dataclass(frozen=True)
class Footprint:
    """Columns of an image's corners (longitude, latitude in degrees) and size in lines and samples."""

    ul: tuple[Column, Column]
    ur: tuple[Column, Column]
    ll: tuple[Column, Column]
    lr: tuple[Column, Column]
    lines: Column
    samples: Column

    @classmethod
    def of(cls, prefix: str = "") -> Footprint:
        c = {k: (F.col(f"{prefix}{k}_lon"), F.col(f"{prefix}{k}_lat")) for k in ("ul", "ur", "ll", "lr")}
        return cls(**c, lines=F.col(f"{prefix}lines"), samples=F.col(f"{prefix}samples"))

    def _axis(self, i: int) -> list[Column]:
        return [self.ul[i], self.ur[i], self.ll[i], self.lr[i]]

    def bounds(self) -> dict[str, Column]:
        lon, lat = self._axis(0), self._axis(1)
        return {"lon_min": F.least(*lon), "lon_max": F.greatest(*lon), "lat_min": F.least(*lat), "lat_max": F.greatest(*lat)}

    def centre(self) -> tuple[Column, Column]:
        """The middle of the bounds, not the mean of the corners."""
        b = self.bounds()
        return (b["lon_min"] + b["lon_max"]) / 2, (b["lat_min"] + b["lat_max"]) / 2

    def usable(self) -> Column:
        """All corners known and both sizes non-zero."""
        ok = F.coalesce(self.lines, F.lit(0)) * F.coalesce(self.samples, F.lit(0)) != 0
        for c in (*self._axis(0), *self._axis(1)):
            ok = ok & c.isNotNull()
        return ok

    def affine(self) -> list[Column]:
        """Least-squares fit of (sample, line, 1) to (lon, lat) on the four corners, in closed form: a, b, c of lon, then of lat."""
        out = []
        for i in (0, 1):
            ul, ur, ll, lr = self._axis(i)
            out.append(F.try_divide((ur - ul) + (lr - ll), 2 * (self.samples - 1)))
            out.append(F.try_divide((ll - ul) + (lr - ur), 2 * (self.lines - 1)))
            out.append((3 * ul + ur + ll - lr) / 4)
        return out

    def pixel_to_lonlat(self, sample: Column, line: Column) -> tuple[Column, Column]:
        a, b, c, d, e, f = self.affine()
        return a * sample + b * line + c, d * sample + e * line + f

    def lonlat_to_pixel(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Inverse of the fit by Cramer's rule; the place may lie outside the image."""
        a, b, c, d, e, f = self.affine()
        det = a * e - b * d
        return F.try_divide(e * (lon - c) - b * (lat - f), det), F.try_divide(a * (lat - f) - d * (lon - c), det)

    def contains_pixel(self, sample: Column, line: Column) -> Column:
        return (sample >= 0) & (sample < self.samples) & (line >= 0) & (line < self.lines)

    def gsd(self) -> tuple[Column, Column]:
        """Metres a pixel along samples (top edge) and along lines (left edge)."""
        lat = self.centre()[1]

        def length(p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
            return F.hypot((q[0] - p[0]) * m_per_deg_lon(lat), (q[1] - p[1]) * F.lit(M_PER_DEG_LAT))

        return length(self.ul, self.ur) / F.greatest(self.samples - 1, F.lit(1)), length(self.ul, self.ll) / F.greatest(self.lines - 1, F.lit(1))


def window_geometry(lon_min: Column, lon_max: Column, lat_min: Column, lat_max: Column) -> dict[str, Column]:
    """Size on the ground and centre of a longitude-latitude window."""
    lat = (lat_min + lat_max) / 2
    width, height = (lon_max - lon_min) * m_per_deg_lon(lat), (lat_max - lat_min) * F.lit(M_PER_DEG_LAT)
    return {"width_m": width, "height_m": height, "area_km2": width * height / 1e6, "centre_lon": (lon_min + lon_max) / 2, "centre_lat": lat}


def centred_window(cx: Column, cy: Column, width: Column, height: Column) -> dict[str, Column]:
    """Half-open pixel window about a centre; halves round to even."""
    x0, y0 = F.bround(cx - width / 2).cast("int"), F.bround(cy - height / 2).cast("int")
    return {"sample0": x0, "line0": y0, "sample1": x0 + width, "line1": y0 + height}


def clipped(w: dict[str, Column], samples: Column, lines: Column) -> dict[str, Column]:
    zero = F.lit(0)
    return {
        "sample0": F.greatest(zero, F.least(w["sample0"], samples)),
        "line0": F.greatest(zero, F.least(w["line0"], lines)),
        "sample1": F.greatest(zero, F.least(w["sample1"], samples)),
        "line1": F.greatest(zero, F.least(w["line1"], lines)),
    }


def is_valid(w: dict[str, Column]) -> Column:
    return (w["sample1"] > w["sample0"]) & (w["line1"] > w["line0"])

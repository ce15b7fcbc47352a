"""Contrast, colour maps, NDVI and relief as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def contrast(v: Column, low: float, high: float) -> Column:
    """Stretch to 0..255: the identity for bytes, a shift for a range of 254, else 1 + (v - low) / scale cut to whole."""
    if low >= 0 and high <= 255:
        return v.cast("int")
    return stretched(v, F.lit(low), F.lit(high))


def stretched(v: Column, low: Column, high: Column) -> Column:
    scale = (high - low) / 254
    return F.when(v <= low, 0).when(v >= high, 255).when(scale == 1, (v - low).cast("int")).otherwise(F.floor(1 + (v - low) / scale).cast("int"))


def gamma(v: Column, low: Column, high: Column, g: float) -> Column:
    i = stretched(v, low, high)
    return F.when(i == 0, 0).when(i == 255, 255).otherwise(F.floor(F.pow(i / 254, F.lit(1 / g)) * 254 + 0.5).cast("int"))


def categorize(v: Column, base: str, steps: Sequence[tuple[float, str]]) -> Column:
    """The colour of the last step not above v, base below the first."""
    out = F.lit(base)
    for at, colour in sorted(steps):
        out = F.when(v >= at, colour).otherwise(out)
    return F.when(v.isNotNull(), out)


def interpolate(v: Column, points: Sequence[tuple[float, tuple[int, int, int]]], default: tuple[int, int, int]) -> Column:
    """struct<r, g, b>: linear between neighbouring points [a, b), cut to whole; outside and at the last point the default."""
    points = sorted(points)
    fields = []
    for k, name in enumerate("rgb"):
        out = F.lit(default[k])
        for (a, x), (b, y) in zip(points, points[1:], strict=False):
            out = F.when((v >= a) & (v < b), F.floor(x[k] + (v - a) / (b - a) * (y[k] - x[k])).cast("int")).otherwise(out)
        fields.append(out.alias(name))
    return F.struct(*fields)


def ndvi(red: Column, nir: Column) -> Column:
    """(nir - red) / (nir + red), null where both are 0."""
    return F.try_divide((nir - red).cast("double"), (nir + red).cast("double"))


def relief(e: Column, factor: float = 55.0, scale: float = 1.0, nodata: float | None = None) -> Column:
    """Hillshade 0..1 of a 3x3 neighbourhood, light from 315 degrees at 45; -1 if a neighbour is missing or NO-DATA."""
    x = [F.element_at(e, k + 1) for k in range(9)]
    z = 0.0033333333 * (factor / 55.0)
    dx = z * ((x[0] + 2 * x[3] + x[6]) - (x[2] + 2 * x[5] + x[8])) / scale
    dy = z * ((x[6] + 2 * x[7] + x[8]) - (x[0] + 2 * x[1] + x[2])) / scale
    slope = math.pi / 2 - F.atan(F.sqrt(dx * dx + dy * dy))
    aspect = F.atan2(dx, dy)
    alt, az = math.radians(45), math.radians(315)
    shade = math.sin(alt) * F.sin(slope) + math.cos(alt) * F.cos(slope) * F.cos(az - math.pi / 2 - aspect)
    bad = F.exists(e, lambda y: y.isNull() | (F.lit(False) if nodata is None else y == nodata))
    return F.when(bad, -1.0).otherwise(F.least(F.greatest(shade, F.lit(0.0)), F.lit(1.0)))


def blend(over: Column, under: Column, opacity: float) -> Column:
    return F.floor(over * opacity + under * (1 - opacity) + 0.5).cast("int")


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.floor(0.2126 * r + 0.7152 * g + 0.0722 * b).cast("int")


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(x)), 2, "0") for x in (r, g, b)])


def scale_denominator(xres: float, yres: float, geographic: bool = False) -> float:
    """The standard scale of a resolution, for pixels of 0.28 mm."""
    res = math.sqrt(xres * yres) * (6378137.0 * 2 * math.pi / 360 if geographic else 1.0)
    return res / 0.000254 * (0.28 / 0.254)


def channels_of(colour) -> tuple[int, int, int] | None:
    """(r, g, b) of #rrggbb, None for what is none."""
    if not isinstance(colour, str) or len(colour) != 7 or colour[0] != "#" or not all(x in "0123456789abcdefABCDEF" for x in colour[1:]):
        return None
    return tuple(int(colour[i : i + 2], 16) for i in (1, 3, 5))

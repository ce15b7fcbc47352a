"""Band statistics: tile partials, their merge, both variance forms, histograms and percentiles.

Partials are algebraic (counts, sums, extrema, squared differences), so tiles combine on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def partials(px: DataFrame, keys: Sequence[str], value: str = "v", nodata: float | None = None) -> DataFrame:
    """Per key: n valid, no_data, min, max, mean, ssd (squared differences from the mean)."""
    valid = F.col(value) if nodata is None else F.when(F.col(value) != nodata, F.col(value))
    none = F.lit(0) if nodata is None else F.count_if(F.col(value) == nodata)
    out = px.groupBy(*keys).agg(
        F.count(valid).alias("n"), none.cast("long").alias("no_data"), F.min(valid).alias("min"), F.max(valid).alias("max"),
        F.avg(valid).alias("mean"), F.coalesce(F.var_pop(valid) * F.count(valid), F.lit(0.0)).alias("ssd"),
    )
    return out


def merged(parts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Partials combined: counts summed, means weighted, squared differences added (between tiles: none)."""
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("no_data").alias("no_data"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.try_divide(F.sum(F.col("mean") * F.col("n")), F.sum("n")).alias("mean"), F.sum("ssd").alias("ssd"), F.count_if(F.col("n") > 0).alias("k"),
    )


def variance(stats: DataFrame, pooled: bool = False) -> DataFrame:
    """Add var and stddev: ssd / (n - 1), or pooled over the k partials, ssd / (n - k)."""
    var = F.try_divide(F.col("ssd"), F.col("n") - (F.col("k") if pooled else F.lit(1)))
    return stats.withColumns({"var": var, "stddev": F.sqrt(var)})


def histogram(px: DataFrame, value: str, keys: Sequence[str] = (), offset: int = 0) -> DataFrame:
    """Types of 8 bits and less: a bin is a value (offset 128 for signed ones)."""
    return px.groupBy(*keys, (F.col(value).cast("int") + offset).alias("bin")).agg(F.count("*").alias("n"))


def binned(px: DataFrame, value: str = "v", bins: int = 256) -> DataFrame:
    """Other types: bins of (max - min) / (bins - 1), the bounds from a first pass; a constant band is bin 0."""
    lo, hi = px.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if lo is None:
        return px.limit(0).select(F.lit(0).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    step = (float(hi) - float(lo)) / (bins - 1)
    at = F.least(F.greatest(F.floor((F.col(value) - F.lit(lo)) / F.lit(step)), F.lit(0)), F.lit(bins - 1)) if step else F.lit(0)
    return px.where(F.col(value).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def rebinned(hist: DataFrame, low: float = 0.0, high: float = 0.0, keys: Sequence[str] = (), bins: int = 256) -> DataFrame:
    """Histograms (lo, hi, bin, n) of several bounds as one over low to high: each bin's count goes where the bin's middle lies."""
    middle = (F.col("bin") + 0.5) * ((F.col("hi") - F.col("lo")) / (bins - 1)) + F.col("lo")
    step = (high - low) / (bins - 1)
    at = F.least(F.greatest(F.floor((middle - F.lit(low)) / F.lit(step)), F.lit(0)), F.lit(bins - 1)) if step else F.lit(0)
    return hist.groupBy(*keys, at.cast("int").alias("bin")).agg(F.sum("n").alias("n"))


def affine(points: DataFrame) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
    """The least squares fit x2 = a + b x + c y, y2 = d + e x + f y of control points (x, y, x2, y2): sums by Spark, two 3 x 3 systems here."""
    import numpy as np

    x, y = F.col("x"), F.col("y")
    names = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y, **{f"{p}{q}": F.col(p) * w for p in ("x2", "y2") for q, w in (("", F.lit(1.0)), ("x", x), ("y", y))}}
    s = points.agg(*[F.sum(v).alias(k) for k, v in names.items()]).first()
    m = np.array([[s.n, s.x, s.y], [s.x, s.xx, s.xy], [s.y, s.xy, s.yy]])
    return tuple(tuple(float(v) for v in np.linalg.solve(m, [s[p], s[p + "x"], s[p + "y"]])) for p in ("x2", "y2"))


def cumulative(hist: DataFrame) -> DataFrame:
    """A histogram (bin, n) of up to 256 bins with the count before each bin and the total."""
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return hist.withColumns({"before": F.coalesce(F.sum("n").over(up), F.lit(0)), "total": F.sum("n").over(every)})


def percentiles(hist: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """(lo_bin, hi_bin): first bin with `low` of all before it, and last with `high` of all at most up to it."""
    c = cumulative(hist)
    return c.agg(
        F.min(F.when(F.col("before") >= F.col("total") * low, F.col("bin"))).alias("lo_bin"),
        F.max(F.when(F.col("before") + F.col("n") <= F.col("total") * high, F.col("bin"))).alias("hi_bin"),
    )


def equalised(hist: DataFrame) -> DataFrame:
    """(bin, lut): histogram equalisation over bins 1 to 255; 0 stays 0, 255 becomes 255."""
    c = cumulative(hist.where("bin between 1 and 255"))
    lut = F.floor(254 * (F.col("before") + F.col("n")) / F.col("total") + 0.5).cast("int")
    return c.select("bin", F.when(F.col("bin") == 255, 255).otherwise(lut).alias("lut"))


def extent(tiles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return tiles.groupBy(*keys).agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))


def level_report(tiles: DataFrame) -> DataFrame:
    """Tiles and bytes of each level."""
    return tiles.groupBy("pyramid_level").agg(F.count("*").alias("tiles"), F.sum("bytes").alias("bytes"))

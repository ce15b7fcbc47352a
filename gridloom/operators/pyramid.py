"""Pyramid levels by block averages: one grouping per level, combined on the map side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reduced(px: DataFrame, factor: int, bands: Sequence[str], nodata: Sequence[float | None], keys: Sequence[str] = (), whole: bool = True, first_column: bool = False) -> DataFrame:
    """Averages of factor x factor blocks per band, cut towards zero for whole-number types.

    Where a block's NO-DATA cells (per band, absent ones not counted) are as many as its valid ones or more, the
    result is NO-DATA.  first_column averages a block's first column alone, as some old pyramids hold it.
    """
    cells = px.where(F.col("c") % factor == 0) if first_column else px
    block = [F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")]
    aggregates = []
    for b, nd in zip(bands, nodata, strict=True):
        valid = F.col(b) if nd is None else F.when(F.col(b) != nd, F.col(b))
        mean = F.avg(valid)
        mean = F.when(mean >= 0, F.floor(mean)).otherwise(F.ceil(mean)).cast("double") if whole else mean
        lost = F.lit(0) if nd is None else F.count_if(F.col(b) == nd)
        aggregates.append(F.when(lost < F.count(valid), mean).otherwise(F.lit(nd).cast("double")).alias(b))
    return cells.groupBy(*keys, *block).agg(*aggregates)


def levels(px: DataFrame, bands: Sequence[str], nodata: Sequence[float | None], top: int, factor: int = 8, whole: bool = True) -> DataFrame:
    """Levels 1 to top, each from the one below, with pyramid_level."""
    out, below = None, px.select("r", "c", *bands)
    for k in range(1, top + 1):
        below = reduced(below, factor, bands, nodata, whole=whole)
        level = below.withColumn("pyramid_level", F.lit(k))
        out = level if out is None else out.unionByName(level)
    return out


def without_pyramid(tiles: DataFrame, section_id: int | None = None) -> DataFrame:
    """Level 0 alone, or level 0 of one section and all levels of the others."""
    keep = F.col("pyramid_level") == 0
    return tiles.where(keep if section_id is None else keep | (F.col("section_id") != section_id))

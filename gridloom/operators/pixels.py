"""Long-form pixels: a row (r, c, value columns) per cell, row 0 at the top.

Everything here is a projection, a filter, a keyed join or a grouping, so that Catalyst sees the whole plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tiled(px: DataFrame, tile_w: int, tile_h: int, width: int) -> DataFrame:
    """Add tile_row, tile_col and tile_id (row-major over a coverage `width` cells wide)."""
    across = -(-width // tile_w)
    row, col = F.floor(F.col("r") / tile_h), F.floor(F.col("c") / tile_w)
    return px.withColumns({"tile_row": row, "tile_col": col, "tile_id": row * across + col})


def tile_boxes(tiles: DataFrame, minx: float, maxy: float, xres: float, yres: float, tile_w: int, tile_h: int) -> DataFrame:
    """Add the bounds of tiles (tile_row, tile_col); the last tile of a row or column may go beyond its section."""
    left, top = F.lit(minx) + F.col("tile_col") * tile_w * xres, F.lit(maxy) - F.col("tile_row") * tile_h * yres
    return tiles.withColumns({"minx": left, "maxx": left + tile_w * xres, "maxy": top, "miny": top - tile_h * yres})


def intersects(minx: float, miny: float, maxx: float, maxy: float) -> Column:
    """Closed intervals; reaches the scan as pushed filters on the four bounds."""
    return (F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny)


def trunc(x: Column) -> Column:
    """Towards zero, as whole numbers."""
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("long")


def point_cells(points: DataFrame, minx: float, maxy: float, xres: float, yres: float) -> DataFrame:
    """Add the cell (r, c) of points (x, y): a computed key, so that the lookup is an equi-join."""
    return points.withColumns({"r": trunc((F.lit(maxy) - F.col("y")) / yres), "c": trunc((F.col("x") - minx) / xres)})


def lookup(points: DataFrame, px: DataFrame, how: str = "left") -> DataFrame:
    """Points with their cell's values; those outside get nulls."""
    return points.join(px, ["r", "c"], how)


def is_nodata(bands: Sequence[str], sentinel: Sequence[float]) -> Column:
    """All bands equal the sentinel; never, if it has another number of bands."""
    if len(bands) != len(sentinel):
        return F.lit(False)
    test = F.lit(True)
    for b, v in zip(bands, sentinel, strict=True):
        test = test & (F.col(b) == v)
    return test


def decimated(px: DataFrame, factor: int) -> DataFrame:
    """Nearest neighbour: the cells whose row and column are multiples of factor, renumbered."""
    kept = px.where((F.col("r") % factor == 0) & (F.col("c") % factor == 0))
    return kept.withColumns({"r": (F.col("r") / factor).cast("long"), "c": (F.col("c") / factor).cast("long")})


def window_cells(px: DataFrame, minx: float, maxy: float, src_res: float, out_minx: float, out_maxy: float, out_res: float, width: int, height: int) -> DataFrame:
    """Add out_x, out_y: the cell of an output window that each source cell's centre falls in; others go."""
    x = (F.lit(minx) + (F.col("c") + 0.5) * src_res - out_minx) / out_res
    y = (F.lit(out_maxy) - (F.lit(maxy) - (F.col("r") + 0.5) * src_res)) / out_res
    inside = (x >= 0) & (y >= 0) & (F.col("out_x") < width) & (F.col("out_y") < height)
    return px.withColumns({"out_x": trunc(x), "out_y": trunc(y)}).where(inside)


def mosaic(cells: DataFrame, order: Column, values: Sequence[str]) -> DataFrame:
    """(out_x, out_y, values) of the cell last in order: max_by combines before the shuffle, no window sort."""
    top = F.max_by(F.struct(*values), order).alias("top")
    return cells.groupBy("out_x", "out_y").agg(top).select("out_x", "out_y", "top.*")


def dense(cells: DataFrame, width: int, height: int, values: dict[str, float], rows: str = "out_y", cols: str = "out_x") -> DataFrame:
    """Every cell of a window, with fill values where there is none: rows from a range, columns exploded."""
    spark = cells.sparkSession
    grid = spark.range(height).select(F.col("id").alias(rows), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias(cols))
    full = grid.join(cells, [rows, cols], "left")
    return full.select(rows, cols, *[F.coalesce(v, F.lit(fill)).alias(v) for v, fill in values.items()])


def rows_of(cells: DataFrame, value: str, row: str = "out_y", col: str = "out_x") -> DataFrame:
    """(row, values): a row's values in column order; a row of a raster is one record."""
    ordered = F.array_sort(F.collect_list(F.struct(col, value)))
    return cells.groupBy(row).agg(F.transform(ordered, lambda s: s[value]).alias("values"))


def pick_bands(px: DataFrame, bands: Sequence[int], names: Sequence[str], source: str = "bands") -> DataFrame:
    """Bands of an array column by number from 0."""
    kept = [c for c in px.columns if c != source]
    return px.select(*kept, *[F.element_at(source, b + 1).alias(n) for b, n in zip(bands, names, strict=True)])


def palette_colors(px: DataFrame, palette: DataFrame, index: str = "v") -> DataFrame:
    """Add r, g, b by a palette (idx, pr, pg, pb); ValueError if it has more than the 256 entries that the type allows."""
    if palette.limit(257).count() > 256:
        raise ValueError("a palette has 256 entries at most")
    return px.join(F.broadcast(palette), F.col(index) == F.col("idx"), "left").drop("idx")


def with_neighbours(px: DataFrame, value: str = "v") -> DataFrame:
    """Add e: the 3x3 neighbourhood as an array of nine, row by row, nulls beyond the edges.

    Each cell is sent to the nine cells that see it and gathered there by one grouping on the cell.  Where a
    partition holds neighbouring cells, they are gathered before the shuffle, which then has about a row per cell;
    unlike windows over whole rows and columns no task holds a whole column.
    """
    offsets = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(3 * (1 - dr) + 1 - dc).alias("k")) for dr in (-1, 0, 1) for dc in (-1, 0, 1)])
    sent = px.select("r", "c", F.col(value).alias("v"), F.explode(offsets).alias("o"))
    sent = sent.select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), F.col("o.k").alias("k"), "v")
    got = sent.groupBy("r", "c").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"e{k}") for k in range(9)])
    return got.where("e4 is not null").select("r", "c", F.col("e4").alias(value), F.array(*[f"e{k}" for k in range(9)]).alias("e"))


def best_resolution(levels: DataFrame, xres: float, yres: float) -> DataFrame:
    """The physical level and scale for a request: the coarsest not coarser than asked for, else the finest.

    levels: (pyramid_level, x1, x2, x4, x8, y1, y2, y4, y8); equal resolutions count at the higher level.
    """
    options = F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), F.col(f"x{s}").alias("x"), F.col(f"y{s}").alias("y")) for s in (8, 4, 2, 1)]))
    flat = levels.select("pyramid_level", options.alias("o")).select("pyramid_level", "o.*").where("x is not null and y is not null")
    once = flat.groupBy("x", "y").agg(F.max(F.struct("pyramid_level", "scale")).alias("at")).select("x", "y", "at.*")
    fits = (F.col("x") <= xres) & (F.col("y") <= yres)
    ranked = F.max(F.struct(fits.alias("fits"), F.when(fits, F.col("x")).otherwise(-F.col("x")).alias("size"), "x", "y", "pyramid_level", "scale"))
    return once.agg(ranked.alias("best")).select("best.pyramid_level", "best.scale", "best.x", "best.y")


def last_match(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def resolution_matches(have: Column, want: float, tolerance: float) -> Column:
    """Strict coverages take a tolerance of 1e-6, permissive ones 0.01."""
    return F.abs(have - want) <= abs(want) * tolerance

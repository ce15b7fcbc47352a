"""Maps as tables of RGBA cells (out_y, out_x, r, g, b, a), and images made of them.

A map of a coverage picks the pyramid level, takes the cell below the centre of every pixel, selects bands,
applies contrast or a colour map and relief, and lays the result on a background.  All of that is one plan; only
the finished image, of images.MAX_SIDE squared pixels at most, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color as C
from ..operators import pixels, statistics, vector
from ..sources import files, images, jpeg, pdf
from .coverage import Catalog, Coverage, window
from .styles import RasterStyle, VectorRule, channels, parse_raster_style, parse_vector_style

RGBA = ["r", "g", "b", "a"]


@dataclass
class Bounds:
    """What contrast needs of a band: extrema and a histogram of 256 bins."""

    low: float
    high: float
    bins: list[int]

    def stretch(self) -> tuple[float, float]:
        """The values at the second and the 98th hundredth of the histogram."""
        n, total, step = len(self.bins), sum(self.bins), (self.high - self.low) / 254
        before = np.concatenate([[0], np.cumsum(self.bins)])
        two = total / 100 * 2
        low = int(np.argmax(before[:n] >= two))
        most = np.flatnonzero(before[1:] <= total - two)
        return self.low + low * step, self.low + (int(most[-1]) if len(most) else 0) * step

    def equalised(self) -> list[int]:
        """Histogram equalisation over bins 1 to 255; 0 stays 0, 255 becomes 255."""
        part = np.cumsum(self.bins[1:256]) / max(1, sum(self.bins[1:256]))
        return [0, *(254 * part + 0.5).astype(int).tolist()[:-1], 255]


def bounds(px: DataFrame, value: Column, small: bool) -> Bounds:
    """small: of 8 bits and less, whose bins are their values."""
    flat = px.select(value.cast("double").alias("v")).where("v is not null")
    low, high = flat.agg(F.min("v"), F.max("v")).first()
    if low is None:
        return Bounds(0.0, 0.0, [0] * 256)
    hist = statistics.histogram(flat, "v") if small else statistics.binned(flat)
    bins = [0] * 256
    for b, n in hist.collect():  # 256 rows at most
        bins[b if 0 <= b < 256 else b + 128] = n
    return Bounds(low, high, bins)


def enhanced(v: Column, kind: str, of: Bounds, gamma: float = 1.0) -> Column:
    """0..255: kind is none, normalize (stretched between hundredths), histogram (equalised) or gamma."""
    if kind == "normalize":
        low, high = of.stretch()
        return C.stretched(v, F.lit(low), F.lit(high))
    if kind == "gamma":
        return C.gamma(v, F.lit(of.low), F.lit(of.high), gamma)
    plain = C.contrast(v, of.low, of.high)
    if kind == "histogram":
        return F.element_at(F.array(*[F.lit(x) for x in of.equalised()]), plain + 1)
    return plain


def rendered(cells: DataFrame, c: Coverage, style: RasterStyle, of: dict[int, Bounds], background: str = "#ffffff", transparent: bool = True) -> DataFrame:
    """RGBA of cells (out_y, out_x, bands); null bands are NO-DATA.  `of` has the bounds of the bands in use."""
    band = lambda k: F.element_at("bands", k + 1)
    mapped = bool(style.categories or style.points)
    if mapped and c.auto_ndvi and style.mono is None:
        red, nir = c.default_bands[0], c.default_bands[3]
        colour = style.mapped(C.ndvi(band(red), band(nir)))
    elif mapped:
        colour = style.mapped(band(style.mono or 0))
    elif c.pixel == "PALETTE" and style.mono is None:
        entries = F.array(*[F.struct(*[F.lit(int(x)).alias(n) for n, x in zip("rgb", p, strict=True)]) for p in c.palette])
        colour = F.try_element_at(entries, band(0).cast("int") + 1)
    else:
        chosen = shown_bands(c, style)
        parts = [enhanced(band(k), style.contrast, of[k], style.gamma) for k in chosen]
        parts = parts * 3 if len(parts) == 1 else parts
        colour = F.struct(*[p.cast("int").alias(n) for n, p in zip("rgb", parts, strict=True)])
    seen = cells.withColumn("p", F.when(F.col("bands").isNotNull(), colour))
    if style.relief is not None:
        value = cells.select(F.col("out_y").alias("r"), F.col("out_x").alias("c"), band(style.mono or 0).alias("v")).where("v is not null")
        shade = pixels.with_neighbours(value).select(F.col("r").alias("out_y"), F.col("c").alias("out_x"), C.relief(F.col("e"), style.relief).alias("shade"))
        lit = F.when(F.col("shade") >= 0, F.col("shade")).otherwise(1.0)
        dark = F.struct(*[F.floor(F.col(f"p.{n}") * lit + 0.5).cast("int").alias(n) for n in "rgb"])
        seen = seen.join(shade, ["out_y", "out_x"], "left").withColumn("p", F.when(F.col("p").isNotNull(), dark))
    alpha = int(255 * style.opacity + 0.5)
    return laid(seen.select("out_y", "out_x", *[F.col(f"p.{n}").alias(n) for n in "rgb"], F.when(F.col("p.r").isNotNull(), alpha).otherwise(0).alias("a")), background, transparent)


def shown_bands(c: Coverage, style: RasterStyle) -> list[int]:
    """Of a style that has no colour map: one band or three, as it says or as the coverage has them."""
    if style.mono is not None:
        return [style.mono]
    if style.triple is not None:
        return list(style.triple)
    if c.bands < 3:
        return [0]
    return c.default_bands[:3] if c.default_bands else [0, 1, 2]


def laid(cells: DataFrame, background: str, transparent: bool) -> DataFrame:
    """On a background; transparent: where nothing is drawn alpha stays 0, and partly drawn colours stay as they are."""
    shown = dict(zip("rgb", channels(background), strict=True))
    if transparent:
        return cells.select("out_y", "out_x", *[F.coalesce(F.col(n), F.lit(v)).alias(n) for n, v in shown.items()], "a")
    mixed = lambda n, v: F.floor((F.coalesce(F.col(n), F.lit(v)) * F.col("a") + v * (255 - F.col("a"))) / 255 + 0.5).cast("int")
    return cells.select("out_y", "out_x", *[mixed(n, v).alias(n) for n, v in shown.items()], F.lit(255).alias("a"))


def over(layers: Sequence[DataFrame]) -> DataFrame:
    """RGBA layers, the first at the bottom, painted over each other by their alpha."""
    every = None
    for k, layer in enumerate(layers):
        one = layer.select("out_y", "out_x", F.struct(F.lit(k).alias("k"), *[F.col(n).cast("double").alias(n) for n in RGBA]).alias("s"))
        every = one if every is None else every.unionByName(one)
    zero = F.struct(*[F.lit(0.0).alias(n) for n in RGBA])

    def paint(low: Column, top: Column) -> Column:
        a = top.a + low.a * (255 - top.a) / 255
        mixed = [F.when(a > 0, (top[n] * top.a + low[n] * low.a * (255 - top.a) / 255) / a).otherwise(0.0).alias(n) for n in "rgb"]
        return F.struct(*mixed, a.alias("a"))

    done = every.groupBy("out_y", "out_x").agg(F.aggregate(F.array_sort(F.collect_list("s")), zero, paint).alias("p"))
    return done.select("out_y", "out_x", *[F.floor(F.col(f"p.{n}") + 0.5).cast("int").alias(n) for n in RGBA])


def style_of(c: Coverage, style: RasterStyle | str | None) -> RasterStyle | None:
    """A style by its name in the coverage, as a document or ready; none for an unknown name."""
    if isinstance(style, RasterStyle):
        return style
    if style is None or style.lower() == "default":
        return RasterStyle()
    if style.lstrip().startswith("<"):
        return parse_raster_style(style)
    return parse_raster_style(c.styles[style.lower()]) if style.lower() in c.styles else None


def map_raster(
    catalog: Catalog, name: str, box: Sequence[float], width: int, height: int, style: RasterStyle | str | None = None, background: str = "#ffffff", transparent: bool = False,
    level: int | None = None,
) -> DataFrame | None:
    """The map of a box (minx, miny, maxx, maxy); None for an unknown coverage or style, or a box or size that is none."""
    c = catalog.get(name)
    style = None if c is None else style_of(c, style)
    if c is None or style is None or width < 1 or height < 1 or box[2] <= box[0] or box[3] <= box[1] or width * height > images.MAX_SIDE**2:
        return None
    xres, yres = (box[2] - box[0]) / width, (box[3] - box[1]) / height
    level = catalog.best_level(name, xres, yres) if level is None else level
    grid = window(catalog.spark, width, height).withColumns({"x": F.lit(float(box[0])) + (F.col("out_x") + 0.5) * xres, "y": F.lit(float(box[3])) - (F.col("out_y") + 0.5) * yres})
    got = catalog.sampled(name, grid, level, ["out_y", "out_x"])
    cells = grid.select("out_y", "out_x").join(got, ["out_y", "out_x"], "left")
    c = c.at(level)
    return rendered(cells, c, style, _bounds(catalog, c, style), background, transparent)


def _bounds(catalog: Catalog, c: Coverage, style: RasterStyle) -> dict[int, Bounds]:
    if style.categories or style.points or (c.pixel == "PALETTE" and style.mono is None):
        return {}
    small = c.sample in ("1-BIT", "2-BIT", "4-BIT", "UINT8", "INT8")
    if style.contrast == "none" and c.sample in ("1-BIT", "2-BIT", "4-BIT", "UINT8"):
        return {k: Bounds(0.0, 255.0, [0] * 256) for k in range(c.bands)}
    px = catalog.pixels(c.name, 0)
    nodata = F.array(*[F.lit(v) for v in c.nodata])
    return {k: bounds(px.where(F.col("bands") != nodata), F.element_at("bands", k + 1), small) for k in set(shown_bands(c, style))}


def map_group(catalog: Catalog, layers: Sequence[tuple[str, RasterStyle | str | None]], box: Sequence[float], width: int, height: int, background: str = "#ffffff", transparent: bool = False) -> DataFrame | None:
    """Coverages (name, style) painted over each other, the first at the bottom."""
    drawn = [map_raster(catalog, n, box, width, height, s, background, True) for n, s in layers]
    if not drawn or any(x is None for x in drawn):
        return None
    return laid(over(drawn), background, transparent)


def tile_image(catalog: Catalog, name: str, section_id: int, tile_id: int, bands: Sequence[int] | None = None, level: int = 0, background: str = "#ffffff", transparent: bool = False) -> DataFrame | None:
    """A whole tile: as the coverage is, of one band as gray, or of three as RGB; None for an unknown tile or band."""
    c = catalog.get(name)
    if c is None or (bands is not None and (len(bands) not in (1, 3) or not all(0 <= b < c.bands for b in bands))):
        return None
    c = c.at(level)
    px = catalog.pixels(name, level, section_id).where(F.col("tile_id") == tile_id)
    if px.isEmpty():
        return None
    nodata = F.array(*[F.lit(v) for v in c.nodata])
    cells = px.select((F.col("r") % c.tile_h).alias("out_y"), (F.col("c") % c.tile_w).alias("out_x"), F.when(F.col("bands") != nodata, F.col("bands")).alias("bands"))
    cells = window(catalog.spark, c.tile_w, c.tile_h).join(cells, ["out_y", "out_x"], "left")
    style = RasterStyle()
    if bands is not None:
        style.mono, style.triple = (bands[0], None) if len(bands) == 1 else (None, tuple(bands))
    return rendered(cells, c, style, _bounds(catalog, c, style), background, transparent)


def blank(spark: SparkSession, width: int, height: int, background: str = "#ffffff", transparent: bool = False) -> DataFrame:
    shown = dict(zip("rgb", channels(background), strict=True))
    return window(spark, width, height).select("out_y", "out_x", *[F.lit(v).alias(n) for n, v in shown.items()], F.lit(0 if transparent else 255).alias("a"))


def array(cells: DataFrame | None, width: int, height: int) -> np.ndarray | None:
    """(h, w, 4) of a map on the driver."""
    if cells is None:
        return None
    return images.gathered(cells.select("out_y", "out_x", F.array(*[F.col(n).cast("double") for n in RGBA]).alias("bands")), width, height, 4).astype(np.uint8)


MIMES = ("image/png", "image/tiff", "image/jpeg", "application/x-pdf")


def encoded(cells: DataFrame | None, width: int, height: int, mime: str = "image/png", quality: int = 80) -> bytes | None:
    """The image: PNG or PDF with alpha where any pixel has it, TIFF or JPEG; None for other types."""
    if cells is None or mime not in MIMES:
        return None
    x = array(cells, width, height)
    if mime == "image/jpeg":
        return jpeg.encode(cells.sparkSession, x[:, :, :3], quality)
    if mime == "image/tiff":
        return images.encode_tiff(x[:, :, :3], "UINT8")
    if mime == "application/x-pdf":
        return pdf.encode(x)
    return images.encode_png(x if (x[:, :, 3] < 255).any() else x[:, :, :3])


def get_map_image(catalog: Catalog, name: str, box: Sequence[float], width: int, height: int, style: str | None = None, mime: str = "image/png", background: str = "#ffffff", transparent: bool = False, quality: int = 80) -> bytes | None:
    """The image of a map; None for arguments that are none, such as sides under 64 pixels."""
    if width < 64 or height < 64 or mime not in MIMES:
        return None
    return encoded(map_raster(catalog, name, box, width, height, style, background, transparent), width, height, mime, quality)


def histogram_image(hist: DataFrame) -> DataFrame:
    """(out_y, out_x, v), 512 x 160 gray: bars of bins 1 to 255 as high as the most frequent allows, above a bar of grays."""
    bars = hist.where("bin between 1 and 255").select("bin", F.col("n").cast("double").alias("n"))
    most = bars.agg(F.max("n")).first()[0] or 1.0
    y, j = F.col("out_y"), F.floor(F.col("out_x") / 2) + 1
    grid = window(hist.sparkSession, 512, 160).withColumn("bin", j)
    drawn = (F.col("bin") < 256) & (y <= 128) & (128 - y < 128 * F.coalesce("n", F.lit(0.0)) / F.lit(most))
    v = F.when((y >= 135) & (F.col("bin") < 256), F.col("bin")).when(drawn, 128).otherwise(255)
    return grid.join(F.broadcast(bars), "bin", "left").select("out_y", "out_x", v.cast("int").alias("v"))  # 255 rows at most


def histogram_from_image(spark: SparkSession, content: bytes, band: int) -> DataFrame | None:
    """The histogram image of a band of an encoded image; None if it can't be read or lacks the band."""
    try:
        _, x, _ = files.decode(content)
    except ValueError:
        return None
    if not 0 <= band < x.shape[2] or x.dtype != np.uint8:
        return None
    n = np.bincount(x[:, :, band].reshape(-1), minlength=256)
    return histogram_image(spark.createDataFrame([(i, int(k)) for i, k in enumerate(n)], "bin int, n long"))


# -- vector layers: geometries are arrays of (x, y)


def _cell(box: Sequence[float], width: int, height: int, x: Column, y: Column) -> tuple[Column, Column]:
    return F.floor((F.lit(float(box[3])) - y) / ((box[3] - box[1]) / height)).cast("long"), F.floor((x - F.lit(float(box[0]))) / ((box[2] - box[0]) / width)).cast("long")


def _inside(cells: DataFrame, width: int, height: int) -> DataFrame:
    return cells.where((F.col("out_y") >= 0) & (F.col("out_y") < height) & (F.col("out_x") >= 0) & (F.col("out_x") < width))


def points_drawn(features: DataFrame, box: Sequence[float], width: int, height: int, size: int = 1) -> DataFrame:
    """(fid, out_y, out_x) of square marks of size x size pixels around points (fid, x, y)."""
    row, col = _cell(box, width, height, F.col("x"), F.col("y"))
    reach = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-(size // 2), size - size // 2) for dx in range(-(size // 2), size - size // 2)])
    marks = features.select("fid", row.alias("r"), col.alias("c"), F.explode(reach).alias("o"))
    return _inside(marks.select("fid", (F.col("r") + F.col("o.dy")).alias("out_y"), (F.col("c") + F.col("o.dx")).alias("out_x")), width, height)


def lines_drawn(features: DataFrame, box: Sequence[float], width: int, height: int) -> DataFrame:
    """(fid, out_y, out_x) of lines (fid, path: array<struct<x, y>>): each segment in steps of half a pixel at most, ends included."""
    pairs = F.transform(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda a, i: F.struct(a.alias("a"), F.get(F.col("path"), i + 1).alias("b")))
    dealt = vector.spread(features.select("fid", "path"), "fid", "path")  # a path becomes many cells, whose distinct ones a task holds
    seg = dealt.select("fid", F.explode(pairs).alias("s")).select("fid", "s.a", "s.b")
    px, py = (box[2] - box[0]) / width, (box[3] - box[1]) / height
    steps = F.greatest(F.ceil(2 * F.greatest(F.abs(F.col("b.x") - F.col("a.x")) / px, F.abs(F.col("b.y") - F.col("a.y")) / py)), F.lit(1))
    walk = seg.select("fid", "a", "b", steps.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), steps.cast("long"))).alias("k"))
    t = F.col("k") / F.col("n")
    row, col = _cell(box, width, height, F.col("a.x") + (F.col("b.x") - F.col("a.x")) * t, F.col("a.y") + (F.col("b.y") - F.col("a.y")) * t)
    return _inside(walk.select("fid", row.alias("out_y"), col.alias("out_x")), width, height).distinct()


def _rings(features: DataFrame) -> DataFrame:
    """Polygons (rings: array of paths) as a row for each ring (path); others as they are."""
    return features.withColumn("path", F.explode("rings")).drop("rings") if "rings" in features.columns else features


def polygons_drawn(features: DataFrame, box: Sequence[float], width: int, height: int) -> DataFrame:
    """(fid, out_y, out_x) of the pixels whose centres lie in rings (fid, path: closed or not; or several in rings): crossings per pixel row, pair by pair.

    Rings of one fid, in a row or in many, are a polygon: those within others are its holes.
    """
    features = _rings(features)
    px, py = (box[2] - box[0]) / width, (box[3] - box[1]) / height
    n = F.size("path")
    edges = F.transform("path", lambda a, i: F.struct(a.alias("a"), F.get(F.col("path"), (i + 1) % n).alias("b")))
    seg = features.select("fid", F.explode(edges).alias("s")).select("fid", F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    top, low = F.greatest("ay", "by"), F.least("ay", "by")
    first = F.greatest(F.ceil((F.lit(float(box[3])) - top) / py - 0.5), F.lit(0)).cast("long")
    last = F.least(F.floor((F.lit(float(box[3])) - low) / py - 0.5), F.lit(height - 1)).cast("long")
    rows = seg.select("*", first.alias("k0"), last.alias("k1")).where("k1 >= k0").select("*", F.explode(F.sequence("k0", "k1")).alias("out_y"))
    y = F.lit(float(box[3])) - (F.col("out_y") + 0.5) * py
    met = rows.where((F.least("ay", "by") <= y) & (y < F.greatest("ay", "by")))  # half open, so that a corner counts once
    cross = met.select("fid", "out_y", (F.col("ax") + (y - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))).alias("x"))
    xs = cross.groupBy("fid", "out_y").agg(F.array_sort(F.collect_list("x")).alias("x"))
    span = F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / 2).cast("int") - 1), lambda k: F.struct(F.get("x", 2 * k).alias("a"), F.get("x", 2 * k + 1).alias("b")))
    runs = xs.where("size(x) > 1").select("fid", "out_y", F.explode(span).alias("s"))
    c0 = F.greatest(F.ceil((F.col("s.a") - float(box[0])) / px - 0.5), F.lit(0)).cast("long")
    c1 = F.least(F.ceil((F.col("s.b") - float(box[0])) / px - 0.5) - 1, F.lit(width - 1)).cast("long")
    return runs.select("fid", "out_y", c0.alias("c0"), c1.alias("c1")).where("c1 >= c0").select("fid", "out_y", F.explode(F.sequence("c0", "c1")).alias("out_x"))


def map_vector(drawn: DataFrame, colours: DataFrame, width: int, height: int, background: str = "#ffffff", transparent: bool = False) -> DataFrame:
    """RGBA of marks (fid, out_y, out_x): of a pixel the feature with the largest (paint, fid) in colours (fid, paint, r, g, b, a) shows."""
    top = drawn.join(colours, "fid").groupBy("out_y", "out_x").agg(F.max_by(F.struct(*RGBA), F.struct("paint", "fid")).alias("p"))
    cells = window(drawn.sparkSession, width, height).join(top, ["out_y", "out_x"], "left")
    return laid(cells.select("out_y", "out_x", *[F.col(f"p.{n}").alias(n) for n in "rgb"], F.coalesce("p.a", F.lit(0)).alias("a")), background, transparent)


def map_layer(features: DataFrame, kind: str, rules: Sequence[VectorRule], box: Sequence[float], width: int, height: int, background: str = "#ffffff", transparent: bool = False) -> DataFrame:
    """Features (fid; x, y or path; attributes) drawn by the first rule of each that holds at the map's scale; later rules and fids paint over earlier ones.

    kind: point, line or polygon.  A polygon's stroke is painted over its fill; it has a path, or rings with holes within others.
    """
    if kind == "polygon":
        features = _rings(features)
    scale = C.scale_denominator((box[2] - box[0]) / width, (box[3] - box[1]) / height)
    kinds = {f.name: "number" if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "decimal") else "text" for f in features.schema.fields}
    tests = [(r.name, r.test(kinds), r.min_scale, r.max_scale) for r in rules if not r.otherwise]
    last = next((r.name for r in rules if r.otherwise), None)
    ruled = features.withColumn("_rule", vector.first_rule(tests, scale, last))
    marks, colours = None, None
    for k, r in enumerate(rules):
        mine = ruled.where(F.col("_rule") == r.name)
        parts = []
        if kind == "point" and r.fill:
            parts.append((points_drawn(mine, box, width, height, r.size), r.fill, r.fill_opacity))
        if kind == "polygon" and r.fill:
            parts.append((polygons_drawn(mine, box, width, height), r.fill, r.fill_opacity))
        if kind in ("line", "polygon") and r.stroke:
            path = F.concat("path", F.slice("path", 1, 1)) if kind == "polygon" else F.col("path")
            parts.append((lines_drawn(mine.withColumn("path", path), box, width, height), r.stroke, r.stroke_opacity))
        for j, (cells, colour, opacity) in enumerate(parts):
            one = cells.withColumn("paint", F.lit(2 * k + j))
            marks = one if marks is None else marks.unionByName(one)
            row = (2 * k + j, *channels(colour), int(255 * opacity + 0.5))
            colours = [row] if colours is None else [*colours, row]
    if marks is None:
        return blank(features.sparkSession, width, height, background, transparent)
    table = F.broadcast(features.sparkSession.createDataFrame(colours, "paint int, r int, g int, b int, a int"))  # two rows a rule at most
    top = marks.groupBy("out_y", "out_x").agg(F.max(F.struct("paint", "fid")).alias("m")).select("out_y", "out_x", F.col("m.paint").alias("paint")).join(table, "paint")
    cells = window(features.sparkSession, width, height).join(top, ["out_y", "out_x"], "left")
    return laid(cells.select("out_y", "out_x", "r", "g", "b", F.coalesce("a", F.lit(0)).alias("a")), background, transparent)


def get_vector_image(catalog: Catalog, name: str, box: Sequence[float], width: int, height: int, style: str | None = None, mime: str = "image/png", background: str = "#ffffff", transparent: bool = False, quality: int = 80) -> bytes | None:
    """The image of a vector layer of the catalog; None for an unknown layer or style, or arguments that are none."""
    layer = catalog.vector(name)
    if layer is None or width < 64 or height < 64 or mime not in MIMES:
        return None
    known = {k.lower(): v for k, v in layer["styles"].items()}
    if style is not None and style.lower() != "default" and style.lower() not in known:
        return None
    rules = parse_vector_style(known[style.lower()]) if style is not None and style.lower() in known else [VectorRule("default", fill="#808080", stroke="#000000")]
    return encoded(map_layer(catalog.features(name), layer["kind"], rules, box, width, height, background, transparent), width, height, mime, quality)

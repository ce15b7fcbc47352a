"""The catalog's functions by their SQL names and argument orders: statement(catalog, "SELECT Name(arguments)").

Arguments are SQL expressions of literals; points and boxes are MakePoint(x, y, srid) and BuildMBR(x1, y1, x2, y2,
srid).  Results are those of the names' contracts: 1, 0 or -1, null, or bytes.  Functions that read or write
files are there only with `relaxed`.  A database prefix names another catalog of `attached`; a transaction flag is
taken and has no effect, as each call is one change.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Row

from ..functions import sqlnames
from ..functions.color import channels_of
from ..sources import fonts
from ..types import tile_form
from . import export, load, maps
from .coverage import Catalog

_STATEMENT = re.compile(r"\s*SELECT\s+(\w+)\s*\((.*)\)\s*;?\s*", re.I | re.S)
_TIFF = re.compile(r"Write(Section)?(TripleBand|MonoBand)?(GeoTiff|TiffTfw|Tiff)", re.I)
POINT = "struct(cast(x AS double) AS x, cast(y AS double) AS y, srid AS srid)"
BOX = "struct(cast(least(a, c) AS double) AS minx, cast(least(b, d) AS double) AS miny, cast(greatest(a, c) AS double) AS maxx, cast(greatest(b, d) AS double) AS maxy, srid AS srid)"
FILES: set[str] = set()
CALLS: dict[str, Callable] = {}


def named(*names: str, files: bool = False):
    def add(f):
        for n in names:
            CALLS[n.lower()] = f
            if files:
                FILES.add(n.lower())
        return f

    return add


def statement(catalog: Catalog, text: str, attached: dict[str, Catalog] | None = None, relaxed: bool = True, prefix: str = ""):
    """The result of one call; ValueError for a name that isn't known."""
    m = _STATEMENT.fullmatch(text)
    name = "" if m is None else m[1].lower()
    name = name[len(prefix) :] if prefix and name.startswith(prefix.lower()) else name
    if name not in CALLS and not _TIFF.fullmatch(name) or (not relaxed and (name in FILES or name.startswith("write"))):
        raise ValueError(f"no such function: {name or text[:80]}")
    spark = catalog.spark
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION MakePoint(x DOUBLE, y DOUBLE, srid INT DEFAULT -1) RETURNS STRUCT<x: DOUBLE, y: DOUBLE, srid: INT> RETURN {POINT}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION BuildMBR(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE, srid INT DEFAULT -1) RETURNS STRUCT<minx: DOUBLE, miny: DOUBLE, maxx: DOUBLE, maxy: DOUBLE, srid: INT> RETURN {BOX}")
    values = list(spark.sql(f"SELECT {m[2]}").first()) if m[2].strip() else []
    values = [float(v) if type(v).__name__ == "Decimal" else bytes(v) if isinstance(v, bytearray) else v for v in values]
    if (t := _TIFF.fullmatch(name)) is not None:
        return _tiff(catalog, attached or {}, t, values)
    return CALLS[name](catalog, attached or {}, *values)


def _of(catalog: Catalog, attached: dict[str, Catalog], prefix) -> Catalog | None:
    return catalog if prefix is None else attached.get(prefix)


def _kinds(values, *kinds) -> bool:
    return all(isinstance(v, k) and not isinstance(v, bool) for v, k in zip(values, kinds, strict=True))


def _box(value) -> tuple[float, float, float, float] | None:
    return (value.minx, value.miny, value.maxx, value.maxy) if isinstance(value, Row) and "minx" in value and value.maxx > value.minx and value.maxy > value.miny else None


NUMBER = (int, float)


@named("CreateRasterCoverage")
def _create(catalog, _, name, sample, pixel, bands, codec, quality, tile_w, tile_h, srid, xres, yres=None, nodata=None, strict=0, mixed=0, paths=0, md5=0, summary=0, queryable=0):
    if not _kinds((name, sample, pixel, bands, codec, quality, tile_w, tile_h, srid, xres), str, str, str, int, str, int, int, int, int, NUMBER) or not 0 <= quality <= 100:
        return -1
    values = list(nodata.bands) if isinstance(nodata, Row) and nodata.sample_type != "NONE" else None
    done = catalog.create(name, sample, pixel, bands, codec, tile_w, tile_h, srid, xres, yres, values, bool(strict), bool(mixed))
    if done == 1 and queryable:
        catalog._change(name, queryable=True)
    return done


@named("CopyRasterCoverage")
def _copy(catalog, attached, prefix, name, transaction=0):
    if not _kinds((prefix, name), str, str):
        return -1
    return 0 if prefix not in attached else catalog.copy(name, name, attached[prefix])


@named("DeleteSection")
def _delete(catalog, _, name, section, transaction=0):
    return catalog.delete_section(name, section) if _kinds((name, section), str, int) else -1


@named("DropRasterCoverage")
def _drop(catalog, _, name, transaction=0):
    return catalog.drop(name) if _kinds((name,), str) else -1


@named("SetRasterCoverageInfos")
def _infos(catalog, _, name, title, abstract, queryable=None):
    return catalog.set_infos(name, title, abstract, None if queryable is None else bool(queryable)) if _kinds((name, title, abstract), str, str, str) else -1


@named("SetRasterCoverageCopyright")
def _copyright(catalog, _, name, text, license=None):
    return catalog.set_copyright(name, text, license) if _kinds((name,), str) and (text is None or isinstance(text, str)) else -1


@named("SetRasterCoverageDefaultBands")
def _bands(catalog, _, name, *bands):
    return catalog.set_default_bands(name, *bands) if _kinds((name, *bands), str, int, int, int, int) else -1


@named("EnableRasterCoverageAutoNDVI")
def _enable(catalog, _, name, on):
    return catalog.enable_auto_ndvi(name, bool(on)) if _kinds((name, on), str, int) else -1


@named("IsRasterCoverageAutoNdviEnabled")
def _enabled(catalog, attached, prefix, name):
    held = _of(catalog, attached, prefix)
    return -1 if held is None or not isinstance(name, str) else held.is_auto_ndvi(name)


@named("Pyramidize")
def _pyramidize(catalog, _, name, section=None, force=0, transaction=0):
    return catalog.pyramidize(name, 1, section, bool(force)) if _kinds((name,), str) and (section is None or isinstance(section, int)) else -1


@named("PyramidizeMonolithic")
def _monolithic(catalog, _, name, levels=0, transaction=0):
    return catalog.pyramidize_monolithic(name, max(1, levels)) if _kinds((name, levels), str, int) else -1


@named("DePyramidize")
def _depyramidize(catalog, _, name, section=None, transaction=0):
    return catalog.depyramidize(name, section) if _kinds((name,), str) and (section is None or isinstance(section, int)) else -1


@named("GetPixelFromRasterByPoint")
def _pixel(catalog, attached, prefix, name, point, level, yres=None):
    """A pixel as a row, at a level or at a resolution; null where nothing is known."""
    held = _of(catalog, attached, prefix)
    c = held.get(name) if held is not None and isinstance(name, str) else None
    if c is None or not isinstance(point, Row) or "x" not in point or (yres is None and not _kinds((level,), int)) or (yres is not None and not _kinds((level, yres), NUMBER, NUMBER)):
        return None
    at = level if yres is None else held.level_of(name, level, yres)
    if at is None or at not in held.levels(name):
        return None
    found = held.sampled(name, held.spark.createDataFrame([(point.x, point.y)], "x double, y double"), at).first()
    return Row(sample_type=c.sample, pixel_type=c.pixel, bands=list(found.bands) if found else list(c.nodata), transparent=False)


@named("GetMapImageFromRaster")
def _map(catalog, attached, prefix, name, box, width, height, style="default", mime="image/png", background="#ffffff", transparent=0, quality=80, reaspect=0):
    held, box = _of(catalog, attached, prefix), _box(box)
    if held is None or box is None or not _kinds((name, width, height, style, mime, background), str, int, int, str, str, str) or channels_of(background) is None:
        return None
    if not reaspect and abs((box[2] - box[0]) / (box[3] - box[1]) - width / height) > 0.01 * width / height:
        return None
    return maps.get_map_image(held, name, box, width, height, style, mime, background, bool(transparent), quality)


@named("GetMapImageFromVector")
def _vector_map(catalog, attached, prefix, name, box, width, height, style="default", mime="image/png", background="#ffffff", transparent=0, quality=80, reaspect=0):
    held, box = _of(catalog, attached, prefix), _box(box)
    if held is None or box is None or not _kinds((name, width, height, style, mime, background), str, int, int, str, str, str) or channels_of(background) is None:
        return None
    if not reaspect and abs((box[2] - box[0]) / (box[3] - box[1]) - width / height) > 0.01 * width / height:
        return None
    return maps.get_vector_image(held, name, box, width, height, style, mime, background, bool(transparent), quality)


@named("GetMaxThreads")
def _threads(catalog, _):
    return sqlnames.max_threads(catalog.spark)


@named("SetMaxThreads")
def _set_threads(catalog, _, n):
    return sqlnames.set_max_threads(catalog.spark, n)


@named("IsValidRasterTile")
def _valid_tile(catalog, attached, prefix, name, level, tile, even=None):
    """A tile here is a struct of sample_type, pixel_type, bands (a number) and compression."""
    held = _of(catalog, attached, prefix)
    c = held.get(name) if held is not None and isinstance(name, str) else None
    if c is None or not _kinds((level,), int) or not isinstance(tile, Row):
        return -1
    return int((tile.pixel_type, tile.sample_type, tile.bands, tile.compression) == tile_form(c.pixel, c.sample, c.bands, c.compression, level))


def _tile(catalog, attached, prefix, name, tile, bands, background, transparent):
    held = _of(catalog, attached, prefix)
    c = held.get(name) if held is not None and isinstance(name, str) else None
    if c is None or not _kinds((tile, background), int, str) or channels_of(background) is None:
        return None
    # a tile's number here is section number x 2^32 + its number in the section
    return maps.encoded(maps.tile_image(held, name, tile >> 32, tile & 0xFFFFFFFF, bands, 0, background, bool(transparent)), c.tile_w, c.tile_h)


@named("GetTileImage")
def _tile_image(catalog, attached, prefix, name, tile, background="#ffffff", transparent=0):
    return _tile(catalog, attached, prefix, name, tile, None, background, transparent)


@named("GetTripleBandTileImage")
def _triple_tile(catalog, attached, prefix, name, tile, red, green, blue, background="#ffffff", transparent=0):
    return _tile(catalog, attached, prefix, name, tile, (red, green, blue), background, transparent) if _kinds((red, green, blue), int, int, int) else None


@named("GetMonoBandTileImage")
def _mono_tile(catalog, attached, prefix, name, tile, band, background="#ffffff", transparent=0):
    return _tile(catalog, attached, prefix, name, tile, (band,), background, transparent) if _kinds((band,), int) else None


@named("GetBandStatistics_Histogram")
def _histogram(catalog, _, name, band):
    """Of a coverage, by name, in place of its serialized statistics."""
    c = catalog.get(name)
    if c is None or not _kinds((band,), int) or not 0 <= band < c.bands:
        return None
    small = c.sample in ("1-BIT", "2-BIT", "4-BIT", "UINT8", "INT8")
    found = maps.bounds(catalog.pixels(name, 0), maps.F.element_at("bands", band + 1), small)
    return _gray(maps.histogram_image(catalog.spark.createDataFrame(list(enumerate(found.bins)), "bin int, n long")))


@named("GetBandHistogramFromImage")
def _histogram_of_image(catalog, _, content, mime, band):
    if not _kinds((content, mime, band), bytes, str, int) or mime not in ("image/png", "image/tiff"):
        return None
    return _gray(maps.histogram_from_image(catalog.spark, content, band))


def _gray(cells) -> bytes | None:
    if cells is None:
        return None
    x = maps.images.gathered(cells.select("out_y", "out_x", maps.F.array(maps.F.col("v").cast("double")).alias("bands")), 512, 160, 1)
    return maps.images.encode_png(x[:, :, 0].astype("u1"))


@named("ExportRawPixels")
def _raw(catalog, attached, prefix, name, width, height, box, xres, yres=None, big_endian=0):
    held, box = _of(catalog, attached, prefix), _box(box)
    return None if held is None or box is None or not _kinds((name, width, height, xres), str, int, int, NUMBER) else export.raw_pixels(held, name, width, height, box, xres, yres, None, bool(big_endian))


@named("ExportSectionRawPixels")
def _section_raw(catalog, attached, prefix, name, section, width, height, box, xres, yres=None, big_endian=0):
    held, box = _of(catalog, attached, prefix), _box(box)
    return None if held is None or box is None or not _kinds((name, section, width, height, xres), str, int, int, int, NUMBER) else export.raw_pixels(held, name, width, height, box, xres, yres, section, bool(big_endian))


@named("ImportSectionRawPixels")
def _import_raw(catalog, _, name, section, width, height, content, box, pyramidize=0, transaction=0, big_endian=0):
    box = _box(box)
    return -1 if box is None or not _kinds((name, section, width, height, content), str, str, int, int, bytes) else load.import_section_raw_pixels(catalog, name, section, width, height, content, box, bool(pyramidize), bool(big_endian))


@named("LoadRaster", files=True)
def _load(catalog, _, name, path, world=0, srid=None, pyramidize=0, transaction=0):
    return load.load_raster(catalog, name, path, bool(world), None if srid in (None, -1) else srid, bool(pyramidize)) if _kinds((name, path), str, str) else -1


@named("LoadRastersFromDir", files=True)
def _load_dir(catalog, _, name, path, ending=None, world=0, srid=None, pyramidize=0, transaction=0):
    return load.load_rasters_from_dir(catalog, name, path, ending, bool(world), None if srid in (None, -1) else srid, bool(pyramidize)) if _kinds((name, path), str, str) else -1


def _tiff(catalog, attached, m, values):
    """Write[Section][TripleBand|MonoBand](GeoTiff|TiffTfw|Tiff): prefix, coverage, [section], path, width, height, [bands], box, resolutions, [world file], compression, tile."""
    left = list(values)
    take = lambda n=1: [left.pop(0) for _ in range(n)]
    n_bands = {None: 0, "tripleband": 3, "monoband": 1}[m[2] and m[2].lower()]
    if len(left) < 7 + bool(m[1]) + n_bands:
        return -1
    (prefix, name), section = take(2), take()[0] if m[1] else None
    (path, width, height), bands, (box, xres) = take(3), take(n_bands), take(2)
    held, box, kind = _of(catalog, attached, prefix), _box(box), m[3].lower()
    yres = take()[0] if left else xres
    world = take()[0] if left and kind == "geotiff" else kind == "tifftfw"
    codec = take()[0] if left else "NONE"
    if held is None or box is None or not _kinds((name, path, width, height, xres, yres, codec), str, str, int, int, NUMBER, NUMBER, str) or not all(isinstance(b, int) for b in bands) or (m[1] and not isinstance(section, int)):
        return -1
    if codec.upper() not in ("NONE", "DEFLATE"):
        return 0
    where = (path.rpartition(".")[0] or path) + ".tfw" if world else None
    return export.write_tiff(held, name, path, width, height, box, xres, section, bands or None, kind == "geotiff", where, codec.upper() == "DEFLATE", yres)


def _grid(catalog, attached, values, section: bool, ndvi: bool):
    left = list(values)
    take = lambda n=1: [left.pop(0) for _ in range(n)]
    (prefix, name), part = take(2), take()[0] if section else None
    (path, width, height), bands, (box, res) = take(3), take(2 * ndvi), take(2)
    centred, digits = take()[0] if left else 0, take()[0] if left else 4
    held, box = _of(catalog, attached, prefix), _box(box)
    if held is None or box is None or not _kinds((name, path, width, height, res, digits, *bands), str, str, int, int, NUMBER, int, *[int] * len(bands)) or (section and not isinstance(part, int)):
        return -1
    if ndvi:
        return export.write_ndvi_ascii_grid(held, name, path, width, height, box, res, *bands, part, bool(centred), digits)
    return export.write_ascii_grid(held, name, path, width, height, box, res, part, bool(centred), digits)


for _name, _section, _ndvi in (("WriteAsciiGrid", False, False), ("WriteSectionAsciiGrid", True, False), ("WriteNdviAsciiGrid", False, True), ("WriteSectionNdviAsciiGrid", True, True)):
    named(_name, files=True)(lambda catalog, attached, *values, s=_section, n=_ndvi: _grid(catalog, attached, values, s, n))


def _jpeg(catalog, attached, values, section: bool, world: bool):
    left = list(values)
    take = lambda n=1: [left.pop(0) for _ in range(n)]
    (prefix, name), part = take(2), take()[0] if section else None
    (path, width, height, box, xres) = take(5)
    yres, quality = take()[0] if left else xres, take()[0] if left else 80
    held, box = _of(catalog, attached, prefix), _box(box)
    if held is None or box is None or not _kinds((name, path, width, height, xres, yres, quality), str, str, int, int, NUMBER, NUMBER, int) or (section and not isinstance(part, int)):
        return -1
    return export.write_jpeg(held, name, path, width, height, box, xres, yres, part, quality, (path.rpartition(".")[0] or path) + ".jgw" if world else None)


for _name, _section, _world in (("WriteJpeg", False, False), ("WriteJpegJgw", False, True), ("WriteSectionJpeg", True, False), ("WriteSectionJpegJgw", True, True)):
    named(_name, files=True)(lambda catalog, attached, *values, s=_section, w=_world: _jpeg(catalog, attached, values, s, w))


# -- fonts: the object is the file's bytes


@named("IsValidFont")
def _valid_font(catalog, _, content):
    return -1 if not isinstance(content, bytes) else int(fonts.names(content) is not None)


@named("CheckFontFacename")
def _check_font(catalog, _, facename, content):
    found = fonts.names(content) if isinstance(content, bytes) else None
    return -1 if not isinstance(facename, str) or not isinstance(content, bytes) else int(found is not None and found["facename"] == facename)


for _name, _key, _none in (("GetFontFamily", "family", None), ("GetFontFacename", "facename", None), ("IsFontBold", "bold", -1), ("IsFontItalic", "italic", -1)):
    named(_name)(lambda catalog, attached, content, k=_key, none=_none: (fonts.names(content) or {k: none})[k] if isinstance(content, bytes) else none)


def _font_file(catalog: Catalog, facename: str) -> str:
    return f"{catalog.root}/_fonts/{facename.encode().hex()}"


@named("LoadFontFromFile", files=True)
def _load_font(catalog, _, path):
    if not isinstance(path, str):
        return -1
    found = catalog.spark.read.format("binaryFile").load(path).select("content").first()
    names = fonts.names(bytes(found[0])) if found else None
    if names is None:
        return 0
    export._put(catalog, _font_file(catalog, names["facename"]), bytes(found[0]))
    return 1


@named("ExportFontToFile", files=True)
def _export_font(catalog, attached, prefix, facename, path):
    held = _of(catalog, attached, prefix)
    if held is None or not _kinds((facename, path), str, str):
        return -1
    at = _font_file(held, facename)
    if not held._fs.exists(held._path(at)):
        return 0
    export._put(held, path, bytes(held.spark.read.format("binaryFile").load(at).select("content").first()[0]))
    return 1



"""Registered queries through the catalog: coverages are stored, changed, exported, loaded and drawn, and read back.

The stored coverage "mb" has two sections of the four-band image of `embeddings`: rows under 100 as they are, and
rows from 80 on as 250 less their values, so that the second covers the first.  Row r lies at y = 100,000 - r.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_queries import FT, IM, MB, features, grid, image, multiband, query, table
from .functions import buffers, pixel, shapes, sqlnames
from .operators import pixels as X
from .operators import statistics, vector
from .operators.codec import decoded
from .plans import calls, export, load, maps
from .plans.coverage import Catalog
from .plans.styles import RasterStyle
from .scratch import folder
from .sources import ascii_grid, files, raw
from .streaming import ingest

TOP = 100_000.0
BANDS = ["b0", "b1", "b2", "b3"]
#: The stored coverage as a view: where both sections have a pixel, the second shows.
CV = MB + ", n AS (SELECT max(r) + 1 AS h FROM mb), cv AS (SELECT r, c, " + ", ".join(f"CASE WHEN r >= 80 THEN 250 - {b} ELSE {b} END AS {b}" for b in BANDS) + " FROM mb)"
SECTIONS = MB + ", se AS (SELECT 1 AS s, r, c, b0, b1, b2, b3 FROM mb WHERE r < 100 UNION ALL SELECT 2, r - 80, c, 250 - b0, 250 - b1, 250 - b2, 250 - b3 FROM mb WHERE r >= 80)"


def stored(spark: SparkSession, d: str, name: str = "mb", catalog: Catalog | None = None) -> Catalog:
    cat = catalog or Catalog(spark, folder(spark))
    px = multiband(spark, d)
    height = px.agg(F.max("r")).first()[0] + 1
    run = lambda text: calls.statement(cat, text)
    made = run(f"SELECT CreateRasterCoverage('{name}', 'UINT8', 'MULTIBAND', 4, 'NONE', 100, 256, 256, -1, 1.0)")
    first = px.where("r < 100").select("r", "c", F.array(*BANDS).alias("bands"))
    second = px.where("r >= 80").select((F.col("r") - 80).alias("r"), "c", F.array(*[250 - F.col(b) for b in BANDS]).alias("bands"))
    assert made == 1 and cat.load(name, "a", first, 16, min(100, height), 0.0, TOP) == 1 and cat.load(name, "b", second, 16, height - 80, 0.0, TOP - 80) == 1
    return cat


def flat(df: DataFrame, names=("b0", "b1", "b2", "b3")) -> list:
    return [F.element_at("bands", k + 1).cast("long").alias(n) for k, n in enumerate(names)]


# -- definitions and changes


def _steps(spark, cat, texts, attached=None) -> DataFrame:
    return spark.createDataFrame([(k, calls.statement(cat, t, attached)) for k, t in enumerate(texts)], "step int, result int")


_DDL = [
    ("SELECT CreateRasterCoverage('g', 'INT16', 'DATAGRID', 1, 'NONE', 100, 512, 512, 4326, 0.5)", 1), ("SELECT CreateRasterCoverage('G', 'INT16', 'DATAGRID', 1, 'NONE', 100, 512, 512, 4326, 0.5)", 0),
    ("SELECT CreateRasterCoverage('x', 'INT16', 'RGB', 3, 'NONE', 100, 512, 512, 4326, 0.5)", 0), ("SELECT CreateRasterCoverage('x', 'INT16', 'DATAGRID', 1, 'NONE', 100, 100, 512, 4326, 0.5)", -1),
    ("SELECT CreateRasterCoverage(NULL, 'INT16', 'DATAGRID', 1, 'NONE', 100, 512, 512, 4326, 0.5)", -1), ("SELECT CreateRasterCoverage('x', 'FLOAT', 'DATAGRID', 1, 'JPEG', 100, 512, 512, 4326, 0.5)", 0),
    ("SELECT SetRasterCoverageInfos('mb', 'a title', 'an abstract', 1)", 1), ("SELECT SetRasterCoverageInfos('none', 'a', 'b')", 0), ("SELECT SetRasterCoverageInfos('mb', 1, 'b')", -1),
    ("SELECT SetRasterCoverageCopyright('mb', 'me', 'CC0')", 1), ("SELECT SetRasterCoverageCopyright(3, 'me')", -1),
    ("SELECT IsRasterCoverageAutoNdviEnabled(NULL, 'mb')", -1), ("SELECT EnableRasterCoverageAutoNDVI('mb', 1)", 0),
    ("SELECT SetRasterCoverageDefaultBands('mb', 0, 1, 2, 2)", 0), ("SELECT SetRasterCoverageDefaultBands('mb', 0, 1, 2, 3)", 1), ("SELECT SetRasterCoverageDefaultBands('g', 0, 1, 2, 3)", 0),
    ("SELECT EnableRasterCoverageAutoNDVI('mb', 1)", 1), ("SELECT IsRasterCoverageAutoNdviEnabled(NULL, 'MB')", 1), ("SELECT EnableRasterCoverageAutoNDVI('g', 1)", 0),
    ("SELECT CopyRasterCoverage('other', 'mb')", 1), ("SELECT CopyRasterCoverage('nowhere', 'mb')", 0), ("SELECT Pyramidize('mb', 2)", 1), ("SELECT Pyramidize('none')", 0), ("SELECT DePyramidize('mb')", 1),
    ("SELECT DeleteSection('mb', 1)", 1), ("SELECT DeleteSection('mb', 1)", 0), ("SELECT DeleteSection('mb', 'a')", -1), ("SELECT DropRasterCoverage('g')", 1), ("SELECT DropRasterCoverage('g')", 0),
    ("SELECT PyramidizeMonolithic('mb')", 1),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {v})" for k, (_, v) in enumerate(_DDL)) + ") t(step, result)")
def catalog_ddl(spark, d):
    """Results of definitions and changes by their SQL names; the copy comes from another catalog."""
    other, cat = stored(spark, d), Catalog(spark, folder(spark))
    texts = [t for t, _ in _DDL]
    at = next(k for k, t in enumerate(texts) if t.startswith("SELECT CopyRasterCoverage"))
    early = stored(spark, d, catalog=cat)
    rows = [(k, calls.statement(early, t)) for k, t in enumerate(texts[:at])]
    early.drop("mb")
    rows += [(at + k, calls.statement(early, t, {"other": other})) for k, t in enumerate(texts[at:])]
    return spark.createDataFrame(rows, "step int, result int")


@query(SECTIONS + """, l AS (SELECT s, 0 AS level, r, c FROM se UNION ALL SELECT DISTINCT s, 1, r // 8, c // 8 FROM se)
SELECT 'pyramids' AS step, s AS section, level, count(*) AS cells FROM l GROUP BY ALL UNION ALL SELECT 'one less', s, level, count(*) FROM l WHERE level = 0 OR s = 1 GROUP BY ALL
UNION ALL SELECT 'one section', s, level, count(*) FROM l WHERE s = 1 GROUP BY ALL UNION ALL SELECT 'base', s, level, count(*) FROM l WHERE s = 1 AND level = 0 GROUP BY ALL""")
def catalog_sections(spark, d):
    """Cells by section and level after pyramids are made, one is removed, a section is deleted and all pyramids are removed."""
    cat, out = stored(spark, d), None
    for step, text in (("pyramids", "SELECT Pyramidize('mb')"), ("one less", "SELECT DePyramidize('mb', 2)"), ("one section", "SELECT DeleteSection('mb', 2)"), ("base", "SELECT DePyramidize('mb')")):
        assert calls.statement(cat, text) == 1
        found = cat.pixels("mb").groupBy(F.col("section_id").alias("section"), F.col("pyramid_level").alias("level")).agg(F.count("*").alias("cells"))
        rows = [(step, *r) for r in found.collect()]
        out = rows if out is None else out + rows
    return spark.createDataFrame(out, "step string, section int, level int, cells long")


@query(SECTIONS + " SELECT s AS section, r // 8 AS r, c // 8 AS c, " + ", ".join(f"trunc(avg({b}))::BIGINT AS {b}" for b in BANDS) + " FROM se GROUP BY 1, 2, 3")
def catalog_pyramid(spark, d):
    cat = stored(spark, d)
    cat.pyramidize("mb")
    px = cat.pixels("mb", 1)
    return px.select(F.col("section_id").alias("section"), "r", "c", *flat(px))


@query(CV + " SELECT r // 8 AS r, c // 8 AS c, " + ", ".join(f"trunc(avg({b}))::BIGINT AS {b}" for b in BANDS) + " FROM cv GROUP BY 1, 2")
def catalog_monolithic_pyramid(spark, d):
    cat = stored(spark, d)
    cat.pyramidize_monolithic("mb")
    px = cat.pixels("mb", 1, 0)
    return px.select("r", "c", *flat(px))


@query(SECTIONS + ", f AS (SELECT s, 0 AS band, b0 AS v FROM se UNION ALL SELECT s, 3, b3 FROM se) SELECT s AS section, band, count(*) AS n, min(v)::DOUBLE AS min_v, max(v)::DOUBLE AS max_v, round(avg(v), 6) AS avg_v FROM f GROUP BY ALL")
def catalog_statistics(spark, d):
    cat = stored(spark, d)
    one = lambda s: cat.statistics("mb", s).where("band in (0, 3)").select(F.lit(s).alias("section"), "band", "n", F.col("min").alias("min_v"), F.col("max").alias("max_v"), F.round("mean", 6).alias("avg_v"))
    return one(1).unionByName(one(2))


@query(CV + " SELECT count(*) AS cells, min(0)::DOUBLE AS minx, max(100000 - r)::DOUBLE AS maxy, min(100000 - r - 1)::DOUBLE AS miny, 16.0::DOUBLE AS maxx FROM cv")
def catalog_extent(spark, d):
    cat = stored(spark, d)
    cells = cat.pixels("mb", 0).where("section_id = 2 or r < 80").agg(F.count("*").alias("cells"))
    return statistics.extent(cat.sections("mb")).select("minx", "maxy", "miny", "maxx").crossJoin(cells)  # one row each


# -- points and windows

_PTS = "pt AS (SELECT event_id, (user_id % 20 + 0.25)::DOUBLE AS x, 100000.0 - value * 2 AS y FROM events)"


def _points(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 20 + 0.25).alias("x"), (F.lit(TOP) - F.col("value") * 2).alias("y"))


@query(CV + f", {_PTS} SELECT event_id, coalesce(b0, 255)::BIGINT AS b0, coalesce(b3, 255)::BIGINT AS b3 FROM pt LEFT JOIN cv ON cv.r = trunc(100000.0 - y)::BIGINT AND cv.c = trunc(x)::BIGINT AND y <= 100000")
def catalog_pixel_at(spark, d):
    found = stored(spark, d).pixel_at("mb", _points(spark, d))
    return found.select("event_id", F.element_at("bands", 1).cast("long").alias("b0"), F.element_at("bands", 4).cast("long").alias("b3"))


@query(SECTIONS + f""", {_PTS}, l AS (SELECT s, r // 8 AS r, c // 8 AS c, trunc(avg(b0))::BIGINT AS b0 FROM se GROUP BY 1, 2, 3),
mm AS (SELECT event_id, max(s) AS s, arg_max(b0, s) AS b0 FROM pt JOIN l ON l.c = trunc(x / 8)::BIGINT AND l.r = trunc((100000.0 - 80 * (s - 1) - y) / 8)::BIGINT AND y <= 100000 - 80 * (s - 1) AND x <= 16
AND y >= 100000 - (CASE s WHEN 1 THEN 100 ELSE (SELECT max(r) + 1 FROM mb) END) GROUP BY 1)
SELECT event_id, coalesce(b0, 255) AS b0 FROM pt LEFT JOIN mm USING (event_id)""")
def catalog_pixel_at_level(spark, d):
    cat = stored(spark, d)
    cat.pyramidize("mb")
    return cat.pixel_at("mb", _points(spark, d), cat.level_of("mb", 8.0, 8.0)).select("event_id", F.element_at("bands", 1).cast("long").alias("b0"))


@query(CV + " SELECT (r - 60) AS out_y, c AS out_x, b0::BIGINT AS b0, b3::BIGINT AS b3 FROM cv WHERE r BETWEEN 60 AND 119")
def catalog_raw_window(spark, d):
    cells = stored(spark, d).raw("mb", 16, 60, 0.0, TOP - 60, 1.0)
    return cells.select("out_y", "out_x", F.element_at("bands", 1).cast("long").alias("b0"), F.element_at("bands", 4).cast("long").alias("b3"))


_WINDOW = f"BuildMBR(0, {TOP - 120}, 16, {TOP - 60})"


@query(CV + " SELECT (r - 60) AS r, c, b0::BIGINT AS b0, b2::BIGINT AS b2, 'whole' AS kind FROM cv WHERE r BETWEEN 60 AND 119 UNION ALL SELECT r - 60, c, CASE WHEN r < 100 THEN b0 ELSE 255 END, CASE WHEN r < 100 THEN b2 ELSE 255 END, 'section' FROM mb WHERE r BETWEEN 60 AND 119")
def export_raw_pixels(spark, d):
    """Buffers of the whole coverage (little endian) and of a section (big endian), decoded again."""
    cat, out = stored(spark, d), None
    for kind, text in (("whole", f"SELECT ExportRawPixels(NULL, 'mb', 16, 60, {_WINDOW}, 1.0, 1.0, 0)"), ("section", f"SELECT ExportSectionRawPixels(NULL, 'mb', 1, 16, 60, {_WINDOW}, 1.0, 1.0, 1)")):
        content = calls.statement(cat, text)
        px = raw.decode(spark.createDataFrame([(bytearray(content),)], "content binary"), 16, 60, 4, "UINT8")
        one = px.select("r", "c", F.element_at("bands", 1).cast("long").alias("b0"), F.element_at("bands", 3).cast("long").alias("b2"), F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


_TIFFS = [(s, b, k) for s in ("", "Section") for b in ("", "TripleBand", "MonoBand") for k in ("GeoTiff", "TiffTfw", "Tiff")]


@query(CV + """, w AS (SELECT '' AS part, b0, b1, b2, b3 FROM cv WHERE r BETWEEN 60 AND 119 UNION ALL SELECT 'Section', CASE WHEN r < 100 THEN b0 ELSE 255 END, CASE WHEN r < 100 THEN b1 ELSE 255 END,
CASE WHEN r < 100 THEN b2 ELSE 255 END, CASE WHEN r < 100 THEN b3 ELSE 255 END FROM mb WHERE r BETWEEN 60 AND 119),
k AS (SELECT * FROM (VALUES ('', 4), ('TripleBand', 3), ('MonoBand', 1)) b(chosen, bands), (VALUES ('GeoTiff', 1), ('TiffTfw', 0), ('Tiff', 0)) f(form, placed))
SELECT 'Write' || part || chosen || form AS name, bands::INT AS bands, placed::INT AS placed, (form = 'TiffTfw')::INT AS world, count(*) AS cells,
sum(CASE chosen WHEN '' THEN b0 + b1 + b2 + b3 WHEN 'TripleBand' THEN b3 + b1 + b0 ELSE b2 END)::BIGINT AS total, sum(CASE chosen WHEN '' THEN b0 WHEN 'TripleBand' THEN b3 ELSE b2 END)::BIGINT AS first_band
FROM w, k GROUP BY ALL""")
def export_tiff_family(spark, d):
    """All 18 TIFF writers: each file's bands, georeference, world file, and sums, read back."""
    cat, out = stored(spark, d), folder(spark)
    for part, chosen, form in _TIFFS:
        name = f"Write{part}{chosen}{form}"
        bands = {"": "", "TripleBand": "3, 1, 0, ", "MonoBand": "2, "}[chosen]
        assert calls.statement(cat, f"SELECT {name}(NULL, 'mb', {'1, ' if part else ''}'{out}/{name}.tif', 16, 60, {bands}{_WINDOW}, 1.0)") == 1
    found = spark.read.format("binaryFile").load(f"{out}/*.tif")
    name = lambda c: F.regexp_extract(c, r"([^/]*)\.tif$", 1).alias("name")
    heads = files.headers(found).select(name("path"), "bands", F.col("xres").isNotNull().cast("int").alias("placed"))
    world = files.world_files(spark, [f"{out}/Write{p}{b}{f}.tif" for p, b, f in _TIFFS])
    worlds = spark.createDataFrame([(p.rpartition("/")[2][:-4], int(w == (1.0, 1.0, 0.0, TOP - 60))) for p, w in world.items()], "name string, world int")
    add = F.aggregate("bands", F.lit(0.0), lambda s, v: s + v)
    sums = files.cells(found).groupBy(name("path")).agg(F.count("*").alias("cells"), F.sum(add).cast("long").alias("total"), F.sum(F.element_at("bands", 1)).cast("long").alias("first_band"))
    return heads.join(sums, "name").join(worlds, "name", "left").select("name", "bands", "placed", F.coalesce("world", F.lit(0)).alias("world"), "cells", "total", "first_band")


@query(CV + " SELECT r - 60 AS r, c, round((b3 - b0)::DOUBLE / (b3 + b0), 8) AS v, 'ndvi' AS kind FROM cv WHERE r BETWEEN 60 AND 119 UNION ALL SELECT r - 60, c, coalesce(round(CASE WHEN r < 100 THEN (b3 - b0)::DOUBLE / (b3 + b0) END, 8), -9999), 'section ndvi' FROM mb WHERE r BETWEEN 60 AND 119 UNION ALL SELECT r, c, round(v, 8), 'grid' FROM g WHERE r < 60 UNION ALL SELECT r, c, round(v, 8), 'section grid' FROM g WHERE r < 60")
def export_ascii_grids(spark, d):
    cat, out = stored(spark, d), folder(spark)
    assert cat.create("g", "DOUBLE", "DATAGRID", 1, nodata=[-9.0]) == 1
    px = grid(spark, d)
    assert cat.load("g", "one", px.select("r", "c", F.array("v").alias("bands")), 64, px.agg(F.max("r")).first()[0] + 1, 0.0, TOP) == 1
    box = f"BuildMBR(0, {TOP - 60}, 64, {TOP})"
    made = {
        "ndvi": f"SELECT WriteNdviAsciiGrid(NULL, 'mb', '{out}/a', 16, 60, 0, 3, {_WINDOW}, 1.0, 0, 8)", "section ndvi": f"SELECT WriteSectionNdviAsciiGrid(NULL, 'mb', 1, '{out}/b', 16, 60, 0, 3, {_WINDOW}, 1.0, 1, 8)",
        "grid": f"SELECT WriteAsciiGrid(NULL, 'g', '{out}/c', 64, 60, {box}, 1.0, 0, 8)", "section grid": f"SELECT WriteSectionAsciiGrid(NULL, 'g', 1, '{out}/d', 64, 60, {box}, 1.0, 0, 8)",
    }
    done = None
    for (kind, text), at in zip(made.items(), "abcd", strict=True):
        assert calls.statement(cat, text) == 1
        one = ascii_grid.read(spark, f"{out}/{at}")[1].select("r", "c", F.round("v", 8).alias("v"), F.lit(kind).alias("kind"))
        done = one if done is None else done.unionByName(one)
    return done


@query(CV + " SELECT 'whole' AS section, count(*) AS cells, sum(b0 + b3)::BIGINT AS total FROM cv WHERE r BETWEEN 60 AND 119 UNION ALL SELECT 'raw', count(*), sum(b0 + b3)::BIGINT FROM cv WHERE r BETWEEN 60 AND 119")
def load_rasters(spark, d):
    """A GeoTIFF loaded by folder and a buffer imported, into a new coverage; a second load of the file is refused."""
    cat, out = stored(spark, d), folder(spark)
    assert calls.statement(cat, f"SELECT WriteGeoTiff(NULL, 'mb', '{out}/whole.tif', 16, 60, {_WINDOW}, 1.0)") == 1
    assert calls.statement(cat, "SELECT CreateRasterCoverage('new', 'UINT8', 'MULTIBAND', 4, 'NONE', 100, 256, 256, -1, 1.0)") == 1
    assert calls.statement(cat, f"SELECT LoadRastersFromDir('new', '{out}', 'tif')") == 1 and calls.statement(cat, f"SELECT LoadRaster('new', '{out}/whole.tif')") == 0
    content = export.raw_pixels(cat, "mb", 16, 60, (0.0, TOP - 120, 16.0, TOP - 60), 1.0)
    assert load.import_section_raw_pixels(cat, "new", "raw", 16, 60, content, (100.0, 0.0, 116.0, 60.0)) == 1
    px = cat.pixels("new", 0).join(cat.sections("new").select("section_id", F.col("section_name").alias("section")), "section_id")
    return px.groupBy("section").agg(F.count("*").alias("cells"), F.sum(F.element_at("bands", 1) + F.element_at("bands", 4)).cast("long").alias("total"))


# -- maps

_MAP = " FROM cv WHERE r BETWEEN 60 AND 119"
_BOX = (0.0, TOP - 120, 16.0, TOP - 60)
RGBA = ["out_y", "out_x", "r", "g", "b", "a"]


@query(CV + " SELECT r - 60 AS out_y, c AS out_x, b2 AS r, b2 AS g, b2 AS b, 255 AS a" + _MAP)
def map_raster_mono(spark, d):
    return maps.map_raster(stored(spark, d), "mb", _BOX, 16, 60, RasterStyle(mono=2)).select(RGBA)


@query(CV + " SELECT r - 60 AS out_y, c AS out_x, b3 AS r, b1 AS g, b0 AS b, 128 AS a" + _MAP)
def map_raster_triple(spark, d):
    return maps.map_raster(stored(spark, d), "mb", _BOX, 16, 60, RasterStyle(triple=(3, 1, 0), opacity=0.5), transparent=True).select(RGBA)


_STRETCHED = """, al AS (SELECT {b} AS v FROM se), h AS (SELECT v::INT AS bin, count(*) AS n FROM al GROUP BY 1), k AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h),
bn AS (SELECT unnest(range(256)) AS bin), f AS (SELECT bn.bin, coalesce((SELECT max(upto) FROM k WHERE k.bin <= bn.bin), 0) AS upto, coalesce((SELECT max(upto) FROM k WHERE k.bin < bn.bin), 0) AS before, (SELECT max(total) FROM k) AS total FROM bn),
e AS (SELECT min(v) AS lo, max(v) AS hi FROM al), st AS (SELECT lo + (hi - lo) / 254.0::DOUBLE * (SELECT min(bin) FROM f WHERE before >= total / 100.0::DOUBLE * 2) AS lo,
lo + (hi - lo) / 254.0::DOUBLE * (SELECT max(bin) FROM f WHERE upto <= total - total / 100.0::DOUBLE * 2) AS hi FROM e)"""


@query(SECTIONS + ", cv AS (SELECT r, c, CASE WHEN r >= 80 THEN 250 - b1 ELSE b1 END AS b1 FROM mb)" + _STRETCHED.format(b="b1") + """,
x AS (SELECT r - 60 AS out_y, c AS out_x, (CASE WHEN b1 <= lo THEN 0 WHEN b1 >= hi THEN 255 ELSE floor(1 + (b1 - lo) / ((hi - lo) / 254)) END)::INT AS v FROM cv, st WHERE r BETWEEN 60 AND 119)
SELECT out_y, out_x, v AS r, v AS g, v AS b, 255 AS a FROM x""")
def map_raster_normalized(spark, d):
    """Contrast stretched between the second and the 98th hundredth of the band's histogram."""
    return maps.map_raster(stored(spark, d), "mb", _BOX, 16, 60, RasterStyle(mono=1, contrast="normalize")).select(RGBA)


@query(CV + """, k AS (SELECT r - 60 AS out_y, c AS out_x, b0 AS v FROM cv WHERE r BETWEEN 60 AND 119) SELECT out_y, out_x, CASE WHEN v >= 130 THEN 255 ELSE 16 END AS r, CASE WHEN v >= 120 AND v < 130 THEN 255 WHEN v >= 130 THEN 0 ELSE 32 END AS g,
CASE WHEN v >= 120 THEN 0 ELSE 48 END AS b, 255 AS a FROM (SELECT out_y, out_x, v FROM k WHERE v < 120 OR v >= 130) UNION ALL SELECT out_y, out_x, 0, 255, 0, 255 FROM k WHERE v >= 120 AND v < 130""")
def map_raster_colormap(spark, d):
    style = RasterStyle(mono=0, categories=("#102030", [(120.0, "#00ff00"), (130.0, "#ff0000")]))
    return maps.map_raster(stored(spark, d), "mb", _BOX, 16, 60, style).select(RGBA)


@query(CV + """, k AS (SELECT r - 60 AS out_y, c AS out_x, (b3 - b0)::DOUBLE / (b3 + b0) AS v FROM cv WHERE r BETWEEN 60 AND 119)
SELECT out_y, out_x, CASE WHEN v >= 0.05 THEN 0 ELSE 170 END AS r, CASE WHEN v >= 0.05 THEN 68 ELSE 136 END AS g, CASE WHEN v >= 0.05 THEN 0 ELSE 68 END AS b, 255 AS a FROM k""")
def map_raster_ndvi(spark, d):
    cat = stored(spark, d)
    cat.set_default_bands("mb", 0, 1, 2, 3)
    cat.enable_auto_ndvi("mb", True)
    return maps.map_raster(cat, "mb", _BOX, 16, 60, RasterStyle(categories=("#aa8844", [(0.05, "#004400")]))).select(RGBA)


@query(CV + " SELECT (r - 40) // 4 AS out_y, c // 4 AS out_x, max(b1) FILTER (r % 4 = 2 AND c % 4 = 2) AS r, max(b1) FILTER (r % 4 = 2 AND c % 4 = 2) AS g, max(b1) FILTER (r % 4 = 2 AND c % 4 = 2) AS b, 255 AS a FROM cv WHERE r BETWEEN 40 AND 119 GROUP BY 1, 2")
def map_raster_decimated(spark, d):
    """One pixel in four each way: the cell below each pixel's centre."""
    return maps.map_raster(stored(spark, d), "mb", (0.0, TOP - 120, 16.0, TOP - 40), 4, 20, RasterStyle(mono=1)).select(RGBA)


@query(SECTIONS + ", l AS (SELECT r // 8 AS r, c // 8 AS c, trunc(avg(b1))::INT AS v FROM se WHERE s = 2 GROUP BY 1, 2) SELECT r AS out_y, c AS out_x, v AS r, v AS g, v AS b, 255 AS a FROM l WHERE r < 6")
def map_raster_by_pyramid(spark, d):
    """At a coarse resolution the pyramid's level is read, by itself."""
    cat = stored(spark, d)
    cat.pyramidize("mb")
    assert cat.best_level("mb", 8.0, 8.0) == 1
    return maps.map_raster(cat, "mb", (0.0, TOP - 128, 16.0, TOP - 80), 2, 6, RasterStyle(mono=1)).select(RGBA)


@query(CV + """, v AS (SELECT r, c, b0::DOUBLE AS v FROM cv WHERE r BETWEEN 60 AND 119), e AS (SELECT a.r, a.c, a.v, """ + ", ".join(f"max(b.v) FILTER (b.r = a.r + {dr} AND b.c = a.c + {dc}) AS e{3 * (dr + 1) + dc + 1}" for dr in (-1, 0, 1) for dc in (-1, 0, 1)) + """
FROM v a JOIN v b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.r, a.c, a.v),
s AS (SELECT r, c, v, 0.0033333333::DOUBLE * 20.0::DOUBLE * ((e0 + 2 * e3 + e6) - (e2 + 2 * e5 + e8)) AS dx, 0.0033333333::DOUBLE * 20.0::DOUBLE * ((e6 + 2 * e7 + e8) - (e0 + 2 * e1 + e2)) AS dy FROM e),
t AS (SELECT r, c, v, dx, dy, pi() / 2 - atan(sqrt(dx * dx + dy * dy)) AS slope FROM s),
u AS (SELECT r, c, v, CASE WHEN dx IS NULL OR dy IS NULL THEN 1 ELSE least(greatest(sin(pi() / 4) * sin(slope) + cos(pi() / 4) * cos(slope) * cos(7 * pi() / 4 - pi() / 2 - atan2(dx, dy)), 0), 1) END AS shade FROM t)
SELECT r - 60 AS out_y, c AS out_x, floor(v * shade + 0.5)::INT AS r, floor(v * shade + 0.5)::INT AS g, floor(v * shade + 0.5)::INT AS b, 255 AS a FROM u""")
def map_raster_relief(spark, d):
    return maps.map_raster(stored(spark, d), "mb", _BOX, 16, 60, RasterStyle(mono=0, relief=1100.0)).select(RGBA)


@query(CV + " SELECT r - 60 AS out_y, c AS out_x, floor((b3 * 64 + b0 * (255 - 64)) / 255.0::DOUBLE + 0.5)::INT AS r, floor((b3 * 64 + b0 * (255 - 64)) / 255.0::DOUBLE + 0.5)::INT AS g, floor((b3 * 64 + b0 * (255 - 64)) / 255.0::DOUBLE + 0.5)::INT AS b, 255 AS a" + _MAP)
def map_layer_group(spark, d):
    """Two layers, the upper one at a quarter of opacity."""
    return maps.map_group(stored(spark, d), [("mb", RasterStyle(mono=0)), ("mb", RasterStyle(mono=3, opacity=0.25))], _BOX, 16, 60).select(RGBA)


_TILED = ", w AS (SELECT y.range AS out_y, x.range AS out_x FROM range(256) y, range(256) x), t AS (SELECT r, c, {bands} FROM se WHERE s = 1)"


@query(SECTIONS + _TILED.format(bands="b3, b1, b0") + " SELECT 'triple' AS kind, out_y, out_x, coalesce(b3, 1) AS r, coalesce(b1, 2) AS g, coalesce(b0, 3) AS b, CASE WHEN b0 IS NULL THEN 0 ELSE 255 END AS a FROM w LEFT JOIN t ON r = out_y AND c = out_x UNION ALL SELECT 'mono', out_y, out_x, coalesce(b1, 1), coalesce(b1, 2), coalesce(b1, 3), 255 FROM w LEFT JOIN t ON r = out_y AND c = out_x UNION ALL SELECT 'whole', out_y, out_x, coalesce(s.b0, 1), coalesce(s.b1, 2), coalesce(s.b2, 3), 255 FROM w LEFT JOIN (SELECT * FROM se WHERE s = 1) s ON s.r = out_y AND s.c = out_x")
def tile_images(spark, d):
    cat = stored(spark, d)
    one = lambda kind, bands, clear=False: maps.tile_image(cat, "mb", 1, 0, bands, 0, "#010203", clear).select(F.lit(kind).alias("kind"), *RGBA)
    return one("triple", [3, 1, 0], True).unionByName(one("mono", [1])).unionByName(one("whole", None))


@query(CV + ", w AS (SELECT y.range AS out_y, x.range AS out_x FROM range(64) y, range(64) x) SELECT out_y, out_x, coalesce(b0, 255) AS v FROM w LEFT JOIN cv ON cv.r = out_y + 60 AND cv.c = out_x")
def map_image_png(spark, d):
    """The PNG of a map by its SQL name, decoded again."""
    cat = stored(spark, d)
    cat.set_style("mb", "gray", "<RasterSymbolizer><ChannelSelection><GrayChannel><SourceChannelName>1</SourceChannelName></GrayChannel></ChannelSelection></RasterSymbolizer>")
    content = calls.statement(cat, f"SELECT GetMapImageFromRaster(NULL, 'mb', BuildMBR(0, {TOP - 124}, 64, {TOP - 60}), 64, 64, 'Gray', 'image/png', '#ffffff', 0)")
    px = files.cells(spark.createDataFrame([("x.png", bytearray(content))], "path string, content binary"))
    return px.select(F.col("r").alias("out_y"), F.col("c").alias("out_x"), F.element_at("bands", 1).cast("int").alias("v"))


@query("""WITH p AS (SELECT * FROM (VALUES (0, 10, 20, 30), (1, 40, 50, 60), (2, 70, 80, 90)) t(i, pr, pg, pb)), x AS (SELECT l_orderkey AS r, max(l_linenumber) % 3 AS v FROM lineitem GROUP BY 1), w AS (SELECT range AS out_y FROM range(64))
SELECT out_y, 0::BIGINT AS out_x, coalesce(CASE WHEN v > 0 THEN pr END, 255) AS r, coalesce(CASE WHEN v > 0 THEN pg END, 255) AS g, coalesce(CASE WHEN v > 0 THEN pb END, 255) AS b, 255 AS a FROM w LEFT JOIN x ON r = out_y LEFT JOIN p ON i = v""")
def map_palette(spark, d):
    cat = Catalog(spark, folder(spark))
    assert cat.create("p", "2-BIT", "PALETTE", 1, tile_w=256, tile_h=256, palette=[(10, 20, 30), (40, 50, 60), (70, 80, 90)]) == 1
    px = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("r")).agg((F.max("l_linenumber") % 3).alias("v"))
    assert cat.load("p", "one", px.select("r", F.lit(0).alias("c"), F.array("v").alias("bands")), 1, px.agg(F.max("r")).first()[0] + 1, 0.0, TOP) == 1
    return maps.map_raster(cat, "p", (0.0, TOP - 64, 1.0, TOP), 1, 64).select(RGBA)


_HIST = """, h AS (SELECT v::INT AS bin, count(*) AS n FROM al GROUP BY 1), q AS (SELECT max(n) AS most FROM h WHERE bin BETWEEN 1 AND 255), w AS (SELECT y.range AS out_y, x.range AS out_x, x.range // 2 + 1 AS bin FROM range(160) y, range(512) x)
SELECT out_y, out_x, CASE WHEN out_y >= 135 AND w.bin < 256 THEN w.bin WHEN w.bin < 256 AND out_y <= 128 AND 128 - out_y < 128 * coalesce(n, 0)::DOUBLE / most THEN 128 ELSE 255 END::INT AS v FROM w LEFT JOIN h USING (bin), q"""


@query(SECTIONS + ", al AS (SELECT b2 AS v FROM se)" + _HIST)
def histogram_image(spark, d):
    """The image of a band's histogram, from the coverage's PNG."""
    content = calls.statement(stored(spark, d), "SELECT GetBandStatistics_Histogram('mb', 2)")
    px = files.cells(spark.createDataFrame([("x.png", bytearray(content))], "path string, content binary"))
    return px.select(F.col("r").alias("out_y"), F.col("c").alias("out_x"), F.element_at("bands", 1).cast("int").alias("v"))


@query(CV + ", al AS (SELECT b1 AS v FROM cv WHERE r BETWEEN 60 AND 119)" + _HIST)
def histogram_from_image(spark, d):
    out = folder(spark)
    assert export.write_png(stored(spark, d), "mb", f"{out}/x.png", 16, 60, _BOX, 1.0, bands=[0, 1, 2]) == 1
    return maps.histogram_from_image(spark, bytes(spark.read.format("binaryFile").load(f"{out}/x.png").first().content), 1)


@query("SELECT y.range AS out_y, x.range AS out_x, 1 AS r, 2 AS g, 255 AS b, 0 AS a FROM range(10) y, range(7) x")
def blank_image(spark, d):
    return maps.blank(spark, 7, 10, "#0102ff", True)


@query(MB + """, x AS (SELECT 1 AS s, c // 2 AS c, r // 2 AS r, arg_max(b0, r * 100 + c) AS v FROM mb WHERE r < 20 AND c < 8 AND r % 2 = 0 AND c % 2 = 0 GROUP BY 1, 2, 3), w AS (SELECT y.range AS out_y, o.range AS out_x FROM range(20) y, range(16) o)
SELECT out_y, out_x, coalesce(m.b1, x.v, 255) AS v FROM w LEFT JOIN x ON x.r = out_y // 2 AND x.c = out_x // 2 LEFT JOIN mb m ON m.r = out_y AND m.c = out_x AND m.r < 10 AND m.c < 4""")
def map_mixed_resolutions(spark, d):
    """A coverage of mixed resolutions: a coarse section, and a fine one over a part of it."""
    cat, px = Catalog(spark, folder(spark)), multiband(spark, d)
    assert cat.create("m", "UINT8", "GRAYSCALE", 1, tile_w=256, tile_h=256, xres=1.0, mixed=True) == 1
    coarse = px.where("r < 20 and c < 8 and r % 2 = 0 and c % 2 = 0").select((F.col("r") / 2).cast("long").alias("r"), (F.col("c") / 2).cast("long").alias("c"), F.array("b0").alias("bands"))
    assert cat.load("m", "coarse", coarse, 4, 10, 0.0, TOP, 2.0, 2.0) == 1
    assert cat.load("m", "fine", px.where("r < 10 and c < 4").select("r", "c", F.array("b1").alias("bands")), 4, 10, 0.0, TOP) == 1
    drawn = maps.map_raster(cat, "m", (0.0, TOP - 20, 16.0, TOP), 16, 20)
    return drawn.select("out_y", "out_x", F.col("r").alias("v"))


# -- vector drawing

_VBOX = (0.0, 0.0, 64.0, 64.0)


@query(FT + ", d AS (SELECT p_partkey AS fid, 63 - floor(y)::BIGINT + dy AS out_y, floor(x)::BIGINT + dx AS out_x FROM ft, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)) SELECT out_y, out_x, max(fid) AS top, count(*) AS marks FROM d WHERE out_y BETWEEN 0 AND 63 AND out_x BETWEEN 0 AND 63 GROUP BY 1, 2")
def vector_points(spark, d):
    f = features(spark, d).select(F.col("p_partkey").alias("fid"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"))
    return maps.points_drawn(f, _VBOX, 64, 64, 3).groupBy("out_y", "out_x").agg(F.max("fid").alias("top"), F.count("*").alias("marks"))


def _paths(spark, d, *corners) -> DataFrame:
    path = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in corners])
    return features(spark, d).select(F.col("p_partkey").alias("fid"), path.alias("path"))


@query(FT + """, k AS (SELECT p_partkey AS fid, x + 0.25 AS x, y + 0.25 AS y, unnest(range(21)) AS k FROM ft), d AS (SELECT DISTINCT fid, floor(64.0 - (y + 5.0 * k / 20)) AS out_y, floor(x + 10.0 * k / 20) AS out_x FROM k)
SELECT out_y::BIGINT AS out_y, out_x::BIGINT AS out_x, count(*) AS lines FROM d WHERE out_y BETWEEN 0 AND 63 AND out_x BETWEEN 0 AND 63 GROUP BY 1, 2""")
def vector_lines(spark, d):
    return maps.lines_drawn(_paths(spark, d, (0.25, 0.25), (10.25, 5.25)), _VBOX, 64, 64).groupBy("out_y", "out_x").agg(F.count("*").alias("lines"))


@query(FT + """, w AS (SELECT y.range AS out_y, x.range AS out_x, 63.5 - y.range AS cy, x.range + 0.5 AS cx FROM range(64) y, range(64) x)
SELECT out_y, out_x, count(*) AS rings FROM ft JOIN w ON cx >= x + 0.25 AND cx < x + 6.25 AND cy >= y + 0.25 AND cy < y + 4.25 AND NOT (cx >= x + 3.25 AND cy >= y + 2.25) GROUP BY 1, 2""")
def vector_polygons(spark, d):
    """L-shaped rings: six wide and four high, less the upper right quarter."""
    ring = _paths(spark, d, (0.25, 0.25), (6.25, 0.25), (6.25, 2.25), (3.25, 2.25), (3.25, 4.25), (0.25, 4.25))
    return maps.polygons_drawn(ring, _VBOX, 64, 64).groupBy("out_y", "out_x").agg(F.count("*").alias("rings"))


@query(FT + """, w AS (SELECT y.range AS out_y, x.range AS out_x, 63.5 - y.range AS cy, x.range + 0.5 AS cx FROM range(64) y, range(64) x)
SELECT out_y, out_x, count(*) AS polygons, max(p_partkey) AS top FROM ft JOIN w ON (cx >= x + 0.25 AND cx < x + 6.25 AND cy >= y + 0.25 AND cy < y + 6.25 AND NOT (cx >= x + 1.25 AND cx < x + 4.25 AND cy >= y + 2.25 AND cy < y + 5.25)) OR (cx >= x + 7.25 AND cx < x + 9.25 AND cy >= y + 0.25 AND cy < y + 2.25) GROUP BY 1, 2""")
def vector_polygons_with_holes(spark, d):
    """Polygons of three rings: a square of six with a hole of three, and a square of two beside it."""
    square = lambda x, y, n: F.array(*[F.struct((F.col("x") + x + dx).alias("x"), (F.col("y") + y + dy).alias("y")) for dx, dy in ((0, 0), (n, 0), (n, n), (0, n))])
    f = features(spark, d).select(F.col("p_partkey").alias("fid"), F.array(square(0.25, 0.25, 6), square(1.25, 2.25, 3), square(7.25, 0.25, 2)).alias("rings"))
    return maps.polygons_drawn(f, _VBOX, 64, 64).groupBy("out_y", "out_x").agg(F.count("*").alias("polygons"), F.max("fid").alias("top"))


@query(FT + """, d AS (SELECT p_partkey AS fid, 63 - floor(y)::BIGINT AS out_y, floor(x)::BIGINT AS out_x, p_size FROM ft), t AS (SELECT out_y, out_x, arg_max(fid, (CASE WHEN p_size < 10 THEN 1 ELSE 0 END) * 1000000000 + fid) AS fid, max(CASE WHEN p_size < 10 THEN 1 ELSE 0 END) AS small FROM d WHERE out_y BETWEEN 0 AND 63 AND out_x BETWEEN 0 AND 63 GROUP BY 1, 2),
w AS (SELECT y.range AS out_y, x.range AS out_x FROM range(64) y, range(64) x)
SELECT out_y, out_x, CASE WHEN small IS NULL THEN 255 WHEN small = 1 THEN 255 ELSE 0 END AS r, CASE WHEN small IS NULL THEN 255 WHEN small = 1 THEN 0 ELSE (fid % 256)::INT END AS g, CASE WHEN small IS NULL THEN 255 ELSE 7 END AS b, 255 AS a FROM w LEFT JOIN t USING (out_y, out_x)""")
def map_vector(spark, d):
    """Points by a rule: small parts are painted last and red, the others by their key."""
    f = features(spark, d)
    small = F.col("p_size") < 10
    colours = f.select(F.col("p_partkey").alias("fid"), F.when(small, 1).otherwise(0).alias("paint"), F.when(small, 255).otherwise(0).alias("r"), F.when(small, 0).otherwise((F.col("p_partkey") % 256).cast("int")).alias("g"), F.lit(7).alias("b"), F.lit(255).alias("a"))
    marks = maps.points_drawn(f.select(F.col("p_partkey").alias("fid"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y")), _VBOX, 64, 64)
    return maps.map_vector(marks, colours, 64, 64).select(RGBA)


# -- anchors, lines and rings

_ANCHORS = {"center": (-0.5, -0.5), "upper_left": (0, -1), "upper_right": (-1, -1), "lower_left": (0, 0), "lower_right": (-1, 0)}


@query(FT + " " + " UNION ALL ".join(f"SELECT p_partkey, '{k}' AS anchor, x + {a} * 0.5 * p_size AS minx, y + {b} * 0.25 * 40 AS miny, x + {a} * 0.5 * p_size + 0.5 * p_size AS maxx, y + {b} * 0.25 * 40 + 0.25 * 40 AS maxy FROM ft" for k, (a, b) in _ANCHORS.items()).replace(" AS minx", "::DOUBLE AS minx").replace(" AS miny", "::DOUBLE AS miny").replace(" AS maxx", "::DOUBLE AS maxx").replace(" AS maxy", "::DOUBLE AS maxy"))
def georeference_anchors(spark, d):
    f, out = features(spark, d), None
    for k in _ANCHORS:
        box = shapes.framed(k, F.col("x"), F.col("y"), F.col("p_size"), F.lit(40), F.lit(0.5), F.lit(0.25))
        one = f.select("p_partkey", F.lit(k).alias("anchor"), box.alias("f")).select("p_partkey", "anchor", "f.*")
        out = one if out is None else out.unionByName(one)
    return out


@query(FT + " SELECT p_partkey, x / 10 AS xres, y / 20 AS yres, round(CASE WHEN y > 0 THEN x / y END, 9) AS ratio FROM ft WHERE x > 0 AND y > 0 UNION ALL SELECT p_partkey, NULL, NULL, round(CASE WHEN y > 0 THEN x / y END, 9) FROM ft WHERE NOT (x > 0 AND y > 0)")
def georeference_frame(spark, d):
    zero = F.lit(0.0)
    res = shapes.resolution(zero, zero, F.col("x"), F.col("y"), F.lit(10), F.lit(20))
    return features(spark, d).select("p_partkey", res["xres"].alias("xres"), res["yres"].alias("yres"), F.round(shapes.aspect_ratio(zero, zero, F.col("x"), F.col("y")), 9).alias("ratio"))


@query(FT + """ SELECT p_partkey, round(sqrt(x * x + y * y) + 5, 8) AS length, round(CASE WHEN sqrt(x * x + y * y) >= (sqrt(x * x + y * y) + 5) / 2 THEN CASE WHEN x = 0 AND y = 0 THEN 0 ELSE x * ((sqrt(x * x + y * y) + 5) / 2) / sqrt(x * x + y * y) END ELSE x + ((sqrt(x * x + y * y) + 5) / 2 - sqrt(x * x + y * y)) END, 8) AS mid_x,
x + 5 AS end_x, (CASE WHEN sqrt(x * x + y * y) > 1 AND sqrt(x * x + y * y) < 1000 THEN 4 ELSE 3 END)::INT AS part_points, least(0, x) AS minx, x + 5 AS maxx, y + 2 AS moved_y, '"' || replace(p_brand || '"', '"', '""') || '"' AS quoted FROM ft""")
def curves(spark, d):
    """A path of two segments: length, midpoint, end, the part from 1 on, bounds, an offset; and a quoted name."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    f = vector.spread(features(spark, d), "p_partkey").withColumn("p", F.array(at(zero, zero), at(F.col("x"), F.col("y")), at(F.col("x") + 5, F.col("y"))))
    p = F.col("p")
    return f.select(
        "p_partkey", F.round(shapes.length(p), 8).alias("length"), F.round(shapes.midpoint(p).x, 8).alias("mid_x"), shapes.point_at(p, F.lit(1e9)).x.alias("end_x"),
        F.size(shapes.substring(p, F.lit(1.0), F.lit(1000.0))).alias("part_points"), shapes.box(p).minx.alias("minx"), shapes.box(p).maxx.alias("maxx"),
        F.get(shapes.offset(p, F.lit(1.0), F.lit(2.0)), 1).y.alias("moved_y"), shapes.quoted(F.concat("p_brand", F.lit('"'))).alias("quoted"),
    )


@query(FT + " SELECT p_partkey, round(x + 2, 8) AS cx, round(y + (p_size + 1) / 3.0, 8) AS cy FROM ft")
def ring_centroids(spark, d):
    """Triangles of base 6 with their apex over a third of it."""
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    high = (F.col("p_size") + 1).cast("double")
    f = features(spark, d).select("p_partkey", shapes.centroid(F.array(at(F.col("x"), F.col("y")), at(F.col("x") + 6, F.col("y")), at(F.col("x"), F.col("y") + high))).alias("c"))
    return f.select("p_partkey", F.round("c.x", 8).alias("cx"), F.round("c.y", 8).alias("cy"))


# -- buffers


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x + 1) * 127.5)::BIGINT) AS v FROM embeddings)
SELECT vec_id, list_sum(list_transform(range(2, 65), lambda i: abs(v[i] - v[i - 1])))::BIGINT AS moved, v[64]::BIGINT AS last, list_sum(list_transform(v, lambda x: CASE WHEN x % 2 = 0 THEN 255 ELSE x END))::BIGINT AS masked FROM e""")
def delta_coding(spark, d):
    """Differences of neighbours and back, and a mask."""
    single = lambda x: F.lit(x).cast("float")  # noqa: E731  # as in SQL, where a component stays in single precision
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor((x + single(1)) * single(127.5))).alias("v"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    coded = e.withColumn("c", buffers.delta(F.col("v")))
    return coded.select(
        "vec_id", add(F.transform(F.slice("c", 2, 64), lambda x: F.abs(x))).alias("moved"), F.element_at(buffers.restored(F.col("c"), "bigint"), -1).alias("last"),
        add(buffers.masked(F.col("v"), F.transform("v", lambda x: x % 2), 255.0)).alias("masked"),
    )


@query(IM + " SELECT r, c, least(b0 - 100, 127)::BIGINT AS int8, b0::BIGINT AS int16, (b0 * 1000 // 256)::INT AS upper, [0, 17, 34, 51, 68, 85, 102, 119, 137, 154, 171, 188, 205, 222, 239, 255][b0 % 16 + 1]::INT AS four, [0, 86, 170, 255][b0 % 4 + 1]::INT AS two, (255 * (1 - b0 % 2))::INT AS one, b2::INT AS first_bgra, md5(b0::VARCHAR) AS sum FROM im")
def sample_views(spark, d):
    x = F.col("b0")
    return image(spark, d).select(
        "r", "c", buffers.viewed(x - 100, "INT8").alias("int8"), buffers.viewed(x, "INT16").alias("int16"), buffers.eight_bits(x * 1000, "UINT16").alias("upper"),
        buffers.eight_bits(x % 16, "4-BIT").alias("four"), buffers.eight_bits(x % 4, "2-BIT").alias("two"), buffers.eight_bits(x % 2, "1-BIT").alias("one"),
        F.element_at(buffers.ordered(F.col("b0"), F.col("b1"), F.col("b2"), F.lit(255), "BGRA"), 1).alias("first_bgra"), F.md5(x.cast("string").cast("binary")).alias("sum"),
    )


@query("SELECT l_orderkey, count(*) AS pixels, (count(*) * 2)::INT AS samples, count(*)::DOUBLE * 7 + count(*) * 9 AS total FROM lineitem GROUP BY 1")
def void_tiles(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("pixels"))
    tile = buffers.void(F.col("pixels").cast("int"), [7.0, 9.0])
    return n.select("l_orderkey", "pixels", F.size(tile).alias("samples"), F.aggregate(tile, F.lit(0.0), lambda s, v: s + v).alias("total"))


@query("""SELECT 'bitmap' AS name, '1-BIT' AS sample, 'MONOCHROME' AS kind, 1 AS at, 2 AS merged UNION ALL SELECT 'gray', '2-BIT', 'GRAYSCALE', NULL, 5 UNION ALL
SELECT 'nations', CASE WHEN count(*) > 16 THEN 'UINT8' ELSE '4-BIT' END, 'PALETTE', min(n_nationkey) FILTER (n_nationkey * 10 % 256 = 0 AND n_nationkey * 7 % 256 = 0 AND n_regionkey * 50 = 0), (count(*) + 1 - count(*) FILTER (n_nationkey * 10 % 256 = 0 AND n_nationkey * 7 % 256 = 0 AND n_regionkey * 50 = 0))::INT FROM nation""")
def palette_types(spark, d):
    """Kinds of palettes, the number of black in them, and their size with black."""
    rgb = lambda *rows: F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip("rgb", r, strict=True)]) for r in rows])
    k = F.col("n_nationkey")
    nations = table(spark, d, "nation").agg(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), (k * 10 % 256).alias("r"), (k * 7 % 256).alias("g"), (F.col("n_regionkey") * 50).alias("b")))), lambda s: F.struct(s.r.alias("r"), s.g.alias("g"), s.b.alias("b"))).alias("p"))
    one = spark.range(1)
    all_of = one.select(F.lit("bitmap").alias("name"), rgb((255, 255, 255), (0, 0, 0)).alias("p")).union(one.select(F.lit("gray"), rgb((1, 1, 1), (86, 86, 86), (170, 170, 170), (255, 255, 255)))).union(nations.select(F.lit("nations"), "p"))
    all_of = all_of.withColumn("p", F.when(F.col("name") == "gray", F.transform("p", lambda e, i: F.when(i == 0, F.struct(F.lit(0).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b"))).otherwise(e))).otherwise(F.col("p")))
    t = pixel.palette_type(F.col("p"))
    at = F.when(F.col("name") != "gray", pixel.palette_index(F.col("p"), F.lit("#000000")))
    white = F.when(F.col("name") == "gray", rgb((9, 9, 9))).otherwise(rgb((0, 0, 0)))
    return all_of.select("name", t.sample_type.alias("sample"), t.pixel_type.alias("kind"), at.alias("at"), F.size(pixel.palette_union(F.col("p"), white)).alias("merged"))


# -- functions by name


@query("SELECT l_orderkey, l_linenumber, 1 AS none, -1 AS opaque_none, 1 AS opaque, 0 AS opaque_clear, 1 AS opaque_again, 'UINT8' AS sample FROM lineitem")
def sql_opaque_functions(spark, d):
    """Names with a prefix, over the rows of a table."""
    sqlnames.register(spark, "gl_")
    p = "gl_SetPixelValue(gl_CreatePixel('UINT8', 'GRAYSCALE', 1), 0, l_linenumber)"
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "gl_IsPixelNone(gl_CreatePixelNone()) AS none", "gl_IsOpaquePixel(gl_CreatePixelNone()) AS opaque_none", f"gl_IsOpaquePixel({p}) AS opaque",
        f"gl_IsOpaquePixel(gl_SetTransparentPixel({p})) AS opaque_clear", f"gl_IsOpaquePixel(gl_SetOpaquePixel(gl_SetTransparentPixel({p}))) AS opaque_again", f"gl_GetPixelSampleType({p}) AS sample",
    )


_HAS = {"none": 1, "deflate": 1, "deflate_no": 1, "lzma": 1, "lzma_no": 1, "jpeg": 1, "png": 1, "fax4": 0, "charls": 0, "webp": 0, "ll_webp": 0, "jp2": 0, "ll_jp2": 0}


@query(" UNION ALL ".join(f"SELECT 'has_codec_{k}' AS name, '{v}' AS value" for k, v in _HAS.items()) + " UNION ALL " + " UNION ALL ".join(f"SELECT '{k}_version', NULL" for k in ("cairo", "curl", "lzma", "png", "jpeg", "tiff", "geotiff", "webp", "charLS", "openJPEG")) + " UNION ALL SELECT 'zlib', 'known' UNION ALL SELECT 'own', 'known' UNION ALL SELECT 'target_cpu', 'known'")
def sql_introspection(spark, d):
    sqlnames.register(spark, "gl_")
    names = [f"has_codec_{k}" for k in _HAS] + [f"{k}_version" for k in sqlnames.VERSIONS if k != "zlib"]
    parts = [f"SELECT '{n}' AS name, CAST(gl_{n}() AS STRING) AS value" for n in names] + [f"SELECT '{n}', CASE WHEN gl_{f}() <> '' THEN 'known' END" for n, f in (("zlib", "zlib_version"), ("own", "version"), ("target_cpu", "target_cpu"))]
    return spark.sql(" UNION ALL ".join(parts))


@query("SELECT 'UINT8' AS sample, 1 AS fits, 0 AS other_bands, -1 AS none FROM (SELECT count(*) FROM lineitem)")
def sql_statistics_validity(spark, d):
    sqlnames.register(spark)
    m = statistics.merged(statistics.partials(image(spark, d), [], "b0"))
    band = F.struct(F.col("min").cast("double").alias("min"), F.col("max").cast("double").alias("max"), "mean", F.col("ssd").alias("sum_sq_diff"), F.array().cast("array<double>").alias("histogram"))
    s = m.select(F.struct(F.lit("UINT8").alias("sample_type"), F.lit(0.0).alias("no_data"), F.col("n").cast("double").alias("count"), F.array(band).alias("bands")).alias("s"))
    return s.selectExpr("GetRasterStatistics_SampleType(s) AS sample", "IsValidRasterStatistics(s, 'uint8', 1) AS fits", "IsValidRasterStatistics(s, 'UINT8', 3) AS other_bands", "IsValidRasterStatistics(s, NULL, 3) AS none")


# -- joins and orders of layers


@query("SELECT n_name AS layer, r_name AS srs, count(*) AS sections FROM nation JOIN region ON n_regionkey = r_regionkey AND r_name LIKE '%A%' JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def layers_sections_reference_systems(spark, d):
    """Three tables joined and grouped, with a pattern on the reference system: the small sides are broadcast by their size."""
    n, r, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    met = n.join(r.where(F.col("r_name").like("%A%")), F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy(F.col("n_name").alias("layer"), F.col("r_name").alias("srs")).agg(F.count("*").alias("sections"))


@query("SELECT p_partkey, t.kind, n FROM part JOIN (SELECT p_brand || '_face' AS k, 'face' AS kind, count(*) AS n FROM part GROUP BY 1, 2) t ON lower(p_brand || '_FACE') = lower(t.k)")
def layers_by_built_names(spark, d):
    """A layer's sub-table by a name that is put together, whatever its case."""
    p = table(spark, d, "part")
    sub = p.groupBy(F.lower(F.concat("p_brand", F.lit("_face"))).alias("k")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("face"))
    return p.withColumn("k", F.lower(F.concat("p_brand", F.lit("_FACE")))).join(sub, "k").select("p_partkey", "kind", "n")


@query("SELECT row_number() OVER (ORDER BY p_size * p_retailprice, p_partkey) AS n, p_partkey FROM part QUALIFY n <= 20")
def smallest_areas_first(spark, d):
    """The first 20 in the order in which a monolithic pyramid paints: by area."""
    p = table(spark, d, "part").orderBy(F.col("p_size") * F.col("p_retailprice"), "p_partkey").limit(20)
    return p.select(F.row_number().over(X.Window.orderBy(F.col("p_size") * F.col("p_retailprice"), "p_partkey")).cast("long").alias("n"), "p_partkey")


_RULES = """<FeatureTypeStyle xmlns="http://www.opengis.net/se" xmlns:ogc="http://www.opengis.net/ogc">
<Rule><Name>far</Name><MinScaleDenominator>1000000</MinScaleDenominator><PointSymbolizer><Graphic><Mark><Fill><SvgParameter name="fill">#ffffff</SvgParameter></Fill></Mark></Graphic></PointSymbolizer></Rule>
<Rule><Name>small</Name><ogc:Filter><ogc:And><ogc:PropertyIsLessThan><ogc:PropertyName>P_SIZE</ogc:PropertyName><ogc:Literal>20</ogc:Literal></ogc:PropertyIsLessThan>
<ogc:PropertyIsLike wildCard="%" singleChar="_" escapeChar="!"><ogc:PropertyName>p_brand</ogc:PropertyName><ogc:Literal>brand%</ogc:Literal></ogc:PropertyIsLike></ogc:And></ogc:Filter>
<PointSymbolizer><Graphic><Mark><Fill><SvgParameter name="fill">#ff0000</SvgParameter></Fill></Mark><Size>1</Size></Graphic></PointSymbolizer></Rule>
<Rule><Name>rest</Name><ElseFilter/><PointSymbolizer><Graphic><Mark><Fill><SvgParameter name="fill">#0000ff</SvgParameter></Fill></Mark><Size>3</Size></Graphic></PointSymbolizer></Rule></FeatureTypeStyle>"""


@query(FT + """, d AS (SELECT 63 - floor(y)::BIGINT AS out_y, floor(x)::BIGINT AS out_x, 1 AS paint FROM ft WHERE p_size < 20 UNION ALL SELECT 63 - floor(y)::BIGINT + dy, floor(x)::BIGINT + dx, 2 FROM ft, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx) WHERE p_size >= 20),
t AS (SELECT out_y, out_x, max(paint) AS paint FROM d GROUP BY 1, 2), w AS (SELECT y.range AS out_y, x.range AS out_x FROM range(64) y, range(64) x)
SELECT out_y, out_x, CASE paint WHEN 1 THEN 255 WHEN 2 THEN 0 ELSE 238 END AS r, CASE WHEN paint IS NULL THEN 238 ELSE 0 END AS g, CASE paint WHEN 1 THEN 0 WHEN 2 THEN 255 ELSE 238 END AS b FROM w LEFT JOIN t USING (out_y, out_x)""")
def map_vector_style(spark, d):
    """A registered layer drawn by a style document, from the PNG of its SQL name."""
    cat, at = Catalog(spark, folder(spark)), folder(spark)
    f = features(spark, d).select(F.col("p_partkey").alias("fid"), (F.col("x") + 0.5).alias("x"), (F.col("y") + 0.5).alias("y"), "p_size", "p_brand")
    f.write.mode("overwrite").parquet(f"{at}/parts")
    assert cat.set_vector("parts", f"{at}/parts", "point", {"sizes": _RULES}) == 1
    content = calls.statement(cat, "SELECT GetMapImageFromVector(NULL, 'Parts', BuildMBR(0, 0, 64, 64), 64, 64, 'Sizes', 'image/png', '#eeeeee')")
    px = files.cells(spark.createDataFrame([("x.png", bytearray(content))], "path string, content binary"))
    return px.select(F.col("r").alias("out_y"), F.col("c").alias("out_x"), *[F.element_at("bands", k + 1).cast("int").alias(n) for k, n in enumerate("rgb")])


@query(IM + """, s AS (SELECT r // 4096 AS section, b0 AS v FROM im), e AS (SELECT section, min(v) AS lo, max(v) AS hi FROM s GROUP BY 1), a AS (SELECT min(lo) AS lo, max(hi) AS hi FROM e),
h AS (SELECT section, lo, hi, least(greatest(floor((v - lo) / ((hi - lo) / 255.0::DOUBLE)), 0), 255)::INT AS bin, count(*) AS n FROM s JOIN e USING (section) GROUP BY ALL)
SELECT least(greatest(floor(((bin + 0.5::DOUBLE) * ((h.hi - h.lo) / 255.0::DOUBLE) + h.lo - a.lo) / ((a.hi - a.lo) / 255.0::DOUBLE)), 0), 255)::INT AS bin, sum(n)::BIGINT AS n FROM h, a GROUP BY 1""")
def histogram_rebin(spark, d):
    """Histograms of sections with bounds of their own, merged into the coverage's."""
    s = image(spark, d).select(F.floor(F.col("r") / 4096).alias("section"), F.col("b0").alias("v"))
    e = s.groupBy("section").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    low, high = e.agg(F.min("lo"), F.max("hi")).first()
    at = F.least(F.greatest(F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.lit(255.0))), F.lit(0)), F.lit(255)).cast("int")
    h = s.join(e, "section").groupBy("section", "lo", "hi", at.alias("bin")).agg(F.count("*").alias("n"))
    return statistics.rebinned(h, low, high)


@query("SELECT axis, shift::DOUBLE AS shift, by_x::DOUBLE AS by_x, by_y::DOUBLE AS by_y FROM (VALUES ('x', 3.0, 0.5, -2.0), ('y', -7.0, 1.25, 4.0)) t(axis, shift, by_x, by_y)")
def affine_fit(spark, d):
    """The transformation that the points of `events` went through, found again by least squares."""
    p = table(spark, d, "events").select((F.col("user_id") % 97).cast("double").alias("x"), (F.col("event_id") % 89).cast("double").alias("y"))
    fit = statistics.affine(p.withColumns({"x2": 3.0 + 0.5 * F.col("x") - 2.0 * F.col("y"), "y2": -7.0 + 1.25 * F.col("x") + 4.0 * F.col("y")}))
    return spark.createDataFrame([(k, *[round(v, 6) for v in row]) for k, row in zip("xy", fit, strict=True)], "axis string, shift double, by_x double, by_y double")


@query("SELECT l_orderkey AS fid, count(*) FILTER (l_linenumber > 1) AS faces, count(*) FILTER (l_returnflag IS NOT NULL AND l_linenumber = 1) AS edges FROM lineitem GROUP BY 1")
def topology_switches(spark, d):
    """Sub-layers by their switches: faces have numbers above the outer one, edges are those that are set."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("fid")).agg(F.count_if(F.col("l_linenumber") > 1).alias("faces"), F.count_if(F.col("l_returnflag").isNotNull() & (F.col("l_linenumber") == 1)).alias("edges"))


@query("SELECT n_name AS layer, r_name AS style, (row_number() OVER (ORDER BY r_name DESC, n_name))::BIGINT AS place FROM nation JOIN region ON lower(r_name) = lower(r_name) AND r_regionkey = n_regionkey")
def styled_layers_in_order(spark, d):
    """Layers with their styles, by kind from the last and name from the first."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    met = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("layer"), F.col("r_name").alias("style"))  # regions are few by what they are
    return met.withColumn("place", F.row_number().over(X.Window.orderBy(F.desc("style"), "layer")).cast("long"))


@query(SECTIONS + ", l AS (SELECT s, 0 AS level, r // 256 AS tr, c // 256 AS tc, count(*) AS n FROM se GROUP BY ALL UNION ALL SELECT s, 1, tr // 256, tc // 256, count(*) FROM (SELECT DISTINCT s, r // 8 AS tr, c // 8 AS tc FROM se) GROUP BY ALL) SELECT s AS section_id, CASE s WHEN 1 THEN 'a' ELSE 'b' END AS section_name, level AS pyramid_level, count(*) AS tiles, sum(n)::BIGINT AS cells FROM l GROUP BY ALL")
def catalog_list(spark, d):
    """Sections with their tiles and cells by level."""
    from .__main__ import listed

    cat = stored(spark, d)
    cat.pyramidize("mb")
    return listed(cat, "mb")


@query(SECTIONS + """, k AS (SELECT unnest(['NONE', 'DEFLATE', 'DEFLATE_NO', 'LZMA', 'LZMA_NO']) AS codec)
SELECT codec, s AS section, r // 256 AS tile_row, count(*) AS cells, sum(b0)::BIGINT AS b0, sum(b3 * (r + c))::BIGINT AS placed FROM se, k GROUP BY ALL""")
def tile_codecs(spark, d):
    """Tiles encoded by each codec and decoded again, by what they hold and where."""
    cat, out = stored(spark, d), None
    for codec in ("NONE", "DEFLATE", "DEFLATE_NO", "LZMA", "LZMA_NO"):
        tiles = cat.tiles("mb", 0, None, codec)
        px = decoded(tiles, "UINT8", 4, 256, 256).where(F.element_at("bands", 1) != 255)
        one = px.groupBy(F.lit(codec).alias("codec"), F.col("section_id").alias("section"), F.floor(F.col("r") / 256).alias("tile_row")).agg(
            F.count("*").alias("cells"), F.sum(F.element_at("bands", 1)).cast("long").alias("b0"), F.sum(F.element_at("bands", 4) * (F.col("r") + F.col("c"))).cast("long").alias("placed")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH x AS (SELECT l_orderkey AS r, max(l_linenumber) % 4 AS v FROM lineitem GROUP BY 1), p AS (SELECT * FROM (VALUES (1, 40, 50, 60), (2, 70, 80, 90), (3, 200, 100, 0)) t(i, pr, pg, pb))
SELECT 'palette' AS kind, r // 8 AS r, trunc(avg(pr))::BIGINT AS red, trunc(avg(pg))::BIGINT AS green, trunc(avg(pb))::BIGINT AS blue FROM x JOIN p ON i = v GROUP BY 2
UNION ALL SELECT 'bitmap', r // 8, 0, NULL, NULL FROM x WHERE v % 2 = 1 GROUP BY 2""")
def pyramid_promoted(spark, d):
    """Levels above the base of a palette coverage are RGB, of a bitmap gray; index 0 is NO-DATA."""
    cat = Catalog(spark, folder(spark))
    px = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("r")).agg((F.max("l_linenumber") % 4).alias("v"))
    height = px.agg(F.max("r")).first()[0] + 1
    assert cat.create("p", "2-BIT", "PALETTE", 1, tile_w=256, tile_h=256, palette=[(1, 2, 3), (40, 50, 60), (70, 80, 90), (200, 100, 0)]) == 1
    assert cat.create("b", "1-BIT", "MONOCHROME", 1, tile_w=256, tile_h=256) == 1
    out = None
    for name, v in (("p", F.col("v")), ("b", F.col("v") % 2)):
        assert cat.load(name, "one", px.select("r", F.lit(0).alias("c"), F.array(v).alias("bands")), 1, height, 0.0, TOP, pyramidize=True) == 1
        at = lambda k: F.try_element_at("bands", F.lit(k)).cast("long")
        one = cat.pixels(name, 1).select(F.lit({"p": "palette", "b": "bitmap"}[name]).alias("kind"), "r", at(1).alias("red"), at(2).alias("green"), at(3).alias("blue"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT r.range AS r, c.range AS c, (r.range * 1000 + c.range)::DOUBLE AS v FROM range(300) r, range(270) c")
def load_generated_tiles(spark, d):
    """A section whose tiles a function makes."""
    cat = Catalog(spark, folder(spark))
    assert cat.create("t", "INT32", "DATAGRID", 1, tile_w=256, tile_h=256) == 1
    assert load.load_tiles(cat, "t", "made", 270, 300, 0.0, 300.0, lambda r, c, w, h: [[[1000 * (r + i) + c + j] for j in range(w)] for i in range(h)]) == 1
    return cat.pixels("t", 0).select("r", "c", F.element_at("bands", 1).alias("v"))


# -- streaming


@query("SELECT event_type, count(*) AS n, min(value) AS min_v, max(value) AS max_v, round(avg(value), 6) AS avg_v, round(var_samp(value), 4) AS var_v FROM events GROUP BY 1")
def stream_statistics(spark, d):
    """Statistics of cells that arrive as a stream, merged batch by batch."""
    root = folder(spark)
    events = table(spark, d, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)  # a stream's source is a folder
    ingest.start(stream.select("event_type", F.col("value").alias("v")), root, ["event_type"]).awaitTermination()
    got = ingest.current(spark, root, ["event_type"])
    return got.select("event_type", "n", F.col("min").alias("min_v"), F.col("max").alias("max_v"), F.round("mean", 6).alias("avg_v"), F.round("var", 4).alias("var_v"))

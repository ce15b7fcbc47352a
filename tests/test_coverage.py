"""Coverages end to end: creation, sections, points, windows, pyramids, exports, styles, streaming."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import __main__ as command
from gridloom.operators import vector
from gridloom.plans import calls, load
from gridloom.plans.coverage import Catalog
from gridloom.plans.styles import parse_group_style, parse_raster_style
from gridloom.sources import ascii_grid, files, images, raw
from gridloom.streaming import ingest


def cells(spark, x):
    h, w, n = x.shape
    rows = [(r, c, [float(v) for v in x[r, c]]) for r in range(h) for c in range(w)]
    return spark.createDataFrame(rows, "r long, c long, bands array<double>")


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}")


def test_catalog(catalog, spark):
    assert catalog.create("Grid", "INT16", "DATAGRID", 1, tile_w=256, tile_h=256) == 1
    assert catalog.create("grid", "INT16", "DATAGRID", 1) == 0
    assert catalog.create("bad", "INT16", "RGB", 3) == 0
    assert catalog.create("bad", "FLOAT", "DATAGRID", 1, "JPEG") == 0
    assert catalog.create("bad", "INT16", "DATAGRID", 1, tile_w=100) == -1
    assert catalog.set_infos("GRID", "t", "a", True) == 1 and catalog.get("grid").title == "t"
    assert catalog.set_infos("none", "t", "a") == 0
    assert catalog.set_copyright("grid", "me", "CC0") == 1 and catalog.get("grid").license == "CC0"
    assert catalog.is_auto_ndvi("grid") == -1
    assert catalog.create("multi", "UINT8", "MULTIBAND", 4, tile_w=256, tile_h=256) == 1
    assert catalog.set_default_bands("multi", 0, 1, 2, 2) == 0 and catalog.set_default_bands("multi", 0, 1, 2, 3) == 1
    assert catalog.enable_auto_ndvi("multi", True) == 1 and catalog.is_auto_ndvi("multi") == 1
    assert catalog.names() == ["grid", "multi"]
    assert catalog.drop("grid") == 1 and catalog.drop("grid") == 0


def test_sections(catalog, spark):
    catalog.create("g", "INT16", "DATAGRID", 1, tile_w=256, tile_h=256, nodata=[-1])
    a = np.arange(24, dtype=float).reshape(4, 6, 1)
    assert catalog.load("g", "a", cells(spark, a), 6, 4, 0.0, 4.0) == 1
    assert catalog.load("g", "a", cells(spark, a), 6, 4, 0.0, 4.0) == 0
    assert catalog.load("g", "wrong", cells(spark, a), 6, 4, 0.0, 4.0, xres=2.0) == 0
    b = np.full((2, 2, 1), 100.0)
    assert catalog.load("g", "b", cells(spark, b), 2, 2, 1.0, 3.0) == 1
    points = spark.createDataFrame([(0.5, 3.5), (1.5, 2.5), (50.0, 50.0)], "x double, y double")
    got = {(p.x, p.y): p.bands for p in catalog.pixel_at("g", points).collect()}
    assert got == {(0.5, 3.5): [0.0], (1.5, 2.5): [100.0], (50.0, 50.0): [-1.0]}
    window = images.gathered(catalog.raw("g", 8, 5, -1.0, 5.0, 1.0), 8, 5, 1)[:, :, 0]
    want = np.full((5, 8), -1.0)
    want[1:, 1:7] = a[:, :, 0]
    want[2:4, 2:4] = 100
    assert (window == want).all()
    s = catalog.statistics("g").first()
    assert s.n == 28 and s.min == 0 and s.max == 100
    assert catalog.pyramidize("g") == 1
    assert catalog.pixels("g", 1, 1).first().bands == [11.0]
    assert catalog.depyramidize("g") == 1 and catalog.pixels("g", 1).count() == 0
    assert catalog.copy("g", "h") == 1 and catalog.pixels("h").count() == 28
    assert catalog.delete_section("g", 2) == 1 and catalog.delete_section("g", 2) == 0
    assert catalog.pixels("g").count() == 24 and catalog.pixels("h").count() == 28


@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize(("sample", "values"), [("INT8", (123, -98)), ("UINT16", (18345, 9746)), ("INT32", (123456789, -987654321)), ("DOUBLE", (123456.78, -98765.43))])
def test_raw_round_trip(spark, sample, values, big):
    x = np.array([[values[(r + c) % 2] for c in range(5)] for r in range(3)]).reshape(3, 5, 1)
    df = cells(spark, x).select(F.col("r").alias("out_y"), F.col("c").alias("out_x"), "bands")
    content = b"".join(bytes(r.content) for r in raw.encode(df, sample, big).orderBy("out_y").collect())
    back = raw.decode(spark.createDataFrame([(bytearray(content),)], "content binary"), 5, 3, 1, sample, big)
    assert {(r.r, r.c): r.bands[0] for r in back.collect()} == {(r, c): x[r, c, 0] for r in range(3) for c in range(5)}


@pytest.mark.parametrize("compress", [False, True])
def test_tiff_round_trip(spark, tmp_path, compress):
    x = np.random.default_rng(1).integers(0, 255, (130, 7, 3))
    (tmp_path / "a.tif").write_bytes(images.encode_tiff(x, "UINT8", (0.5, 0.5, 10.0, 20.0), 4326, compress))
    (tmp_path / "b.tif").write_bytes(b"junk")
    back, tags = images.decode_tiff((tmp_path / "a.tif").read_bytes())
    assert (back == x).all() and images.georeference(tags) == (0.5, 0.5, 10.0, 20.0)
    found_files = spark.read.format("binaryFile").load(str(tmp_path))
    found = {r.path[-5:]: r for r in files.headers(found_files).collect()}
    assert found["a.tif"].width == 7 and found["a.tif"].sample == "UINT8" and found["b.tif"].error
    assert found["a.tif"].md5 == hashlib.md5((tmp_path / "a.tif").read_bytes()).hexdigest()
    px = files.cells(found_files.where("path like '%a.tif'"))
    assert px.count() == 130 * 7 and px.where("r = 5 and c = 6").first().bands == x[5, 6].tolist()


def filtered_png(x):
    """A PNG whose rows use all five filters in turn."""
    h, w, n = x.shape
    rows, up = b"", np.zeros(w * n, int)
    for y in range(h):
        line = x[y].reshape(-1).astype(int)
        left = np.concatenate([np.zeros(n, int), line[:-n]])
        corner = np.concatenate([np.zeros(n, int), up[:-n]])
        p = left + up - corner
        best = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * line, left, up, (left + up) // 2, best][y % 5]
        rows += bytes([y % 5]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        up = line
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    return images.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("bands", [1, 2, 3, 4])
def test_png_filters(bands):
    x = np.random.default_rng(bands).integers(0, 256, (11, 7, bands)).astype(np.uint8)
    assert np.array_equal(images.decode_png(filtered_png(x)), x)


def test_loading_by_path(catalog, spark, tmp_path):
    """A folder of a TIFF, a PNG with a world file, an ASCII grid, and files that are refused."""
    src = tmp_path / "in"
    src.mkdir()
    a, b = np.arange(12, dtype=float).reshape(3, 4, 1), np.full((2, 2), 77, np.uint8)
    (src / "a.tif").write_bytes(images.encode_tiff(a, "UINT8", (1.0, 1.0, 0.0, 3.0)))
    (src / "b.png").write_bytes(images.encode_png(b))
    (src / "b.pgw").write_text(images.world_file(1.0, 1.0, 10.0, 2.0))
    (src / "c.asc").write_text("ncols 2\nnrows 1\nxllcenter 20.5\nyllcorner 0\ncellsize 1\nnodata_value 0\n5 6\n")
    (src / "d.tif").write_bytes(images.encode_tiff(a, "UINT8", (2.0, 2.0, 0.0, 3.0)))
    (src / "e.tif").write_bytes(b"junk")
    assert catalog.create("g", "UINT8", "DATAGRID", 1, tile_w=256, tile_h=256) == 1
    assert load.load_rasters_from_dir(catalog, "none", str(src)) == -1
    assert load.load_raster(catalog, "g", str(src / "d.tif")) == 0 and load.load_raster(catalog, "g", str(src / "b.png")) == 0
    assert load.load_raster(catalog, "g", str(src / "a.tif"), force_srid=4326) == 0
    assert load.load_rasters_from_dir(catalog, "g", str(src), with_world=True, pyramidize=True) == 1
    assert [(r.section_name, r.minx, r.maxy, r.width) for r in catalog.sections("g").orderBy("section_id").collect()] == [("a", 0, 3, 4), ("b", 10, 2, 2), ("c", 20, 1, 2)]
    assert load.load_raster(catalog, "g", str(src / "a.tif")) == 0
    points = spark.createDataFrame([(1.5, 0.5), (11.5, 0.5), (21.5, 0.5)], "x double, y double")
    assert {p.x: p.bands[0] for p in catalog.pixel_at("g", points).collect()} == {1.5: 9.0, 11.5: 77.0, 21.5: 6.0}
    assert catalog.levels("g") == [0, 1] and catalog.pixels("g", 1).count() == 3
    assert load.import_section_raw_pixels(catalog, "g", "r", 2, 1, b"\x01\x02", (30.0, 0.0, 32.0, 1.0)) == 1
    assert load.import_section_raw_pixels(catalog, "g", "r2", 2, 1, b"\x01", (30.0, 0.0, 32.0, 1.0)) == 0


def test_a_load_writes_its_own_section_alone(catalog, spark, tmp_path):
    """Bytes written don't grow with what is there, points are found by equal keys, and levels and sections are folders."""
    assert catalog.create("g", "INT16", "DATAGRID", 1, tile_w=256, tile_h=256, nodata=[-1]) == 1
    held = []
    for k in range(4):
        px = spark.range(400).select(F.floor(F.col("id") / 20).alias("r"), (F.col("id") % 20).alias("c"), F.array(F.col("id").cast("double") + k).alias("bands"))
        assert catalog.load("g", f"s{k}", px, 20, 20, 20.0 * k, 20.0) == 1
        held.append(sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")))
    steps = np.diff([0, *held])
    assert max(steps) < 1.3 * min(steps)
    points = spark.createDataFrame([(70.5, 0.5)], "x double, y double")
    plan = catalog.pixel_at("g", points)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert catalog.raw("g", 5, 5, 41.0, 19.0, 1.0).agg(F.sum(F.col("bands")[0])).first()[0] == sum(20 * r + c + 2 for r in range(1, 6) for c in range(1, 6))
    assert catalog.pyramidize_monolithic("g") == 1 and catalog.levels("g") == [0, 1]
    assert catalog.pyramidize("g", section_id=2) == 1 and catalog.levels("g", 2) == [0, 1] and catalog.levels("g", 1) == [0]
    assert catalog.depyramidize("g", 2) == 1 and catalog.levels("g", 2) == [0]


def test_jpeg(catalog, spark, tmp_path):
    """A JPEG written, loaded again by its world file, within what the codec loses; a gray one by folder."""
    x = np.repeat(np.repeat(np.array([[20, 200], [120, 90]]), 16, 0), 16, 1)
    rgb = np.stack([x, 255 - x, x // 2], axis=2).astype(float)
    assert catalog.create("c", "UINT8", "RGB", 3, tile_w=256, tile_h=256) == 1 and catalog.load("c", "s", cells(spark, rgb), 32, 32, 0.0, 32.0) == 1
    box = "BuildMBR(0, 0, 32, 32)"
    for name in ("WriteJpeg(NULL, 'c', ", "WriteSectionJpegJgw(NULL, 'c', 1, "):
        assert calls.statement(catalog, f"SELECT {name}'{tmp_path}/a.jpg', 32, 32, {box}, 1.0, 1.0, 95)") == 1
    assert (tmp_path / "a.jgw").exists() and (tmp_path / "a.jpg").read_bytes()[:2] == b"\xff\xd8"
    assert catalog.create("d", "UINT8", "RGB", 3, tile_w=256, tile_h=256) == 1
    assert load.load_raster(catalog, "d", f"{tmp_path}/a.jpg") == 0 and load.load_raster(catalog, "d", f"{tmp_path}/a.jpg", with_world=True) == 1
    back = images.gathered(catalog.raw("d", 32, 32, 0.0, 32.0, 1.0), 32, 32, 3)
    assert np.abs(back - rgb)[4:12, 4:12].max() <= 6 and np.abs(back - rgb).mean() < 8
    head = files.headers(spark.createDataFrame([("x", bytearray(images.encode_png(x.astype(np.uint8))))], "path string, content binary")).first()
    assert "<RasterWidth>32</RasterWidth>" in load.summary(head) and f"<MD5>{head.md5}</MD5>" in load.summary(head)


def test_command_line(catalog, spark, tmp_path):
    root = ["--root", f"file://{tmp_path}"]
    run = lambda *a: command.run(spark, [a[0], *root, *map(str, a[1:])])
    assert run("create", "--coverage", "g", "--sample", "UINT8", "--pixel", "GRAYSCALE", "--bands", 1, "--tile-width", 256, "--tile-height", 256)[0] == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_bytes(images.encode_tiff(np.arange(4096).reshape(64, 64, 1) % 251, "UINT8", (1.0, 1.0, 0.0, 64.0)))
    assert run("import", "--coverage", "g", "--src", tmp_path / "in", "--ending", "tif", "--pyramidize")[0] == 1
    assert run("list", "--coverage", "g") == (1, ["1\ta\t0\t1\t4096", "1\ta\t1\t1\t64"])
    assert run("catalog")[1][0].startswith("g\tUINT8\tGRAYSCALE")
    box = ("--box", 0, 0, 64, 64)
    assert run("export", "--coverage", "g", "--dst", tmp_path / "o.tif", "--width", 64, "--height", 64, "--resolution", 1, "--geo", *box)[0] == 1
    assert run("sect-export", "--coverage", "g", "--section", 1, "--dst", tmp_path / "p.tif", "--width", 64, "--height", 64, "--resolution", 1, *box)[0] == 1
    assert images.decode_tiff((tmp_path / "o.tif").read_bytes())[0][63, 63, 0] == 4095 % 251
    assert run("map", "--coverage", "g", "--dst", tmp_path / "m.png", "--width", 64, "--height", 64, *box)[0] == 1 and (tmp_path / "m.png").read_bytes()[:4] == b"\x89PNG"
    assert run("histogram", "--coverage", "g", "--band", 0, "--dst", tmp_path / "h.png")[0] == 1 and images.decode_png((tmp_path / "h.png").read_bytes()).shape == (160, 512, 1)
    assert run("pyrmono", "--coverage", "g")[0] == 1 and run("pyramidize", "--coverage", "g", "--force")[0] == 1 and run("de-pyramidize", "--coverage", "g")[0] == 1
    assert run("delete", "--coverage", "g", "--section", 1)[0] == 1 and run("drop", "--coverage", "g")[0] == 1 and run("list", "--coverage", "g")[0] == 0


def test_threads_and_tiles_by_name(catalog, spark):
    before = calls.statement(catalog, "SELECT GetMaxThreads()")
    assert calls.statement(catalog, "SELECT SetMaxThreads(256)") == 64 and calls.statement(catalog, "SELECT SetMaxThreads('x')") == -1
    spark.conf.set("spark.sql.shuffle.partitions", before)
    catalog.create("p", "4-BIT", "PALETTE", 1, "PNG", tile_w=256, tile_h=256)
    tile = "struct('{}' AS sample_type, '{}' AS pixel_type, {} AS bands, 'PNG' AS compression)"
    for level, form, want in ((0, ("4-BIT", "PALETTE", 1), 1), (1, ("4-BIT", "PALETTE", 1), 0), (1, ("UINT8", "RGB", 3), 1)):
        assert calls.statement(catalog, f"SELECT IsValidRasterTile(NULL, 'p', {level}, {tile.format(*form)})") == want
    assert calls.statement(catalog, "SELECT IsValidRasterTile(NULL, 'none', 0, 1)") == -1


def test_group_documents():
    doc = "<StyledLayerDescriptor><NamedLayer><Name>under</Name></NamedLayer><NamedLayer><Name>over</Name><NamedStyle><Name>red</Name></NamedStyle></NamedLayer></StyledLayerDescriptor>"
    assert parse_group_style(doc) == [("under", None), ("over", "red")]


def test_palettes(catalog):
    assert catalog.create("p", "UINT8", "PALETTE", 1, tile_w=256, tile_h=256, palette=[(0, 0, 0), (255, 0, 0)]) == 1
    assert catalog.merge_palette("p", [(255, 0, 0), (1, 2, 3)]) == [1, 2] and catalog.get("p").palette[2] == (1, 2, 3)
    assert catalog.merge_palette("p", [(i, 9, 9) for i in range(255)]) is None and catalog.set_palette("p", [(1, 1, 1)]) == 1


def test_png_and_world_file():
    assert images.encode_png(np.zeros((2, 3, 4))).startswith(b"\x89PNG")
    assert images.parse_world_file(images.world_file(0.5, 0.25, 10.0, 20.0)) == (0.5, 0.25, 10.0, 20.0)


def test_ascii_grid(spark, tmp_path):
    x = np.array([[1.5, 2.0], [-9999.0, 100.25], [0.0, 7.0]]).reshape(3, 2, 1)
    df = cells(spark, x).select(F.col("r").alias("out_y"), F.col("c").alias("out_x"), F.col("bands")[0].alias("v"))
    ascii_grid.write(df, str(tmp_path / "out"), 2, 3, 10.0, 20.0, 0.5, -9999)
    text = [r[0] for r in ascii_grid.lines(df, 2, 3, 10.0, 20.0, 0.5, -9999).orderBy("at").select("line").collect()]
    assert text[6:] == ["1.5 2", "-9999 100.25", "0 7"] and text[0].split() == ["ncols", "2"]
    (tmp_path / "g.asc").write_text("\n".join(text))
    head, back = ascii_grid.read(spark, str(tmp_path / "g.asc"))
    assert head["cellsize"] == 0.5 and {(r.r, r.c): r.v for r in back.collect()} == {(r, c): x[r, c, 0] for r in range(3) for c in range(2)}
    (tmp_path / "bad.asc").write_text("ncols 2\nncols 3\n")
    with pytest.raises(ValueError):
        ascii_grid.header(spark, str(tmp_path / "bad.asc"))


def test_style(spark):
    s = parse_raster_style(
        """<RasterSymbolizer xmlns="http://www.opengis.net/se"><Name>n</Name><Opacity>0.5</Opacity><ColorMap><Categorize fallbackValue="#123456"><LookupValue>Rasterdata</LookupValue>
        <Value>#000000</Value><Threshold>10</Threshold><Value>#ff0000</Value></Categorize></ColorMap><ShadedRelief><ReliefFactor>25</ReliefFactor></ShadedRelief></RasterSymbolizer>"""
    )
    assert (s.opacity, s.relief, s.visible(5.0)) == (0.5, 25.0, True)
    df = spark.createDataFrame([(5.0,), (10.0,), (None,)], "v double").select(s.colour(F.col("v")).alias("c"))
    assert [r.c for r in df.collect()] == ["#000000", "#ff0000", "#123456"]


def test_filters(spark):
    df = spark.createDataFrame([("Abc", 5), ("a_c", None), (None, 7)], "t string, n int")
    count = lambda e: df.where(e).count()
    assert count(vector.compare(F.col("n"), "number", "=", "x")) == 0 and count(vector.compare(F.col("n"), "number", "<>", "x")) == 2
    assert count(vector.between(F.col("n"), "number", 5, 7)) == 1
    assert count(vector.like(F.col("t"), "a!_c", "%", "_", "!")) == 1 and count(vector.like(F.col("t"), "A_c")) == 2
    assert count(vector.compare(F.col("t"), "text", "<>", "zzz")) == 2 and count(vector.is_null(F.col("t"))) == 1


def test_streaming_ingest(spark, tmp_path):
    src = tmp_path / "in"
    spark.range(100).select((F.col("id") % 3).alias("tile_id"), F.col("id").cast("double").alias("v")).write.parquet(str(src))
    stream = spark.readStream.schema("tile_id long, v double").parquet(str(src))
    ingest.start(stream, str(tmp_path / "s"), ["tile_id"]).awaitTermination(60)
    got = {r.tile_id: (r.n, r.min, r.max) for r in ingest.current(spark, str(tmp_path / "s"), ["tile_id"]).collect()}
    assert got == {0: (34, 0.0, 99.0), 1: (33, 1.0, 97.0), 2: (33, 2.0, 98.0)}

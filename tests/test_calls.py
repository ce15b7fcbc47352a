"""Calls by SQL names: arguments, prefixes, gating, fonts."""

import struct

import pytest

from gridloom.plans import calls
from gridloom.plans.coverage import Catalog


def font(family="Test Sans", style="Bold", bits=1):
    """The least file that has the tables that names are read from."""
    texts = [(1, family.encode("utf-16-be")), (2, style.encode("utf-16-be"))]
    records, strings = b"", b""
    for kind, t in texts:
        records += struct.pack(">HHHHHH", 3, 1, 0x409, kind, len(t), len(strings))
        strings += t
    name = struct.pack(">HHH", 0, 2, 6 + len(records)) + records + strings
    head = b"\0" * 44 + struct.pack(">H", bits) + b"\0" * 8
    at = 12 + 32
    return b"\0\1\0\0" + struct.pack(">HHHH", 2, 0, 0, 0) + b"head" + struct.pack(">III", 0, at, len(head)) + b"name" + struct.pack(">III", 0, at + len(head), len(name)) + head + name


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, f"file://{tmp_path}/root")


def test_fonts(catalog, tmp_path):
    (tmp_path / "f.ttf").write_bytes(font())
    (tmp_path / "bad.ttf").write_bytes(b"junk")
    run = lambda text: calls.statement(catalog, text)
    assert run(f"SELECT LoadFontFromFile('{tmp_path}/f.ttf')") == 1 and run(f"SELECT LoadFontFromFile('{tmp_path}/bad.ttf')") == 0 and run("SELECT LoadFontFromFile(1)") == -1
    assert run(f"SELECT ExportFontToFile(NULL, 'Test Sans-Bold', '{tmp_path}/out.ttf')") == 1 and (tmp_path / "out.ttf").read_bytes() == font()
    assert run(f"SELECT ExportFontToFile(NULL, 'None', '{tmp_path}/out2.ttf')") == 0
    hexed = f"unhex('{font().hex()}')"
    assert run(f"SELECT GetFontFamily({hexed})") == "Test Sans" and run(f"SELECT GetFontFacename({hexed})") == "Test Sans-Bold"
    assert run(f"SELECT IsFontBold({hexed})") == 1 and run(f"SELECT IsFontItalic({hexed})") == 0 and run(f"SELECT IsValidFont({hexed})") == 1
    assert run("SELECT IsValidFont('text')") == -1 and run("SELECT IsValidFont(unhex('00'))") == 0 and run("SELECT GetFontFamily(unhex('00'))") is None
    assert run(f"SELECT CheckFontFacename('Test Sans-Bold', {hexed})") == 1 and run(f"SELECT CheckFontFacename('x', {hexed})") == 0


def test_names_and_gating(catalog, spark):
    create = "CreateRasterCoverage('g', 'UINT8', 'GRAYSCALE', 1, 'NONE', 100, 256, 256, -1, 1.0)"
    assert calls.statement(catalog, f"select gl_{create};", prefix="gl_") == 1
    assert calls.statement(catalog, f"SELECT {create}") == 0
    for text in ("SELECT NoSuchThing(1)", "DROP TABLE x", "SELECT 1"):
        with pytest.raises(ValueError):
            calls.statement(catalog, text)
    for text in ("SELECT LoadRaster('g', '/x')", "SELECT WriteGeoTiff(NULL, 'g', '/x', 1, 1, BuildMBR(0, 0, 1, 1), 1.0)", "SELECT WriteAsciiGrid(NULL, 'g', '/x', 1, 1, BuildMBR(0, 0, 1, 1), 1.0)"):
        with pytest.raises(ValueError):
            calls.statement(catalog, text, relaxed=False)


def test_results_for_odd_arguments(catalog, spark):
    run = lambda text: calls.statement(catalog, text)
    assert run("SELECT CreateRasterCoverage('g', 'UINT8', 'GRAYSCALE', 1, 'NONE', 100, 256, 256, -1, 1.0)") == 1
    px = spark.range(64 * 64).selectExpr("id div 64 AS r", "id % 64 AS c", "array(double(id % 200)) AS bands")
    assert catalog.load("g", "s", px, 64, 64, 0.0, 64.0) == 1
    box = "BuildMBR(0, 0, 64, 64)"
    assert run(f"SELECT GetMapImageFromRaster(NULL, 'g', {box}, 64, 64)")[:4] == b"\x89PNG" and run(f"SELECT GetMapImageFromRaster(NULL, 'g', {box}, 63, 64)") is None
    for bad in ("NULL, 'none', {b}, 64, 64", "NULL, 'g', 1, 64, 64", "NULL, 'g', {b}, 64, 64, 'nosuch'", "NULL, 'g', {b}, 64, 64, 'default', 'image/webp'", "NULL, 'g', {b}, 64, 64, 'default', 'image/png', 'white'", "'other', 'g', {b}, 64, 64", "NULL, 'g', {b}, 128, 64"):
        assert run(f"SELECT GetMapImageFromRaster({bad.format(b=box)})") is None
    assert run(f"SELECT GetMapImageFromRaster(NULL, 'g', {box}, 128, 64, 'default', 'image/tiff', '#ffffff', 0, 80, 1)")[:2] == b"II"
    pixel = run("SELECT GetPixelFromRasterByPoint(NULL, 'g', MakePoint(1.5, 62.5), 0)")
    assert pixel.bands == [65.0] and run("SELECT GetPixelFromRasterByPoint(NULL, 'g', MakePoint(1.5, 62.5), 1.0, 1.0)") == pixel
    for bad in ("MakePoint(1, 1), 2.5", "MakePoint(1, 1), NULL", "'point', 0", "MakePoint(1, 1), 3", "MakePoint(1, 1), 3.0, 3.0"):
        assert run(f"SELECT GetPixelFromRasterByPoint(NULL, 'g', {bad})") is None
    tile = 1 << 32
    assert run(f"SELECT GetTileImage(NULL, 'g', {tile})")[:4] == b"\x89PNG" and run(f"SELECT GetMonoBandTileImage(NULL, 'g', {tile}, 0)")[:4] == b"\x89PNG"
    assert run("SELECT GetTileImage(NULL, NULL, 1)") is None and run(f"SELECT GetMonoBandTileImage(NULL, 'g', {tile}, 1)") is None and run(f"SELECT GetTripleBandTileImage(NULL, 'g', {tile}, 0, 1, 2)") is None
    assert run("SELECT WriteTiff(NULL, 'g', '/tmp/x', 'a', 64, BuildMBR(0, 0, 64, 64), 1.0)") == -1 and run("SELECT GetBandStatistics_Histogram('g', 1)") is None
    assert run("SELECT ImportSectionRawPixels('g', 'raw', 2, 1, unhex('0102'), BuildMBR(100, 0, 102, 1))") == 1 and run("SELECT ImportSectionRawPixels('g', 'raw2', 2, 1, unhex('01'), BuildMBR(100, 0, 102, 1))") == 0

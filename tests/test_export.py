"""Exports of a coverage: what is written reads back as the cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.plans import export
from gridloom.plans.coverage import Catalog
from gridloom.sources import ascii_grid, images

BOX = (0.0, 0.0, 8.0, 6.0)


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    cat = Catalog(spark, str(tmp_path_factory.mktemp("root")))
    px = spark.range(48).select(F.floor(F.col("id") / 8).alias("r"), (F.col("id") % 8).alias("c"), F.col("id").cast("double").alias("v"))
    assert cat.create("one", "DOUBLE", "DATAGRID", 1, nodata=[0.0]) == 1
    assert cat.load("one", "s", px.select("r", "c", F.array("v").alias("bands")), 8, 6, 0.0, 6.0) == 1
    assert cat.create("four", "UINT8", "MULTIBAND", 4, nodata=[0.0] * 4) == 1
    assert cat.load("four", "s", px.select("r", "c", F.array(*[F.col("v") + k for k in range(4)]).alias("bands")), 8, 6, 0.0, 6.0) == 1
    return cat


def test_tiff(catalog, tmp_path):
    path, world = str(tmp_path / "a.tif"), str(tmp_path / "a.tfw")
    assert export.write_tiff(catalog, "ONE", path, 8, 6, BOX, 1.0, world_file=world, compress=True) == 1
    x, tags = images.decode_tiff(open(path, "rb").read())
    assert np.array_equal(x[:, :, 0], np.arange(48.0).reshape(6, 8))
    assert images.georeference(tags) == (1.0, 1.0, 0.0, 6.0)
    assert images.parse_world_file(open(world).read()) == (1.0, 1.0, 0.0, 6.0)
    assert export.write_tiff(catalog, "four", path, 8, 6, BOX, 1.0, section_id=1, bands=[3, 1, 0], geo=False) == 1
    x, tags = images.decode_tiff(open(path, "rb").read())
    assert x.shape == (6, 8, 3) and x[5, 7].tolist() == [50, 48, 47] and images.georeference(tags) is None


def test_png(catalog, tmp_path):
    path = str(tmp_path / "a.png")
    assert export.write_png(catalog, "four", path, 8, 6, BOX, 1.0, bands=[0]) == 1
    assert open(path, "rb").read(8) == b"\x89PNG\r\n\x1a\n"
    assert export.write_png(catalog, "one", path, 8, 6, BOX, 1.0) == 0
    assert export.write_png(catalog, "four", path, 8, 6, BOX, 1.0) == 0


def test_grids(spark, catalog, tmp_path):
    path = str(tmp_path / "grid")
    assert export.write_ascii_grid(catalog, "one", path, 8, 6, BOX, 1.0) == 1
    head, cells = ascii_grid.read(spark, path)
    assert head["ncols"] == 8 and {(r.r, r.c): r.v for r in cells.collect()} == {(i // 8, i % 8): float(i) for i in range(48)}
    assert export.write_ascii_grid(catalog, "four", path + "2", 8, 6, BOX, 1.0) == 0
    assert export.write_ndvi_ascii_grid(catalog, "four", path + "3", 8, 6, BOX, 1.0, 0, 3) == 1
    _, cells = ascii_grid.read(spark, path + "3")
    assert {(r.r, r.c): r.v for r in cells.collect()} == {(i // 8, i % 8): pytest.approx(3 / (2 * i + 3), abs=1e-7) for i in range(48)}
    assert export.write_ndvi_ascii_grid(catalog, "one", path + "4", 8, 6, BOX, 1.0, 0, 0) == 0


def test_guards(catalog, tmp_path):
    path = str(tmp_path / "x")
    assert export.write_tiff(catalog, "one", path, 9, 6, BOX, 1.0) == -1
    assert export.write_tiff(catalog, "none", path, 8, 6, BOX, 1.0) == 0
    assert export.write_tiff(catalog, "one", path, 8, 6, BOX, 1.0, section_id=9) == 0
    assert export.write_tiff(catalog, "four", path, 8, 6, BOX, 1.0, bands=[4]) == 0
    assert export.fits(100, 100, (0, 0, 100.9, 100), 1.0, 1.0) and not export.fits(100, 100, (0, 0, 102, 100), 1.0, 1.0)

"""Groups of layers, lines and paths: their results, and plans whose tasks need no memory that grows with the cells."""

from pyspark.sql import functions as F

from gridloom import catalog_queries, coverage_queries  # noqa: F401
from gridloom.functions import shapes
from gridloom.operators import vector
from gridloom.plans import maps

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlay_is_one_aggregation(spark):
    """The layers of one image: it is read, grouped and shuffled once."""
    text = plan(catalog_queries.QUERIES["group_overlay"](spark, DATA))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1 and "SortAggregate" not in text and text.count("FileScan") == 1


def test_overlay_of_tables_is_not_sorted(spark):
    layers = spark.createDataFrame([(0, 0, 1, 7, 70), (0, 0, 2, None, 80), (1, 0, 1, 5, 50)], "r long, c long, paint int, v int, w int")
    top = vector.overlay(layers, ["r", "c"], "paint", ["v", "w"])
    assert "SortAggregate" not in plan(top)
    assert sorted(tuple(x) for x in top.collect()) == [(0, 0, None, 80), (1, 0, 5, 50)]


def test_stacked_layers_are_those_of_an_overlay(spark):
    cells = spark.createDataFrame([(0, 60, 1), (1, 50, 2), (2, None, 3), (3, 70, None), (4, 90, 4)], "r long, a int, b int")
    layers = [(3, F.col("a") > 80, [F.lit(None).cast("int"), F.lit(3)]), (1, F.col("b") > 1, [F.col("b"), F.lit(1)]), (2, F.col("a") > 55, [F.col("a"), F.lit(2)])]
    one = None
    for paint, test, (v, w) in layers:
        layer = cells.where(test).select("r", F.lit(paint).alias("paint"), v.alias("v"), w.alias("w"))
        one = layer if one is None else one.unionByName(layer)
    want = sorted(tuple(x) for x in vector.overlay(one, ["r"], "paint", ["v", "w"]).collect())
    got = sorted(tuple(x) for x in vector.stacked(cells, ["r"], layers, ["v", "w"]).collect())
    assert got == want == [(0, 60, 2), (1, 2, 1), (2, 3, 1), (3, 70, 2), (4, None, 3)]


def test_a_layer_without_a_test_shows_everywhere(spark):
    assert vector.stacked(spark.range(3), ["id"], [(1, None, [F.col("id") * 2])], ["v"]).count() == 3


def test_lines_are_dealt_out_before_they_become_cells(spark):
    """One file of features, and one fid with many paths, must not be the work of one task."""
    point = lambda x, y: F.struct((F.col("id") % 50 + x).cast("double").alias("x"), (F.col("id") % 40 + y).cast("double").alias("y"))
    lines = spark.range(0, 4000, 1, 1).select((F.col("id") % 2).alias("fid"), F.array(point(0.25, 0.25), point(9.25, 5.25), point(0.25, 0.25)).alias("path"))
    drawn = maps.lines_drawn(lines, (0.0, 0.0, 64.0, 64.0), 64, 64)
    text = plan(drawn)
    assert text.count("Exchange") == 2 and text.rindex("Exchange") > text.rindex("HashAggregate")  # the lower one is below the first aggregation
    assert drawn.count() == drawn.distinct().count() > 0


def test_curves_are_dealt_out(spark):
    text = plan(catalog_queries.QUERIES["curves"](spark, DATA))
    assert text.count("Exchange hashpartitioning") == 1


def test_ways_along_a_path(spark):
    p = spark.createDataFrame([([(0.0, 0.0), (3.0, 4.0), (3.0, 4.0), (6.0, 8.0), (6.0, 10.0)],)], "p array<struct<x: double, y: double>>")
    at = lambda way: tuple(p.select(shapes.point_at(F.col("p"), F.lit(way)).alias("a")).first().a)
    assert [at(w) for w in (-1.0, 0.0, 2.5, 5.0, 7.5, 11.0, 12.0, 99.0)] == [(0, 0), (0, 0), (1.5, 2), (3, 4), (4.5, 6), (6, 9), (6, 10), (6, 10)]
    part = lambda a, b: [tuple(x) for x in p.select(shapes.substring(F.col("p"), F.lit(a), F.lit(b)).alias("s")).first().s]
    assert part(2.5, 7.5) == [(1.5, 2), (3, 4), (3, 4), (4.5, 6)]
    assert part(-1.0, 99.0) == [(0, 0), (0, 0), (3, 4), (3, 4), (6, 8), (6, 10), (6, 10)]
    assert part(5.0, 10.0) == [(3, 4), (6, 8)]

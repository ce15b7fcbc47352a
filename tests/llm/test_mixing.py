"""Mixing: the Poisson inverse, the targets met on average, and the SQL form."""

import hashlib
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.llm import mixing

DATA = "/root/testdata/sf0.001"


def inverse(u, mean):
    k, p, c = 0, math.exp(-mean), math.exp(-mean)
    while u >= c and k < 1000:
        k += 1
        p *= mean / k
        c += p
    return k


def number(seed, j, key):
    return int(hashlib.md5((f"{seed}|{key}|{j}" if j else f"{seed}|{key}").encode()).hexdigest()[:13], 16) / 2**52


def test_inverse(spark):
    rows = [(k, m) for m in (0.0, 0.01, 0.5, 1.0, 3.7, 20.0, 64.0, 64.5, 200.0) for k in range(40)]
    frame = spark.createDataFrame(rows, "k long, m double").select("k", "m", mixing.drawn(9, F.col("k").cast("string"), mixing.distribution(F.col("m"))).alias("n"))
    want = {(k, m): sum(inverse(number(9, j, k), m / max(1, math.ceil(m / 64))) for j in range(max(1, math.ceil(m / 64)))) for k, m in rows}
    assert {(r.k, r.m): r.n for r in frame.collect()} == want


@pytest.mark.parametrize("rate", [20.0, 300.5])
def test_mean_and_variance_are_poisson_at_every_rate(spark, rate):
    frame = spark.range(4000).select(mixing.drawn(1, F.col("id").cast("string"), mixing.distribution(F.lit(rate))).alias("n"))
    mean, var = frame.agg(F.avg("n"), F.var_pop("n")).first()
    assert abs(mean - rate) < 4 * math.sqrt(rate / 4000) and 0.9 < var / rate < 1.1


def test_null_ids_are_drawn_by_their_texts(spark):
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    got = mixing.mixed(docs).groupBy("text").count()
    n = got.count()
    assert abs(n / 3000 - (1 - math.exp(-1))) < 0.03 and abs(got.agg(F.sum("count")).first()[0] / 3000 - 1) < 0.06


def test_a_column_named_as_the_new_one(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a", "t", 7, 8) for i in range(50)], "doc_id long, source string, text string, Copy_No int, copy_no_ int")
    got = mixing.mixed(docs)
    assert got.columns == ["doc_id", "source", "text", "Copy_No__", "copy_no_", "copy_no"]
    got.write.parquet(str(tmp_path / "t"))
    assert {tuple(r)[3:5] for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(7, 8)}


def test_weights_are_met(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit("t").alias("text"))
    got = mixing.mixed(docs, {"a": 3, "b": 1})
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(n) == {"a", "b"}
    assert abs(n["a"] / 22_500 - 1) < 0.05 and abs(n["b"] / 7_500 - 1) < 0.05
    again = mixing.mixed(docs.repartition(7), {"a": 3, "b": 1})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_odd_rows(spark):
    schema = "doc_id long, source string, text string, mix string, rate double, n int"
    rows = [(None, None, None, "m", 1.0, 2), (1, "a", "", "m", 1.0, 2), (1, "a", "", "m", 1.0, 2), (2, "b", "x" * 100_000, "m", 1.0, 2)]
    got = mixing.mixed(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "source", "text", "mix", "rate", "n", "copy_no"]
    n = {(r.doc_id, r.copy_no): r["count"] for r in got.groupBy("doc_id", "copy_no").count().collect()}
    assert all(v == 2 for (i, _), v in n.items() if i == 1)
    assert mixing.mixed(spark.createDataFrame([], schema)).collect() == []


def test_many_sources_are_joined_by_shuffles(spark, monkeypatch):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), (F.col("id") % 20).cast("string").alias("source"))
    want = sorted(map(tuple, mixing.mixed(docs).collect()))
    monkeypatch.setattr(mixing, "SOURCES", 3)
    assert sorted(map(tuple, mixing.mixed(docs).collect())) == want


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def test_sql_at_large_rates(spark, con):
    """Two sources of very different sizes: the smaller one's rate is over LARGEST."""
    rows = [(i, f"t{i}", "en", "big" if i < 40_000 else "small", 2) for i in range(40_002)] + [(None, "no id", "en", "small", 5), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    c = duckdb.connect()
    c.register("documents", frame.toArrow())
    want = c.execute(mixing.OP6_SQL.replace("sqrt(n)", "pow(n, 0.5)")).fetchall()
    names = [x[0] for x in c.description]
    got = mixing.mixed(frame).where("source is null or source = 'small'").select(*names).collect()
    assert len(got) > 200 and sorted(map(str, map(tuple, got))) == sorted(str(r) for r in want if r[3] != "big")


def test_same_as_sql(spark, con):
    got = mixing.op6_mixing(spark, DATA)
    c = con.execute(mixing.OP6_SQL)
    names = [x[0] for x in c.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(c.fetchall())

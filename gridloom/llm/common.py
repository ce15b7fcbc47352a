"""Shared pieces: cutting lineage in shared storage, connected components, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only on a single machine where that is unset."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to shared storage and read it back: recovery from lost executors starts here.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def raw(batch: pa.RecordBatch, name: str) -> list:
    """A text column as a list of UTF-8 bytes, b"" for null."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Re-cut sorted batches so that no group of equal keys is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for k in keys:
            column = numbers(batch, k)
            same &= column == column[-1]
        start = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if start == 0 and held:
            last = held[-1]
            if all(numbers(last, k)[-1] == numbers(batch, k)[0] for k in keys):
                held.append(batch)
                continue
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
        else:
            yield pa.Table.from_batches(held) if held else batch.schema.empty_table()
            held = [batch]
    if held:
        yield pa.Table.from_batches(held)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the links a-b, and for each the smallest node that the links reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for side in (u, v, label[u], label[v]):
            np.minimum.at(new, side, low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            node, root = forest(numbers(batch, "u"), numbers(batch, "v"))
            other = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(root[other])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (u, v: long): one row (node, root) per node, root the smallest node reachable.

    Alternating large-star and small-star contraction.  A round is two group-bys with map-side minima, each
    joined back on its node; the minima are written first, so that both sides of a join come from plain
    exchanges, and Spark can split the links of a hub.  Rounds end when every node has one link, to a node that has none itself.  Links of a node with itself count as none;
    no links give no rows.
    """
    edges = links.where("u <> v").mapInArrow(_contract, "u long, v long").distinct()
    edges = cut(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v")).where("u <> v").union(low).distinct()
        edges = cut(small)
        n = edges.groupBy("u").count().agg(F.max("count")).first()[0] or 1
        if n == 1 and edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))

"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

A vector is rotated by three rounds of random signs and a Walsh-Hadamard transform; its hash is the nearest
signed axis.  `hashes` of these make a bucket, in `tables` independent tables; the cheapest `probes` buckets of
a table (multiprobe) are taken, on both sides.  Pairs that share a bucket are verified by their cosine in
double precision.  Buckets are cut into blocks, and pairs of blocks are compared in separate tasks; what leaves
a task is one row per vector: its number of links and its root in the task's spanning forest.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, forest, numbers, read, whole_groups

COSINE, TABLES, HASHES, PROBES, BLOCK, SEED = 0.98, 8, 3, 4, 1024, 20240


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose length is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    for s in signs:
        x = hadamard(x * s)
    return x


def buckets(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = SEED) -> np.ndarray:
    """Bucket numbers (rows, tables, probes) of unit vectors: the cheapest probes by the sum of lost axis length."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng(seed)
    out = np.empty((len(x), tables, probes), np.int64)
    choices = np.array(list(itertools.product((0, 1, 2), repeat=hashes)))
    for t in range(tables):
        axis, loss = [], []
        for _ in range(hashes):
            r = rotated(x, rng.choice([-1.0, 1.0], (3, width)))
            top = np.argsort(-np.abs(r), axis=1, kind="stable")[:, :3]
            if top.shape[1] < 3:
                top = np.pad(top, ((0, 0), (0, 3 - top.shape[1])), mode="edge")
            near = np.take_along_axis(r, top, 1)
            axis.append(2 * top + (near < 0))
            loss.append((np.abs(near[:, :1]) - np.abs(near)) ** 2)
        cost = sum(loss[k][:, choices[:, k]] for k in range(hashes))
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        number = np.zeros((len(x), best.shape[1]), np.int64)
        for k in range(hashes):
            number = number * (2 * width) + np.take_along_axis(axis[k], choices[best, k], 1)
        out[:, t] = number[:, :1]
        out[:, t, : number.shape[1]] = number
    return out


def unit(rows: list, width: int) -> np.ndarray:
    x = np.asarray(rows, np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _file(tables: int, hashes: int, probes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column(batch.schema.get_field_index("embedding")).to_pylist()
            label, rep, n = (numbers(batch, c) for c in ("label", "rep", "n"))
            width = np.array([len(v) for v in vectors])
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                found = buckets(unit([vectors[i] for i in at], int(w)), tables, hashes, probes)
                salt = (label[at].astype(np.int64) * 1_000_003 + w)[:, None] * tables + np.arange(tables)
                with np.errstate(over="ignore"):
                    mixed = (found.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (salt.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))[:, :, None]
                    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                flat = mixed.reshape(len(at), -1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[at]), pa.array(n[at]), pa.array(label[at]), pa.array([vectors[i] for i in at], pa.list_(pa.float64())), pa.array(list(flat), pa.list_(pa.int64()))],
                    names=["rep", "n", "label", "embedding", "entries"],
                )

    return run


def _verify(least: float, tables: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["entry", "lo", "hi"]):
            if group.num_rows < 2:
                continue
            entry, lo, hi, block, rep, n, label = (group[c].to_numpy() for c in ("entry", "lo", "hi", "block", "rep", "n", "label"))
            change = (entry[1:] != entry[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            first = np.concatenate([[0], np.flatnonzero(change) + 1])
            size = np.diff(np.append(first, len(rep)))
            vectors = group["embedding"].to_pylist()
            entries = np.asarray(group["entries"].to_pylist(), np.int64).reshape(len(rep), tables, -1)
            width = np.array([len(v) for v in vectors])
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g in np.flatnonzero(size > 1):
                s = slice(first[g], first[g] + size[g])
                w = width[s]
                if (w != w[0]).any():  # two lengths under one mixed number: by length, in turn
                    parts = [first[g] + np.flatnonzero(w == k) for k in np.unique(w)]
                else:
                    parts = [np.arange(s.start, s.stop)]
                for at in parts:
                    x = unit([vectors[i] for i in at], int(width[at[0]]))
                    if lo[at[0]] == hi[at[0]]:
                        left = right = np.arange(len(at))
                    else:
                        left, right = np.flatnonzero(block[at] == lo[at[0]]), np.flatnonzero(block[at] == hi[at[0]])
                    for i in range(0, len(left), 256):
                        r, c = np.nonzero(x[left[i : i + 256]] @ x[right].T >= least)
                        p, q = at[left[i + r]], at[right[c]]
                        ok = (p < q) & (label[p] == label[q]) if left is right else label[p] == label[q]
                        p, q = p[ok], q[ok]
                        for j in range(0, len(p), 50_000):  # a pair counts in the first bucket that it shares
                            u, v = p[j : j + 50_000], q[j : j + 50_000]
                            same = entries[u][:, :, :, None] == entries[v][:, :, None, :]
                            shared = np.where(same.any(axis=3), entries[u], np.iinfo(np.int64).max)
                            once = shared.reshape(len(u), -1).min(axis=1) == entry[u]
                            a.append(u[once])
                            b.append(v[once])
            u, v = np.concatenate(a), np.concatenate(b)
            if len(u):
                node, root = forest(rep[u], rep[v])
                order = np.searchsorted(node, np.concatenate([rep[u], rep[v]]))
                count = np.bincount(order, weights=np.concatenate([n[v], n[u]]), minlength=len(node)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(count)], names=["u", "v", "links"])

    return run


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine is at least
    `cosine`.  A vector that is null, empty, zero or holds null or non-finite components, or whose id is null,
    links with nothing: n_links 0, component_id its own id.  Equal vectors of a label are one class, hashed
    once; its members link with each other, repeated rows too.  Other columns are not read.  An empty table gives
    no rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(valid).withColumns({"h": F.xxhash64("embedding"), "g": F.xxhash64(F.lit(1), "embedding")})
    classes = good.groupBy("label", "h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min_by("embedding", "vec_id").alias("embedding"))
    reps = cut(
        classes.select("rep", "n", "label", "embedding")
        .mapInArrow(_file(tables, hashes, probes), "rep long, n long, label long, embedding array<double>, entries array<long>")
    )
    filed = reps.select("rep", F.explode(F.array_distinct("entries")).alias("entry"))
    shared = filed.groupBy("entry").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / block).cast("int")
    members = filed.join(shared, "entry").withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.select("rep", "entry", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block").join(reps, "rep")
    dealt = members.repartition("entry", "lo", "hi").sortWithinPartitions("entry", "lo", "hi")
    found = cut(dealt.mapInArrow(_verify(cosine, tables), "u long, v long, links long"))
    roots = components(found.select("u", "v").distinct())
    counts = found.groupBy("u").agg(F.sum("links").alias("links"))
    named = reps.select("rep", "n").join(counts, F.col("rep") == F.col("u"), "left").join(roots, F.col("rep") == F.col("node"), "left")
    named = named.select("rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    member = good.select("vec_id", "label", "h", "g").join(classes.select("label", "h", "g", "rep"), ["label", "h", "g"]).join(named, "rep")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = member.select("vec_id", "n_links", "component_id").union(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))

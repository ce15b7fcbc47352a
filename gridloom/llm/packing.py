"""Best-fit packing with conflicts.

Documents go to shards of bounded size by a hash.  In a shard they are packed from the longest down; open bins
are in the order of their residual room, and carry a bitmap of the duplicate clusters in them and, per level, a
bitmap of sources (level l has the sources that the bin holds l times at least).  The search starts at the
tightest bin with room and goes on to its successors until one is compatible: no member of the cluster in it,
and fewer than `per_source` pieces of the source.  If none is, a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, whole_groups

#: Words and end marks in a bin, pieces of a source in a bin, documents in a shard as expected.
CAPACITY, PER_SOURCE, SHARD = 4096, 4, 2000


def pack(length: list[int], source: list[int], cluster: list[int], capacity: int, per_source: int) -> list[int]:
    """Bins of items that are given from the longest down; cluster -1 conflicts with nothing."""
    residuals: list[tuple[int, int]] = []
    clusters: list[int] = []
    levels: list[list[int]] = []
    out = []
    for n, s, c in zip(length, source, cluster, strict=True):
        bit, mark = 1 << s, 1 << c if c >= 0 else 0
        at = bisect_left(residuals, (n, -1))
        while at < len(residuals):
            number = residuals[at][1]
            if not clusters[number] & mark and not levels[number][per_source - 1] & bit:
                break
            at += 1
        if at < len(residuals):
            room, number = residuals.pop(at)
        else:
            room, number = capacity, len(clusters)
            clusters.append(0)
            levels.append([0] * per_source)
        clusters[number] |= mark
        level = levels[number]
        level[next(k for k in range(per_source) if not level[k] & bit)] |= bit
        insort(residuals, (room - n, number))
        out.append(number)
    return out


def _pack(capacity: int, per_source: int):
    names = ["shard", "bin", "doc_id", "row", "copy_no", "start", "length"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["shard"]):
            shard = table["shard"].to_numpy()
            first = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
            for a, b in zip(first[:-1], first[1:], strict=True):
                part = table.slice(a, b - a)
                if not part.num_rows:
                    continue
                length = part["length"].to_numpy()
                order = np.lexsort((part["start"].to_numpy(), part["copy_no"].to_numpy(), part["row"].to_numpy(), -length))
                rank = {s: i for i, s in enumerate(dict.fromkeys(part["source"].to_pylist()))}
                source = [rank[s] for s in part["source"].to_pylist()]
                cluster = part["cluster"].to_pylist()
                often = {c: i for i, c in enumerate(c for c, n in Counter(cluster).items() if n > 1)}
                marks = [often.get(c, -1) for c in cluster]
                bins = pack(length[order].tolist(), [source[i] for i in order], [marks[i] for i in order], capacity, per_source)
                part = part.take(pa.array(order)).append_column("bin", pa.array(bins, pa.int64()))
                yield from part.select(names).combine_chunks().to_batches()

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD, cluster: str | None = None) -> DataFrame:
    """(shard, bin, doc_id, copy_no, start, length): the pieces of docs (doc_id, source, text) and their bins.

    A document is its words and an end mark; one longer than a bin is cut into pieces from word `start` on, all
    full but the last.  Two pieces in a bin are never of the same cluster: `cluster` names a column, else it is
    all with the same words, A-Z lower-cased.  Null or empty texts are one mark long and conflict by source
    alone.  A null source is a source.  Repeated rows are told apart by copy_no, from 1.  Other columns are not
    read.  An empty table gives no rows.
    """
    folded = F.trim(F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))
    slim = docs.select("doc_id", "source", folded.alias("folded"), *([F.col(cluster).alias("given")] if cluster else []))
    own = F.when(F.col("folded") == "", F.xxhash64(F.lit("empty"), "doc_id")).otherwise(F.xxhash64("folded"))
    words = F.when(F.col("folded") == "", 0).otherwise(F.length("folded") - F.length(F.translate("folded", " ", "")) + 1)
    rows = slim.select("doc_id", "source", (F.xxhash64("given") if cluster else own).alias("cluster"), (words + 1).cast("long").alias("n"))
    rows = rows.groupBy("doc_id", "source", "cluster", "n").agg(F.count("*").alias("copies"))
    copies = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    pieces = copies.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))))
    shards = max(1, -(-docs.count() // shard))
    key = F.xxhash64("doc_id", "cluster", "copy_no", "start")
    pieces = pieces.select(
        F.pmod(key, F.lit(shards)).alias("shard"), key.alias("row"), "doc_id", "source", "cluster", "copy_no", "start",
        F.least(F.col("n") - F.col("start"), F.lit(capacity)).cast("long").alias("length"),
    )
    dealt = pieces.repartition("shard").sortWithinPartitions("shard", "row")
    return dealt.mapInArrow(_pack(capacity, per_source), "shard long, bin long, doc_id long, row long, copy_no long, start long, length long").drop("row")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))

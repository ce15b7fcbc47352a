"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32.  If two fingerprints differ in at most 4 bits, then
in one segment they differ in at most 2, so their Hamming balls of radius 1 within that segment meet.  Every
distinct fingerprint is filed under the 33 values of each ball; whoever shares a table entry is a candidate,
and candidates' complete distances are verified.  An entry that many share is cut into blocks, pairs of blocks
are compared in separate tasks, and each yields a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, forest, raw, read, whole_groups

SHINGLE, SEED, DISTANCE, BLOCK = 4, 42, 4, 1024


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the lower-cased (A-Z) text's n-word shingles; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= n:
        hashes = digest(joined, SEED)
    else:
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = [0, *(spaces[: len(words) - n] + 1).tolist()]
        ends = [*spaces[n - 1 :].tolist(), len(joined)]
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    over = 2 * np.add.reduce(bits, axis=0, dtype=np.int64) > len(bits)
    return int.from_bytes(np.packbits(over).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """Append `fp` (long) to docs, whose other columns must be of plain types."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(x, n) for x in raw(batch, text_col)], pa.int64())
            rest = [i for i, name in enumerate(batch.schema.names) if name != text_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), fp], names=[*(batch.schema.names[i] for i in rest), "fp"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text_col), "fp long"])
    return docs.mapInArrow(add, schema)


def _verify(distance: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in whole_groups(batches, ["entry", "lo", "hi"]):
            if group.num_rows < 2:
                continue
            entry, lo, hi, block, fp = (group[c].to_numpy() for c in ("entry", "lo", "hi", "block", "fp"))
            change = (entry[1:] != entry[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            first = np.concatenate([[0], np.flatnonzero(change) + 1])
            size = np.diff(np.append(first, len(fp)))
            bits = fp.view(np.uint64)
            found_a, found_b = [], []
            small = np.repeat(size <= 64, size)
            number = np.repeat(np.arange(len(size)), size)
            for shift in range(1, int(min(64, size.max()))):
                same = np.flatnonzero((number[shift:] == number[:-shift]) & small[shift:])
                near = same[np.bitwise_count(bits[same] ^ bits[same + shift]) <= distance]
                found_a.append(fp[near])
                found_b.append(fp[near + shift])
            for g in np.flatnonzero(size > 64):
                at = slice(first[g], first[g] + size[g])
                x, k = bits[at], block[at]
                if lo[at][0] == hi[at][0]:
                    left = right = np.arange(len(x))
                else:
                    left, right = np.flatnonzero(k == lo[at][0]), np.flatnonzero(k != lo[at][0])
                for i in range(0, len(left), 256):  # bounded memory: 256 rows of the block at a time
                    r, c = np.nonzero(np.bitwise_count(x[left[i : i + 256], None] ^ x[None, right]) <= distance)
                    found_a.append(fp[at][left[i + r]])
                    found_b.append(fp[at][right[c]])
            node, root = forest(np.concatenate(found_a), np.concatenate(found_b))
            other = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(root[other])], names=["u", "v"])

    return run


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """A spanning forest (u, v) of the links between the distinct fingerprints `fp` at up to `distance` bits.

    `distance` may be up to 5: of two segments one then differs in at most 2 bits.
    """
    if not 0 <= distance <= 5:
        raise ValueError("two segments with balls of radius 1 find distances up to 5")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << j).cast("long") for j in range(32)))
    ball = lambda tag, part: F.transform(flips, lambda m: part.bitwiseXOR(m).bitwiseOR(F.lit(tag << 32)))
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    # few fingerprints fill few files; 66 rows of each are better made by many tasks
    fps = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    filed = fps.select("fp", F.explode(F.concat(ball(0, low), ball(1, high))).alias("entry"))
    shared = filed.groupBy("entry").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    # both sides are 66 times what the planner takes them for, so it would send them to the driver as a small table
    members = filed.join(shared.hint("merge"), "entry").withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.select("entry", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp")
    dealt = members.repartition("entry", "lo", "hi").sortWithinPartitions("entry", "lo", "hi")
    return dealt.mapInArrow(_verify(distance), "u long, v long").distinct()


def _roots(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, first, root): of each fingerprint the smallest id, and the smallest fingerprint that it reaches.

    Written, so that joins with it have plain exchanges on both sides, and Spark can split a hot fingerprint.
    """
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp"), distance))
    return cut(classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable over links of up to `distance` bits.

    One row per input row.  Null or empty texts have the fingerprint zero and link like any other.  Repeated
    rows come out repeated; a row with a null id carries links but gives no id to its component, whose
    component_id is null only if no row in it has an id.  Other columns are not read.  An empty table gives no
    rows.
    """
    prints = cut(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    named = _roots(prints, distance)
    groups = named.groupBy("root").agg(F.min("first").alias("component_id"))
    byclass = cut(named.join(groups, "root").select("fp", "component_id"))
    return prints.join(byclass, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, one of each near-duplicate group: the one with the smallest id, nulls last.

    Of rows with that id, the one with the smallest hash of its text stays, of equal ones any one.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    prints = cut(fingerprints(ids))
    # small as files, these tables grow with docs: neither goes through the driver
    rows = prints.join(_roots(prints, distance).select("fp", "root").hint("merge"), "fp")
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h")).alias("best"))
    best = best.select("best.late", F.coalesce("best.doc_id", F.lit(0)).alias("id"), "best.h")
    boxed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).isNull().alias("late"),
        F.coalesce(F.col(id_col), F.lit(0)).alias("id"), F.xxhash64(text_col).alias("h"),
    )
    return boxed.join(best.hint("merge"), ["late", "id", "h"], "left_semi").dropDuplicates(["late", "id", "h"]).select("doc.*")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

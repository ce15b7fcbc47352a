"""Line deduplication by a deletion-neighbourhood join.

Two lines are at edit distance 1 at most if they are equal, if both become the same variant when the character
at the same place is deleted (a substitution), or if one is a variant of the other (an insertion).  So every
line is filed under hashes of its variants, each with the deleted place, and of itself; equal keys are joined,
each line only with the earliest of a key, and the edit distance is verified on the texts.

Only lines that can have a neighbour emit variants: an edit leaves the first or the last half of a line as it
was, so lines first meet on hashes of their halves; those alone on all of theirs have no neighbour.  Texts are
cut into lines once for all that needs hashes alone; what those tell is written to shared storage.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, whole_groups

#: Lines shorter than this have only equal lines as neighbours: in a line of one character an edit leaves nothing.
NEAR_CHARS = 2
#: Of a Bloom filter that spares lines a shuffle; beyond some 11 million wanted lines it fills up and spares fewer.
FILTER_BITS, FILTER_HASHES = 1 << 27, 6

_MIX = np.random.default_rng(5).integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _MIX[0], np.uint64)]))


def variants(line: str, powers: np.ndarray) -> tuple[np.ndarray, int]:
    """Hashes of the line without each of its characters, and of the line."""
    with np.errstate(over="ignore"):
        x = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        x = x * _MIX[1]
        x = (x ^ (x >> np.uint64(31))) * _MIX[2]
        n = len(x)
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers[:n])])
        after = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x[1:] * powers[: n - 1])]) if n else before
        deleted = before[:n] + after[n - 1] - after[:n]  # a place further left for all that follows
        mix = lambda h, size: (h ^ (h >> np.uint64(29)) ^ np.uint64(size)) * _MIX[3]
        return mix(deleted, n - 1).view(np.int64), int(mix(before[n : n + 1], n).view(np.int64)[0])


def _emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place, rank) of lines (line, rank): place -1 for the line itself."""
    powers = _powers(1 << 12)
    for batch in batches:
        lines = batch.column(batch.schema.get_field_index("line")).to_pylist()
        ranks = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
        keys, places, who, size = [], [], [], 0

        def out():
            columns = [np.concatenate(keys), np.concatenate(places).astype(np.int32), np.concatenate(who)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "place", "rank"])

        for line, rank in zip(lines, ranks, strict=True):
            if len(line) >= len(powers):
                powers = _powers(2 * len(line))
            deleted, whole = variants(line, powers)
            keys.append(np.append(deleted, whole))
            places.append(np.append(np.arange(len(deleted)), -1))
            who.append(np.full(len(deleted) + 1, rank))
            size += len(keys[-1])
            if size > 200_000:
                yield out()
                keys, places, who, size = [], [], [], 0
        if size:
            yield out()


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, best) of rows sorted by key, place and rank: a line, and an earlier one that may be its neighbour.

    A key's group is one line and those an edit away from it, so it is held whole.
    """
    for group in whole_groups(batches, ["key"]):
        if not group.num_rows:
            continue
        key, place, rank = (group[c].to_numpy() for c in ("key", "place", "rank"))
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])]))
        # substitutions: all of a key and place are neighbours of the first
        best = np.repeat(rank[start], np.diff(np.append(start, len(key))))
        late = (place >= 0) & (best < rank)
        out = [(rank[late], best[late])]
        # insertions: the line itself comes first in its key; the rest of the key holds it with one character more
        heads = np.flatnonzero(new_key)
        size = np.diff(np.append(heads, len(key)))
        whole = np.repeat(np.where(place[heads] == -1, rank[heads], np.iinfo(np.int64).max), size)
        longer = (place >= 0) & (whole < rank)
        out.append((rank[longer], whole[longer]))
        least = np.minimum.reduceat(np.where(place >= 0, rank, np.iinfo(np.int64).max), heads)
        short = (place[heads] == -1) & (least < rank[heads])
        out.append((rank[heads][short], least[short]))
        a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["rank", "best"])


def near(a: str, b: str) -> bool:
    """Edit distance 1 at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    n = len(a)
    lead = next((i for i in range(n) if a[i] != b[i]), n)
    return a[lead + (len(a) == len(b)) :] == b[lead + 1 :]


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("line", "other"))
        keep = pa.array([near(x, y) for x, y in zip(a, b, strict=True)], pa.bool_())
        yield batch.select(["h", "g"]).filter(keep)


def _lines(docs: DataFrame) -> DataFrame:
    """(at, h, g, line): `at` is the place in the corpus, by id, row and line; lines without a word are no lines here."""
    cutting = docs.select("id", "row", F.posexplode(F.split(F.col("text"), "\n", -1)).alias("no", "line"))
    worded = cutting.where(F.btrim("line", F.lit(" \t\n\x0b\x0c\r")) != "")
    return worded.select(F.struct(F.col("id").isNull().alias("late"), "id", "row", "no").alias("at"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "line")


def _halves(near_chars: int) -> list[Column]:
    """Hashes of the first and last `half` characters: lines of 2 half and 2 half + 1 have them, and for those a character shorter lines of 2 half + 2."""
    n = F.length("line")
    half = F.floor(n / 2).cast("int")
    out = []
    for size, ok in ((half, n >= near_chars), (half - 1, (n % 2 == 0) & (n > near_chars))):
        for side, part in enumerate((F.substring("line", F.lit(1), size), F.right("line", size))):
            out.append(F.when(ok, F.xxhash64(F.lit(side), size, part)))
    return out


def _filter(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """lines less most whose h is not among wanted: a Bloom filter of FILTER_BITS at most, with false hits only.

    The join that follows takes out the false ones.
    """
    bits = max(1 << 10, min(FILTER_BITS, 1 << (12 * wanted.count()).bit_length()))
    places = F.explode(F.array(*[F.pmod(F.shiftright("h", 8) + F.lit(k) * F.shiftright(F.xxhash64("h"), 8), F.lit(bits)) for k in range(FILTER_HASHES)]))
    words = wanted.select(places.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(b & 63))")).alias("m")).toPandas()
    table = np.zeros(bits // 64, np.uint64)
    table[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64).view(np.uint64)
    shared = lines.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, step = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("h", "step"))
            keep = np.ones(len(h), bool)
            for k in range(FILTER_HASHES):
                b = ((h >> np.int64(8)) + np.int64(k) * (step >> np.int64(8))) & np.int64(bits - 1)
                keep &= (shared.value[b >> 6] >> (b & 63).astype(np.uint64)) & np.uint64(1) == 1
            if keep.any():
                yield batch.filter(pa.array(keep))

    stepped = lines.withColumn("step", F.xxhash64("h"))
    return stepped.mapInArrow(run, stepped.schema).drop("step")


def repeats(docs: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """(id, row, no): the lines of docs (id, row, text) that an earlier line equals or nears, by id, row and line number."""
    lines = _lines(docs)
    halves = ["a", "b", "c", "d"]
    slim = cut(lines.select("at", "h", "g", *[x.alias(k) for k, x in zip(halves, _halves(near_chars), strict=True)]))
    classes = cut(slim.groupBy("h", "g").agg(F.min("at").alias("first"), F.count("*").alias("times"), *[F.min(k).alias(k) for k in halves]))
    met = classes.select("h", F.explode(F.array(*halves)).alias("half")).where("half is not null")
    # written, so that the joins that follow have plain exchanges on both sides, and Spark can split a hot half or line
    shared = cut(met.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half"))
    wanted = cut(met.join(shared, "half", "left_semi").select("h").distinct())
    long_lines = lines.where(F.length("line") >= near_chars)
    texts = _filter(long_lines, wanted).groupBy("h", "g", "line").agg(F.min("at").alias("at")).join(wanted, "h", "left_semi")
    # ranks in the order of `at`, in place of it in the many rows that follow
    able = cut(texts.repartitionByRange("at").sortWithinPartitions("at").select("h", "g", "line", F.monotonically_increasing_id().alias("rank")))
    keys = able.select("line", "rank").mapInArrow(_emit, "key long, place int, rank long").repartition("key").sortWithinPartitions("key", "place", "rank")
    found = keys.mapInArrow(_meet, "rank long, best long").distinct()
    other = able.select(F.col("rank").alias("best"), F.col("line").alias("other"))
    paired = found.join(able, "rank").join(other, "best").select("h", "g", "line", "other")
    late = paired.mapInArrow(_verify, "h long, g long").distinct().withColumn("near", F.lit(True))
    doomed = cut(classes.join(late, ["h", "g"], "left").where("times > 1 or near").select("h", "g", "first", "near"))
    hit = slim.select("at", "h", "g").join(doomed, ["h", "g"]).where("near or at <> first")
    return hit.select("at.id", "at.row", "at.no")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with its text less all lines that an earlier line of the corpus equals or, from near_chars on, nears.

    Earlier is by id, then by a hash of the text, then by line number; null ids come last.  An earlier line that
    is itself removed counts too.  Lines are cut at \\n; lines without a word stay.  A null text stays null.  Of
    repeated rows (equal id and text) none is earlier: each keeps what the first keeps.  Every row of docs stays,
    with an empty text if all its lines go.  Columns of docs keep their names and values, whatever these are.  An
    empty table gives no rows.
    """
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    ids = boxed.select("doc", F.col(f"doc.`{id_col}`").alias("id"), F.xxhash64(F.col(f"doc.`{text_col}`")).alias("row"))
    slim = ids.select("id", "row", F.col(f"doc.`{text_col}`").alias("text"))
    gone = repeats(slim, near_chars)
    lost = gone.groupBy("id", "row").agg(F.collect_set("no").alias("lost")).select(F.col("id").alias("id2"), F.col("row").alias("row2"), "lost")
    met = ids.join(lost, F.col("id").eqNullSafe(F.col("id2")) & (F.col("row") == F.col("row2")), "left")
    # the lines are bound to a variable, so that the text is cut once
    lines = F.array(F.split(F.col(f"doc.`{text_col}`"), "\n", -1))
    left = F.element_at(F.transform(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), "lost"), lambda i: F.get(x, i)), "\n")), 1)
    text = F.when(F.col("lost").isNull(), F.col(f"doc.`{text_col}`")).otherwise(left)
    return met.withColumn("text", text).select(*[F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and n_chars of every document after line deduplication."""
    return deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("n_chars", F.length("text").cast("long"))

"""Quality rules: an isolation forest on rule statistics, its threshold calibrated from labelled rows.

Rule statistics are computed over every whole text.  All labelled rows that pass the base rules are learned from:
typical rates, the statistics' ranges and the threshold are taken over every one of them, and each tree is grown, as
the method has it, on SUBSAMPLE rows of its own, drawn from all the good ones; a tree splits a random statistic at a
random place.  Documents that few splits isolate are anomalous.  The threshold is the one that best tells the good
rows from the bad ones among those that keep KEEP_GOOD of the good rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, numbers, raw, read

TREES, SUBSAMPLE, KEEP_GOOD, SEED = 200, 256, 0.98, 7
#: Rows are ranked within so many ranges of hashes and of scores, whose counts alone the driver sees.
RANGES = 1 << 14
#: Words of typical text that are added to each text's rates.
SHRINK = 80.0
WINDOW, MIN_WORDS, REPEAT_PERCENT = 8, 20, 30

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACE = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_STOPS = np.frombuffer(b".,;:", np.uint8)
_CALLS = np.frombuffer(b"!?", np.uint8)
_MULT = np.random.default_rng(SEED).integers(1, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of `window` words which the text holds twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        key = sum(h[k : k + n] * _MULT[k] for k in range(window))
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice)).tolist()
    text = [tuple(words[i : i + window]) for i in at]  # equal numbers are checked by the words themselves
    times = Counter(text)
    marks = np.zeros(len(words) + 1, np.int64)
    for i, t in zip(at, text, strict=True):
        if times[t] > 1:
            marks[i] += 1
            marks[i + window] -= 1
    return int((np.cumsum(marks)[:-1] > 0).sum())


def statistics(text: bytes) -> tuple[int, int, int, int, int, list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the forest's counts, numerator and denominator in turn."""
    words = text.split()
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = len(text) - int(seen[0x80:0xC0].sum())
    word_chars = chars - int(seen[_SPACE].sum())
    symbols = int(seen[_SYMBOLS].sum())
    lines, dup, n_lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line in lines:
            dup += 1
        elif line.strip():
            lines.add(line)
            n_lines += 1
    n_lines += dup
    n, repeat = len(words), repeated_words(words)
    upper, letters = int(seen[65:91].sum()), int(seen[65:91].sum() + seen[97:123].sum())
    stops, calls, digits = int(seen[_STOPS].sum()), int(seen[_CALLS].sum()), int(seen[48:58].sum())
    f = [word_chars, n, symbols, n, dup, n_lines, repeat, n, upper, letters, digits, word_chars, stops, n, calls, n, n_lines, n, len(set(words)), n]
    return n, word_chars, symbols, dup, repeat, f


def priors(counts: np.ndarray) -> np.ndarray:
    """The typical rate of each statistic, from rows of counts (numerator and denominator in turn)."""
    return counts[:, 0:-2:2].sum(axis=0) / np.maximum(counts[:, 1:-2:2].sum(axis=0), 1)


def features(counts: np.ndarray, typical: np.ndarray) -> np.ndarray:
    """Square roots of rates that are drawn to the typical ones as if by so much more text, and the vocabulary's growth.

    So a short text is not odd because its few lines, capitals or stops happen to lie apart.
    """
    top, of = counts[:, 0:-2:2], counts[:, 1:-2:2]
    more = np.array([SHRINK * x for x in (1, 1, 0.1, 1, 5, 5, 1, 1, 1)])
    rates = np.sqrt((top + more * typical) / (of + more))
    grown = (np.log1p(counts[:, -2]) + 1) / (np.log1p(counts[:, -1]) + 1)
    return np.column_stack([rates, grown])


_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, stats array<long>"
_NAMES = [x.split()[0] for x in _STATS.split(", ")]
_COUNTS = len(statistics(b"")[-1])


def _stats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(x) for x in raw(batch, "text")]
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text_hash")]
        columns += [pa.array([x[i] for x in found], pa.int64()) for i in range(5)]
        columns.append(pa.array([x[5] for x in found], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", *_NAMES])


def grow(x: np.ndarray, box: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED, picks: list | None = None) -> list[tuple]:
    """Isolation trees over the rows of x: arrays (feature or -1, split, left, right, path length at a leaf).

    A tree's rows are the `subsample` rows that picks names for it, or as many drawn here.
    Splits fall anywhere in the node's part of `box` (least and largest of each statistic over good and bad
    rows), so that a region without good rows is cut off even where the good rows are all alike.
    """
    rng, out = np.random.default_rng(seed), []
    harmonic = lambda n: 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    deepest = 2 * int(np.ceil(np.log2(max(2, min(subsample, len(x))))))
    for t in range(trees):
        rows = x[rng.choice(len(x), min(subsample, len(x)), replace=False) if picks is None else picks[t]]
        feature, split, left, right, path = [], [], [], [], []

        def node(part: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
            me = len(feature)
            for column in (feature, left, right):
                column.append(-1)
            split.append(0.0)
            path.append(depth + harmonic(len(part)))
            spread = np.flatnonzero(high > low) if len(part) > 1 and depth < deepest else []
            if len(spread):
                f = int(rng.choice(spread))
                cutoff = rng.uniform(low[f], high[f])
                go = part[:, f] < cutoff
                feature[me], split[me] = f, float(cutoff)
                under, over = high.copy(), low.copy()
                under[f] = over[f] = cutoff
                left[me], right[me] = node(part[go], low, under, depth + 1), node(part[~go], over, high, depth + 1)
            return me

        node(rows, box[0], box[1], 0)
        out.append(tuple(map(np.array, (feature, split, left, right, path))))
    return out


def anomaly(x: np.ndarray, forest: list[tuple], subsample: int) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 for rows that few splits isolate."""
    total = np.zeros(len(x))
    for feature, split, left, right, path in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            f = feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                break
            a = at[inner]
            at[inner] = np.where(x[inner, f[inner]] < split[a], left[a], right[a])
        total += path[at]
    expected = 2 * (np.log(max(subsample, 3) - 1) + np.euler_gamma) - 2 * (max(subsample, 3) - 1) / max(subsample, 3)
    return 2.0 ** (-total / len(forest) / expected)


def calibrate(score: np.ndarray, good: np.ndarray, keep: float = KEEP_GOOD) -> float:
    """The threshold with the least share of good rows rejected plus share of bad rows kept, where `keep` of the good ones stay.

    Of equal ones the largest, in the middle of the gap above it; without bad rows the largest good score.
    """
    fine, bad = np.sort(score[good]), np.sort(score[~good])
    if not len(bad):
        return float(fine[-1])
    cuts = np.unique(score[score >= np.quantile(fine, keep, method="higher")])
    wrong = 1 - np.searchsorted(fine, cuts, "right") / len(fine) + np.searchsorted(bad, cuts, "right") / len(bad)
    k = len(cuts) - 1 - int(np.argmin(wrong[::-1]))
    return float((cuts[k] + cuts[min(k + 1, len(cuts) - 1)]) / 2)


def threshold(scores: DataFrame, keep: float = KEEP_GOOD) -> float:
    """What `calibrate` gives for all rows of scores (good: boolean, anomaly: 0 to 1), of which one is good.

    Rows are counted by score and by range of scores; within the ranges the counts are summed in turn, by a task each.
    """
    marked = scores.withColumn("range", F.floor(F.col("anomaly") * RANGES))
    each = cut(marked.groupBy("range", "anomaly").agg(F.count_if("good").alias("fine"), F.count_if(~F.col("good")).alias("bad")))
    ranges = each.groupBy("range").agg(F.sum("fine").alias("fine"), F.sum("bad").alias("bad")).sort("range").toArrow()
    at, fine, bad = (numbers(ranges, c) for c in ("range", "fine", "bad"))
    n_fine, n_bad = int(fine.sum()), int(bad.sum())
    if not n_bad:
        return each.where("fine > 0").agg(F.max("anomaly")).first()[0]
    least = int(np.ceil(keep * (n_fine - 1))) + 1  # good rows that stay
    before = pa.table({"range": at, "fine_before": np.cumsum(fine) - fine, "bad_before": np.cumsum(bad) - bad}).filter(pa.array(np.cumsum(fine) >= least))
    upto = Window.partitionBy("range").orderBy("anomaly").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = each.join(F.broadcast(each.sparkSession.createDataFrame(before)), "range").select(
        "anomaly", (F.col("fine_before") + F.sum("fine").over(upto)).alias("fine"), (F.col("bad_before") + F.sum("bad").over(upto)).alias("bad")
    )
    wrong = F.col("bad") * n_fine - F.col("fine") * n_bad
    best = summed.where(F.col("fine") >= least).agg(F.min(F.struct(wrong.alias("wrong"), (-F.col("anomaly")).alias("low")))).first()[0]
    above = each.where(F.col("anomaly") > -best.low).agg(F.min("anomaly")).first()[0]
    return (-best.low + (-best.low if above is None else above)) / 2


def _drawn(good: DataFrame, n: int, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Counts of the rows that trees are grown on, and for each tree the places of its `size` ones; all n rows of good may be drawn.

    Rows rank by a hash of their id; ranks are drawn here, and only the rows that have them are sent.
    """
    rng = np.random.default_rng(SEED)
    ranks = [rng.choice(n, size, replace=False) for _ in range(TREES)]
    wanted = np.unique(np.concatenate(ranks))
    hashed = good.withColumn("range", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - RANGES.bit_length() + 1))
    ranges = hashed.groupBy("range").count().sort("range").toArrow()
    at, last = numbers(ranges, "range"), np.cumsum(numbers(ranges, "count"))
    k = np.searchsorted(last, wanted, "right")
    places = pa.table({"range": at[k], "place": wanted - (last[k] - numbers(ranges, "count")[k]) + 1, "rank": wanted})
    placed = hashed.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy(F.xxhash64("doc_id"), "doc_id", "stats")).cast("long"))
    rows = placed.join(F.broadcast(good.sparkSession.createDataFrame(places)), ["range", "place"]).select("rank", "stats").toArrow()
    order = np.argsort(numbers(rows, "rank"))
    counts = np.asarray(rows["stats"].to_pylist(), np.float64)[order]
    return counts, [np.searchsorted(wanted, r) for r in ranks]


def _judge(model):
    """Rows with `anomaly` in place of their counts."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, size, typical = model.value
        for batch in batches:
            x = np.asarray(batch.column(batch.schema.get_field_index("stats")).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            out = anomaly(features(x, typical), trees, size) if trees and len(x) else np.zeros(len(x))
            rest = [i for i, c in enumerate(batch.schema.names) if c != "stats"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(out)], names=[*(batch.schema.names[i] for i in rest), "anomaly"])

    return judge


def _box(usable: DataFrame, typical: np.ndarray) -> np.ndarray:
    """The least and the largest of each statistic over all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = features(np.asarray(batch.column(0).to_pylist(), np.float64), typical)
                yield pa.RecordBatch.from_arrays([pa.array(range(x.shape[1]), pa.int32()), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], names=["k", "low", "high"])

    ends = usable.select("stats").mapInArrow(run, "k int, low double, high double").groupBy("k").agg(F.min("low"), F.max("high")).sort("k").collect()
    return np.array([[r[1] for r in ends], [r[2] for r in ends]])


def scored(docs: DataFrame, labels: DataFrame, keep: float = KEEP_GOOD) -> DataFrame:
    """doc_id, text_hash, the rule statistics, `anomaly`, `base_failed` and `kept`, one row per row of docs (doc_id, text).

    A null text has no words, and so fails the base rules.  Labels that are null, and labels of unknown ids,
    are not used; if fewer than two good rows are labelled, the forest keeps all that the base rules keep.
    Columns of docs beside these two, whatever their names, are not read.  Repeated rows come out repeated; an empty table gives no rows.
    """
    spark = docs.sparkSession
    found = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_stats, f"doc_id long, text_hash long, {_STATS}"))
    marks = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    usable = cut(found.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {REPEAT_PERCENT} * n_words").join(marks, "doc_id").select((F.col("quality") > 0).alias("good"), "stats", "doc_id"))
    good = usable.where("good")
    n_good, *sums = good.agg(F.count("*"), *[F.sum(F.col("stats")[i]) for i in range(_COUNTS)]).first()
    bound, size = float("inf"), 2
    trees, typical = [], None
    if n_good >= 2:
        typical = priors(np.array([sums], np.float64))
        size = min(SUBSAMPLE, n_good)
        counts, picks = _drawn(good, n_good, size)
        trees = grow(features(counts, typical), _box(usable, typical), TREES, size, picks=picks)
    model = spark.sparkContext.broadcast((trees, size, typical))
    if trees:
        bound = threshold(usable.select("good", "stats").mapInArrow(_judge(model), "good boolean, anomaly double"), keep)

    judged = found.mapInArrow(_judge(model), "doc_id long, text_hash long, " + ", ".join(x for x in _STATS.split(", ") if not x.startswith("stats")) + ", anomaly double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") <= bound))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) whose verdict is kept, with all columns."""
    verdicts = scored(docs, labels).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64(F.col("doc.text")) == F.col("kept_hash"))
    return boxed.join(verdicts, same, "left_semi").select("doc.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("text_hash")

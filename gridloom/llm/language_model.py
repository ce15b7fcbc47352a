"""LM scoring with Brown class-based n-grams.

Pass 1 counts all training tokens.  All words met PLACED times or more, a vocabulary that grows with the input,
are placed: each has a class of its own.  Rarer and unseen words form groups by their last three bytes.  Pass 2
turns every text into numbers, of a placed word or of a group, once; all later passes read those numbers.

Exchange clustering first runs on the dense counts of the OWN most frequent words and the groups, which gives
the classes that all placed words start from.  Then come sweeps over the whole vocabulary, as in distributed
exchange clustering: Spark sums each word's and group's neighbours by class, and each goes to the class that
raises the class bigrams' mutual information most; all move at once, and the mutual information is measured
after each sweep.  Sweeps end when it rises by less than SETTLED, or after WORD_SWEEPS; a sweep that lowers it is undone.

Scoring: P(word | previous) = P(class | previous class) P(symbol | class) P(word | symbol), the transition
smoothed towards the class's frequency; a placed word is a symbol of its own, else its share of its group is
(c + 0.1) / (group tokens + 0.1 (group types + 1)).  Rare words and their counts meet by a shuffle on the word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, raw, read

OWN, GROUPS, CLASSES, SWEEPS, ALPHA, BACKOFF = 600, 300, 64, 8, 0.1, 5.0
#: Words met so often have a class of their own; 17 bytes of each go to every worker, so beyond MOST_PLACED the bound rises.
PLACED, MOST_PLACED = 10, 1 << 24
#: Sweeps end when a token's mean log10 probability rises by less than SETTLED, or after WORD_SWEEPS.
SETTLED, WORD_SWEEPS = 0.002, 6
#: Texts that are turned into numbers at once, tokens whose neighbours are counted at once.
TEXTS, RUN = 500, 2_000_000
#: The end token; no word holds a space.
END = b" "
HELD_OUT = "crc32(cast(doc_id as string)) % 10 = 0"


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words and one end token."""
    return [*text.lower().split(), END]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for at in range(0, batch.num_rows, TEXTS):
            for text in raw(batch.slice(at, TEXTS), "text"):
                seen.update(tokens(text))
            if len(seen) > 300_000:
                yield _counted(seen)
                seen = Counter()
        if seen:
            yield _counted(seen)


def _counted(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])


def hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in words]), np.int64)


def _hash(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = raw(batch, "word")
        suffixes = pa.array([w[-3:] for w in words], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(hashes(words), pa.int64()), batch.column(batch.schema.get_field_index("c")), suffixes], names=["h", "c", "s"])


class Numbers:
    """Word -> number: 0 is the end token, 1 all small groups, then the groups by suffix, then placed words in the order of their hashes.

    Words are told apart by 64-bit hashes; among 16 million placed words and 10 billion others about 0.01 are confused.
    """

    MEMO = 200_000

    def __init__(self, suffixes: list[bytes], sorted_hashes: np.ndarray):
        self.groups = {s: i + 2 for i, s in enumerate(suffixes)}
        self.first, self.hashes, self.memo = len(suffixes) + 2, sorted_hashes, {END: 0}

    def of(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        found = [memo.get(w) for w in words]
        new = list({w for w, x in zip(words, found, strict=True) if x is None})
        if new:
            number = np.fromiter([self.groups.get(w[-3:], 1) for w in new], np.int64, len(new))
            if len(self.hashes):
                h = hashes(new)
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                number = np.where(self.hashes[at] == h, self.first + at, number)
            memo.update(zip(new, number.tolist(), strict=True))
            found = [memo[w] for w in words]
            if len(memo) > self.MEMO:
                self.memo = {END: 0}
        return np.array(found, np.int32)


def _runs(batches: Iterable[pa.RecordBatch], size: int = RUN) -> Iterator[np.ndarray]:
    """The numbers of many texts in one run, an end token before the first and after each."""
    held, n = [np.zeros(1, np.int32)], 1
    for batch in batches:
        for x in batch.column(0):
            held.append(np.frombuffer(x.as_buffer(), np.int32))
            n += len(held[-1])
            if n > size:
                yield np.concatenate(held)
                held, n = [np.zeros(1, np.int32)], 1
    if n > 1:
        yield np.concatenate(held)


def neighbour_classes(runs: Iterable[np.ndarray], label: np.ndarray, classes: int) -> Iterator[pa.RecordBatch]:
    """(bucket, keys, times): how often each class stands before and after each number.

    A bucket is 65,536 / (2 classes) numbers; a key is place in it x 2 classes + class before, or classes + class
    after.  Times over 255 are cut into several entries.
    """
    wide = 2 * classes
    dtype = np.uint32 if len(label) * wide < 1 << 32 else np.uint64
    for s in runs:
        l = label[s].astype(dtype)  # noqa: E741
        n = s.astype(dtype) * dtype(wide)
        keys, times = np.unique(np.concatenate([n[1:] + l[:-1], n[:-1] + l[1:] + dtype(classes)]), return_counts=True)
        big = -(-times // 255)
        if big.max() > 1:
            last = np.cumsum(big) - 1
            left = times - 255 * (big - 1)
            keys, times = np.repeat(keys, big), np.full(int(big.sum()), 255, np.int64)
            times[last] = left
        bucket = (keys >> dtype(16)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        stop = np.append(start[1:], len(keys))
        where, often = (keys & dtype(0xFFFF)).astype(np.uint16), times.astype(np.uint8)
        columns = [pa.array(bucket[start])] + [pa.array([x[a:b].tobytes() for a, b in zip(start, stop, strict=True)], pa.binary()) for x in (where, often)]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "times"])


def likeliest(context: np.ndarray, old: np.ndarray, between: np.ndarray) -> np.ndarray:
    """For rows of counts by class before and class after, the class that makes them likeliest; class 0 is the end token's."""
    smooth = between + BACKOFF / len(between)
    before, after = np.hsplit(context.astype(float), 2)
    gain = before @ np.log(smooth) + after @ np.log(smooth).T
    gain -= before.sum(axis=1)[:, None] * np.log(smooth.sum(axis=0)) + after.sum(axis=1)[:, None] * np.log(smooth.sum(axis=1))
    gain[:, 0] = -np.inf
    new = gain.argmax(axis=1)
    rows = np.arange(len(old))
    return np.where(gain[rows, new] > gain[rows, old] + 1e-9, new, old)


def sweep(numbers: DataFrame, label: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Labels after each number but the end token's went to its likeliest class."""
    classes = len(between)
    size = 65_536 // (2 * classes)
    state = numbers.sparkSession.sparkContext.broadcast((label, between))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from neighbour_classes(_runs(batches), state.value[0], classes)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, between = state.value

        def out(bucket, held):
            old = label[bucket * size : (bucket + 1) * size]
            new = likeliest(held.reshape(size, -1)[: len(old)], old, between).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([new.tobytes()], pa.binary())], names=["bucket", "labels"])

        last, held = None, None
        for batch in batches:
            for bucket, keys, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != last:
                    if last is not None:
                        yield out(last, held)
                    last, held = bucket, np.zeros(65_536, np.int64)
                np.add.at(held, np.frombuffer(keys, np.uint16), np.frombuffer(times, np.uint8))
        if last is not None:
            yield out(last, held)

    parts = numbers.mapInArrow(count, "bucket long, keys binary, times binary").repartition("bucket").sortWithinPartitions("bucket")
    new = label.copy()
    for bucket, labels in parts.mapInArrow(place, "bucket long, labels binary").collect():
        got = np.frombuffer(bytes(labels), np.uint8)
        new[bucket * size : bucket * size + len(got)] = got
    new[0] = 0
    state.unpersist()
    return new


def bigrams(numbers: DataFrame, label: np.ndarray, n: int) -> np.ndarray:
    """Neighbour counts (n, n) of the labels of numbers; n is of a fixed size."""
    state = numbers.sparkSession.sparkContext.broadcast(label)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n * n, np.int64)
        for s in _runs(batches):
            l = state.value[s].astype(np.int64)  # noqa: E741
            seen += np.bincount(l[:-1] * n + l[1:], minlength=len(seen))
        at = np.flatnonzero(seen)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(seen[at[i : i + 100_000]])], names=["pair", "c"])

    met = numbers.mapInArrow(count, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    between = np.zeros(n * n)
    between[met["pair"].to_numpy()] = met["c"].to_numpy()
    state.unpersist()
    return between.reshape(n, n)


def information(between: np.ndarray) -> float:
    """Mean log10 of P(class | class before) P(word | class), less what no choice of classes changes."""
    xlogx = lambda x: float((x * np.log10(np.maximum(x, 1e-300))).sum())
    return (xlogx(between) - xlogx(between.sum(axis=0)) - xlogx(between.sum(axis=1))) / max(1.0, float(between.sum()))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Exchange clustering of symbols by their dense matrix of neighbour counts; symbol 0 keeps class 0.

    Each symbol in turn goes to the class that gives the largest sum N(c,d) log N(c,d) - 2 sum N(c) log N(c);
    sweeps end when no symbol moves.
    """
    n = len(pairs)
    left, right = pairs.sum(axis=1), pairs.sum(axis=0)
    order = np.argsort(-(left + right), kind="stable")
    order = order[order != 0]
    label = np.zeros(n, np.int64)
    label[order] = 1 + np.arange(n - 1) % max(1, classes - 1)
    onehot = np.zeros((n, classes))
    onehot[np.arange(n), label] = 1
    out, into = pairs @ onehot, pairs.T @ onehot  # counts of each symbol towards and from each class
    between = onehot.T @ out
    xlogx = lambda x: x * np.log(np.maximum(x, 1e-300))
    mass_l, mass_r = onehot.T @ left, onehot.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in order:
            old, both = label[w], pairs[w, w]
            o, i = out[w].copy(), into[w].copy()
            o[old] -= both
            i[old] -= both
            base = between.copy()
            base[old] -= o
            base[:, old] -= i
            base[old, old] -= both
            m_l, m_r = mass_l.copy(), mass_r.copy()
            m_l[old] -= left[w]
            m_r[old] -= right[w]
            rows = (xlogx(base + o[None, :]) - xlogx(base)).sum(axis=1)
            columns = (xlogx(base + i[:, None]) - xlogx(base)).sum(axis=0)
            d = np.diag(base)
            corner = xlogx(d + o + i + both) - xlogx(d + o) - xlogx(d + i) + xlogx(d)
            gain = rows + columns + corner - (xlogx(m_l + left[w]) - xlogx(m_l)) - (xlogx(m_r + right[w]) - xlogx(m_r))
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                new = int(old)
            moved += new != old
            between = base
            between[new] += o
            between[:, new] += i
            between[new, new] += both
            m_l[new] += left[w]
            m_r[new] += right[w]
            mass_l, mass_r = m_l, m_r
            if new != old:
                label[w] = new
                column, row = pairs[:, w], pairs[w]
                out[:, old] -= column
                out[:, new] += column
                into[:, old] -= row
                into[:, new] += row
        if not moved:
            break
    return label


def clustered(numbers: DataFrame, label: np.ndarray, between: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Labels and class bigrams after the sweeps, and the information before the first and after each."""
    gained = [information(between)]
    for _ in range(WORD_SWEEPS if most is None else most):
        new = sweep(numbers, label, between)
        if np.array_equal(new, label):
            break
        met = bigrams(numbers, new, len(between))
        gained.append(information(met))
        if gained[-1] <= gained[-2]:
            break
        label, between = new, met
        if gained[-1] < gained[-2] + SETTLED:
            break
    return label, between, gained


class Fitted(NamedTuple):
    """What was learned, the texts as numbers (parts) and the counts of training tokens."""

    parts: DataFrame
    counts: DataFrame
    least: int
    total: int
    types: int
    suffixes: list[bytes]
    hashes: np.ndarray
    label: np.ndarray
    transition: np.ndarray
    emission: np.ndarray
    information: list[float]


def fitted(docs: DataFrame, held_out: str = HELD_OUT, sweeps: int | None = None) -> Fitted:
    """The model of the rows of docs (doc_id, text) that are not held out; `sweeps` bounds those over the whole vocabulary."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"))
    counts = cut(rows.where("not held_out").select("text").mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")))
    least = max(PLACED, _bound(counts, MOST_PLACED))
    few, word = F.col("c") < least, F.col("word") != F.lit(bytearray(END))
    total, types, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(~word, F.col("c"))), F.lit(0))).first()
    by_suffix = counts.where(word).groupBy(F.substring("word", -3, 3).alias("s")).agg(
        F.sum("c").alias("c"), F.coalesce(F.sum(F.when(few, F.col("c"))), F.lit(0)).alias("m"), F.count_if(few).alias("v")
    )
    kept = by_suffix.orderBy(F.desc("c"), "s").limit(GROUPS).toPandas()
    rest = by_suffix.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    suffixes = [bytes(s) for s in kept["s"]]
    known = {s: i + 2 for i, s in enumerate(suffixes)}
    placed = counts.where(word & ~few).mapInArrow(_hash, "h long, c long, s binary").toArrow().sort_by("h")
    first, times = len(suffixes) + 2, placed["c"].to_numpy()
    group = np.concatenate([np.arange(first), np.array([known.get(x, 1) for x in placed["s"].to_pylist()], np.int64)])
    in_group, kinds = np.zeros(first), np.zeros(first)  # tokens and types of the words that are not placed
    in_group[0], in_group[2:], kinds[2:] = ends, kept["m"], kept["v"]
    in_group[1], kinds[1] = rest[0] - in_group[2:].sum(), rest[1] - kinds[2:].sum()
    mass = np.concatenate([in_group, times])
    sorted_hashes = placed["h"].to_numpy()
    table = spark.sparkContext.broadcast((suffixes, sorted_hashes, np.concatenate([[ends], np.full(first - 1, -1), times])))
    del placed

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text its numbers, what placed words tell, and the other words with their frequencies."""
        suffixes, sorted_hashes, times = table.value
        words_of, first = Numbers(suffixes, sorted_hashes), len(suffixes) + 2
        logs = np.log10(np.maximum(times, 0) + ALPHA)
        logs[1:first] = 0.0
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                n, known, base, packed, rare, often = [], [], [], [], [], []
                for text in raw(batch, "text"):
                    words = tokens(text)
                    s = words_of.of(words)
                    other = np.flatnonzero((s < first) & (s > 0)).tolist()
                    missing = Counter([words[i] for i in other])
                    n.append(len(words))
                    known.append(len(words) - len(other))
                    base.append(float(logs[s].sum()))
                    packed.append(s.tobytes())
                    rare.append(list(missing))
                    often.append(list(missing.values()))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id", "held_out")),
                        pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(packed, pa.binary()),
                        pa.array(rare, pa.list_(pa.binary())), pa.array(often, pa.list_(pa.int64())),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "numbers", "words", "times"],
                )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, numbers binary, words array<binary>, times array<long>"
    parts = cut(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "text").mapInArrow(number, schema))
    numbers = parts.where("not held_out").select("numbers")
    # classes to start from: the most frequent words and the groups, by dense counts
    own = first + np.argsort(-times, kind="stable")[:OWN]
    coarse = group.astype(np.int32)
    coarse[own] = first + np.arange(len(own))
    pairs = bigrams(numbers, coarse, first + len(own))
    start = exchange(pairs)
    member = np.eye(CLASSES)[start]
    label, between, gained = clustered(numbers, start[coarse].astype(np.uint8), member.T @ (pairs @ member), sweeps)
    label = label.astype(np.int64)
    share = np.bincount(label, weights=mass, minlength=CLASSES) + 1.0 / CLASSES
    share = share / share.sum()
    transition = np.log10((between + BACKOFF * share[None, :]) / (between.sum(axis=1, keepdims=True) + BACKOFF))
    weight = mass + ALPHA  # every symbol of a class may come, also one not met in training
    emission = np.log10(weight / np.bincount(label, weights=weight, minlength=CLASSES)[label])
    emission[1:first] -= np.log10(in_group[1:] + ALPHA * (kinds[1:] + 1))
    return Fitted(parts, counts, least, total, types, suffixes, sorted_hashes, label.astype(np.uint8), transition, emission, gained)


def scored(docs: DataFrame, held_out: str = HELD_OUT, sweeps: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs (doc_id, text).

    A null or empty text is its end token alone.  A row with a null id is in training.  Repeated rows are scored
    alike and counted in training as often as they occur.  Words of nearly equal counts are placed together or not.
    Other columns of docs, also of these names, are not read.  An empty table gives no rows.
    """
    found = fitted(docs, held_out, sweeps)
    model = docs.sparkSession.sparkContext.broadcast((found.label, found.transition, found.emission))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, transition, emission = model.value
        for batch in batches:
            full = []
            for x in batch.column(batch.schema.get_field_index("numbers")):
                s = np.frombuffer(x.as_buffer(), np.int32)
                k = label[s]
                full.append(float(transition[np.concatenate([label[:1], k[:-1]]), k].sum() + emission[s].sum()))
            rest = [i for i, name in enumerate(batch.schema.names) if name != "numbers"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(full, pa.float64())], names=[*(batch.schema.names[i] for i in rest), "full"])

    parts, total = found.parts, found.total
    whole = parts.drop("words", "times").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, full double")
    tail = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    looked = tail.join(found.counts.where(F.col("c") < found.least), "word", "left")
    logs = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ALPHA))
    sums = looked.groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("known2"), F.sum(logs).alias("logs"))
    more = F.coalesce("logs", F.lit(0.0))
    return whole.join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(float(np.log10(total + ALPHA * (found.types + 1))))).alias("base_score"), (F.col("full") + more).alias("score"),
    )


def _bound(counts: DataFrame, most: int) -> int:
    """A count that at most `most` words reach: from counts' eighths of a power of two, so that no task sends a table of its own."""
    eighth = F.floor(8 * F.log2(F.col("c"))).cast("int")
    sizes = counts.groupBy(eighth.alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("k")).collect()
    bound, held = 1 << 62, 0
    for k in sizes:
        held += k["n"]
        if held > most:
            break
        bound = k["c"]
    return bound


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"))

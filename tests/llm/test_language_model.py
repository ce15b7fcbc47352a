"""LM scoring: the base score against brute force, the class model's sums and its gain on held-out text."""

import math
import os
import random
import subprocess
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np

from gridloom.llm import language_model


def corpus(n=400, seed=1):
    """Sentences from a small grammar: classes of words follow each other."""
    rng = random.Random(seed)
    nouns, verbs, dets = [f"noun{i}" for i in range(40)], [f"verb{i}s" for i in range(30)], ["the", "a", "this", "each"]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(1, 12)):
            words += [rng.choice(dets), rng.choice(nouns), rng.choice(verbs)]
        out.append((i, " ".join(words)))
    out += [(1000, None), (1001, ""), (1002, "never seen words ÀÉ here"), (1003, "THE Noun1\nverb2s"), (1003, "THE Noun1\nverb2s"), (None, "the noun1 verb2s"), (1004, " ".join(w for _, t in out[:100] for w in t.split()))]
    return out


def base(rows):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode()
    tokens = [(i, [*low(t).split(), b" "]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, ws in tokens if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, out(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens]


def check(got, rows):
    want = sorted(base(rows), key=str)
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    assert [w[:5] for w in want] == [f[:5] for f in found]
    assert np.allclose([w[5] for w in want], [f[5] for f in found])


def test_base_score_and_gain(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, part string, n_tokens int").repartition(4)
    got = language_model.scored(frame).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)
    assert all(r.score < 0 for r in got)


def test_score_by_plain_computation(spark, monkeypatch):
    """The score from the labels alone: transitions, emissions and shares are counted anew, word by word."""
    for name, value in (("PLACED", 4), ("OWN", 20), ("GROUPS", 5)):
        monkeypatch.setattr(language_model, name, value)
    rows = corpus(150)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = language_model.fitted(frame)
    numbers = language_model.Numbers(model.suffixes, model.hashes)
    low = lambda t: [*(t or "").encode().lower().split(), b" "]
    training = [low(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for ws in training for w in ws)
    number = {w: int(numbers.of([w])[0]) for _, t in rows for w in low(t)}
    for w, n in number.items():
        group = next((2 + k for k, x in enumerate(model.suffixes) if x == w[-3:]), 1)
        assert n == 0 if w == b" " else n >= numbers.first if counts[w] >= 4 else n == group
    label = lambda w: int(model.label[number[w]])
    k, pairs = language_model.CLASSES, Counter()
    for ws in training:
        pairs.update(zip([0, *map(label, ws)], map(label, ws), strict=False))
    left, tokens = Counter(), Counter()
    for (a, _), c in pairs.items():
        left[a] += c
    for w, c in counts.items():
        tokens[number[w]] += c
    share = [sum(c for n, c in tokens.items() if model.label[n] == x) + 1 / k for x in range(k)]
    weight = [sum(tokens[n] + 0.1 for n in range(len(model.label)) if model.label[n] == x) for x in range(k)]
    kinds = Counter(number[w] for w in counts if 0 < number[w] < numbers.first)

    def score(ws):
        total, last = 0.0, 0
        for w in ws:
            at, n = label(w), number[w]
            total += math.log10((pairs[last, at] + 5 * share[at] / sum(share)) / (left[last] + 5)) + math.log10((tokens[n] + 0.1) / weight[at])
            if 0 < n < numbers.first:
                total += math.log10((counts[w] + 0.1) / (tokens[n] + 0.1 * (kinds[n] + 1)))
            last = at
        return total

    want = sorted((str(i), score(low(t))) for i, t in rows)
    got = sorted((str(r.doc_id), r.score) for r in language_model.scored(frame).collect())
    assert [i for i, _ in want] == [i for i, _ in got] and np.allclose([x for _, x in want], [x for _, x in got])


def test_sweeps_place_all_words_and_pay_on_held_out_text(spark, monkeypatch):
    """Every word met PLACED times has a class of its own, and the information rises with each sweep that is kept."""
    for name, value in (("OWN", 10), ("GROUPS", 3)):
        monkeypatch.setattr(language_model, name, value)
    rows = corpus(600)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = language_model.fitted(frame)
    counts = Counter(w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 for w in (t or "").lower().split())
    assert len(model.hashes) == sum(c >= language_model.PLACED for c in counts.values()) > 60
    assert len(model.information) > 1 and model.information[1] > model.information[0]
    held = lambda n: sum(r.score for r in language_model.scored(frame, sweeps=n).collect() if r.held_out)
    assert held(None) > held(0)


def test_workers_without_the_package(tmp_path):
    """Started from elsewhere: workers can't import the package, so whatever they get must be plain data or code by value."""
    repo = str(Path(__file__).resolve().parents[2])
    code = f"""
import sys; sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from gridloom.llm import registry
s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').config('spark.checkpoint.dir', {str(tmp_path)!r}).getOrCreate()
s.createDataFrame([(i, 'the quick brown fox jumps over the lazy dog again ' * 3) for i in range(40)], 'doc_id long, text string').write.parquet('t/documents.parquet')
assert len(registry.QUERIES['op8_lm_scoring'](s, 't').collect()) == 40
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=300)


def test_probabilities_of_a_next_word_sum_to_one(spark):
    rows = corpus(60)
    vocabulary = sorted({w for _, t in rows for w in (t or "").lower().split()}) + [""]
    frame = spark.createDataFrame([(i if i is None else i, t) for i, t in rows], "doc_id long, text string")
    probe = [(10_000 + i, w) for i, w in enumerate(vocabulary)]
    held = "doc_id >= 10000"
    both = frame.union(spark.createDataFrame(probe, "doc_id long, text string"))
    score = {r.doc_id - 10_000: r.score for r in language_model.scored(both, held).collect() if (r.doc_id or 0) >= 10_000}
    # a text of one word has P(word | start) P(end | word); the empty one P(end | start)
    assert 0 < sum(10 ** score[i] for i in range(len(vocabulary))) <= 1.0 + 1e-9


def test_exchange_finds_the_classes():
    rng, kinds = np.random.default_rng(1), np.array([0] + [1] * 20 + [2] * 20 + [3] * 20)
    pairs = np.zeros((61, 61))
    at = 0
    for _ in range(60_000):
        kind = kinds[at] % 3 + 1
        new = 20 * (kind - 1) + 1 + int(rng.integers(20))
        pairs[at, new] += 1
        at = new
    label = language_model.exchange(pairs, 4)
    for k in (1, 2, 3):
        assert len(set(label[kinds == k])) == 1
    assert len(set(label[1:])) == 3


def test_no_rows(spark):
    assert language_model.scored(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_beyond_the_fixed_symbols_find_their_classes(spark, monkeypatch):
    """Nouns and verbs that share their last bytes: only words with classes of their own can tell them apart."""
    rng = random.Random(5)
    nouns, verbs = [f"n{i}same" for i in range(30)], [f"v{i}same" for i in range(30)]
    rows = [(i, " ".join(w for _ in range(12) for w in (rng.choice(("the", "a")), rng.choice(nouns), rng.choice(verbs)))) for i in range(300)]
    for name, value in (("OWN", 12), ("GROUPS", 3)):
        monkeypatch.setattr(language_model, name, value)
    got = language_model.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(got, rows)
    # where classes are known, words cost log10 2, log10 30 and log10 30: 1.06 a token
    assert -sum(r.score for r in got) / sum(r.n_tokens for r in got) < 1.15


def test_neighbours_by_class_are_counted():
    rng = np.random.default_rng(3)
    label, classes = rng.integers(0, 4, 20_000).astype(np.uint8), 4
    runs = [np.concatenate([rng.integers(0, 20_000, 3000), np.full(700, 9), [0]]) for _ in range(2)]
    want = Counter()
    for s in runs:
        for a, b in zip(s[:-1], s[1:], strict=True):
            want[int(b), int(label[a])] += 1
            want[int(a), 4 + int(label[b])] += 1
    got = Counter()
    for batch in language_model.neighbour_classes([s.astype(np.int32) for s in runs], label, classes):
        for bucket, keys, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for k, n in zip(np.frombuffer(keys, np.uint16), np.frombuffer(times, np.uint8), strict=True):
                got[bucket * 8192 + int(k) // 8, int(k) % 8] += int(n)
    assert got == want

"""Quality rules: base statistics against brute force, the forest on planted anomalies."""

import random
import re

import numpy as np
import pytest

from gridloom.llm import quality

from .helpers import WORDS, prose

SPACE = re.compile(r"[\x20\x09-\x0d]+")


def slow(text):
    text = text or ""
    words = [w for w in SPACE.split(text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if SPACE.sub("", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def texts():
    rng, out = random.Random(1), [None, "", "\n \n", "a", "a\na\n a\na", "é\x0bü\x0c漢字 x", "w " * 8, "w " * 9, "one two three four five six seven eight " * 2, "#*$%&|<> x"]
    for k in range(40):
        lines = [prose(rng.randint(1, 12), rng.randint(0, 12)) for _ in range(rng.randint(1, 12))]
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("text", texts())
def test_base_statistics(text):
    assert quality.statistics((text or "").encode())[:5] == slow(text)


def corpus(n=900):
    rng, docs, labels = random.Random(2), [], []
    for i in range(n):
        words = prose(rng.randint(40, 300), 500 + i).split()
        bad = i % 5 == 0
        if bad:
            words = [w.upper() + rng.choice(["###", "$$$", "!!!"]) if rng.random() < 0.7 else "9" * rng.randint(3, 9) for w in words]
        else:
            words = [w + ("." if rng.random() < 0.1 else "") for w in words]
        docs.append((i, " ".join(words), "clash", 0.5))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    return docs, labels


def test_forest_tells_planted_anomalies_apart(spark):
    docs, labels = corpus()
    docs += [(2000, None, "c", 0.0), (2001, "", "c", 0.0), (2002, prose(30_000, 3), "c", 0.0), (2003, "too few words", "c", 0.0), (2004, "the same eight words are here once more " * 9, "c", 0.0), (None, prose(100, 4), "c", 0.0), (1, docs[1][1], "c", 0.0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string, anomaly double")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(frame, marks).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    unseen = [i for i in range(900) if i % 3 == 0]
    assert np.mean([not by[i].kept for i in unseen if i % 5 == 0]) > 0.9
    assert np.mean([by[i].kept for i in unseen if i % 5]) > 0.95
    for i in (2000, 2001, 2003, 2004):
        assert by[i].base_failed and not by[i].kept
    kept = quality.kept(frame, marks)
    assert kept.columns == ["doc_id", "text", "source", "anomaly"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((r[0], r[1]) for r in docs if by[r[0]].kept), key=str)


def test_without_labels_the_base_rules_decide(spark):
    frame = spark.createDataFrame([(1, prose(50, 1)), (2, "few"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.doc_id, r.kept) for r in quality.scored(frame, none).collect()} == {(1, True), (2, False), (3, False)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.scored(empty, none).collect() == []
    assert quality.kept(empty, none).collect() == []


def test_calibration_takes_the_gap():
    score = np.array([0.3, 0.31, 0.32, 0.6, 0.7])
    good = np.array([True, True, True, False, False])
    assert 0.32 < quality.calibrate(score, good, 1.0) < 0.6
    assert quality.calibrate(score[:3], good[:3], 1.0) == 0.32


def test_threshold_is_the_calibration_of_all_rows(spark):
    rng = np.random.default_rng(3)
    for n, digits, share in ((400, 9, 0.2), (400, 2, 0.5), (30, 1, 0.9), (5, 9, 0.0), (2, 9, 0.5)):
        good = rng.random(n) >= share
        good[0] = True
        score = np.round(np.where(good, rng.beta(6, 8, n), rng.beta(8, 6, n)), digits)
        frame = spark.createDataFrame([(bool(g), float(x)) for g, x in zip(good, score, strict=True)], "good boolean, anomaly double")
        for keep in (0.5, 0.98, 1.0):
            assert quality.threshold(frame, keep) == quality.calibrate(score, good, keep)


def test_every_labelled_row_counts(spark):
    """Without bad labels all good rows stay, also the few odd ones of 24,000, whatever the hashes of their ids."""
    words = "transform(sequence(1, 20 + id % 30), i -> substr(md5(concat(id, '-', i)), 1, 1 + (id * i) % 7))"
    odd = "id % 40 = 0 and pmod(xxhash64(id), 1 << 30) > 0.9 * (1 << 30)"
    text = f"if({odd}, array_join(transform({words}, x -> concat(x, md5(x), '. 99!')), '\n'), array_join({words}, ' '))"
    rows = spark.range(24_000).selectExpr("id doc_id", f"{text} text", "1 quality", f"{odd} odd")
    got = quality.scored(rows.select("doc_id", "text"), rows.select("doc_id", "quality")).where("not base_failed").join(rows.select("doc_id", "odd"), "doc_id").toPandas()
    assert len(got) > 23_000 and got["odd"].sum() > 20
    assert got["kept"].all()


def test_path_lengths_by_plain_recursion():
    """The anomaly of a row is what walking each tree, node by node, gives."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    trees = quality.grow(x, np.array([x.min(axis=0), x.max(axis=0)]), 25, 64, 3)

    def depth(tree, row, node=0):
        feature, split, left, right, path = tree
        return path[node] if feature[node] < 0 else depth(tree, row, left[node] if row[feature[node]] < split[node] else right[node])

    def leaves(tree, node=0, d=0):
        feature, _, left, right, path = tree
        return [(d, path[node])] if feature[node] < 0 else leaves(tree, left[node], d + 1) + leaves(tree, right[node], d + 1)

    expected = 2 * (np.log(63) + np.euler_gamma) - 2 * 63 / 64
    probe = np.vstack([x[:20], [[9.0] * 4]])
    want = [2 ** (-np.mean([depth(t, r) for t in trees]) / expected) for r in probe]
    got = quality.anomaly(probe, trees, 64)
    assert np.allclose(got, want) and got[-1] > got[:-1].max()
    assert all(p >= d for t in trees for d, p in leaves(t))


def test_words_are_letters_of_the_helpers():
    assert len(set(WORDS)) > 90

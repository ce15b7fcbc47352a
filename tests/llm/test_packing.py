"""Packing: against a plain best-fit search, and what every packing holds."""

import random
from collections import Counter, defaultdict

from gridloom.llm import packing

from .helpers import prose


def plain(length, source, cluster, capacity, per_source):
    bins, out = [], []
    for n, s, c in zip(length, source, cluster, strict=True):
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= n and b["s"][s] < per_source and (c < 0 or c not in b["c"])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": Counter(), "c": set()})
        bins[k]["room"] -= n
        bins[k]["s"][s] += 1
        if c >= 0:
            bins[k]["c"].add(c)
        out.append(k)
    return out


def test_as_by_plain_search():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 120)
        length = sorted((rng.randint(1, 50) for _ in range(n)), reverse=True)
        source = [rng.randint(0, 4) for _ in range(n)]
        cluster = [rng.choice([-1, -1, 0, 1, 2, 3]) for _ in range(n)]
        args = length, source, cluster, 60, rng.randint(1, 4)
        assert packing.pack(*args) == plain(*args)


def test_whole_texts_and_constraints(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "a", "b", "c", None]), prose(rng.randint(0, 80), i % 90), "x", 1) for i in range(400)]
    rows += [(900, "a", None, "x", 1), (901, "a", "", "x", 1), (902, "a", prose(1000, 7), "x", 1), (903, "b", prose(1000, 7).upper(), "x", 1), (5, rows[5][1], rows[5][2], "x", 1), (None, "a", "words of nobody", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, bin string, n int").repartition(7)
    got = packing.packed(frame, capacity=100, per_source=3, shard=100).collect()
    size = lambda t: len((t or "").split()) + 1
    want = Counter()
    for i, _, t, *_rest in rows:
        want[i] += size(t)
    held = Counter()
    for r in got:
        held[r.doc_id] += r.length
    assert held == want
    of = {i: (s, (t or "").lower().split()) for i, s, t, *_rest in rows}
    bins = defaultdict(list)
    for r in got:
        bins[r.shard, r.bin].append(r)
    for members in bins.values():
        assert sum(r.length for r in members) <= 100
        assert max(Counter(of[r.doc_id][0] for r in members).values()) <= 3
        texts = Counter(" ".join(of[r.doc_id][1]) for r in members if of[r.doc_id][1])
        assert not texts or max(texts.values()) == 1
    pieces = sorted((r.start, r.length) for r in got if r.doc_id == 902)
    assert pieces == [(s, min(100, 1001 - s)) for s in range(0, 1001, 100)]
    again = packing.packed(frame.repartition(3), capacity=100, per_source=3, shard=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_clusters_of_a_column_and_no_rows(spark):
    frame = spark.createDataFrame([(i, "s", f"text {i}", "same" if i < 5 else None) for i in range(10)], "doc_id long, source string, text string, group_no string")
    got = packing.packed(frame, per_source=20, cluster="group_no").collect()
    together = Counter((r.shard, r.bin) for r in got if r.doc_id < 5)
    assert max(together.values()) == 1
    assert packing.packed(frame.limit(0)).collect() == []

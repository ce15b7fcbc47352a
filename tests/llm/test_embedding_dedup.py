"""Embedding near-duplicates against all pairs in double precision."""

import numpy as np

from gridloom.llm import embedding_dedup

from .helpers import roots


def brute(rows, cosine=0.98):
    def usable(r):
        i, v, label = r
        return i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [r for r in rows if usable(r)]
    n, links = {}, []
    for i, (a, u, k) in enumerate(good):
        for b, v, l in good[:i]:
            if k == l and len(u) == len(v):
                u64, v64 = np.asarray(u, np.float64), np.asarray(v, np.float64)
                if u64 @ v64 / np.sqrt((u64 @ u64) * (v64 @ v64)) >= cosine:
                    links.append((a, b))
                    n[a], n[b] = n.get(a, 0) + 1, n.get(b, 0) + 1
    ids = [r[0] for r in rows if r[0] is not None]
    root = roots(ids, links)
    return {(i, n.get(i, 0), root[i], root[i] == i) for i in ids}


def data(seed, dims=64, groups=30):
    rng, rows, k = np.random.default_rng(seed), [], 100
    for g in range(groups):
        centre = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 12))):
            v = centre + rng.normal(size=dims) * rng.choice([0.0, 0.02, 0.05, 0.08])
            rows.append((k, [float(np.float32(x)) for x in v * rng.choice([1.0, 1e-3, 50.0])], int(g % 3)))
            k += 1
    return rows


def test_as_by_brute_force(spark):
    rows = data(1)
    same = rows[0][1]
    rows += [(1, same, 0), (2, same, 0), (3, same, 1), (4, same, None), (5, None, 0), (6, [], 0), (7, [0.0] * 64, 0), (8, [float("nan")] * 64, 0), (9, [float("inf")] + [1.0] * 63, 0), (10, [None] + [1.0] * 63, 0), (11, [1.0, 2.0, 3.0], 0), (12, [1.0, 2.0, 3.01], 0), (13, [2.0], 0), (14, [-2.0], 0), (15, [3.0], 0)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, rep string, n int")
    exact = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]
    want = brute(exact)
    for block in (1024, 4):
        got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame, block=block).collect()}
        assert got == want


def test_recall_on_pairs_at_the_bound(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        u = rng.normal(size=64)
        w = rng.normal(size=64)
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        w /= np.linalg.norm(w)
        c = rng.uniform(0.9801, 0.999)
        rows += [(2 * k, u.tolist(), 0), (2 * k + 1, (c * u + np.sqrt(1 - c * c) * w).tolist(), 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = embedding_dedup.near_duplicates(frame).where("n_links = 1").count()
    assert found >= 0.99 * 800


def test_recall_on_the_table_with_perturbed_copies(spark):
    """The given vectors and for each a copy turned by up to the bound's angle: links against brute force."""
    rng = np.random.default_rng(11)
    rows = [(r.vec_id, np.asarray(r.embedding, np.float64), r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect() if r.embedding is not None and r.label is not None]
    out = []
    for i, v, label in rows:
        w = rng.normal(size=len(v))
        w -= (w @ v) / (v @ v) * v
        c = rng.uniform(0.9801, 0.9999)
        out += [(i, v.tolist(), label), (i + 1_000_000, (c * v + np.sqrt(1 - c * c) * np.linalg.norm(v) / np.linalg.norm(w) * w).tolist(), label)]
    want = {(i, n) for i, n, _, _ in brute(out) if n}
    frame = spark.createDataFrame(out, "vec_id long, embedding array<double>, label int")
    got = {(r.vec_id, r.n_links) for r in embedding_dedup.near_duplicates(frame).collect() if r.n_links}
    assert len(want) >= 2 * len(rows) * 0.99 and {i for i, _ in got} <= {i for i, _ in want}
    assert len(got & want) >= 0.99 * len(want)


def test_repeated_rows_null_ids_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [0.0, 1.0], 0)]
    got = sorted((tuple(r) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True), (2, 0, 2, True)], key=str)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).collect() == []

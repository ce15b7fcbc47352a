"""SimHash: fingerprints and classes against brute force."""

import random

import xxhash

from gridloom.llm import simhash

from .helpers import WORDS, prose, roots


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(texts):
    fps = [slow_fingerprint(t) for t in texts]
    return fps, [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4]


def corpus():
    rng, out = random.Random(1), [None, "", " \n\t", "one", "one two three", "Ünï Cödé ÀB", "A B C D", "a b c d", "x\x0by\x0cz w v"]
    for k in range(60):
        words = prose(rng.randint(3, 400), k).split()
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            out.append(" ".join(copy))
    out += [prose(30_000, 5)] * 3 + ["same text here again and again"] * 70
    return out


def test_classes_as_by_brute_force(spark):
    texts = corpus()
    ids = [7 * i + 3 for i in range(len(texts))]
    random.Random(2).shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(ids), range(len(ids)))), "doc_id long, text string, fp string, root int")
    fps, links = near(texts)
    want = roots(ids, [(ids[a], ids[b]) for a, b in links])
    for block in (simhash.BLOCK, 16):
        simhash_block, simhash.BLOCK = simhash.BLOCK, block
        try:
            got = simhash.near_duplicates(docs).collect()
        finally:
            simhash.BLOCK = simhash_block
        assert len(got) == len(texts)
        assert {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in got} == {i: (f, want[i]) for i, f in zip(ids, fps, strict=True)}


def test_blocks_lose_no_link(spark):
    rng = random.Random(4)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centre for _ in range(120)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = roots(signed, [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4])
    for block in (8, 1024):
        found = {(r.u, r.v) for r in simhash.links(frame, block=block).collect()}
        assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 64 for a, b in found)
        assert roots(signed, found) == want


def pairs_at_one_bit(n, seed):
    rng = random.Random(seed)
    centre = [rng.getrandbits(63) for _ in range(n)]
    return centre + [c ^ 1 << rng.randrange(63) for c in centre]


def test_no_side_of_the_entries_goes_to_the_driver(spark):
    """The planner takes the entries for as few as the fingerprints, which are 66 times fewer, and would broadcast them."""
    written = simhash.cut(spark.createDataFrame([(f,) for f in pairs_at_one_bit(20, 6)], "fp long"))
    plan = simhash.links(written)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_representatives_repeated_rows_and_null_ids(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "A b c d e f", "t"), (None, "lonely text with some words", "u"), (None, "a b c d e f", "v"), (5, None, "w"), (6, "", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc string")
    got = sorted(map(tuple, simhash.representatives(docs).collect()), key=str)
    assert got == sorted([(1, "a b c d e f", "s"), (None, "lonely text with some words", "u"), (5, None, "w")], key=str)
    ids = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert ids == {(1, 1), (2, 1), (None, 1), (None, None), (5, 5), (6, 5)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.representatives(docs).collect() == []

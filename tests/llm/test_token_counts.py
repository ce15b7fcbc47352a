"""Token counts against greedy longest match by slicing."""

import random

from gridloom.llm import token_counts

from .helpers import prose


def greedy(text, known, longest):
    n = at = 0
    while at < len(text):
        size = next((k for k in range(min(longest, len(text) - at), 1, -1) if text[at : at + k] in known), 1)
        at, n = at + size, n + 1
    return n


def test_automaton_as_by_slicing():
    rng = random.Random(1)
    for _ in range(40):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 30))}
        automaton = token_counts.Automaton(pieces)
        for _ in range(60):
            text = bytes(rng.choices(b"abcd", k=rng.randint(0, 40)))
            assert automaton.length(text) == greedy(text, pieces, 6)


def test_public_vocabulary(spark):
    pieces = token_counts.vocabulary(token_counts.VOCABULARY)
    known, longest = set(pieces), max(map(len, pieces))
    texts = [None, "", "  \n ", "hello world", "naïve Größe 漢字 \U0001f600  x", "x" * 5000, prose(20_000, 2), "tie tie tie"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "hello world", 2), (None, "hello", 3)], "doc_id long, text string, n_words int")
    got = sorted((tuple(r) for r in token_counts.counted(docs, pieces).collect()), key=str)
    want = []
    for i, t in [*enumerate(texts), (3, "hello world"), (None, "hello")]:
        words = (t or "").encode().split()
        want.append((i, len(words), sum(greedy(b" " + w, known, longest) for w in words)))
    assert got == sorted(want, key=str)


def test_no_rows(spark):
    assert token_counts.counted(spark.createDataFrame([], "doc_id long, text string"), [b"ab"]).collect() == []

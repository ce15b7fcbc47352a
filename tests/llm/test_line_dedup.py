"""Line dedup against brute force over all pairs of lines."""

import random
import re
import time

import pytest

from gridloom.llm import line_dedup

from .helpers import WORDS, prose


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = [], {}
    for i, text in order:
        if text is None:
            out[i] = None
            continue
        left = []
        for line in text.split("\n"):
            if not re.search(r"[^\x20\x09-\x0d]", line):
                left.append(line)
                continue
            if not any(line == s or (min(len(line), len(s)) >= least and distance_one(line, s)) for s in seen):
                left.append(line)
            seen.append(line)
        out[i] = "\n".join(left)
    return out


def corpus():
    rng = random.Random(3)
    base = [prose(rng.randint(1, 12), 1000 + k) for k in range(60)]
    rows = [(0, None), (1, ""), (2, "\n\n  \n"), (3, "short"), (4, "short\nshorts\na\nb\nab\nabc\nxy"), (201, "b\nax\nabcd\nabyd\nzz z\nzz"), (5, "é" * 30 + "\n" + "é" * 29 + "\n" + "é" * 31), (6, "a" * 20), (7, "a" * 19), (8, "\U0001f600" * 25), (9, "\U0001f600" * 24 + "\U0001f601")]
    for i in range(10, 120):
        lines = []
        for _ in range(rng.randint(1, 8)):
            line = rng.choice(base)
            kind = rng.random()
            if kind < 0.5 and line:
                at = rng.randrange(len(line))
                line = rng.choice([line[:at] + line[at + 1 :], line[:at] + "z" + line[at:], line[:at] + "q" + line[at + 1 :], line[:at] + "qq" + line[at + 1 :]])
            lines.append(line)
        rows.append((i, "\n".join(lines)))
    rows.append((None, base[0] + "\nno other document has this line at all"))
    rows.append((200, "\n".join([prose(20_000, 8), "the end of a long document " + rng.choice(WORDS)])))
    return rows


def test_as_by_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, id string, line int").repartition(5)
    want = brute(rows, line_dedup.NEAR_CHARS)
    got = line_dedup.deduplicated(frame)
    assert got.columns == ["doc_id", "text", "id", "line"]
    assert {r.doc_id: r.text for r in got.collect()} == want


@pytest.mark.parametrize("least", [1, 3, 20])
def test_other_least_lengths(spark, least):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(frame, near_chars=least).collect()} == brute(rows, least)


def test_a_document_of_many_lines_takes_linear_time(spark):
    """150,000 lines, equal ones and others; a search in a list for each line would take minutes."""
    frame = spark.createDataFrame([(1, "\n".join(["the same line again"] * 100_000 + [f"{i:06d} own line {i * 7919:010d}" for i in range(0, 500_000, 10)]))], "doc_id long, text string")
    began = time.monotonic()
    text = line_dedup.deduplicated(frame).collect()[0].text
    assert time.monotonic() - began < 60
    assert text.count("the same line again") == 1 and text.split("\n")[1] == "000000 own line 0000000000"


def test_a_full_filter_gives_the_same(spark, monkeypatch):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "FILTER_BITS", 1)
    assert {r.doc_id: r.text for r in line_dedup.deduplicated(frame).collect()} == brute(rows, line_dedup.NEAR_CHARS)


def test_repeated_rows_and_no_rows(spark):
    frame = spark.createDataFrame([(1, "one line here\nanother"), (1, "one line here\nanother"), (2, "another\nnew")], "doc_id long, text string")
    assert sorted(tuple(r) for r in line_dedup.deduplicated(frame).collect()) == [(1, "one line here\nanother"), (1, "one line here\nanother"), (2, "new")]
    assert line_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []

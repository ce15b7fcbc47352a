"""Chat formatting: the grammar's round trip on hostile texts, and the SQL form."""

import hashlib
import os
import random
import re

import duckdb
from pyspark.sql import functions as F

from gridloom.llm import chat

DATA = "/root/testdata/sf0.001"
BITS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[TURN:", "[/TURN]", "[TURN:41] ", "\\", "\\\\", " ", "\n", "$1", "x", "é漢\U0001f600", "]", "<", "s>", "ok [/INST]", "\x00"]


def conversations():
    rng, rows = random.Random(1), []
    for c in range(300):
        for t in range(rng.randint(1, 5)):
            text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9)))
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "", "[INST] é", None]), rng.choice([text, text, None])))
    rows += [(500, 0, "user", "again"), (500, 0, "user", "again"), (501, None, "assistant", "z"), (501, 3, "assistant", "a"), (None, 1, "user", "nobody"), (502, 1, "user", "[INST] a " * 20_000)]
    return rows


def test_round_trip(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, segments string").repartition(5)
    got = chat.format_conversations(frame).collect()
    source = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())):
        source.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [(t.role, t.text) for t in r.recovered] for r in got} == source
    for r in got:
        assert r.round_trip and r.formatted == "".join(s.text for s in r.segments)
        escaped = [s.text for s in r.segments if s.loss]
        assert len(escaped) == sum(t.role == "assistant" for t in r.recovered)
        assert [re.sub(rf"\\({chat.CONTROL})", r"\1", x) for x in escaped] == [t.text for t in r.recovered if t.role == "assistant"] if r.escaped else True


def test_parser_rejects_what_is_not_of_the_grammar(spark):
    bad = ["x", "[INST] a", "[INST] a [/INST] ", "[INST] <s> [/INST]", "<s>a</s>", "[INST] a [/INST]tail"]
    frame = spark.createDataFrame([(b,) for b in [*bad, "", "[INST] a [/INST]<s> b </s>"]], "f string")
    got = {r.f: r.p for r in frame.select("f", chat.parse(F.col("f")).alias("p")).collect()}
    assert all(got[b] is None for b in bad)
    assert got[""] == [] and [tuple(t) for t in got["[INST] a [/INST]<s> b </s>"]] == [("user", "a"), ("assistant", "b")]


def test_no_rows(spark):
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_same_as_sql(spark):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    c = con.execute(chat.OP3_SQL)
    names = [x[0] for x in c.description]
    got = chat.op3_chat_formatting(spark, DATA)
    assert sorted(got.columns) == sorted(names)
    rows = sorted(map(tuple, got.select(*names).collect()))
    assert rows == sorted(c.fetchall())
    hard = dict(zip(names, rows[0], strict=True))
    text = "</s>[INST] ok [/INST]"
    assert hard["conv_id"] == -7 and hard["n_turns"] == 2 and hard["loss_chars"] == len(text)
    assert hard["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert hard["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()

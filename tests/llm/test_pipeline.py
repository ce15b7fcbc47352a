"""The pipeline: each stage on what the one before kept, against the brute-force forms of the other tests."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import line_dedup, mixing, packing, quality, simhash

from .helpers import prose, roots, table
from .test_line_dedup import brute as slow_lines
from .test_mixing import inverse
from .test_quality import slow as slow_statistics
from .test_simhash import near

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, docs, labels = random.Random(7), [], []
    for i in range(260):
        source = rng.choice(["hot", "hot", "hot", "web", "books", None])
        lines = [prose(rng.randint(8, 30), 10_000 + 50 * i + k) for k in range(rng.randint(3, 7))]
        if i % 4 == 0:
            lines.insert(1, "this licence line is in many of the documents " + ("here" if i % 8 else "hers"))
        text, bad = "\n".join(lines), i % 9 == 0
        if bad:
            text = " ".join(w.upper() + "###" for w in text.split())
        elif i % 10 == 3 and docs:
            text = docs[-1][1]
        docs.append((i, text, "en", source, 0 if text is None else len(text)))
        labels.append((i, 0 if bad else 1, 0))
    docs += [(900, None, "en", "web", 0), (901, "", None, None, 0), (902, prose(5000, 3), "en", "hot", 1), (3, docs[3][1], "en", docs[3][3], docs[3][4])]
    path = str(tmp_path_factory.mktemp("sf"))
    table(path, "documents", spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5))
    table(path, "labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return path


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(([tuple(r) for r in docs.select(*COLUMNS).collect()], after.columns, [tuple(r) for r in after.collect()]))
        docs = after
    assert all(columns == COLUMNS for _, columns, _ in seen[:-1])
    (before, _, ruled), (_, _, lined), (simmed_in, _, simmed), (_, _, mixed), (packed_in, columns, packed) = seen

    # quality: nothing that the base rules reject stays, no clean document goes, all planted junk goes
    texts = {r[1] for r in ruled}
    for i, text, *_ in before:
        n, _, _, _, repeat = slow_statistics(text)
        junk = n < 20 or 100 * repeat > 30 * n or "###" in text
        if i != 902:  # a text unlike all labelled ones may go either way
            assert (text in texts) is not junk, i
    # lines: the brute force, n_chars with it
    want = slow_lines(sorted({r[:2] for r in ruled}), line_dedup.NEAR_CHARS)
    assert sorted((r[0], r[1], r[4]) for r in lined) == sorted((r[0], want[r[0]], len(want[r[0]])) for r in ruled)
    assert Counter(w for r in lined for w in r[1].split("\n") if "licence" in w).total() == 1
    # SimHash: one row of each group, with the smallest id
    ids = sorted({r[0] for r in simmed_in})
    by = {r[0]: r[1] for r in simmed_in}
    _, links = near([by[i] for i in ids])
    root = roots(ids, [(ids[a], ids[b]) for a, b in links])
    assert sorted(simmed) == sorted({r for r in simmed_in if root[r[0]] == r[0]})
    # mixing: copies by the Poisson inverse at a hash of seed and id
    n = Counter(r[3] for r in simmed)
    power = {s: c**mixing.TEMPERATURE for s, c in n.items()}
    draws = {}
    for r in simmed:
        u = int(hashlib.md5(f"{mixing.SEED}|{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        draws[r[0]] = inverse(u, power[r[3]] / math.fsum(power.values()) * len(simmed) / n[r[3]])
    assert Counter(r[0] for r in mixed) == +Counter(draws)
    # packing: every word of every document once, within the bins' room
    assert columns == ["shard", "bin", "doc_id", "copy_no", "start", "length"]
    held, size = Counter(), Counter()
    for shard, number, i, copy, _, length in packed:
        held[i] += length
        size[shard, number] += length
    whole = Counter()
    for r in packed_in:
        whole[r[0]] += len(r[1].split()) + 1
    assert held == whole and max(size.values()) <= packing.CAPACITY


def test_run_is_the_stages_in_turn(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert sorted(map(tuple, got)) == sorted(map(tuple, docs.collect()))


def test_simhash_stage_sends_no_large_table_to_the_driver(spark, monkeypatch):
    """3,000 pairs one bit apart share over 100,000 table entries, more than the driver takes here."""
    fp = F.xxhash64(F.expr("doc_id div 2")).bitwiseXOR(F.col("doc_id") % 2)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.withColumn("fp", fp).drop("text"))
    docs = spark.range(6000).selectExpr("id doc_id", "string(id) text", "'en' lang", "'web' source", "id n_chars")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "3m")
    try:
        stage = corpus_pipeline.simhash_dedup(spark, docs, "")  # links and components are written here
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted(r.doc_id for r in stage.collect()) == list(range(0, 6000, 2))


def test_simhash_stage_joins_documents_without_the_driver(spark, monkeypatch):
    """40,000 fingerprints, or the rows that stay, are small files but more than the driver takes here."""
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs.withColumn("fp", F.xxhash64("doc_id")).drop("text"))
    docs = spark.range(40_000).selectExpr("id doc_id", "string(id) text", "'en' lang", "'web' source", "id n_chars")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "3m")
    try:
        stage = corpus_pipeline.simhash_dedup(spark, docs, "").collect()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert sorted(r.doc_id for r in stage) == list(range(40_000))


def test_empty_documents(spark, sf_dir, tmp_path):
    path = str(tmp_path)
    table(path, "documents", spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0))
    table(path, "labels", spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert corpus_pipeline.run(spark, path).collect() == []


def test_quality_is_the_operator(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    verdict = {r.doc_id: r.kept for r in quality.scored(read("documents"), read("labels")).collect()}
    kept = quality.kept(read("documents"), read("labels")).collect()
    assert {r.doc_id for r in kept} == {i for i, k in verdict.items() if k}

"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, mixing, packing.

A stage takes (spark, docs, sf_dir); each is written as Parquet and reread before the next.  All stages but the
last return the columns of documents, in COLUMNS, and no others that docs may have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import line_dedup, mixing, packing, quality, simhash
from gridloom.llm.common import cut, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those that the rules or the isolation forest reject."""
    return quality.kept(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the lines that earlier ones equal or near; n_chars follows the text."""
    done = line_dedup.deduplicated(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id, of its repeated rows one."""
    return simhash.representatives(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as drawn, in shuffled order."""
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins' pieces."""
    return packing.packed(docs.select(*COLUMNS))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", simhash_dedup),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_best_fit),
]

#: Fingerprints, isolation trees and bins can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

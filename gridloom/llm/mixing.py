"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the whole over its own share.  A document's number of copies is the
inverse of the Poisson distribution with that mean at a number in [0, 1) hashed from the seed and the document,
so a recomputed task gives the same copies.  Copies are exploded, and another hash deals them to partitions and orders them there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

TEMPERATURE, SEED, SOURCES = 0.5, 11, 10_000
#: A draw's distribution is tabled so far; beyond lies less than 2 ** -53 for means up to LARGEST.  A larger rate is cut
#: into equal means of at most LARGEST, whose independent draws are added: their sum is Poisson at every rate.
STEPS, LARGEST = 160, 64.0


def hashed(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from MD5 of the parts that aren't null."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def distribution(rate: Column) -> Column:
    """struct<draws, cdf>: the number of draws, and P(at most k) of each for k = 0, 1, ... below 1."""
    draws = F.greatest(F.ceil(rate / F.lit(LARGEST)), F.lit(1)).cast("int")
    mean = rate / draws
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    step = lambda s, k: F.struct((s.p * mean / k).alias("p"), F.concat(s.c, F.array(F.element_at(s.c, -1) + s.p * mean / k)).alias("c"))
    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, step, lambda s: F.filter(s.c, lambda x: x < 1))
    return F.struct(draws.alias("draws"), cdf.alias("cdf"))


def drawn(seed: int, key: Column, d: Column) -> Column:
    """The sum over draws of the distribution's inverse: the number of k with P(at most k) <= a number hashed from seed, key and, after the first, draw.

    That number is bound to a variable, as else its hash would be computed for each k.
    """
    inverse = lambda j: F.element_at(F.transform(F.array(hashed(F.lit(seed), key, F.when(j > 0, j))), lambda v: F.size(F.filter(d.cdf, lambda c: v >= c))), 1)
    return F.aggregate(F.sequence(F.lit(0), d.draws - 1), F.lit(0), lambda n, j: n + inverse(j))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, rate): copies expected of a document.  Weights are shares of documents, scaled to sum to 1.

    Without weights a source's target is its share to the power `temperature`, scaled.  A null source is one
    source, named by null.  Sources that weights do not name get the rate 0, those without documents none.
    """
    sizes = docs.groupBy("source").agg(F.count("*").cast("double").alias("n"))
    if weights is None:
        sized = sizes.withColumn("w", F.pow("n", F.lit(temperature)))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "name string, w double")
        sized = sizes.join(named, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n", F.coalesce("w", F.lit(0.0)).alias("w"))
    all_n, all_w = sized.agg(F.sum("n"), F.sum("w")).first()
    rate = F.col("w") / F.lit(all_w) * F.lit(all_n) / F.col("n") if all_w else F.lit(0.0)
    return sized.select("source", rate.alias("rate"))


def mixed(
    docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs' columns and copy_no (int), each row as often as drawn, dealt to partitions and ordered in them by a hash: a global shuffle.

    A row's draw depends on the seed and its id alone, or its text where the id is null, so repeated rows are
    drawn alike.  A column of docs that is named copy_no already comes out with underscores after its name.  The
    table of rates goes to all workers if it has at most SOURCES rows; a larger one is joined by shuffles.  An
    empty table gives no rows.
    """
    table = rates(docs.select("source"), weights, temperature).select(F.col("source").alias("mix_source"), distribution(F.col("rate")).alias("mix"))
    small = table.limit(SOURCES + 1).count() <= SOURCES
    names, taken = [], {c.lower() for c in docs.columns} | {"copy_no"}
    for c in docs.columns:
        name = c
        while name.lower() == "copy_no" or name != c and name.lower() in taken:
            name += "_"
        names.append(name)
    boxed = docs.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("doc"))
    met = boxed.join(F.broadcast(table) if small else table, F.col("doc.source").eqNullSafe(F.col("mix_source")))
    text = F.coalesce(F.col(f"doc.`{text_col}`"), F.lit("")) if text_col in docs.columns else F.lit("")
    key = F.coalesce(F.col(f"doc.`{id_col}`").cast("string"), F.concat(F.lit("null|"), F.md5(text.cast("binary"))))
    counted = met.select("doc", key.alias("key"), "mix").select("doc", "key", drawn(seed, F.col("key"), F.col("mix")).alias("n")).where("n > 0")
    copies = counted.select("doc", "key", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy_no"))
    keyed = copies.select("doc", "copy_no", F.xxhash64(F.lit(seed), "key", "copy_no").alias("mix_key"))
    return keyed.repartition("mix_key").sortWithinPartitions("mix_key").select("doc.*", "copy_no")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents")).withColumn("copy_no", F.col("copy_no").cast("long"))


OP6_SQL = """
WITH n AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
r AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM n),
d AS (SELECT row_number() OVER () AS rid, d.*, greatest(ceil(rate / 64), 1)::BIGINT AS draws, rate / greatest(ceil(rate / 64), 1) AS mean,
        coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, ''))) AS key
      FROM documents d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
u AS (SELECT rid, mean, ('0x' || substr(md5('11|' || key || CASE WHEN j > 0 THEN '|' || j ELSE '' END), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM (SELECT rid, mean, key, unnest(range(draws)) AS j FROM d)),
t AS (SELECT rid, sum(list_reduce(list_prepend({'p': exp(-mean), 'c': exp(-mean), 'k': 0::DOUBLE, 'm': 0::DOUBLE},
        [{'p': 0::DOUBLE, 'c': 0::DOUBLE, 'k': i::DOUBLE, 'm': 0::DOUBLE} FOR i IN range(1, 161)]),
        lambda s, x: {'p': s.p * mean / x.k, 'c': s.c + s.p * mean / x.k, 'k': x.k, 'm': s.m + CASE WHEN u >= s.c THEN 1 ELSE 0 END}).m)::BIGINT AS times
      FROM u GROUP BY rid)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, times + 1)) AS copy_no FROM d JOIN t USING (rid) WHERE times > 0
"""

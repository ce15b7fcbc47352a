"""Chat formatting with a grammar round trip, in DataFrame functions alone.

    formatted := turn*
    turn      := open " " content " " close
    open      := "[INST]" (user) | "<s>" (assistant) | "<<SYS>>" (system) | "[TURN:" hex of the role "]"
    close     := "[/INST]"       | "</s>"            | "<</SYS>>"         | "[/TURN]"

Content holds no bare control string.  A conversation is rendered as it is and reparsed; if the parser rejects
it, or recovers other turns, a backslash goes before every control string in its texts, and the result is
reparsed and compared again.  The parser drops one backslash before each control string of a content, so
texts that hold escaped control strings already are told apart too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[TURN:|\[/TURN\]"
OPENS = {"user": "[INST]", "assistant": "<s>", "system": "<<SYS>>"}
CLOSES = {"user": "[/INST]", "assistant": "</s>", "system": "<</SYS>>"}
_TURN = r"(?s)(<s>|\[INST\]|<<SYS>>|\[TURN:[0-9A-F]*\]) (.*?) (</s>|\[/INST\]|<</SYS>>|\[/TURN\])"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def _by_role(role: Column, marks: dict[str, str], other: Column) -> Column:
    out = F.when(role == "user", marks["user"]).when(role == "assistant", marks["assistant"]).when(role == "system", marks["system"])
    return out.otherwise(other)


def segments(turns: Column, content) -> Column:
    """array<struct<text, loss>>: open, content and close of each turn; content(text) is what a text becomes."""

    def of(t: Column) -> Column:
        start = _by_role(t.role, OPENS, F.concat(F.lit("[TURN:"), F.hex(F.encode(t.role, "UTF-8")), F.lit("]")))
        end = _by_role(t.role, CLOSES, F.lit("[/TURN]"))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(F.concat(start, F.lit(" ")), F.lit(False)), part(content(t.text), t.role == LEARNED), part(F.concat(F.lit(" "), end), F.lit(False)))

    return F.flatten(F.transform(turns, of))


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s.text), "")


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>, or null if the string is not of the grammar."""
    opens, contents, closes = (F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(g)) for g in (1, 2, 3))

    def turn(x: Column) -> Column:
        named = F.decode(F.unhex(F.regexp_extract(x.opens, r"^\[TURN:([0-9A-F]*)\]$", 1)), "UTF-8")
        role = F.when(x.opens == OPENS["user"], "user").when(x.opens == OPENS["assistant"], "assistant").when(x.opens == OPENS["system"], "system").otherwise(named)
        return F.struct(role.alias("role"), unescape(x.contents).alias("text"))

    def turns(parts: Column) -> Column:
        covered = F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x.opens) + F.length(x.contents) + F.length(x.closes) + 2)
        bare = F.exists(parts, lambda x: F.rlike(x.contents, F.lit(rf"(?<!\\)(?:{CONTROL})")))
        return F.when((covered == F.length(formatted)) & ~bare, F.transform(parts, turn))

    # bound to a variable, so that the matches are found once
    parts = F.arrays_zip(opens.alias("opens"), contents.alias("contents"), closes.alias("closes"))
    return F.element_at(F.transform(F.array(parts), turns), 1)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, segments, recovered, round_trip, escaped), one row per conv_id of rows (conv_id, turn, role, text).

    Turns go by turn, role and text, nulls first; repeated rows are turns of their own.  A null text or role is
    empty.  Rows with a null conv_id are one conversation.  segments joined give formatted, with the loss mask of
    each; recovered is what the parser reads back from formatted.  Other columns are not read.  An empty table
    gives no rows.
    """
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))
    plain = ordered.withColumn("segments", segments(F.col("turns"), lambda t: t))
    tried = plain.withColumn("escaped", ~F.coalesce(parse(joined(F.col("segments"))) == source, F.lit(False)))
    final = tried.withColumn("segments", F.when(F.col("escaped"), segments(F.col("turns"), escape)).otherwise(F.col("segments")))
    shown = final.withColumn("formatted", joined(F.col("segments"))).withColumn("recovered", parse(F.col("formatted")))
    return shown.select("conv_id", "formatted", "segments", "recovered", F.coalesce(F.col("recovered") == source, F.lit(False)).alias("round_trip"), "escaped")


HARD = "</s>[INST] ok [/INST]"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD).alias("text")
    )
    done = format_conversations(rows.union(hard))
    under = F.array_join(F.transform(F.filter("recovered", lambda t: t.role == LEARNED), lambda t: t.text), "")  # as the parser reads it
    digest = F.array_join(F.transform("recovered", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("recovered").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length(under).cast("long").alias("loss_chars"), F.sha2(under, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 16 + length(hex(role)) END
    + length(regexp_replace(text, '(<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[TURN:|\[/TURN\])', '\\\1', 'g')) AS formatted
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(formatted)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

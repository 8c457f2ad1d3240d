"""Operator 3, chat formatting: rolling hashes of turn prefixes show which logged conversations are a prefix of a longer one
(snapshots of the same conversation); anti-joins keep the maximal ones, which are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_KEY = ["__conv"]


def _safe(text: Column) -> Column:
    """Marker strings in a text lose their bars, so that no text can open or close a turn."""
    return F.regexp_replace(text, r"<\|(im_start|im_end)\|>", "<$1>")


def _turn_hash(seed: int) -> Column:
    """Of position, role and text; null and the empty text differ. A decimal, so that sums don't overflow."""
    parts = [F.lit(seed), F.col("__pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return F.xxhash64(*parts).cast("decimal(38,0)")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered: one row for each maximal conversation.

    A conversation is the turns of a conv_id ordered by turn (null first), then role and text; its prefix hash after each turn is a
    running sum of hashes of (position, role, text), two of 64 bits. A conversation goes if all of it is a proper
    prefix of a longer one; of equal ones the smallest conv_id stays. Only hashes are joined. Texts are shuffled by conv_id, to
    be hashed in order and, those of maximal conversations, to be rendered.

    Nulls: rows with a null conv_id are one conversation (conv_id null, smaller than any other); a null role is rendered
    as user, a null text as empty, yet neither equals an explicit one. Repeated rows are repeated turns. An empty table
    gives an empty table. Very long texts are hashed and rendered whole. Only conv_id, turn, role and text are used: other columns may have any name.
    """
    turns = turns.select("conv_id", "turn", "role", "text").withColumn("__conv", F.concat(F.lit("c"), F.col("conv_id").cast("string"))).fillna("", ["__conv"])
    order = Window.partitionBy(*_KEY).orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.withColumn("__pos", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*_KEY)
    rows = rows.withColumns({"__h1": F.sum(_turn_hash(1)).over(upto), "__h2": F.sum(_turn_hash(2)).over(upto), "__n": F.count(F.lit(1)).over(whole)})
    prefixes = rows.select("__conv", "conv_id", F.col("__pos").alias("pos"), F.col("__n").alias("n"), F.col("__h1").alias("h1"), F.col("__h2").alias("h2"))
    full = prefixes.filter("pos = n")
    proper = prefixes.filter("pos < n").select("pos", "h1", "h2")
    maximal = full.join(proper, ["pos", "h1", "h2"], "left_anti")
    first = Window.partitionBy("pos", "h1", "h2").orderBy(F.col("conv_id").asc_nulls_first(), "__conv")
    chosen = maximal.withColumn("__k", F.row_number().over(first)).filter("__k = 1").select("__conv")
    kept = turns.withColumn("__pos", F.row_number().over(order)).join(chosen, "__conv", "left_semi")
    turn = F.concat(F.lit(OPEN), F.coalesce(_safe(F.col("role")), F.lit("user")), F.lit("\n"), F.coalesce(_safe(F.col("text")), F.lit("")), F.lit(CLOSE + "\n"))
    parts = F.array_sort(F.collect_list(F.struct("__pos", turn.alias("t"))))
    out = kept.groupBy("__conv").agg(F.first("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_turns"), F.concat_ws("", F.transform(parts, lambda x: x["t"])).alias("rendered"))
    return out.select("conv_id", "n_turns", "rendered")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


_CLEAN = "regexp_replace(coalesce({}, '{}'), '<\\|(im_start|im_end)\\|>', '<\\1>', 'g')"
SQL = f"""
WITH turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
prefixes AS (
  SELECT conv_id, pos, n, list((role, text)) OVER (PARTITION BY conv_id ORDER BY pos) AS said FROM turns),
whole AS (SELECT * FROM prefixes WHERE pos = n),
maximal AS (
  SELECT conv_id FROM whole a WHERE NOT EXISTS (
    SELECT 1 FROM prefixes b WHERE b.pos < b.n AND b.said = a.said)
  QUALIFY row_number() OVER (PARTITION BY said ORDER BY conv_id NULLS FIRST) = 1)
SELECT conv_id, count(*) AS n_turns,
  string_agg('{OPEN}' || {_CLEAN.format("role", "user")} || chr(10) || {_CLEAN.format("text", "")} || '{CLOSE}' || chr(10), '' ORDER BY pos) AS rendered
FROM turns WHERE conv_id IN (SELECT conv_id FROM maximal) GROUP BY conv_id"""

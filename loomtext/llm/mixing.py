"""Operator 8, mixing sources to target weights: tokens per source give repetition rates, and each document is
emitted floor(rate) times plus one hash-seeded Bernoulli copy with probability equal to the fraction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import BROADCAST_ROWS, guarded, hashed_unit, table

SEED = 11
#: Shares of the mixture's tokens. Sources that aren't listed share the rest in proportion to their tokens.
TARGETS = {"src0": 0.30, "src1": 0.06, "src2": 0.02, "src3": 0.05}


def tokens(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\r\f]+")), F.lit(0)).cast("bigint")


def repetition_rates(docs: DataFrame, targets: dict[str, float] = TARGETS, total: int | None = None) -> DataFrame:
    """One row for each source: source, n_docs, n_tokens, share, rate.

    total: tokens of the mixture, by default those of the input. A source without tokens can't contribute to any
    weight; its rate is 1, so its documents stay as they are. Listed sources that don't occur give their share to
    the others: shares are scaled to sum to 1.
    """
    if any(w < 0 for w in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("target shares must not be negative or sum to more than 1")
    per = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(tokens()).alias("n_tokens"))
    listed = F.lit(None).cast("double")
    for s, w in targets.items():
        listed = F.when(F.col("source") == s, F.lit(float(w))).otherwise(listed)
    per = per.withColumn("listed", F.when(F.col("n_tokens") > 0, listed))
    sums = per.agg(
        F.sum("n_tokens").alias("all_tokens"),
        F.coalesce(F.sum(F.when(F.col("listed").isNull(), F.col("n_tokens"))), F.lit(0)).alias("free_tokens"),
        F.coalesce(F.sum("listed"), F.lit(0.0)).alias("listed_sum"),
    )
    free_share = F.greatest(F.lit(1.0) - F.col("listed_sum"), F.lit(0.0))
    raw = F.when(F.col("listed").isNotNull(), F.col("listed")).otherwise(free_share * F.col("n_tokens") / F.col("free_tokens"))
    whole = F.col("listed_sum") + F.when(F.col("free_tokens") > 0, free_share).otherwise(F.lit(0.0))
    wanted = F.lit(total).cast("double") if total is not None else F.col("all_tokens").cast("double")
    share = F.when(F.col("n_tokens") > 0, F.when(whole > 0, raw / whole).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
    return (
        per.crossJoin(F.broadcast(sums))  # one row
        .withColumn("share", share)
        .withColumn("rate", F.when(F.col("n_tokens") > 0, F.col("share") * wanted / F.col("n_tokens")).otherwise(F.lit(1.0)))
        .select("source", "n_docs", "n_tokens", "share", "rate")
    )


def mix(docs: DataFrame, targets: dict[str, float] = TARGETS, total: int | None = None, seed: int = SEED) -> DataFrame:
    """The columns of docs and ``copy`` (0, 1, ...): each document as often as its source's rate says.

    The rates are one row a source. They are brought to the driver and broadcast if there are no more than
    BROADCAST_ROWS of them, and joined by Spark's own choice otherwise; texts are never shuffled in the first case.

    Nulls: a null source is a source of its own; a null or empty text has no tokens but is repeated like any
    document of its source; a null doc_id hashes as the word null. Repeated rows get the same draw each. An empty
    table gives an empty table. Very long texts are counted whole. A column that is already called copy becomes copy_in, any
    other name is left alone.
    """
    g = guarded(docs, ["doc_id", "text", "source"], ["copy"])
    rates = repetition_rates(g.rows, targets, total).select(F.col("source").alias("of"), "rate")
    head = rates.limit(BROADCAST_ROWS + 1).collect()
    if len(head) <= BROADCAST_ROWS:
        rates = F.broadcast(docs.sparkSession.createDataFrame(head, rates.schema))
    whole = F.floor("rate")
    draw = hashed_unit(seed, F.col("doc_id"), F.col("source")) < F.col("rate") - whole
    copies = (whole + draw.cast("bigint")).cast("int")
    got = g.rows.join(rates, F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", copies).filter("copies > 0")
    return g.restored(got.select(*g.columns, F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy")), F.col("copy"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


_CASES = " ".join(f"WHEN source = '{s}' THEN {w!r}::DOUBLE" for s, w in TARGETS.items())


def mixed_sql(source_table: str) -> str:
    """CTEs up to ``mixed``, over a table with the columns of documents."""
    return f"""
mix_per AS (
  SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+')))::BIGINT AS n_tokens
  FROM {source_table} GROUP BY source),
mix_listed AS (SELECT *, CASE WHEN n_tokens > 0 THEN CASE {_CASES} END END AS listed FROM mix_per),
mix_sums AS (
  SELECT sum(n_tokens)::DOUBLE AS all_tokens,
         coalesce(sum(CASE WHEN listed IS NULL THEN n_tokens END), 0)::DOUBLE AS free_tokens,
         coalesce(sum(listed ORDER BY source), 0)::DOUBLE AS listed_sum FROM mix_listed),
mix_rates AS (
  SELECT source, CASE WHEN n_tokens > 0 THEN
    (CASE WHEN listed IS NOT NULL THEN listed ELSE greatest(1 - listed_sum, 0) * n_tokens / free_tokens END
     / (listed_sum + CASE WHEN free_tokens > 0 THEN greatest(1 - listed_sum, 0) ELSE 0 END)) * all_tokens / n_tokens
    ELSE 1 END AS rate
  FROM mix_listed, mix_sums),
mixed AS (
  SELECT t.*, unnest(range(0, (floor(rate) + CASE WHEN
      ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(t.source, 'null')), 1, 13))::BIGINT
      / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT))::INTEGER AS copy
  FROM {source_table} t JOIN mix_rates r ON t.source IS NOT DISTINCT FROM r.source)"""


SQL = f"WITH {mixed_sql('documents')} SELECT * FROM mixed"

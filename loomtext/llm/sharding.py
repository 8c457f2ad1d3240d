"""Operator 4, sharding by proportional stratified interleaving: rows are shuffled by a seeded hash and ranked within
their source, sorted by fractional rank (rank - u) / n with a hashed u in (0, 1) for each source, and cut so that every shard
has the corpus' mixture. With a u of its own, sources of few rows spread over all shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import guarded, hash_text, hashed_unit, hex_number, materialise, table

SEED = 5
SHARDS = 64
#: Rows that one window partition of the ranking aims at.
BUCKET_ROWS = 20_000
_BITS = 24
OUT = ("source_rank", "position", "shard")
_GROUP = ["s", "no_s", "bucket"]


def _before(df: DataFrame, group: list[str], key: str, n: str, name: str) -> DataFrame:
    """Adds the sum of n over the rows of the group with a smaller key."""
    window = Window.partitionBy(*(group or [F.lit(1)])).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(n).over(window), F.lit(0)))


def _places(counts: DataFrame, buckets: int, seed: int) -> DataFrame:
    """s, no_s, bucket, upto (rows of the source in earlier buckets), places (positions of the bucket's rows, by rank).

    counts: s, no_s, bucket, n. The interleaving follows from the counts alone: each source has the ranks 1 .. its size. A
    rank's cell is a range of fractional ranks of about BUCKET_ROWS rows, so no task sorts more.
    """
    sized = _before(counts, ["s", "no_s"], "bucket", "n", "upto").withColumn("size", F.sum("n").over(Window.partitionBy("s", "no_s")))
    u = hashed_unit(seed + 1, F.col("s"), F.col("no_s").cast("string")) + F.lit(2.0**-53)
    ranks = sized.withColumn("u", u).select("s", "no_s", "bucket", "size", "u", F.explode(F.sequence(F.col("upto") + 1, F.col("upto") + F.col("n"))).alias("r"))
    f = (F.col("r") - F.col("u")) / F.col("size")
    ranks = ranks.select(*_GROUP, "r", f.alias("f")).withColumn("cell", F.least(F.floor(F.col("f") * buckets), F.lit(buckets - 1)).cast("bigint"))
    cells = _before(ranks.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), [], "cell", "n", "first")  # as many rows as cells
    order = Window.partitionBy("cell").orderBy("f", F.col("no_s").desc(), "s")
    placed = ranks.withColumn("local", F.row_number().over(order)).join(cells.select("cell", "first"), "cell")
    placed = placed.withColumn("place", F.col("first") + F.col("local") - 1)
    lists = placed.groupBy(*_GROUP).agg((F.min("r") - 1).alias("upto"), F.array_sort(F.collect_list(F.struct("r", "place"))).alias("p"))
    return lists.select(*_GROUP, "upto", F.col("p.place").alias("places"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The columns of docs and source_rank (1 ..), position (0 .. N-1 in the interleaving) and shard (0 .. shards-1).

    Shards have floor(N / shards) or one more rows; in each, every source has its share of the corpus up to one row
    or two. One shuffle carries the texts, however many sources there are: the ranking is by (source, hash bucket), so a hot
    source is spread over many tasks, and positions are computed from the buckets' counts.

    Nulls: a null source is a source of its own and sorts first; a null doc_id hashes as the word null. The hash is of doc_id
    and text, so copies and rows without an id are spread as well; wholly equal rows are interchangeable. Ties of
    fractional ranks go to the source that sorts first. Very long texts are hashed whole. Fewer rows than shards leave
    shards empty; an empty table gives an empty table. Columns called source_rank, position or shard become *_in, any other
    name is left alone.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    g = guarded(docs, ["doc_id", "text", "source"], OUT)
    digest = F.md5(F.coalesce("text", F.lit("")))
    keyed = g.rows.withColumns({"key": F.md5(hash_text(seed, F.col("doc_id"), digest)), "s": F.coalesce("source", F.lit("")), "no_s": F.col("source").isNull()})
    total = docs.count()
    buckets = max(1, min(1 << _BITS, total // BUCKET_ROWS))
    bucket = F.floor(hex_number(F.col("key"), _BITS // 4) * buckets / (1 << _BITS)).cast("bigint")
    keyed = keyed.withColumn("bucket", bucket)
    counts = materialise(keyed.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n")), "counts")
    places = materialise(_places(counts, buckets, seed), "places")
    # the window and the join share one shuffle, as their keys are the same
    local = F.row_number().over(Window.partitionBy(*_GROUP).orderBy("key", "doc_id"))
    placed = keyed.withColumn("local", local).join(places, _GROUP)
    position = F.element_at("places", F.col("local"))
    cut = F.floor(F.col("position").cast("decimal(38,0)") * shards / F.lit(max(total, 1))).cast("int")
    placed = placed.select(*g.columns, (F.col("local") + F.col("upto")).cast("bigint").alias("source_rank"), position.alias("position"))
    return g.restored(placed, F.col("source_rank"), F.col("position"), cut.alias("shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in order of position."""
    sharded.repartitionByRange("position").sortWithinPartitions("position").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def _unit(seed: int, *parts: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || {' || chr(58) || '.join(parts)}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


SQL = f"""
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), doc_id) AS source_rank,
         count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total,
         {_unit(SEED + 1, "coalesce(source, '')", "(source IS NULL)::VARCHAR")} + 1.1102230246251565e-16::DOUBLE AS u FROM documents),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (source_rank - u) / n::DOUBLE, source NULLS FIRST) - 1 AS position FROM ranked)
SELECT * EXCLUDE (n, total, u), (position * {SHARDS} // total)::INTEGER AS shard FROM placed"""

"""Agreement, rank correlation and translation scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.metrics import chance_corrected
from loomtext.functions.tokenizers import ngrams


#: Ranges of a column, of about equally many rows, that are ranked apart.
RANGES = 64


def _ranked(rows: DataFrame, group: str, by: str, ties: list[str], name: str) -> DataFrame:
    """rows with the rank by a column in each group, without a task that sorts a group: ranges of the values are ranked apart and
    counts of the lower ones added."""
    cuts = rows.groupBy(group).agg(F.array_sort(F.array_distinct(F.percentile_approx(by, [i / RANGES for i in range(1, RANGES)], 10_000))).alias("_cuts"))
    placed = rows.join(cuts, group).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(by)))).drop("_cuts")
    n = placed.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    lower = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = n.select(group, "_range", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(group, "_range").orderBy(by, *ties))
    return placed.withColumn("_local", local).join(before, [group, "_range"]).withColumn(name, (F.col("_local") + F.col("_before")).cast("double")).drop("_local", "_before", "_range")


def spearman(rows: DataFrame, group: str, x: str, y: str, ties: list[str]) -> DataFrame:
    """H13 by group: ranks by position, ties in the order of the given columns. Rows with a null group or value are left out."""
    rows = rows.select(group, x, y, *ties).dropna(subset=[group, x, y])
    r = _ranked(_ranked(rows, group, x, ties, "_x"), group, y, ties, "_y").select(F.col(group).alias("grp"), "_x", "_y")
    n, d = F.count(F.lit(1)), F.col("_x") - F.col("_y")
    return r.groupBy("grp").agg(n.alias("n"), F.sum(d * d).alias("d")).select("grp", "n", F.round(1 - 6 * F.col("d") / (F.col("n").cast("double") * (F.col("n").cast("double") * F.col("n") - 1)), 6).alias("rho"))


def kappa(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """Cohen's kappa of two labels a row: observed, expected, kappa. Rows with a null label are left out."""
    pairs = rows.select(a.alias("a"), b.alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    n = pairs.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    by = lambda c: pairs.groupBy(F.col(c).alias("k")).agg(F.sum("c").cast("double").alias(f"n{c}"))
    e = by("a").join(by("b"), "k").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0.0)).alias("e"))
    both = n.crossJoin(e).select((F.col("same") / F.col("n")).alias("o"), (F.col("e") / (F.col("n") * F.col("n").cast("double"))).alias("e"))
    return both.select(F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), F.round(chance_corrected(F.col("o"), F.col("e")), 6).alias("kappa"))


def pi(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """H11, Scott's pi: expected agreement by the pooled shares of both labels. observed, expected, pi."""
    pairs = rows.select(a.alias("a"), b.alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    n = pairs.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same"))
    pooled = pairs.select("c", F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.sum("c").cast("double").alias("c"))
    e = pooled.agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("e"))
    both = n.crossJoin(e).select((F.col("same") / F.col("n")).alias("o"), "e")
    return both.select(F.round("o", 6).alias("observed"), F.round("e", 6).alias("expected"), F.round(chance_corrected(F.col("o"), F.col("e")), 6).alias("pi"))


def deviation(rows: DataFrame, value: str) -> DataFrame:
    """Mean and mean absolute deviation of a column."""
    m = rows.agg(F.avg(value).alias("m"))
    return rows.crossJoin(F.broadcast(m)).agg(F.round(F.first("m"), 4).alias("mean"), F.round(F.avg(F.abs(F.col(value) - F.col("m"))), 4).alias("mad"))


def alpha(rows: DataFrame, a: str, b: str) -> DataFrame:
    """1 - mean |a - b| / mean absolute deviation of the pooled values; 1 for less than two pairs or without deviation.
    Pairs with a null are left out."""
    pairs = rows.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    m = pairs.agg(F.avg(F.col("a") + F.col("b")) / 2).toDF("m")
    terms = pairs.crossJoin(F.broadcast(m)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("o"), (F.avg(F.abs(F.col("a") - F.col("m")) + F.abs(F.col("b") - F.col("m"))) / 2).alias("e"))
    return terms.select("n", F.when((F.col("n") < 2) | (F.col("e") == 0), 1.0).otherwise(1 - F.col("o") / F.col("e")).alias("alpha"))


def _marked(n: int, mine: int):
    return lambda g: F.struct(F.lit(n).alias("n"), F.lit(mine).alias("mine"), F.array_join(g, "\x01").alias("g"))


def bleu_parts(rows: DataFrame, key: str, candidate: str, reference: str, max_n: int = 4) -> DataFrame:
    """key, c, r (lengths), n, hits (clipped), total: the n-grams of both sides are counted together, orders that both reach."""
    c, r = F.col("said"), F.col("meant")
    sides = rows.select(F.col(key).alias("key"), F.col(candidate).alias("said"), F.col(reference).alias("meant"))
    grams = []
    for n in range(1, max_n + 1):
        fits = (F.size(c) >= n) & (F.size(r) >= n)
        for side, mine in ((c, 1), (r, 0)):
            made = F.transform(ngrams(side, n), _marked(n, mine))
            grams.append(F.when(fits, made).otherwise(F.array().cast("array<struct<n:int,mine:int,g:string>>")))
    flat = sides.select("key", F.size(c).alias("c"), F.size(r).alias("r"), F.explode_outer(F.concat(*grams)).alias("x"))
    counts = flat.groupBy("key", "c", "r", "x.n", "x.g").agg(F.sum("x.mine").alias("mine"), F.count(F.lit(1)).alias("both"))
    hits = F.least("mine", F.col("both") - F.col("mine"))
    return counts.groupBy("key", "c", "r", "n").agg(F.sum(hits).alias("hits"), F.sum("mine").alias("total"))


def _bleu(parts: DataFrame, keys: list[str], c: Column, r: Column, standard: bool, max_n: int) -> DataFrame:
    log = F.avg(F.when(F.col("hits") > 0, F.ln(F.col("hits") / F.col("total")))).alias("log")
    sums = parts.groupBy(*keys).agg(log, F.sum(F.when(F.col("hits") > 0, 1).otherwise(0)).alias("orders"), c.alias("c"), r.alias("r"))
    brevity = F.when(F.col("c") >= F.col("r"), 1.0).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    none = (F.col("c") == 0) | (F.col("r") == 0) | ((F.col("orders") < max_n) if standard else (F.col("orders") == 0))
    return sums.select(*keys, F.when(none, 0.0).otherwise(brevity * F.exp("log")).alias("bleu"))


def bleu(rows: DataFrame, key: str, candidate: str, reference: str, max_n: int = 4, standard: bool = False) -> DataFrame:
    """V2: key, bleu: clipped n-gram precisions of one reference, brevity penalty, and their geometric mean over the orders with a
    match; standard: over all orders, 0 if one has none."""
    return _bleu(bleu_parts(rows, key, candidate, reference, max_n), ["key"], F.first("c"), F.first("r"), standard, max_n).withColumnRenamed("key", key)


def corpus_bleu(rows: DataFrame, key: str, candidate: str, reference: str, max_n: int = 4, standard: bool = False) -> DataFrame:
    """V3: bleu of pooled counts and lengths; 0 without rows."""
    parts = bleu_parts(rows, key, candidate, reference, max_n)
    lengths = rows.agg(F.coalesce(F.sum(F.size(candidate)), F.lit(0)).alias("c"), F.coalesce(F.sum(F.size(reference)), F.lit(0)).alias("r"))
    pooled = parts.groupBy("n").agg(F.sum("hits").alias("hits"), F.sum("total").alias("total")).crossJoin(F.broadcast(lengths))
    return _bleu(pooled, [], F.coalesce(F.first("c"), F.lit(0)), F.coalesce(F.first("r"), F.lit(0)), standard, max_n)

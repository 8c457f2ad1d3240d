"""Collocations: contiguous n-grams, filters, association scores, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import metrics, tokenizers


def find(docs: DataFrame, tokens: Column, n: int = 2) -> DataFrame:
    """K1: w1 .. wn, count; n-grams don't cross documents. Windows are taken within the token array, so nothing is shuffled before the count."""
    names = [f"w{i}" for i in range(1, n + 1)]
    grams = docs.select(tokens.alias("t")).select(F.inline(tokenizers.ngram_structs(F.col("t"), n, *names)))  # tokens once a text
    return grams.groupBy(*names).agg(F.count(F.lit(1)).alias("count"))


def unigrams(docs: DataFrame, tokens: Column) -> DataFrame:
    return docs.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("count"))


def counted(docs: DataFrame, tokens: Column) -> DataFrame:
    """w1, w2, count of adjacent words, and of each text's last word with an empty w2: unigrams and bigrams of one scan."""
    t = docs.select(tokens.alias("t")).select("t", F.concat(F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), F.array(F.lit(""))).alias("after"))
    pairs = t.select(F.explode(F.zip_with("t", F.slice("after", 1, F.size("t")), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))).alias("g"))
    # joins infer this condition for one of the parts: said here, the parts stay equal and share their shuffle
    pairs = pairs.filter(F.col("g.w1").isNotNull() & F.col("g.w2").isNotNull())
    return pairs.groupBy("g.w1", "g.w2").agg(F.count(F.lit(1)).alias("count"))


def unigrams_of(pairs: DataFrame) -> DataFrame:
    """w, count from ``counted``: each word is the first of one pair."""
    return pairs.groupBy(F.col("w1").alias("w")).agg(F.sum("count").alias("count"))


def bigrams_of(pairs: DataFrame, least: int = 1) -> DataFrame:
    """K1, K2 from ``counted``. The condition reads the count, so that it isn't pushed below the aggregation, which both parts share."""
    return pairs.filter(F.when(F.col("w2") == "", F.lit(0)).otherwise(F.col("count")) >= max(1, least))


def freq_filter(grams: DataFrame, least: int) -> DataFrame:
    """K2."""
    return grams.filter(F.col("count") >= least)


def word_filter(grams: DataFrame, drop) -> DataFrame:
    """K3: n-grams of which any word meets the condition go. drop: Column -> Column."""
    hit = F.lit(False)
    for c in grams.columns:
        if c.startswith("w"):
            hit = hit | drop(F.col(c))
    return grams.filter(~hit)


def finder_likelihood_ratio(k: Column, c1: Column, c2: Column, n: Column) -> Column:
    """K7: the finder's ratio, whose null probability is k / n."""

    def ll(k: Column, n: Column, p: Column) -> Column:
        rest = F.when(n - k == 0, 0.0).otherwise((n - k) * F.ln(1 - p))
        return F.when((k <= 0) | (n <= 0) | (p <= 0), 0.0).otherwise(k * F.ln(p) + rest)

    p, p1, p2 = k / n, k / c1, F.when(n > c1, (c2 - k) / (n - c1)).otherwise(0.0)
    return 2 * (ll(k, c1, p1) + ll(c2 - k, n - c1, p2) - ll(k, c1, p) - ll(c2 - k, n - c1, p))


def score(grams: DataFrame, words: DataFrame, measure: str = "pmi") -> DataFrame:
    """K4 - K9: bigrams with count, c1, c2 and score. Filter first: only what is left is joined to the words' counts."""
    n = words.agg(F.sum("count").alias("n"))
    side = lambda i: words.select(F.col("w").alias(f"w{i}"), F.col("count").alias(f"c{i}"))
    joined = grams.join(side(1), "w1").join(side(2), "w2").crossJoin(F.broadcast(n))
    args = [F.col(x) for x in ("count", "c1", "c2", "n")]
    value = {
        "raw_freq": lambda: F.col("count").cast("double"),
        "pmi": lambda: metrics.pmi(*args),
        "chi_sq": lambda: metrics.chi_sq(*args),
        "likelihood_ratio": lambda: finder_likelihood_ratio(*args),
        "g2": lambda: metrics.likelihood_ratio(*args),
        "dice": lambda: metrics.dice(*args[:3]),
        "student_t": lambda: metrics.student_t(*args),
    }[measure]()
    return joined.select("w1", "w2", "count", "c1", "c2", value.alias("score"))


def best(scored: DataFrame, n: int = 10) -> DataFrame:
    """K8: by score rounded to 6 digits, then words."""
    return scored.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "w1", "w2").limit(n)

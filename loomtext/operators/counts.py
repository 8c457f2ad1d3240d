"""Frequency and conditional-frequency distributions, their algebra, and probability estimates, as DataFrames.

A distribution is (sample, count); a conditional one (condition, sample, count). Counting is a partial and a final hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(docs: DataFrame, tokens_: Column, *keep: str) -> DataFrame:
    """doc_id, pos (from 0), token, and further columns: one row a token."""
    return docs.select("doc_id", *keep, F.posexplode(tokens_).alias("pos", "token"))


def freq_dist(rows: DataFrame, sample: str = "token") -> DataFrame:
    """F1."""
    return rows.groupBy(F.col(sample).alias("sample")).agg(F.count(F.lit(1)).alias("count"))


def conditional_freq_dist(rows: DataFrame, condition: str, sample: str) -> DataFrame:
    """F13."""
    return rows.groupBy(F.col(condition).alias("condition"), F.col(sample).alias("sample")).agg(F.count(F.lit(1)).alias("count"))


def totals(fd: DataFrame) -> DataFrame:
    """n, b (outcomes, samples)."""
    return fd.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("b"))


def with_total(fd: DataFrame, n: str = "n", b: str = "b") -> DataFrame:
    """fd with n and b on each row; one row is broadcast, nothing is shuffled but the two sums."""
    return fd.crossJoin(F.broadcast(totals(fd).select(F.col("n").alias(n), F.col("b").alias(b))))


def frequencies(fd: DataFrame) -> DataFrame:
    """sample, count, freq."""
    return with_total(fd).select("sample", "count", (F.col("count") / F.col("n")).alias("freq"))


def hapaxes(fd: DataFrame) -> DataFrame:
    """F5."""
    return fd.filter("count = 1").select("sample")


def most_common(fd: DataFrame, n: int | None = None) -> DataFrame:
    """by count, then sample."""
    out = fd.orderBy(F.desc("count"), "sample")
    return out if n is None else out.limit(n)


def most_common_by_condition(cfd: DataFrame, n: int) -> DataFrame:
    """the n most common samples of each condition, with rank."""
    w = Window.partitionBy("condition").orderBy(F.desc("count"), "sample")
    return cfd.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """F9."""
    return a.unionByName(b).groupBy("sample").agg(F.sum("count").alias("count"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """what stays above 0."""
    both = a.unionByName(b.select("sample", (-F.col("count")).alias("count")))
    return both.groupBy("sample").agg(F.sum("count").alias("count")).filter("count > 0")


def laplace(fd: DataFrame, bins: int | None = None) -> DataFrame:
    """(c + 1) / (N + bins)."""
    return lidstone(fd, 1.0, bins)


def lidstone(fd: DataFrame, gamma: float, bins: int | None = None) -> DataFrame:
    """(c + gamma) / (N + gamma bins)."""
    size = F.lit(bins) if bins is not None else F.col("b")
    return with_total(fd).select("sample", ((F.col("count") + gamma) / (F.col("n") + gamma * size)).alias("prob"))


def witten_bell(fd: DataFrame) -> DataFrame:
    """c / (N + B): the rest is for unseen samples."""
    return with_total(fd).select("sample", (F.col("count") / (F.col("n") + F.col("b"))).alias("prob"))


def entropy(fd: DataFrame) -> DataFrame:
    """In bits."""
    p = F.col("freq")
    return frequencies(fd).agg(F.round(-F.sum(p * F.log2(p)), 6).alias("entropy"))


def count_of_counts(fd: DataFrame) -> DataFrame:
    """How many samples occur r times, the statistic of Good-Turing estimates."""
    return fd.groupBy(F.col("count").alias("r")).agg(F.count(F.lit(1)).alias("n_r"))


def samples(fd: DataFrame) -> DataFrame:
    """the samples, sorted."""
    return fd.select("sample").orderBy("sample")


def increased(fd: DataFrame, changes: DataFrame) -> DataFrame:
    """F8: fd with the counts of changes (sample, count) added; samples may be new, repeated changes add up."""
    return add(fd, changes.groupBy("sample").agg(F.sum("count").alias("count")))


def assigned(fd: DataFrame, values: DataFrame) -> DataFrame:
    """F8: fd with the counts of values (sample, count; each sample once) set."""
    v = values.select("sample", F.col("count").alias("_new"))
    return fd.join(v, "sample", "full").select("sample", F.coalesce("_new", "count").alias("count"))


def looked_up(fd: DataFrame, asked: DataFrame) -> DataFrame:
    """F8: asked (sample) with its count, 0 if it isn't in fd."""
    return asked.select("sample").join(fd, "sample", "left").select("sample", F.coalesce("count", F.lit(0)).alias("count"))


def contains(fd: DataFrame, asked: DataFrame) -> DataFrame:
    """F8: the asked samples that fd has."""
    return asked.select("sample").join(fd, "sample", "left_semi")


def tabulate(fd: DataFrame, n: int = 10) -> str:
    """the n most common samples and their counts as two aligned lines."""
    rows = [(str(r["sample"]), str(r["count"])) for r in most_common(fd, n).collect()]
    width = max((len(x) for r in rows for x in r), default=0) + 1
    return "\n".join("".join(r[i].rjust(width) for r in rows) for i in (0, 1))


def described(fd: DataFrame) -> str:
    """F12."""
    t = totals(fd).first()
    return f"<FreqDist with {t.b} samples and {t.n} outcomes>"

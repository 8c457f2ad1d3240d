"""Classifiers over labelled feature sets: (id, label, features MAP<STRING, STRING>)."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators.lineage import cut


def _exploded(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode("features").alias("k", "v")).select(*keep, F.concat_ws("=", "k", "v").alias("feature"))


def naive_bayes_train(rows: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Label, feature, logp for each label and feature; feature NULL holds the log prior."""
    counts = _exploded(rows, "label").groupBy("label", "feature").agg(F.count(F.lit(1)).alias("c"))
    labels = rows.groupBy("label").agg(F.count(F.lit(1)).alias("docs"))
    n = labels.agg(F.sum("docs").alias("n"))
    vocabulary = counts.select("feature").distinct()
    size = vocabulary.agg(F.count(F.lit(1)).alias("v"))
    total = counts.groupBy("label").agg(F.sum("c").alias("total"))
    grid = vocabulary.crossJoin(F.broadcast(labels.select("label")))  # labels are few: each feature once a label
    like = grid.join(counts, ["label", "feature"], "left").join(F.broadcast(total), "label", "left").crossJoin(F.broadcast(size))
    logp = F.ln((F.coalesce("c", F.lit(0)) + alpha) / (F.coalesce("total", F.lit(0)) + alpha * F.col("v")))
    prior = labels.crossJoin(F.broadcast(n)).select("label", F.lit(None).cast("string").alias("feature"), F.ln(F.col("docs") / F.col("n")).alias("logp"))
    return like.select("label", "feature", logp.alias("logp")).unionByName(prior)


def naive_bayes_scores(model: DataFrame, rows: DataFrame) -> DataFrame:
    """Id, label, logp, prob; unknown features are left out."""
    prior = model.filter("feature IS NULL").select("label", F.col("logp").alias("prior"))
    by_feature = model.filter("feature IS NOT NULL").groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("label", "logp"))).alias("by"))
    keyed = _keyed(rows)
    sets = keyed.select("f").distinct()
    seen = sets.select("f", F.explode("f").alias("feature")).join(by_feature, "feature").select("f", F.explode("by").alias("label", "logp")).groupBy("f", "label").agg(F.sum("logp").alias("s"))
    every = sets.crossJoin(F.broadcast(prior)).join(seen, ["f", "label"], "left")
    every = every.select("f", "label", (F.col("prior") + F.coalesce("s", F.lit(0.0))).alias("logp"))
    w = Window.partitionBy("f")
    every = every.withColumn("e", F.exp(F.col("logp") - F.max("logp").over(w)))
    return _by_set(keyed, every.select("f", F.struct("label", "logp", (F.col("e") / F.sum("e").over(w)).alias("prob")).alias("x")))


def _keyed(rows: DataFrame) -> DataFrame:
    """id, f: a row's features in order. Rows with the same features have the same scores, which are computed once: features are few,
    so that rows exploded and joined by feature would fall into a few tasks."""
    f = F.array_sort(F.transform(F.map_entries("features"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.select("id", F.coalesce(f, F.array().cast("array<string>")).alias("f"))


def _by_set(keyed: DataFrame, scored: DataFrame) -> DataFrame:
    """scored: f, x (a struct for each label) -> id and the fields of x."""
    sets = scored.groupBy("f").agg(F.collect_list("x").alias("x"))
    return keyed.join(sets, "f").select("id", F.explode("x").alias("x")).select("id", "x.*")


def best_label(scores: DataFrame) -> DataFrame:
    """Id, label; of ties the last label in sort order."""
    return scores.groupBy("id").agg(F.max(F.struct(F.round("logp", 9).alias("p"), "label")).alias("m")).select("id", "m.label")


def most_informative(model: DataFrame, n: int = 10) -> DataFrame:
    """Pairs of labels and features by the absolute difference of their log likelihoods."""
    m = model.filter("feature IS NOT NULL")
    a, b = m.select("feature", F.col("label").alias("label_a"), F.col("logp").alias("pa")), m.select("feature", F.col("label").alias("label_b"), F.col("logp").alias("pb"))
    diff = F.round(F.abs(F.col("pa") - F.col("pb")), 6).alias("difference")
    return a.join(b, "feature").filter("label_a < label_b").select("label_a", "label_b", "feature", diff).orderBy(F.desc("difference"), "feature", "label_a", "label_b").limit(n)


def positive_naive_bayes(positive: DataFrame, unlabelled: DataFrame) -> DataFrame:
    """Unlabelled rows count as neg. Columns id, features."""
    rows = positive.withColumn("label", F.lit("pos")).unionByName(unlabelled.withColumn("label", F.lit("neg")))
    return naive_bayes_train(rows)


def accuracy(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.agg(F.coalesce(F.avg(F.when(F.col(gold).eqNullSafe(F.col(predicted)), 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"))


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def labels(rows: DataFrame) -> DataFrame:
    """C4: the labels, sorted."""
    return rows.select("label").distinct().orderBy("label")


def log_likelihood(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """L3 re-export: mean log2 probability of the gold labels; scores: id, label, prob."""
    return scores.join(gold.select("id", "label"), ["id", "label"]).agg(F.avg(F.log2("prob")).alias("log_likelihood"))


# ---------------------------------------------------------------- maximum entropy


def _sets(rows: DataFrame) -> DataFrame:
    """Distinct feature sets: key, features (array of feature=value), and how often each label has them."""
    s = rows.select(*[c for c in ("label",) if c in rows.columns], F.array_sort(F.transform(F.map_entries("features"), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("f"))
    return s.groupBy("f", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.xxhash64("f"))


#: Distinct feature sets times labels up to which the rounds run on the driver: the same sums, without a job for each round.
MAXENT_LOCAL = 200_000


def _maxent_local(data: DataFrame, most: int, max_iter: int, sigma: float, least: float) -> DataFrame:
    rows = data.collect()  # bounded by MAXENT_LOCAL
    keys, labels_ = {r.key: r.f for r in rows}, sorted({r.label for r in rows})
    names = sorted({f for fs in keys.values() for f in fs})
    place, order = {f: i for i, f in enumerate(names)}, {k: i for i, k in enumerate(keys)}
    has = np.zeros((len(keys), len(names)))
    for k, fs in keys.items():
        has[order[k], [place[f] for f in fs]] = 1
    n = np.zeros((len(keys), len(labels_)))
    for r in rows:
        n[order[r.key], labels_.index(r.label)] = r.n
    seen = has.T @ n
    known = seen > 0
    w = np.zeros(seen.shape)
    for _ in range(max_iter):
        x = has @ w
        p = np.exp(x - x.max(1, keepdims=True))
        expected = has.T @ (n.sum(1, keepdims=True) * p / p.sum(1, keepdims=True))
        step = np.where(known, np.log(np.where(known, seen, 1) / np.where(known, expected, 1)) / most, 0.0)
        if sigma > 0:
            step = np.where(known, step - w / (sigma * sigma * most), 0.0)
        w += step
        if np.abs(step).max() < least:
            break
    out = [(labels_[j], names[i], float(w[i, j])) for i in range(len(names)) for j in range(len(labels_)) if known[i, j]]
    return data.sparkSession.createDataFrame(out, "label string, feature string, weight double")


def maxent_train(rows: DataFrame, max_iter: int = 100, sigma: float = 0.0, least: float = 1e-5) -> DataFrame:
    """Label, feature, weight by generalised iterative scaling with expectations by label, over binary features.

    Rows with equal features are one row with a count. Each round is a join by feature and two aggregations; it ends when no weight
    changes by ``least`` or more. sigma: deviation of a Gaussian prior, 0 for none.
    """
    data = cut(_sets(rows))
    if data.isEmpty():
        raise ValueError("no training data")
    kinds = data.select("label").distinct()
    most = max(1, data.agg(F.max(F.size("f"))).first()[0])
    flat = data.select("key", "label", "n", F.explode("f").alias("feature"))
    empirical = flat.groupBy("label", "feature").agg(F.sum("n").alias("seen"))
    sets = cut(data.groupBy("key").agg(F.first("f").alias("f"), F.sum("n").alias("n")))
    pairs = sets.select("key", "n", F.explode("f").alias("feature"))
    if data.count() * kinds.count() <= MAXENT_LOCAL:
        return _maxent_local(data, most, max_iter, sigma, least)
    weights = cut(empirical.withColumn("weight", F.lit(0.0)))
    for _ in range(max_iter):
        p = _probabilities(pairs.select("key", "feature"), sets.select("key"), kinds, weights)
        expected = pairs.join(p, "key").groupBy("label", "feature").agg(F.sum(F.col("n") * F.col("prob")).alias("expected"))
        step = F.ln(F.col("seen") / F.col("expected")) / most
        if sigma > 0:
            step = step - F.col("weight") / (sigma * sigma * most)
        new = cut(weights.join(expected, ["label", "feature"]).select("label", "feature", "seen", (F.col("weight") + step).alias("weight"), F.abs(step).alias("step")))
        weights = new.drop("step")
        if (new.agg(F.max("step")).first()[0] or 0.0) < least:
            break
    return weights.select("label", "feature", "weight")


def _probabilities(pairs: DataFrame, keys: DataFrame, kinds: DataFrame, weights: DataFrame) -> DataFrame:
    """key, label, prob: softmax of the summed weights; labels are few."""
    by_feature = weights.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("label", "weight"))).alias("w"))
    sums = pairs.join(by_feature, "feature").select("key", F.explode("w").alias("label", "x")).groupBy("key", "label").agg(F.sum("x").alias("x"))
    every = keys.crossJoin(F.broadcast(kinds)).join(sums, ["key", "label"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
    w = Window.partitionBy("key")
    return every.withColumn("e", F.exp(F.col("x") - F.max("x").over(w))).select("key", "label", (F.col("e") / F.sum("e").over(w)).alias("prob"))


def maxent_scores(model: DataFrame, rows: DataFrame) -> DataFrame:
    """Id, label, prob."""
    keyed = _keyed(rows)
    sets = keyed.select(F.col("f").alias("key")).distinct()
    p = _probabilities(sets.select("key", F.explode("key").alias("feature")), sets, model.select("label").distinct(), model)
    return _by_set(keyed, p.select(F.col("key").alias("f"), F.struct("label", "prob").alias("x")))


def maxent_informative(model: DataFrame, n: int = 10) -> DataFrame:
    """The largest weights as lines "0.123 label feature"."""
    top = model.orderBy(F.desc("weight"), "label", "feature").limit(n)
    return top.select(F.format_string("%.3f %s %s", "weight", "label", "feature").alias("line"))


# ---------------------------------------------------------------- language identification


#: Trigrams of a language's profile.
PROFILE = 300


def textcat_train(rows: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """Lang, trigram, rank (0 first) of each language's most frequent character trigrams; of ties the smaller one goes first."""
    padded = rows.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")), F.lit(" ")).alias("t"))
    chars = padded.select("lang", F.split("t", "", -1).alias("c"))  # a substring would be looked for from the text's start each time
    shifted = [F.slice("c", i, F.greatest(F.size("c") - 2, F.lit(0))) for i in (1, 2, 3)]
    grams = chars.select("lang", F.explode(F.zip_with(F.zip_with(*shifted[:2], lambda a, b: F.concat(a, b)), shifted[2], lambda a, b: F.concat(a, b))).alias("trigram"))
    counts = grams.filter(F.trim("trigram") != "").groupBy("lang", "trigram").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "trigram")
    return counts.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < size).select("lang", "trigram", "rank")


def textcat(rows: DataFrame, profiles: DataFrame, text: str = "text", size: int = PROFILE) -> DataFrame:
    """Rows with guess and confidence: the profile whose ranks are nearest to the text's (out-of-place distance), and how
    much nearer it is than the next one. A text without letters is unknown. Profiles are size rows a language."""
    table: dict[str, dict[str, int]] = {}
    for r in profiles.collect():
        table.setdefault(r.lang, {})[r.trigram] = r.rank

    @F.arrow_udf("struct<guess:string,confidence:double>")
    def guess(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            padded = f" {' '.join(re.findall(r'[^\W\d_]+', (t or '').lower()))} "
            seen = Counter(padded[i : i + 3] for i in range(len(padded) - 2))
            ranked = sorted((g for g in seen if g.strip() and len(g) == 3), key=lambda g: (-seen[g], g))[:size]
            if not ranked or not table:
                out.append({"guess": "unknown", "confidence": 0.0})
                continue
            far = sorted((sum(abs(i - p[g]) if g in p else size for i, g in enumerate(ranked)), lang) for lang, p in table.items())
            second = far[1][0] if len(far) > 1 else size * len(ranked)
            out.append({"guess": far[0][1], "confidence": (second - far[0][0]) / max(second, 1)})
        return pa.array(out, pa.struct([("guess", pa.string()), ("confidence", pa.float64())]))

    return rows.withColumn("_g", guess(F.col(text))).select(*rows.columns, "_g.guess", "_g.confidence")

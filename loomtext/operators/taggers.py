"""Taggers that are tables: training counts (token rows: sent_id, pos, word, tag), tagging is a join."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.kernels import tagging
from loomtext.operators.lineage import cut


def _most_frequent(rows: DataFrame, *keys: str) -> DataFrame:
    """The most frequent tag by key; of ties the smallest."""
    c = rows.groupBy(*keys, "tag").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "tag")).alias("m")).select(*keys, F.col("m.tag").alias("tag"))


def default_tag(rows: DataFrame, tag: str) -> DataFrame:
    """G3."""
    return rows.withColumn("tag", F.lit(tag))


def unigram_train(rows: DataFrame) -> DataFrame:
    """Word, tag."""
    return _most_frequent(rows, "word")


def unigram_tag(rows: DataFrame, model: DataFrame, backoff: str = "") -> DataFrame:
    """Unknown words get the backoff tag."""
    return rows.join(model.withColumnRenamed("tag", "__tag"), "word", "left").withColumn("tag", F.coalesce("__tag", F.lit(backoff))).drop("__tag")


def context_train(rows: DataFrame, order: int) -> DataFrame:
    """G5 (order 2), G6 (order 3): previous tags, word, tag."""
    w = Window.partitionBy("sent_id").orderBy("pos")
    for i in range(1, order):
        rows = rows.withColumn(f"prev{i}", F.lag("tag", i, "<S>").over(w))
    return _most_frequent(rows, *[f"prev{i}" for i in range(1, order)], "word")


def _with_previous(sentences: DataFrame, order: int) -> DataFrame:
    """Token rows with the tags before, paired within the arrays (s: array of word, tag): nothing is shuffled by sentence."""
    before = lambda i, n: F.coalesce(F.get("s", i - n)["tag"], F.lit("<S>"))
    made = F.transform("s", lambda x, i: F.struct(*[F.when(i >= n, before(i, n)).otherwise("<S>").alias(f"prev{n}") for n in range(1, order)], x["word"].alias("word"), x["tag"].alias("tag")))
    return sentences.select(F.explode(made).alias("x")).select("x.*")


def context_train_sentences(sentences: DataFrame, order: int) -> DataFrame:
    """``context_train`` of sentences that are arrays."""
    return _most_frequent(_with_previous(sentences, order), *[f"prev{n}" for n in range(1, order)], "word")


def transition_counts_sentences(sentences: DataFrame) -> DataFrame:
    """``transition_counts`` of sentences that are arrays."""
    return _with_previous(sentences, 2).groupBy(F.col("prev1").alias("prev"), "tag").agg(F.count(F.lit(1)).alias("n"))


def affix_train(rows: DataFrame, size: int = 3, suffix: bool = True) -> DataFrame:
    """Affix, tag (most frequent)."""
    affix = F.right("word", F.lit(size)) if suffix else F.left("word", F.lit(size))
    return _most_frequent(rows.filter(F.length("word") >= size).withColumn("affix", affix), "affix")


def affix_tag(rows: DataFrame, model: DataFrame, size: int = 3, suffix: bool = True, backoff: str = "") -> DataFrame:
    affix = F.right("word", F.lit(size)) if suffix else F.left("word", F.lit(size))
    return rows.withColumn("affix", affix).join(model.withColumnRenamed("tag", "__tag"), "affix", "left").withColumn("tag", F.coalesce("__tag", F.lit(backoff))).drop("__tag", "affix")


def regexp_tag(rows: DataFrame, patterns: list[tuple[str, str]], backoff: str = "") -> DataFrame:
    """The first pattern found anywhere in the word decides."""
    return rows.withColumn("tag", regexp_tag_of(F.col("word"), patterns, backoff))


def regexp_tag_of(word: Column, patterns: list[tuple[str, str]], backoff: str = "") -> Column:
    tag = F.lit(backoff)
    for pattern, t in reversed(patterns):
        tag = F.when(word.rlike(pattern), t).otherwise(tag)
    return tag


def evaluate(gold: DataFrame, tagged: DataFrame) -> DataFrame:
    """Accuracy by token, 0 without tokens."""
    j = gold.select("sent_id", "pos", F.col("tag").alias("g")).join(tagged.select("sent_id", "pos", "tag"), ["sent_id", "pos"])
    return j.agg(F.coalesce(F.avg(F.when(F.col("g") == F.col("tag"), 1.0).otherwise(0.0)), F.lit(0.0)).alias("accuracy"))


def transition_counts(rows: DataFrame) -> DataFrame:
    """Previous tag, tag, n."""
    w = Window.partitionBy("sent_id").orderBy("pos")
    return rows.withColumn("prev", F.lag("tag", 1, "<S>").over(w)).groupBy("prev", "tag").agg(F.count(F.lit(1)).alias("n"))


def emission_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("tag", "word").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- taggers that go along a sentence

#: Tags that a model of transitions may have: their tables go to every task.
MOST_TAGS = 200
#: Sentences of a batch whose tags are Python objects at once.
SLICE = 500


def _sentences(rows: DataFrame, by_word: DataFrame, info: str) -> DataFrame:
    """sent_id, s: array of (pos, word, info) by position; by_word (word, info) is joined, however large."""
    joined = rows.select("sent_id", "pos", "word").join(by_word.select("word", info), "word", "left")
    return joined.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", F.col(info).alias("info")))).alias("s"))


def _exploded(tagged: DataFrame) -> DataFrame:
    return tagged.select("sent_id", F.explode(F.arrays_zip(F.col("s.pos").alias("pos"), F.col("s.word").alias("word"), "tags")).alias("x")).select("sent_id", "x.pos", "x.word", F.col("x.tags").alias("tag"))


def _codes(tags: Iterable[str]) -> dict[str, str]:
    """A character for each tag."""
    return {t: chr(i if i < 0xD800 else i + 0x800) for i, t in enumerate(tags, 1)}


def _coded(tag: Column, codes: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in codes.items() for x in pair]), tag)


def _tag_maps(counts: DataFrame, codes: dict[str, str]) -> DataFrame:
    """word, info: each tag's character and how often the word has it, tabs between; as long as the tagset at most. A token carries
    this through two shuffles, so it is a short text."""
    one = F.concat(_coded(F.col("tag"), codes), F.col("n").cast("string"))
    return counts.groupBy("word").agg(F.array_join(F.array_sort(F.collect_list(one)), "\t").alias("info"))


def _uncoded(info: str, names: dict[str, str]) -> dict[str, int]:
    return {names[x[0]]: int(x[1:]) for x in info.split("\t")} if info else {}


def _arrow(read: Callable, f: Callable[[list], list[str]]) -> Callable[[Column], Column]:
    """f of sentences that are arrays of infos; read: what f gets for an info (null for an unknown word), once for each kind in a batch."""

    @F.arrow_udf("array<string>")
    def run(sentences: pa.Array) -> pa.Array:
        coded = sentences.flatten().dictionary_encode(null_encoding="encode")
        kinds, at = [read(x) for x in coded.dictionary.to_pylist()], coded.indices.to_numpy()
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(sentences), 0).to_numpy())])
        parts = []
        for i in range(0, len(sentences), SLICE):
            tags = [t for a, b in zip(ends[i : i + SLICE], ends[i + 1 : i + SLICE + 1]) for t in f([kinds[k] for k in at[a:b].tolist()])]
            parts.append(pa.array(tags, pa.string()))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts) if parts else pa.array([], pa.string()))

    return run


def context_tag(rows: DataFrame, model: DataFrame, order: int, default: str | None = None, backoff: DataFrame | None = None) -> DataFrame:
    """G5 (order 2), G6 (order 3): rows (sent_id, pos, word) with tag, by the tags predicted before and the word.

    model: see ``context_train``; it is computed once. Where a context is unknown, backoff (word, tag) decides, else default, by default
    the model's most frequent tag (of ties the smallest).
    """
    entry = F.concat_ws("\t", *[f"prev{i}" for i in range(1, order)], "tag")
    maps = cut(model.groupBy("word").agg(F.array_join(F.collect_list(entry), "\t").alias("by")))
    parts = F.transform(F.split("by", "\t", -1), lambda x, i: F.struct(x.alias("tag"), (i % order == order - 1).alias("given")))
    seen = maps.select(F.explode(parts).alias("x")).groupBy("x.tag", "x.given").agg(F.count(F.lit(1)).alias("n")).collect()  # a tagset
    if default is None:
        default = min(((-r.n, r.tag) for r in seen if r.given), default=(0, "NN"))[1]
    codes = _codes(sorted({r.tag for r in seen} | {"<S>"}))
    names = {c: t for t, c in codes.items()}
    by = F.array_join(F.transform(F.split("by", "\t", -1), lambda x: _coded(x, codes)), "")
    known = maps.select("word", by.alias("by"))
    if backoff is not None:
        known = known.join(backoff.select("word", F.col("tag").alias("back")), "word", "full")
        known = known.select("word", F.concat(F.coalesce("by", F.lit("")), F.lit("\0"), F.coalesce("back", F.lit(""))).alias("by"))

    def read(info: str | None) -> tuple[dict[str, str], str]:
        by, _, back = (info or "").partition("\0")
        return {"\t".join(names[c] for c in by[i : i + order - 1]): names[by[i + order - 1]] for i in range(0, len(by), order)}, back or default

    def tag(s: list) -> list[str]:
        return tagging.by_context([x[0] for x in s], order, [x[1] for x in s])

    return _exploded(_sentences(rows, known.withColumnRenamed("by", "info"), "info").withColumn("tags", _arrow(read, tag)("s.info")))


def affix_last_train(rows: DataFrame, size: int = 3, suffix: bool = True) -> DataFrame:
    """G7 as the reference has it: affix and the tag seen last, by sentence and position."""
    affix = F.right("word", F.lit(size)) if suffix else F.left("word", F.lit(size))
    seen = rows.filter(F.length("word") >= size).select(affix.alias("affix"), "tag", F.struct("sent_id", "pos").alias("at"))
    return seen.groupBy("affix").agg(F.max(F.struct("at", "tag")).alias("m")).select("affix", F.col("m.tag").alias("tag"))


def _tags_of(rows: DataFrame, sentences: DataFrame | None) -> DataFrame:
    """t: the tags of each sentence, in order."""
    if sentences is not None:
        return sentences.select(F.col("s.tag").alias("t"))
    return rows.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag")))["tag"].alias("t"))


def _moves(tags: DataFrame, order: int) -> list:
    """Counts of order consecutive tags with marks at both ends, brought to the driver: bounded by MOST_TAGS."""
    marked = tags.select(F.when(F.size("t") > 0, F.concat(F.array_repeat(F.lit("<S>"), order - 1), "t", F.array(F.lit("<E>")))).alias("t"))
    shifted = lambda k: F.slice("t", k + 1, F.size("t") - order + 1)
    grams = shifted(0)
    for k in range(1, order):  # a text of two tags or more: counted faster than arrays, and told apart by its tabs
        grams = F.zip_with(grams, shifted(k), lambda a, b: F.concat(a, F.lit("\t"), b))
    counted = cut(marked.select(F.explode(grams).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).select(F.split("g", "\t", -1).alias("g"), "n"))
    kinds = counted.select(F.explode("g").alias("tag")).filter(~F.col("tag").isin("<S>", "<E>")).distinct().limit(MOST_TAGS + 1).count()
    if kinds > MOST_TAGS:
        raise ValueError(f"more than {MOST_TAGS} tags")
    return counted.collect()


def tnt_train(rows: DataFrame, sentences: DataFrame | None = None) -> tuple[tagging.Tnt, DataFrame]:
    """Transitions, and emissions (tag, word, n). sentences: the same as arrays (s: array of word, tag), so that no token is shuffled."""
    return _tnt(_moves(_tags_of(rows, sentences), 3)), emission_counts(rows)


def _tnt(grams: list) -> tagging.Tnt:
    tags = sorted({t for r in grams for t in r.g} | {"<S>", "<E>"})
    at = {t: i for i, t in enumerate(tags)}
    n = len(tags)
    uni, bi, tri = np.zeros(n), np.zeros((n, n)), np.zeros((n, n, n))
    for r in grams:
        a, b, c = (at[t] for t in r.g)
        tri[a, b, c] += r.n
        bi[a, b] += r.n
        uni[c] += r.n
    return tagging.Tnt(tags, uni, bi, tri)


def tnt_tag(rows: DataFrame, model: tuple[tagging.Tnt, DataFrame]) -> DataFrame:
    tnt, emissions = model
    codes = _codes(tnt.tags)
    names = {c: t for t, c in codes.items()}
    maps = cut(_tag_maps(emissions, codes))
    low = maps.select(F.lower("word").alias("low")).distinct().withColumn("known", F.lit("1"))
    words = rows.select("word").distinct().withColumn("low", F.lower("word")).join(low, "low", "left").join(maps, "word", "left")
    by_word = words.select("word", F.concat(F.coalesce("known", F.lit("0")), F.coalesce("info", F.lit(""))).alias("info"))
    read = lambda info: tnt.emission(_uncoded(info[1:], names) or None, info[0] == "1")
    return _exploded(_sentences(rows, by_word, "info").withColumn("tags", _arrow(read, tnt.path)("s.info")))


def hmm_train(rows: DataFrame, sentences: DataFrame | None = None) -> tuple[tagging.Hmm, DataFrame]:
    """Transitions and emissions; without rows it raises. sentences: as in ``tnt_train``."""
    return _hmm(_moves(_tags_of(rows, sentences), 2)), emission_counts(rows)


def _hmm(grams: list) -> tagging.Hmm:
    tags = sorted({t for r in grams for t in r.g} - {"<S>", "<E>"})
    if not tags:
        raise ValueError("no training data")
    at = {t: i for i, t in enumerate(tags)} | {"<S>": len(tags), "<E>": len(tags)}
    moves, uses = np.zeros((len(tags) + 1, len(tags) + 1)), np.zeros(len(tags))
    for r in grams:
        moves[at[r.g[0]], at[r.g[1]]] += r.n
        if r.g[1] != "<E>":
            uses[at[r.g[1]]] += r.n
    return tagging.Hmm(tags, moves, uses)


def hmm_tag(rows: DataFrame, model: tuple[tagging.Hmm, DataFrame]) -> DataFrame:
    hmm, emissions = model
    codes = _codes(hmm.tags)
    names = {c: t for t, c in codes.items()}
    read = lambda info: hmm.emission(_uncoded(info, names) if info else None)
    return _exploded(_sentences(rows, _tag_maps(emissions, codes), "info").withColumn("tags", _arrow(read, hmm.path)("s.info")))


#: Tokens that the perceptron is trained on at most: whole sentences in order of a hash of their id. Its weights, which this
#: bounds, go to every task.
PERCEPTRON_TOKENS = 200_000


def perceptron_train(rows: DataFrame, rounds: int = 5, most: int = PERCEPTRON_TOKENS, seed: int = 1) -> tagging.Perceptron:
    """G1's trainer: the published averaged perceptron on a bounded sample of sentences."""
    sizes = rows.groupBy("sent_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("sent_id", F.lit(seed)))
    share = min(1.0, most / max(1, rows.count()))
    chosen = sizes.filter(F.col("h") / float(1 << 64) + 0.5 <= share).select("sent_id")
    own = rows.join(chosen, "sent_id", "left_semi").groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "tag"))).alias("s"))
    return tagging.train([[(x.word, x.tag) for x in r.s] for r in own.orderBy("sent_id").collect()], rounds, seed)


def perceptron_tables(spark: SparkSession, model: tagging.Perceptron) -> dict[str, DataFrame]:
    """The model as tables: weights (feature, tag, weight), tagdict (word, tag), classes (place, tag)."""
    weights = [(f, t, x) for f, by in model.weights.items() for t, x in by.items()]
    return {
        "weights": spark.createDataFrame(weights, "feature string, tag string, weight double"),
        "tagdict": spark.createDataFrame(list(model.tagdict.items()), "word string, tag string"),
        "classes": spark.createDataFrame(list(enumerate(model.classes)), "place int, tag string"),
    }


def save_perceptron(spark: SparkSession, model: tagging.Perceptron, path: str) -> None:
    for name, df in perceptron_tables(spark, model).items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def load_perceptron(spark: SparkSession, path: str) -> tagging.Perceptron:
    """From tables or, if path ends in .json, from a JSON object of weights, tagdict and classes; never unpickled."""
    if path.endswith(".json"):
        with open(path) as f:
            x = json.load(f)
        return tagging.Perceptron(x["weights"], x.get("tagdict", {}), x["classes"])
    weights: dict[str, dict[str, float]] = {}
    for r in spark.read.parquet(f"{path}/weights").collect():
        weights.setdefault(r.feature, {})[r.tag] = r.weight
    tagdict = {r.word: r.tag for r in spark.read.parquet(f"{path}/tagdict").collect()}
    return tagging.Perceptron(weights, tagdict, [r.tag for r in spark.read.parquet(f"{path}/classes").orderBy("place").collect()])


def pos_tag(tokens: Column, model: tagging.Perceptron, tagset: dict[str, str] | None = None) -> Column:
    """An array of words -> array of (word, tag); tagset maps the model's tags to others."""
    to = (tagset or {}).get

    @F.arrow_udf("array<string>")
    def run(sentences: pa.Array) -> pa.Array:
        return pa.array([None if s is None else [to(t, t) for t in model.tag(s)] for s in sentences.to_pylist()], pa.list_(pa.string()))

    return F.arrays_zip(tokens.alias("word"), run(tokens).alias("tag"))


def untag(tagged: Column) -> Column:
    """L3: the words of an array of (word, tag)."""
    return F.transform(tagged, lambda x: x["word"])

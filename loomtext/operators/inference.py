"""Lexicons, discourse threads and closed-world reasoning as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.functions import arrow


def ccg_parse(sentences: DataFrame, lexicon: DataFrame, longest: int = 20) -> DataFrame:
    """A2, A4: sentences (sent_id, pos, word) and a lexicon (word, category, duplicates kept) -> sent_id, derivations."""
    known = lexicon.groupBy("word").agg(F.array_sort(F.collect_list("category")).alias("categories"))
    rows = sentences.select("sent_id", "pos", "word").join(known, "word", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))
    s = rows.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "categories"))).alias("s"))
    return s.select("sent_id", arrow.ccg_derivations(F.col("s.word"), F.col("s.categories"), longest).alias("derivations"))


def ccg_lookup(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    """A2: word, category for each entry of the asked words; unknown words have none."""
    return words.select("word").distinct().join(lexicon.select("word", "category"), "word")


def threads(rows: DataFrame, thread: str = "thread", turn: str = "turn", drs: str = "drs") -> DataFrame:
    """Thread, n, drss (in order of turn), merged, fol."""
    s = rows.groupBy(thread).agg(F.array_sort(F.collect_list(F.struct(turn, drs)))[drs].alias("drss"))
    made = s.select(thread, "drss", arrow.merged_and_formula(F.col("drss")).alias("m"))
    return made.select(thread, F.size("drss").alias("n"), "drss", "m.merged", "m.fol")


def closed_world(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked (fact) with holds: whether it is among the facts; what isn't is false."""
    known = facts.select("fact").distinct().withColumn("holds", F.lit(True))
    return asked.join(known, "fact", "left").withColumn("holds", F.coalesce("holds", F.lit(False)))


def negative_facts(facts: DataFrame, universe: DataFrame) -> DataFrame:
    """Negations of the atoms of a universe (fact) that aren't facts."""
    return universe.select("fact").distinct().join(facts.select("fact"), "fact", "left_anti").select(F.concat(F.lit("~"), "fact").alias("fact"))


def default_step(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """I5 as a plan, one round: facts with the consequents of the rules (prerequisite, justification, consequent) that apply."""
    negated: Column = F.regexp_extract("fact", "^[~-](.*)$", 1)
    blocked = facts.select(negated.alias("justification")).filter("justification <> ''").distinct()
    open_ = rules.join(blocked, "justification", "left_anti")
    met = open_.join(facts.select(F.col("fact").alias("prerequisite")).distinct(), "prerequisite", "left_semi").select("consequent")
    free = open_.filter("prerequisite = ''").select("consequent")
    return facts.select("fact").unionByName(met.unionByName(free).select(F.col("consequent").alias("fact"))).distinct()

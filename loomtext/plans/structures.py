"""Registered queries of the kernels: treebank tokens, multi-word expressions, string similarity, parsing, trees, chunks, chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import arrow, tokenizers
from loomtext.plans.models import PATTERNS, table
from loomtext.plans.tokens import documents


def respond(text: Column, pairs: list[tuple[str, list[str]]], seed: int = 0, fallback: str = "I don't understand.") -> Column:
    """V6: struct(response, rule) of the first pattern found anywhere; of several responses a hash of the text picks one."""
    out = F.struct(F.lit(fallback).alias("response"), F.lit(-1).alias("rule"))
    for i in reversed(range(len(pairs))):
        pattern, answers = pairs[i]
        pick = F.array(*map(F.lit, answers))[F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(len(answers))).cast("int")] if len(answers) > 1 else F.lit(answers[0])
        out = F.when(text.rlike(pattern), F.struct(pick.alias("response"), F.lit(i).alias("rule"))).otherwise(out)
    return out


def _treebank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(arrow.treebank_tokens(F.col("text"))).alias("pos", "token"))


def _punkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(arrow.punkt_sentences(F.col("text"), ["dr", "mr", "mrs", "e.g", "i.e"], ["the", "he", "she", "it"])).alias("pos", "token"))


def _mwe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = arrow.mwe_tokens(tokenizers.words(F.lower(F.col("text"))), [["of", "the"], ["in", "the"], ["in", "the", "and"]])
    return documents(spark, sf_dir).select("doc_id", F.posexplode(got).alias("pos", "token"))


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(arrow.jaro_similarity(a, b), 6).alias("jaro"), F.round(arrow.jaro_winkler_similarity(a, b), 6).alias("jaro_winkler"), arrow.edit_distance(a, b, 2, True).alias("edit"))


GRAMMAR = """S -> P P | P S
P -> 'F' | 'O' | 'P'"""


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states of all orders of a customer, by order key, as a sentence."""
    orders = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus")))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(orders["o_orderstatus"].alias("w"))
    return rows.select("o_custkey", F.explode(arrow.parses(F.col("w"), GRAMMAR)).alias("tree"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _parsed(spark, sf_dir).select("o_custkey", F.explode(arrow.tree_nodes(F.col("tree"))).alias("n"))
    return got.select("o_custkey", "n.*")


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.lit("NN")
    word = tokenizers.words(F.lower(F.col("text")))

    def tagged(x: Column) -> Column:
        out = tag
        for pattern, t in reversed(PATTERNS):
            out = F.when(x.rlike(pattern), t).otherwise(out)
        return F.struct(x.alias("word"), out.alias("tag"))

    rows = documents(spark, sf_dir).select("doc_id", F.transform(word, tagged).alias("t"))
    return rows.select("doc_id", F.posexplode(arrow.chunks(F.col("t"), "NP: {<VB.*>?<NN.*>+}\nADV: {<RB>}")).alias("pos", "iob"))


PAIRS = [("\\?", ["Good question."]), ("(?i)\\bthe\\b", ["Which one?"]), ("^.{0,40}$", ["Go on."])]


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.withColumn("r", respond(F.col("text"), PAIRS)).select("conv_id", "turn", "r.response", "r.rule")


CATALOG = {
    "tokenize_treebank": (_treebank, None),
    "tokenize_punkt": (_punkt, None),
    "tokenize_mwe": (_mwe, None),
    "metrics_similarity": (_similar, None),
    "parse_cfg": (_parsed, None),
    "tree_nodes": (_nodes, None),
    "chunk": (_chunked, None),
    "chat": (_chat, r"SELECT conv_id, turn, CASE WHEN contains(text, '?') THEN 'Good question.' WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') THEN 'Which one?' WHEN length(text) <= 40 AND NOT contains(text, chr(10)) THEN 'Go on.' ELSE 'I don''t understand.' END AS response, (CASE WHEN contains(text, '?') THEN 0 WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])') THEN 1 WHEN length(text) <= 40 AND NOT contains(text, chr(10)) THEN 2 ELSE -1 END)::INTEGER AS rule FROM conversations"),
}

"""Corpus readers (S1 - S11): folders of text files as DataFrames (fileid, text), one row a file."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import arrow, tokenizers


def plaintext(spark: SparkSession, root: str, fileids: Iterable[str] | None = None) -> DataFrame:
    """Fileid, text of the files of a folder (not of folders in it), or of some of them. A missing local folder raises."""
    if "://" not in root and not os.path.isdir(root):
        raise ValueError(f"no folder {root}")
    rows = spark.read.text(root if fileids is None else [f"{root.rstrip('/')}/{f}" for f in fileids], wholetext=True)
    return rows.select(F.col("_metadata.file_name").alias("fileid"), F.col("value").alias("text"))


def fileids(corpus: DataFrame) -> DataFrame:
    """Sorted."""
    return corpus.select("fileid").distinct().orderBy("fileid")


def words(corpus: DataFrame, *keep: str) -> DataFrame:
    """Fileid, pos, word: treebank tokens of each whole file."""
    return corpus.select("fileid", *keep, F.posexplode(arrow.treebank_tokens(F.col("text"))).alias("pos", "word"))


def sents(corpus: DataFrame, *keep: str) -> DataFrame:
    """Fileid, sent, words (array)."""
    cut = corpus.select("fileid", *keep, F.posexplode(tokenizers.sentences(F.col("text"))).alias("sent", "text"))
    return cut.select("fileid", *keep, "sent", arrow.treebank_tokens(F.col("text")).alias("words"))


def paras(corpus: DataFrame) -> DataFrame:
    """Fileid, para, sent, words."""
    blocks = corpus.select("fileid", F.posexplode(tokenizers.blank_lines(F.col("text"))).alias("para", "text"))
    cut = blocks.select("fileid", "para", F.posexplode(tokenizers.sentences(F.col("text"))).alias("sent", "text"))
    return cut.select("fileid", "para", "sent", arrow.treebank_tokens(F.col("text")).alias("words"))


def sizes(corpus: DataFrame) -> DataFrame:
    """Fileid, word_count, sent_count."""
    return corpus.select("fileid", F.size(arrow.treebank_tokens(F.col("text"))).cast("bigint").alias("word_count"), F.size(tokenizers.sentences(F.col("text"))).cast("bigint").alias("sent_count"))


def _tagged(line: Column, sep: str) -> Column:
    """word and tag of the tokens that have a separator, at the last of which they are cut."""
    tokens = F.filter(tokenizers.whitespace(line), lambda t: t.contains(sep))
    end = lambda t: F.substring_index(t, sep, -1)
    return F.transform(tokens, lambda t: F.struct(F.left(t, F.length(t) - F.length(end(t)) - len(sep)).alias("word"), end(t).alias("tag")))


def tagged_sents(corpus: DataFrame, sep: str = "/") -> DataFrame:
    """Fileid, line, tagged (array of word, tag): one row for each line that isn't blank."""
    lines = corpus.select("fileid", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return lines.filter(~tokenizers.blank(F.col("text"))).select("fileid", "line", _tagged(F.col("text"), sep).alias("tagged"))


def tagged_words(corpus: DataFrame, sep: str = "/") -> DataFrame:
    """Fileid, pos, word, tag."""
    got = corpus.select("fileid", F.posexplode(_tagged(F.col("text"), sep)).alias("pos", "t"))
    return got.select("fileid", "pos", "t.word", "t.tag")


def words_of_tagged(corpus: DataFrame, sep: str = "/") -> DataFrame:
    """Fileid, pos, word."""
    return tagged_words(corpus, sep).drop("tag")


def categorised(spark: SparkSession, root: str, categories: Mapping[str, Iterable[str]]) -> DataFrame:
    """Category, fileid, text: one row for each category of each file. words and sents take "category" as a further column."""
    pairs = [(c, f) for c, fs in categories.items() for f in fs]
    table = spark.createDataFrame(pairs, "category string, fileid string")
    return plaintext(spark, root, sorted({f for _, f in pairs})).join(F.broadcast(table), "fileid").select("category", "fileid", "text")


def categories(corpus: DataFrame) -> DataFrame:
    """Sorted."""
    return corpus.select("category").distinct().orderBy("category")


def find(name: str, folders: Iterable[str] = ()) -> str:
    """The path of a resource in the first folder that has it: those given, LOOMTEXT_DATA's, the home's, /usr/share, /usr/local/share."""
    asked = [*folders, *os.environ.get("LOOMTEXT_DATA", "").split(os.pathsep), os.path.expanduser("~/loomtext_data"), "/usr/share/loomtext_data", "/usr/local/share/loomtext_data"]
    for folder in filter(None, asked):
        if os.path.exists(path := os.path.join(folder, name)):
            return path
    raise LookupError(name)

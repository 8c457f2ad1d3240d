"""Stemmers: rule chains as Catalyst expressions, Porter's as an Arrow function. Use them on distinct words."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.kernels import stems


def regexp_stem(word: Column, min_length: int = 4) -> Column:
    """M4: one of eight English endings goes from words of more bytes than min_length."""
    return F.when(F.octet_length(word) > min_length, F.regexp_replace(word, "(?i)(ing|ed|s|ly|ness|ment|tion|able)$", "")).otherwise(word)


def cistem(word: Column) -> Column:
    """M7: lower case; of more than 3 bytes, a leading ge (of more than 5) and the first fitting ending go."""
    w = F.lower(word)
    short = F.octet_length(w) <= 3
    w = F.when(w.startswith("ge") & (F.octet_length(w) > 5), F.substring(w, 3, 1 << 30)).otherwise(w)
    out = w
    for ending in reversed("est et en em er es st t e n s".split()):
        out = F.when(w.endswith(ending) & (F.octet_length(w) - len(ending) > 2), F.regexp_replace(w, f"{ending}$", "")).otherwise(out)
    return F.when(short, F.lower(word)).otherwise(out)


def _first_suffix(w: Column, suffixes: str, least: int) -> Column:
    """w without the first of the suffixes that leaves more than ``least`` bytes."""
    out = w
    for x in reversed(suffixes.split()):
        out = F.when(w.endswith(x) & (F.octet_length(w) > len(x) + least), F.left(w, F.length(w) - len(x))).otherwise(out)
    return out


_RSLP_VERBS = "ou ram mos ndo sse"
_ISRI_SUFFIXES = "huma km kn hm hn na ny at an yn wn h t k n"


def rslp(word: Column) -> Column:
    """M8: of more than 3 bytes, ns becomes n, es (of more than 4) or s but not ss goes, a final a becomes o, one of five verb
    endings goes."""
    low = F.lower(word)
    cut = lambda n: F.left(low, F.length(low) - n)
    w = F.when(low.endswith("ns"), cut(1)).when(low.endswith("es") & (F.octet_length(low) > 4), cut(2)).when(low.endswith("s") & ~low.endswith("ss"), cut(1)).otherwise(low)
    w = F.when(w.endswith("a") & (F.octet_length(w) > 3), F.concat(F.left(w, F.length(w) - 1), F.lit("o"))).otherwise(w)
    return F.when(F.octet_length(low) <= 3, low).otherwise(_first_suffix(w, _RSLP_VERBS, 2))


def isri_transliterated(word: Column) -> Column:
    """M5: of more than 3 bytes, a leading al, one prefix letter and one ending of transliterated Arabic go."""
    low = F.lower(F.trim(word))
    w = F.when(low.startswith("al") & (F.octet_length(low) > 4), F.substring(low, 3, 1 << 30)).otherwise(low)
    w = F.when(w.rlike("^[wfblytns]") & (F.octet_length(w) > 3), F.substring(w, 2, 1 << 30)).otherwise(w)
    w = _first_suffix(w, _ISRI_SUFFIXES, 2)
    return F.when((F.octet_length(low) <= 3) | (F.octet_length(w) < 2), low).otherwise(w)


def _by_word(stem: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.arrow_udf(T.StringType())
    def run(words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()
        return pa.array([stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)

    return run


def lancaster(word: Column) -> Column:
    """M2."""
    return _by_word(stems.lancaster)(word)


def snowball(word: Column, language: str = "english") -> Column:
    """M3: English, German, Swedish, Norwegian or Danish."""
    return _by_word(stems.snowball(language))(word)


def arlstem(word: Column, second: bool = False) -> Column:
    """M10; second: M11."""
    return _by_word(lambda w: stems.arlstem(w, second))(word)


#: Suffix rules of the WordNet lemmatizer by part of speech, in the order in which they are tried.
MORPHY = {
    "n": [("s", ""), ("ses", "x"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "v": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "a": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
    "r": [],
}


def lemmatize(words: DataFrame, lexicon: DataFrame, exceptions: DataFrame, word: str = "word", pos: str = "pos") -> DataFrame:
    """Words with a column lemma. lexicon: pos, word; exceptions: pos, form, base.

    An exception's base, else the first suffix rule whose result, or that without its doubled last letter, is in the lexicon, else
    the word (in lower case if the lexicon has that). The candidates of the distinct words are joined, not the words' rows.
    """
    low = F.lower(word)
    rules = F.array().cast("array<struct<rank:int,form:string>>")
    for p, table in MORPHY.items():
        made = []
        for i, (end, to) in enumerate(table):
            form = F.concat(F.left(low, F.length(low) - len(end)), F.lit(to))
            fits = low.endswith(end) & (F.length(low) > len(end))
            made.append(F.when(fits, F.struct(F.lit(2 * i).alias("rank"), form.alias("form"))))
            twice = (F.length(form) > 1) & (F.right(form, F.lit(1)) == F.left(F.right(form, F.lit(2)), F.lit(1)))
            made.append(F.when(fits & twice, F.struct(F.lit(2 * i + 1).alias("rank"), F.left(form, F.length(form) - 1).alias("form"))))
        made.append(F.struct(F.lit(1000).alias("rank"), low.alias("form")))
        rules = F.when(F.col(pos) == p, F.filter(F.array(*made), lambda x: x.isNotNull())).otherwise(rules)
    kinds = words.select(word, pos).distinct()
    known = exceptions.select(F.col("pos").alias(pos), F.lower("form").alias("form"), F.struct(F.lit(-1).alias("rank"), F.lower("base").alias("form")).alias("best"))
    by_table = kinds.withColumn("form", low).join(known, [pos, "form"]).select(word, pos, "best")
    tried = kinds.select(word, pos, F.explode(rules).alias("best")).withColumn("form", F.col("best.form"))
    found = tried.join(lexicon.select(F.col("pos").alias(pos), F.lower("word").alias("form")).distinct(), [pos, "form"], "left_semi").select(word, pos, "best")
    lemmas = by_table.unionByName(found).groupBy(word, pos).agg(F.min("best").alias("best"))
    return words.join(lemmas, [word, pos], "left").withColumn("lemma", F.coalesce("best.form", word)).drop("best")


# ---------------------------------------------------------------- Porter (1980), as published

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]


_NO_VOWEL, _VOWEL = re.compile("[^aeiou]"), re.compile("[aeiou]")


def _shape(w: str) -> str:
    if "y" not in w:
        return "".join("v" if c in "aeiou" else "c" for c in w) if len(w) < 6 else _VOWEL.sub("v", _NO_VOWEL.sub("c", w))
    out = ""
    for i, c in enumerate(w):
        out += "v" if c in "aeiou" or (c == "y" and i and out[-1] == "c") else "c"
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _short(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def _longest(w: str, rules: dict[str, str]) -> str:
    for end in sorted(rules, key=len, reverse=True):
        if w.endswith(end):
            return w[: -len(end)] + rules[end] if _measure(w[: -len(end)]) > 0 else w
    return w


def porter_word(word: str) -> str:
    w = word.lower()
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _longest(_longest(w, _STEP2), _STEP3)
    for end in _STEP4:
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.arrow_udf(T.StringType())
def porter(words: pa.Array) -> pa.Array:
    """M1, published form."""
    return pa.array([None if w is None else porter_word(w) for w in words.to_pylist()], pa.string())

"""Rule-based sentiment (V1) as Catalyst expressions: array functions over a text's words, lexicon and boosters as map literals."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(text: str) -> dict[str, float]:
    parts = text.split()
    return dict(zip(parts[::2], map(float, parts[1::2])))


#: A small sample of the published lexicon, by default; any other map will do.
LEXICON = _pairs(
    "amazing 2.8 angry -2.3 awesome 3.1 awful -2.0 bad -2.5 beautiful 2.9 best 3.2 better 1.9 boring -1.3 cry -2.1 disgusting -2.4 enjoy 2.2 excellent 2.7 fantastic 2.6 "
    "glad 2.0 good 1.9 great 3.1 happy 2.7 hate -2.7 horrible -2.5 hurt -2.4 impressed 2.1 like 1.5 love 3.2 miss -0.6 nice 1.8 okay 0.9 pain -2.3 perfect 2.7 pleased 1.9 "
    "problem -1.7 sad -2.1 sorry -0.3 stupid -2.4 terrible -2.1 thank 1.5 thanks 1.9 ugly -2.3 wonderful 2.7 worst -3.1"
)
STEP = 0.293
_MORE = (
    "absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely especially exceptionally extremely fabulously flipping flippin fricking frickin frigging friggin fully fucking "
    "greatly hella highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly totally tremendously uber unbelievably unusually utterly very"
).split()
_LESS = "almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely slightly somewhat sorta sortof sort-of".split()
BOOSTERS = dict.fromkeys(_MORE, STEP) | dict.fromkeys(_LESS, -STEP)
NEGATORS = sorted(
    {"despite", "neither", "never", "none", "nope", "nor", "not", "nothing", "nowhere", "rarely", "seldom", "uh-uh", "uhuh", "without", "cannot", "cant", "wont", "shant", "aint"}
    | {f"{w}nt" for w in "are could dare did does do had has have is might must need ought should was were would".split()}
)
CAPS, NEGATED, BUT_BEFORE, BUT_AFTER, BANG, NORM = 0.733, -0.74, 0.5, 1.5, 0.292, 15.0
#: Words: runs of letters, digits and underscores, also with one apostrophe, dot or colon between letters, or dot or comma between digits.
WORD = r"[\p{L}\p{M}\p{N}_]+(?:['’.:·]\p{L}[\p{L}\p{M}\p{N}_]*|[.,;']\p{N}+)*"


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(sorted(values.items()))])


def words(text: Column) -> Column:
    """Words of more than one byte."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lambda w: F.octet_length(w) > 1)


def _one(x: Column, i: Column, w: Column, mixed: Column) -> Column:
    caps = mixed & x["word"].rlike(r"\p{Lu}") & ~x["word"].rlike(r"\p{Ll}") & (F.abs(x["v"]) >= 1.0)
    v = x["v"] + F.when(caps, F.signum(x["v"]) * CAPS).otherwise(0.0)
    for back, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
        p = F.get(w, i - back)
        plain = (i >= back) & p["v"].isNull()
        v = v + F.when(plain, F.when(v < 0, -p["s"]).otherwise(p["s"]) * damp).otherwise(0.0)
        v = v * F.when(plain & p["n"], NEGATED).otherwise(1.0)
    return F.when(x["v"].isNotNull(), v).otherwise(0.0)


def polarity_scores(rows: DataFrame, text: str = "text", lexicon: dict[str, float] = LEXICON) -> DataFrame:
    """V1: rows with neg, neu, pos and compound. A text without words is neutral; a null text has null scores.

    The words are a column of their own, as each looks at the three before it.
    """
    lex, boost = _map(lexicon), _map(BOOSTERS)

    def known(x: Column) -> Column:
        low = F.lower(x)
        return F.struct(x.alias("word"), F.element_at(lex, low).alias("v"), F.coalesce(F.element_at(boost, low), F.lit(0.0)).alias("s"), (low.isin(NEGATORS) | low.endswith("n't")).alias("n"))

    total = lambda f: F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + f(x))
    got = rows.withColumn("_w", F.transform(words(F.col(text)), known))
    got = got.withColumn("_mixed", F.exists("_w", lambda x: x["word"].rlike(r"\p{Lu}")) & F.exists("_w", lambda x: x["word"].rlike(r"\p{Ll}")))
    got = got.withColumn("_but", F.array_position(F.transform("_w", lambda x: F.lower(x["word"])), "but").cast("int") - 1)
    weight = lambda i: F.when(F.col("_but") < 0, 1.0).when(i < F.col("_but"), BUT_BEFORE).when(i > F.col("_but"), BUT_AFTER).otherwise(1.0)
    got = got.withColumn("_v", F.transform("_w", lambda x, i: _one(x, i, F.col("_w"), F.col("_mixed")) * weight(i)))
    got = got.withColumn("_bang", F.lit(BANG) * (F.length(text) - F.length(F.replace(F.col(text), F.lit("!"), F.lit("")))))
    got = got.withColumns({
        "_sum": total(lambda x: x), "_pos": total(lambda x: F.when(x > 0, x + 1).otherwise(0.0)),
        "_neg": -total(lambda x: F.when(x < 0, x - 1).otherwise(0.0)), "_neu": total(lambda x: F.when(x == 0, 1.0).otherwise(0.0)),
    })
    got = got.withColumns({"_sum": F.col("_sum") + F.signum("_sum") * F.col("_bang"), "_up": F.col("_pos") + F.when(F.col("_pos") > F.col("_neg"), F.col("_bang")).otherwise(0.0)})
    got = got.withColumn("_down", F.col("_neg") + F.when(F.col("_neg") > F.col("_up"), F.col("_bang")).otherwise(0.0))
    whole = F.col("_up") + F.col("_down") + F.col("_neu")
    part = lambda c, none: F.when(whole > 0, F.round(F.col(c) / whole, 3)).when(F.col(text).isNotNull(), none)
    compound = F.when(F.col(text).isNotNull(), F.round(F.col("_sum") / F.sqrt(F.col("_sum") * F.col("_sum") + NORM), 4))
    return got.select(*rows.columns, part("_down", 0.0).alias("neg"), part("_neu", 1.0).alias("neu"), part("_up", 0.0).alias("pos"), compound.alias("compound"))


def polarity_sql(table: str, key: str, text: str = "text") -> str:
    """The same in SQL."""
    pairs = lambda d: ", ".join(f"'{k}': {v}::DOUBLE" for k, v in sorted(d.items()))
    names = ", ".join("'" + n.replace("'", "''") + "'" for n in NEGATORS)
    word = WORD.replace("'", "''")
    v = f"x.v + CASE WHEN mixed AND x.up AND NOT x.low_ AND abs(x.v) >= 1 THEN sign(x.v) * {CAPS} ELSE 0 END"
    steps = f"SELECT *, {v} AS v0 FROM flat"
    for back, damp in ((1, 1.0), (2, 0.95), (3, 0.9)):
        p = f"w[i - {back}]"
        before = f"v{back - 1}"
        plain = f"(i > {back} AND {p}.v IS NULL)"
        steps = f"SELECT *, ({before} + CASE WHEN {plain} THEN CASE WHEN {before} < 0 THEN -{p}.s ELSE {p}.s END * {damp} ELSE 0 END) * CASE WHEN {plain} AND {p}.n THEN {NEGATED} ELSE 1 END AS v{back} FROM ({steps})"
    return f"""WITH m AS (SELECT MAP {{{pairs(LEXICON)}}} AS lex, MAP {{{pairs(BOOSTERS)}}} AS boost),
raw AS (SELECT {key}, {text} AS text, list_filter(regexp_extract_all({text}, '{word}'), lambda w: strlen(w) > 1) AS words FROM {table}),
known AS (SELECT {key}, text, list_transform(words, lambda w: {{'v': lex[lower(w)], 's': coalesce(boost[lower(w)], 0.0::DOUBLE), 'n': lower(w) IN ({names}) OR lower(w) LIKE '%n''t', 'up': regexp_matches(w, '\\p{{Lu}}'), 'low_': regexp_matches(w, '\\p{{Ll}}')}}) AS w,
  list_position(list_transform(words, lambda w: lower(w)), 'but') AS but FROM raw, m),
cased AS (SELECT *, len(list_filter(w, lambda x: x.up)) > 0 AND len(list_filter(w, lambda x: x.low_)) > 0 AS mixed FROM known),
flat AS (SELECT *, w[i] AS x FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM cased)),
v AS (SELECT {key}, coalesce(v3, 0) * CASE WHEN coalesce(but, 0) = 0 OR i = but THEN 1 WHEN i < but THEN {BUT_BEFORE} ELSE {BUT_AFTER} END AS v FROM ({steps})),
sums AS (SELECT {key}, sum(v) AS s, sum(CASE WHEN v > 0 THEN v + 1 ELSE 0 END) AS pos, sum(CASE WHEN v < 0 THEN 1 - v ELSE 0 END) AS neg, sum((v = 0)::INT)::DOUBLE AS neu FROM v GROUP BY {key}),
e AS (SELECT {key}, text, coalesce(s, 0) AS s, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg, coalesce(neu, 0) AS neu, {BANG} * (length(text) - length(replace(text, '!', ''))) AS bang FROM raw LEFT JOIN sums USING ({key})),
f AS (SELECT *, s + sign(s) * bang AS t, pos + CASE WHEN pos > neg THEN bang ELSE 0 END AS up FROM e),
g AS (SELECT *, neg + CASE WHEN neg > up THEN bang ELSE 0 END AS down FROM f)
SELECT {key}, (CASE WHEN up + down + neu > 0 THEN round(down / (up + down + neu), 3) ELSE 0 END)::DOUBLE AS neg, (CASE WHEN up + down + neu > 0 THEN round(neu / (up + down + neu), 3) ELSE 1 END)::DOUBLE AS neu,
  (CASE WHEN up + down + neu > 0 THEN round(up / (up + down + neu), 3) ELSE 0 END)::DOUBLE AS pos, round(t / sqrt(t * t + {NORM}), 4)::DOUBLE AS compound FROM g"""

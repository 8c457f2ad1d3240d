"""Registered queries of the tokenizers, n-grams and rule stemmers, over all documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import arrow, stemmers, tokenizers
from loomtext.sources.tables import table

CLASS = r"[\p{L}\p{M}\p{N}_]"
Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _flat(tokens: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))

    return query


def _flat_sql(array: str, source: str = "documents") -> str:
    return f"WITH t AS (SELECT doc_id, {array} AS a FROM {source}) SELECT doc_id, (generate_subscripts(a, 1) - 1)::INTEGER AS pos, unnest(a) AS token FROM t WHERE len(a) > 0"


def _char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: its characters with their numbers and the sums of their places."""
    got = documents(spark, sf_dir).select("doc_id", F.posexplode(tokenizers.chars(F.col("text"))).alias("pos", "token"))
    return got.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("places"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = documents(spark, sf_dir).select("doc_id", F.explode(arrow.spans(F.col("text"), "\n", gaps=True)).alias("s"))
    return got.select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))


def _ngrams(n: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = F.lower(F.col("text"))
        g = documents(spark, sf_dir).select(tokenizers.words(w).alias("t")).select(F.explode(tokenizers.ngrams(F.col("t"), n)).alias("g"))
        return g.groupBy(F.array_join("g", " ").alias("ngram")).agg(F.count(F.lit(1)).alias("n"))

    return query


def _ngrams_sql(n: int) -> str:
    return f"""WITH w AS (SELECT regexp_extract_all(lower(text), '{CLASS}+') AS w FROM documents),
g AS (SELECT unnest(list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) AS ngram FROM w)
SELECT ngram, count(*) AS n FROM g GROUP BY ngram"""


def _everygrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs are told apart as texts, which are hashed, where arrays would be compared each with each; no word has a space."""
    t = documents(spark, sf_dir).select("doc_id", tokenizers.pad(tokenizers.words(F.lower(F.col("text"))), 2).alias("t"))
    pairs = t.select("doc_id", "t", F.transform(tokenizers.ngrams(F.col("t"), 2), lambda g: F.array_join(g, " ")).alias("p"))
    kinds = F.concat(F.array_distinct("t"), F.array_distinct("p"))
    return pairs.select("doc_id", F.size(F.concat("t", "p")).cast("bigint").alias("n"), F.size(kinds).cast("bigint").alias("kinds"))


def _stemmed(stem: Callable[[Column], Column]) -> Query:
    """Over distinct words: the vocabulary is far smaller than the text."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = documents(spark, sf_dir).select(F.explode(tokenizers.words(F.lower(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        return words.select("word", "n", stem(F.col("word")).alias("stem"))

    return query


def _stemmed_sql(stem: str) -> str:
    return f"WITH v AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{CLASS}+')) AS word FROM documents) GROUP BY word) SELECT word, n, {stem} AS stem FROM v"


def _detokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tokenizers.detokenize(tokenizers.word_punct(F.col("text"))).alias("text"))


_WORD_PUNCT = rf"regexp_extract_all(text, '{CLASS}+|[^\p{{L}}\p{{M}}\p{{N}}_\s]+')"
_NO_SPACE = "('.', ',', '!', '?', ':', ';', ')', ']', '}', '%', '''''', 'n''t', '(', '[', '{', '``')"

def _chain_sql(steps: list[str]) -> str:
    """The distinct words' stem: steps are expressions over word and w, the result of the step before."""
    out = f"SELECT word, count(*) AS n, lower(word) AS w FROM (SELECT unnest(regexp_extract_all(lower(text), '{CLASS}+')) AS word FROM documents) GROUP BY word"
    for x in steps:
        out = f"SELECT * REPLACE ({x} AS w) FROM ({out})"
    return f"SELECT word, n, w AS stem FROM ({out})"


def _suffix_sql(suffixes: str, least: int, when: str = "true") -> str:
    cases = " ".join(f"WHEN w LIKE '%{x}' AND strlen(w) > {len(x) + least} THEN w[:length(w) - {len(x)}]" for x in suffixes.split())
    return f"CASE WHEN NOT ({when}) THEN w {cases} ELSE w END"


_LONG = "strlen(lower(word)) > 3"
_RSLP = [
    f"CASE WHEN NOT {_LONG} THEN w WHEN w LIKE '%ns' THEN w[:-2] WHEN w LIKE '%es' AND strlen(w) > 4 THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END",
    f"CASE WHEN {_LONG} AND w LIKE '%a' AND strlen(w) > 3 THEN w[:-2] || 'o' ELSE w END", _suffix_sql("ou ram mos ndo sse", 2, _LONG),
]
_ISRI = [
    f"CASE WHEN {_LONG} AND w LIKE 'al%' AND strlen(w) > 4 THEN w[3:] ELSE w END", f"CASE WHEN {_LONG} AND regexp_matches(w, '^[wfblytns]') AND strlen(w) > 3 THEN w[2:] ELSE w END",
    _suffix_sql("huma km kn hm hn na ny at an yn wn h t k n", 2, _LONG), "CASE WHEN strlen(w) < 2 THEN lower(word) ELSE w END",
]
_CISTEM = [f"CASE WHEN {_LONG} AND w LIKE 'ge%' AND strlen(w) > 5 THEN w[3:] ELSE w END", _suffix_sql("est et en em er es st t e n s", 2, _LONG)]


def _toktok_sql() -> str:
    out = "text"
    for pattern, to in tokenizers.TOKTOK:
        p, t = (x.replace("'", "''") for x in (pattern, to))
        t = "'" + t.replace("\x01", "' || chr(1) || '").replace("\t", "' || chr(9) || '") + "'"
        p = "'" + p.replace("\t", "' || chr(9) || '") + "'"
        out = f"regexp_replace({out}, {p}, {t}, 'g')"
    parts = f"list_filter(string_split_regex({out}, '[{tokenizers._BLANKS}]+'), lambda x: x <> '')"
    return _flat_sql(f"list_transform({parts}, lambda x: replace(x, chr(1), ','))")


_SHORT_RUNS = "array_to_string(list_transform(list_filter(range(1, length(x) + 1), lambda i: NOT (i > 3 AND x[i] = x[i - 1] AND x[i] = x[i - 2] AND x[i] = x[i - 3])), lambda i: x[i]), '')"
_TWEETS = f"list_transform(list_filter(regexp_extract_all(text, '{tokenizers._TWEET.replace(chr(39), chr(39) * 2)}'), lambda x: NOT (x LIKE '@%' AND strlen(x) > 1)), lambda x: lower(x))"
_NO_MODEL = "list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])([ \\n\"''])', '\\1' || chr(1) || '\\2', 'g'), chr(1) || '[ \\t\\n\\x0B\\f\\r]*', chr(1), 'g'), chr(1)), lambda x: trim(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) <> '')"


def _spans_of(column: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return documents(spark, sf_dir).select("doc_id", F.explode(column(F.col("text"))).alias("s")).select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"))

    return query


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", tokenizers.count_char(t, "a").cast("bigint").alias("n"), tokenizers.blank(t).alias("blank"), tokenizers.collapsed(t).alias("collapsed"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = documents(spark, sf_dir).select("doc_id", arrow.text_tiles(F.col("text"), 10, 4).alias("t"))
    return got.select("doc_id", F.posexplode("t.segments").alias("segment", "text"))


#: A lexicon for the lemmatizer: the documents' frequent words as nouns and verbs, and two exceptions.
def _lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select(F.explode(tokenizers.words(F.lower(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    both = words.crossJoin(F.broadcast(spark.createDataFrame([("n",), ("v",)], "pos string")))
    lexicon = both.filter("n >= 5").select("pos", "word")
    exceptions = spark.createDataFrame([("n", "mice", "mouse"), ("v", "was", "be")], "pos string, form string, base string")
    return stemmers.lemmatize(both, lexicon, exceptions).select("word", "pos", "lemma")


def _lemmas_sql() -> str:
    tries = []
    for pos in ("n", "v"):
        for i, (end, to) in enumerate(stemmers.MORPHY[pos]):
            form = f"(word[:length(word) - {len(end)}] || '{to}')"
            fits = f"pos = '{pos}' AND word LIKE '%{end}' AND length(word) > {len(end)}"
            tries.append(f"SELECT word, pos, {2 * i} AS rank, {form} AS form FROM both_ WHERE {fits}")
            tries.append(f"SELECT word, pos, {2 * i + 1}, {form}[:length({form}) - 1] FROM both_ WHERE {fits} AND length({form}) > 1 AND {form}[-1] = {form}[-2]")
    return f"""WITH words AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '{CLASS}+')) AS word FROM documents) GROUP BY word),
both_ AS (SELECT word, n, pos FROM words, (VALUES ('n'), ('v')) p(pos)), tried AS ({' UNION ALL '.join(tries)} UNION ALL SELECT word, pos, 1000, word FROM both_),
found AS (SELECT t.word, t.pos, rank, form FROM tried t JOIN words l ON l.word = form AND l.n >= 5 UNION ALL SELECT word, pos, -1, CASE word WHEN 'mice' THEN 'mouse' ELSE 'be' END FROM both_ WHERE (word = 'mice' AND pos = 'n') OR (word = 'was' AND pos = 'v')),
best AS (SELECT word, pos, min_by(form, rank) AS form FROM found GROUP BY ALL) SELECT b.word, b.pos, coalesce(form, b.word) AS lemma FROM both_ b LEFT JOIN best USING (word, pos)"""


CATALOG: dict[str, tuple[Query, str | None]] = {
    "tokenize_sentences": (_flat(tokenizers.sentences), _flat_sql(r"list_filter(string_split(regexp_replace(text, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')")),
    "tokenize_sentences_without_model": (_flat(tokenizers.sentences_without_model), _flat_sql(_NO_MODEL)),
    "tokenize_space": (_flat(tokenizers.space), _flat_sql("string_split(text, ' ')")),
    "tokenize_tab": (_flat(tokenizers.tab), _flat_sql("string_split(text, chr(9))")),
    "tokenize_lines": (_flat(tokenizers.lines), _flat_sql("list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x) <> '')")),
    "tokenize_blank_lines": (_flat(tokenizers.blank_lines), _flat_sql(r"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')")),
    "tokenize_chars": (_char_counts, "WITH t AS (SELECT doc_id, string_split(text, '') AS a, text AS text_ FROM documents), e AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, unnest(a) AS token FROM t WHERE text_ <> '') SELECT doc_id, token, count(*) AS n, sum(pos)::BIGINT AS places FROM e GROUP BY ALL"),
    "tokenize_whitespace": (_flat(tokenizers.whitespace), _flat_sql(r"list_filter(string_split_regex(text, '[\s\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+'), lambda x: x <> '')")),
    "tokenize_word_punct": (_flat(tokenizers.word_punct), _flat_sql(_WORD_PUNCT)),
    "tokenize_regexp": (_flat(lambda x: tokenizers.regexp(x, r"[A-Za-z]+")), _flat_sql("regexp_extract_all(text, '[A-Za-z]+')")),
    "tokenize_regexp_gaps": (_flat(lambda x: tokenizers.regexp(x, r"[.,]\s*", gaps=True)), _flat_sql(r"list_filter(string_split_regex(text, '[.,]\s*'), lambda x: x <> '')")),
    "tokenize_tweet": (_flat(lambda x: tokenizers.tweet(x, preserve_case=False, reduce_len=True, strip_handles=True)), _flat_sql(f"list_transform({_TWEETS}, lambda x: {_SHORT_RUNS})")),
    "tokenize_toktok": (_flat(tokenizers.toktok), _toktok_sql()),
    "tokenize_lexer": (_flat(tokenizers.lexer_words), _flat_sql(f"regexp_extract_all(text, '{tokenizers._LEXER.replace(chr(39), chr(39) * 2)}')")),
    "detokenize": (_detokenized, f"WITH t AS (SELECT doc_id, list_transform({_WORD_PUNCT}, lambda x: CASE WHEN x IN {_NO_SPACE} OR x LIKE '''%' THEN x ELSE ' ' || x END) AS a FROM documents), j AS (SELECT doc_id, coalesce(array_to_string(a, ''), '') AS s FROM t) SELECT doc_id, CASE WHEN s LIKE ' %' THEN substr(s, 2) ELSE s END AS text FROM j"),
    "line_spans": (_spans, "WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), p AS (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM t), q AS (SELECT doc_id, len(a[i]) AS n, (coalesce(list_sum(list_transform(a[1:i - 1], lambda x: len(x) + 1)), 0))::INTEGER AS start FROM p) SELECT doc_id, start, (start + n)::INTEGER AS \"end\" FROM q WHERE n > 0"),
    "ngrams_2": (_ngrams(2), _ngrams_sql(2)),
    "ngrams_3": (_ngrams(3), _ngrams_sql(3)),
    "everygrams_padded": (_everygrams, f"WITH w AS (SELECT doc_id, list_concat(['<s>'], regexp_extract_all(lower(text), '{CLASS}+'), ['</s>']) AS w FROM documents), g AS (SELECT doc_id, list_concat(list_transform(range(1, len(w) + 1), lambda i: w[i:i]), list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS g FROM w) SELECT doc_id, len(g)::BIGINT AS n, len(list_distinct(g))::BIGINT AS kinds FROM g"),
    "stem_regexp": (_stemmed(stemmers.regexp_stem), _stemmed_sql("CASE WHEN strlen(word) > 4 THEN regexp_replace(word, '(ing|ed|s|ly|ness|ment|tion|able)$', '', 'i') ELSE word END")),
    "stem_cistem": (_stemmed(stemmers.cistem), _chain_sql(_CISTEM)),
    "stem_rslp": (_stemmed(stemmers.rslp), _chain_sql(_RSLP)),
    "stem_isri": (_stemmed(stemmers.isri_transliterated), _chain_sql(_ISRI)),
    "stem_porter": (_stemmed(stemmers.porter), None),
    "stem_lancaster": (_stemmed(stemmers.lancaster), None),
    "stem_snowball_english": (_stemmed(stemmers.snowball), None),
    "stem_snowball_german": (_stemmed(lambda w: stemmers.snowball(w, "german")), None),
    "stem_arlstem": (_stemmed(stemmers.arlstem), None),
    "stem_arlstem2": (_stemmed(lambda w: stemmers.arlstem(w, True)), None),
    "lemmatize": (_lemmas, _lemmas_sql()),
    "word_tokenize": (_flat(arrow.word_tokenize), None),
    "sent_tokenize": (_flat(lambda x: arrow.sent_tokenize(x, None)), _flat_sql(_NO_MODEL)),
    "tokenize_preserve_line": (_flat(lambda x: arrow.treebank_tokens(x, preserve_line=True)), None),
    "tokenize_regexp_flags": (_flat(lambda x: tokenizers.regexp(x, "[A-Z]+", flags=2 | 256)), _flat_sql("regexp_extract_all(text, '(?i)[A-Z]+')")),
    "treebank_spans": (_spans_of(arrow.treebank_spans), None),
    "regexp_spans": (_spans_of(lambda x: arrow.spans(x, "[A-Za-z]+")), "WITH t AS (SELECT doc_id, string_split_regex(text, '[A-Za-z]+') AS gaps, regexp_extract_all(text, '[A-Za-z]+') AS a FROM documents), p AS (SELECT doc_id, gaps, a, unnest(range(1, len(a) + 1)) AS i FROM t), q AS (SELECT doc_id, len(a[i]) AS n, (sum(len(gaps[i]) + len(a[i])) OVER (PARTITION BY doc_id ORDER BY i) - len(a[i]))::INTEGER AS start FROM p) SELECT doc_id, start, (start + n)::INTEGER AS \"end\" FROM q"),
    "text_tiling": (_tiles, None),
    "string_helpers": (_strings, r"SELECT doc_id, (length(text) - length(replace(text, 'a', '')))::BIGINT AS n, regexp_full_match(text, '[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*') AS blank, regexp_replace(text, '[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g') AS collapsed FROM documents"),
}

"""Registered queries of sequential taggers, maximum entropy, language identification, point scores, sentiment, corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import sentiment
from loomtext.operators import classify, counts, language_models, taggers
from loomtext.plans import models
from loomtext.plans.models import CLASS, table, words
from loomtext.plans.tokens import documents
from loomtext.sources import corpora


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of all conversations as sentences, tagged by the form of their words."""
    t = table(spark, sf_dir, "conversations").withColumn("sent_id", F.concat_ws(":", "conv_id", "turn"))
    rows = t.select("sent_id", F.posexplode(words()).alias("pos", "word"))
    return taggers.regexp_tag(rows, models.PATTERNS, "NN")


def _context(order: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return taggers.context_tag(_turns(spark, sf_dir), taggers.context_train_sentences(models._tagged_arrays(spark, sf_dir), order), order)

    return query


def _tnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taggers.tnt_tag(_turns(spark, sf_dir), taggers.tnt_train(models._tagged(spark, sf_dir), models._tagged_arrays(spark, sf_dir)))


def _hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taggers.hmm_tag(_turns(spark, sf_dir), taggers.hmm_train(models._tagged(spark, sf_dir), models._tagged_arrays(spark, sf_dir)))


def _perceptron(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = taggers.perceptron_train(models._tagged(spark, sf_dir), 2, 20_000)
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", words().alias("w"))
    return t.select("conv_id", "turn", F.posexplode(taggers.pos_tag(F.col("w"), model)).alias("pos", "t")).select("conv_id", "turn", "pos", "t.word", "t.tag")


def _affix_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = models._tagged(spark, sf_dir)
    return taggers.affix_tag(_turns(spark, sf_dir).drop("tag"), taggers.affix_last_train(gold)).select("sent_id", "pos", "word", "tag")


_LAST = f"{models._TAGGED}, last AS (SELECT right(word, 3) AS affix, max_by(tag, (sent_id, pos)) AS tag FROM tagged WHERE len(word) >= 3 GROUP BY 1)"
_SAID = f"said AS (SELECT conv_id || ':' || turn AS sent_id, regexp_extract_all(lower(text), '{CLASS}+') AS w FROM conversations), spoken AS (SELECT sent_id, (generate_subscripts(w, 1) - 1)::INTEGER AS pos, unnest(w) AS word FROM said WHERE len(w) > 0)"


def _maxent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models._featured(spark, sf_dir)


def _maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.maxent_train(_maxent_rows(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def _maxent_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _maxent_rows(spark, sf_dir)
    return classify.maxent_scores(classify.maxent_train(rows), rows).withColumn("prob", F.round("prob", 6))


def _maxent_informative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.maxent_informative(classify.maxent_train(_maxent_rows(spark, sf_dir)), 10)


def _positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models._featured(spark, sf_dir)
    first = F.col("label") == "1-URGENT"
    got = classify.positive_naive_bayes(rows.filter(first).drop("label"), rows.filter(~first).drop("label"))
    return got.select("label", "feature", F.round("logp", 9).alias("logp"))


_POSITIVE = models._NB.replace("o_orderpriority AS label", "CASE WHEN o_orderpriority = '1-URGENT' THEN 'pos' ELSE 'neg' END AS label")


def _textcat(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return classify.textcat(d, classify.textcat_train(d)).select("doc_id", "lang", "guess", F.round("confidence", 6).alias("confidence"))


_PADDED = r"' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{M}]+', ' ', 'g'), ' ') || ' '"
_PROFILES = f"WITH p AS (SELECT lang, {_PADDED} AS t FROM documents WHERE lang IS NOT NULL), g AS (SELECT lang, unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) AS trigram FROM p), c AS (SELECT lang, trigram, count(*) AS n FROM g WHERE trim(trigram, ' ') <> '' GROUP BY ALL) SELECT lang, trigram, (row_number() OVER (PARTITION BY lang ORDER BY n DESC, trigram) - 1)::INTEGER AS rank FROM c QUALIFY rank < {classify.PROFILE}"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word pairs of all turns, distinct."""
    w = table(spark, sf_dir, "conversations").select(language_models.padded(words(), 2).alias("t"))
    g = w.select(F.explode(F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda a, b: F.struct(F.array(a).alias("context"), b.alias("word")))).alias("g"))
    return g.select("g.*").distinct()


def _points(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        model = language_models.fit(documents(spark, sf_dir), words(), 2)
        got = language_models.point_scores(model, _asked(spark, sf_dir), 2, method)
        return got.select(F.col("context")[0].alias("context"), "word", F.round("score", 9).alias("score"))

    return query


def _points_sql(score: str) -> str:
    asked = f"q AS (SELECT list_concat(['<s>'], regexp_extract_all(lower(text), '{CLASS}+'), ['</s>']) AS w FROM conversations), asked AS (SELECT DISTINCT unnest(w[:-2]) AS context, unnest(w[2:]) AS word FROM q)"
    return f"{models._LM}, {asked} SELECT a.context, a.word, round({score}, 9)::DOUBLE AS score FROM asked a LEFT JOIN m ON m.context = a.context AND m.word = a.word LEFT JOIN t ON t.context = a.context, v"


def _unigram_points(method: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        asked = table(spark, sf_dir, "conversations").select(F.explode(words()).alias("sample")).distinct()
        return language_models.unigram_point_scores(models._fd(spark, sf_dir), asked, method).withColumn("score", F.round("score", 12))

    return query


def _unigram_points_sql(seen: str, unseen: str) -> str:
    return f"{models._FD}, asked AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{CLASS}+')) AS sample FROM conversations) SELECT a.sample, round(CASE WHEN count IS NULL THEN {unseen} ELSE {seen} END, 12)::DOUBLE AS score FROM asked a LEFT JOIN fd USING (sample), t"


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_models.fit(documents(spark, sf_dir), words(), 2).persist()
    text = language_models.generate(model, 2, 8, None, 7)
    model.unpersist()
    return spark.createDataFrame(list(enumerate(text)), "pos int, word string")


def _sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.polarity_scores(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def _as_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, each word of letters with a tag."""
    return documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("fileid"), F.regexp_replace("text", "([A-Za-z]+)", "$1/W").alias("text"))


_CORPUS = r"c AS (SELECT doc_id::VARCHAR AS fileid, regexp_replace(text, '([A-Za-z]+)', '\1/W', 'g') AS text FROM documents)"
_SPACE = r"[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_TAGGED = f"t AS (SELECT fileid, list_filter(string_split_regex(text, '{_SPACE}'), lambda x: contains(x, '/')) AS a FROM c)"


def _tagged_sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = corpora.tagged_sents(_as_corpus(spark, sf_dir))
    return got.select("fileid", "line", F.array_join(F.transform("tagged", lambda t: t["word"]), " ").alias("words"), F.size("tagged").alias("n"))


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("fileid"), "text")


def _increased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.increased(models._fd(spark, sf_dir), spark.createDataFrame([("the", 3), ("brandnew", 2), ("the", 1)], "sample string, count long"))


CATALOG = {
    "tag_default": (lambda s, d: taggers.default_tag(models._tagged(s, d).drop("tag"), "NN"), f"{models._TAGGED} SELECT sent_id, pos, word, 'NN' AS tag FROM tagged"),
    "tag_affix_last_train": (lambda s, d: taggers.affix_last_train(models._tagged(s, d)), f"{_LAST} SELECT * FROM last"),
    "tag_affix": (_affix_tagged, f"{_LAST}, {_SAID} SELECT sent_id, pos, word, coalesce(tag, '') AS tag FROM spoken LEFT JOIN last ON affix = right(word, 3)"),
    "tag_bigram": (_context(2), None),
    "tag_trigram": (_context(3), None),
    "tag_tnt": (_tnt, None),
    "tag_hmm": (_hmm, None),
    "pos_tag": (_perceptron, None),
    "maxent_train": (_maxent, None),
    "maxent_prob": (_maxent_prob, None),
    "maxent_informative": (_maxent_informative, None),
    "naive_bayes_labels": (lambda s, d: classify.labels(models._featured(s, d)), "SELECT DISTINCT o_orderpriority AS label FROM orders"),
    "positive_naive_bayes": (_positive, f"{_POSITIVE} SELECT label, feature, round(logp, 9) AS logp FROM m UNION ALL SELECT label, NULL, round(prior, 9) FROM pr"),
    "textcat_train": (lambda s, d: classify.textcat_train(documents(s, d)), _PROFILES),
    "textcat": (_textcat, None),
    "lm_points_mle": (_points("mle"), _points_sql("coalesce(count, 0) / coalesce(total, 1)::DOUBLE")),
    "lm_points_laplace": (_points("laplace"), _points_sql("(coalesce(count, 0) + 1.0::DOUBLE) / (coalesce(total, 0) + v)")),
    "lm_points_lidstone": (_points("lidstone"), _points_sql("(coalesce(count, 0) + 0.1::DOUBLE) / (coalesce(total, 0) + 0.1::DOUBLE * v)")),
    "lm_points_kneser_ney_unigram": (_unigram_points("kneser_ney"), _unigram_points_sql("greatest(count - 0.75::DOUBLE, 0) / n + 0.75::DOUBLE / n", "0.75::DOUBLE / n")),
    "lm_points_witten_bell_unigram": (_unigram_points("witten_bell"), _unigram_points_sql("count / (n + b)::DOUBLE", "1 / (n + b)::DOUBLE")),
    "lm_points_stupid_backoff_unigram": (_unigram_points("stupid_backoff"), _unigram_points_sql("count / n::DOUBLE", "0.4::DOUBLE / (n + b)")),
    "lm_vocabulary_size": (lambda s, d: language_models.vocabulary_size(language_models.fit(documents(s, d), words(), 2)), f"{models._LM} SELECT v FROM v"),
    "lm_generate": (_generated, None),
    "sentiment": (_sentiment, sentiment.polarity_sql("documents", "doc_id")),
    "corpus_tagged_words": (lambda s, d: corpora.tagged_words(_as_corpus(s, d)), f"WITH {_CORPUS}, {_TAGGED}, e AS (SELECT fileid, (generate_subscripts(a, 1) - 1)::INTEGER AS pos, unnest(a) AS x FROM t WHERE len(a) > 0) SELECT fileid, pos, regexp_extract(x, '(?s)^(.*)/([^/]*)$', 1) AS word, regexp_extract(x, '(?s)^(.*)/([^/]*)$', 2) AS tag FROM e"),
    "corpus_tagged_sents": (_tagged_sents, f"WITH {_CORPUS}, l AS (SELECT fileid, string_split(text, chr(10)) AS a FROM c), e AS (SELECT fileid, (generate_subscripts(a, 1) - 1)::INTEGER AS line, unnest(a) AS text FROM l), t AS (SELECT fileid, line, list_filter(string_split_regex(text, '{_SPACE}'), lambda x: contains(x, '/')) AS a FROM e WHERE regexp_replace(text, '{_SPACE}', '', 'g') <> '') SELECT fileid, line, coalesce(array_to_string(list_transform(a, lambda x: regexp_extract(x, '^(.*)/([^/]*)$', 1)), ' '), '') AS words, len(a)::INTEGER AS n FROM t"),
    "corpus_words": (lambda s, d: corpora.words(_plain(s, d)), None),
    "corpus_sents": (lambda s, d: corpora.sents(_plain(s, d)), None),
    "corpus_paras": (lambda s, d: corpora.paras(_plain(s, d)), None),
    "corpus_sizes": (lambda s, d: corpora.sizes(_plain(s, d)), None),
    "freq_dist_samples": (lambda s, d: counts.samples(models._fd(s, d)), f"{models._FD} SELECT sample FROM fd"),
    "freq_dist_inc": (_increased, f"{models._FD}, x AS (SELECT * FROM (VALUES ('the', 4), ('brandnew', 2)) v(sample, n)) SELECT coalesce(fd.sample, x.sample) AS sample, (coalesce(count, 0) + coalesce(x.n, 0))::BIGINT AS count FROM fd FULL JOIN x ON x.sample = fd.sample"),
}

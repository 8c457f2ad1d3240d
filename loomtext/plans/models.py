"""Registered queries of counts, collocations, language models, classifiers, taggers, metrics, translation and clustering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import metrics, tokenizers
from loomtext.operators import classify, clustering, collocations, counts, language_models, scores, taggers
from loomtext.plans.tokens import CLASS, documents
from loomtext.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def words() -> Column:
    return tokenizers.words(F.lower(F.col("text")))


_TOKENS = f"tokens AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '{CLASS}+')) AS token FROM documents)"
_FD = f"WITH {_TOKENS}, fd AS (SELECT token AS sample, count(*) AS count FROM tokens GROUP BY token), t AS (SELECT sum(count)::BIGINT AS n, count(*) AS b FROM fd)"


def _fd(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    return counts.freq_dist(counts.tokens(documents(spark, sf_dir).filter(where), words()))


def _cfd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.conditional_freq_dist(counts.tokens(documents(spark, sf_dir), words(), "lang"), "lang", "token")


def _scored(measure: str, n: int = 50) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        pairs = collocations.counted(documents(spark, sf_dir), words())
        return collocations.best(collocations.score(collocations.bigrams_of(pairs, 5), collocations.unigrams_of(pairs), measure), n)

    return query


_BI = f"""WITH w AS (SELECT regexp_extract_all(lower(text), '{CLASS}+') AS w FROM documents),
u AS (SELECT word, count(*) AS c FROM (SELECT unnest(w) AS word FROM w) GROUP BY word), t AS (SELECT sum(c)::BIGINT AS n FROM u),
p AS (SELECT unnest(w[:-2]) AS w1, unnest(w[2:]) AS w2 FROM w WHERE len(w) > 1),
b AS (SELECT w1, w2, count(*) AS count FROM p GROUP BY w1, w2 HAVING count(*) >= 5),
j AS (SELECT w1, w2, b.count AS o, x.c AS r, y.c AS c, n, b.count::DOUBLE AS o11, (x.c - b.count)::DOUBLE AS o12, (y.c - b.count)::DOUBLE AS o21, (n - x.c - y.c + b.count)::DOUBLE AS o22,
  x.c * y.c / n::DOUBLE AS e11, x.c * (n - y.c) / n::DOUBLE AS e12, (n - x.c) * y.c / n::DOUBLE AS e21, (n - x.c) * (n - y.c) / n::DOUBLE AS e22
  FROM b JOIN u x ON x.word = w1 JOIN u y ON y.word = w2, t)"""


def _scored_sql(expr: str, n: int = 50) -> str:
    return f"{_BI} SELECT w1, w2, o AS count, r AS c1, c AS c2, round({expr}, 6) AS score FROM j ORDER BY score DESC, w1, w2 LIMIT {n}"


def _ll(k: str, n: str, p: str) -> str:
    return f"CASE WHEN {k} <= 0 OR {n} <= 0 OR {p} <= 0 THEN 0 ELSE {k} * ln({p}) + CASE WHEN {n} = {k} THEN 0 ELSE ({n} - {k}) * ln(1 - {p}) END END"


def _all(cell: str) -> str:
    return " + ".join(f"({cell.format(i)})" for i in ("11", "12", "21", "22"))


def _lm(method: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = language_models.scores(language_models.fit(documents(spark, sf_dir), words(), 2), method)
        return got.select(F.col("context")[0].alias("context"), "word", "count", F.round("score", 9).alias("score"))

    return query


_LM = f"""WITH w AS (SELECT list_concat(['<s>'], regexp_extract_all(lower(text), '{CLASS}+'), ['</s>']) AS w FROM documents),
p AS (SELECT unnest(w[:-2]) AS context, unnest(w[2:]) AS word FROM w), m AS (SELECT context, word, count(*) AS count FROM p GROUP BY ALL),
t AS (SELECT context, sum(count)::BIGINT AS total FROM m GROUP BY context), v AS (SELECT count(DISTINCT word) + 1 AS v FROM m)"""


def _lm_sql(score: str) -> str:
    return f"{_LM} SELECT m.context, word, count, round({score}, 9) AS score FROM m JOIN t USING (context), v"


def _uni(method: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return language_models.unigram_scores(_fd(spark, sf_dir), method).select("sample", F.round("score", 12).alias("score"))

    return query


def _featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, odd = F.when(F.col("o_totalprice") < 150000, "low").otherwise("high"), (F.col("o_custkey") % 3).cast("string")
    features = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("price"), price, F.lit("customer"), odd)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), features.alias("features"))


_NB = """WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS label, ['status=' || o_orderstatus, 'price=' || CASE WHEN o_totalprice < 150000 THEN 'low' ELSE 'high' END, 'customer=' || (o_custkey % 3)] AS f FROM orders),
x AS (SELECT id, label, unnest(f) AS feature FROM r), c AS (SELECT label, feature, count(*) AS c FROM x GROUP BY ALL), l AS (SELECT label, count(*) AS docs FROM r GROUP BY label),
t AS (SELECT label, sum(c) AS total FROM c GROUP BY label), v AS (SELECT count(DISTINCT feature) AS v FROM c), g AS (SELECT label, feature FROM l, (SELECT DISTINCT feature FROM c)),
m AS (SELECT label, feature, ln((coalesce(c, 0) + 1.0) / (total + 1.0 * v)) AS logp FROM g LEFT JOIN c USING (label, feature) JOIN t USING (label), v),
pr AS (SELECT label, ln(docs / (SELECT sum(docs) FROM l)::DOUBLE) AS prior FROM l)"""
_NBS = f"{_NB}, s AS (SELECT id, m.label, sum(logp) + any_value(prior) AS logp FROM x JOIN m USING (feature) JOIN pr ON pr.label = m.label GROUP BY id, m.label)"


def _nb_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.naive_bayes_train(_featured(spark, sf_dir)).select("label", "feature", F.round("logp", 9).alias("logp"))


def _nb_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _featured(spark, sf_dir)
    return classify.naive_bayes_scores(classify.naive_bayes_train(rows), rows).select("id", "label", F.round("logp", 6).alias("logp"), F.round("prob", 6).alias("prob"))


def _nb_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _featured(spark, sf_dir)
    return classify.best_label(classify.naive_bayes_scores(classify.naive_bayes_train(rows), rows))


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a tag by a rule of their form: sentences are documents."""
    rows = counts.tokens(documents(spark, sf_dir), words()).select(F.col("doc_id").alias("sent_id"), "pos", F.col("token").alias("word"))
    return taggers.regexp_tag(rows, PATTERNS, "NN")


def _tagged_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``_tagged``: sent_id and an array of (word, tag)."""
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("sent_id"), words().alias("w"))
    return rows.select("sent_id", F.transform("w", lambda x: F.struct(x.alias("word"), taggers.regexp_tag_of(x, PATTERNS, "NN").alias("tag"))).alias("s"))


PATTERNS = [("^[0-9]+$", "CD"), ("ing$", "VBG"), ("ed$", "VBD"), ("ly$", "RB"), ("s$", "NNS")]
_CASE = "CASE " + " ".join(f"WHEN regexp_matches(word, '{p}') THEN '{t}'" for p, t in PATTERNS) + " ELSE 'NN' END"
_TAGGED = f"WITH d AS (SELECT doc_id AS sent_id, regexp_extract_all(lower(text), '{CLASS}+') AS w FROM documents), e AS (SELECT sent_id, (generate_subscripts(w, 1) - 1)::INTEGER AS pos, unnest(w) AS word FROM d WHERE len(w) > 0), tagged AS (SELECT sent_id, pos, word, {_CASE} AS tag FROM e)"


def _best_sql(keys: str, source: str = "tagged") -> str:
    return f"SELECT {keys}, tag FROM (SELECT {keys}, tag, count(*) AS n FROM {source} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, tag) = 1"


def _unigram_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _tagged(spark, sf_dir)
    return taggers.evaluate(gold, taggers.unigram_tag(gold.select("sent_id", "pos", "word"), taggers.unigram_train(gold)))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")
    return p.select(
        "p_partkey", metrics.edit_distance(F.col("p_name"), F.col("p_type")).cast("bigint").alias("edit"), F.round(metrics.dice_similarity(F.col("p_name"), F.col("p_type")), 6).alias("dice"),
        F.round(metrics.jaccard_distance(a, b), 6).alias("jaccard"), metrics.binary_distance(a, b).alias("binary"), F.round(metrics.masi_distance(a, b), 6).alias("masi"), F.round(metrics.precision(a, b), 6).alias("prec"), F.round(metrics.recall(a, b), 6).alias("rec"),
        F.round(metrics.f_measure(a, b), 6).alias("f"),
    )


_BG = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i:i + 1]))"
_NAMES = f"""WITH p AS (SELECT p_partkey, p_name AS x, p_type AS y, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part),
q AS (SELECT *, list_distinct(a) AS da, list_distinct(b) AS db, len(list_intersect(list_distinct(a), list_distinct(b))) AS i, {_BG.format("x")} AS gx, {_BG.format("y")} AS gy, len(list_filter(b, lambda z: list_contains(a, z))) AS hits FROM p),
r AS (SELECT *, len(da) + len(db) - i AS u, hits / len(b)::DOUBLE AS pr, i / len(da)::DOUBLE AS re FROM q)
SELECT p_partkey, levenshtein(x, y)::BIGINT AS edit, round(CASE WHEN x = y THEN 1.0 WHEN len(x) < 2 OR len(y) < 2 THEN 0.0 ELSE 2.0 * len(list_intersect(gx, gy)) / (len(gx) + len(gy)) END, 6)::DOUBLE AS dice,
 round(1 - i / u::DOUBLE, 6) AS jaccard, (CASE WHEN list_sort(da) = list_sort(db) THEN 0 ELSE 1 END)::DOUBLE AS "binary",
 round(1 - i / u::DOUBLE * CASE WHEN i = len(da) AND i = len(db) THEN 1.0::DOUBLE WHEN i = least(len(da), len(db)) THEN 0.67::DOUBLE WHEN i > 0 THEN 0.33::DOUBLE ELSE 0 END, 6) AS masi,
 round(pr, 6) AS prec, round(re, 6) AS rec, round(CASE WHEN pr = 0 OR re = 0 THEN 0.0::DOUBLE ELSE 1 / (0.5::DOUBLE / pr + 0.5::DOUBLE / re) END, 6) AS f FROM r"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(c, "1").otherwise("0").alias("b")))), lambda x: x["b"]), "")
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(mark(F.col("l_quantity") > 30).alias("ref"), mark(F.col("l_discount") > 0.06).alias("hyp"))
    return s.select("l_orderkey", "ref", "hyp", F.round(metrics.windowdiff(F.col("ref"), F.col("hyp")), 6).alias("windowdiff"), F.round(metrics.pk(F.col("ref"), F.col("hyp"), 2), 6).alias("pk"))


_ONES = "len({0}) - len(replace({0}, '1', ''))"
_W3 = "len(list_filter(range(1, len(ref) - 1), lambda i: (" + _ONES.format("ref[i:i + 2]") + ") <> (" + _ONES.format("hyp[i:i + 2]") + ")))"
_SEGMENTS = f"""WITH s AS (SELECT l_orderkey, string_agg(CASE WHEN l_quantity > 30 THEN '1' ELSE '0' END, '' ORDER BY l_linenumber, CASE WHEN l_quantity > 30 THEN '1' ELSE '0' END) AS ref,
 string_agg(CASE WHEN l_discount > 0.06 THEN '1' ELSE '0' END, '' ORDER BY l_linenumber, CASE WHEN l_discount > 0.06 THEN '1' ELSE '0' END) AS hyp FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, ref, hyp, CASE WHEN len(ref) < 3 THEN NULL WHEN len(ref) = 3 THEN 0.0::DOUBLE ELSE round({_W3} / (len(ref) - 2)::DOUBLE, 6) END AS windowdiff,
 CASE WHEN len(ref) < 2 THEN NULL ELSE round(len(list_filter(range(1, len(ref)), lambda i: contains(ref[i:i + 1], '1') <> contains(hyp[i:i + 1], '1'))) / (len(ref) - 1)::DOUBLE, 6) END AS pk FROM s"""


def _spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.spearman(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def _alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.deviation(table(spark, sf_dir, "orders"), "o_totalprice")


def _agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.kappa(table(spark, sf_dir, "labels"), F.col("quality").cast("string"), F.col("toxic").cast("string"))


def _bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.bleu(_translated(spark, sf_dir), "item_id", "candidate", "reference").withColumn("bleu", F.round("bleu", 6))


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", words().alias("candidate"), F.split(F.lower("text"), r"\s+").alias("reference"))


def _corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.corpus_bleu(_translated(spark, sf_dir), "item_id", "candidate", "reference").withColumn("bleu", F.round("bleu", 6))


_BLEU = f"""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '{CLASS}+') AS a, string_split_regex(lower(text), '\\s+') AS b FROM benchmark),
o AS (SELECT item_id, a, b, unnest([1, 2, 3, 4]) AS n FROM t),
g AS (SELECT item_id, n, 1 AS mine, unnest(list_transform(range(1, len(a) - n + 2), lambda i: array_to_string(a[i:i + n - 1], chr(1)))) AS g FROM o WHERE least(len(a), len(b)) >= n
  UNION ALL SELECT item_id, n, 0, unnest(list_transform(range(1, len(b) - n + 2), lambda i: array_to_string(b[i:i + n - 1], chr(1)))) FROM o WHERE least(len(a), len(b)) >= n),
c AS (SELECT item_id, n, g, sum(mine) AS mine, count(*) - sum(mine) AS theirs FROM g GROUP BY ALL),
h AS (SELECT item_id, n, sum(least(mine, theirs)) AS hits, sum(mine) AS total FROM c GROUP BY ALL)"""
_BREVITY = "CASE WHEN c >= r THEN 1 ELSE exp(1 - r / c::DOUBLE) END"
_BLEU_ROWS = f"{_BLEU}, l AS (SELECT item_id, avg(ln(hits / total::DOUBLE)) AS log FROM h WHERE hits > 0 GROUP BY item_id) SELECT item_id, round(coalesce({_BREVITY} * exp(log), 0), 6)::DOUBLE AS bleu FROM (SELECT item_id, len(a) AS c, len(b) AS r FROM t) LEFT JOIN l USING (item_id)"
_BLEU_ALL = f"{_BLEU}, p AS (SELECT n, sum(hits) AS hits, sum(total) AS total FROM h GROUP BY n), l AS (SELECT avg(ln(hits / total::DOUBLE)) AS log FROM p WHERE hits > 0) SELECT round({_BREVITY} * exp(log), 6)::DOUBLE AS bleu FROM l, (SELECT sum(len(a)) AS c, sum(len(b)) AS r FROM t)"


def _kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return clustering.assign(v, clustering.first_centroids(v, 8)).select("id", "cluster")


def _kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return clustering.k_means(v, 8)


_P = "(SELECT sum(count) FROM fd)::DOUBLE"
CATALOG: dict[str, tuple[Query, str | None]] = {
    "collocations_bigram_pmi": (_scored("pmi"), _scored_sql("log2(o * n / (r * c)::DOUBLE)")),
    "collocations_bigram_chi_sq": (_scored("chi_sq"), _scored_sql(_all("CASE WHEN e{0} > 0 THEN (o{0} - e{0}) * (o{0} - e{0}) / e{0} ELSE 0 END"))),
    "collocations_bigram_likelihood_ratio": (_scored("likelihood_ratio"), _scored_sql(f"2 * ({_ll('o', 'r', 'o / r::DOUBLE')} + {_ll('(c - o)', '(n - r)', '((c - o) / (n - r)::DOUBLE)')} - {_ll('o', 'r', '(o / n::DOUBLE)')} - {_ll('(c - o)', '(n - r)', '(o / n::DOUBLE)')})")),
    "collocations_bigram_g2": (_scored("g2"), _scored_sql("2 * (" + _all("CASE WHEN o{0} > 0 AND e{0} > 0 THEN o{0} * ln(o{0} / e{0}) ELSE 0 END") + ")")),
    "collocations_bigram_dice": (_scored("dice"), _scored_sql("2 * o / (r + c)::DOUBLE")),
    "collocations_bigram_raw_freq": (_scored("raw_freq"), _scored_sql("o::DOUBLE")),
    "collocations_bigram_student_t": (_scored("student_t"), _scored_sql("(o - r * c / n::DOUBLE) / sqrt(o)")),
    "collocations_trigram": (lambda s, d: collocations.freq_filter(collocations.find(documents(s, d), words(), 3), 2), f"WITH w AS (SELECT regexp_extract_all(lower(text), '{CLASS}+') AS w FROM documents), p AS (SELECT unnest(w[:-3]) AS w1, unnest(w[2:-2]) AS w2, unnest(w[3:]) AS w3 FROM w WHERE len(w) > 2) SELECT w1, w2, w3, count(*) AS count FROM p GROUP BY ALL HAVING count(*) >= 2"),
    "collocations_quadgram_filtered": (lambda s, d: collocations.word_filter(collocations.freq_filter(collocations.find(documents(s, d), words(), 4), 2), lambda w: F.length(w) < 3), f"WITH w AS (SELECT regexp_extract_all(lower(text), '{CLASS}+') AS w FROM documents), p AS (SELECT unnest(w[:-4]) AS w1, unnest(w[2:-3]) AS w2, unnest(w[3:-2]) AS w3, unnest(w[4:]) AS w4 FROM w WHERE len(w) > 3) SELECT w1, w2, w3, w4, count(*) AS count FROM p WHERE least(len(w1), len(w2), len(w3), len(w4)) >= 3 GROUP BY ALL HAVING count(*) >= 2"),
    "freq_dist": (_fd, f"{_FD} SELECT * FROM fd"),
    "freq_dist_totals": (lambda s, d: counts.totals(_fd(s, d)), f"{_FD} SELECT * FROM t"),
    "freq_dist_freq": (lambda s, d: counts.frequencies(_fd(s, d)).withColumn("freq", F.round("freq", 12)), f"{_FD} SELECT sample, count, round(count / n::DOUBLE, 12) AS freq FROM fd, t"),
    "freq_dist_hapaxes": (lambda s, d: counts.hapaxes(_fd(s, d)), f"{_FD} SELECT sample FROM fd WHERE count = 1"),
    "freq_dist_most_common": (lambda s, d: counts.most_common(_fd(s, d), 100), f"{_FD} SELECT * FROM fd ORDER BY count DESC, sample LIMIT 100"),
    "freq_dist_add": (lambda s, d: counts.add(_fd(s, d, "lang = 'en'"), _fd(s, d, "lang <> 'en'")), f"{_FD} SELECT * FROM fd"),
    "freq_dist_subtract": (lambda s, d: counts.subtract(_fd(s, d), _fd(s, d, "lang = 'en'")), f"WITH {_TOKENS} SELECT token AS sample, count(*) - sum((lang = 'en')::INT)::BIGINT AS count FROM tokens GROUP BY token HAVING count(*) > sum((lang = 'en')::INT)"),
    "freq_dist_count_of_counts": (lambda s, d: counts.count_of_counts(_fd(s, d)), f"{_FD} SELECT count AS r, count(*) AS n_r FROM fd GROUP BY r"),
    "freq_dist_entropy": (lambda s, d: counts.entropy(_fd(s, d)), f"{_FD} SELECT round(-sum(count / n::DOUBLE * log2(count / n::DOUBLE)), 6) AS entropy FROM fd, t"),
    "conditional_freq_dist": (_cfd, f"WITH {_TOKENS} SELECT lang AS condition, token AS sample, count(*) AS count FROM tokens GROUP BY ALL"),
    "conditional_freq_dist_most_common": (lambda s, d: counts.most_common_by_condition(_cfd(s, d), 20), f"WITH {_TOKENS}, c AS (SELECT lang AS condition, token AS sample, count(*) AS count FROM tokens GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY condition ORDER BY count DESC, sample)::INTEGER AS rank FROM c QUALIFY rank <= 20"),
    "prob_laplace": (lambda s, d: counts.laplace(_fd(s, d)).withColumn("prob", F.round("prob", 12)), f"{_FD} SELECT sample, round((count + 1.0::DOUBLE) / (n + b), 12) AS prob FROM fd, t"),
    "prob_lidstone": (lambda s, d: counts.lidstone(_fd(s, d), 0.5).withColumn("prob", F.round("prob", 12)), f"{_FD} SELECT sample, round((count + 0.5::DOUBLE) / (n + 0.5::DOUBLE * b), 12) AS prob FROM fd, t"),
    "prob_witten_bell": (lambda s, d: counts.witten_bell(_fd(s, d)).withColumn("prob", F.round("prob", 12)), f"{_FD} SELECT sample, round(count / (n + b)::DOUBLE, 12) AS prob FROM fd, t"),
    "lm_mle": (_lm("mle"), _lm_sql("count / total::DOUBLE")),
    "lm_laplace": (_lm("laplace"), _lm_sql("(count + 1.0::DOUBLE) / (total + v)")),
    "lm_lidstone": (_lm("lidstone"), _lm_sql("(count + 0.1::DOUBLE) / (total + 0.1::DOUBLE * v)")),
    "lm_kneser_ney_unigram": (_uni("kneser_ney"), f"{_FD} SELECT sample, round(greatest(count - 0.75::DOUBLE, 0) / n + 0.75::DOUBLE / n, 12) AS score FROM fd, t"),
    "lm_witten_bell_unigram": (_uni("witten_bell"), f"{_FD} SELECT sample, round(count / (n + b)::DOUBLE, 12) AS score FROM fd, t"),
    "lm_stupid_backoff_unigram": (_uni("stupid_backoff"), f"{_FD} SELECT sample, round(count / n::DOUBLE, 12) AS score FROM fd, t"),
    "lm_kneser_ney": (lambda s, d: language_models.kneser_ney(language_models.fit(documents(s, d), words(), 2)).select("h", "word", F.round("score", 9).alias("score")), f"{_LM}, k AS (SELECT context, count(*) AS kinds FROM m GROUP BY context), h AS (SELECT word, count(*) AS histories FROM m GROUP BY word) SELECT m.context AS h, m.word, round(greatest(count - 0.75::DOUBLE, 0) / total + 0.75::DOUBLE * kinds / total * histories / (SELECT count(*) FROM m), 9) AS score FROM m JOIN t USING (context) JOIN k USING (context) JOIN h ON h.word = m.word"),
    "naive_bayes_train": (_nb_train, f"{_NB} SELECT label, feature, round(logp, 9) AS logp FROM m UNION ALL SELECT label, NULL, round(prior, 9) FROM pr"),
    "naive_bayes_prob": (_nb_prob, f"{_NBS}, e AS (SELECT *, exp(logp - max(logp) OVER (PARTITION BY id)) AS e FROM s) SELECT id, label, round(logp, 6) AS logp, round(e / sum(e) OVER (PARTITION BY id), 6) AS prob FROM e"),
    "naive_bayes_classify": (_nb_classify, f"{_NBS} SELECT id, label FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(logp, 9) DESC, label DESC) = 1"),
    "naive_bayes_informative": (lambda s, d: classify.most_informative(classify.naive_bayes_train(_featured(s, d)), 10), f"{_NB} SELECT a.label AS label_a, b.label AS label_b, a.feature, round(abs(a.logp - b.logp), 6) AS difference FROM m a JOIN m b ON a.feature = b.feature AND a.label < b.label ORDER BY difference DESC, feature, label_a, label_b LIMIT 10"),
    "tag_regexp": (_tagged, f"{_TAGGED} SELECT * FROM tagged"),
    "tag_unigram_train": (lambda s, d: taggers.unigram_train(_tagged(s, d)), f"{_TAGGED} {_best_sql('word')}"),
    "tag_bigram_train": (lambda s, d: taggers.context_train_sentences(_tagged_arrays(s, d), 2), f"{_TAGGED}, c AS (SELECT *, lag(tag, 1, '<S>') OVER (PARTITION BY sent_id ORDER BY pos) AS prev1 FROM tagged) {_best_sql('prev1, word', 'c')}"),
    "tag_trigram_train": (lambda s, d: taggers.context_train_sentences(_tagged_arrays(s, d), 3), f"{_TAGGED}, c AS (SELECT *, lag(tag, 1, '<S>') OVER (PARTITION BY sent_id ORDER BY pos) AS prev1, lag(tag, 2, '<S>') OVER (PARTITION BY sent_id ORDER BY pos) AS prev2 FROM tagged) {_best_sql('prev1, prev2, word', 'c')}"),
    "tag_affix_train": (lambda s, d: taggers.affix_train(_tagged(s, d)), f"{_TAGGED}, c AS (SELECT *, right(word, 3) AS affix FROM tagged WHERE len(word) >= 3) {_best_sql('affix', 'c')}"),
    "tag_unigram_accuracy": (_unigram_tagged, f"{_TAGGED}, m AS ({_best_sql('word')}) SELECT avg((t.tag = m.tag)::INT)::DOUBLE AS accuracy FROM tagged t JOIN m USING (word)"),
    "tag_transitions": (lambda s, d: taggers.transition_counts_sentences(_tagged_arrays(s, d)), f"{_TAGGED}, c AS (SELECT tag, lag(tag, 1, '<S>') OVER (PARTITION BY sent_id ORDER BY pos) AS prev FROM tagged) SELECT prev, tag, count(*) AS n FROM c GROUP BY ALL"),
    "tag_emissions": (lambda s, d: taggers.emission_counts(_tagged(s, d)), f"{_TAGGED} SELECT tag, word, count(*) AS n FROM tagged GROUP BY ALL"),
    "metrics_names": (_names, _NAMES),
    "metrics_segmentation": (_segments, _SEGMENTS),
    "metrics_spearman": (_spearman, "WITH r AS (SELECT l_returnflag AS grp, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS y FROM lineitem) SELECT grp, count(*) AS n, round(1 - 6 * sum((x - y) * (x - y)::DOUBLE) / (count(*)::DOUBLE * (count(*)::DOUBLE * count(*) - 1)), 6) AS rho FROM r GROUP BY grp"),
    "metrics_deviation": (_alpha, "WITH m AS (SELECT avg(o_totalprice) AS m FROM orders) SELECT round(any_value(m), 4) AS mean, round(avg(abs(o_totalprice - m)), 4) AS mad FROM orders, m"),
    "metrics_kappa": (_agreement, "WITH p AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), n AS (SELECT count(*) AS n, avg((a = b)::INT) AS o FROM p), e AS (SELECT sum(x.c * y.c) AS e FROM (SELECT a, count(*)::DOUBLE AS c FROM p GROUP BY a) x JOIN (SELECT b, count(*)::DOUBLE AS c FROM p GROUP BY b) y ON x.a = y.b) SELECT round(o, 6) AS observed, round(e / (n * n::DOUBLE), 6) AS expected, round((o - e / (n * n::DOUBLE)) / (1 - e / (n * n::DOUBLE)), 6) AS kappa FROM n, e"),
    "bleu": (_bleu, _BLEU_ROWS),
    "corpus_bleu": (_corpus_bleu, _BLEU_ALL),
    "metrics_alpha": (lambda s, d: scores.alpha(table(s, d, "lineitem"), "l_discount", "l_tax").withColumn("alpha", F.round("alpha", 6)), "WITH m AS (SELECT avg(l_discount::DOUBLE + l_tax::DOUBLE) / 2 AS m FROM lineitem) SELECT count(*) AS n, round(1 - avg(abs(l_discount::DOUBLE - l_tax::DOUBLE)) / (avg(abs(l_discount::DOUBLE - m) + abs(l_tax::DOUBLE - m)) / 2), 6) AS alpha FROM lineitem, m"),
    "metrics_pi": (lambda s, d: scores.pi(table(s, d, "labels"), F.col("quality").cast("string"), F.col("toxic").cast("string")), "WITH p AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), k AS (SELECT k, count(*)::DOUBLE AS c FROM (SELECT unnest([a, b]) AS k FROM p) GROUP BY k), e AS (SELECT sum(c * c) / (sum(c) * sum(c)) AS e FROM k), o AS (SELECT avg((a = b)::INT) AS o FROM p) SELECT round(o, 6) AS observed, round(e, 6) AS expected, round(CASE WHEN e >= 1 THEN 0 ELSE (o - e) / (1 - e) END, 6)::DOUBLE AS pi FROM o, e"),
    "k_means_step": (_kmeans_step, "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT (row_number() OVER (ORDER BY id) - 1)::INTEGER AS cluster, v AS c FROM (SELECT * FROM v ORDER BY id LIMIT 8)) SELECT id, cluster FROM v, c QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), cluster) = 1"),
    "k_means": (_kmeans, None),
}

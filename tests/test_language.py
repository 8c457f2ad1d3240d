"""Golden values and brute-force versions of tokenizers, stemmers, taggers, models, scores, readers and streams."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.functions import arrow, sentiment, stemmers, tokenizers
from loomtext.kernels import stems, strings, tagging, texttiling, treebank
from loomtext.operators import classify, clustering, counts, language_models, scores, taggers
from loomtext.plans.catalog import CATALOG
from loomtext.sources import corpora
from loomtext.streaming import counts as stream_counts


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'array<string>' if isinstance(v, list) else 'string'}" for i, v in enumerate(values)))
    return df.select(column(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


def test_toktok(spark):
    assert one(spark, tokenizers.toktok, "Go now.\nStop. a,5 b,,c 1,5") == ["Go", "now", ".", "Stop.", "a", ",", "5", "b", ",", ",", "c", "1,5"]
    assert one(spark, tokenizers.toktok, 'Is 9.5 or 525,600 my "favourite" number?') == ["Is", "9.5", "or", "525,600", "my", '"', "favourite", '"', "number", "?"]
    assert one(spark, tokenizers.toktok, "The € 5 (or £6) a|b -- it's & so...") == ["The", "€", "5", "(", "or", "£", "6", ")", "a", "&#124;", "b", "--", "it", "'", "s", "&amp;", "so", "..", "."]
    assert one(spark, tokenizers.toktok, "") == [] and one(spark, tokenizers.toktok, None) is None


def test_tweet(spark):
    cut = lambda t: tokenizers.tweet(t, preserve_case=False, reduce_len=True, strip_handles=True)
    assert one(spark, cut, "@me É Waaaaayyyy :-) #Tag https://x.y/z") == ["é", "waaayyy", ":-)", "#tag", "https://x.y/z"]


def test_words_and_sentences(spark):
    assert one(spark, arrow.word_tokenize, "It is. Go now. He won't") == ["It", "is", ".", "Go", "now", ".", "He", "wo", "n't"]
    assert one(spark, lambda t: arrow.word_tokenize(t, ["dr"], ["the"]), "Dr. Smith left. Bye.") == ["Dr.", "Smith", "left", ".", "Bye", "."]
    assert one(spark, lambda t: arrow.word_tokenize(t, preserve_line=True), "It is. Go.") == ["It", "is.", "Go", "."]
    assert one(spark, lambda t: arrow.sent_tokenize(t, None), 'He said. "So?" Yes!') == ["He said.", '"So?', '" Yes!']
    assert treebank.punkt("Use tools, e.g. the hammer. Dr. Smith left U.S. soil. Go! ok", frozenset({"e.g", "dr"}), frozenset({"the"})) == ["Use tools, e.g. the hammer.", "Dr. Smith left U.S. soil.", "Go!", "ok"]
    assert treebank.punkt("He saw Dr. The man left.", frozenset({"dr"}), frozenset({"the"})) == ["He saw Dr.", "The man left."]
    text = "We'll go, ok?"
    assert [text[s["start"] : s["end"]] for s in one(spark, arrow.treebank_spans, text)] == treebank.tokens(text)
    assert [tuple(s) for s in one(spark, lambda t: arrow.spans(t, r"\s+", gaps=True), " a  bc ")] == [(1, 2), (4, 6)]
    assert one(spark, lambda t: tokenizers.regexp(t, "é+", flags=2), "É e") == ["É"]


def test_text_tiling():
    a, b = ["apple", "pear", "plum", "fig"], ["stone", "iron", "lead", "zinc"]
    rng = random.Random(1)
    text = " ".join([rng.choice(a) for _ in range(400)] + [rng.choice(b) for _ in range(400)])
    segments, found, depths, cuts = texttiling.tile(text, 10, 6)
    assert " ".join(segments) == text and len(found) == len(depths) == len(cuts) == 80
    assert min(range(12, 68), key=lambda i: found[i]) == 40 and 1 in cuts[38:43]
    assert texttiling.tile("short text") == (["short text"], [], [], [])

    def brute(parts, gap, k):
        def weights(ps):
            c = {}
            for p in ps:
                for w in p:
                    c[w] = c.get(w, 0) + 1
            return {w: 1 + math.log2(n) for w, n in c.items()}

        x, y = weights(parts[gap - k : gap]), weights(parts[gap : gap + k])
        return sum(v * y.get(w, 0) for w, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))

    words = text.split()
    parts = [words[i : i + 10] for i in range(0, 800, 10)]
    assert all(found[g] == pytest.approx(brute(parts, g, 6)) for g in range(6, 75))


@pytest.mark.parametrize(("stem", "pairs"), [
    (stems.lancaster, {"maximum": "maxim", "presumably": "presum", "multiply": "multiply", "provision": "provid", "owed": "ow", "ear": "ear", "saying": "say", "crying": "cry", "string": "str", "meant": "meant", "cement": "cem", "kilometer": "met"}),
    (stems.snowball("English"), {"running": "run", "generously": "generous", "consistency": "consist", "national": "nation", "skies": "sky", "dying": "die", "happily": "happili", "knightly": "knight", "relational": "relat", "consigned": "consign", "knocks": "knock"}),
    (stems.snowball("de"), {"aufeinanderfolgenden": "aufeinanderfolg", "kategorie": "kategori", "häuser": "haus", "aufschlüsse": "aufschluss"}),
    (stems.snowball("sv"), {"jaktkarlarne": "jaktkarl", "klostergården": "klostergård", "jakten": "jakt"}),
    (stems.snowball("da"), {"indtage": "indtag", "underste": "underst", "indtagelse": "indtag"}),
    (stems.snowball("no"), {"havnemyndighetene": "havnemynd", "opning": "opning"}),
    (stems.arlstem, {"الكتاب": "كتاب", "يكتبون": "كتب"}),
])
def test_stems(stem, pairs):
    assert {w: stem(w) for w in pairs} == pairs


def test_rule_stems(spark):
    words = ["as", "gas", "pass", "meninas", "cantando", "casas", "homens", "mares"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(stemmers.rslp(F.col("w"))).collect()] == ["as", "gas", "pass", "menino", "canta", "caso", "homen", "mar"]
    df = spark.createDataFrame([(w,) for w in ["kitab", "nahr", "alkitab", "wal", " SALAM "]], "w string")
    assert [r[0] for r in df.select(stemmers.isri_transliterated(F.col("w"))).collect()] == ["kitab", "ahr", "kitab", "wal", "alam"]
    with pytest.raises(ValueError):
        stems.snowball("klingon")


def test_lemmatizer(spark):
    words = spark.createDataFrame([("dogs", "n"), ("churches", "n"), ("mice", "n"), ("running", "v"), ("better", "a"), ("Women", "n"), ("xyzzy", "n"), ("quickly", "r"), ("dogs", "n")], "word string, pos string")
    lexicon = spark.createDataFrame([("n", "dog"), ("n", "church"), ("v", "run"), ("n", "woman"), ("n", "running"), ("a", "good")], "pos string, word string")
    exceptions = spark.createDataFrame([("n", "mice", "mouse"), ("a", "better", "good")], "pos string, form string, base string")
    got = {(r.word, r.pos): r.lemma for r in stemmers.lemmatize(words, lexicon, exceptions).collect()}
    assert got == {("dogs", "n"): "dog", ("churches", "n"): "church", ("mice", "n"): "mouse", ("running", "v"): "run", ("better", "a"): "good", ("Women", "n"): "woman", ("xyzzy", "n"): "xyzzy", ("quickly", "r"): "quickly"}


TRAIN = [[("the", "DT"), ("dog", "NN"), ("runs", "VB")], [("the", "DT"), ("runs", "NN"), ("end", "VB")], [("dogs", "NNS"), ("run", "VB")], [("the", "DT"), ("dog", "NN"), ("end", "VB")]] * 3


def token_rows(spark, sentences):
    data = [(i, p, w, t) for i, s in enumerate(sentences) for p, (w, t) in enumerate(s)]
    return spark.createDataFrame(data, "sent_id long, pos int, word string, tag string")


def by_sentence(df):
    out = {}
    for r in df.orderBy("sent_id", "pos").collect():
        out.setdefault(r.sent_id, []).append(r.tag)
    return [out[k] for k in sorted(out)]


def test_context_taggers(spark):
    rows = token_rows(spark, TRAIN)
    asked = token_rows(spark, [[("the", ""), ("runs", ""), ("end", "")], [("dog", ""), ("the", "")]])
    two = taggers.context_tag(asked, taggers.context_train(rows, 2), 2)
    assert by_sentence(two) == [["DT", "NN", "VB"], ["VB", "VB"]]  # unseen contexts: the most frequent tag of the model
    three = taggers.context_tag(asked, taggers.context_train(rows, 3), 3, "XX")
    assert by_sentence(three) == [["DT", "NN", "VB"], ["XX", "XX"]]
    chain = taggers.context_tag(asked, taggers.context_train(rows, 3), 3, "XX", taggers.unigram_train(rows))
    assert by_sentence(chain) == [["DT", "NN", "VB"], ["NN", "DT"]]


def best_path(words, tags, start, move, emit, end):
    import itertools

    def score(path):
        return start(path[0]) + sum(emit(t, w) for t, w in zip(path, words)) + sum(move(path, i) for i in range(1, len(path))) + end(path[-1])

    return max(score(p) for p in itertools.product(tags, repeat=len(words))), score


def test_context_taggers_of_queries_shuffle_no_tokens(spark):
    """Training pairs tags within arrays, and a token carries its word's contexts as a short text."""
    for name in ("tag_bigram", "tag_trigram"):
        plan = CATALOG[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "lag(" not in plan and "Window" not in plan


def test_context_tagger_reads_codes(spark):
    rows = token_rows(spark, [[("a", "X"), ("b", "Y"), ("a", "Z")], [("b", "X"), ("a", "X")], []])
    asked = token_rows(spark, [[("a", ""), ("b", ""), ("new", ""), ("a", "")], [("b", ""), ("a", "")]])
    two = by_sentence(taggers.context_tag(asked, taggers.context_train(rows, 2), 2, "D"))
    assert two == [["X", "Y", "D", "D"], ["X", "X"]]


def test_transitions_of_arrays(spark):
    said = [[("a", "X"), ("b", "Y"), ("a", "Z")], [("b", "X")], []]
    rows = token_rows(spark, said)
    arrays = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "sent_id int, s array<struct<word:string,tag:string>>")
    (tnt, e), (other, f) = taggers.tnt_train(rows), taggers.tnt_train(rows, arrays)
    assert tnt.tags == other.tags and np.array_equal(tnt.three, other.three) and np.array_equal(tnt.uni, other.uni) and sorted(e.collect()) == sorted(f.collect())
    (hmm, _), (other, _) = taggers.hmm_train(rows), taggers.hmm_train(rows, arrays)
    assert hmm.tags == other.tags and np.array_equal(hmm.moves, other.moves)


def test_slices_of_a_batch(monkeypatch):
    """Few rows of a batch are Python objects at once, also where they are long; nulls and order stay."""
    import pyarrow as pa

    monkeypatch.setattr(arrow, "SLICE", 64)
    texts = ["x y"] * 50 + [None, "", "z" * 1000] + ["a b c"] * 50
    sizes = []
    whole = pa.Array.to_pylist

    class Spy:
        def __init__(self, a):
            self.a, self.nbytes = a, a.nbytes

        def __len__(self):
            return len(self.a)

        def slice(self, i, n):
            sizes.append(len(self.a.slice(i, n)))
            return self.a.slice(i, n)

    got = arrow._by_slices(str.split, pa.list_(pa.string()), Spy(pa.array(texts)))
    assert whole(got) == [None if x is None else x.split() for x in texts] and max(sizes) < 20
    assert len(arrow._by_slices(str.split, pa.list_(pa.string()), pa.array([], pa.string()))) == 0


def test_chunks_are_sent_tags_only(spark):
    df = spark.createDataFrame([([("w", "NN"), ("v", "X")],), (None,)], "t array<struct<word:string,tag:string>>")
    got = df.select(arrow.chunks(F.col("t"), "NP: {<NN>}").alias("c"))
    assert [r.c for r in got.collect()] == [["B-NP", "O"], None]
    assert "t#" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and ".tag" in plan


def test_counts_of_tiles_forget_words():
    left = texttiling.Counter(["a", "a", "b"])
    texttiling._leave(left, ["a", "b"])
    assert dict(left) == {"a": 1}


def test_textcat_train_reads_a_text_once(spark):
    """A long text: its trigrams are of its characters, not substrings looked for from its start."""
    docs = spark.createDataFrame([("xx", "ab\U0001d49c" + "abc " * 20_000), ("yy", "a"), ("zz", ""), (None, "abc")], "lang string, text string")
    made = classify.textcat_train(docs)
    assert "substring" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.lang, r.trigram): r["rank"] for r in made.collect()}
    assert got["xx", " ab"] == 0 and got["xx", "abc"] == 1 and ("xx", "b\U0001d49ca") in got and ("xx", " ab") in got and got["yy", " a "] == 0 and not any(lang == "zz" for lang, _ in got)


def test_everygrams_of_a_long_text(spark, tmp_path):
    """Distinct pairs are hashed: comparing each with each takes minutes here."""
    text = " ".join(f"w{i}" for i in range(60_000)) + " w0 w1"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    got = {r.doc_id: (r.n, r.kinds) for r in CATALOG["everygrams_padded"][0](spark, str(tmp_path)).collect()}
    assert got[1] == (60_004 + 60_003, 60_002 + 60_002) and got[3] == (3, 3) and time.time() - began < 30


def test_models_of_texts_are_counted_once(spark):
    """The sums that a model is joined with share its count of the texts."""
    docs = spark.createDataFrame([("a b a c",), ("b",), ("",), (None,)], "text string").repartition(2)
    counted = lambda: language_models.fit(docs, F.split("text", " "), 2)
    asked = spark.createDataFrame([(["a"], "b"), (["q"], "b")], "context array<string>, word string")
    for df in (language_models.scores(counted()), language_models.kneser_ney(counted()), language_models.point_scores(counted(), asked, 2), language_models.point_scores(counted(), asked, 2, "laplace")):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Generate inline") == 1, plan


def test_rows_with_equal_features_are_scored_once(spark):
    rows = spark.createDataFrame([(1, "a", {"x": "1", "y": "2"}), (2, "b", {"y": "2", "x": "1"}), (3, "b", {"x": "2"}), (4, "a", {}), (5, "a", None)], "id long, label string, features map<string,string>")
    model = classify.naive_bayes_train(rows)
    scored = classify.naive_bayes_scores(model, rows)
    assert "explode(f#" in scored._jdf.queryExecution().optimizedPlan().toString()
    logp = {(r.label, r.feature): r.logp for r in model.collect()}
    for r in scored.collect():
        own = {1: ("x=1", "y=2"), 2: ("x=1", "y=2"), 3: ("x=2",)}.get(r.id, ())
        assert math.isclose(r.logp, logp[r.label, None] + sum(logp[r.label, f] for f in own))
    assert sorted((r.id, r.label) for r in scored.collect()) == [(i, x) for i in range(1, 6) for x in "ab"]
    assert "explode(key#" in classify.maxent_scores(classify.maxent_train(rows.filter("id < 5")), rows)._jdf.queryExecution().optimizedPlan().toString()


def test_toktok_classes_of_java(spark):
    """The patterns that Java runs match what those of the SQL match, in each character."""
    text = " ".join(chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x10000), 0x1F600])
    df = spark.createDataFrame([(text,)], "t string")
    split = [(p, to.replace("\\", "$")) for p, to in tokenizers.TOKTOK if tokenizers._java(p) != p.replace("(?m)", "(?md)")]
    assert len(split) == 3
    for p, to in split:
        assert df.select(F.regexp_replace("t", p, to) == F.regexp_replace("t", tokenizers._java(p), to)).first()[0]


def test_hmm_against_all_paths(spark):
    rows = token_rows(spark, TRAIN)
    hmm, emissions = taggers.hmm_train(rows)
    counts_ = {(r.tag, r.word): r.n for r in emissions.collect()}
    at = hmm.place
    emit = lambda t, w: math.log((counts_.get((t, w), 0) + 1) / (hmm.uses[at[t]] + hmm.k)) if (t, w) in counts_ or not any(k[1] == w for k in counts_) else tagging.NEVER
    for words in (["the", "dog", "runs"], ["the", "new", "end"], ["dogs", "run"], ["zzz"]):
        top, score = best_path(words, hmm.tags, lambda t: hmm.moves[-1, at[t]], lambda p, i: hmm.moves[at[p[i - 1]], at[p[i]]], emit, lambda t: hmm.moves[at[t], -1])
        got = by_sentence(taggers.hmm_tag(token_rows(spark, [[(w, "") for w in words]]), (hmm, emissions)))[0]
        assert score(tuple(got)) == pytest.approx(top)
    with pytest.raises(ValueError):
        taggers.hmm_train(rows.limit(0))


def test_tnt(spark):
    rows = token_rows(spark, TRAIN)
    model = taggers.tnt_train(rows)
    tnt = model[0]
    assert np.exp(tnt.two).sum(1) == pytest.approx(1) and set(tnt.tags) == {"<S>", "<E>", "DT", "NN", "NNS", "VB"}
    asked = token_rows(spark, [[("the", ""), ("dog", ""), ("runs", "")], [("The", ""), ("new", ""), ("end", "")], [("runs", "")]])
    got = by_sentence(taggers.tnt_tag(asked, model))
    assert got[0] == ["DT", "NN", "NN"] or got[0] == ["DT", "NN", "VB"]
    assert all(t not in ("<S>", "<E>") for s in got for t in s) and len(got[1]) == 3


def test_perceptron(spark, tmp_path):
    rng = random.Random(2)
    make = lambda: [(rng.choice(["the", "a"]), "DT"), (rng.choice("cat dog house tree".split()) + rng.choice(["", "s"]), "N"), (rng.choice("walk jump play".split()) + "ed", "V")]
    sentences = [make() for _ in range(120)]
    model = taggers.perceptron_train(token_rows(spark, sentences), 3)
    test = [[("the", "DT"), ("mousedogs", "N"), ("jumped", "V")], *[make() for _ in range(20)]]
    assert all(model.tag([w for w, _ in s]) == [t for _, t in s] for s in test)
    taggers.save_perceptron(spark, model, str(tmp_path / "m"))
    again = taggers.load_perceptron(spark, str(tmp_path / "m"))
    assert (again.weights, again.tagdict, again.classes) == (model.weights, model.tagdict, model.classes)
    (tmp_path / "m.json").write_text(json.dumps({"weights": {"bias": {"X": 1.0}}, "classes": ["X", "Y"]}))
    assert taggers.load_perceptron(spark, str(tmp_path / "m.json")).tag(["q"]) == ["X"]
    assert tagging.Perceptron({}, {}, []).tag(["q"]) == ["NN"]
    df = spark.createDataFrame([(["the", "cats"],), (None,), ([],)], "w array<string>")
    got = [r[0] for r in df.select(taggers.pos_tag(F.col("w"), model, {"N": "NOUN"})).collect()]
    assert [tuple(x) for x in got[0]] == [("the", "DT"), ("cats", "NOUN")] and got[1] is None and got[2] == []
    assert [r[0] for r in df.limit(1).select(taggers.untag(taggers.pos_tag(F.col("w"), model))).collect()] == [["the", "cats"]]


def featured(spark):
    data = [(i, ["a", "b", "b"][i % 3], {"x": str(i % 2), "y": str(i % 3 == 0)}) for i in range(60)]
    return spark.createDataFrame(data, "id int, label string, features map<string,string>")


def test_maximum_entropy(spark, monkeypatch):
    rows = featured(spark)
    model = classify.maxent_train(rows, 15)
    local = {(r.label, r.feature): r.weight for r in model.collect()}
    monkeypatch.setattr(classify, "MAXENT_LOCAL", 0)
    spread = {(r.label, r.feature): r.weight for r in classify.maxent_train(rows, 15).collect()}
    assert spread == pytest.approx(local)
    got = classify.maxent_scores(model, rows)
    best = {r.id: r.label for r in classify.best_label(got.withColumn("logp", F.ln("prob"))).collect()}
    assert all(best[r.id] == r.label for r in rows.collect())
    assert all(r[0] == pytest.approx(1) for r in got.groupBy("id").agg(F.sum("prob")).select(F.col("sum(prob)")).collect())
    assert classify.maxent_informative(model, 2).count() == 2
    with pytest.raises(ValueError):
        classify.maxent_train(rows.limit(0))


def test_language_identification(spark):
    en, de = "the cat sat on the mat and the dog ate the hat with this that", "der hund und die katze sind auf der matte mit dem hut und das ist nicht"
    docs = spark.createDataFrame([("en", en), ("de", de)], "lang string, text string")
    asked = spark.createDataFrame([("that the hat",), ("und der hut ist",), ("123",), (None,)], "text string")
    got = classify.textcat(asked, classify.textcat_train(docs)).collect()
    assert [r.guess for r in got] == ["en", "de", "unknown", "unknown"] and got[0].confidence > 0


def test_point_scores(spark):
    docs = spark.createDataFrame([("a b a",), ("a c",)], "text string")
    model = language_models.fit(docs, F.split("text", " "), 2)
    asked = spark.createDataFrame([(["a"], "b"), (["a"], "zzz"), (["q"], "a"), ([], "a"), (["x", "a"], "c"), (None, "a")], "context array<string>, word string")
    got = [(r.context, r.word, r.score, r.logscore) for r in language_models.point_scores(model, asked, 2).collect()]
    by = {}
    for c, w, s, l in got:
        by.setdefault((tuple(c), w), (s, l))
    assert by[("a",), "b"][0] == pytest.approx(1 / 3) and by[("a",), "c"][0] == pytest.approx(1 / 3) and by[("<s>",), "a"][0] == 1
    assert by[("a",), "zzz"] == (0, float("-inf")) and by[("q",), "a"] == (0, float("-inf"))
    v = language_models.vocabulary_size(model).first().v
    assert v == 5
    laplace = {(tuple(r.context), r.word): r.score for r in language_models.point_scores(model, asked, 2, "laplace").collect()}
    assert laplace[("a",), "zzz"] == pytest.approx(1 / (3 + v)) and laplace[("q",), "a"] == pytest.approx(1 / v)
    text = language_models.generate(model, 2, 6, None, 3)
    assert text == language_models.generate(model, 2, 6, None, 3) and set(text) <= {"a", "b", "c", "</s>"} and text[0] == "a"
    fd = spark.createDataFrame([("a", 3), ("b", 1)], "sample string, count long")
    known = language_models.vocabulary(fd, 2)
    assert [r.token for r in language_models.looked_up(spark.createDataFrame([("a",), ("b",)], "token string"), known).collect()] == ["a", "<UNK>"]


def test_sentiment(spark):
    texts = ["I love this", "I do not love this", "This is VERY good!", "very good but terrible", "a", None, "GOOD news", "plain words only"]
    rows = sentiment.polarity_scores(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    norm = lambda s: round(s / math.sqrt(s * s + 15), 4)
    got = [r.compound for r in rows]
    assert got[0] == norm(3.2) and got[1] == norm(3.2 * -0.74) and got[2] == norm(1.9 + 0.293 + 0.292)
    assert got[3] == norm((1.9 + 0.293) * 0.5 - (2.1 + 0.293 * 0.9) * 1.5) and got[4] == 0 and got[5] is None
    assert got[6] == norm(1.9 + 0.733) and (rows[7].neu, rows[7].pos) == (1, 0) and rows[4].neu == 1


def test_bleu(spark):
    rows = spark.createDataFrame([(1, "the cat sat on the mat".split(), "the cat is on the mat".split()), (2, ["a"], ["a"]), (3, [], ["a"]), (4, "x x x".split(), "x y".split())], "id int, c array<string>, r array<string>")
    got = {r.id: r.bleu for r in scores.bleu(rows, "id", "c", "r").collect()}
    want = math.exp((math.log(5 / 6) + math.log(3 / 5) + math.log(1 / 4)) / 3)
    assert got == pytest.approx({1: want, 2: 1.0, 3: 0.0, 4: 1 / 3})
    assert {r.id: r.bleu for r in scores.bleu(rows, "id", "c", "r", standard=True).collect()}[1] == 0
    pooled = scores.corpus_bleu(rows, "id", "c", "r").first().bleu  # hits 7 of 10, 3 of 7, 1 of 4; both sides have 10 words
    assert pooled == pytest.approx(math.exp((math.log(7 / 10) + math.log(3 / 7) + math.log(1 / 4)) / 3))
    assert scores.corpus_bleu(rows.limit(0), "id", "c", "r").first().bleu == 0


def test_agreement(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0)], "a double, b double")
    r = scores.alpha(df, "a", "b").first()
    assert r.n == 2 and r.alpha == pytest.approx(1 - 0.5 / np.mean(np.abs(np.array([1, 2, 3, 3]) - 2.25)))
    labels = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("y", "y")], "a string, b string")
    p = scores.pi(labels, F.col("a"), F.col("b")).first()
    e = (3 / 8) ** 2 + (5 / 8) ** 2
    assert p.pi == pytest.approx((0.75 - e) / (1 - e), abs=1e-5)


def test_counts(spark):
    fd = spark.createDataFrame([("a", 3), ("b", 1)], "sample string, count long")
    delta = spark.createDataFrame([("a", 2), ("c", 1), ("a", 1)], "sample string, count long")
    rows = lambda df: {r["sample"]: r["count"] for r in df.collect()}
    assert rows(counts.increased(fd, delta)) == {"a": 6, "b": 1, "c": 1}
    assert rows(counts.assigned(fd, delta.filter("sample = 'c'"))) == {"a": 3, "b": 1, "c": 1}
    assert rows(counts.looked_up(fd, delta.select("sample").distinct())) == {"a": 3, "c": 0}
    assert [r[0] for r in counts.contains(fd, delta.select("sample").distinct()).collect()] == ["a"]
    assert [r[0] for r in counts.samples(fd).collect()] == ["a", "b"]
    assert counts.described(fd) == "<FreqDist with 2 samples and 4 outcomes>" and counts.tabulate(fd).split() == ["a", "b", "3", "1"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(clustering.cosine(F.col("a"), F.col("b")), clustering.euclidean(F.col("a"), F.col("b"))).first()
    assert tuple(r) == pytest.approx((math.sqrt(0.5), 1.0))
    with pytest.raises(ValueError):
        clustering.k_means(spark.createDataFrame([(1, [0.0])], "id int, v array<double>"), 2)


def test_corpora(spark, tmp_path):
    (tmp_path / "b.txt").write_text("Hello there. Bye now.\n\nNext one.")
    (tmp_path / "a.txt").write_text("the/DT cat/NN sat\n\nold/JJ/x ran/VB")
    (tmp_path / "in").mkdir()
    c = corpora.plaintext(spark, str(tmp_path))
    assert [r[0] for r in corpora.fileids(c).collect()] == ["a.txt", "b.txt"]
    b = corpora.plaintext(spark, str(tmp_path), ["b.txt"])
    assert [r.word for r in corpora.words(b).orderBy("pos").collect()] == ["Hello", "there.", "Bye", "now.", "Next", "one", "."]
    assert [r.words for r in corpora.sents(b).orderBy("sent").collect()][0] == ["Hello", "there", "."]
    assert [(r.para, r.sent) for r in corpora.paras(b).orderBy("para", "sent").collect()] == [(0, 0), (0, 1), (1, 0)]
    assert tuple(corpora.sizes(b).first())[1:] == (7, 2)
    a = corpora.plaintext(spark, str(tmp_path), ["a.txt"])
    assert [(r.word, r.tag) for r in corpora.tagged_words(a).orderBy("pos").collect()] == [("the", "DT"), ("cat", "NN"), ("old/JJ", "x"), ("ran", "VB")]
    assert [r.line for r in corpora.tagged_sents(a).orderBy("line").collect()] == [0, 2]
    assert [r.word for r in corpora.words_of_tagged(a).orderBy("pos").collect()][0] == "the"
    k = corpora.categorised(spark, str(tmp_path), {"x": ["a.txt"], "y": ["a.txt", "b.txt"]})
    assert k.count() == 3 and [r[0] for r in corpora.categories(k).collect()] == ["x", "y"] and corpora.words(k.filter("category = 'y'"), "category").columns == ["fileid", "category", "pos", "word"]
    assert corpora.find("a.txt", [str(tmp_path)]).endswith("a.txt")
    with pytest.raises(LookupError):
        corpora.find("nothing")
    with pytest.raises(ValueError):
        corpora.plaintext(spark, str(tmp_path / "missing"))


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "k", "a b a"), ("2024-01-01 01:10:00", "k", "b"), ("2024-01-01 05:00:00", "j", "c")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "at string, k string, text string").selectExpr("cast(at as timestamp) at", "k", "text").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, k string, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    words = F.split("text", " ")
    got = run(stream_counts.freq_dist(stream, words), "complete", "fd")
    assert {r["sample"]: r["count"] for r in got} == {"a": 2, "b": 2, "c": 1}
    got = run(stream_counts.conditional_freq_dist(stream, F.col("k"), words), "complete", "cfd")
    assert {(r.condition, r["sample"]): r["count"] for r in got} == {("k", "a"): 2, ("k", "b"): 2, ("j", "c"): 1}
    got = run(stream_counts.windowed_freq_dist(stream, "at", words), "append", "win")
    assert {(r.start.hour, r["sample"]): r["count"] for r in got} == {(0, "a"): 2, (0, "b"): 1, (1, "b"): 1}
    assert strings.edit_distance("", "") == 0


def test_registered_functions(spark):
    from loomtext.functions.register import register

    assert "word_tokenize" in register(spark)
    row = spark.sql("SELECT word_tokenize('It is. Go.') a, space_tokenize('a  b') b, wordpunct_tokenize('a.b!') c, porter_stem('running') d, tableau_proves('q', array('p', 'p -> q')) e, word_tokenize(NULL) f").first()
    assert tuple(row) == (["It", "is", ".", "Go", "."], ["a", "", "b"], ["a", ".", "b", "!"], "run", True, None)

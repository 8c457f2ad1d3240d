import pickle
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import lexer, quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, make_docs, words):
    texts, labels = [], []
    for i in range(400):
        w = words(30, i)
        bad, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            w[3], w[9] = ["idiot", "scum"][i % 2], "idiot"
        texts.append(("!! ".join(w).upper() + "!!") if bad else " ".join(w).capitalize() + ".")
        labels.append((i, int(not bad), int(toxic)))
    return make_docs(texts), spark.createDataFrame(labels, LABELS), texts, labels


def test_quality_on_held_out_documents(spark, make_docs, words):
    docs, labels, _, rows = labelled(spark, make_docs, words)
    got = {r.doc_id: r.keep for r in quality.classify(docs, labels.filter("doc_id < 250")).collect()}
    held = [(got[i], bool(q)) for i, q, _ in rows if i >= 250]
    assert np.mean([a == b for a, b in held]) > 0.97


def test_toxicity_on_held_out_documents(spark, make_docs, words):
    docs, labels, _, rows = labelled(spark, make_docs, words)
    got = {r.doc_id: r for r in toxicity.score(docs, labels.filter("doc_id < 250")).collect()}
    held = [(got[i].toxic, bool(t)) for i, _, t in rows if i >= 250]
    assert np.mean([a == b for a, b in held]) > 0.97
    hit = next(got[i] for i, _, t in rows if i >= 250 and t)
    assert set(hit.evidence_ids) <= {i for i, _, t in rows if i < 250} and len(hit.evidence_ids) == toxicity.NEIGHBOURS


def test_nearest_against_brute_force():
    rng = np.random.default_rng(5)
    terms, n = 40, 700
    counts = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(terms, rng.integers(0, 6), replace=False)} for _ in range(n)]
    idf = rng.uniform(1, 5, terms)
    ids = rng.permutation(n).astype(np.int64)
    index = toxicity.build(ids, rng.integers(0, 2, n).astype(float), counts, np.arange(terms, dtype=np.uint64), idf)
    dense = np.zeros((len(index.ids), terms))
    for i in range(len(index.ids)):
        s, e = index.starts[i], index.starts[i + 1]
        dense[i, index.columns[s:e]] = index.weights[s:e]
    assert np.allclose((dense**2).sum(1), 1)
    for c in counts[:300]:
        if c:
            t, w = index.vector(c)
            q = np.zeros(terms)
            q[t] = w
            cosine = (dense @ q).round(9)
            want = [i for i in np.lexsort((index.ids, -cosine)) if cosine[i] > 0][:15]
            rows, got = index.nearest(t, w, 15)
            assert got == pytest.approx(cosine[want]) and [index.ids[r] for r in rows] == [index.ids[r] for r in want]


@pytest.mark.parametrize("module", [quality.classify, toxicity.score])
def test_cases(spark, make_docs, words, clashing, module):
    docs, labels, _, _ = labelled(spark, make_docs, words)
    none = spark.createDataFrame([], LABELS)
    odd = make_docs([None, "", "..", "word " * 60_000, "same", "same", "idiot"], [1000, 1001, 1002, 1003, 1004, 1004, None])
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (1000, None, None), (1004, 1, 0), (1004, 1, 0), (1001, 1, 0)], LABELS))
    name = "keep" if module is quality.classify else "toxic"
    rows = module(clashing(docs.unionByName(odd), name), labels).collect()
    assert len(rows) == 407 and all(r[f"{name}_in"] == "x" and r[name] is not None for r in rows)
    same = [r for r in rows if r.text == "same"]
    assert same[0] == same[1]
    free = module(odd, none).collect()
    assert len(free) == 7 and all(r[name] == (name == "keep") for r in free)
    assert module(make_docs([]), labels).collect() == []


def test_words_against_a_regular_expression():
    texts = ["Ab ab-AB é_x 10", None, "", "..", "İstanbul straße 語 中文", "a" * 3 + " b" * 5]
    h, bounds = lexer.words(texts)
    want = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in want]
    flat = [x for w in want for x in w]
    assert len(set(flat)) == len(set(h.tolist())) == len(set(zip(flat, h.tolist())))


def test_words_of_long_texts(monkeypatch):
    texts = ["word " * 100, "x" * 70, "a b", "tail"]
    whole = lexer.words(texts)
    monkeypatch.setattr(lexer, "PIECE", 64)
    lexer._kept().clear()
    parts = lexer.words(texts)
    lexer._kept().clear()
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_quality_against_brute_force(spark, make_docs, words):
    """The fit from the labels to the calibrated probability, done again in one process."""
    docs, labels, texts, rows = labelled(spark, make_docs, words)
    got = {r.doc_id: r for r in quality.classify(docs, labels.filter("doc_id < 250")).collect()}
    d, n = len(quality.STATISTICS), quality.FEATURES
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    x = np.concatenate([quality.statistics(b, np.array([0, len(b)])) for b in raw])
    import hashlib

    held = np.array([int(hashlib.md5(f"{quality.SEED + 1}:{i}".encode()).hexdigest()[:13], 16) / 2**52 < quality.HOLD_OUT for i in range(250)])
    y = np.array([q for _, q, _ in rows[:250]], float)
    mean, scale = x[:250].mean(0), x[:250].std(0)
    scale = np.where(scale > 1e-12, scale, 1.0)
    rng = np.random.default_rng(quality.SEED)
    w, phase = rng.normal(size=(d, n)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, n)
    z = np.clip((x - mean) / scale, -6, 6)
    f = np.hstack([np.sqrt(2 / n) * np.cos(z @ w + phase), z, np.ones((len(x), 1))])
    fit = f[:250][~held]
    ridge = np.linalg.solve(fit.T @ fit + quality.RIDGE * np.eye(f.shape[1]), fit.T @ y[~held])
    score = f @ ridge
    order = np.argsort(score[:250][held], kind="stable")
    xs, ys = score[:250][held][order], y[held][order]
    best = [max(min(ys[a : b + 1].mean() for b in range(i, len(ys))) for a in range(i + 1)) for i in range(len(ys))]  # min-max formula
    for i in range(400):
        at = np.searchsorted(xs, score[i], side="right") - 1
        assert got[i].score == pytest.approx(score[i], abs=1e-6) and got[i].quality == pytest.approx(best[max(at, 0)], abs=1e-6)


@pytest.mark.parametrize("module", [quality.classify, toxicity.score])
def test_any_column_name(spark, make_docs, words, module):
    docs, labels, _, _ = labelled(spark, make_docs, words)
    odd = docs.selectExpr("*", "'f' AS found", "1 AS `a.b`", "2 AS in_0_")
    got = module(odd, labels)
    assert got.columns[: len(odd.columns)] == odd.columns and got.filter("found = 'f' AND `a.b` = 1 AND in_0_ = 2").count() == 400


def test_an_id_with_two_texts(spark, make_docs):
    docs = make_docs(["one clean text", "you idiot scum", "another clean text here"], [1, 1, 2])
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], LABELS)
    a, b = (sorted((r.doc_id, r.text, r.toxicity, r.evidence_ids) for r in toxicity.score(x, labels).collect()) for x in (docs, docs.repartition(3)))
    assert a == b


def test_isotonic():
    x, y = np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1])
    steps, values = quality.isotonic(x, y)
    assert list(steps) == [1, 2, 4] and values == pytest.approx([0, 1 / 3, 1])


def test_statistics_by_hand():
    text = "Ab ab ab\nXY é|1\n\nAb ab ab"
    data = np.frombuffer(text.encode(), np.uint8)
    row = dict(zip(quality.STATISTICS, quality.statistics(np.concatenate([data, data]), np.array([0, len(data), 2 * len(data)]))[1]))
    assert row["log_bytes"] == pytest.approx(np.log1p(len(data)))
    assert row["upper"] == pytest.approx(4 / len(data)) and row["pipe"] == pytest.approx(1 / len(data))
    assert row["repeats_previous"] == pytest.approx(2 / 8)
    assert row["distinct_lines"] == pytest.approx(2 / 3)
    assert row["distinct_words"] == pytest.approx(4 / 8)


def test_all_words_of_the_examples_are_terms(spark, make_docs, words):
    """Clean documents have no word that tells the labels apart; their neighbours are those of a brute force over all words."""
    docs, labels, texts, rows = labelled(spark, make_docs, words)
    index = toxicity.fit(docs, labels.filter("doc_id < 250"))
    seen = [Counter(re.findall(r"[^\W_]+", t.lower())) for t in texts]
    names = {t: int(lexer.words([t])[0][0]) for c in seen for t in c}
    vocabulary = {t: i for t in {t for c in seen[:250] for t in c} for i in np.flatnonzero(index.vocabulary == np.uint64(names[t])).tolist()}
    assert set(vocabulary) == {t for c in seen[:250] for t in c} and len(index.vocabulary) == len(vocabulary)
    df = Counter(t for c in seen for t in c)
    plain = {t: np.log((1 + len(texts)) / (1 + df[t])) + 1 for t in vocabulary}
    factor = {t: index.idf[i] / plain[t] for t, i in vocabulary.items()}
    assert {round(x, 6) for x in factor.values()} == {1, toxicity.LEAD} and round(factor["idiot"], 6) == toxicity.LEAD

    def vector(c):
        v = {t: (1 + np.log(n)) * plain[t] * factor[t] for t, n in c.items() if t in plain}
        size = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = [vector(c) for c in seen]
    got = {r.doc_id: r for r in toxicity.score(docs, labels.filter("doc_id < 250")).collect()}
    for q in range(250, 400, 7):
        cosines = [(-round(sum(x * v.get(t, 0) for t, x in vectors[q].items()), 9), i) for i, v in enumerate(vectors[:250])]
        want = sorted(x for x in cosines if x[0] < 0)[: toxicity.NEIGHBOURS]
        assert got[q].evidence_ids == [i for _, i in want] and got[q].evidence_cosines == pytest.approx([-c for c, _ in want], abs=1e-8)


def test_bounds_leave_out_no_neighbour(monkeypatch):
    rng = np.random.default_rng(6)
    n, terms = 900, 60
    counts = [{int(t): 1 for t in rng.choice(terms, 3, replace=False)} for _ in range(n)]
    idf = np.where(np.arange(terms) < 20, toxicity.LEAD, 1.0)
    index = toxicity.build(np.arange(n), rng.integers(0, 2, n).astype(float), counts, np.arange(terms, dtype=np.uint64), idf)
    vectors = [index.vector(c) for c in counts[:200]]
    few = index.all_nearest(vectors, 15)
    monkeypatch.setattr(toxicity, "FEW_BLOCKS", 0)
    for (a, x), (b, y) in zip(few, index.all_nearest(vectors, 15)):
        assert a.tolist() == b.tolist() and x == pytest.approx(y)


def _peak(call):
    """(result, most bytes that the call held at once)"""
    tracemalloc.start()
    try:
        return call(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _large_index():
    rng = np.random.default_rng(8)
    n, terms = 3_000, 60_000
    counts = [dict.fromkeys(np.unique((rng.random(200) ** 3 * terms).astype(int)).tolist(), 1 + i % 3) for i in range(n)]
    vocabulary = np.sort(lexer.words([" ".join(f"w{i}" for i in range(terms))])[0])
    return toxicity.build(np.arange(n), rng.integers(0, 2, n).astype(float), counts, vocabulary, np.ones(terms)), counts


def test_the_index_takes_little_memory_in_a_worker():
    index, counts = _large_index()
    entries = len(index.columns)
    sent = pickle.dumps(index)
    assert len(sent) < 5 * entries
    again = pickle.loads(sent)
    vectors = [index.vector(c) for c in counts[:40]]
    for (a, x), (b, y) in zip(index.all_nearest(vectors, 15), again.all_nearest(vectors, 15)):
        assert a.tolist() == b.tolist() and x.tolist() == y.tolist()
    tables, peak = _peak(lambda: toxicity.Tables.of(again))
    assert peak - tables.matrix.nbytes < 36 * entries


def test_scoring_a_batch_holds_no_copy_of_its_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "TEXTS", 4)
    index, _ = _large_index()
    texts = [f"w{i} " + "long " * 2_000 for i in range(1_500)]
    texts = pa.array([*texts, None, "", *texts[:5]])
    index.all_nearest([], 15)
    score = toxicity._scorer(index, 15).func
    score(texts[:20])
    got, peak = _peak(lambda: score(texts))
    assert len(got) == len(texts) and peak < texts.nbytes
    assert got[:5].equals(got[-5:]) and got[1500].as_py() == got[1501].as_py() and got[1500]["ids"].as_py() == []


def test_statistics_are_taken_slice_by_slice(monkeypatch):
    texts = pa.array([f"Some words, {i} of THEM!\n" * 100 for i in range(3_000)])
    whole, peak = _peak(lambda: quality._of_texts(texts))
    assert peak < 10 * texts.nbytes
    monkeypatch.setattr(quality, "_SLICE", 10_000)
    assert (quality._of_texts(texts) == whole).all()

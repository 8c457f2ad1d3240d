import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import ngram_join as J


def grams(text, n=J.N):
    import re

    w = [x for x in re.split(r"[^a-z0-9]+", (text or "").lower()) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(texts, t=J.THRESHOLD):
    sets = {x: grams(x) for x in set(texts) if x}
    names = sorted(sets)
    return {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}


def corpus(words, seed, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = words(rng.choice([1, 2, 3, 5, 8, 20, 60, 200]), seed + i)
        out.append(" ".join(w))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 8))):
                v[rng.randrange(len(v))] = "q" + str(rng.randrange(50))
            out.append(" ".join(v))
    return out


def grouped(nodes, pairs):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[root(a)] = root(b)
    return root


@pytest.mark.parametrize(("seed", "band"), [(1, 2_000_000), (2, 2_000_000), (3, 7)])
def test_every_link_is_found(spark, make_docs, words, monkeypatch, seed, band):
    monkeypatch.setattr(J, "BAND_DOCS", band)
    texts = corpus(words, seed)
    pairs = brute(texts)
    docs = make_docs(texts)
    found = J.pair_sets(docs).collect()
    by_key = {r.k: r.text for r in docs.select(J.text_key(docs.text).alias("k"), "text").collect()}
    assert {tuple(sorted((by_key[r.a], by_key[r.b]))) for r in found} == pairs
    for r in found:
        a, b = grams(by_key[r.a]), grams(by_key[r.b])
        assert (r.shared, r.total) == (len(a & b), len(a | b))
    linked = {t: {t} for t in texts}
    for a, b in pairs:
        linked[a].add(b)
        linked[b].add(a)
    root = grouped(set(texts), pairs)
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(root(t), i)
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_classes(docs).collect()}
    assert got == {i: (least[root(t)], sum(texts.count(x) for x in linked[t]) - 1) for i, t in enumerate(texts)}


def test_copies_and_a_variant_of_many(spark, make_docs):
    """A text of half the documents, and variants that chain: no pair is lost, none is made of equal texts."""
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join(base)] * 300 + [" ".join([*base[:40 - i], *[f"v{i}{j}" for j in range(i)]]) for i in range(1, 6)] + [f"alone {i} of its own kind x{i}" for i in range(50)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in J.near_classes(make_docs(texts)).collect()}
    sets = [grams(t) for t in texts]
    for i in [0, 299, *range(300, 355)]:
        want = sum(len(sets[i] & x) / len(sets[i] | x) >= J.THRESHOLD for j, x in enumerate(sets) if j != i)
        assert got[i][1] == want
    assert all(got[i][0] == 0 for i in range(300)) and all(got[i] == (i, 0) for i in range(305, 355))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=24), min_size=2, max_size=12), st.sampled_from([0.5, 0.7, 0.8]), st.sampled_from([1, 3]))
def test_signatures_miss_no_pair(sets, t, parts):
    """The kernels alone, on sets of single words; near copies are made by changing elements."""
    sets = sets + [s ^ {i % 41} for i, s in enumerate(sets) if len(s ^ {i % 41})]
    arrays = [np.unique(np.array([x * 7919 + 13 for x in s], np.uint64)) for s in sets]
    out = {}
    seen = np.zeros((1 << 20) + 1, np.int32)
    J._packed(np.arange(len(sets)), [np.sort(J._mix(a)) for a in arrays], t, J.bands(t), {b: (1, parts) for b in range(40)}, out, seen)
    table = pa.Table.from_batches([J._flush(out)])
    got = set()
    for b in set(table.column("task").to_pylist()):
        part = J._candidates(t)(table.filter(pa.compute.equal(table.column("task"), b)))
        got |= set(zip(part.column(0).to_pylist(), part.column(1).to_pylist()))
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] != sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= t}
    assert want <= got


def test_cases(spark, make_docs, clashing):
    long = " ".join(f"w{i}" for i in range(60_000))
    texts = [None, "", "...", "one", "one", "One!", None, "", long, long + " more", "a b c", "a b c"]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None]
    docs = clashing(make_docs(texts, ids), "class_id").withColumnRenamed("lang", "a.b")
    rows = sorted(((r.doc_id, r.class_id, r.n_links) for r in J.near_classes(docs).collect()), key=str)
    alone = [(i, i, 0) for i in (0, 1, 2, 6, 7)]
    assert rows == sorted([*alone, (3, 3, 2), (4, 3, 2), (5, 3, 2), (8, 8, 1), (9, 8, 1), (10, 10, 1), (None, 10, 1)], key=str)
    assert J.near_classes(make_docs([])).collect() == []
    again = make_docs(["x y z", "x y z", "p q r"], [1, 1, 1])
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in J.near_classes(again).collect()) == [(1, 1, 0), (1, 1, 0)]
    lost = make_docs(["x y z", "x y z"], [None, None])
    assert [(r.doc_id, r.class_id) for r in J.near_classes(lost).collect()] == [(None, None)]


def test_deduplicate_cases(spark, make_docs):
    docs = make_docs(["x y z", "x y z", "x y z", None, None, ""], [1, 1, None, 2, 2, 3]).selectExpr("*", "'t' AS node", "doc_id AS `a.b`", "1 AS component")
    got = J.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.node, r["a.b"]) for r in got.collect() if r.text is not None) == [(1, "x y z", "t", 1), (3, "", "t", 3)]
    assert [r.doc_id for r in got.collect() if r.text is None] == [2, 2]
    assert J.deduplicate(make_docs([])).collect() == []


def test_one_of_each_group_stays(spark, make_docs, words):
    texts = corpus(words, 9, 40) + [None, None, "", "..", "..", "same text here"]
    ids = [*range(len(texts) - 1), None]
    kept = J.deduplicate(make_docs(texts, ids)).collect()
    parent = {x: x for x in set(texts) if x}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(texts):
        parent[root(a)] = root(b)
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(root(t) if grams(t) else f"alone{i}", []).append(ids[i] if ids[i] is not None else 10**9)
    assert sorted(r.doc_id if r.doc_id is not None else 10**9 for r in kept) == sorted(min(g) for g in groups.values())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 201)]
    got = {r.node: r.component for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
    assert J.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bad_parameters(make_docs):
    with pytest.raises(ValueError):
        J.near_classes(make_docs(["a"]), threshold=0)


def test_candidates_grow_with_documents(monkeypatch):
    """600 variants of one text, whose signatures lie in many tasks: each task reports at most a tree of them, and all are connected."""
    monkeypatch.setattr(J, "TASK_BUCKETS", 1)
    rng = np.random.default_rng(3)
    base = J._mix(np.arange(1, 301, dtype=np.uint64))
    sets = []
    for i in range(600):
        new = J._mix(np.arange(1000 + 10 * i, 1006 + 10 * i, dtype=np.uint64))
        sets.append(np.sort(np.concatenate([rng.permutation(base)[6:], new])))
    out = {}
    J._packed(np.arange(600), sets, 0.7, J.bands(0.7), {b: (16, 1) for b in range(40)}, out, np.zeros((1 << 20) + 1, np.int32))
    table = pa.Table.from_batches([J._flush(out)])
    edges, tasks = [], set(table.column("task").to_pylist())
    assert len(tasks) > 16
    for b in tasks:
        part = J._candidates(0.7, True)(table.filter(pa.compute.equal(table.column("task"), b)))
        assert len(part) < 600
        edges += zip(part.column(0).to_pylist(), part.column(1).to_pylist())
    root = grouped(range(600), edges)
    assert len({root(i) for i in range(600)}) == 1


def test_components_in_parts(spark, make_docs, words, monkeypatch):
    """Components of more n-grams than a task takes: pairs within and between parts count once each."""
    monkeypatch.setattr(J, "TASK_GRAMS", 300)
    base = words(60, 5)
    rng = random.Random(5)
    texts = [" ".join(base)] * 2
    for i in range(40):
        v = list(base)
        for _ in range(rng.randint(1, 6)):
            v[rng.randrange(len(v))] = f"q{rng.randrange(500)}"
        texts.append(" ".join(v))
    docs, sets = make_docs(texts), [grams(t) for t in texts]
    near = [{j for j, x in enumerate(sets) if j != i and len(s & x) / len(s | x) >= J.THRESHOLD} for i, s in enumerate(sets)]
    root = grouped(range(len(texts)), [(i, j) for i, x in enumerate(near) for j in x])
    least = {}
    for i in range(len(texts)):
        least.setdefault(root(i), i)
    assert {r.doc_id: (r.class_id, r.n_links) for r in J.near_classes(docs).collect()} == {i: (least[root(i)], len(x)) for i, x in enumerate(near)}
    assert J.pair_sets(docs).count() == len(brute(texts))
    assert sorted(r.doc_id for r in J.deduplicate(docs).collect()) == sorted(least.values())


def test_a_tree_of_verified_pairs():
    """300 variants, of which every two are linked: their group is a tree and counts, not pairs."""
    base = J._mix(np.arange(1, 101, dtype=np.uint64))
    sets = [np.sort(np.concatenate([base, J._mix(np.arange(1000 + 3 * i, 1003 + 3 * i, dtype=np.uint64))])) for i in range(300)]
    cols = {"task": [0] * 300, "component": [7] * 300, "rid": list(range(300)), "part": [0] * 300, "cross": [False] * 300, "n": [2] * 300, "grams": [s.tobytes() for s in sets]}
    for want in (J.FOREST, J.LINKS):
        rows = J._verified(0.7, want)(pa.table(cols)).to_pylist()
        edges = [(r["a"], r["b"]) for r in rows if r["b"] is not None]
        root = grouped(range(300), edges)
        assert len(edges) == 299 and len({root(i) for i in range(300)}) == 1
        assert {r["a"]: r["linked"] for r in rows if r["b"] is None} == ({} if want == J.FOREST else {i: 598 for i in range(300)})

import math
from collections import Counter, defaultdict

import pytest

from loomtext.llm import katz


def brute(corpus, order):
    """Probability of a word after a context, from nested dictionaries."""
    import re

    grams = [Counter() for _ in range(order + 1)]
    toks = lambda t: [katz.START] * (order - 1) + [w for w in re.split(r"[^a-z0-9]+", t.lower()) if w] + [katz.END]
    for t in corpus:
        if t is None:
            continue
        w = toks(t)
        for i in range(order - 1, len(w)):
            for m in range(1, order + 1):
                grams[m][tuple(w[i - m + 1 : i + 1])] += 1
    k = katz.DISCOUNT_TO
    p, alpha = {}, {}
    for m in range(1, order + 1):
        seen = Counter(grams[m].values())
        d = katz.discounts([seen[r] for r in range(1, k + 2)], k)
        total, least = Counter(), defaultdict(lambda: 1 << 30)
        for g, n in grams[m].items():
            total[g[:-1]] += n
            least[g[:-1]] = min(least[g[:-1]], n)
        sums = defaultdict(lambda: [0.0, 0.0])
        for g, n in grams[m].items():
            if m > 1 and n < katz.MIN_COUNT:
                continue
            p[g] = (d[n - 1] if n <= k else 1) * n / (total[g[:-1]] + (least[g[:-1]] > k))
            if m > 1:
                sums[g[:-1]][0] += p[g]
                sums[g[:-1]][1] += p[g[1:]]
        alpha |= {c: (1 - a) / (1 - b) for c, (a, b) in sums.items()}
    unknown = 1 - sum(p[g] for g in grams[1])

    def prob(g):
        if g in p:
            return p[g]
        return unknown if len(g) == 1 else alpha.get(g[:-1], 1.0) * prob(g[1:])

    def score(t):
        w = toks(t)
        return sum(math.log(prob(tuple(w[i - order + 1 : i + 1]))) for i in range(order - 1, len(w))), len(w) - order + 1

    return score, prob, grams


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, make_docs, words, order, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 500)
    monkeypatch.setattr(katz, "BUCKET_NGRAMS", 800)
    corpus = [" ".join(w[:3] * 2 + w) for w in (words(25, s % 12) for s in range(60))] + [None, "", "!"]
    queries = corpus[:5] + ["never seen words", "", None, " ".join(words(40, 3)), corpus[0]]
    score, prob, grams = brute(corpus, order)
    model = katz.fit(make_docs(corpus), order)
    got = {r.doc_id: r for r in katz.score(make_docs(queries), model).collect()}
    for i, q in enumerate(queries):
        if q is None:
            assert got[i].logprob is None and got[i].n_tokens is None
        else:
            lp, n = score(q)
            assert got[i].n_tokens == n and got[i].logprob == pytest.approx(lp, abs=1e-5)
    # normalised: every word and the unknown one sum to 1 after any context
    vocabulary = [g[0] for g in grams[1]] + ["\x01new"]
    for context in list({g[:-1] for g in grams[order]})[:20] + [("zzz",) * (order - 1)]:
        assert sum(prob((*context, w)) for w in vocabulary) == pytest.approx(1.0)


def test_cases(spark, make_docs, clashing):
    empty = katz.fit(make_docs([]))
    rows = katz.score(clashing(make_docs(["a b", None]), "logprob"), empty).orderBy("doc_id").collect()
    assert rows[0].logprob == 0 and rows[0].n_tokens == 3 and rows[1].logprob is None and rows[0].logprob_in == "x"
    model = katz.fit(make_docs(["same"] * 10))
    assert katz.score(make_docs([]), model).collect() == []
    (row,) = katz.score(make_docs(["w " * 50_000]), model).collect()
    assert row.n_tokens == 50_001 and math.isfinite(row.logprob)
    with pytest.raises(ValueError):
        katz.fit(make_docs(["a"]), order=0)


def test_discounts_fall_back():
    assert katz.discounts([0] * 6, 5) == [(r - 0.5) / r for r in range(1, 6)]


def test_ngrams_that_occur_once_are_found(spark, make_docs):
    """Every bigram of the corpus is in the model, however rare, and the count 1 is discounted."""
    corpus = ["a b c d", "a b e", "f g", "c c c a"]
    score, _, grams = brute(corpus, 2)
    assert min(grams[2].values()) == 1
    rows = katz.score(make_docs(corpus), katz.fit(make_docs(corpus))).orderBy("doc_id").collect()
    assert [r.n_backed_off for r in rows] == [0] * 4
    assert [r.logprob for r in rows] == pytest.approx([score(t)[0] for t in corpus], abs=1e-5)

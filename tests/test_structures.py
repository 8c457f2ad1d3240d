"""Parses and clusters against brute force."""

import numpy as np
import pytest

from loomtext.kernels.parsing import Grammar
from loomtext.plans import models, structures


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Customer 1 has nine orders, written in another order than that of their keys; customer 2 has two, customer 3 one."""
    states = {1: "OFPPFOOFP", 2: "FO", 3: "P"}
    rows = [(c * 100 + i, c, s) for c, w in states.items() for i, s in enumerate(w)]
    folder = tmp_path_factory.mktemp("orders")
    spark.createDataFrame(rows[::-1], "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{folder}/orders.parquet")
    return str(folder), states


def tree(w):
    """S -> P P | P S, by hand."""
    return f"(S (P {w[0]}) (P {w[1]}))" if len(w) == 2 else f"(S (P {w[0]}) {tree(w[1:])})"


def test_whole_sequences_are_parsed(spark, orders):
    folder, states = orders
    got = sorted(map(tuple, structures._parsed(spark, folder).collect()))
    assert got == [(c, tree(w)) for c, w in states.items() if len(w) > 1]
    leaves = structures._nodes(spark, folder).filter("leaf").orderBy("o_custkey", "node").collect()
    assert ["".join(r.label for r in leaves if r.o_custkey == c) for c in (1, 2)] == [states[1], states[2]]


def test_no_tree_is_left_out():
    two = Grammar.parse("S -> S S | 'a'")
    assert len(two.trees(["a"] * 9)) == 1430  # the Catalan number


def test_k_means_runs_until_it_converges(spark, tmp_path):
    """A chain of points along a line, for which ten iterations are not enough."""
    x = np.cumsum(np.random.default_rng(3).exponential(size=400))
    v = np.stack([x, np.zeros(400)], 1)
    spark.createDataFrame([(i, p) for i, p in enumerate(v.tolist())], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    v = v.astype(np.float32).astype(float)

    def brute(iterations):
        centres = v[:8].copy()
        place = lambda: ((v[:, None] - centres) ** 2).sum(2).round(9).argmin(1)
        for _ in range(iterations):
            at = place()
            new = np.array([v[at == i].mean(0) if (at == i).any() else centres[i] for i in range(8)])
            if abs(new - centres).max() < 1e-9:
                break
            centres = new
        return place().tolist()

    assert brute(10) != brute(50)
    got = models._kmeans(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.cluster for r in got] == brute(50)

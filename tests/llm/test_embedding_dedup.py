import numpy as np
import pytest

from loomtext.llm import embedding_dedup as E

VECTORS = "vec_id long, embedding array<float>, label int"


def linked(v):
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T >= E.THRESHOLD
    np.fill_diagonal(c, False)
    return c


@pytest.mark.parametrize("cell", [20, 10_000])
def test_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(E, "PART", 30)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 32))
    near = base[:80] + rng.normal(size=(80, 32)) * rng.uniform(0, 0.2, (80, 1))
    v = np.concatenate([base, near, base[:5], rng.normal(size=(1, 32)) + np.linspace(0, 0.3, 60)[:, None]]).astype(np.float32)
    data = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    got = {r.vec_id: (r.class_id, r.n_links) for r in E.near_classes(spark.createDataFrame(data, VECTORS), cell=cell).collect()}
    c = linked(v)
    least = np.arange(len(v))
    for _ in range(len(v)):
        least = np.minimum(least, np.where(c, least[None, :], len(v)).min(1))
    assert got == {i: (int(least[i]), int(c[i].sum())) for i in range(len(v))}


@pytest.mark.parametrize("dim", [24, 64, 100])
def test_recall_of_cells(spark, dim):
    """Pairs just at the threshold, in many cells, against brute force."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(1500, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    v = np.concatenate([base, 0.951 * base + np.sqrt(1 - 0.951**2) * side])
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = sum(r.n_links for r in E.near_classes(df, cell=50).collect())
    assert E.tables_of(len(v), E.THRESHOLD, 50)[0] == 6
    assert got >= 0.998 * linked(v).sum()


def test_tables_follow_the_vectors():
    assert E.tables_of(1000, 0.95, 2000) == (0, 1)
    sizes = [E.tables_of(n, 0.95, 2000)[1] for n in (10**4, 10**5, 10**6, 10**9)]
    assert sizes == sorted(sizes) and sizes[-1] < 80


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(400, 64)), rng.normal(size=(400, 64))
    x, q = x / np.linalg.norm(x, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
    q = np.where(np.arange(400)[:, None] % 2, q, 0.9 * x + 0.1 * q)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    errors, inside = [], []
    for seed in range(30):
        r = E.rotation(64, seed)
        inner, bound = E.estimate(*E.codes(x, r), *E.planes(q, r, seed), 64)
        errors.append(inner - (x * q).sum(1))
        inside.append(np.abs(errors[-1]) <= bound)
    assert abs(np.mean(errors)) < 0.004 and np.mean(inside) > 0.999


def test_cases(spark):
    z = [1.0] + [0.0] * 7
    data = [(1, z, 0), (2, z, 0), (2, z, 0), (None, z, 0), (3, None, 0), (4, [0.0] * 8, 0), (5, [1.0, 2.0], 0), (6, [None] * 8, 0), (7, [float("nan")] * 8, 0), (8, [], 0), (9, [0.0, 1e-30] + [0.0] * 6, 0), (1, [3.0] + [0.0] * 7, 0)]
    df = spark.createDataFrame(data, VECTORS).selectExpr("*", "'x' AS class_id", "1 AS `a.b`")
    assert sorted((r.vec_id, r.class_id, r.n_links) for r in E.near_classes(df).collect()) == [(1, 1, 2), (1, 1, 2), (2, 1, 2), (9, 9, 0)]
    assert E.near_classes(spark.createDataFrame([], VECTORS)).collect() == []

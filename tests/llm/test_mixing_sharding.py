import hashlib
from collections import Counter

import pytest

from loomtext.llm import mixing, sharding


def test_mixing_against_brute_force(spark, make_docs, clashing):
    texts = ["a b c", "a", "", None, "x y", "x y", "long " * 3000, "z"]
    sources = ["s1", "s1", "s2", "s2", None, None, "s3", "s3"]
    ids = [0, 1, 2, 3, 4, 4, None, 7]
    targets = {"s1": 0.5, "s2": 0.2, "absent": 0.1}
    docs = clashing(make_docs(texts, ids, sources), "copy")
    got = Counter((r.doc_id, r.source, r.text) for r in mixing.mix(docs, targets).collect())
    tokens = Counter()
    for t, s in zip(texts, sources):
        tokens[s] += len((t or "").split())
    listed = {s: w for s, w in targets.items() if tokens.get(s)}
    free = {s: n for s, n in tokens.items() if s not in listed}
    spare = max(0, 1 - sum(listed.values()))
    share = dict(listed) | {s: spare * n / sum(free.values()) for s, n in free.items() if n}
    whole, total = sum(share.values()), sum(tokens.values())
    want = Counter()
    for i, t, s in zip(ids, texts, sources):
        rate = share[s] / whole * total / tokens[s] if tokens[s] else 1.0
        key = f"{mixing.SEED}:{'null' if i is None else i}:{s or 'null'}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        want[i, s, t] += int(rate) + (u < rate - int(rate))
    assert got == +want
    assert mixing.mix(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(make_docs(["a"]), {"a": 2.0})


def fraction(r, size, seed=sharding.SEED):
    key = f"{seed + 1}:{r.source or ''}:{'true' if r.source is None else 'false'}"
    u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52 + 2.0**-53
    return ((r.source_rank - u) / size[r.source], (r.source is not None, r.source or ""))


def test_sharding(spark, make_docs, clashing, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 40)
    sources = ["hot"] * 300 + ["b"] * 60 + [None] * 40 + ["rare"]
    docs = clashing(make_docs([f"t{i}" for i in range(400)] + ["long " * 50_000], [*range(399), 5, None], sources), "shard").selectExpr("*", "'k' AS key", "1 AS `a.b`", "2 AS bucket", "3 AS local")
    sharded = sharding.shard(docs, 7)
    assert sharded.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard_in", "key", "a.b", "bucket", "local", "source_rank", "position", "shard"]
    rows = sharded.collect()
    assert all((r.key, r["a.b"], r.bucket, r.local) == ("k", 1, 2, 3) for r in rows)
    order = sorted(rows, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(401))
    size = Counter(sources)
    assert [fraction(r, size) for r in order] == sorted(fraction(r, size) for r in rows)
    for s, n in size.items():
        own = sorted((hashlib.md5(f"{sharding.SEED}:{'null' if r.doc_id is None else r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}".encode()).hexdigest(), r.source_rank) for r in rows if r.source == s)
        assert [x for _, x in own] == list(range(1, n + 1))
        for k in range(7):
            assert abs(sum(r.shard == k and r.source == s for r in rows) - n / 7) <= 2
    assert set(Counter(r.shard for r in rows).values()) <= {57, 58}
    assert sharding.shard(make_docs([]), 3).collect() == []


def test_many_sources_and_repeated_rows(spark, make_docs):
    n = 5_000
    docs = make_docs(["same"] * (n + 500), [*range(n), *[7] * 500], [f"s{i}" for i in range(n)] + ["hot"] * 500)
    rows = sharding.shard(docs, 10).collect()
    assert sorted(r.position for r in rows) == list(range(n + 500))
    assert set(Counter(r.shard for r in rows).values()) == {550}
    assert all(30 <= sum(r.shard == k and r.source == "hot" for r in rows) <= 70 for k in range(10))


def test_shards_are_written_in_order(spark, make_docs, tmp_path):
    docs = make_docs([f"t{i}" for i in range(50)], None, [f"s{i % 3}" for i in range(50)])
    sharding.write_shards(sharding.shard(docs, 5), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(r.shard for r in back.collect()) == {k: 10 for k in range(5)} and len(list((tmp_path / "out").glob("shard=*"))) == 5


def test_mixing_of_many_sources_and_clashing_names(spark, make_docs):
    docs = make_docs(["a b"] * 3000, None, [f"s{i}" for i in range(3000)]).selectExpr("*", "1 AS rate", "2 AS `a.b`", "3 AS of")
    got = mixing.mix(docs, {})
    assert got.columns == [*docs.columns, "copy"] and got.filter("rate = 1 AND `a.b` = 2 AND of = 3 AND copy = 0").count() == 3000

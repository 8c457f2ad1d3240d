from collections import Counter

import corpus_pipeline as C
from loomtext.llm import bpe

STAGES = ["quality classifier", "toxicity", "n-gram Jaccard join", "mixing sources to target weights", "BPE encoding and decoding"]


def write(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def corpus(words):
    texts, labels = [], []
    for i in range(320):
        w = words(40, i)
        bad, toxic = i % 8 == 0, i % 8 == 3
        if toxic:
            w[5] = w[20] = "idiot"
        texts.append(("!! ".join(w).upper()) if bad else " ".join(w).capitalize() + ".")
        if i % 2 == 0 or toxic:
            labels.append((i, int(not bad), int(toxic)))
    texts += [texts[1], texts[5] + " extra", texts[2].replace(" ", "  ")]
    return texts, labels


def test_stages(spark, make_docs, words, tmp_path):
    assert [n for n, _ in C.STAGES] == STAGES and C.ORACLE_SQL is None
    texts, labels = corpus(words)
    sources = [f"src{i % 3}" for i in range(len(texts))]
    folder = write(spark, tmp_path / "t", make_docs(texts, None, sources), labels)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for i, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, folder)
        if i < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        kept.append(Counter(r.doc_id for r in docs.collect()))
    bad, toxic = {i for i in range(320) if i % 8 == 0}, {i for i in range(320) if i % 8 == 3}
    good = set(range(323)) - bad
    assert not set(kept[0]) & bad and len(set(kept[0])) >= 0.95 * len(good)
    assert set(kept[1]) == set(kept[0]) - toxic
    copies = {a for a, b in ((320, 1), (321, 5), (322, 2)) if b in kept[1]}
    assert set(kept[2]) == set(kept[1]) - copies
    assert set(kept[3]) <= set(kept[2]) and sum(kept[3].values()) > 0
    rows = docs.collect()
    vocabulary = bpe.Vocabulary.load(bpe.RANKS)
    for r in rows[:20]:
        assert r.round_trip and vocabulary.decode(__import__("numpy").array(r.ids))[0].tobytes().decode() == r.text
    assert Counter(r.doc_id for r in C.run(spark, folder).collect()) == kept[4]


def test_odd_rows_and_no_rows(spark, make_docs, words, tmp_path):
    texts, labels = corpus(words)
    odd = make_docs([*texts[:60], None, "", None, "x " * 50_000], [*range(60), 900, 901, None, 902])
    folder = write(spark, tmp_path / "odd", odd, labels)
    assert C.run(spark, folder).count() > 0
    folder = write(spark, tmp_path / "none", make_docs([]), [])
    assert C.run(spark, folder).collect() == []

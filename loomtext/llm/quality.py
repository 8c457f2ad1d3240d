"""Operator 9, quality classifier: random Fourier features of document statistics approximate a Gaussian kernel;
normal equations, summed over partitions, fit ridge scores; isotonic regression on held-out rows calibrates them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import guarded, hash_text, hashed_unit, materialise, released, table

#: Labelled rows that the model is fitted on at most (chosen by a hash of the id), and the share held out to calibrate.
SAMPLE = 20_000
HOLD_OUT = 0.25
FEATURES = 192
RIDGE = 1.0
#: A document stays if its calibrated probability of good quality is at least this.
KEEP_FROM = 0.5
#: Partial sums of the normal equations that reach the driver.
SUMS = 16
SEED = 17
#: Bytes of texts that are taken at once; all sums are of whole numbers, so results are the same for any.
_SLICE = 500_000

STATISTICS = (
    "log_bytes", "upper", "digit", "space", "symbol", "sentence_end", "bang", "pipe", "odd", "word_length", "word_length_sd",
    "capitalised", "repeats_previous", "distinct_words", "distinct_lines", "log_line_words",
)


def _classes() -> np.ndarray:
    c = np.zeros((8, 256), np.float32)
    for i, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\f\v", bytes(x for x in range(33, 127) if not chr(x).isalnum()), b".?", b"!", b"|", b"#$%&*<>{}[]\\^~=+@_")):
        c[i, list(chars)] = 1
    return c


def _word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial hash of each slice of bytes, from running sums."""
    x = np.uint64(0x9E3779B97F4A7C15)
    powers = np.cumprod(np.full(len(b) + 1, x, np.uint64)) if len(b) else np.ones(1, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[: len(b)])])
    inverse = np.uint64(pow(int(x), -1, 1 << 64))
    back = np.cumprod(np.full(len(b) + 1, inverse, np.uint64))
    h = (sums[ends] - sums[starts]) * back[starts]
    return h ^ (h >> np.uint64(29))


def _per(doc: np.ndarray, value: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(doc, value, n).astype(np.float64)


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    if not len(doc):
        return np.zeros(n)
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])
    return _per(d[new], None, n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text: its UTF-8 bytes are data[offsets[i]:offsets[i + 1]], whole."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    safe = np.maximum(size, 1)
    out = np.zeros((n, len(STATISTICS)))
    out[:, 0] = np.log1p(size)
    for i, c in enumerate(_classes()):
        sums = np.concatenate([[0.0], np.cumsum(c[data], dtype=np.float64)])
        out[:, 1 + i] = (sums[offsets[1:]] - sums[offsets[:-1]]) / safe
    blank = np.isin(data, np.frombuffer(b" \t\n\r\f\v", np.uint8))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = ~blank & (np.concatenate([[True], blank[:-1]]) | edge[:-1]) if len(data) else blank
    end = ~blank & (np.concatenate([blank[1:], [True]]) | edge[1:]) if len(data) else blank
    ws, we = np.flatnonzero(start), np.flatnonzero(end) + 1
    wd = doc[ws] if len(doc) else ws
    words = _per(wd, None, n)
    w = np.maximum(words, 1)
    length = (we - ws).astype(np.float64)
    mean = _per(wd, length, n) / w
    out[:, 9] = mean
    out[:, 10] = np.sqrt(np.maximum(_per(wd, length * length, n) / w - mean * mean, 0))
    if len(ws):
        out[:, 11] = _per(wd, ((data[ws] >= 65) & (data[ws] <= 90)).astype(float), n) / w
        h = _word_hashes(data, ws, we)
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (wd[1:] == wd[:-1])])
        out[:, 12] = _per(wd, same.astype(float), n) / w
        out[:, 13] = _distinct(wd, h, n) / w
    out[words == 0, 13] = 1.0
    newline = data == 10
    line_start = np.concatenate([[True], newline[:-1]]) | edge[:-1] if len(data) else newline
    line_start &= ~newline
    ls = np.flatnonzero(line_start)
    stop = np.flatnonzero(newline | edge[1:] | (np.arange(len(data)) == len(data) - 1)) if len(data) else ls
    le = stop[np.searchsorted(stop, ls)] if len(ls) else ls
    le = le + ~newline[le] if len(ls) else le
    ld = doc[ls] if len(ls) else ls
    lines = _per(ld, None, n)
    if len(ls):
        out[:, 14] = _distinct(ld, _word_hashes(data, ls, le), n) / np.maximum(lines, 1)
    out[lines == 0, 14] = 1.0
    out[:, 15] = np.log1p(words / np.maximum(lines, 1))
    return out


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts and the offsets of each; a null is an empty text."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _of_texts(texts: pa.Array) -> np.ndarray:
    data, offsets = _bytes(texts)
    out, at, n = [], 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE, side="right")) - 1)
        out.append(statistics(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]))
        at = to
    return np.concatenate(out) if out else np.zeros((0, len(STATISTICS)))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pa.Array) -> pa.Array:
    x = _of_texts(texts)
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(STATISTICS), dtype=np.int32), x.ravel())


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features' frequencies
    phases: np.ndarray
    ridge: np.ndarray
    steps: np.ndarray  # scores from which a calibrated value holds
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        rff = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.weights + self.phases)
        return np.hstack([rff, z, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return self.values[np.clip(np.searchsorted(self.steps, raw, side="right") - 1, 0, len(self.values) - 1)]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (steps, values), values[i] holds from steps[i] on; equal x share one value."""
    steps, inverse = np.unique(x, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, y) / weight
    pools: list[list[float]] = []
    for s, w, m in zip(steps, weight, mean):
        pools.append([s, w, m])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            _, w2, m2 = pools.pop()
            pools[-1][2] = (pools[-1][2] * pools[-1][1] + m2 * w2) / (pools[-1][1] + w2)
            pools[-1][1] += w2
    return np.array([p[0] for p in pools]), np.array([p[2] for p in pools])


def _normal_equations(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").values.to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            f = model.features(x)
            y = batch.column("y").to_numpy()
            a, b = (f.T @ f, f.T @ y) if a is None else (a + f.T @ f, b + f.T @ y)
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], names=["a", "b"])

    return run


def _summed(group: pa.Table) -> pa.Table:
    a, b = (sum(np.frombuffer(x.as_py()) for x in group.column(c)) for c in ("a", "b"))
    return pa.table({"a": pa.array([a.tobytes()]), "b": pa.array([b.tobytes()])})


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: int) -> DataFrame:
    """doc_id, text, y of at most ``bound`` labelled ids, those with the smallest hashes; an id's label is its majority's, its
    text, if it has several, the one with the smallest hash."""
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.when(F.avg(label) >= 0.5, 1.0).otherwise(0.0).alias("y"))
    chosen = ids.orderBy(F.md5(hash_text(seed, F.col("doc_id"))), "doc_id").limit(bound)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by ``bound`` rows
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Model | None:
    """None without labelled documents of both kinds."""
    rows = labelled_sample(docs, labels, "quality", sample, seed)
    rows = rows.select(statistics_of("text").alias("x"), "y", (hashed_unit(seed + 1, F.col("doc_id")) < HOLD_OUT).alias("held"))
    rows = materialise(rows, "labelled")
    d = len(STATISTICS)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)]).first()
    if not stats.n or not 0 < stats.good < stats.n:
        return None
    rng = np.random.default_rng(seed)
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(d)])
    model = Model(np.array([stats[f"m{i}"] for i in range(d)]), np.where(scale > 1e-12, scale, 1.0), rng.normal(size=(d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + d + 1), np.zeros(1), np.zeros(1))
    width = FEATURES + d + 1
    parts = rows.filter("not held").mapInArrow(_normal_equations(model), "a binary, b binary").withColumn("to", F.spark_partition_id() % SUMS)
    sums = parts.groupBy("to").applyInArrow(_summed, "a binary, b binary").collect()  # at most SUMS rows
    a = sum((np.frombuffer(r.a).reshape(width, width) for r in sums), np.zeros((width, width)))
    b = sum((np.frombuffer(r.b) for r in sums), np.zeros(width))
    model.ridge = np.linalg.solve(a + RIDGE * np.eye(width), b)
    held = rows.filter("held").select("x", "y").toArrow().combine_chunks()  # bounded by the sample
    if len(held):
        x = held.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        model.steps, model.values = isotonic(model.raw(x), held.column("y").to_numpy())
    else:
        model.steps, model.values = np.array([0.0, 0.5]), np.array([0.0, 1.0])
    return model


def _scorer(model: Model):
    @F.arrow_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("quality", T.DoubleType())]))
    def score(texts: pa.Array) -> pa.Array:
        raw = model.raw(_of_texts(texts))
        released()
        return pa.StructArray.from_arrays([pa.array(raw), pa.array(model.calibrated(raw))], names=["score", "quality"])

    return score


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """The columns of docs and score (ridge), quality (calibrated probability), keep (quality >= KEEP_FROM).

    Statistics are of whole texts. A null text counts as an empty one. Labels with null ids or values are left out, several
    of one id vote. Without labels of both kinds nothing can be told apart: score and quality are null and all documents are
    kept. Repeated rows get equal scores. An empty table gives an empty table. Columns named score, quality, keep become *_in.
    """
    g = guarded(docs, ["doc_id", "text"], ("score", "quality", "keep"))
    model = fit(g.rows, labels, sample, seed)
    if model is None:
        nothing = F.lit(None).cast("double")
        return g.restored(g.rows, nothing.alias("score"), nothing.alias("quality"), F.lit(True).alias("keep"))
    got = g.rows.withColumn("found", _scorer(model)(F.col("text")))
    return g.restored(got, F.col("found.score").alias("score"), F.col("found.quality").alias("quality"), (F.col("found.quality") >= KEEP_FROM).alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "score", "quality", "keep")

"""Operator 5, embedding near-dedup: randomised-rotation binary codes with stored correction factors.

A unit vector o is rotated and coded by the signs of its coordinates; with <o, x> for its code vector x stored, a code's
product with a rotated query, itself kept in QUERY_BITS bit planes, divided by <o, x> is an unbiased estimate of the inner
product, whose error has a bound that holds with known confidence. Products of codes and planes are bit counts. Pairs whose
bound excludes the threshold go, those whose bound proves it are links, the others are computed anew from the vectors.

Candidates share a cell: in each of several tables a vector lies in the cell of the signs of a few of its coordinates, rotated
once more. The number of tables is the least that misses a pair at the threshold with a probability of at most MISS (less for nearer
ones), whatever the number of vectors; with the vectors, the signs grow as the logarithm and the tables as a small power.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.classes import classes_sql, summary
from loomtext.llm.common import materialise, released, table

THRESHOLD = 0.95
#: Vectors that a cell aims at, and vectors of one side of a task: larger cells are split into pairs of parts.
CELL = 2_000
PART = 2_048
MISS = 1e-4
#: Standard deviations of the estimate's error: beyond them a pair is decided without recomputation.
EPSILON = 4.0
QUERY_BITS = 4
SEED = 41


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def tables_of(count: int, threshold: float, cell: int) -> tuple[int, int]:
    """(signs of a cell, tables)."""
    k = max(0, math.ceil(math.log2(max(count, 1) / cell)))
    same = (1 - math.acos(threshold) / math.pi) ** k
    return k, 1 if same > 1 - MISS else math.ceil(math.log(MISS) / math.log(1 - same))


def codes(unit: np.ndarray, rotate: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed signs of the rotated vectors, correction factors <o, x> with x = signs / sqrt(dim))."""
    z = unit @ rotate.T
    return np.packbits(z > 0, axis=1), np.abs(z).sum(1) / np.sqrt(z.shape[1])


def planes(unit: np.ndarray, rotate: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bit planes of the rotated vectors, lowest value, step): rounded with a dither, so that errors cancel out."""
    z = unit @ rotate.T
    low = z.min(1)
    step = np.maximum((z.max(1) - low) / ((1 << QUERY_BITS) - 1), 1e-12)
    level = np.floor((z - low[:, None]) / step[:, None] + np.random.default_rng(seed + 1).uniform(size=z.shape[1])).astype(np.int64)
    level = np.minimum(level, (1 << QUERY_BITS) - 1)
    return np.stack([np.packbits(level >> j & 1, axis=1) for j in range(QUERY_BITS)], 1), low, step


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


def estimate(code: np.ndarray, factor: np.ndarray, plane: np.ndarray, low: np.ndarray, step: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, error bounds) of inner products, row by row: code and factor of the one, planes of the other vector.

    The deviation is sqrt((1 - f^2) / (f^2 (dim - 1))) by the code and at most step / 2f by the rounding; EPSILON are taken.
    """
    weight = 1 << np.arange(QUERY_BITS)
    inside = low * _bits(code) + step * (_bits(code[:, None] & plane) * weight).sum(1)
    whole = low * dim + step * (_bits(plane) * weight).sum(1)
    bound = np.sqrt(np.maximum(1 - factor**2, 0) / max(dim - 1, 1) + step**2 / 4) / np.maximum(factor, 1e-12)
    return (2 * inside - whole) / np.sqrt(dim) / factor, EPSILON * bound


_ROWS = "cell long, key long, code binary, factor double, plane binary, low double, step double"


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    v = v / np.abs(v).max(1, keepdims=True)  # large and tiny ones don't overflow
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _raw(x: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(x).reshape(len(x), -1)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), len(flat), [None, pa.py_buffer(flat.tobytes())]).cast(pa.binary())


def _coded(dim: int, k: int, tables: int):
    rotate = rotation(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes_at = [np.random.default_rng([SEED, t]).normal(size=(dim, k)) for t in range(tables)]
        for whole in batches:
            for batch in (whole.slice(i, 2000) for i in range(0, whole.num_rows, 2000)):
                unit = _unit(batch.column("v"), dim)
                code, factor = codes(unit, rotate)
                plane, low, step = planes(unit, rotate)
                fixed = [batch.column("key"), _raw(code), pa.array(factor), _raw(plane), pa.array(low), pa.array(step)]
                for t, p in enumerate(planes_at):
                    cell = ((unit @ p > 0) << np.arange(k)).sum(1).astype(np.int64) + (t << k) if k else np.zeros(len(unit), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), *fixed], names=["cell", "key", "code", "factor", "plane", "low", "step"])

    return run


_FOUND = "task long, a long, b long, sure boolean"


def _compared(dim: int, threshold: float):
    # signs differ with a probability of angle / pi each; beyond EPSILON deviations of it no pair reaches the threshold
    apart = math.acos(threshold) / math.pi
    most = dim * apart + EPSILON * math.sqrt(dim * apart * (1 - apart))
    width = -(-dim // 64) * 8

    def run(group: pa.Table) -> pa.Table:
        task = group.column("task")[0].as_py()
        key, part = (group.column(c).to_numpy() for c in ("key", "part"))
        code = np.frombuffer(b"".join(x.as_py().ljust(width, b"\0") for x in group.column("code")), np.uint64).reshape(len(key), -1)
        plane = np.frombuffer(b"".join(group.column("plane").to_pylist()), np.uint8).reshape(len(key), QUERY_BITS, -1)
        packed = np.frombuffer(b"".join(group.column("code").to_pylist()), np.uint8).reshape(len(key), -1)
        factor, low, step = (group.column(c).to_numpy() for c in ("factor", "low", "step"))
        left = np.flatnonzero(part == part.min())
        right = np.flatnonzero(part == part.max())
        same = part.min() == part.max()
        if same and not group.column("inner")[0].as_py():
            left = right = left[:0]  # its partner part is empty
        found: list[tuple[np.ndarray, ...]] = []
        for i in range(0, len(left), 512):
            rows = left[i : i + 512]
            off = np.zeros((len(rows), len(right)), np.uint16)
            for w in range(code.shape[1]):
                off += np.bitwise_count(code[rows, w][:, None] ^ code[right, w][None, :])
            x, y = np.nonzero(off <= most)
            x, y = rows[x], right[y]
            ok = key[x] < key[y] if same else key[x] != key[y]
            x, y = x[ok], y[ok]
            for c in range(0, len(x), 200_000):
                p, q = x[c : c + 200_000], y[c : c + 200_000]
                inner, bound = estimate(packed[p], factor[p], plane[q], low[q], step[q], dim)
                hit = inner + bound >= threshold
                p, q, sure = p[hit], q[hit], (inner - bound >= threshold)[hit]
                found.append((np.minimum(key[p], key[q]), np.maximum(key[p], key[q]), sure))
        a, b, sure = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        released()
        return pa.Table.from_arrays([pa.array(np.full(len(a), task)), pa.array(a), pa.array(b), pa.array(sure)], names=["task", "a", "b", "sure"])

    return run


def _verified(threshold: float):
    """Of one task: rows with a vector are its vectors, the others its pairs."""

    def run(group: pa.Table) -> pa.Table:
        is_vector = group.column("v").is_valid().to_numpy()
        a, b = group.column("a").to_numpy(), group.column("b").to_numpy()
        vectors = group.column("v").filter(pa.array(is_vector)).combine_chunks()
        unit = _unit(vectors, len(vectors[0]))
        names = a[is_vector]
        order = np.argsort(names)
        p, q = (order[np.searchsorted(names[order], x[~is_vector])] for x in (a, b))
        exact = np.concatenate([np.einsum("ij,ij->i", unit[p[c : c + 50_000]], unit[q[c : c + 50_000]]) for c in range(0, len(p), 50_000)])
        hit = exact >= threshold
        return pa.Table.from_arrays([pa.array(names[p[hit]]), pa.array(names[q[hit]])], names=["a", "b"])

    return run


def links(vectors: DataFrame, dim: int, count: int, threshold: float, cell: int) -> DataFrame:
    """Pairs a < b of the keys of different vectors (key, v) whose cosine reaches the threshold."""
    k, tables = tables_of(count, threshold, cell)
    rows = vectors.dropDuplicates(["key"]).mapInArrow(_coded(dim, k, tables), _ROWS)
    rows = materialise(rows, "codes")
    parts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("cell", F.ceil(F.col("n") / PART).alias("parts"))
    placed = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("key", F.lit(3)), F.col("parts")))
    with_ = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other")
    tasks = placed.select("*", with_).withColumns({"task": F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")), "inner": F.col("part") == F.col("other")})
    found = tasks.drop("cell", "parts", "other").groupBy("task").applyInArrow(_compared(dim, threshold), _FOUND)
    pairs = materialise(found.groupBy("a", "b").agg(F.min("task").alias("task"), F.max("sure").alias("sure")), "pairs")
    open_ = pairs.filter("NOT sure").select("task", "a", "b")
    wanted = open_.select("task", F.explode(F.array("a", "b")).alias("key")).distinct()
    own = vectors.join(wanted.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    sent = wanted.join(own, "key").select("task", F.col("key").alias("a"), F.lit(None).cast("bigint").alias("b"), "v")
    both = sent.unionByName(open_.select("task", "a", "b", F.lit(None).cast(vectors.schema["v"].dataType).alias("v")))
    exact = both.groupBy("task").applyInArrow(_verified(threshold), "a long, b long")
    return pairs.filter("sure").select("a", "b").unionByName(exact)


def near_classes(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL) -> DataFrame:
    """vec_id, class_id, n_links: one row for each vector (distinct vec_id and embedding).

    n_links counts the other rows whose cosine with this one reaches the threshold, equal embeddings among them, which are
    counted and not paired; class_id is the smallest vec_id that chains of links reach. Pairs of different vectors just at
    the threshold are missed with a probability of at most MISS, nearer ones with less.

    Nulls: rows with a null vec_id or embedding, an embedding with a null or not finite element, or of length zero are left out, as
    are those of another dimension than most (the most frequent; of ties the smallest). Repeated rows are one; several
    embeddings of an id are rows of their own. Very long embeddings are compared whole. An empty table gives an empty
    table. Other columns are ignored, whatever their names.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must be in (0, 1)")
    spark = vectors.sparkSession
    v = vectors.select("vec_id", F.col("embedding").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad).filter(F.exists("v", lambda x: x != 0))
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "vec_id long, class_id long, n_links long")
    dim, count = sizes[0].d, sizes[0].n
    v = v.filter(F.size("v") == dim).select(F.col("vec_id").cast("bigint").alias("id"), F.xxhash64("v").alias("key"), "v")
    found = materialise(links(v.select("key", "v"), dim, count, threshold, cell), "links")
    rows = v.select("id", F.col("key").alias("node")).distinct()
    return summary(rows, found).withColumnRenamed("id", "vec_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v, md5(embedding::VARCHAR) AS node FROM embeddings),
u AS (SELECT DISTINCT node, v, sqrt(list_inner_product(v, v)) AS n FROM v),
rows_ AS (SELECT DISTINCT vec_id AS id, node FROM v),
links_ AS (SELECT a.node AS a, b.node AS b FROM u a JOIN u b ON a.node < b.node WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= {THRESHOLD}),
{classes_sql("rows_", "links_")}
SELECT id AS vec_id, class_id, n_links FROM summary"""

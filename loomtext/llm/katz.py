"""Operator 7, LM scoring by Katz backoff: Good-Turing discounted n-gram counts with exactly normalised backoff weights,
in tables partitioned by order; a token's probability is evaluated from the highest order down.

Counting: each task counts its distinct n-grams (arrays, no rows), sends them packed by bucket of the context, and the
bucket's task adds them up. N-grams below MIN_COUNT leave their mass to the backoff. Words are 64-bit hashes; the tables'
joins and the scoring are relational.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import guarded, materialise, table
from loomtext.llm.ngram_join import _lists, _mix, words

ORDER = 2
#: Counts above DISCOUNT_TO keep their mass; n-grams of two words or more that occur less than MIN_COUNT times back off.
DISCOUNT_TO = 5
MIN_COUNT = 1
#: N-grams of a batch of tasks' input that are counted at once, and n-grams that a bucket aims at.
CHUNK = 1_500_000
BUCKET_NGRAMS = 2_000_000
START, END = "\x02", "\x03"
_U = np.uint64
_PACKED = "m int, bucket long, ctx binary, low binary, len binary, word binary, n binary"


def hashed_words(text: Column, order: int) -> Column:
    marked = F.concat(F.array_repeat(F.lit(START), order - 1), words(text), F.array(F.lit(END)))
    return F.transform(marked, lambda x: F.xxhash64(x))


def _contexts(v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position from m - 1 on: hashes of the m - 1 words before it, and of the m - 2 words before it."""

    def joined(size: int) -> np.ndarray:
        h = np.zeros(len(v) - m + 1, _U)
        for j in range(size):
            h = _mix(h) * _U(0x9E3779B97F4A7C15) + v[m - 1 - size + j : len(v) - size + j]
        return h

    return joined(m - 1), joined(max(0, m - 2))


def _positions(v: np.ndarray, offsets: np.ndarray, m: int, order: int) -> np.ndarray:
    """Indexes of the scored words: not the order - 1 start marks of each text."""
    ok = np.ones(len(v), bool)
    for j in range(order - 1):
        ok[offsets[:-1] + j] = False
    return np.flatnonzero(ok)


def _count_batches(order: int, buckets: int):
    def counted(m: int, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        at = _positions(values, offsets, m, order)
        word = values[at]
        if m == 1:
            word, n = np.unique(word, return_counts=True)
            zero = np.zeros(len(word), _U)
            return zero, zero, word, n.astype(np.int32)
        ctx, low = _contexts(values, m)
        ctx, low = ctx[at - m + 1], low[at - m + 1]
        key = _mix(ctx * _U(0xD1342543DE82EF95) + _mix(word))
        order_ = np.argsort(key)
        key = key[order_]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.concatenate([first, [len(key)]])).astype(np.int32)
        pick = order_[first]
        return ctx[pick], low[pick], word[pick], n

    def pack(values: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = [[] for _ in range(7)]
        for m in range(1, order + 1):
            ctx, low, word, n = counted(m, values, offsets)
            home = (_mix(word if m == 1 else ctx) % _U(buckets)).astype(np.int64)
            by = np.lexsort((ctx, home))
            home, ctx, low, word, n = home[by], ctx[by], low[by], word[by], n[by]
            cut = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])).tolist() + [len(home)] if len(home) else [0]
            for a, b in zip(cut[:-1], cut[1:]):
                c = ctx[a:b]
                run = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                for i, x in enumerate((m, int(home[a]), c[run].tobytes(), low[a:b][run].tobytes(), np.diff(np.append(run, b - a)).astype(np.int32).tobytes(), word[a:b].tobytes(), _small(n[a:b]))):
                    rows[i].append(x)
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.int32(), pa.int64(), *[pa.binary()] * 5))], names=["m", "bucket", "ctx", "low", "len", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bounds, size = [], [np.zeros(1, np.int64)], 0
        for batch in batches:
            values, offsets = _lists(batch.column("w"))
            at = 0
            while at < len(offsets) - 1:  # whole texts, as many as fit: a batch may hold several times CHUNK
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK - size, side="right")) - 1)
                part = values[offsets[at] : offsets[to]].view(_U)
                held.append(part)
                bounds.append(np.asarray(offsets[at + 1 : to + 1] - offsets[at], np.int64) + size)
                size += len(part)
                at = to
                if size >= CHUNK or at < len(offsets) - 1:
                    yield from pack(np.concatenate(held), np.concatenate(bounds))
                    held, bounds, size = [], [np.zeros(1, np.int64)], 0
            held = [h.copy() for h in held]  # not the whole batch
        if size:
            yield from pack(np.concatenate(held), np.concatenate(bounds))

    return run


def _small(n: np.ndarray) -> bytes:
    """Counts in a byte each; those of 255 and more follow in eight bytes."""
    big = n >= 255
    return np.where(big, 255, n).astype(np.uint8).tobytes() + n[big].astype(np.int64).tobytes()


def _wide(data: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(data, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(data, np.int64, offset=size)
    return n


_COUNTED = "m int, ctx long, low long, word long, n long, total long"


def _added(min_count: int, up_to: int):
    """A bucket's n-grams: those kept, with their context's total; and with word null, how many occur n times (n <= up_to).

    Counts below up_to are discounted; a context that has none of them counts as one longer than it is.
    """

    def run(group: pa.Table) -> pa.Table:
        m = group.column("m")[0].as_py()
        ctx, low, word, n = [], [], [], []
        for c, w_low, size, w, k in zip(*(group.column(x).to_pylist() for x in ("ctx", "low", "len", "word", "n"))):
            size = np.frombuffer(size, np.int32)
            ctx.append(np.repeat(np.frombuffer(c, _U), size))
            low.append(np.repeat(np.frombuffer(w_low, _U), size))
            word.append(np.frombuffer(w, _U))
            n.append(_wide(k, len(word[-1])))
        ctx, low, word, n = map(np.concatenate, (ctx, low, word, n))
        key = _mix(ctx * _U(0xD1342543DE82EF95) + _mix(word))
        by = np.argsort(key)
        key = key[by]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.add.reduceat(n[by], first)
        pick = by[first]
        by = np.argsort(ctx[pick], kind="stable")  # contexts in runs take little room on disk
        pick, count = pick[by], count[by]
        ctx, low, word = ctx[pick], low[pick], word[pick]
        names, inverse = np.unique(ctx, return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, inverse, count)
        least = np.full(len(names), up_to, np.int64)
        np.minimum.at(least, inverse, count)
        total += least >= up_to  # no count is discounted: one more occurrence, of something new, leaves a mass to back off with
        keep = count >= (min_count if m > 1 else 1)
        seen = np.bincount(count[count <= up_to], minlength=up_to + 1)[1:]
        k, e = int(keep.sum()), up_to
        longs = lambda x, fill: pa.array(np.concatenate([x, fill]).astype(np.int64))
        zero = np.zeros(e, np.int64)
        return pa.Table.from_arrays(
            [pa.array(np.full(k + e, m, np.int32)), longs(ctx[keep].view(np.int64), zero), longs(low[keep].view(np.int64), zero),
             pa.array(np.concatenate([word[keep].view(np.int64), zero]), mask=np.concatenate([np.zeros(k, bool), np.ones(e, bool)])),
             longs(count[keep], np.arange(1, e + 1)), longs(total[inverse][keep], seen)],
            names=["m", "ctx", "low", "word", "n", "total"],
        )

    return run


def discounts(seen: list[int], up_to: int) -> list[float]:
    """Katz' Good-Turing ratios of the counts 1 .. up_to; seen[i]: n-grams that occur i + 1 times, up to up_to + 1.

    Where a ratio isn't defined or leaves (0, 1), (r - 0.5) / r takes its place.
    """
    out = []
    for r in range(1, up_to + 1):
        d = -1.0
        if seen[r - 1] > 0 and seen[0] > 0:
            tail = (up_to + 1) * seen[up_to] / seen[0]
            if tail != 1:
                d = ((r + 1) * seen[r] / (r * seen[r - 1]) - tail) / (1 - tail)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


@dataclass
class Model:
    """tables[m]: ctx, word, p for order m (m = 1: ctx 0); weights[m]: ctx, alpha where it isn't 1; unknown: p of a new word."""

    order: int
    tables: dict[int, DataFrame]
    weights: dict[int, DataFrame]
    unknown: float


def _discounted(n: Column, d: list[float]) -> Column:
    out = F.lit(1.0)
    for r, x in enumerate(d, 1):
        out = F.when(n == r, F.lit(x)).otherwise(out)
    return out * n


def fit(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, up_to: int = DISCOUNT_TO, text: str = "text") -> Model:
    """Counts over all documents; null texts are left out, a text without words is a start and an end."""
    if order < 1 or min_count < 1 or up_to < 1:
        raise ValueError("order, min_count and up_to must be positive")
    texts = docs.filter(F.col(text).isNotNull())
    chars = texts.agg(F.sum(F.length(text)).alias("c")).first().c or 0
    buckets = max(1, int(chars / 6 / BUCKET_NGRAMS))
    packed = texts.select(hashed_words(F.col(text), order).alias("w")).mapInArrow(_count_batches(order, buckets), _PACKED)
    counted = packed.groupBy("m", "bucket").applyInArrow(_added(min_count, up_to + 1), _COUNTED)
    counted = materialise(counted, "counts", "m")
    seen = {m: [0] * (up_to + 1) for m in range(1, order + 1)}
    for r in counted.filter("word is null").groupBy("m", "n").agg(F.sum("total").alias("t")).collect():
        seen[r.m][r.n - 1] = r.t
    kept = counted.filter("word is not null")
    one = kept.filter("m = 1")
    everything = one.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.min("n").alias("least")).first()
    if not everything.k:
        return Model(order, {}, {}, 1.0)
    mass = _discounted(F.col("n"), discounts(seen[1], up_to))
    size = everything.n + (everything.least > up_to)
    tables = {1: one.select("ctx", "word", (mass / F.lit(float(size))).alias("p"))}
    unknown = 1.0 - float(one.agg(F.sum(mass).alias("s")).first().s) / size
    weights = {}
    for m in range(2, order + 1):
        own = kept.filter(F.col("m") == m).select("ctx", "low", "word", (_discounted(F.col("n"), discounts(seen[m], up_to)) / F.col("total")).alias("p"))
        lower = tables[m - 1].select(F.col("ctx").alias("low"), "word", F.col("p").alias("q"))
        if m == 2:
            lower = lower.drop("low")
        sums = own.join(lower, ["word"] if m == 2 else ["low", "word"]).groupBy("ctx").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
        weights[m] = materialise(sums.select("ctx", ((1 - F.col("p")) / (1 - F.col("q"))).alias("alpha")), f"weights{m}")
        tables[m] = own.select("ctx", "word", "p")
    return Model(order, tables, weights, unknown)




def _token_batches(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column("w"))
            offsets = np.asarray(offsets, np.int64)
            values = values[offsets[0] : offsets[-1]].view(_U)
            offsets = offsets - offsets[0]
            keys = np.repeat(batch.column("key").to_numpy(), np.diff(offsets))
            at = _positions(values, offsets, order, order)
            ctx = [_contexts(values, m)[0][at - m + 1].view(np.int64) for m in range(2, order + 1)]
            flat = pa.array(np.stack(ctx, 1).ravel()) if ctx else pa.array([], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * (order - 1) + 1, max(1, order - 1), dtype=np.int32)[: len(at) + 1] if order > 1 else np.zeros(len(at) + 1, np.int32)), flat)
            for a in range(0, len(at), 200_000):
                b = min(len(at), a + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at[a:b]]), lists[a:b], pa.array(values[at[a:b]].view(np.int64))], names=["key", "ctx", "word"])

    return run


def score(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The columns of rows, n_tokens (words and the end), logprob (natural, rounded to 6 digits) and n_backed_off (tokens that
    weren't found at the highest order).

    Equal texts are scored once. Nulls: a null text has null results; an empty one is scored as the end after the start. New
    words have the unknown word's probability. A model of an empty corpus gives every token probability 1 and backs off
    always. An empty table gives an empty table. Columns called n_tokens, logprob, n_backed_off become *_in, any other
    name is left alone. Very long texts are scored whole.
    """
    g = guarded(rows, [text], ("n_tokens", "logprob", "n_backed_off"))
    rows = g.rows
    key = F.xxhash64(F.col(text))
    texts = rows.filter(F.col(text).isNotNull()).select(key.alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
    tokens = texts.select("key", hashed_words(F.col("text"), model.order).alias("w")).mapInArrow(_token_batches(model.order), "key long, ctx array<long>, word long")
    tokens = tokens.select("key", *[F.col("ctx")[m - 2].alias(f"c{m}") for m in range(2, model.order + 1)], "word")
    left = tokens.withColumns({"lp": F.lit(None).cast("double"), "up": F.lit(0.0), "back": F.lit(0)})
    done = []
    for m in range(model.order, 0, -1):
        cols = ["key", *[f"c{i}" for i in range(2, m + 1)], "word", "up", "back"]
        left = left.select(*cols)
        if not model.tables:
            done.append(left.select("key", F.lit(0.0).alias("lp"), F.lit(1).alias("back")))
            break
        p = model.tables[m]
        if m == 1:
            p1 = F.coalesce(F.col("p"), F.lit(model.unknown))
            found = left.join(p.select("word", "p"), "word", "left")
            done.append(found.select("key", (F.col("up") + F.log(p1)).alias("lp"), (F.col("back") if model.order > 1 else F.when(F.col("p").isNull(), 1).otherwise(0)).alias("back")))
            break
        found = left.join(p.select(F.col("ctx").alias(f"c{m}"), "word", "p"), [f"c{m}", "word"], "left")
        found = found.join(model.weights[m].select(F.col("ctx").alias(f"c{m}"), "alpha"), f"c{m}", "left")
        found = materialise(found.select(*cols, "p", "alpha"), f"found{m}")
        done.append(found.filter("p is not null").select("key", (F.col("up") + F.log("p")).alias("lp"), "back"))
        left = found.filter("p is null").withColumns({"up": F.col("up") + F.log(F.coalesce("alpha", F.lit(1.0))), "back": F.lit(1)})
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    sums = every.groupBy("key").agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.sum("lp"), 6).alias("logprob"), F.sum("back").cast("bigint").alias("n_backed_off"))
    scored = rows.withColumn("key", F.when(F.col(text).isNotNull(), key)).join(sums, "key", "left")
    return g.restored(scored, *[F.col(c) for c in ("n_tokens", "logprob", "n_backed_off")])


def query(spark: SparkSession, sf_dir: str, order: int = ORDER) -> DataFrame:
    """All turns of all conversations under a model of all documents."""
    return score(table(spark, sf_dir, "conversations"), fit(table(spark, sf_dir, "documents"), order)).drop("role", "text")


def query_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(spark, sf_dir, 3)


def _d(order: int) -> str:
    n = lambda r: f"(SELECT count(*) FROM c{order} WHERE n = {r})::DOUBLE"
    tail = f"({DISCOUNT_TO + 1} * {n(DISCOUNT_TO + 1)} / nullif({n(1)}, 0))"
    cases = [f"SELECT {r} AS r, (({r + 1} * {n(r + 1)} / nullif({r} * {n(r)}, 0)) - {tail}) / nullif(1 - {tail}, 0) AS d" for r in range(1, DISCOUNT_TO + 1)]
    return f"d{order} AS (SELECT r, CASE WHEN d > 0 AND d < 1 THEN d ELSE (r - 0.5) / r::DOUBLE END AS d FROM ({' UNION ALL '.join(cases)}))"


def _toks(name: str, columns: str, source: str) -> str:
    return f"{name} AS (SELECT {columns}, list_concat([chr(2)], list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), [chr(3)]) AS w FROM {source} WHERE text IS NOT NULL)"


SQL = f"""
WITH {_toks("dt", "doc_id", "documents")},
b AS (SELECT unnest(w[:-2]) AS h, unnest(w[2:]) AS w FROM dt),
c1 AS (SELECT w, count(*) AS n FROM b GROUP BY w), c2 AS (SELECT h, w, count(*) AS n FROM b GROUP BY h, w),
{_d(1)}, {_d(2)},
p1 AS (SELECT w, coalesce(d, 1.0) * n / (SELECT sum(n) + (min(n) > {DISCOUNT_TO})::INT FROM c1)::DOUBLE AS p FROM c1 LEFT JOIN d1 ON r = n),
unk AS (SELECT 1 - sum(p) AS p FROM p1),
t2 AS (SELECT h, sum(n) + (min(n) > {DISCOUNT_TO})::INT AS t FROM c2 GROUP BY h),
p2 AS (SELECT c2.h, c2.w, coalesce(d, 1.0) * n / t::DOUBLE AS p FROM c2 JOIN t2 USING (h) LEFT JOIN d2 ON r = n WHERE n >= {MIN_COUNT}),
a2 AS (SELECT h, (1 - sum(p2.p)) / (1 - sum(p1.p)) AS a FROM p2 JOIN p1 USING (w) GROUP BY h),
{_toks("ct", "conv_id, turn", "conversations")},
q AS (SELECT conv_id, turn, unnest(w[:-2]) AS h, unnest(w[2:]) AS w FROM ct),
s AS (SELECT conv_id, turn, p2.p IS NULL AS back, ln(coalesce(p2.p, coalesce(a2.a, 1.0) * coalesce(p1.p, (SELECT p FROM unk)))) AS lp
  FROM q LEFT JOIN p2 USING (h, w) LEFT JOIN a2 ON a2.h = q.h LEFT JOIN p1 ON p1.w = q.w)
SELECT conv_id, turn, count(*) AS n_tokens, round(sum(lp), 6) AS logprob, sum(back::INT)::BIGINT AS n_backed_off FROM s GROUP BY conv_id, turn"""

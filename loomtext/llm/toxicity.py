"""Operator 1, toxicity: the nearest labelled examples by exact TF-IDF cosine, found in a block-max inverted index;
their distance-weighted votes, calibrated by isotonic regression on leave-one-out votes, are score and evidence.

The terms are all words of the labelled examples; their document frequencies are counted over all documents. Words that
tell the labels apart (likelihood-ratio test on the examples, in which near copies count once) weigh LEAD times as much.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm import lexer
from loomtext.llm.common import guarded, materialise, released, table
from loomtext.llm.quality import isotonic, labelled_sample

#: Labelled rows in the index at most (chosen by a hash of the id), and the test of a term that weighs LEAD times its TF-IDF.
EXAMPLES = 12_000
MIN_G2 = 24.0
MIN_EXAMPLES = 3
LEAD = 30.0
NEIGHBOURS = 15
#: Added to a neighbour's distance before its vote is 1 / distance.
SOFTEN = 0.02
TOXIC_FROM = 0.5
BLOCK = 64
#: Blocks that are evaluated one by one; a text for which bounds leave more is compared with all examples at once, TEXTS
#: texts together, the FREQUENT most frequent terms as a matrix.
FEW_BLOCKS = 6
TEXTS = 128
FREQUENT = 512
#: Entries of the index that are rearranged at once.
ENTRIES = 250_000
ROUNDING = 1e-4
BOUND = 1e-5
SEED = 23
RESULTS = ("toxicity", "toxic", "evidence_ids", "evidence_cosines", "evidence_labels")


def _prints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Four min-hashes of the word trigrams of each text; a shorter text is one n-gram."""
    n = len(bounds) - 1
    out = np.zeros((n, 4), np.uint64)
    size = np.diff(bounds)
    grams = lexer.mixed(h)
    if len(h) > 2:
        grams = grams[:-2] + lexer.mixed(h[1:-1] + np.uint64(1)) + lexer.mixed(h[2:] + np.uint64(2))
        grams = np.concatenate([grams, h[-2:]])
    for i in np.flatnonzero(size):
        a, b = int(bounds[i]), int(bounds[i + 1])
        own = grams[a : b - 2] if b - a > 2 else np.array([lexer.mixed(h[a:b]).sum()], np.uint64)
        out[i] = [lexer.mixed(own ^ np.uint64(s)).min() for s in (1, 0x51ED270B, 0x7FEB352D9A1, 0x846CA68B3F11D)]
    return out.view(np.int64)


def _example_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, y, distinct terms (hashes), their frequencies, and min-hashes of word trigrams, by which near copies meet."""
    for whole in batches:
        for b in (whole.slice(i, TEXTS) for i in range(0, len(whole), TEXTS)):
            h, bounds = lexer.words(b.column("text").to_pylist())
            doc = np.repeat(np.arange(len(b)), np.diff(bounds))
            order = np.lexsort((h, doc))
            first = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])])) if len(h) else np.zeros(0, np.int64)
            cuts = np.searchsorted(doc[order][first], np.arange(len(b) + 1)).astype(np.int32)
            tf = np.diff(np.append(first, len(h))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), x) for x in (pa.array(h[order][first].view(np.int64)), pa.array(tf))]
            prints = pa.ListArray.from_arrays(pa.array(np.arange(0, 4 * len(b) + 1, 4, dtype=np.int32)), pa.array(_prints(h, bounds).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), *lists, prints], names=["doc_id", "y", "terms", "tf", "prints"])


def _length(w: np.ndarray) -> np.floating:
    return np.sqrt((w * w).sum())


def _joined(starts: np.ndarray, keys: np.ndarray, values: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of some terms one after another, with their values times the term's weight."""
    if not len(terms):
        return keys[:0], values[:0]
    a, b = starts[terms], starts[terms + 1]
    cuts = list(zip(a.tolist(), b.tolist()))
    return np.concatenate([keys[i:j] for i, j in cuts]), np.concatenate([values[i:j] for i, j in cuts]) * np.repeat(weights.astype(values.dtype), b - a)


def _smallest(most: int) -> np.dtype:
    return np.min_scalar_type(max(0, int(most)))


def _slices(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of items with about ENTRIES entries each; item i's end at ends[i + 1]."""
    at = 0
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + ENTRIES, side="right")) - 1)
        yield at, to
        at = to


@dataclass
class Tables:
    """An index by term: a matrix of the FREQUENT most frequent ones, the postings of the others, and each one's highest weight in each block."""

    posted: np.ndarray
    rows: np.ndarray
    values: np.ndarray
    column: np.ndarray
    matrix: np.ndarray
    top_starts: np.ndarray
    top_blocks: np.ndarray
    top: np.ndarray
    query: np.ndarray

    @classmethod
    def of(cls, index: Index) -> Tables:
        n, terms = len(index.ids), len(index.idf)
        size = np.bincount(index.columns, minlength=terms)
        posted = np.concatenate([[0], np.cumsum(size)])
        rows, values = np.zeros(posted[-1], _smallest(n)), np.zeros(posted[-1], np.float32)
        ends = posted[:-1].copy()
        for lo, hi in _slices(index.starts):
            s, e = index.starts[lo], index.starts[hi]
            by = np.argsort(index.columns[s:e], kind="stable")
            term = index.columns[s:e][by]
            first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            count = np.diff(np.append(first, len(term)))
            to = ends[term] + np.arange(len(term)) - np.repeat(first, count)
            rows[to] = np.repeat(np.arange(lo, hi), np.diff(index.starts[lo : hi + 1]))[by]
            values[to] = index.weights_of(lo, hi)[by]
            ends[term[first]] += count
        del ends
        blocks, tops, tops_of = [], [], np.zeros(terms, np.int64)
        for lo, hi in _slices(posted):
            s, e = posted[lo], posted[hi]
            if s == e:
                continue
            term, block = np.repeat(np.arange(lo, hi), size[lo:hi]), rows[s:e] // BLOCK
            first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
            tops_of[lo:hi] = np.bincount(term[first] - lo, minlength=hi - lo)
            blocks.append(block[first].astype(_smallest(n // BLOCK)))
            tops.append(np.maximum.reduceat(values[s:e], first))
        top_blocks, top = np.concatenate(blocks), np.concatenate(tops)
        del blocks, tops
        frequent = np.argsort(-size, kind="stable")[:FREQUENT]
        column, matrix = np.full(terms, -1, np.int32), np.zeros((len(frequent), n), np.float32)
        column[frequent] = np.arange(len(frequent))
        for i, t in enumerate(frequent.tolist()):
            matrix[i, rows[posted[t] : posted[t + 1]]] = values[posted[t] : posted[t + 1]]
        rare = np.repeat(column < 0, size)
        rows, values = rows[rare], values[rare]
        posted = np.concatenate([[0], np.cumsum(np.where(column < 0, size, 0))])
        return cls(posted, rows, values, column, matrix, np.concatenate([[0], np.cumsum(tops_of)]), top_blocks, top, np.zeros(terms))


@dataclass
class Index:
    """Examples' unit vectors, in blocks of BLOCK; ``top`` bounds the weights of a term in a block."""

    vocabulary: np.ndarray  # sorted hashes
    idf: np.ndarray  # by term; times LEAD for those that tell the labels apart
    ids: np.ndarray
    toxic: np.ndarray
    starts: np.ndarray
    columns: np.ndarray
    level: np.ndarray  # of each entry, its place in ``levels``
    levels: np.ndarray  # 1 + log of each frequency that occurs
    norms: np.ndarray
    base: float  # share of toxic ones among the examples without a term
    steps: np.ndarray
    values: np.ndarray
    tables: Tables | None = None

    def __getstate__(self) -> dict:
        """Compressed, as a worker keeps what it was sent; the tables stay behind, every worker makes its own."""
        state = pickle.dumps(self.__dict__ | {"tables": None}, 5)
        return {"size": len(state), "packed": pa.compress(state, codec="zstd", asbytes=True)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= pickle.loads(pa.decompress(state["packed"], state["size"], codec="zstd"))

    def weights_of(self, lo: int, hi: int) -> np.ndarray:
        """The weights of the examples from lo to hi."""
        s, e = self.starts[lo], self.starts[hi]
        return self.levels[self.level[s:e]] * self.idf[self.columns[s:e]] / np.repeat(self.norms[lo:hi], np.diff(self.starts[lo : hi + 1]))

    @property
    def weights(self) -> np.ndarray:
        return self.weights_of(0, len(self.ids))

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(sorted(counts), np.int64)
        return t, self.unit(t, np.array([counts[i] for i in t.tolist()], float))

    def unit(self, terms: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[terms]
        return w / _length(w)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(rows, cosines) of the k nearest examples with a cosine above 0, nearest first, smaller ids first in ties."""
        return self.all_nearest([(terms, weights)], k, [without])[0]

    def all_nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each vector."""
        without = without or [-1] * len(vectors)
        if not len(self.ids):
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(vectors)
        if self.tables is None:
            self.tables = Tables.of(self)
            released()
        tables = self.tables
        # bounds say little where no term outweighs the others
        out: list = [self._by_blocks(tables, *v, k, x) if v[1].max() > 0.5 else None for v, x in zip(vectors, without)]
        rest = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(rest), TEXTS):
            some = rest[at : at + TEXTS]
            frequent = np.zeros((len(some), len(tables.matrix)), np.float32)
            for j, i in enumerate(some):
                t, w = vectors[i]
                column = tables.column[t]
                frequent[j, column[column >= 0]] = w[column >= 0]
            dots = frequent @ tables.matrix
            for j, i in enumerate(some):
                t, w = vectors[i]
                rare = tables.column[t] < 0
                at_rows, values = _joined(tables.posted, tables.rows, tables.values, t[rare], w[rare])
                near = dots[j] + np.bincount(at_rows, values, len(self.ids)).astype(np.float32)
                # one more, as without may be among them; what is short of the last by less than the rounding of 32 bits is computed anew
                least = np.partition(near, -k - 1)[-k - 1] - ROUNDING if len(near) > k else 0.0
                rows = np.flatnonzero(near >= least)
                size = self.starts[rows + 1] - self.starts[rows]
                ends = np.cumsum(size)
                at_ = np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends + size, size)
                tables.query[t] = w * self.idf[t]
                exact = np.add.reduceat(tables.query[self.columns[at_]] * self.levels[self.level[at_]], ends - size) / self.norms[rows]
                tables.query[t] = 0
                out[i] = self._best(rows, exact, k, without[i])
        return out

    def _best(self, rows: np.ndarray, cosines: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray]:
        cosines = np.where(rows == without, 0, cosines.round(9))
        ok = np.flatnonzero(cosines >= max(1e-9, np.partition(cosines, -k)[-k] if len(cosines) > k else 0))
        best = ok[np.lexsort((self.ids[rows[ok]], -cosines[ok]))[:k]]
        return rows[best], cosines[best]

    def _by_blocks(self, tables: Tables, terms: np.ndarray, weights: np.ndarray, k: int, without: int) -> tuple[np.ndarray, np.ndarray] | None:
        """None if more than FEW_BLOCKS blocks may hold one of the k nearest."""
        blocks, values = _joined(tables.top_starts, tables.top_blocks, tables.top, terms, weights)
        bound = np.bincount(blocks, values, (len(self.ids) + BLOCK - 1) // BLOCK)
        order = np.argsort(-bound, kind="stable")
        tables.query[terms] = weights * self.idf[terms]
        rows, cosines, kth = np.zeros(0, np.int64), np.zeros(0), 0.0
        for n, b in enumerate(order.tolist()):
            if bound[b] <= 0 or bound[b] < kth - BOUND:
                break
            if n == FEW_BLOCKS or (n == 1 and bound[order[min(FEW_BLOCKS, len(order) - 1)]] >= max(kth - BOUND, 1e-9) and len(order) > FEW_BLOCKS):
                rows = None
                break
            lo, hi = b * BLOCK, min((b + 1) * BLOCK, len(self.ids))
            s, e = self.starts[lo], self.starts[hi]
            got = np.add.reduceat(tables.query[self.columns[s:e]] * self.levels[self.level[s:e]], self.starts[lo:hi] - s) / self.norms[lo:hi]
            rows, cosines = self._best(np.append(rows, np.arange(lo, hi)), np.append(cosines, got), k, without)
            kth = cosines.min() if len(rows) == k else 0.0
        tables.query[terms] = 0
        return None if rows is None else (rows, cosines)

    def vote(self, rows: np.ndarray, cosines: np.ndarray) -> float:
        if not len(rows):
            return -1.0
        w = 1 / (1 - np.minimum(cosines, 1) + SOFTEN)
        return float((w * self.toxic[rows]).sum() / w.sum())

    def calibrated(self, vote: float) -> float:
        if vote < 0:
            return self.base
        return float(self.values[max(0, int(np.searchsorted(self.steps, vote + 1e-12, side="right")) - 1)])


def build(ids: np.ndarray, toxic: np.ndarray, counts: list[dict[int, int]], vocabulary: np.ndarray, idf: np.ndarray, k: int = NEIGHBOURS) -> Index:
    terms = np.array([t for c in counts for t in sorted(c)], np.int64)
    tf = np.array([c[t] for c in counts for t in sorted(c)], np.int64)
    return assemble(ids, toxic, np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int64), terms, tf, vocabulary, idf, k)


def _own_votes(index: Index, k: int):
    """The vote of each example in a range, without itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.column(0).to_numpy()
            own = [slice(*index.starts[x : x + 2].tolist()) for x in i.tolist()]
            found = index.all_nearest([(index.columns[x], index.weights_of(j, j + 1)) for j, x in zip(i.tolist(), own)], k, i.tolist())
            released()
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array([index.vote(*x) for x in found], pa.float64())], names=["i", "vote"])

    return run


def assemble(ids: np.ndarray, toxic: np.ndarray, starts: np.ndarray, terms: np.ndarray, tf: np.ndarray, vocabulary: np.ndarray, idf: np.ndarray, k: int, spark: SparkSession | None = None) -> Index:
    """As ``build``; example i has the terms and frequencies from starts[i] to starts[i + 1]. With spark, the examples' votes are
    computed by its tasks."""
    size = np.diff(starts)
    has = size > 0
    base = (float(toxic[~has].sum()) + 0.5 * float(toxic.mean()) if len(toxic) else 0.0) / ((~has).sum() + 0.5 if len(toxic) else 1)
    index = Index(vocabulary, idf, ids, toxic, np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0), np.zeros(0), base, np.zeros(1), np.zeros(1))
    use = np.flatnonzero(has)
    norms = np.ones(len(ids))
    lead = []
    for i in use.tolist():
        at = slice(starts[i], starts[i + 1])
        w = (1 + np.log(tf[at])) * idf[terms[at]]
        norms[i] = _length(w)
        lead.append(int(terms[at][np.argmax(w)]))
    # neighbours in the order share their heaviest term, so a block's bounds are tight
    use = use[np.lexsort((ids[use], np.array(lead, np.int64)))]
    index.ids, index.toxic = ids[use], toxic[use].astype(float)
    index.starts = np.concatenate([[0], np.cumsum(size[use])]).astype(np.int64)
    if len(use):
        at = np.arange(index.starts[-1]) + np.repeat(starts[use] - index.starts[:-1], size[use])
        distinct = np.unique(tf)
        index.columns, index.norms = terms[at].astype(np.int32), norms[use]
        index.level, index.levels = np.searchsorted(distinct, tf[at]).astype(_smallest(len(distinct))), 1 + np.log(distinct)
        del at
        if spark:
            got = spark.range(0, len(use), 1, 1 + len(use) // 250).mapInArrow(_own_votes(index, k), "i long, vote double").toArrow()  # a row an example
            votes = np.zeros(len(use))
            votes[got.column("i").to_numpy()] = got.column("vote").to_numpy()
        else:
            votes = next(_own_votes(index, k)(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(len(use)))], names=["i"])]))).column("vote").to_numpy()
        index.tables = None
        known = votes >= 0
        if known.any():
            index.steps, index.values = isotonic(votes[known], index.toxic[known])
        else:
            index.steps, index.values = np.array([0.0, 0.5]), np.array([0.0, 1.0])
    return index


def _g2(a: np.ndarray, n: np.ndarray, toxic: float, total: float) -> np.ndarray:
    """Likelihood ratio of a term in a of ``toxic`` and n - a of the other examples; 0 where it is rarer in toxic ones."""

    def part(x, m, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return x * np.log(p) + (m - x) * np.log(1 - p)

    b, clean = n - a, total - toxic
    g = 2 * (part(a, toxic, a / toxic) + part(b, clean, b / clean) - part(a, toxic, n / total) - part(b, clean, n / total))
    return np.where(a / toxic > b / clean, g, 0)


def _document_frequencies(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(vocabulary) + 1, np.int64)  # last: all documents
        for b in batches:
            for texts in (b.column("text").slice(i, TEXTS) for i in range(0, len(b), TEXTS)):
                seen[:-1] += np.bincount(lexer.counted(texts.to_pylist(), vocabulary)[1], minlength=len(vocabulary))
                seen[-1] += len(texts)
            released()
        t = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(seen[t], pa.int64())], names=["t", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS, seed: int = SEED, min_g2: float = MIN_G2) -> Index | None:
    """None without labelled documents of both kinds."""
    found = labelled_sample(docs, labels, "toxic", examples, seed)
    found = materialise(found.mapInArrow(_example_batches, "doc_id long, y double, terms array<long>, tf array<int>, prints array<long>"), "examples")
    # the sample is bounded: so is what follows on the driver
    data = found.orderBy("doc_id").toArrow().combine_chunks()
    ids, toxic = (data.column(c).to_numpy() for c in ("doc_id", "y"))
    prints = np.array(data.column("prints").to_pylist(), np.int64).reshape(-1, 4)
    lone = np.ones(len(ids), bool)
    for i in range(4):
        at = np.flatnonzero(lone)
        lone[np.delete(at, np.unique(prints[at, i], return_index=True)[1])] = False
    if not 0 < toxic[lone].sum() < lone.sum():
        return None
    starts = np.concatenate([[0], np.cumsum(data.column("terms").combine_chunks().value_lengths().to_numpy())]).astype(np.int64)
    vocabulary, column = np.unique(data.column("terms").combine_chunks().flatten().to_numpy().view(np.uint64), return_inverse=True)
    column = column.astype(np.int32)
    tf = data.column("tf").combine_chunks().flatten().to_numpy().astype(np.int32)
    del data, prints
    released()
    once = np.repeat(lone, np.diff(starts))
    n, a = (np.bincount(column[once], x, len(vocabulary)) for x in (None, np.repeat(toxic, np.diff(starts))[once]))
    tells = (a >= MIN_EXAMPLES) & (_g2(a, n.astype(float), float(toxic[lone].sum()), float(lone.sum())) >= min_g2)
    rows = docs.select("text").mapInArrow(_document_frequencies(vocabulary), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[rows.column("t").to_numpy()] = rows.column("n").to_numpy()
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1) * np.where(tells, LEAD, 1.0)
    del rows, once, n, a
    index = assemble(ids, toxic, starts, column, tf, vocabulary, idf, k, docs.sparkSession)
    del column, tf
    released()
    return index


_RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("cosines", T.ArrayType(T.DoubleType())), T.StructField("toxic", T.ArrayType(T.IntegerType()))])
_FOUND = pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int64())), ("cosines", pa.list_(pa.float64())), ("toxic", pa.list_(pa.int32()))])


def _scorer(index: Index, k: int):
    @F.arrow_udf(_RESULT)
    def score(texts: pa.Array) -> pa.Array:
        seen: dict[bytes, int] = {}
        place = np.zeros(len(texts), np.int64)
        parts = [pa.array([], _FOUND)]
        none = (index.calibrated(-1.0), [], [], [])
        for at in range(0, len(texts), TEXTS):
            some = []
            for i, text in enumerate(texts.slice(at, TEXTS).to_pylist(), at):
                text = text or ""
                key = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if key not in seen:
                    seen[key] = len(seen)
                    some.append(text)
                place[i] = seen[key]
            bounds, terms, tf = lexer.counted(some, index.vocabulary)
            own = [(i, slice(a, b)) for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())) if b > a]
            out = [none] * len(some)
            for (i, _), (rows, cosines) in zip(own, index.all_nearest([(terms[x], index.unit(terms[x], tf[x])) for _, x in own], k)):
                out[i] = (index.calibrated(index.vote(rows, cosines)), index.ids[rows].tolist(), cosines.tolist(), index.toxic[rows].astype(int).tolist())
            parts.append(pa.array([dict(zip(_FOUND.names, x)) for x in out], _FOUND))
        released()
        return pa.concat_arrays(parts).take(pa.array(place))

    return score


def score(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS, seed: int = SEED, min_g2: float = MIN_G2) -> DataFrame:
    """The columns of docs and toxicity (calibrated probability), toxic (>= TOXIC_FROM), evidence (nearest examples first:
    ids, their cosines, their labels).

    Every document is a query over its whole text; words that no example has are left out of its length. One without any
    word of the examples has no neighbour: empty evidence and the rate of such examples. A labelled document finds itself, its label is part of the evidence. Nulls: a null text counts
    as empty; labels with null ids or values are left out, several of one id vote. A labelled id with several texts stands for
    the one with the smallest hash; rows without an id are never examples. Without examples of both kinds toxicity
    is null and toxic false. Ties among neighbours go to the smaller id, repeated rows get equal results. An empty
    table gives an empty table. Columns that are already called toxicity, toxic or evidence_* become *_in, any other name is left alone.
    """
    g = guarded(docs, ["doc_id", "text"], RESULTS)
    index = fit(g.rows, labels, examples, k, seed, min_g2)
    if index is None:
        none = [F.lit(None).cast("double"), F.lit(False), F.array().cast("array<bigint>"), F.array().cast("array<double>"), F.array().cast("array<int>")]
        return g.restored(g.rows, *[x.alias(n) for n, x in zip(RESULTS, none)])
    got = g.rows.withColumn("found", _scorer(index, k)(F.col("text")))
    parts = [F.col("found.score"), F.col("found.score") >= TOXIC_FROM, F.col("found.ids"), F.col("found.cosines"), F.col("found.toxic")]
    return g.restored(got, *[x.alias(n) for n, x in zip(RESULTS, parts)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text", "lang", "source", "n_chars")

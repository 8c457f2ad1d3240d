"""Operator 6, BPE encoding and decoding with a public vocabulary's ranks.

The distinct words of a batch lie in one flat array of symbols. A pair occurrence index maps each mergeable pair to all
its positions; active ranks are applied in ascending order, each to all its positions at once, and only the lists of the
neighbouring pairs change. Word splitting and decoding are array operations as well; no Python code runs for each token.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import guarded, released, table

#: A file of base64 tokens and ranks; the split pattern is that of GPT-2's vocabulary.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_SLICE = 1_500_000
_RANKED = 200_000
_NONE = np.int32(2**31 - 1)
_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


class Vocabulary:
    """Token bytes by id, and for each pair of ids whose bytes joined are a token, that token's id (its rank)."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.get)
        self.ids = np.array([ranks[t] for t in tokens], np.int64)
        size = int(self.ids.max()) + 1
        lengths = np.zeros(size, np.int64)
        lengths[self.ids] = [len(t) for t in tokens]
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        keys = np.array(list(pairs), np.int64)
        order = np.argsort(keys)
        self.pairs, self.merged = keys[order], np.array(list(pairs.values()), np.int32)[order]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if len(left) > _RANKED:  # temporary arrays stay small
            return np.concatenate([self.rank(left[k : k + _RANKED], right[k : k + _RANKED]) for k in range(0, len(left), _RANKED)])
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], _NONE)

    def encode_words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words data[starts[i]:starts[i + 1]], flat, and where each word's begin."""
        n = len(data)
        sym = self.byte[data].astype(np.int32)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        last = np.zeros(n + 1, bool)
        last[starts[1:] - 1] = True
        last = last[:n]
        rank = np.full(n + 1, _NONE, np.int32)
        for k in range(0, n, _RANKED):
            inner = np.flatnonzero(~last[k : k + _RANKED]) + k
            rank[inner] = self.rank(sym[inner], sym[inner + 1])
        alive = np.ones(n, bool)
        lists: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def push(at: np.ndarray) -> None:
            at = at[rank[at] != _NONE]
            if not len(at):
                return
            if len(at) == 1:
                r = int(rank[at[0]])
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(heap, r)
                lists[r].append(at)
                return
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            rs = rank[at]
            cut = np.flatnonzero(rs[1:] != rs[:-1]) + 1
            edges = [0, *cut.tolist(), len(at)]
            for a, b in zip(edges[:-1], edges[1:]):
                r = int(rs[a])
                if r not in lists:
                    lists[r] = []
                    heapq.heappush(heap, r)
                lists[r].append(at[a:b])

        push(np.flatnonzero(rank[:n] != _NONE).astype(np.int32))
        while heap:
            r = heapq.heappop(heap)
            parts = lists.pop(r)
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[rank[at] == r]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.unique(at)
                clash = nxt[at[:-1]] == at[1:]
                if clash.any():  # overlapping occurrences: leftmost first
                    index = np.arange(len(at))
                    head = np.concatenate([[True], ~clash])
                    at = at[(index - np.maximum.accumulate(np.where(head, index, 0))) % 2 == 0]
            right = nxt[at]
            far = nxt[right]
            sym[at] = r
            alive[right] = False
            rank[right] = _NONE
            end = last[right]
            last[at] = end
            nxt[at] = far
            ok = ~end
            prv[far[ok]] = at[ok]
            before = prv[at]
            before = before[before >= 0]
            before = before[~last[before] & alive[before]]
            rank[at[end]] = _NONE
            open_ = at[ok]
            redo = np.unique(np.concatenate([open_, before])) if len(open_) + len(before) > 1 else np.concatenate([open_, before])
            rank[redo] = self.rank(sym[redo], sym[nxt[redo]])
            push(redo)
        del nxt, prv, rank, last
        ids = sym[alive]
        upto = np.concatenate([[0], np.cumsum(alive)])
        return ids, upto[starts]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids, flat, and where each token's begin."""
        return _ragged(self.data, self.starts, ids)


def _ragged(values: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[starts[r]:starts[r + 1]] for all rows one after another, and where each begins."""
    sizes = (starts[1:] - starts[:-1])[rows]
    out = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(out[-1]) + np.repeat(starts[:-1][rows] - out[:-1], sizes)
    return values[at], out


def _class_table() -> np.ndarray:
    """Class of each code point; made once a process."""
    kept = sys.__dict__.setdefault("_loomtext_kept", {})
    if "classes" not in kept:
        t = np.full(0x110000, _OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                t[c] = _LETTER
            elif k == "N":
                t[c] = _NUMBER
        t[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        kept["classes"] = t
    return kept["classes"]


def split_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 bytes, where words begin and the last ends, words a text): contractions, runs of letters, numbers or
    others with a space before them, and white space, of which the last before a word stands alone."""
    joined = "".join(texts)
    data = np.frombuffer(joined.encode(), np.uint8)
    lead = (data & 0xC0) != 0x80  # first bytes of code points
    if len(joined) == len(data):
        code = data
    else:
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(code)
    if not n:
        return data, np.zeros(1, np.int64), np.zeros(len(texts), np.int64)
    c = _class_table()[code]
    ends = np.cumsum([len(t) for t in texts])
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    begins = first[:-1]
    differs = np.empty(n, bool)
    differs[0] = True
    np.not_equal(c[1:], c[:-1], out=differs[1:])
    start = differs | begins
    space = c == _SPACE
    # the last white space before something else in the same text
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & ~space[1:] & ~begins[1:]
    start |= last
    prefix = np.flatnonzero(last & (code == 32))
    start[prefix + 1] = False
    quote = np.flatnonzero((code == 39) & start)
    if len(quote):
        limit = np.concatenate([code, np.zeros(2, code.dtype)])
        a, b = limit[quote + 1], limit[quote + 2]
        in1 = ~first[quote + 1]
        in2 = in1 & ~first[np.minimum(quote + 2, n)]
        one = in1 & np.isin(a, [ord(x) for x in "stmd"])
        two = in2 & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        p = quote[one | two]
        length = np.where(one[one | two], 2, 3)
        start[p + 1] = False
        after = p + length
        inside = after < n
        start[after[inside]] = True
    at = np.flatnonzero(start)
    where = np.flatnonzero(lead)[at] if n != len(data) else at
    upto = np.concatenate([[0], np.cumsum(start)])
    return data, np.append(where, len(data)), np.diff(np.concatenate([[0], upto[ends]]))


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _SLICE bytes: temporary arrays stay small."""
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _SLICE, side="right")))
        yield at, to
        at = to


def encode_texts(vocabulary: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, their bounds by text, whether they decode to the text). Words are encoded once for all of texts, a column
    without nulls; they are split, looked up and decoded a slice at a time, and between that only their numbers are held."""
    ranges, numbers, counts = list(_slices(texts)), [], []
    words = pa.array([], pa.binary())
    for at, to in ranges:
        data, where, per = split_words(texts.slice(at, to - at).to_pylist())
        piece = pa.Array.from_buffers(pa.binary(), len(where) - 1, [None, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        known = pa.compute.index_in(piece.dictionary, words)
        new = piece.dictionary.filter(known.is_null())
        place = known.to_numpy(zero_copy_only=False)
        place = np.where(np.isnan(place), -1, place).astype(np.int32) if place.dtype.kind == "f" else place.astype(np.int32)
        place[place < 0] = len(words) + np.arange(len(new), dtype=np.int32)
        words = pa.concat_arrays([words, new])
        numbers.append(place[piece.indices.to_numpy(zero_copy_only=False)])
        counts.append(per)
    if not len(words):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64), np.ones(len(texts), bool)
    _, starts, data = words.buffers()
    starts = np.frombuffer(starts, np.int32)[: len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[: starts[-1]] if data is not None else np.zeros(0, np.uint8)
    ids, bounds = vocabulary.encode_words(data, starts)
    size = np.diff(bounds)
    words_at = [np.concatenate([[0], np.cumsum(x)]) for x in counts]
    sizes = [np.diff(np.concatenate([[0], np.cumsum(size[x])])[at]) for x, at in zip(numbers, words_at)]
    ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    out, same = np.empty(ends[-1], np.int32), np.ones(len(texts), bool)
    for i, (at, to) in enumerate(ranges):
        flat, _ = _ragged(ids, bounds, numbers[i])
        numbers[i] = None
        out[ends[at] : ends[to]] = flat
        raw = "".join(texts.slice(at, to - at).to_pylist()).encode()
        raw = np.frombuffer(raw, np.uint8)
        byte_at = np.concatenate([[0], np.cumsum(pa.compute.binary_length(texts.slice(at, to - at)).to_numpy(zero_copy_only=False).astype(np.int64))])
        back, token_at = vocabulary.decode(flat)
        wrong = np.concatenate([[0], np.cumsum(back != raw)]) if len(back) == len(raw) else np.arange(len(raw) + 1)
        same[at:to] = (wrong[byte_at[1:]] == wrong[byte_at[:-1]]) & (token_at[ends[at : to + 1] - ends[at]] == byte_at)[1:]
    return out, ends, same


def _encoder(vocabulary: Vocabulary):
    @F.arrow_udf(T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]))
    def encode(texts: pa.Array) -> pa.Array:
        valid = texts.is_valid()
        ids, bounds, same = encode_texts(vocabulary, texts.fill_null(""))
        released()
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
        return pa.StructArray.from_arrays([pa.compute.if_else(valid, lists, pa.scalar(None, lists.type)), pa.compute.if_else(valid, pa.array(same), pa.scalar(None, pa.bool_()))], names=["ids", "round_trip"])

    return encode


def encode(docs: DataFrame, ranks: str = RANKS, text: str = "text") -> DataFrame:
    """The columns of docs, ids (token ids of the whole text), n_tokens, and round_trip (decoded again, they give the text).

    Nulls: a null text has null ids, n_tokens and round_trip; an empty one no ids. Strings that look like special tokens are
    ordinary text. Equal rows get equal ids; an empty table gives an empty table. Columns called ids, n_tokens or
    round_trip become *_in, any other name is left alone. Very long texts are encoded whole. The vocabulary is read once, on the driver.
    """
    g = guarded(docs, [text], ("ids", "n_tokens", "round_trip"))
    got = g.rows.withColumn("found", _encoder(Vocabulary.load(ranks))(F.col(f"`{text}`")))
    ids = F.col("found.ids")
    return g.restored(got, ids.alias("ids"), F.when(ids.isNotNull(), F.size(ids)).alias("n_tokens"), F.col("found.round_trip").alias("round_trip"))


def decode(tokens: DataFrame, ranks: str = RANKS, ids: str = "ids") -> DataFrame:
    """The columns of tokens and decoded: the ids' text. Null ids give null, no ids the empty text, and bytes that aren't
    UTF-8 the replacement character; an id that the vocabulary lacks or a null one raises. decoded becomes decoded_in."""
    g = guarded(tokens, [ids], ["decoded"])
    vocabulary = Vocabulary.load(ranks)

    @F.arrow_udf("string")
    def back(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and (flat.dtype.kind == "f" or flat.min() < 0 or flat.max() >= len(vocabulary.starts) - 1):
            raise ValueError("an id isn't in the vocabulary")
        data, at = vocabulary.decode(flat)
        sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        ends = at[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        data = data.tobytes()
        return pa.array([data[a:b].decode(errors="replace") if ok else None for a, b, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist())], pa.string())

    return g.restored(g.rows, back(F.col(f"`{ids}`")).alias("decoded"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).select("doc_id", "ids", "n_tokens", "round_trip")

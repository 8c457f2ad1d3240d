"""Operator 2, n-gram Jaccard join by universe-partition pigeonhole.

A document is the set of its word n-grams. For sets of a size band, the universe of n-grams is hashed into segments.
Two sets whose Jaccard similarity reaches the threshold differ in at most H n-grams, so if the longer one (the prober)
allots thresholds v (0, 1 or 2) to segments with a sum of H + 1, some segment differs in less than v n-grams: with v = 1
its subsets are equal, with v = 2 one is the other or the other less one n-gram. Subsets, and in some segments their
one-deletion neighbourhoods, are indexed; the prober allots by cost, leaving out empty segments (shared by everyone)
and taking single n-grams and deletion neighbourhoods last. Candidates are dropped if the parities of n-grams by hash cell, of
which each n-gram in only one set flips one, already differ in more than H cells.

Candidate pairs are never listed: a task reports a spanning forest of them. Within each component of all forests, every pair is
verified on the whole sets, once, and counted where it is found. So rows grow with the documents, neither with the pairs of
a group of variants nor with the tasks that meet a pair.

Signatures travel as packed arrays, one row for each batch of documents and bucket (size band, range of segments), so the
shuffle carries 5 bytes a signature and no row overhead; a bucket holds a bounded number of signatures at any input size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import bloom
from loomtext.llm.classes import classes_sql, components, counted, summary
from loomtext.llm.common import guarded, materialise, released, table

N = 2
THRESHOLD = 0.7
#: Signatures that a bucket aims at.
BUCKET_SIGNATURES = 1_500_000
#: Buckets of a size band that one task goes through: it gets a document's sketch, and reports a pair, once for all of them.
TASK_BUCKETS = 8
#: Documents of a band up to which one task holds a sketch of each: beyond, signatures are dealt out to parts by their value.
BAND_DOCS = 2_000_000
#: N-grams of one side of a verification task.
TASK_GRAMS = 1_000_000
#: Segments for each that a prober of the largest size needs: the rest is left out as empty or shared by many.
SLACK = 1.2
_SPLIT = r"[^\p{L}\p{N}]+"
_WORDS = r"[\p{L}\p{N}]"
_SUBS = 4096
_U = np.uint64
_DEL, _IDX, _PROBE = 1, 2, 4
_OWN, _BRUTE = 1, 2


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), _SPLIT), lambda x: x != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda x: F.xxhash64(x))


def text_key(text: Column) -> Column:
    """64 bits of the text's identity; texts that differ share one with a probability of n^2 / 2^65."""
    return F.xxhash64(text)


# ---------------------------------------------------------------- numpy kernels


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_sets(values: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each document, from its word hashes; a document of 1 to n - 1 words is one n-gram."""
    v = values.view(_U)
    out = []
    if len(v) >= n:
        g = v[: len(v) - n + 1].copy()
        for j in range(1, n):
            g = _mix(g) * _U(0x9E3779B97F4A7C15) + v[j : len(v) - n + 1 + j]
        g = _mix(g)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            x = np.sort(g[a : b - n + 1])
            keep = np.empty(len(x), bool)
            keep[0] = True
            np.not_equal(x[1:], x[:-1], out=keep[1:])
            out.append(x[keep])
        elif b > a:
            h = v[a : a + 1].copy()
            for j in range(a + 1, b):
                h = _mix(h) * _U(0x9E3779B97F4A7C15) + v[j : j + 1]
            out.append(_mix(h + _U(b - a)))
        else:
            out.append(v[:0])
    return out


def bands(t: float, limit: int = 1 << 40) -> np.ndarray:
    """Lower ends of the size bands; each next one is the first size beyond 1 / t times the last."""
    ends = [1]
    while ends[-1] < limit:
        ends.append(max(ends[-1] + 1, int(np.floor(ends[-1] / t)) + 1))
    return np.array(ends, np.int64)


def most_different(longer: np.ndarray, shorter: np.ndarray, t: float) -> np.ndarray:
    """The largest symmetric difference of sets of these sizes, or of a smaller shorter one, at a similarity of t."""
    best = np.zeros(len(longer), np.int64)
    for back in range(8):  # by rounding, a slightly smaller partner may be allowed to differ more
        s = shorter - back
        both = longer + s
        overlap = np.ceil(t / (1 + t) * both - 1e-9).astype(np.int64)
        overlap = np.minimum(overlap, s)
        best = np.maximum(best, np.where((s >= 1) & (s + 1e-9 >= t * longer), both - 2 * overlap, 0))
    return best


def scheme(band: np.ndarray, ends: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Segments of a band, and how many of them also index one-deletion neighbourhoods."""
    upper = ends[band + 1] - 1
    longest = np.floor(upper / t + 1e-9).astype(np.int64)
    need = most_different(longest, upper, t) + 1
    m = np.ceil(SLACK * need).astype(np.int64)
    d = np.where(upper <= 24, m, np.ceil(np.where(upper <= 200, 0.12, 0.06) * m)).astype(np.int64)
    return m, d


def _cells(band, ends):
    """Parity cells of a band: a power of two, no less than its largest set."""
    return 1 << np.maximum(6, np.ceil(np.log2(ends[band + 1] - 1)).astype(np.int64))


def _sketches(g, doc, band, ends) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds by document): whether each cell holds an odd number of the document's n-grams."""
    m = _cells(band, ends)
    base = np.concatenate([[0], np.cumsum(m)])
    at = base[doc] + (_mix(g ^ _U(0x8BADF00D5EED1234)) % m[doc].astype(_U)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=int(base[-1])).astype(np.uint8) & 1), base // 8


def _signatures(g, rarity, doc, sizes, band, prober, ends, t):
    """One band a document: (document, segment, signature, flags), and the documents whose allotment didn't reach H + 1.

    g, rarity, doc: the n-grams, the logarithms of their shares of documents, and their documents' indexes; band: by
    document. prober: False where it is only indexed.
    """
    m, dels = scheme(band, ends, t)
    own = np.searchsorted(ends, sizes, side="right") - 1 == band
    h = _mix(g + (band[doc].astype(_U) + _U(1)) * _U(0xD1342543DE82EF95))
    seg = ((h >> _U(33)) * m[doc].astype(_U) >> _U(31)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(m)])
    cell = base[doc] + seg
    order = np.argsort(cell, kind="stable")
    cell, part = cell[order], _mix(g[order] ^ _U(0xA0761D6478BD642F))
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    total = np.add.reduceat(part, first) if len(first) else part
    chance = np.add.reduceat(rarity[order], first) if len(first) else rarity
    e = np.diff(np.concatenate([first, [len(cell)]]))
    at = cell[first]
    of = doc[order][first]
    seg = at - base[of]
    salt = _mix(seg.astype(_U) * _U(0x9E3779B97F4A7C15) + band[of].astype(_U))
    # the prober's allotment: first thresholds of 1 by the chance that others share the subset, then deletions by their
    # number. A threshold of 2 needs two n-grams: one n-gram less one is empty, and empty subsets aren't indexed
    can = prober[of]
    pick = np.flatnonzero(can)
    more = np.flatnonzero(can & (seg < dels[of]) & (e > 1))
    cost = np.concatenate([np.minimum(chance[pick], 0), e[more].astype(float)])
    which = np.concatenate([pick, more])
    upper = ends[band + 1] - 1
    need = most_different(sizes, np.minimum(sizes, upper), t) + 1
    by = np.lexsort((cost, of[which]))
    owner = of[which][by]
    start = np.searchsorted(owner, np.arange(len(sizes)))
    chosen = by[np.arange(len(by)) - start[owner] < need[owner]]
    v1 = np.zeros(len(at), bool)
    v2 = np.zeros(len(at), bool)
    v1[which[chosen[chosen < len(pick)]]] = True
    v2[which[chosen[chosen >= len(pick)]]] = True
    got = np.bincount(owner, minlength=len(sizes))
    brute = prober & (got < need) & (sizes > 0)
    flags = np.where(own[of], _IDX, 0) + np.where(v1, _PROBE, 0)
    keep = flags > 0
    out = [(of[keep], seg[keep], _mix(total[keep] + salt[keep]), flags[keep].astype(np.uint8))]
    indexed = own[of] & (seg < dels[of]) & (e > 2)
    want = indexed | v2
    cells = np.repeat(np.arange(len(at)), e)
    rows = np.flatnonzero(want[cells])
    c = cells[rows]
    out.append((of[c], seg[c], _mix(total[c] - part[rows] + salt[c]), (_DEL + np.where(indexed[c], _IDX, 0) + np.where(v2[c], _PROBE, 0)).astype(np.uint8)))
    of, seg, sig, flags = (np.concatenate(x) for x in zip(*out))
    return of, seg, sig, flags, own, brute


_PACKED = pa.schema([("task", pa.int64()), *((c, pa.binary()) for c in ("rid", "size", "meta", "sketch", "sub", "doc", "len", "low", "high"))])
PACKED_DDL = "task long, rid binary, size binary, meta binary, sketch binary, sub binary, doc binary, len binary, low binary, high binary"


_PART = TASK_BUCKETS << 40


def _packed(rids: np.ndarray, sets: list[np.ndarray], t: float, ends: np.ndarray, subs: dict[int, tuple[int, int]], out: dict, seen: np.ndarray) -> int:
    # subs: by band, its buckets and its parts
    # seen: documents by n-gram (hashed), of those that the task has read; the last place counts them all
    every = np.concatenate(sets) if sets else np.zeros(0, _U)
    seen[:-1] += np.bincount((every >> _U(44)).astype(np.int64), minlength=len(seen) - 1).astype(np.int32)
    seen[-1] += len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    own = np.searchsorted(ends, sizes, side="right") - 1
    lowest = np.searchsorted(ends, np.ceil(t * sizes - 1e-9).astype(np.int64), side="right") - 1
    n = 0
    for back in range(int((own - lowest).max(initial=0)) + 1):
        use = np.flatnonzero((sizes > 0) & (own - back >= np.maximum(lowest, 0)))
        if not len(use):
            break
        g = np.concatenate([sets[i] for i in use])
        doc = np.repeat(np.arange(len(use)), sizes[use])
        band = (own - back)[use]
        rarity = np.log(np.maximum(seen[(g >> _U(44)).astype(np.int64)], 1) / (seen[-1] + 1.0))
        of, seg, sig, flags, mine, brute = _signatures(g, rarity, doc, sizes[use], band, np.ones(len(use), bool), ends, t)
        sketch, edges = _sketches(g, doc, band, ends)
        m, _ = scheme(band, ends, t)
        s, parts = (np.array([subs.get(int(b), (1, 1))[i] for b in band], np.int64) for i in (0, 1))
        bucket = band[of] * _SUBS + seg * s[of] // m[of] + (_mix(sig) % parts[of].astype(_U)).astype(np.int64) * _PART
        # every indexed document shows in one part of the band's first bucket, probers without an allotment in all parts
        one, every_ = np.flatnonzero(mine & ~brute), np.flatnonzero(brute)
        show = np.concatenate([one, np.repeat(every_, parts[every_])])
        part = np.concatenate([(rids[use[one]].view(_U) % parts[one].astype(_U)).astype(np.int64), _ranges(np.zeros(len(every_), np.int64), parts[every_])])
        of = np.concatenate([of, show])
        bucket = np.concatenate([bucket, band[show] * _SUBS + part * _PART])
        real = np.concatenate([np.ones(len(sig), bool), np.zeros(len(show), bool)])
        sig = np.concatenate([sig, np.zeros(len(show), _U)])
        flags = np.concatenate([flags, np.zeros(len(show), np.uint8)])
        order = np.lexsort((of, bucket))
        of, bucket, real = of[order], bucket[order], real[order]
        low = sig[order].astype(np.uint32)
        high = ((sig[order] >> _U(32)).astype(np.uint8) & 0xF8) | flags[order]
        run = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])]))
        count = np.add.reduceat(real.astype(np.int32), run)
        low, high = low[real], high[real]
        upto = np.concatenate([[0], np.cumsum(count)])
        meta = (np.where(mine, _OWN, 0) + np.where(brute, _BRUTE, 0)).astype(np.uint8)
        task = bucket[run] // TASK_BUCKETS
        runs = np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])).tolist() + [len(run)]
        for a, b in zip(runs[:-1], runs[1:]):
            docs, local = np.unique(of[run[a:b]], return_inverse=True)
            out.setdefault(int(task[a]), []).append(
                (rids[use[docs]], sizes[use[docs]].astype(np.int32), meta[docs], np.concatenate([sketch[edges[i] : edges[i + 1]] for i in docs.tolist()]),
                 (bucket[run[a:b]] % TASK_BUCKETS).astype(np.uint8), local.astype(np.uint32), count[a:b].astype(np.int32), low[upto[a] : upto[b]], high[upto[a] : upto[b]])
            )
        n += len(low)
    return n


def _flush(out: dict) -> pa.RecordBatch:
    cols = [[] for _ in _PACKED]
    for task, parts in out.items():
        before = np.cumsum([0, *(len(p[0]) for p in parts)])
        parts = [(*p[:5], p[5] + np.uint32(n), *p[6:]) for p, n in zip(parts, before)]
        cols[0].append(task)
        for i, x in enumerate(zip(*parts)):
            cols[i + 1].append(np.concatenate(x).tobytes())
    out.clear()
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _PACKED)], schema=_PACKED)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _signature_batches(n: int, t: float, subs: dict[int, tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, out, held = bands(t), {}, 0
        seen = np.zeros((1 << 20) + 1, np.int32)
        for batch in batches:
            values, offsets = _lists(batch.column("w"))
            rids = batch.column("rid").to_numpy(zero_copy_only=False)
            at = 0
            while at < len(rids):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 200_000, side="right")) - 1)
                sets = gram_sets(values[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], n)
                held += _packed(rids[at:to], sets, t, ends, subs, out, seen)
                at = to
                if held > 4_000_000:
                    yield _flush(out)
                    held = 0
        if out:
            yield _flush(out)
        released()

    return run


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(size)])
    return np.arange(upto[-1]) + np.repeat(start - upto[:-1], size)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class _Forest:
    """Labels of connected items, and the edges that connected them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []
        self._members: dict[int, list[int]] = {}

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        for a, b in zip(x.tolist(), y.tolist()):
            p, q = int(self.label[a]), int(self.label[b])
            if p == q:
                continue
            self.edges.append((a, b))
            small, large = (self._members.pop(k, [k]) for k in (p, q))
            if len(small) > len(large):
                small, large, q = large, small, p
            self.label[small] = q
            large.extend(small)
            self._members[q] = large

    def span(self, rows: np.ndarray, item: np.ndarray, linked, ends: np.ndarray) -> None:
        """Connects items of rows (row r is of item[r]) as linked(r, others) says; of two linked rows, one is in ends (a mask
        by row). A row that was compared with all of other labels is done. Rows go on until those outside the commonest label
        or those in ends are done, whichever are fewer, so that a group of mutual links takes one pass."""
        before = -1
        while len(rows) > 1:
            label = self.label[item[rows]]
            if len(self.edges) != before:
                names, count = np.unique(label, return_counts=True)
                major, before = names[np.argmax(count)], len(self.edges)
            other = np.flatnonzero(label != major)
            needed = np.flatnonzero(ends[rows])
            if not len(other) or not len(needed):
                break
            at = other[0] if len(other) <= len(needed) else needed[0]
            x = rows[at]
            y = item[linked(x, rows[label != label[at]])]
            self.join(np.full(len(y), item[x]), y)
            rows = np.delete(rows, at)


def _candidates(t: float, forest: bool = False):
    """The candidate pairs of a task's documents; with forest, a spanning forest of them."""

    def run(group: pa.Table) -> pa.Table:
        def col(name, kind):
            return np.concatenate([np.frombuffer(x.as_py(), kind) for x in group.column(name)])

        task = group.column("task")[0].as_py() & ((1 << 40) - 1)
        first = task % (_SUBS // TASK_BUCKETS) == 0
        rid, size, meta = col("rid", np.int64), col("size", np.int32), col("meta", np.uint8)
        ids, local = np.unique(rid, return_inverse=True)  # equal texts have one rid: they count once
        length = np.zeros(len(ids), np.int64)
        length[local] = size
        cells = int(_cells(np.array([task * TASK_BUCKETS // _SUBS]), bands(t))[0])
        one = np.zeros(len(ids), np.int64)
        one[local] = np.arange(len(local))
        sketch = col("sketch", np.uint64).reshape(len(local), cells // 64)[one]
        sub, count = col("sub", np.uint8), col("len", np.int32)
        low, high = col("low", np.uint32), col("high", np.uint8)
        before = np.cumsum([0, *(len(x.as_py()) // 8 for x in group.column("rid"))])
        owner = local[np.concatenate([np.frombuffer(x.as_py(), np.uint32).astype(np.int64) + n for x, n in zip(group.column("doc"), before)])]
        del group
        found: list[np.ndarray] = []
        held = 0

        trees = _Forest(len(ids))

        def alike(lx, ly):
            return np.minimum(lx, ly) + 1e-9 >= t * np.maximum(lx, ly)

        def close(x, y):
            both = length[x] + length[y]
            most = both - 2 * np.ceil(t / (1 + t) * both - 1e-9)
            step = max(1, 4_000_000 // sketch.shape[1])
            apart = [np.bitwise_count(sketch[x[k : k + step]] ^ sketch[y[k : k + step]]).sum(1, dtype=np.int64) for k in range(0, len(x), step)]
            return (np.concatenate(apart) if apart else np.zeros(0, np.int64)) <= most

        def add(x, y):
            nonlocal held
            if forest:
                apart = trees.label[x] != trees.label[y]
                x, y = x[apart], y[apart]
            ok = (x != y) & alike(length[x], length[y])
            x, y = x[ok], y[ok]
            codes = np.unique(np.minimum(x, y) << 32 | np.maximum(x, y))
            x, y = codes >> 32, codes & 0xFFFFFFFF
            codes = codes[close(x, y)]
            if forest:
                trees.join(codes >> 32, codes & 0xFFFFFFFF)
                return
            found.append(codes)
            held += len(found[-1])
            if held > 3_000_000:
                found[:] = [np.unique(np.concatenate(found))]
                held = 0 if len(found[0]) > 1_500_000 else len(found[0])

        at = np.concatenate([[0], np.cumsum(count)])

        def fits(doc, flag, i, j):
            x, y, fx, fy = doc[i], doc[j], flag[i], flag[j]
            lx, ly = length[x], length[y]
            return ((fx & fy & _DEL) == 0) & ((((fx & _PROBE) > 0) & ((fy & _IDX) > 0) & (lx >= ly)) | (((fy & _PROBE) > 0) & ((fx & _IDX) > 0) & (ly >= lx)))

        def emit(doc, flag, i, j):
            ok = fits(doc, flag, i, j)
            add(doc[i[ok]], doc[j[ok]])

        def linked(doc, flag):
            def of(i, j):
                j = j[fits(doc, flag, i, j) & alike(length[doc[i]], length[doc[j]])]
                return j[close(np.full(len(j), doc[i]), doc[j])]

            return of

        for bucket in np.unique(sub).tolist():
            runs = np.flatnonzero(sub == bucket)
            rows = _ranges(at[runs], count[runs])
            doc, flag = np.repeat(owner[runs], count[runs]), high[rows] & 7
            key = (high[rows] & 0xF8).astype(np.uint64) << _U(29) | low[rows].astype(np.uint64)
            order = np.argsort(key, kind="stable")
            key = key[order]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            run_len = np.diff(np.concatenate([edge, [len(key)]]))
            edge, run_len = edge[run_len > 1], run_len[run_len > 1]
            for n in np.unique(run_len).tolist():
                starts = edge[run_len == n]
                if forest:  # a run of connected documents, or one without a prober or an indexed one, has nothing to add
                    step, more = max(1, 1_000_000 // n), []
                    for k in range(0, len(starts), step):
                        rows = order[starts[k : k + step, None] + np.arange(n)]
                        label, flags = trees.label[doc[rows]], np.bitwise_or.reduce(flag[rows], 1)
                        more.append((label != label[:, :1]).any(1) & ((flags & (_IDX | _PROBE)) == (_IDX | _PROBE)))
                    starts = starts[np.concatenate(more)]
                if n <= 512:
                    p, q = np.triu_indices(n, 1)
                    step = max(1, 1_000_000 // len(p))
                    for k in range(0, len(starts), step):
                        s = starts[k : k + step, None]
                        emit(doc, flag, order[(s + p).ravel()], order[(s + q).ravel()])
                else:
                    for s in starts.tolist():
                        rows = order[s : s + n]
                        _, one = np.unique(doc[rows].astype(np.int64) << 3 | flag[rows], return_index=True)
                        rows = rows[one]
                        if forest:
                            rare = min((_IDX, _PROBE), key=lambda x: np.count_nonzero(flag[rows] & x))  # noqa: B023
                            trees.span(rows, doc, linked(doc, flag), (flag & rare) > 0)
                            continue
                        step = max(1, 1_000_000 // len(rows))
                        for k in range(0, len(rows), step):
                            part = rows[k : k + step]
                            emit(doc, flag, np.repeat(part, len(rows)), np.tile(rows, len(part)))
        if first and (meta & _BRUTE).any():
            indexed = np.unique(local[(meta & _OWN) > 0])
            for x in np.unique(local[(meta & _BRUTE) > 0]).tolist():
                y = indexed[length[indexed] <= length[x]]
                add(np.full(len(y), x, np.int64), y.astype(np.int64))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        found.clear()
        if trees.edges:
            x, y = np.array(trees.edges, np.int64).T
            pairs = np.minimum(x, y) << 32 | np.maximum(x, y)
        released()
        return pa.Table.from_arrays([pa.array(ids[pairs >> 32]), pa.array(ids[pairs & 0xFFFFFFFF])], schema=_PAIR)

    return run


_SETS = pa.schema([("rid", pa.int64()), ("grams", pa.binary())])


def _set_batches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column("w"))
            sets = gram_sets(values[offsets[0] : offsets[-1]], offsets - offsets[0], n)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array([s.tobytes() for s in sets], pa.binary())], schema=_SETS)

    return run


PAIRS, LINKS, FOREST = "pairs", "links", "forest"
_FOUND = pa.schema([(c, pa.int64()) for c in ("a", "b", "shared", "total", "linked")])
FOUND_DDL = "a long, b long, shared long, total long, linked long"


def _verified(t: float, want: str):
    """Of one task: its documents, compared within each component; where a component has several parts, within a part or (cross)
    between two.

    PAIRS gives the linked pairs; LINKS a spanning forest of them, and for each document how many rows its links have
    (linked); FOREST the forest alone, for which connected documents needn't be compared.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("component", "ascending"), ("part", "ascending"), ("rid", "ascending")])
        component, rid, part, cross, weight = (group.column(c).to_numpy() for c in ("component", "rid", "part", "cross", "n"))
        sets = [np.frombuffer(x.as_py(), _U) for x in group.column("grams")]
        del group
        size = np.array([len(s) for s in sets], np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        flat = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        del sets
        marked = np.zeros(int(flat.max(initial=0)) + 1, np.int32)
        trees, linked = _Forest(len(rid)), np.zeros(len(rid), np.int64)
        out: list[tuple] = []

        def shared(x, y):
            own = flat[at[x] : at[x + 1]]
            marked[own] = 1
            a, b = y[0], y[-1] + 1
            if 2 * (at[b] - at[a]) <= 3 * size[y].sum():  # most of a stretch: no copy of it
                n = np.add.reduceat(marked[flat[at[a] : at[b]]], at[a:b] - at[a])[y - a]
            else:
                n = np.add.reduceat(marked[flat[_ranges(at[y], size[y])]], np.cumsum(size[y]) - size[y])
            marked[own] = 0
            return n.astype(np.int64)

        edge = np.flatnonzero(np.concatenate([[True], component[1:] != component[:-1], [True]])).tolist()
        for s, e in zip(edge[:-1], edge[1:]):
            sketch = None
            if e - s > 16:
                cells = 1 << int(min(4096, max(64, size[s:e].max())) - 1).bit_length()
                odd = np.bincount(np.repeat(np.arange(e - s) * cells, size[s:e]) + flat[at[s] : at[e]] % cells, minlength=(e - s) * cells)
                sketch = np.packbits(odd.astype(np.uint8) & 1).view(np.uint64).reshape(e - s, cells // 64)
                del odd

            def near(x, y, s=s, sketch=sketch):
                """Those of y, in ascending order, that are linked with x, and their shared n-grams."""
                both = size[x] + size[y]
                ok = np.minimum(size[x], size[y]) + 1e-9 >= t * np.maximum(size[x], size[y])
                if sketch is not None:
                    ok &= np.bitwise_count(sketch[y - s] ^ sketch[x - s]).sum(1, dtype=np.int64) <= both - 2 * np.ceil(t / (1 + t) * both - 1e-9)
                y = y[ok]
                if not len(y):
                    return y, y
                n = shared(x, y)
                ok = n / np.maximum(size[x] + size[y] - n, 1) >= t
                return y[ok], n[ok]

            if want == FOREST:
                trees.span(np.arange(s, e), np.arange(len(rid)), lambda x, y: near(x, y)[0], np.ones(len(rid), bool))  # noqa: B023
                continue
            second = s + int(np.searchsorted(part[s:e], part[s], side="right"))
            for x in range(s, second if cross[s] else e - 1):
                y, n = near(x, np.arange(second if cross[s] else x + 1, e))
                if want == PAIRS:
                    out.append((np.minimum(rid[x], rid[y]), np.maximum(rid[x], rid[y]), n, size[x] + size[y] - n))
                    continue
                linked[x] += weight[y].sum()
                linked[y] += weight[x]
                y = y[trees.label[y] != trees.label[x]]
                trees.join(np.full(len(y), x), y)
        released()
        if want == PAIRS:
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
            return pa.Table.from_arrays([*map(pa.array, cols), pa.nulls(len(cols[0]), pa.int64())], schema=_FOUND)
        x, y = np.array(trees.edges, np.int64).reshape(-1, 2).T
        has = np.flatnonzero(linked)
        none = pa.nulls(len(x) + len(has), pa.int64())
        others = pa.concat_arrays([pa.array(rid[y]), pa.nulls(len(has), pa.int64())])
        counts = pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(linked[has])])
        return pa.Table.from_arrays([pa.array(np.concatenate([rid[x], rid[has]])), others, none, none, counts], schema=_FOUND)

    return run


# ---------------------------------------------------------------- plans


def _sub_buckets(docs: DataFrame, t: float) -> dict[int, tuple[int, int]]:
    """How many buckets and parts each size band needs, from the lengths of all texts (only the tasks' sizes depend on it)."""
    step = float(np.log(1 / t))
    guess = F.floor(F.log(F.greatest(F.length("text") / 6.0, F.lit(1.0))) / step).cast("int")
    per = docs.filter(F.length("text") > 0).groupBy(guess.alias("g")).agg(F.sum(F.length("text") / 6.0).alias("grams"), F.count(F.lit(1)).alias("docs"))
    ends = bands(t)
    grams: dict[int, float] = {}
    count: dict[int, float] = {}
    for r in per.collect():
        b = int(np.searchsorted(ends, max(1, int(np.exp(r.g * step) * 1.1)), side="right") - 1)
        for near, share in ((b - 1, 0.5), (b, 1.0), (b + 1, 0.7)):
            grams[near] = grams.get(near, 0.0) + share * r.grams
            count[near] = count.get(near, 0.0) + share * r.docs
    return {b: (int(min(_SUBS, max(1, np.ceil(x / BUCKET_SIGNATURES)))), int(max(1, np.ceil(count[b] / BAND_DOCS)))) for b, x in grams.items() if b >= 0}


def _found(docs: DataFrame, n: int, threshold: float, want: str, rows: DataFrame | None = None) -> DataFrame:
    """What ``_verified`` finds in all tasks. rows: how many rows (n) each text key (node) has, for LINKS."""
    if n < 1 or not 0 < threshold <= 1:
        raise ValueError("n must be positive and the threshold in (0, 1]")
    texts = docs.select(text_key(F.col("text")).alias("rid"), "text").filter(F.col("text").isNotNull() & (F.col("text") != ""))
    subs = _sub_buckets(docs.select("text"), threshold)
    hashed = texts.select("rid", word_hashes(F.col("text")).alias("w"))
    packed = hashed.mapInArrow(_signature_batches(n, threshold, subs), PACKED_DDL)
    place = components(packed.groupBy("task").applyInArrow(_candidates(threshold, True), "a long, b long")).withColumnRenamed("node", "rid")
    known = bloom.build(place, "rid", place.count())
    once = texts.filter(bloom.may_contain(known, F.col("rid")))
    sets = once.select("rid", word_hashes(F.col("text")).alias("w")).mapInArrow(_set_batches(n), "rid long, grams binary")
    sets = sets.groupBy("rid").agg(F.first("grams").alias("grams")).join(place, "rid")  # one of equal texts
    sets = sets.join(rows.select(F.col("node").alias("rid"), "n"), "rid", "left") if rows is not None else sets.withColumn("n", F.lit(1).cast("long"))
    sets = materialise(sets, "sets")
    # small components share a task, documents of a large one are dealt out to parts: a task is a part or a pair of them
    sizes = sets.groupBy("component").agg(F.sum(F.length("grams") / 8).alias("grams")).withColumn("parts", F.ceil(F.col("grams") / TASK_GRAMS).cast("int"))
    bins = max(1, int(np.ceil((sizes.agg(F.sum("grams")).first()[0] or 0) / TASK_GRAMS)))
    sets = sets.join(sizes.filter("parts > 1").select("component", "parts"), "component", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("rid", F.lit(7)), F.col("parts")).cast("int")
    sets = sets.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    small = F.pmod(F.xxhash64("component", F.lit(11)), F.lit(bins))
    task = F.when(F.col("parts") == 1, small).otherwise(F.xxhash64("component", F.least("part", "other"), F.greatest("part", "other")))
    tasks = sets.select(task.alias("task"), "component", "rid", "part", (F.col("part") != F.col("other")).alias("cross"), "n", "grams")
    return tasks.groupBy("task").applyInArrow(_verified(threshold, want), FOUND_DDL)


def pair_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs a < b of text keys with shared and total n-grams, for all texts that differ and reach the threshold."""
    return _found(docs, n, threshold, PAIRS).select("a", "b", "shared", "total")


def near_classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_links: one row for each document (distinct doc_id and text).

    n_links counts the other documents whose n-gram sets reach the threshold with this one's, equal texts among them: those are
    counted and not paired, all pairs of texts that differ are found. class_id is the smallest doc_id that chains of links
    reach; a document without links is a class of its own.

    Nulls: a null or empty text, or one without letters and digits, has no n-gram and no link. A document with a null doc_id
    counts as a link of others, but its id is never a class's smallest; a class of such documents has a null class_id. A
    text of fewer than n words counts as one n-gram. Repeated rows of one doc_id and text are one document, several texts
    of an id are documents of their own. An empty table gives an empty table; columns other than doc_id and text are
    ignored, whatever their names. Very long texts are sets like any other, no part of them is left out.
    """
    docs = docs.select("doc_id", "text")
    node = F.when(F.col("text").rlike(_WORDS), text_key(F.col("text")))
    rows = docs.select(F.col("doc_id").alias("id"), node.alias("node"), text_key(F.col("text")).alias("t")).distinct().drop("t")
    nodes = counted(rows)
    found = materialise(_found(docs, n, threshold, LINKS, nodes), "links")
    near = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    return summary(rows, found.filter("b IS NOT NULL").select("a", "b"), nodes, near).withColumnRenamed("id", "doc_id")


def deduplicate(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each group of near copies: of its connected component, the one with the smallest doc_id.

    Texts without a word are in no group and stay, as do null texts and all their repeats. Of rows with equal ids, the one with the
    smallest hash of its text, then of all its columns, goes first; of wholly equal rows one stays. A null id loses
    against any other. Very long texts are compared whole; an empty table gives an empty table; columns may have any names.
    Winners are chosen by ids and hashes alone; only the documents of groups, which a size-bounded Bloom filter
    lets through, are shuffled.
    """
    g = guarded(docs, ["doc_id", "text"], [])
    docs = g.rows
    rid = F.when(F.col("text").rlike(_WORDS), text_key(F.col("text")))
    groups = docs.select(rid.alias("node")).filter("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    many = groups.filter("n > 1").select("node", F.col("node").alias("component"))
    found = _found(docs.select("text"), n, threshold, FOREST)
    members = materialise(components(found).unionByName(many).groupBy("node").agg(F.min("component").alias("component")), "members")
    held = bloom.build(members, "node", members.count())
    inside = bloom.may_contain(held, rid)
    checked = docs.filter(inside).withColumns({"node": rid, "row": F.xxhash64(*[F.to_json(F.struct(c)) for c in docs.columns])})
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "row")
    winners = checked.select("node", order.alias("o")).join(members, "node").groupBy("component").agg(F.min("o").alias("o")).select("o.node", "o.row")
    winners = materialise(winners, "winners")
    alone = checked.join(members.select("node"), "node", "left_anti").select(*g.columns)
    first = checked.join(winners, ["node", "row"], "left_semi").dropDuplicates(["node", "row"]).select(*g.columns)
    rest = docs.filter(rid.isNull() | ~inside)
    return g.restored(rest.unionByName(alone).unionByName(first))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


_GRAMS = rf"""
words AS (SELECT text, list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
grams AS (SELECT DISTINCT text, unnest(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM words WHERE len(w) > 0),
sizes AS (SELECT text, count(*) AS n FROM grams GROUP BY text),
shared AS (SELECT a.text AS ta, b.text AS tb, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.text < b.text GROUP BY ALL),
near AS (SELECT ta, tb, o / (x.n + y.n - o)::DOUBLE AS jaccard FROM shared JOIN sizes x ON x.text = ta JOIN sizes y ON y.text = tb WHERE o / (x.n + y.n - o)::DOUBLE >= {THRESHOLD})"""

SQL = f"""
WITH RECURSIVE {_GRAMS},
rows_ AS (SELECT DISTINCT doc_id AS id, sizes.text AS node, documents.text FROM documents LEFT JOIN sizes USING (text)),
links_ AS (SELECT ta AS a, tb AS b FROM near),
{classes_sql("rows_", "links_")}
SELECT id AS doc_id, class_id, n_links FROM summary"""

"""Words of many texts at once: lower-cased runs of letters and digits as 64-bit hashes, in array operations."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np

#: Characters that are hashed at once.
PIECE = 1_000_000
_U = np.uint64
_X = 0x9E3779B97F4A7C15


def _kept() -> dict:
    """Tables that a process makes once: whether a code point is a letter or digit, and powers of the multiplier."""
    kept = sys.__dict__.setdefault("_loomtext_lexer", {})
    if not kept:
        kept["word"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
        kept["up"] = _powers(_X, PIECE + 1)
        kept["down"] = _powers(pow(_X, -1, 1 << 64), PIECE + 1)
    return kept


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, _U)
    out[0] = 1
    return np.cumprod(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _hashed(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, where they start) of a string's words."""
    kept = _kept()
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.diff(np.concatenate([[False], kept["word"][code], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n = len(code)
    up, down = (kept["up"], kept["down"]) if n <= PIECE else (_powers(_X, n + 1), _powers(pow(_X, -1, 1 << 64), n + 1))
    sums = np.zeros(n + 1, _U)
    np.cumsum(mixed(code.astype(_U) + _U(1)) * up[:n], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(_U)), start


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters that end where no word does."""
    at = 0
    while len(text) - at > PIECE:
        to = at + PIECE
        while to < len(text) and text[to].isalnum():
            to += 1
        yield text[at:to]
        at = to
    yield text[at:]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, bounds by text); a null text has none."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    held: list[str] = []
    ids: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            h, start = _hashed("\n".join(held))
            ends = np.cumsum([len(x) + 1 for x in held])
            hashes.append(h)
            np.add.at(counts, ids, np.diff(np.concatenate([[0], np.searchsorted(start, ends)])))
            held.clear()
            ids.clear()
            size = 0

    for i, text in enumerate(texts):
        for piece in _pieces((text or "").lower()):
            if size + len(piece) > PIECE:
                flush()
            held.append(piece)
            ids.append(i)
            size += len(piece) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, _U)), np.concatenate([[0], np.cumsum(counts)])


def counted(texts: list[str | None], vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds by text, terms, frequencies): of each text, its words in ``vocabulary`` (sorted hashes), ascending."""
    h, bounds = words(texts)
    names, inverse = np.unique(h, return_inverse=True)
    at = np.searchsorted(vocabulary, names)
    at[at == len(vocabulary)] = 0
    term = np.where(vocabulary[at] == names, at, -1)[inverse] if len(vocabulary) else np.full(len(h), -1)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    ok = term >= 0
    width = max(1, len(vocabulary))
    key, n = np.unique(doc[ok] * width + term[ok], return_counts=True)
    return np.searchsorted(key, np.arange(len(texts) + 1) * width), key % width, n

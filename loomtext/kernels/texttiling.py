"""Topic segmentation of one text by lexical cohesion."""

from __future__ import annotations

import math
import re
from collections import Counter

_WORD = re.compile("[A-Za-z]+")


def _cosine(a: Counter, b: Counter, weight: list[float], square: list[float]) -> float:
    size = math.sqrt(math.fsum([square[n] for n in a.values()])) * math.sqrt(math.fsum([square[n] for n in b.values()]))  # sums in any order
    return math.fsum([weight[n] * weight[b[w]] for w, n in a.items() if w in b]) / size if size else 0.0


def _leave(counts: Counter, words: list[str]) -> None:
    """Words that are gone leave no key: the counts are of k parts, however long the text."""
    for w in words:
        if counts[w] > 1:
            counts[w] -= 1
        else:
            counts.pop(w)


def _smooth(scores: list[float], radius: int) -> list[float]:
    out = []
    for i in range(len(scores)):
        near = scores[max(0, i - radius) : i + radius + 1]
        out.append(sum(near) / len(near))
    return out


def tile(text: str, w: int = 20, k: int = 10, demo: bool = False) -> tuple[list[str], list[float], list[float], list[int]]:
    """(segments, scores, depths, boundaries). Gaps lie between pseudo-sentences of w words; the score of one is the cosine
    of the k before and the k behind it, whose counts slide along."""
    found = [m[0].lower() for m in _WORD.finditer(text)]
    parts = [found[i : i + w] for i in range(0, len(found), w)]
    n = len(parts)
    if len(found) < w + k or n < 3:
        return [text], [], [], []
    scores = [0.0] * n
    if n >= 2 * k + 1:
        left, right = Counter(), Counter()
        weight = [0.0, *(1 + math.log2(n) for n in range(1, w * k + 1))]  # of the counts that k parts can have
        square = [v * v for v in weight]
        for p in parts[:k]:
            left.update(p)
        for p in parts[k : 2 * k]:
            right.update(p)
        for gap in range(k, n - k + 1):
            scores[gap] = _cosine(left, right, weight, square)
            if gap < n - k:
                left.update(parts[gap])
                _leave(left, parts[gap - k])
                right.update(parts[gap + k])
                _leave(right, parts[gap])
    smooth = _smooth(_smooth(scores, 2), 2)
    depths = [0.0] * n
    for i in range(1, n - 1):
        rise = min(smooth[i - 1], smooth[i + 1]) - smooth[i]
        depths[i] = max(rise, 0.0)
    least = max(depths) * (0.3 if demo else 0.5)
    cuts = [int(0 < i < n - 1 and d >= least and d > depths[i - 1] and d >= depths[i + 1]) for i, d in enumerate(depths)]
    words = text.split()
    segments, start = [], 0
    for i, cut in enumerate(cuts):
        at = i * len(words) // n
        if cut and at > start:
            segments.append(" ".join(words[start:at]))
            start = at
    if start < len(words):
        segments.append(" ".join(words[start:]))
    return segments or [text], scores, depths, cuts

"""String distances that SQL lacks: optimal string alignment, Jaro, Jaro-Winkler."""

from __future__ import annotations


def edit_distance(a: str, b: str, substitution: int = 1, transpositions: bool = False) -> int:
    """H1: insertions and deletions cost 1."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (x != y) * substitution)
            if transpositions and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + substitution)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def jaro(a: str, b: str) -> float:
    """H2 with the published window."""
    if not a or not b:
        return float(a == b)
    window = max(len(a), len(b)) // 2 - 1
    used, matched = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                matched.append(x)
                break
    m = len(matched)
    if not m:
        return 0.0
    half = sum(x != y for x, y in zip(matched, (y for y, u in zip(b, used) if u))) / 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler(a: str, b: str, p: float = 0.1, most: int = 4) -> float:
    """H3."""
    prefix = 0
    while prefix < min(most, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    j = jaro(a, b)
    return j + prefix * p * (1 - j)

"""Combinatory categorial grammar: categories, combinators and a chart parser, as functions of one sentence.

A category is a string (primitive) or a tuple (result, slash, argument).
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\s*([()/\\]|[^\s()/\\]+)")


def parse(text: str):
    """A1: slashes associate to the right where brackets don't say otherwise, as the reference splits at the first one."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        raise ValueError("an empty category")
    at = 0

    def whole():
        nonlocal at
        left = part()
        if at < len(tokens) and tokens[at] in "/\\":
            slash = tokens[at]
            at += 1
            return (left, slash, whole())
        return left

    def part():
        nonlocal at
        if at == len(tokens) or tokens[at] in ")/\\":
            raise ValueError(f"not a category: {text}")
        t = tokens[at]
        at += 1
        if t != "(":
            return t
        inner = whole()
        if at == len(tokens) or tokens[at] != ")":
            raise ValueError(f"a bracket is open: {text}")
        at += 1
        return inner

    out = whole()
    if at != len(tokens):
        raise ValueError(f"not a category: {text}")
    return out


def show(c, inner: bool = False) -> str:
    """Brackets around every functional part."""
    if isinstance(c, str):
        return c
    text = f"{show(c[0], True)}{c[1]}{show(c[2], True)}"
    return f"({text})" if inner else text


def combined(left, right) -> list[tuple[object, str]]:
    """A3: results of two neighbours with the rule's name: application, composition and crossed composition, both ways."""
    out = []
    if isinstance(left, tuple) and left[1] == "/":
        if left[2] == right:
            out.append((left[0], "FA"))
        if isinstance(right, tuple) and left[2] == right[0]:
            out.append(((left[0], right[1], right[2]), "FC" if right[1] == "/" else "FX"))
    if isinstance(right, tuple) and right[1] == "\\":
        if right[2] == left:
            out.append((right[0], "BA"))
        if isinstance(left, tuple) and right[2] == left[0]:
            out.append(((right[0], left[1], left[2]), "BC" if left[1] == "\\" else "BX"))
    return out


def derivations(words: list[str], categories: list[list[str]], longest: int = 20) -> list[str]:
    """A4: lines for the edges over all words, those of category S if there are any. An unknown word is NP and N."""
    n = len(words)
    if not 0 < n <= longest:
        raise ValueError(f"{n} words; from 1 to {longest} can be parsed")
    chart: dict[tuple[int, int], list] = {}
    for i, known in enumerate(categories):
        chart[i, i + 1] = [(parse(c), "Lexical") for c in known or ["NP", "N"]]
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            j = i + size
            chart[i, j] = list(dict.fromkeys(x for k in range(i + 1, j) for a, _ in chart[i, k] for b, _ in chart[k, j] for x in combined(a, b)))
    found = chart[0, n]
    name, kept = ("Parse", [x for x in found if x[0] == "S"])
    if not kept:
        name, kept = "Derivation", found
    return [f"{name} {i}: {show(c)} (rule: {rule})" for i, (c, rule) in enumerate(kept, 1)] or ["No parse found"]

"""Treebank word tokenizer (T12) and the tokenizers built on it, as functions of one text."""

from __future__ import annotations

import re
from collections.abc import Iterable

_PUNCT = re.compile(r"--|''|[()\[\]{}<>:;,?!@]")
_CLITICS = ("n't", "'ll", "'re", "'ve", "'m", "'d", "'s")
_BLANK = re.compile(r"[^ \t\n\r\f\v]+")


def _clitic(word: str) -> tuple[str, str, str] | None:
    """(before, clitic, after) at the last apostrophe."""
    at = word.rfind("'")
    if at < 0:
        return None
    low = word.lower()
    for c in _CLITICS:
        start = at - 1 if c == "n't" else at
        if start > 0 and low.startswith(c, start) and not word[start + len(c) : start + len(c) + 1].isalpha():
            return word[:start], word[start : start + len(c)], word[start + len(c) :]
    if low.startswith("'em", at) and at > 0 and not word[at + 3 : at + 4].isalpha():
        return word[:at], word[at : at + 3], word[at + 3 :]
    return None


def _split(word: str) -> Iterable[str]:
    if not word:
        return
    dots = word.find("...")
    if dots >= 0:
        yield from _split(word[:dots])
        yield "..."
        yield from _split(word[dots + 3 :])
        return
    cut = _clitic(word)
    if cut:
        yield from _split(cut[0])
        yield cut[1]
        yield from _split(cut[2])
        return
    at = 0
    for m in _PUNCT.finditer(word):
        if m.start() > at:
            yield word[at : m.start()]
        yield m[0]
        at = m.end()
    if at < len(word):
        yield word[at:]


def tokens(text: str, known: dict[str, list[str]] | None = None) -> list[str]:
    """known: what words of earlier texts were split into; a word is split once."""
    known = {} if known is None else known
    out: list[str] = []
    for w in _BLANK.findall(text):
        parts = known.get(w)
        if parts is None:
            parts = known[w] = list(_split(w))
        out += parts
    if out and out[-1].endswith(".") and out[-1] not in (".", "..", "..."):
        out[-1:] = [out[-1][:-1], "."]
    return out


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of each token in characters."""
    out, at = [], 0
    for t in tokens(text):
        at = text.index(t, at)
        out.append((at, at + len(t)))
        at += len(t)
    return out


def regexp_spans(text: str, pattern: re.Pattern, gaps: bool = False) -> list[tuple[int, int]]:
    """(start, end) in characters of the matches, or of what lies between them, empty ones left out."""
    if not gaps:
        return [m.span() for m in pattern.finditer(text) if m.end() > m.start()]
    edges = [0, *[x for m in pattern.finditer(text) for x in m.span()], len(text)]
    return [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b > a]


_RUN = re.compile(r"(?:[^\W_]|[.'-])+|\S")


def punkt_spans(text: str, abbreviations: frozenset[str], starters: frozenset[str]) -> list[tuple[int, int]]:
    """A run of letters, digits, dots, dashes and apostrophes that ends in a dot, and each ! or ?, ends a sentence. A known
    abbreviation does so only at the end or before a starter; a run of several dots not before a lower-case letter or an
    ASCII capital."""
    words = list(_RUN.finditer(text))
    out, begin = [], 0
    for i, m in enumerate(words):
        w = m[0]
        if w[-1] not in ".!?":
            continue
        following = words[i + 1][0] if i + 1 < len(words) else None
        if w[-1] == "." and following is not None:
            if w.rstrip(".").lower() in abbreviations:
                if following[0].islower() or following.lower() not in starters:
                    continue
            elif w.count(".") > 1 and (following[0].islower() or "A" <= following[0] <= "Z"):
                continue
        out.append((begin, m.end()))
        begin = m.end()
        while begin < len(text) and text[begin].isspace():
            begin += 1
    end = len(text.rstrip())
    if end > begin:
        out.append((begin, end))
    return out or ([(0, len(text))] if text else [])


def punkt(text: str, abbreviations: frozenset[str], starters: frozenset[str]) -> list[str]:
    return [text[a:b] for a, b in punkt_spans(text, abbreviations, starters)]


_BOUNDARY = re.compile(r"(?<=[.!?])(?=[ \n\"'])\s*")


def sentences(text: str, abbreviations: frozenset[str] | None, starters: frozenset[str] = frozenset()) -> list[str]:
    """With the parameters of a Punkt model, else cut between . ! ? and white space or a quote."""
    if abbreviations is not None:
        return punkt(text, abbreviations, starters)
    return [x for x in _BOUNDARY.split(text) if x.strip()]


def word_tokens(text: str, abbreviations: frozenset[str] | None, starters: frozenset[str], preserve_line: bool, known: dict[str, list[str]] | None = None) -> list[str]:
    """T4: the tokens of each sentence, so that the full stop of each is split off; with preserve_line, of each line."""
    if preserve_line:
        return tokens(text, known)
    return [t for x in sentences(text, abbreviations, starters) for t in tokens(x, known)]


class Mwe:
    """The longest multi-word expression at each place is joined."""

    def __init__(self, expressions: Iterable[Iterable[str]], separator: str = "_"):
        self.root: dict = {}
        self.separator = separator
        for e in expressions:
            node = self.root
            for w in e:
                node = node.setdefault(w, {})
            node[None] = True

    def join(self, words: list[str]) -> list[str]:
        out, i = [], 0
        while i < len(words):
            node, end = self.root, i
            for j in range(i, len(words)):
                node = node.get(words[j])
                if node is None:
                    break
                if None in node:
                    end = j + 1
            end = max(end, i + 1)
            out.append(self.separator.join(words[i:end]))
            i = end
        return out


def s_expressions(text: str, parens: str = "()", strict: bool = True) -> list[str]:
    """Balanced groups at the top level whole, other text cut at white space. Imbalance raises, or ends the last group."""
    left, right = parens
    out, depth, begin = [], 0, 0
    for i, c in enumerate(text):
        if c == left:
            if not depth:
                out += text[begin:i].split()
                begin = i
            depth += 1
        elif c == right:
            if not depth:
                if strict:
                    raise ValueError(f"unmatched {right} at {i}")
                continue
            depth -= 1
            if not depth:
                out.append(text[begin : i + 1])
                begin = i + 1
    if depth and strict:
        raise ValueError(f"unmatched {left} at {begin}")
    return out + ([text[begin:].strip()] if depth else text[begin:].split())

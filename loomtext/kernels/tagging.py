"""Tagging of one sentence: greedy by context tables, Viterbi for TnT and hidden Markov models, averaged perceptron."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Iterable

import numpy as np

NEVER = -1e9


def by_context(entries: list[dict[str, str]], order: int, otherwise: list[str]) -> list[str]:
    """Entries: for each word its tag by the previous predicted tags, joined by tabs, nearest first; otherwise: the tag that
    it gets in an unknown context."""
    before, out = ["<S>"] * (order - 1), []
    for known, default in zip(entries, otherwise):
        tag = known.get("\t".join(before), default)
        out.append(tag)
        before = [tag, *before][: order - 1]
    return out


class Tnt:
    """G9. Transitions by the last two tags: halves of the trigram's and the bigram's estimate, add-1/2 each."""

    def __init__(self, tags: list[str], uni: np.ndarray, bi: np.ndarray, tri: np.ndarray):
        t = len(tags)
        self.tags, self.uni = tags, uni
        start = (uni + 1) / (uni.sum() + t)
        totals = bi.sum(1)
        two = np.where(totals[:, None] > 0, (bi + 0.5) / (0.5 * t + totals[:, None]), start[None, :])
        seen = bi[:, :, None]  # of the two tags before
        three = np.where(seen > 0, 0.5 * (tri + 0.5) / (seen + 0.5 * t) + 0.5 * two[None, :, :], two[None, :, :])
        self.two, self.three = np.log(two), np.log(three)
        self.first, self.last = tags.index("<S>"), tags.index("<E>")
        self.place = {x: i for i, x in enumerate(tags)}
        self.real = np.array([x not in ("<S>", "<E>") for x in tags])

    def emission(self, counts: dict[str, int] | None, known: bool) -> np.ndarray:
        """Log probabilities by tag; a word that its tag lacks has 1e-3 of an occurrence, 1e-4 if its lower-case form is known."""
        n = np.full(len(self.tags), 1e-4 if known else 1e-3)
        for tag, c in (counts or {}).items():
            n[self.place[tag]] = c
        out = np.log(n / np.maximum(self.uni, 1))
        return np.where(self.real & (self.uni > 0), out, NEVER)

    def tag(self, words: list[tuple[dict[str, int] | None, bool]]) -> list[str]:
        return self.path([self.emission(*w) for w in words])

    def path(self, emissions: list[np.ndarray]) -> list[str]:
        t, back = np.arange(len(self.tags)), []
        score = self.two[self.first] + emissions[0]
        before = np.full(len(t), self.first)
        for e in emissions[1:]:
            step = score[:, None] + self.three[before, t]
            best = step.argmax(0)
            score = step[best, t] + e
            back.append(best)
            before = best
        at = int((score + self.two[:, self.last]).argmax())
        path = [at]
        for best in reversed(back):
            at = int(best[at])
            path.append(at)
        return [self.tags[i] for i in reversed(path)]


class Hmm:
    """G10. Transitions that were seen, add-1, all of them from the start; words that a tag lacks have its floor."""

    def __init__(self, tags: list[str], moves: np.ndarray, uses: np.ndarray):
        """moves: counts from (last row: start) to (last column: end); uses: occurrences of each tag."""
        k = len(tags) + 2
        total = moves.sum(1, keepdims=True)
        p = np.log((moves + 1) / (total + k))
        p[:-1] = np.where(moves[:-1] > 0, p[:-1], NEVER)
        self.tags, self.moves, self.uses, self.k = tags, p, uses, k
        self.place = {x: i for i, x in enumerate(tags)}

    def emission(self, counts: dict[str, int] | None) -> np.ndarray:
        n = np.zeros(len(self.tags))
        for tag, c in (counts or {}).items():
            n[self.place[tag]] = c
        out = np.log((n + 1) / (self.uses + self.k))
        return np.where(n > 0, out, NEVER) if counts else out

    def tag(self, words: list[dict[str, int] | None]) -> list[str]:
        return self.path([self.emission(w) for w in words])

    def path(self, emissions: list[np.ndarray]) -> list[str]:
        back, score, moves = [], self.moves[-1, :-1] + emissions[0], self.moves[:-1, :-1]
        for e in emissions[1:]:
            step = score[:, None] + moves
            back.append(step.argmax(0))
            score = step.max(0) + e
        at = int((score + self.moves[:-1, -1]).argmax())
        path = [at]
        for best in reversed(back):
            at = int(best[at])
            path.append(at)
        return [self.tags[i] for i in reversed(path)]


def features(words: list[str], i: int, tags: list[str]) -> list[str]:
    """Of word i after the tags of those before it; what lies outside the sentence has no feature."""
    w = words[i]
    out = ["bias", f"i word {w}", f"i suffix {w[-3:]}", f"i pref1 {w[:1]}"]
    if i > 0:
        out += [f"i-1 tag {tags[-1]}", f"i-1 tag+i word {tags[-1]} {w}", f"i-1 word {words[i - 1]}", f"i-1 suffix {words[i - 1][-3:]}"]
    if i > 1:
        out += [f"i-2 tag {tags[-2]}", f"i tag+i-2 tag {tags[-1]} {tags[-2]}", f"i-2 word {words[i - 2]}"]
    if i + 1 < len(words):
        out += [f"i+1 word {words[i + 1]}", f"i+1 suffix {words[i + 1][-3:]}"]
    if i + 2 < len(words):
        out.append(f"i+2 word {words[i + 2]}")
    return out


class Perceptron:
    """G1. weights: feature -> tag -> weight; tagdict: words that have one tag."""

    def __init__(self, weights: dict[str, dict[str, float]], tagdict: dict[str, str], classes: Iterable[str]):
        self.weights, self.tagdict, self.classes = weights, tagdict, list(classes)

    def guess(self, found: list[str]) -> str:
        scores: dict[str, float] = defaultdict(float)
        for f in found:
            for tag, x in self.weights.get(f, {}).items():
                scores[tag] += x
        best, most = "NN", -math.inf
        for c in self.classes:  # the first of equals
            if scores.get(c, 0.0) > most:
                best, most = c, scores.get(c, 0.0)
        return best

    def tag(self, words: list[str]) -> list[str]:
        tags: list[str] = []
        for i, w in enumerate(words):
            tags.append(self.tagdict.get(w) or self.guess(features(words, i, tags)))
        return tags


def train(sentences: list[list[tuple[str, str]]], rounds: int = 5, seed: int = 1, often: int = 20, sure: float = 0.97) -> Perceptron:
    """The published averaged perceptron; words that occur ``often`` and nearly always with one tag go to the dictionary."""
    counts: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for s in sentences:
        for w, t in s:
            counts[w][t] += 1
    tagdict = {}
    for w, by in counts.items():
        t, n = max(sorted(by.items()), key=lambda x: x[1])
        if sum(by.values()) >= often and n / sum(by.values()) >= sure:
            tagdict[w] = t
    model = Perceptron(defaultdict(dict), tagdict, sorted({t for s in sentences for _, t in s}))
    sums: dict[tuple[str, str], float] = defaultdict(float)
    since: dict[tuple[str, str], int] = defaultdict(int)
    now, order = 0, list(sentences)
    for _ in range(rounds):
        for s in order:
            words, tags = [w for w, _ in s], []
            for i, (w, gold) in enumerate(s):
                tag = tagdict.get(w)
                if tag is None:
                    now += 1
                    found = features(words, i, tags)
                    tag = model.guess(found)
                    if tag != gold:
                        for f in found:
                            for t, step in ((gold, 1.0), (tag, -1.0)):
                                x = model.weights[f].get(t, 0.0)
                                sums[f, t] += (now - since[f, t]) * x
                                since[f, t] = now
                                model.weights[f][t] = x + step
                tags.append(tag)
        random.Random(seed).shuffle(order)
    mean: dict[str, dict[str, float]] = {}
    for f, by in model.weights.items():
        for t, x in by.items():
            value = round((sums[f, t] + (now - since[f, t]) * x) / max(now, 1), 3)
            if value:
                mean.setdefault(f, {})[t] = value
    return Perceptron(mean, tagdict, model.classes)

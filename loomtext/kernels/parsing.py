"""Context-free grammars, trees and chunk grammars, as functions of one sentence."""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass


@dataclass(frozen=True)
class Grammar:
    """P1, P2. Productions as (left, right); terminals are right-hand symbols in quotes."""

    start: str
    productions: tuple[tuple[str, tuple[tuple[str, bool], ...]], ...]

    @classmethod
    def parse(cls, text: str) -> Grammar:
        """Lines ``A -> B 'c' | D``; the first left side is the start. Empty alternatives are left out."""
        out = []
        for line in text.splitlines():
            line = line.split("#")[0].strip()
            if not line:
                continue
            left, arrow, right = line.partition("->")
            if not arrow or not left.strip():
                raise ValueError(f"not a production: {line}")
            for part in right.split("|"):
                symbols = tuple((q or d or n, bool(q or d)) for q, d, n in re.findall(r"'([^']*)'|\"([^\"]*)\"|(\S+)", part))
                if symbols:
                    out.append((left.strip(), symbols))
        if not out:
            raise ValueError("a grammar needs a production")
        return cls(out[0][0], tuple(out))

    def trees(self, words: list[str], most: int | None = None) -> list[str]:
        """All trees of the words as bracket strings, of a span at most ``most`` if that is given; none if there is no parse.

        Spans are parsed once each. A unit cycle (A to B to A) is followed once round.
        """
        words, by_left = tuple(words), {}
        for left, right in self.productions:
            by_left.setdefault(left, []).append(right)
        active: set = set()
        known: dict = {}
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 1000 + 30 * len(words)))

        def sequence(right: tuple, i: int, j: int) -> tuple[str, ...]:
            if (right, i, j) not in known:
                known[right, i, j] = parsed(right, i, j)
            return known[right, i, j]

        def parsed(right: tuple, i: int, j: int) -> tuple[str, ...]:
            (name, terminal), rest = right[0], right[1:]
            out = []
            for k in range(i + 1, j - len(rest) + 1) if rest else [j]:
                heads = ((name,) if k == i + 1 and words[i] == name else ()) if terminal else span(name, i, k)
                if heads:
                    tails = sequence(rest, k, j) if rest else ("",)
                    out += [f"{h} {t}".rstrip() for h in heads for t in tails]
            return tuple(out[:most])

        def span(name: str, i: int, j: int) -> tuple[str, ...]:
            if (name, i, j) in active:
                return ()
            active.add((name, i, j))
            out = [f"({name} {x})" for right in by_left.get(name, ()) if len(right) <= j - i for x in sequence(right, i, j)]
            active.discard((name, i, j))
            return tuple(out[:most])

        return list(dict.fromkeys(span(self.start, 0, len(words)))) if words else []


    def nonterminals(self) -> list[str]:
        """Left sides, and right-hand symbols that are no terminals, sorted."""
        return sorted({left for left, _ in self.productions} | {n for _, right in self.productions for n, terminal in right if not terminal})

    def __len__(self) -> int:
        return len(self.productions)

    def __str__(self) -> str:
        return "\n".join(f"{left} -> {' '.join(f"'{n}'" if terminal else n for n, terminal in right)}" for left, right in self.productions)


def text_of(rows: list[dict]) -> list[str]:
    """The bracket string of each node's subtree, in pre-order; a leaf is its label."""
    out = [""] * len(rows)
    below: dict[int, list[str]] = {}
    for r in reversed(rows):
        inner = below.pop(r["node"], [])[::-1]
        out[r["node"]] = r["label"] if r["leaf"] else f"({' '.join([r['label'], *inner])})"
        below.setdefault(r["parent"], []).append(out[r["node"]])
    return out


def positions(rows: list[dict]) -> list[list[int]]:
    """Y2: each node's place as child indexes from the root."""
    out: list[list[int]] = []
    for r in rows:
        out.append([*out[r["parent"]], r["child"]] if r["parent"] >= 0 else [])
    return out


def productions(rows: list[dict]) -> list[str]:
    """In pre-order, leaves in quotes; nodes without children have none."""
    children: dict[int, list[str]] = {}
    for r in rows:
        children.setdefault(r["parent"], []).append(f"'{r['label']}'" if r["leaf"] else r["label"])
    return [f"{r['label']} -> {' '.join(children[r['node']])}" for r in rows if r["node"] in children]


def iob_tree(tokens: list[dict], tags: list[str], root: str = "S") -> str:
    """Tokens (word, tag) and their IOB tags as a bracket string: word/tag leaves, those of a chunk under its label."""
    out, inside = [f"({root}"], None
    for t, iob in zip(tokens, tags):
        head, _, label = iob.partition("-")
        if inside is not None and (head != "I" or label != inside):
            out[-1] += ")"
            inside = None
        if head in ("B", "I") and inside is None:
            out.append(f"({label}")
            inside = label
        out.append(f"{t['word']}/{t['tag']}")
    if inside is not None:
        out[-1] += ")"
    return " ".join(out) + ")"


def tree_iob(tree: str) -> list[dict]:
    """Word, tag and IOB tag of each leaf word/tag of a chunk tree."""
    rows = nodes(tree)
    out = []
    for r in rows:
        if r["leaf"]:
            word, _, tag = r["label"].rpartition("/")
            up = rows[r["parent"]]
            iob = "O" if up["parent"] < 0 else ("B-" if r["child"] == 0 else "I-") + up["label"]
            out.append({"word": word, "tag": tag, "iob": iob})
    return out


def nodes(tree: str) -> list[dict]:
    """The nodes of a bracket string in pre-order. Errors: no bracket, no label, brackets left open."""
    out: list[dict] = []
    stack: list[int] = []
    count: list[int] = []
    tokens = re.findall(r"[()]|[^\s()]+", tree)
    if not tokens or tokens[0] != "(":
        raise ValueError("a tree begins with a bracket")
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t == ")":
            stack.pop()
            if not stack:
                return out
        else:
            leaf = t != "("
            if not leaf:
                i += 1
                if i == len(tokens) or tokens[i] in "()":
                    raise ValueError("a node needs a label")
            parent = stack[-1] if stack else -1
            out.append({"node": len(out), "parent": parent, "child": count[parent] if stack else 0, "label": tokens[i], "leaf": leaf})
            count.append(0)
            if stack:
                count[parent] += 1
            if not leaf:
                stack.append(len(out) - 1)
        i += 1
    raise ValueError("a bracket is open")


def chunk_rules(grammar: str) -> list[tuple[str, re.Pattern]]:
    """Lines ``LABEL: {<tag>...}``; inside the angles . * ? | are as in a pattern, quantifiers may follow an angle."""
    out = []
    for line in grammar.splitlines():
        line = line.split("#")[0].strip()
        if not line:
            continue
        m = re.fullmatch(r"(\S+)\s*:\s*\{(.*)\}", line)
        if not m:
            raise ValueError(f"not a chunk rule: {line}")
        inner = re.sub(r"<([^>]*)>", lambda t: "(?:<(?:" + re.sub(r"[^\w.*?|]", lambda c: re.escape(c[0]), t[1]).replace(".", "[^<>]") + ")>)", re.sub(r"\s+", "", m[2]))
        out.append((m[1], re.compile(inner)))
    return out


def chunk(tokens: list[dict], rules: list[tuple[str, re.Pattern]]) -> list[str]:
    """IOB tags; matches go left to right, later rules take what is free."""
    return chunk_tags([t["tag"] for t in tokens], rules)


def chunk_tags(tags: list[str], rules: list[tuple[str, re.Pattern]]) -> list[str]:
    """``chunk`` by the tags alone."""
    text = "".join(f"<{t}>" for t in tags)
    ends, at = {0: 0}, 0
    for i, t in enumerate(tags):
        at += len(f"<{t}>")
        ends[at] = i + 1
    out = ["O"] * len(tags)
    for label, rule in rules:
        for m in rule.finditer(text):
            if m.start() in ends and m.end() in ends and m.end() > m.start():
                a, b = ends[m.start()], ends[m.end()]
                if all(x == "O" for x in out[a:b]):
                    out[a:b] = [f"B-{label}"] + [f"I-{label}"] * (b - a - 1)
    return out

"""Arrow functions around the kernels: batches of texts in, lists or numbers out. NULL in, NULL out."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.kernels import ccg, logic, parsing, strings, texttiling, treebank

_STRINGS = T.ArrayType(T.StringType())


#: Bytes of a batch's columns that are Python objects at once, with what is made of them: a batch is some thousand rows, however long.
SLICE = 1 << 20
#: Words whose tokens are kept.
KNOWN = 100_000


def _by_slices(f: Callable, arrow_type: pa.DataType, *columns: pa.Array) -> pa.Array:
    """f of each row, null where a column is null."""
    n = len(columns[0])
    step = max(1, n * SLICE // max(1, sum(c.nbytes for c in columns)))
    parts = []
    for i in range(0, n, step):
        rows = zip(*(c.slice(i, step).to_pylist() for c in columns))
        parts.append(pa.array([None if any(x is None for x in r) else f(*r) for r in rows], arrow_type))
    return pa.concat_arrays(parts) if parts else pa.array([], arrow_type)


def _mapped(f: Callable, spark_type: T.DataType, arrow_type: pa.DataType) -> Callable[..., Column]:
    def call(*columns: pa.Array) -> pa.Array:
        return _by_slices(f, arrow_type, *columns)

    if f.__code__.co_argcount - len(f.__defaults__ or ()) <= 1:

        @F.arrow_udf(spark_type)
        def one(a: pa.Array) -> pa.Array:
            return call(a)

        return one

    @F.arrow_udf(spark_type)
    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return call(a, b)

    return two


def _distinct(f: Callable, spark_type: T.DataType, arrow_type: pa.DataType) -> Callable[[Column], Column]:
    """As ``_mapped`` of one column; each distinct value of a batch is computed once."""

    @F.arrow_udf(spark_type)
    def one(a: pa.Array) -> pa.Array:
        coded = a.dictionary_encode()
        values = pa.array([f(x) for x in coded.dictionary.to_pylist()], arrow_type)
        return values.take(coded.indices)

    return one


def treebank_tokens(text: Column, preserve_line: bool = False) -> Column:
    """Of the whole text, or with preserve_line of each of its lines."""

    @F.arrow_udf(_STRINGS)
    def run(texts: pa.Array) -> pa.Array:
        known: dict = {}

        def split(x: str) -> list[str]:
            if len(known) > KNOWN:
                known.clear()
            return [t for line in x.split("\n") for t in treebank.tokens(line, known)] if preserve_line else treebank.tokens(x, known)

        return _by_slices(split, pa.list_(pa.string()), texts)

    return run(text)


def punkt_sentences(text: Column, abbreviations: Iterable[str] | None, starters: Iterable[str] = ()) -> Column:
    """Without abbreviations (no model) as T10."""
    a, s = None if abbreviations is None else frozenset(abbreviations), frozenset(starters)
    return _mapped(lambda x: treebank.sentences(x, a, s), _STRINGS, pa.list_(pa.string()))(text)


sent_tokenize = punkt_sentences


def word_tokenize(text: Column, abbreviations: Iterable[str] | None = None, starters: Iterable[str] = (), preserve_line: bool = False) -> Column:
    """T4: sentences, then the treebank tokens of each."""
    a, s = None if abbreviations is None else frozenset(abbreviations), frozenset(starters)

    @F.arrow_udf(_STRINGS)
    def run(texts: pa.Array) -> pa.Array:
        known: dict = {}

        def split(x: str) -> list[str]:
            if len(known) > KNOWN:
                known.clear()
            return treebank.word_tokens(x, a, s, preserve_line, known)

        return _by_slices(split, pa.list_(pa.string()), texts)

    return run(text)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def spans(text: Column, pattern: str, gaps: bool = False) -> Column:
    """D3: (start, end) in characters of a pattern's matches, or of what lies between them."""
    rx = re.compile(pattern)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return _mapped(lambda x: [{"start": a, "end": b} for a, b in treebank.regexp_spans(x, rx, gaps)], _SPANS, kind)(text)


def treebank_spans(text: Column) -> Column:
    """T12's span_tokenize, in characters."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return _mapped(lambda x: [{"start": a, "end": b} for a, b in treebank.spans(x)], _SPANS, kind)(text)


def text_tiles(text: Column, w: int = 20, k: int = 10, demo: bool = False) -> Column:
    """struct(segments, scores, depths, boundaries)."""
    kind = pa.struct([("segments", pa.list_(pa.string())), ("scores", pa.list_(pa.float64())), ("depths", pa.list_(pa.float64())), ("boundaries", pa.list_(pa.int32()))])
    spark = T.StructType([T.StructField("segments", _STRINGS), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("depths", T.ArrayType(T.DoubleType())), T.StructField("boundaries", T.ArrayType(T.IntegerType()))])
    return _mapped(lambda x: dict(zip(("segments", "scores", "depths", "boundaries"), texttiling.tile(x, w, k, demo))), spark, kind)(text)


def mwe_tokens(tokens: Column, expressions: Iterable[Iterable[str]], separator: str = "_") -> Column:
    """T19."""
    m = treebank.Mwe(expressions, separator)
    return _mapped(lambda x: m.join(x), _STRINGS, pa.list_(pa.string()))(tokens)


def s_expressions(text: Column, parens: str = "()", strict: bool = True) -> Column:
    """T20."""
    return _mapped(lambda x: treebank.s_expressions(x, parens, strict), _STRINGS, pa.list_(pa.string()))(text)


def edit_distance(a: Column, b: Column, substitution: int = 1, transpositions: bool = False) -> Column:
    """H1 with costs."""
    return _mapped(lambda x, y: strings.edit_distance(x, y, substitution, transpositions), T.IntegerType(), pa.int32())(a, b)


def jaro_similarity(a: Column, b: Column) -> Column:
    """H2."""
    return _mapped(strings.jaro, T.DoubleType(), pa.float64())(a, b)


def jaro_winkler_similarity(a: Column, b: Column, p: float = 0.1, most: int = 4) -> Column:
    """H3."""
    return _mapped(lambda x, y: strings.jaro_winkler(x, y, p, most), T.DoubleType(), pa.float64())(a, b)


def parses(tokens: Column, grammar: str) -> Column:
    """All trees of a token array under a context-free grammar, as bracket strings."""
    g = parsing.Grammar.parse(grammar)
    return _mapped(lambda x: g.trees(x), _STRINGS, pa.list_(pa.string()))(tokens)


_NODE = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("child", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("leaf", T.BooleanType())])


def tree_nodes(tree: Column) -> Column:
    """A bracket string's nodes in pre-order; the root's parent is -1."""
    kind = pa.list_(pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("child", pa.int32()), ("label", pa.string()), ("leaf", pa.bool_())]))
    return _mapped(lambda x: parsing.nodes(x), T.ArrayType(_NODE), kind)(tree)


def chunks(tokens: Column, grammar: str) -> Column:
    """IOB tags of an array of (word, tag) structs under lines of LABEL: {<tag>...}."""
    rules = parsing.chunk_rules(grammar)
    return _mapped(lambda x: parsing.chunk_tags(x, rules), _STRINGS, pa.list_(pa.string()))(tokens["tag"])  # words aren't sent


# ---------------------------------------------------------------- trees


def tree_texts(tree: Column) -> Column:
    """The bracket strings of all subtrees and leaves, in pre-order; each tree is its own first one."""
    return _mapped(lambda x: parsing.text_of(parsing.nodes(x)), _STRINGS, pa.list_(pa.string()))(tree)


def tree_productions(tree: Column) -> Column:
    """Y3."""
    return _mapped(lambda x: parsing.productions(parsing.nodes(x)), _STRINGS, pa.list_(pa.string()))(tree)


def tree_positions(tree: Column) -> Column:
    """Y2: each node's place as child indexes from the root, in pre-order."""
    return _mapped(lambda x: parsing.positions(parsing.nodes(x)), T.ArrayType(T.ArrayType(T.IntegerType())), pa.list_(pa.list_(pa.int32())))(tree)


def iob_tree(tokens: Column, iob: Column) -> Column:
    """An array of (word, tag) and one of IOB tags as a bracket string."""
    return _mapped(lambda x, y: parsing.iob_tree(x, y), T.StringType(), pa.string())(tokens, iob)


def tree_iob(tree: Column) -> Column:
    """Array of (word, tag, iob)."""
    names = ("word", "tag", "iob")
    spark = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return _mapped(lambda x: parsing.tree_iob(x), spark, pa.list_(pa.struct([(n, pa.string()) for n in names])))(tree)


# ---------------------------------------------------------------- semantics, discourse, inference, categorial grammar


def _or_null(f: Callable) -> Callable:
    """Values that can't be read give null."""

    def run(*args):
        try:
            return f(*args)
        except ValueError:
            return None

    return run


def _one(f: Callable, strict: bool) -> Callable[[str], str | None]:
    g = f if strict else _or_null(f)
    return lambda x: g(x)


def canonical_formula(text: Column, strict: bool = False) -> Column:
    """A formula in canonical form; what can't be parsed is null, or raises if strict."""
    return _mapped(_one(lambda x: logic.show(logic.parse(x)), strict), T.StringType(), pa.string())(text)


def simplified_formula(text: Column, strict: bool = False) -> Column:
    """E2."""
    return _mapped(_one(lambda x: logic.show(logic.simplify(logic.parse(x))), strict), T.StringType(), pa.string())(text)


def free_variables(text: Column, strict: bool = False) -> Column:
    """E3."""
    return _mapped(_one(lambda x: logic.free(logic.parse(x)), strict), _STRINGS, pa.list_(pa.string()))(text)


def formula_holds(text: Column, model: Column, strict: bool = False) -> Column:
    """Model: a JSON object of valuation (predicate -> tuples), domain, assignment."""

    def run(formula: str, model: str) -> bool:
        m = json.loads(model)
        return logic.evaluate(logic.parse(formula), m.get("valuation", {}), m.get("domain", []), m.get("assignment", {}))

    g = run if strict else _or_null(run)
    return _mapped(lambda x, y: g(x, y), T.BooleanType(), pa.bool_())(text, model)


def canonical_drs(text: Column, strict: bool = False) -> Column:
    """E6."""
    return _mapped(_one(lambda x: logic.show_drs(logic.parse_drs(x)), strict), T.StringType(), pa.string())(text)


def drs_formula(text: Column, strict: bool = False) -> Column:
    """E7."""
    return _mapped(_one(lambda x: logic.show(logic.drs_to_fol(logic.parse_drs(x))), strict), T.StringType(), pa.string())(text)


def merged_drs(structures: Column) -> Column:
    """An array of structures, in order, as one."""
    return _mapped(_one(lambda x: logic.show_drs(logic.merged([logic.parse_drs(d) for d in x])), False), T.StringType(), pa.string())(structures)


def merged_and_formula(structures: Column) -> Column:
    """struct(merged, fol) as ``merged_drs`` and ``drs_formula`` of it have them. A structure is parsed once, what is merged
    isn't parsed again."""
    known: dict = {}

    def parsed(text: str):
        if text not in known:
            if len(known) > KNOWN:
                known.clear()
            known[text] = logic.parse_drs(text)
        return known[text]

    def run(texts: list[str]) -> dict[str, str]:
        d = logic.merged([parsed(x) for x in texts])
        return {"merged": logic.show_drs(d), "fol": logic.show(logic.drs_to_fol(d))}

    g = _or_null(run)
    names = ("merged", "fol")
    return _mapped(lambda x: g(x), T.StructType([T.StructField(n, T.StringType()) for n in names]), pa.struct([(n, pa.string()) for n in names]))(structures)


def discourse_answer(structures: Column, question: str, valuation: dict, domain: list[str]) -> Column:
    """True, false or unknown."""
    asked = logic.parse_drs(question)
    return _mapped(_one(lambda x: logic.answer([logic.parse_drs(d) for d in x], asked, valuation, domain), False), T.StringType(), pa.string())(structures)


def proved(goal: Column, assumptions: Column, method: str = "tableau", most: int | None = None) -> Column:
    """Whether an array of assumptions proves the goal; most: steps of the tableau (200), clauses of resolution (1000).
    A goal that can't be parsed gives null, assumptions that can't are left out."""
    f = {"tableau": lambda g, a: logic.tableau(g, a, most or 200), "resolution": lambda g, a: logic.resolution(g, a, most or 1000)}[method]
    g = _or_null(f)
    return _mapped(lambda x, y: g(x, y), T.BooleanType(), pa.bool_())(goal, assumptions)


def default_extensions(facts: Column, rules: Iterable[tuple[str, str, str, str]], most: int = 10) -> Column:
    """An array of facts with what default rules (prerequisite, justification, consequent, name) add."""
    rules = list(rules)
    return _mapped(lambda x: logic.extensions(x, rules, most), _STRINGS, pa.list_(pa.string()))(facts)


def canonical_category(text: Column, strict: bool = False) -> Column:
    """A1."""
    return _mapped(_one(lambda x: ccg.show(ccg.parse(x)), strict), T.StringType(), pa.string())(text)


def ccg_derivations(words: Column, categories: Column, longest: int = 20) -> Column:
    """A4: lines of derivations; categories: for each word an array of its categories, empty if it is unknown. Sentences that are empty
    or longer give null."""
    g = _or_null(ccg.derivations)
    return _mapped(lambda x, y: g(x, y, longest), _STRINGS, pa.list_(pa.string()))(words, categories)

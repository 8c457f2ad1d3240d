"""Trees, chunk trees, categorial grammar, formulas, discourse, inference: golden values, and provers against truth tables."""

import itertools
import random

import pytest

from pyspark.sql import functions as F

from loomtext.functions import arrow
from loomtext.kernels import ccg, logic, parsing


def canon(text):
    return logic.show(logic.parse(text))


@pytest.mark.parametrize(("text", "want"), [
    ("exists x.(man(x) & walk(x))", "exists x.(man(x) & walk(x))"), ("\\x.\\y.see(x,y)", "\\x.\\y.(see(x))(y)"), ("P ^ Q | R <-> S", "(((P & Q) | R) <-> S)"), ("a => b -> c", "((a -> b) -> c)"),
    ("all x.man(x) -> q", "all x.(man(x) -> q)"), ("--p", "--p"), ("lambda x.p(x)", "\\x.p(x)"), ("x = y & p", "((x = y) & p)"), ("E x.A y.r(x, y)", "exists x.all y.(r(x))(y)"),
])
def test_canonical_forms(text, want):
    assert canon(text) == want and canon(want) == want


def test_formulas():
    for bad in ("", "p &", "(p", "p q)", "exists .p", "1"):
        with pytest.raises(ValueError):
            logic.parse(bad)
    s = lambda t: logic.show(logic.simplify(logic.parse(t)))
    assert s("(\\x.\\y.see(x,y))(j)(m)") == "(see(j))(m)"
    assert s("(\\x.\\y.see(x,y))(y)") == "\\y1.(see(y))(y1)"  # no capture
    assert s("(\\P.exists x.P(x))(\\y.dog(y))") == "exists x.dog(x)"
    with pytest.raises(ValueError):
        s("(\\x.x(x))(\\x.x(x))")
    assert logic.free(logic.parse("exists x.(p(x) & q(y)) & r(z, y)")) == ["p", "q", "y", "r", "z"]
    v, d = {"man": [["a"], ["b"]], "loves": [["a", "b"]]}, ["a", "b", "c"]
    holds = lambda t, g=None: logic.evaluate(logic.parse(t), v, d, g or {})
    assert holds("exists x.man(x)") and not holds("all x.man(x)") and holds("all x.(man(x) -> -(x = c))") and holds("man(x)", {"x": "a"}) and holds("exists x.loves(x, b)")
    with pytest.raises(ValueError):
        holds("\\x.man(x)")
    with pytest.raises(ValueError):
        holds("man(nobody)")


def test_discourse():
    text = "([x,y],[man(x), x = y, -([z],[dog(z)]), (([u],[a(u)]) => ([],[b(u)]))])"
    assert logic.show_drs(logic.parse_drs(text)) == text == logic.show_drs(logic.parse_drs(text.replace(",", " , ")))
    assert logic.show(logic.drs_to_fol(logic.parse_drs("([é],[man(é), -([z],[dog(z)])])"))) == "exists é.(man(é) & -exists z.dog(z))"
    assert logic.show(logic.drs_to_fol(logic.parse_drs("([x],[])"))) == "true"
    a, b = logic.parse_drs("([x],[p(x)])"), logic.parse_drs("([x,y],[q(y)])")
    assert logic.show_drs(logic.merged([a, b])) == "([x,y],[p(x), q(y)])"
    model = {"p": [["a"]], "q": [["a"]]}
    assert logic.answer([a], b, model, ["a"]) == "true" and logic.answer([a], b, {"p": [["a"]]}, ["a"]) == "false"
    assert logic.answer([a], logic.parse_drs("([],[r(w)])"), model, ["a"]) == "unknown"
    for bad in ("", "([x]", "([x],[p(])", "([x],[p(x)]) y"):
        with pytest.raises(ValueError):
            logic.parse_drs(bad)


def random_formula(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice("pqr")
    kind = rng.choice(["not", "and", "or", "if", "iff"])
    a, b = random_formula(rng, depth - 1), random_formula(rng, depth - 1)
    return f"-{a}" if kind == "not" else f"({a} {logic._PRINTED[kind]} {b})"


def true(x, world):
    if x[0] == "name":
        return world[x[1]]
    if x[0] == "not":
        return not true(x[1], world)
    a, b = true(x[1], world), true(x[2], world)
    return {"and": a and b, "or": a or b, "if": not a or b, "iff": a == b}[x[0]]


def test_provers_against_truth_tables():
    rng = random.Random(3)
    worlds = [dict(zip("pqr", bits)) for bits in itertools.product([False, True], repeat=3)]
    for _ in range(150):
        goal, assumed = random_formula(rng, 3), [random_formula(rng, 2) for _ in range(rng.randint(0, 2))]
        follows = all(true(logic.parse(goal), w) for w in worlds if all(true(logic.parse(a), w) for a in assumed))
        assert logic.tableau(goal, assumed, 5000) == follows, (goal, assumed)
        assert logic.resolution(goal, assumed, 5000) == follows, (goal, assumed)


def test_quantified_proofs():
    rules = ["all x.(man(x) -> mortal(x))", "man(socrates)"]
    assert logic.tableau("mortal(socrates)", rules) and not logic.tableau("mortal(zeus)", rules)
    assert logic.tableau("exists x.p(x)", ["p(a)"]) and logic.tableau("-exists x.-p(x)", ["all x.p(x)"]) and not logic.tableau("all x.p(x)", ["p(a)"])
    with pytest.raises(ValueError):
        logic.tableau("(", [])
    assert logic.tableau("p", ["p", "not ( a formula"])


def test_defaults():
    rules = [("bird", "flies", "flies", ""), ("flies", "light", "light", ""), ("", "x", "x", "")]
    assert logic.extensions(["bird"], rules) == ["bird", "flies", "light", "x"]
    assert logic.extensions(["bird", "~flies"], rules) == ["bird", "x", "~flies"]
    assert logic.extensions(["bird"], rules, 1) == ["bird", "flies", "x"]


def test_categories():
    for text in ("S", "NP/N", "(S\\NP)/NP", "S\\(NP/N)"):
        assert ccg.show(ccg.parse(text)) == text
    assert ccg.parse("S/NP/N") == ("S", "/", ("NP", "/", "N"))
    for bad in ("", "(", "S/", "/S", "S)"):
        with pytest.raises(ValueError):
            ccg.parse(bad)
    assert ccg.derivations(["I", "see", "you"], [["NP"], ["(S\\NP)/NP"], ["NP"]]) == ["Parse 1: S (rule: BA)"]
    assert ccg.derivations(["the", "dog"], [["NP/N"], ["N"]]) == ["Derivation 1: NP (rule: FA)"]
    assert ccg.derivations(["new", "dog"], [[], ["N"]]) == ["No parse found"]
    assert ccg.combined(ccg.parse("S/NP"), ccg.parse("NP/N")) == [(("S", "/", "N"), "FC")]
    for words in ([], ["w"] * 21):
        with pytest.raises(ValueError):
            ccg.derivations(words, [[] for _ in words])


def test_tree_parts():
    tree = "(S (NP (D the) (N dog)) (VP (V ran)))"
    rows = parsing.nodes(tree)
    assert parsing.text_of(rows)[0] == tree and parsing.text_of(rows)[1] == "(NP (D the) (N dog))" and parsing.text_of(rows)[3] == "the"
    assert parsing.productions(rows) == ["S -> NP VP", "NP -> D N", "D -> 'the'", "N -> 'dog'", "VP -> V", "V -> 'ran'"]
    assert parsing.positions(rows)[:4] == [[], [0], [0, 0], [0, 0, 0]]
    tokens = [{"word": w, "tag": t} for w, t in (("the", "DT"), ("cat", "NN"), ("ran", "VB"))]
    assert parsing.iob_tree(tokens, ["B-NP", "I-NP", "O"]) == "(S (NP the/DT cat/NN) ran/VB)"
    assert [x["iob"] for x in parsing.tree_iob("(S (NP the/DT cat/NN) ran/VB)")] == ["B-NP", "I-NP", "O"]


def test_grammars():
    g = parsing.Grammar.parse("S -> 'a' S | 'a'")
    assert len(g.trees(["a"] * 400)) == 1 and g.nonterminals() == ["S"] and len(g) == 2 and str(g) == "S -> 'a' S\nS -> 'a'"


def test_threads_are_parsed_once(spark):
    """What is merged isn't parsed again; a structure that can't be read leaves both null."""
    rows = [(["([x],[p(x)])", "([x, y],[-([z],[q(z)]), x = y, (([a],[r(a)]) => ([],[s(a)]))])", "([x],[p(x)])"],), (["([],[])"],), (["(["],), (None,)]
    df = spark.createDataFrame(rows, "d array<string>")
    got = df.select(arrow.merged_and_formula(F.col("d")).alias("m"), arrow.merged_drs(F.col("d")).alias("merged")).select("m", "merged", arrow.drs_formula(F.col("merged")).alias("fol")).collect()
    assert [(r.m and r.m.merged, r.m and r.m.fol) for r in got] == [(r.merged, r.fol) for r in got] and got[0].merged and got[2].m is None

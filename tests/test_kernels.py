import pytest

from loomtext.functions.stemmers import porter_word
from loomtext.kernels import parsing, strings, treebank


@pytest.mark.parametrize(("word", "stem"), [
    ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
    ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adjustable", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("running", "run"),
])
def test_porter(word, stem):
    assert porter_word(word) == stem


def test_treebank():
    assert treebank.tokens("They can't, won't... say 'hi' (now)!") == ["They", "ca", "n't", ",", "wo", "n't", "...", "say", "'hi'", "(", "now", ")", "!"]
    assert treebank.tokens("U.S. ends here.") == ["U.S.", "ends", "here", "."]
    text = "We'll go, ok?"
    assert [text[a:b] for a, b in treebank.spans(text)] == treebank.tokens(text)
    assert treebank.tokens("") == []


def test_punkt():
    a, s = frozenset({"dr", "u.s"}), frozenset({"the", "he"})
    assert treebank.punkt("Dr. Smith went home. He ate dinner.", a, s) == ["Dr. Smith went home.", "He ate dinner."]
    assert treebank.punkt("", a, s) == []


def test_mwe():
    m = treebank.Mwe([["a", "little"], ["a", "little", "bit"], ["a", "lot"], ["in", "spite", "of"]])
    assert m.join("In a little or a little bit or a lot in spite of".split()) == ["In", "a_little", "or", "a_little_bit", "or", "a_lot", "in_spite_of"]


def test_s_expressions():
    assert treebank.s_expressions("x (a (b) c) y z (d)") == ["x", "(a (b) c)", "y", "z", "(d)"]
    with pytest.raises(ValueError):
        treebank.s_expressions("(a")
    assert treebank.s_expressions("(a b", strict=False) == ["(a b"]


def test_distances():
    assert strings.edit_distance("kitten", "sitting") == 3
    assert strings.edit_distance("abcd", "acbd", transpositions=True) == 1
    assert strings.edit_distance("", "abc") == 3 and strings.edit_distance("ca", "abc", transpositions=True) == 3
    assert strings.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert strings.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert strings.jaro("", "") == 1 and strings.jaro("a", "") == 0


def test_parsing():
    g = parsing.Grammar.parse("S -> NP VP\nNP -> Det N\nVP -> V\nDet -> 'the'\nN -> 'cat'\nV -> 'runs'")
    assert g.trees("the cat runs".split()) == ["(S (NP (Det the) (N cat)) (VP (V runs)))"]
    assert g.trees(["dog"]) == [] and g.trees([]) == []
    two = parsing.Grammar.parse("S -> S S | 'a'")
    assert len(two.trees(["a"] * 4)) == 5
    with pytest.raises(ValueError):
        parsing.Grammar.parse("nothing")


def test_trees():
    n = parsing.nodes("(S (NP I) (VP (V saw) (NP him)))")
    assert [(x["label"], x["parent"], x["leaf"]) for x in n] == [("S", -1, False), ("NP", 0, False), ("I", 1, True), ("VP", 0, False), ("V", 3, False), ("saw", 4, True), ("NP", 3, False), ("him", 6, True)]
    for bad in ("", "x", "(", "(S (NP", "()"):
        with pytest.raises(ValueError):
            parsing.nodes(bad)


def test_chunks():
    rules = parsing.chunk_rules("NP: {<DT>?<JJ>*<NN.*>}")
    tags = [{"tag": t} for t in ["DT", "JJ", "NNS", "VB", "NN"]]
    assert parsing.chunk(tags, rules) == ["B-NP", "I-NP", "I-NP", "O", "B-NP"]

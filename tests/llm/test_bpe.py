import base64

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.RANKS, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return bpe.Vocabulary(ranks)


@pytest.fixture(scope="module")
def other(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def both(vocabulary, other, texts):
    ids, bounds, same = bpe.encode_texts(vocabulary, pa.array(texts, pa.string()))
    assert same.all()
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == other.encode_ordinary(t), t


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 's'trelvmd\n\t é中1!٣😀 ́²"), max_size=30), max_size=8))
def test_equals_the_library(vocabulary, other, texts):
    both(vocabulary, other, texts)


def test_overlaps_and_long_texts(vocabulary, other):
    both(vocabulary, other, ["a" * 1000, "ab" * 500, "aaaa" * 7 + " aaab", "", " ", "  x", "x  ", "don't we'll '' 's \n's", "the quick brown fox " * 20_000])


def test_brute_force_merges(vocabulary, ranks):
    """One merge at a time, the lowest rank first."""
    for word in [b"understanding", b" tokenization", "naïveté".encode(), b"zzzzzzzz", b"abracadabra"]:
        parts = [bytes([b]) for b in word]
        while True:
            found = [(ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1)]
            if not found or min(found)[0] == 1 << 40:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        import numpy as np

        ids, _ = vocabulary.encode_words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        assert ids.tolist() == [ranks[p] for p in parts]


def test_cases(make_docs, clashing):
    texts = [None, "", "hello world", "hello world", "<|endoftext|>", "x" * 200_000]
    rows = bpe.decode(bpe.encode(clashing(make_docs(texts), "ids"))).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == texts
    assert rows[0].ids is None and rows[0].n_tokens is None and rows[1].ids == [] and rows[2].ids == rows[3].ids
    assert all(r.round_trip for r in rows[1:]) and rows[0].ids_in == "x" and rows[2].n_tokens == 2
    assert bpe.encode(make_docs([])).collect() == []


def test_memory_of_merges(vocabulary):
    """The merges' arrays take a bounded number of bytes for each byte of distinct words."""
    import random
    import tracemalloc

    import numpy as np

    rng = random.Random(1)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(10)).encode() for _ in range(120_000)]
    data, starts = np.frombuffer(b"".join(words), np.uint8), np.arange(0, 10 * len(words) + 1, 10)
    tracemalloc.start()
    ids, _ = vocabulary.encode_words(data, starts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert vocabulary.decode(ids)[0].tobytes() == data.tobytes() and peak < 45 * len(data)

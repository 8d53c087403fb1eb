"""Vectorised words and shingles against regular expressions."""
import random
import re

import pyarrow as pa

from fixtures import EDGES, prose
from squall.llm.words import distinct, pieces, shingles, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", (text or "").translate(LOWER))


def test_words_are_those_of_the_pattern_and_equal_words_have_equal_hashes():
    r = random.Random(1)
    texts = [*EDGES, *(prose(r, r.randint(0, 60)).title() for _ in range(50))]
    w = words(pa.array(texts, pa.string()))
    of_hash, of_word = {}, {}
    for i, text in enumerate(texts):
        own = w.hashes[w.first[i]:w.first[i + 1]].tolist()
        assert len(own) == len(plain(text))
        for h, x in zip(own, plain(text), strict=True):
            assert of_hash.setdefault(h, x) == x and of_word.setdefault(x, h) == h


def test_shingles_count_like_tuples_of_words():
    r = random.Random(2)
    texts = [None, "", "one", "one two", "one two three", "one two three four", *(prose(r, 30) for _ in range(20))]
    w = words(pa.array(texts, pa.string()))
    value, at, doc = shingles(w, 3)
    names = {}
    for i, text in enumerate(texts):
        x = plain(text)
        expected = [tuple(x[k:k + 3]) for k in range(max(1, len(x) - 2))] if x else []
        own = value[doc == i].tolist()
        assert len(own) == len(expected)
        for h, s in zip(own, expected, strict=True):
            assert names.setdefault(h, s) == s
    assert len(set(names.values())) == len(names)
    once, owner = distinct(value, doc)
    assert len(once) == len(set(zip(value.tolist(), doc.tolist(), strict=True)))
    assert (owner[1:] >= owner[:-1]).all()


def test_pieces_cover_all_rows_and_long_texts_stay_whole():
    texts = pa.array(["a" * n for n in (5, 0, 50, 3, 3, 3, 200, 1)], pa.string())
    cut = list(pieces(texts, 10))
    assert [i for a, b in cut for i in range(a, b)] == list(range(8))
    assert all(b > a for a, b in cut)
    assert list(pieces(pa.array([], pa.string()))) == []

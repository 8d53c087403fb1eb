import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from fixtures import EDGES, changed, documents, empty, prose

from squall.llm import phrases as ph


def pieces_of(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def expected(rows, threshold, most=2000):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for w in pieces_of(text):
            totals[lang] += len(w)
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    counts[lang, tuple(w[i:i + n])] += 1
    kept = {k: c for k, c in counts.items() if c >= threshold}
    out = []
    for (lang, w), a in kept.items():
        if len(w) < 2:
            continue
        score, k = min((2_000_000 * a // (kept[lang, w[:k]] + kept[lang, w[k:]]), k) for k in range(1, len(w)))
        longer = [c for (g, v), c in kept.items() if g == lang and len(v) > len(w)
                  and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if not any(100 * c >= 80 * a for c in longer):
            out.append((lang, score, a, " ".join(w), kept[lang, w[:k]], kept[lang, w[k:]], totals[lang]))
    found = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))[:most]
        found += [(lang, i + 1, r[3], r[2], r[4], r[5], r[6], r[1]) for i, r in enumerate(own)]
    return sorted(found)


def corpus():
    r = random.Random(5)
    shared = [prose(r, 12) for _ in range(6)]
    texts = [changed(r, r.choice(shared), 2) + r.choice([".", "!", "\n", " "]) + " Ab  ab\tAB ab, " + prose(r, 8) for _ in range(60)]
    return texts + EDGES + ["one two three"] * 7 + ["x. y"] * 9


@pytest.mark.parametrize("sizes", [{}, {"capacity": 20, "pack": 100, "most_bits": 1 << 10, "most_counted": 10}])
def test_against_brute_force(spark, sizes):
    """Small summaries, packs and bit tables change the work and not the result."""
    texts = corpus()
    docs = documents(spark, texts)
    langs = [None if i % 5 == 0 else "en" if i % 5 < 4 else "de" for i in range(len(texts))]
    rows = spark.createDataFrame([(*r[:2], langs[i], *r[3:]) for i, r in enumerate(docs.collect())], docs.schema)
    got = [tuple(r) for r in ph.collocations(rows, threshold=4, most=50, **sizes).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    want = expected(list(zip(langs, texts, strict=True)), 4, 50)
    assert len(want) > 20
    assert sorted(got) == want


def test_no_documents_and_no_candidates(spark):
    assert ph.collocations(empty(spark)).collect() == []
    assert ph.collocations(documents(spark, ["a b c", None, ""])).collect() == []


def test_every_frequent_hash_survives():
    """Whatever the capacity and the order, a summary keeps all hashes that reach the threshold, with
    counts too low by less than it."""
    r = np.random.default_rng(3)
    for capacity in (1, 7, 100):
        s = ph.Summary(capacity, 30)
        total = collections.Counter()
        for _ in range(60):
            value = np.unique(np.concatenate([r.integers(0, 5000, 300), r.integers(0, 40, 20)])).astype(np.uint64)
            count = np.where(value < 40, r.integers(1, 4, len(value)), 1).astype(np.int64)
            s.add(value, count)
            for v, c in zip(value.tolist(), count.tolist(), strict=True):
                total[v] += c
        alive = set(s.survivors().tolist())
        assert {v for v, c in total.items() if c >= 30} <= alive
        assert s.taken < 30
        assert all(0 <= total[v] - c <= s.taken for v, c in zip(s.value.tolist(), s.count.tolist(), strict=True))


def test_long_texts_are_cut_where_no_phrase_is(monkeypatch):
    monkeypatch.setattr(ph, "_LONG_TEXT", 200)
    text = " ".join(f"w{i % 37} é{i % 11}{'.' if i % 13 == 0 else ''}" for i in range(400))
    parts = ph._cut(text)
    assert len(parts) > 10
    assert "".join(parts) == text
    whole = pa.record_batch({"lang": ["en"], "text": [text]})
    for seeds in ({},):
        cut = collections.Counter()
        for langs, texts in ph._texts([whole]):
            g = ph.Grams(langs, texts, seeds)
            for n in range(1, 5):
                cut.update(g.value[n][g.whole[n]].tolist())
        g = ph.Grams(["en"], pa.array([text]), seeds)
        assert cut == collections.Counter(v for n in range(1, 5) for v in g.value[n][g.whole[n]].tolist())
    assert ph._cut("a" * 500) == ["a" * 500]


def test_equal_hashes_are_told_apart_by_text():
    """Two phrases of one hash stay two, in one task and over tasks; the same phrase of two tasks is one."""
    def part(texts, langs=(0, 0)):
        size = np.array([len(t) for t in texts])
        return (np.array([7, 7], np.uint64), np.array([2, 3]), np.array(langs), np.array([1, 1]), size, np.frombuffer("".join(texts).encode(), np.uint8))
    c = ph.Counted(100)
    c.number(["en", "de"])
    for texts, langs in ((("ab", "cd"), (0, 0)), (("cd", "abc"), (0, 0)), (("ab", "ab"), (1, 0))):
        c._hold(*part(texts, langs))
    got = sorted((x["lang"], x["phrase"], x["count"]) for x in c.result(0).to_pylist())
    assert got == [("de", "ab", 2), ("en", "ab", 5), ("en", "abc", 3), ("en", "cd", 5)]

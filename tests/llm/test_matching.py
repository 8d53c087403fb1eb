"""Decontamination, license scans and the Jaccard join against brute force."""
import random
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from fixtures import changed, documents, empty, prose, word
from squall.llm import decontaminate, licenses, ngram_join
from squall.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", (text or "").translate(LOWER))


def shingles_of(text, size):
    w = words_of(text)
    return [tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


# ---- decontamination

def benchmark(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def best_window(text, item, size=5):
    """The definition: the largest similarity of a window with as many words as the item."""
    own, other = shingles_of(text, size), Counter(shingles_of(item, size))
    total = sum(other.values())
    if not own or not total:
        return 0.0
    n = min(max(1, min(len(words_of(item)), len(words_of(text))) - size + 1), len(own))
    best = 0.0
    for s in range(len(own) - n + 1):
        shared = sum((Counter(own[s:s + n]) & other).values())
        best = max(best, shared / (n + total - shared))
    return best


def test_leaks_are_those_of_brute_force(spark):
    r = random.Random(3)
    items = [prose(r, n) for n in (14, 20, 33, 47, 59)] + ["two words", "", None, "la la la la la la la la la la la la"]
    texts = [prose(r, 80) for _ in range(10)] + [None, "", "two words", "two", items[0]]
    for item in items[:5]:
        for edits in (0, 0, 1, 1, 2, 4):
            texts.append(f"{prose(r, r.randint(0, 40))} {changed(r, item, edits).upper()} {prose(r, r.randint(0, 40))}")
        words = item.split(" ")
        texts.append(" ".join(words[2:]))
        texts.append(" ".join(words[:len(words) * 9 // 10]) + " " + prose(r, 5))
    texts.append(prose(r, 30) + " la" * 40)
    found = decontaminate.find_leaks(documents(spark, texts), benchmark(spark, items), per_pass=4).collect()
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in found}
    expected = {(d, i): best_window(t, items[i]) for d, t in enumerate(texts) for i in range(len(items))}
    expected = {k: v for k, v in expected.items() if v >= 0.8}
    assert got.keys() == expected.keys() and len(got) > 15
    assert all(abs(got[k] - v) < 1e-12 for k, v in expected.items())
    bad = {d for d, _ in expected}
    docs = documents(spark, texts)
    kept = decontaminate.drop_leaks(docs, benchmark(spark, items), per_pass=4)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.collect()) == [d for d in range(len(texts)) if d not in bad]


def test_items_of_few_words_are_found_inside_documents(spark):
    items = ["alpha", "two words", "one more item", "an item of four", "two words"]
    texts = ["x two WORDS y z u v", "two words", "p two\nwords", "a b c one more item", "and an item of four here too",
             "an item of three and more words", "two other words are not one", "words two words two words", "alpha",
             "a b c d e f alpha", "alphabet one two three four"]
    got = {(x["doc_id"], x["item_id"]): (x["first_word"], x["n_words"], x["similarity"]) for x in
           decontaminate.find_leaks(documents(spark, texts), benchmark(spark, items)).collect()}
    expected = {}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            own, other = words_of(t), words_of(item)
            at = [s for s in range(len(own) - len(other) + 1) if own[s:s + len(other)] == other]
            if at:
                expected[d, i] = (at[0], len(other), 1.0)
    assert got == expected and len(got) == 12
    kept = decontaminate.drop_leaks(documents(spark, texts), benchmark(spark, items))
    assert {x["doc_id"] for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in expected}


def test_leaks_of_empty_tables(spark):
    assert decontaminate.find_leaks(empty(spark), benchmark(spark, ["a b c d e f"])).collect() == []
    docs = documents(spark, ["a b c d e f", None, "x"], [1, None, 1])
    assert decontaminate.find_leaks(docs, benchmark(spark, [])).collect() == []
    assert decontaminate.drop_leaks(docs, benchmark(spark, [])).count() == 3
    assert decontaminate.drop_leaks(docs, benchmark(spark, ["a b c d e f"])).count() == 2


def test_blocks_find_every_fingerprint_within_the_radius():
    import numpy as np

    r = random.Random(4)
    texts = tuple(prose(r, 30) for _ in range(60))
    index = decontaminate.Index(tuple(range(60)), texts, 5, 39)
    draw = np.random.default_rng(0)
    prints = np.concatenate([index.prints, draw.integers(0, 1 << 16, (200, 8), dtype=np.uint16)])
    flipped = np.unpackbits(index.prints.view(np.uint8).reshape(60, 16), axis=1)
    for row, k in enumerate(draw.integers(30, 45, 60)):
        flipped[row, draw.choice(128, k, replace=False)] ^= 1
    prints = np.concatenate([prints, np.packbits(flipped, axis=1).view(np.uint16).reshape(60, 8)])
    rows, items = index.candidates(prints)
    near = decontaminate.distances(prints[:, None, :], index.prints[None, :, :]) <= 39
    assert set(zip(rows.tolist(), items.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


# ---- licenses

def test_longest_rise_and_patience():
    r = random.Random(6)
    for _ in range(200):
        values = [r.randint(0, 20) for _ in range(r.randint(0, 9))]
        got = licenses.longest_rise(values)
        picked = [values[i] for i in got]
        best = max((len(c) for k in range(len(values) + 1) for c in combinations(values, k)
                    if all(a < b for a, b in zip(c, c[1:], strict=False))), default=0)
        assert got == sorted(got) and picked == sorted(set(picked)) and len(got) == best
    for _ in range(200):
        a = [r.randint(0, 30) for _ in range(r.randint(0, 30))]
        b = [x for x in a if r.random() < 0.8]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert len(licenses.patience(list(range(50)), list(range(50)))) == 50


def common(a, b):
    """Length of a longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_patience_against_the_longest_common_subsequence():
    """Where no word repeats the alignment is a longest one; else it is a common one and never longer."""
    r = random.Random(11)
    for n in range(60):
        a, b = r.sample(range(40), r.randint(0, 30)), r.sample(range(40), r.randint(0, 30))
        assert len(licenses.patience(a, b)) == common(a, b)
        a, b = [r.randrange(9) for _ in range(n % 25)], [r.randrange(9) for _ in range(20)]
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and s < t for (p, s), (q, t) in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= common(a, b)


def test_one_license_a_text(spark):
    """A BSD-3 header or text is one BSD-3 license, a BSD-2 text one BSD-2; "All rights reserved" counts
    only where nothing else does; SPDX lines are read exactly."""
    top = "Copyright (c) 2020, Somebody. All rights reserved. "
    lc = licenses
    texts = [f"{top}{lc._CONDITIONS} {lc._NAMES}", f"{top}{lc._CONDITIONS} {lc._NAMES} {lc._NO_WARRANTY}",
             f"{top}{lc._CONDITIONS} {lc._NO_WARRANTY}", f"{top}{lc._CONDITIONS}", f"MIT License {top}{lc._MIT} {lc._MIT_WARRANTY}",
             f"{lc._ISC} {lc._ISC_WARRANTY}", top, "// SPDX-License-Identifier: GPL-2.0-only\nint main;",
             "x SPDX-License-Identifier: (MIT OR Apache-2.0) WITH LLVM-exception y", "/* SPDX-License-Identifier: BSD-3-Clause */" + top,
             "SPDX-License-Identifier:", "spdx license identifier mit"]
    got = {}
    for x in lc.scan_licenses(documents(spark, texts)).collect():
        got.setdefault(x["doc_id"], []).append(x["license"])
        assert 0.8 <= x["coverage"] <= 1 and x["n_words"] >= x["matched"] > 0
    assert got == {0: ["BSD-3-Clause"], 1: ["BSD-3-Clause"], 2: ["BSD-2-Clause"], 3: ["BSD-2-Clause"], 4: ["MIT"], 5: ["ISC"],
                   6: ["Proprietary"], 7: ["GPL-2.0-only"], 8: ["Apache-2.0", "MIT"], 9: ["BSD-3-Clause"]}


def test_licenses_in_prose(spark):
    r = random.Random(7)
    whole = {name: text for name, text in licenses.TEMPLATES[::-1] if len(text) > 150}
    texts, expected = [], []
    for name, text in whole.items():
        expected.append((len(texts), name))
        texts.append(f"{prose(r, 50)}\n{text.upper()}\n{prose(r, 50)}")
        words = text.split(" ")
        del words[len(words) // 2:len(words) // 2 + 2]
        words[3] = "changed"
        expected += [(len(texts), name), (len(texts), name)]
        texts.append(f"{text} {' '.join(words)}")
    expected.append((len(texts), "MIT"))
    texts += [f"Released under the MIT License. {prose(r, 30)}", prose(r, 100), None, "", "license", "of the the of"]
    got = licenses.scan_licenses(documents(spark, texts)).collect()
    assert sorted((x["doc_id"], x["license"]) for x in got) == sorted(expected)
    assert all(0.8 <= x["coverage"] <= 1 for x in got)
    assert licenses.scan_licenses(empty(spark)).collect() == []


# ---- Jaccard join

def brute_components(texts, keys, size, percent):
    sets = [frozenset(shingles_of(t, size)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), keys[i]), keys[i])
    return [(len(sets[i]), least[find(i)]) for i in range(len(texts))]


def copies(r):
    line = prose(r, 12)
    texts = ["", None, " \n", "one", "one", "one two", "ONE two", "one two three", "one  two three", line, line + " x"]
    texts += [f"{prose(r, r.randint(3, 60))} {line}" for _ in range(30)]
    for n, group in ((150, 60), (40, 25), (60, 4), (12, 6)):
        base = prose(r, n)
        texts += [base, base]
        for _ in range(group):
            texts.append(changed(r, base, r.randint(0, 4)))
        again = changed(r, base, 3)                 # copies of a copy, out of the first one's reach
        texts += [changed(r, again, r.randint(0, 2)) for _ in range(group // 3)]
    r.shuffle(texts)
    return texts


def test_components_are_those_of_brute_force(spark, monkeypatch):
    for seed, size, percent, hot in ((1, 3, 90, 8), (2, 3, 90, 2), (3, 5, 80, 4), (4, 2, 60, 3), (5, 3, 90, 1000)):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        texts = copies(random.Random(seed))
        keys = [3 * i + 1 for i in range(len(texts))]
        random.Random(seed).shuffle(keys)
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in
               ngram_join.join_components(documents(spark, texts, keys).repartition(3), size=size, percent=percent).collect()}
        expected = dict(zip(keys, brute_components(texts, keys, size, percent), strict=True))
        assert got == expected, (seed, [k for k in keys if got[k] != expected[k]])
        assert len({c for _, c in expected.values()}) < len(texts) - 20


def test_components_without_a_table_of_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TABLE", 0)
    texts = copies(random.Random(8))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"])
           for x in ngram_join.join_components(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts, range(len(texts)), 3, 90)))


def test_prefixes_share_what_they_ask_for():
    import numpy as np

    r = np.random.default_rng(1)
    checked = 0
    for _ in range(2000):
        n = int(r.integers(5, 60))
        x = np.sort(r.choice(200, n, replace=False)).astype(np.uint64)
        y = np.unique(np.concatenate([r.choice(x, max(1, n - int(r.integers(0, 5))), replace=False),
                                      r.integers(0, 200, int(r.integers(0, 4))).astype(np.uint64)]))
        shared = len(np.intersect1d(x, y))
        if 100 * shared < 80 * (len(x) + len(y) - shared):
            continue
        often = r.integers(0, 5, 200) * r.integers(0, 200)
        sides = []
        for z in (x, y):
            order, length, need = ngram_join.prefix_of(often[z.astype(int)], 80)
            sides.append((set(z[order[:length]].tolist()), need))
        assert len(sides[0][0] & sides[1][0]) >= min(sides[0][1], sides[1][1])
        checked += 1
    assert checked > 300


def test_components_of_edge_tables(spark):
    assert ngram_join.join_components(empty(spark)).collect() == []
    assert ngram_join.drop_near_copies(empty(spark)).collect() == []
    same = documents(spark, ["a b c d", "a b c d", "a b c d", None, "a b c d"], [5, 5, None, 9, 2])
    got = sorted((x["doc_id"] or 0, x["component_id"]) for x in ngram_join.join_components(same).collect())
    assert got == [(0, 2), (2, 2), (5, 2), (5, 2), (9, 9)]


def test_one_of_each_component_stays(spark):
    texts = copies(random.Random(9))
    docs = documents(spark, [*texts, texts[40]], [*range(len(texts)), 40])
    kept = ngram_join.drop_near_copies(docs, size=5, percent=80)
    assert kept.columns == docs.columns
    expected = sorted(i for i, (n, c) in enumerate(brute_components(texts, range(len(texts)), 5, 80)) if c == i)
    assert sorted(x["doc_id"] for x in kept.collect()) == expected


def test_a_family_of_unlinked_sets_makes_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TABLE", 0)
    r = random.Random(13)
    base = prose(r, 302).split(" ")
    texts = []
    for i in range(80):
        own = list(base)
        for k, at in enumerate(r.sample(range(3, 299, 6), 5)):
            own[at] = f"own{i}x{k}"
        texts.append(" ".join(own))
    texts += [texts[3] + " end", texts[5] + " end"]
    made = []
    pairs_of = ngram_join._pairs_of_differences

    def counted(members, percent, scratch):
        made.append((members.count(), (pairs := scratch.pin(pairs_of(members, percent, scratch), "test-pairs")).count()))
        return pairs

    monkeypatch.setattr(ngram_join, "_pairs_of_differences", counted)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"])
           for x in ngram_join.join_components(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts, range(len(texts)), 3, 90)))
    (members, pairs), = made
    assert members >= 80 and pairs <= 4 * members, made


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_rows_that_share_a_key_are_told_apart_by_their_texts(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW_KEYS", few)
    r = random.Random(12)
    a, b, c, alone = (prose(r, 80) for _ in range(4))
    near_b, near_c = changed(r, b, 1), changed(r, c, 1)
    texts = [a, a, b, near_b, c, near_c, c, near_c, alone, "", a]
    keys = [3, 5, 5, 7, 9, 9, 12, 12, 12, 5, 3]
    docs = documents(spark, texts, keys)
    got = Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.join_components(docs).collect())
    n = [len(set(shingles_of(t, 3))) for t in texts]
    assert got == Counter(zip(keys, n, [3, 3, 5, 5, 9, 9, 9, 9, 12, 5, 3], strict=True))
    kept = [(x["doc_id"], x["text"]) for x in ngram_join.drop_near_copies(docs).collect()]
    (of_c,) = [t for k, t in kept if k == 9]
    assert of_c in (c, near_c)
    assert Counter(kept) == Counter([(3, a), (5, b), (9, of_c), (12, alone), (5, "")])


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_rows_without_a_key_link_and_one_of_each_component_stays(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW_KEYS", few)
    r = random.Random(14)
    a, b, c, alone, d = (prose(r, 80) for _ in range(5))
    middle = changed(r, c, 1)
    texts = [a, a, changed(r, a, 1), b, changed(r, b, 1), b, c, middle, changed(r, middle, 1), alone, "", None, d, d]
    keys = [None, None, None, 4, None, None, 6, None, 8, None, None, None, 9, None]
    docs = documents(spark, texts, keys)
    got = Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in ngram_join.join_components(docs).collect())
    n = [len(set(shingles_of(t, 3))) for t in texts]
    ids = [None, None, None, 4, 4, 4, 6, 6, 6, None, None, None, 9, 9]
    assert got == Counter(zip(keys, n, ids, strict=True))
    kept = [(x["doc_id"], x["text"]) for x in ngram_join.drop_near_copies(docs).collect()]
    (of_a,) = [t for k, t in kept if k is None and t in (a, texts[2])]
    assert Counter(kept) == Counter([(None, of_a), (4, b), (6, c), (None, alone), (None, ""), (None, None), (9, d)])


def test_chains_have_one_root(spark):
    names = [i.to_bytes(16, "big") for i in range(300)]
    order = list(range(300))
    random.Random(1).shuffle(order)
    links = [(names[a], names[b]) for a, b in zip(order[:200], order[1:200], strict=False)] + [(names[order[250]], names[order[251]])]
    got = {bytes(x["name"]): bytes(x["root"]) for x in
           ngram_join.components(spark.createDataFrame(links, "x binary, y binary"), Scratch(spark)).collect()}
    assert len(got) == 202
    assert {got[names[i]] for i in order[:200]} == {names[min(order[:200])]}


def test_word_helper():
    assert word(random.Random(0)).isalpha() and pa is not None

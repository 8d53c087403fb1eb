"""Sharding and nearest neighbours: laws of the result, differencing, recall against brute force."""
import random
import zlib
from collections import defaultdict

import numpy as np

from fixtures import documents, empty, prose
from squall.llm import neighbours, shards


def test_differencing_keeps_sums_and_beats_dealing_by_size():
    r = np.random.default_rng(1)
    for n, k in ((1, 3), (2, 3), (50, 4), (400, 10)):
        sizes = r.integers(1, 1000, n)
        vectors = []
        for s in sizes:
            v = np.zeros(k, np.int64)
            v[0] = s
            vectors.append(v)
        sums, places = shards.difference(vectors)
        dealt = np.bincount(places[:, 0], weights=sizes, minlength=k).astype(int)
        assert dealt.tolist() == sums.tolist() == sorted(sums.tolist(), reverse=True)
        if n >= 50:
            greedy = np.zeros(k)
            for s in sorted(sizes, reverse=True):
                greedy[greedy.argmin()] += s
            assert sums.max() - sums.min() <= greedy.max() - greedy.min()
    # the example of the method: 8, 7, 6, 5, 4 in two parts differ by 2
    assert np.diff(shards.difference([np.array([s, 0]) for s in (8, 7, 6, 5, 4)])[0])[0] == -2


def test_shards_obey_their_law(spark, monkeypatch):
    monkeypatch.setattr(shards, "GROUPS_PER_BUCKET", 100)
    monkeypatch.setattr(shards, "FACTOR", 4)
    r = random.Random(3)
    texts = [prose(r, r.randint(1, 200)) for _ in range(600)]
    texts += [texts[0]] * 40 + [None, "", None, "ü€"]
    keys = [*range(len(texts) - 1), None]
    got = shards.shard_documents(documents(spark, texts, keys).repartition(4), 8).collect()
    assert len(got) == len(texts)
    by_key = {x["doc_id"]: x for x in got}
    groups, slots, sizes = defaultdict(set), defaultdict(list), defaultdict(int)
    for k, t in zip(keys, texts, strict=True):
        x = by_key[k]
        data = (t or "").encode()
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        assert 0 <= x["shard"] < 8
        groups[t or ""].add(x["shard"])
        slots[x["shard"]].append(x["slot"])
        sizes[x["shard"]] += x["size"]
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.005 * sum(sizes.values()) / 8
    assert shards.shard_documents(empty(spark), 8).collect() == []


def test_a_group_larger_than_a_share_has_a_shard_alone(spark, monkeypatch):
    monkeypatch.setattr(shards, "GROUPS_PER_BUCKET", 50)
    r = random.Random(4)
    rows = [("hot", 10 ** 6)] + [(f"g{i}", int(r.paretovariate(1.2) * 100)) for i in range(500)]
    rows = [(g, min(s, 20_000)) if g != "hot" else (g, s) for g, s in rows]
    got = shards.balanced_groups(spark.createDataFrame(rows, "group string, size long"), 5).collect()
    assert {(x["group"], x["size"]) for x in got} == set(rows) and len(got) == len(rows)
    sizes, hot = defaultdict(int), next(x["shard"] for x in got if x["group"] == "hot")
    for x in got:
        sizes[x["shard"]] += x["size"]
    assert sizes[hot] == 10 ** 6
    rest = [v for k, v in sizes.items() if k != hot]
    assert len(rest) == 4 and max(rest) - min(rest) < 0.02 * max(rest)


def vectors(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], "id")
                                  for k, v in rows], "vec_id long, embedding array<float>, id string")


def brute(rows, every, k):
    good = {i: np.array(v, np.float32).astype(np.float64) for i, v in rows}
    out = {}
    for q in sorted(good):
        if q % every == 0:
            scores = sorted((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def listed(df):
    out = defaultdict(list)
    for x in sorted(df.collect(), key=lambda x: (x["query_id"], x["rank"])):
        out[x["query_id"]].append((x["vec_id"], x["score"]))
        assert x["rank"] == len(out[x["query_id"]])
    return out


def test_recall_of_clustered_and_plain_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_BLOCK", 32)
    r = np.random.default_rng(4)
    centres = r.standard_normal((30, 16)) * 3
    rows = [(i, centres[i % 30] + r.standard_normal(16) * 0.3) for i in range(1500)]
    rows += [(i, r.standard_normal(16) * r.uniform(0.1, 3)) for i in range(1500, 2000)]
    got, expected = listed(neighbours.nearest(vectors(spark, rows), 10, 20)), brute(rows, 20, 10)
    assert got.keys() == expected.keys() and all(len(v) == 10 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.9 * 10 * len(expected)
    exact = dict(rows)
    for q, best in got.items():
        for i, s in best:
            assert abs(s - float(np.float32(exact[q]).astype(float) @ np.float32(exact[i]).astype(float))) < 1e-9
        assert best == sorted(best, key=lambda x: (-x[1], x[0]))


def test_equal_vectors_come_by_smallest_key(spark):
    r = np.random.default_rng(5)
    same = r.standard_normal(8)
    rows = [(i, same) for i in range(0, 300, 2)] + [(i, r.standard_normal(8)) for i in range(1, 100, 2)]
    got, expected = listed(neighbours.nearest(vectors(spark, rows), 5, 20)), brute(rows, 20, 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in expected.items()}


def test_vectors_that_take_no_part(spark):
    good = [(0, [1, 0]), (1, [0.5, 0.5]), (2, [0, 1]), (20, [2, 0])]
    bad = [(3, None), (40, [0, 0]), (5, [1, None]), (6, [float("nan"), 1]), (60, [float("inf"), 1]), (7, [1, 2, 3]), (None, [1, 1]),
           (80, [])]
    got = listed(neighbours.nearest(vectors(spark, [*good, *bad, (1, [0.5, 0.5])]), 20, 20))
    assert got == {0: [(20, 2.0), (1, 0.5), (2, 0.0)], 20: [(0, 2.0), (1, 1.0), (2, 0.0)]}
    assert neighbours.nearest(vectors(spark, []), 20, 20).collect() == []
    assert neighbours.nearest(vectors(spark, [(0, [1, 1])]), 20, 20).collect() == []
    assert neighbours.nearest(vectors(spark, [(1, [1, 1]), (2, [1, 1])]), 20, 20).collect() == []


def test_neighbours_on_the_curve_are_neighbours_in_the_grid():
    for bits, dimensions in ((3, 2), (2, 3), (1, 5), (2, 4)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
        key = neighbours.hilbert_key(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1)
        assert (steps == 1).all()

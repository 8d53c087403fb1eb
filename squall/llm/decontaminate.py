"""Benchmark decontamination: SimHash of item-sized windows, found by multi-index Hamming blocks,
verified by the exact weighted similarity of word shingles.

Every window of a document with as many words as an item (a shorter document
is one window) that holds at least one of that item's shingles gets a
fingerprint; a window without any has similarity 0, so leaving it out loses
nothing. Items of fewer than five words are one shingle, their whole sequence,
and are looked up among all sequences of as many words. The 128 bits fall into 8 blocks: two fingerprints within the radius
``r`` differ by at most ``r // 8`` bits in some block, so looking each block
up among the items' block values within that distance finds every item within
the radius. Candidates within the radius are compared exactly: a shingle
weighs as often as it occurs, similarity is the sum of the smaller weights
over the sum of the larger.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squall.llm.common import arrow_function, column, kept, map_arrow, ship
from squall.llm.words import mix, pieces, sequences, shingles, words

WORDS = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS = 8, 16
RADIUS = 39
#: Items whose index one pass over the documents holds in memory (about 0.1 MB an item).
ITEMS_PER_PASS = 500


def fingerprint_bits(hashes: np.ndarray) -> np.ndarray:
    """One row of 128 signs (+1, -1) for each shingle hash."""
    both = np.stack([mix(hashes), mix(hashes ^ np.uint64(0xA0761D6478BD642F))], axis=1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(hashes), 16), axis=1)
    return bits.astype(np.int8) * 2 - 1


def pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of summed signs, as 8 blocks of 16 bits."""
    return np.packbits(sums > 0, axis=1).view(np.uint16).reshape(len(sums), BLOCKS)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of blocks."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _within(bits: int) -> np.ndarray:
    """All 16-bit masks with at most ``bits`` ones."""
    return np.array([sum(1 << i for i in c) for k in range(bits + 1) for c in combinations(range(BLOCK_BITS), k)],
                    dtype=np.uint16)


class Index:
    """Items of one pass: their shingles, fingerprints and block tables."""

    def __init__(self, ids: tuple, texts: tuple[str, ...], size: int, radius: int):
        w = words(pa.array(list(texts), pa.string()))
        value, _, doc = shingles(w, size)
        self.ids, self.radius = ids, radius
        self.length = w.count()
        at = np.searchsorted(doc, np.arange(len(ids) + 1))
        self.weights = [dict(zip(*(x.tolist() for x in np.unique(value[a:b], return_counts=True)), strict=True))
                        for a, b in zip(at[:-1], at[1:], strict=True)]
        self.total = np.diff(at)
        sums = np.zeros((len(ids), BLOCKS * BLOCK_BITS), np.int64)
        np.add.at(sums, doc, fingerprint_bits(value))
        self.prints = pack(sums)
        # each shingle's window sizes
        pairs = np.unique(np.stack([value, self.length[doc].astype(np.uint64)], axis=1), axis=0) \
            if len(value) else np.zeros((0, 2), np.uint64)
        self.shingle, first = np.unique(pairs[:, 0], return_index=True)
        self.size_at = np.append(first, len(pairs))
        self.sizes = pairs[:, 1].astype(np.int64)
        # items shorter than a shingle, by their number of words: hash -> items
        self.short: dict[int, dict[int, list[int]]] = {}
        for i in np.flatnonzero((self.length > 0) & (self.length < size)).tolist():
            self.short.setdefault(int(self.length[i]), {}).setdefault(int(value[at[i]]), []).append(i)
        # a block's table: value -> items with a value within the distance
        masks = _within(radius // BLOCKS)
        has = np.flatnonzero(self.total > 0)
        self.tables = []
        for b in range(BLOCKS):
            near = (self.prints[has, b][:, None] ^ masks[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            item = np.repeat(has, len(masks))[order].astype(np.int32)
            self.tables.append((np.searchsorted(near[order], np.arange((1 << BLOCK_BITS) + 1)), item))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``prints``, item) pairs within the radius."""
        rows, items = [], []
        for b, (at, item) in enumerate(self.tables):
            begin, end = at[prints[:, b].astype(np.int64)], at[prints[:, b].astype(np.int64) + 1]
            count = end - begin
            row = np.repeat(np.arange(len(prints)), count)
            where = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
            items.append(item[where])
            rows.append(row)
        pair = np.unique(np.concatenate(rows) * np.int64(len(self.ids)) + np.concatenate(items))
        row, item = pair // len(self.ids), pair % len(self.ids)
        near = distances(prints[row], self.prints[item]) <= self.radius
        return row[near], item[near]

    def similarity(self, window: np.ndarray, item: int) -> float:
        value, count = np.unique(window, return_counts=True)
        weight = self.weights[item]
        shared = sum(min(c, weight.get(v, 0)) for v, c in zip(value.tolist(), count.tolist(), strict=True))
        return shared / (len(window) + int(self.total[item]) - shared)


@kept
def _index(ids: tuple, texts: tuple, size: int, radius: int) -> Index:
    return Index(ids, texts, size, radius)


def leaks_in(texts: pa.Array, index: Index, size: int, least: float) -> list[tuple]:
    """(row, item, first word, words, distance, similarity): the most similar window of each
    document and item that reaches ``least``; the first one of equals."""
    best: dict[tuple[int, int], tuple] = {}
    if len(index.shingle) == 0:
        return []
    for begin, end in pieces(texts):
        w = words(texts.slice(begin, end - begin))
        value, at, doc = shingles(w, size)
        if len(value) == 0:
            continue
        for n, known in index.short.items():
            own, start, of = sequences(w, n)
            for h in np.flatnonzero(np.isin(own, np.array(list(known), np.uint64))).tolist():
                d = int(of[h])
                for i in known[int(own[h])]:
                    best.setdefault((begin + d, i), (begin + d, i, int(start[h] - w.first[d]), n, 0, 1.0))
        found = np.searchsorted(index.shingle, value)
        found[found == len(index.shingle)] = 0
        hits = np.flatnonzero(index.shingle[found] == value)
        if len(hits) == 0:
            continue
        first = np.searchsorted(doc, np.arange(end - begin + 1))     # of each document, among shingles
        for d in np.unique(doc[hits]):
            lo, hi = int(first[d]), int(first[d + 1])
            n_words = int(w.first[d + 1] - w.first[d])
            own = value[lo:hi]
            windows = set()
            for h in hits[np.searchsorted(hits, lo):np.searchsorted(hits, hi)].tolist():
                for n in index.sizes[index.size_at[found[h]]:index.size_at[found[h] + 1]].tolist():
                    n = min(n, n_words)
                    count = max(1, n - size + 1)
                    for s in range(max(0, h - lo - count + 1), min(h - lo, hi - lo - count) + 1):
                        windows.add((s, count, n))
            todo = np.array(sorted(windows), np.int64)
            sums = np.zeros((hi - lo + 1, BLOCKS * BLOCK_BITS), np.int32)
            np.cumsum(fingerprint_bits(own), axis=0, out=sums[1:])
            prints = pack(sums[todo[:, 0] + todo[:, 1]] - sums[todo[:, 0]])
            rows, items = index.candidates(prints)
            for r, i in zip(rows.tolist(), items.tolist(), strict=True):
                s, count, n = todo[r].tolist()
                like = index.similarity(own[s:s + count], i)
                if like >= least:
                    near = int(distances(prints[r], index.prints[i]))
                    key = (begin + int(d), i)
                    if key not in best or (-like, s) < (-best[key][5], best[key][2]):
                        best[key] = (begin + int(d), i, s, n, near, like)
    return [best[k] for k in sorted(best)]


def passes(benchmark: DataFrame, item: str, text: str, per_pass: int):
    """The benchmark in parts of at most about ``per_pass`` items, each as plain values."""
    rows = benchmark.select(F.col(item).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .where("item is not null").distinct()
    parts = max(1, -(-rows.count() // per_pass))
    for part in range(parts):
        got = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).orderBy("item", "text").collect()
        yield tuple(r["item"] for r in got), tuple(r["text"] for r in got)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
               item: str = "item_id", item_text: str = "text", size: int = WORDS, least: float = SIMILARITY,
               radius: int = RADIUS, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """(key, item, first_word, n_words, distance, similarity): for each row of ``docs`` and item,
    the most similar window with ``similarity >= least``, if any.

    Words are runs outside white space with A-Z lower-cased; an item or document of fewer than
    ``size`` words has one shingle, its whole sequence; such an item matches wherever its words
    stand in a row. Null or empty texts match nothing; items
    with null ids are left out; repeated rows give repeated matches. No shuffle: one pass over the
    documents for each ``per_pass`` items, whose index (at most about 0.1 MB an item) goes to
    the workers with the function."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind, item_kind = dict(rows.dtypes)["key"], dict(benchmark.dtypes)[item]
    schema = f"key {kind}, item {item_kind}, first_word int, n_words int, distance int, similarity double"
    out = None
    for ids, texts in passes(benchmark, item, item_text, per_pass):
        def search(batches, ids=ids, texts=texts):
            index = _index(ids, texts, size, radius)
            for batch in batches:
                found = leaks_in(column(batch, "text"), index, size, least)
                if found:
                    r, i, s, n, d, like = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [column(batch, "key").take(pa.array(r)), pa.array([ids[k] for k in i]), pa.array(s, pa.int32()),
                         pa.array(n, pa.int32()), pa.array(d, pa.int32()), pa.array(like, pa.float64())],
                        names=["key", "item", "first_word", "n_words", "distance", "similarity"])

        found = map_arrow(rows, search, schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"key": key, "item": item if item != key else f"{item}_of_benchmark"})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
               item_text: str = "text", size: int = WORDS, least: float = SIMILARITY, radius: int = RADIUS,
               per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window matches an item."""
    out = docs
    ship(docs.sparkSession)
    for ids, texts in passes(benchmark, item, item_text, per_pass):
        def clean(column_of_texts: pa.Array, ids=ids, texts=texts) -> pa.Array:
            index = _index(ids, texts, size, radius)
            mask = np.ones(len(column_of_texts), bool)
            mask[[f[0] for f in leaks_in(column_of_texts, index, size, least)]] = False
            return pa.array(mask)

        out = out.where(arrow_function(clean, "boolean")(F.col(text)))
    return out

"""Phrase collocations: all phrases of two to four words that occur often enough, scored by how
firmly their parts belong together.

Counting all n-grams of a corpus would shuffle most of them for nothing, as nearly all are rare.
Candidates are found first. Tasks send their n-grams as 64-bit hashes, sorted, packed and dealt to
partitions by ranges of the hash, where mergeable Misra-Gries summaries add them up: a summary with
more counters than its mass divided by the threshold takes less than the threshold from any count,
so every frequent n-gram survives. Words and pairs go first; three and four words in a row are sent
only where all pairs in them survived. A last pass counts the survivors exactly, by their text, so a
hash shared by two n-grams costs a little work and changes nothing.

What survived reaches the tasks as a bit table of bounded size. With more survivors than it can tell
apart it lets more n-grams through, which is again more work and the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squall.llm.common import Scratch, column, map_arrow, pinned, text_or_empty
from squall.llm.words import U64, mix, slices, utf8, words

THRESHOLD, LONGEST = 30, 4
#: Counters a partition's summary is planned for, hashes a task packs at once, bits of the table at
#: most, phrases a task holds before it adds up equal ones.
CAPACITY, PACK, MOST_BITS, MOST_COUNTED = 1 << 18, 1 << 21, 1 << 28, 800_000

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG_TEXT = 2 << 20


def _cut(text: str) -> list[str]:
    """A long text in stretches of about a megabyte, cut after marks that end a piece, so that no
    phrase is cut; a stretch without such a mark stays whole."""
    raw = text.encode()
    ends, at = np.flatnonzero(_BREAK[np.frombuffer(raw, np.uint8)]) + 1, 0
    parts = []
    while len(raw) - at > _LONG_TEXT // 2:
        i = np.searchsorted(ends, at + _LONG_TEXT // 2)
        if i == len(ends):
            break
        parts.append(raw[at:ends[i]].decode())
        at = int(ends[i])
    return [*parts, raw[at:].decode()]


def _texts(batches):
    """(language of each text, texts) in parts of about a megabyte."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            texts, langs = column(part, "text"), column(part, "lang").to_pylist()
            if part.num_rows == 1 and len(utf8(texts)[0]) > _LONG_TEXT:
                for stretch in _cut(texts[0].as_py()):
                    yield langs, pa.array([stretch])
            else:
                yield langs, texts


class Grams:
    """The n-grams of a part: ``value[n]`` is the hash of the n words from each word on, ``whole[n]``
    where these are in one piece. Hashes hold the language."""

    def __init__(self, langs: list, texts: pa.Array, seeds: dict):
        self.words = w = words(texts, _LOWER, _GAP)
        for name in set(langs) - seeds.keys():
            seeds[name] = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")
        self.seed = seed = np.array([seeds[name] for name in langs], dtype=U64)
        self.doc, size = w.doc(), len(w.hashes)
        breaks = np.concatenate([[0], np.cumsum(_BREAK[w.data], dtype=np.int64)])
        joined = (breaks[w.end[:-1]] == breaks[w.start[1:]]) & (self.doc[:-1] == self.doc[1:])
        self.value = {1: mix(seed[self.doc] + w.hashes)}
        self.whole = {1: np.ones(size, dtype=bool)}
        for n in range(2, LONGEST + 1):
            many = max(size - n + 1, 0)
            self.value[n] = mix(self.value[n - 1][:many] * U64(0x9E3779B97F4A7C15) + w.hashes[n - 1:] + U64(n))
            self.whole[n] = self.whole[n - 1][:many] & joined[n - 2:n - 2 + many]

    def phrases(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The n words from each of these words on, joined by a blank: their bytes one after the other,
        and how many each has. A blank is kept where one stands, and stands in for other gaps."""
        w = self.words
        begin, size = w.start[at], w.end[at + n - 1] - w.start[at]
        odd = np.zeros(len(at), dtype=bool)
        for k in range(n - 1):
            odd |= (w.start[at + k + 1] - w.end[at + k] != 1) | (w.data[w.end[at + k]] != 32)
        if not odd.any():
            return _gathered(w.data, begin, size), size
        made = [self._phrase(i, n) for i in at[odd].tolist()]
        size[odd] = [len(x) for x in made]
        begin[odd] = len(w.data) + np.cumsum(size[odd]) - size[odd]
        return _gathered(np.concatenate([w.data, np.frombuffer(b"".join(made), np.uint8)]), begin, size), size

    def _phrase(self, at: int, n: int) -> bytes:
        w = self.words
        return b" ".join(w.data[a:b].tobytes() for a, b in zip(w.start[at:at + n].tolist(), w.end[at:at + n].tolist(),
                                                               strict=True))


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes ``begin:begin + size`` of ``data``, one run after the other; some runs at a time, as
    their places take eight bytes a byte."""
    out, at = np.empty(int(size.sum()), np.uint8), 0
    for i in range(0, len(size), 1 << 15):
        some = size[i:i + (1 << 15)]
        ends = np.cumsum(some)
        out[at:at + ends[-1]] = data[np.arange(ends[-1]) + np.repeat(begin[i:i + (1 << 15)] - (ends - some), some)]
        at += int(ends[-1])
    return out


def has(table: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which hashes the bit table may hold."""
    at = value & U64(8 * len(table) - 1)
    return (table[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def _packed(values: np.ndarray, borders: np.ndarray):
    """Rows (partition, hashes seen once, hashes seen more often, how often) of sorted distinct hashes."""
    values.sort()
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    count, value = np.diff(np.append(first, len(values))), values[first]
    cuts = np.concatenate([[0], np.searchsorted(value, borders), [len(value)]])
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        v, c = value[cuts[i]:cuts[i + 1]], count[cuts[i]:cuts[i + 1]]
        yield i, v[c == 1].tobytes(), v[c > 1].tobytes(), c[c > 1].astype(np.int64).tobytes()


def _sent(batches, chosen, borders: np.ndarray, pack: int):
    """Packed rows of the n-grams that ``chosen`` takes from each part."""
    held, size, seeds = [], 0, {}

    def rows():
        made = list(zip(*_packed(np.concatenate(held), borders), strict=True))
        held.clear()
        return pa.record_batch([pa.array(c, t) for c, t in zip(made, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)],
                               ["partition", "once", "more", "count"])

    for langs, texts in _texts(batches):
        for values in chosen(Grams(langs, texts, seeds)):
            held.append(values)
            size += len(values)
        if size >= pack:
            yield rows()
            size = 0
    if size:
        yield rows()


class Summary:
    """A Misra-Gries summary of hashes: each count is too low by at most ``taken``, less than the
    threshold. It keeps ``capacity`` counters, or mass / threshold if that is more; taking too much is
    answered by more counters, never by a lost n-gram."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold = capacity, threshold
        self.value, self.count = np.zeros(0, U64), np.zeros(0, np.int64)
        self.mass = self.taken = self.waiting = 0
        self._new: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, value: np.ndarray, count: np.ndarray) -> None:
        self._new.append((value, count))
        self.mass += int(count.sum())
        self.waiting += len(value)
        if self.waiting > 2 * self.capacity:
            self.merge()

    def merge(self) -> None:
        value = np.concatenate([self.value, *(v for v, _ in self._new)])
        count = np.concatenate([self.count, *(c for _, c in self._new)])
        self._new, self.waiting = [], 0
        order = np.argsort(value, kind="stable")
        value, count = value[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        self.value, self.count = value[first], np.add.reduceat(count, first) if len(first) else count
        self.capacity = max(self.capacity, self.mass // self.threshold + 1)
        over = len(self.value) - self.capacity
        if over > 0:
            less = int(np.partition(self.count, over - 1)[over - 1])      # the largest count beyond the capacity
            if self.taken + less < self.threshold:
                self.taken += less
                keep = self.count > less
                self.value, self.count = self.value[keep], self.count[keep] - less
            else:
                self.capacity = 2 * len(self.value)

    def survivors(self) -> np.ndarray:
        """All hashes that may reach the threshold."""
        self.merge()
        return self.value[self.count + self.taken >= self.threshold]


def _summed(batches, capacity: int, threshold: int):
    """Survivors of every partition; rows come sorted by partition."""
    now, summary = None, None

    def out():
        return pa.record_batch([pa.array(summary.survivors().view(np.int64))], ["hash"])

    for batch in batches:
        for i, once, more, count in zip(*(batch.column(c) for c in range(4)), strict=True):
            if i.as_py() != now:
                if summary is not None:
                    yield out()
                now, summary = i.as_py(), Summary(capacity, threshold)
            once = np.frombuffer(once.as_py(), U64)
            summary.add(once, np.ones(len(once), np.int64))
            summary.add(np.frombuffer(more.as_py(), U64), np.frombuffer(count.as_py(), np.int64))
    if summary is not None:
        yield out()


def _borders(partitions: int) -> np.ndarray:
    return np.array([(i << 64) // partitions for i in range(1, partitions)], dtype=U64)


def _dealt(packed: DataFrame, partitions: int) -> DataFrame:
    tasks = max(1, min(partitions, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return packed.repartition(tasks, "partition").sortWithinPartitions("partition")


def survivors(rows: DataFrame, chosen, partitions: int, capacity: int, threshold: int, pack: int) -> DataFrame:
    """Hashes of all n-grams taken by ``chosen`` that occur ``threshold`` times, and few others."""
    borders = _borders(partitions)
    sent = map_arrow(rows, lambda batches: _sent(batches, chosen, borders, pack),
                     "partition int, once binary, more binary, count binary")
    return map_arrow(_dealt(sent, partitions), lambda batches: _summed(batches, capacity, threshold), "hash long")


def bit_table(hashes: DataFrame, most_bits: int) -> np.ndarray:
    """A table with the bit of every hash set, 32 bits a hash and at most ``most_bits``; made in
    slices by tasks."""
    n = max(1, hashes.count())
    bits = min(most_bits, 1 << max(10, (32 * n - 1).bit_length()))
    width = min(bits, 1 << 20)
    at = F.col("hash").bitwiseAND(F.lit(bits - 1))
    placed = hashes.select(F.floor(at / width).cast("int").alias("slice"), F.pmod(at, F.lit(width)).cast("int").alias("bit"))
    placed = placed.repartition(min(64, bits // width), "slice").sortWithinPartitions("slice")

    def made(batches):
        now, table = None, None
        for batch in batches:
            parts, bit = (batch.column(i).to_numpy() for i in range(2))
            for i in np.unique(parts).tolist():
                if i != now:
                    if table is not None:
                        yield pa.record_batch([pa.array([now], pa.int32()), pa.array([table.tobytes()], pa.binary())], ["slice", "bytes"])
                    now, table = i, np.zeros(width // 8, np.uint8)
                own = bit[parts == i]
                np.bitwise_or.at(table, own >> 3, (1 << (own & 7)).astype(np.uint8))
        if table is not None:
            yield pa.record_batch([pa.array([now], pa.int32()), pa.array([table.tobytes()], pa.binary())], ["slice", "bytes"])

    table = np.zeros(bits // 8, np.uint8)
    for row in map_arrow(placed, made, "slice int, bytes binary").collect():       # at most most_bits / 8 bytes
        begin = row["slice"] * (width // 8)
        table[begin:begin + width // 8] = np.frombuffer(row["bytes"], np.uint8)
    return table


#: What a task knows of its phrases, as packed arrays: hash, count, language, words, bytes.
_PACKED = (("value", np.uint64), ("count", np.int64), ("lang", np.int32), ("n", np.int8), ("size", np.int32),
           ("text", np.uint8))
_WORDS = U64(0x5851F42D4C957F2D)                  # sets the number of a language's words apart from its phrases
_PACKED_SCHEMA = "partition int, names array<string>, " + ", ".join(f"{c} binary" for c, _ in _PACKED)


class Counted:
    """Phrases with their counts, as arrays: equal ones are added up once ``most`` have come. Languages
    are numbered as they appear."""

    def __init__(self, most: int):
        self.most, self.held, self.grown, self.numbers, self._parts = most, 0, 0, {}, []

    def number(self, langs: list) -> np.ndarray:
        return np.array([self.numbers.setdefault(x, len(self.numbers)) for x in langs], dtype=np.int32)

    def add(self, g: Grams, langs: list, table: np.ndarray) -> None:
        """Phrases of a part that the table has, and with no words the number of all words."""
        lang = self.number(langs)
        for n in range(1, LONGEST + 1):
            at = np.flatnonzero(g.whole[n])
            at = at[has(table, g.value[n][at])]
            if len(at):
                value, first, count = np.unique(g.value[n][at], return_index=True, return_counts=True)
                at = at[first]
                text, size = g.phrases(at, n)
                self._hold(value, count, lang[g.doc[at]], np.full(len(at), n, np.int8), size, text)
        own, first = np.unique(lang, return_index=True)
        if len(own):
            words_in = np.bincount(lang, weights=g.words.count())[own].astype(np.int64)
            self._hold(mix(g.seed[first] ^ _WORDS), words_in, own, np.zeros(len(own), np.int8), np.zeros(len(own), np.int32),
                       np.zeros(0, np.uint8))

    def add_packed(self, names: list, arrays: list) -> None:
        """What another task has packed."""
        own = [np.frombuffer(x, kind) for x, (_, kind) in zip(arrays, _PACKED, strict=True)]
        own[2] = self.number(names)[own[2]]
        self._hold(*own)

    def _hold(self, *part: np.ndarray) -> None:
        self._parts.append(tuple(x.astype(kind, copy=False) for x, (_, kind) in zip(part, _PACKED, strict=True)))
        self.held += len(part[0])

    def merge(self) -> None:
        """Add up equal phrases. They have one hash; that phrases of one hash are equal is looked up in
        their language and bytes, and should they not be, these decide. Afterwards all are in the order
        of the hash."""
        value, count, lang, n, size, text = (np.concatenate(x) for x in zip(*self._parts, strict=True))
        begin, long = np.cumsum(size, dtype=np.int64) - size, size.astype(np.int64)
        order = np.argsort(value, kind="stable")
        new = np.concatenate([[True], value[order][1:] != value[order][:-1]])
        head = order[new][np.cumsum(new) - 1]                 # the first of each one's hash
        if np.any(size[order] != size[head]) or np.any(lang[order] != lang[head]) or not np.array_equal(
                _gathered(text, begin[order], long[order]), _gathered(text, begin[head], long[head])):
            names = [(int(v), int(x), text[a:a + k].tobytes()) for v, x, a, k in zip(value, lang, begin, size, strict=True)]
            order = np.array(sorted(range(len(names)), key=names.__getitem__))
            new = np.array([True, *(names[i] != names[j] for i, j in zip(order[1:], order[:-1], strict=True))])
        first = np.flatnonzero(new)
        one = order[first]
        self._parts = [(value[one], np.add.reduceat(count[order], first), lang[one], n[one], size[one],
                        _gathered(text, begin[one], long[one]))]
        self.held = len(first)

    def packed(self, borders: np.ndarray) -> pa.RecordBatch:
        """One row for each partition of the hash, and nothing left."""
        *arrays, text = self._parts[0]
        cuts = np.concatenate([[0], np.searchsorted(arrays[0], borders), [len(arrays[0])]])
        ends = np.concatenate([[0], np.cumsum(arrays[4], dtype=np.int64)])
        rows = [(i, list(self.numbers), *[x[a:b].tobytes() for x in arrays], text[ends[a]:ends[b]].tobytes())
                for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if b > a]
        self._parts, self.held = [], 0
        kinds = [pa.int32(), pa.list_(pa.string()), *[pa.binary()] * len(_PACKED)]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                               ["partition", "names", *[c for c, _ in _PACKED]])

    def result(self, threshold: int) -> pa.RecordBatch:
        """(lang, n, phrase, count) of what reaches the threshold, and of all numbers of words."""
        self.merge()
        _, count, lang, n, size, text = self._parts[0]
        kept = np.flatnonzero((count >= threshold) | (n == 0))
        begin, size = (np.cumsum(size, dtype=np.int64) - size)[kept], size[kept].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        phrase = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(_gathered(text, begin, size).tobytes()))
        return pa.record_batch([pa.array(list(self.numbers), pa.string()).take(pa.array(lang[kept])), pa.array(n[kept].astype(np.int32)),
                                phrase.cast(pa.string()), pa.array(count[kept])], ["lang", "n", "phrase", "count"])


def _counted(batches, table: np.ndarray, borders: np.ndarray, most: int):
    """Packed counts of the n-grams in the table and of each language's words, partly added up and dealt
    by ranges of the hash."""
    counted, seeds = Counted(most), {}
    for langs, texts in _texts(batches):
        counted.add(Grams(langs, texts, seeds), langs, table)
        if counted.held > most:
            counted.merge()
            if counted.held > most // 2:
                yield counted.packed(borders)
    if counted.held:
        counted.merge()
        yield counted.packed(borders)


def _added(batches, most: int, threshold: int):
    """Exact counts of every partition; rows come sorted by partition."""
    now, counted = None, None
    for batch in batches:
        for i, names, *arrays in zip(*(batch.column(c) for c in range(2 + len(_PACKED))), strict=True):
            if i.as_py() != now:
                if counted is not None:
                    yield counted.result(threshold)
                now, counted = i.as_py(), Counted(most)
            counted.add_packed(names.as_py(), [x.as_py() for x in arrays])
            if counted.held > 2 * max(most, counted.grown):
                counted.merge()
                counted.grown = counted.held
    if counted is not None:
        yield counted.result(threshold)


def frequent(docs: DataFrame, scratch: Scratch, text: str = "text", lang: str = "lang", threshold: int = THRESHOLD,
             capacity: int = CAPACITY, pack: int = PACK, most_bits: int = MOST_BITS, most_counted: int = MOST_COUNTED) -> DataFrame:
    """Exact counts (lang, n, phrase, count) of all phrases of one to four words with ``threshold``
    occurrences, and with n = 0 the number of words of each language."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = 1 + int(size // 3 // (threshold * capacity))      # a word and its blank take three bytes or more, mostly

    def short(g):
        return [g.value[n][g.whole[n]] for n in (1, 2)]

    found = scratch.pin(survivors(rows, short, partitions, capacity, threshold, pack), "phrase-pairs")
    pairs = spark.sparkContext.broadcast(bit_table(found, most_bits))

    def long(g):
        kept = has(pairs.value, g.value[2]) & g.whole[2]
        for n in range(3, LONGEST + 1):
            ok = g.whole[n].copy()
            for k in range(n - 1):
                ok &= kept[k:k + len(ok)]
            yield g.value[n][ok]

    more = scratch.pin(survivors(rows, long, partitions, capacity, threshold, pack), "phrase-longer")
    table = spark.sparkContext.broadcast(bit_table(found.union(more), most_bits))
    borders = _borders(partitions)
    sent = map_arrow(rows, lambda batches: _counted(batches, table.value, borders, most_counted), _PACKED_SCHEMA)
    counts = scratch.pin(map_arrow(_dealt(sent, partitions), lambda batches: _added(batches, most_counted, threshold),
                                   "lang string, n int, phrase string, count long"), "phrase-counts")
    pairs.unpersist()
    table.unpersist()
    return counts


def _parts(begin: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", begin, size), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 2000, threshold: int = THRESHOLD,
                 contained: int = 80, **options) -> DataFrame:
    """The ``most`` best phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    A-Z are lower-cased and texts cut into pieces at ``.,;:!?`` and line ends; a phrase is two to four
    words of one piece that occur at least ``threshold`` times (``a``). Of its cuts in two the one with
    the lowest ``score = floor(2000000 a / (l + r))`` counts, l and r the counts of its parts; ties to
    the shortest first part. A phrase that lies in a longer one with at least ``contained`` percent of
    its count is left out. Null languages are ``und``, null texts empty; every row counts, repeated or
    not; no documents give no rows."""
    scratch = Scratch(docs.sparkSession)
    counts = frequent(docs, scratch, text, lang, threshold, **options)
    phrases = counts.where("n >= 2").withColumn("words", F.split("phrase", " "))
    cut = F.explode(F.sequence(F.lit(1), F.col("n") - 1))
    cuts = phrases.select("lang", "phrase", "words", "n", F.col("count").alias("a"), cut.alias("k")) \
        .withColumn("left", _parts(F.lit(1), F.col("k"))).withColumn("right", _parts(F.col("k") + 1, F.col("n") - F.col("k")))
    known = counts.where("n >= 1").select("lang", "phrase", "count")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(side), F.col("count").alias(name)), ["lang", side])
    exact = {c: F.col(c).cast("decimal(20,0)") for c in "alr"}
    cuts = cuts.withColumn("score", F.call_function("div", exact["a"] * F.lit(2_000_000).cast("decimal(7,0)"), exact["l"] + exact["r"]))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("n") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("n") - size + 1), lambda begin: _parts(begin, size)))))
    longer = phrases.where("n >= 3").select("lang", "count", inner.alias("phrase")) \
        .groupBy("lang", "phrase").agg(F.max("count").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < contained * exact["a"]))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    totals = counts.where("n = 0").select("lang", F.col("count").alias("n"))
    top = pinned(top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n",
                                                 "best.score"), "phrases")
    scratch.drop()
    return top

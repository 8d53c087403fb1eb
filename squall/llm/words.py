"""Words and word shingles of whole Arrow batches as 64-bit hashes, without a Python loop over words.

A word is a run of bytes outside space and U+0009-U+000D of the UTF-8 text
(``[^\\x20\\x09-\\x0D]+``) with A-Z lower-cased. Its hash is a polynomial of
its bytes modulo 2**64, taken from one running sum over the batch's buffer
and then mixed; a shingle hash mixes the hashes of its words in order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def slices(batch: pa.RecordBatch, text: str, most: int = 4 << 20):
    """A batch in parts of about ``most`` bytes of the column ``text``."""
    for begin, end in pieces(batch.column(batch.schema.get_field_index(text)), most):
        yield batch.slice(begin, end - begin)


@dataclass
class Words:
    """Words of a batch: ``hashes`` in text order, document ``i`` owning ``first[i]:first[i + 1]``;
    ``start`` and ``end`` are byte positions in ``data`` (the lower-cased UTF-8 of all texts)."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    text_at: np.ndarray
    total: np.ndarray

    def prefix(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word; 0 for shorter words."""
        enough = self.end - self.start >= size
        stop = np.where(enough, self.start + size, self.start)
        value = (self.total[stop] - self.total[self.start]) * _power(_INVERSE, len(self.data) + 1)[self.start]
        return np.where(enough, mix(value ^ (U64(size) << U64(56))), U64(0))

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count())


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between batches and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.ones(size, dtype=U64)
        done = 1
        while done < size:
            have[done:2 * done] = have[:done] * U64(pow(base, done, 1 << 64))
            done *= 2
        if size <= 1 << 24:
            _powers[base] = have
    return have[:n]


def forget() -> None:
    """Drop the kept powers; they are made again when needed."""
    _powers.clear()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(texts: pa.Array, most: int = 1 << 20):
    """Cut a batch into runs of documents of at most ``most`` bytes (one longer document stays
    whole), so that working arrays stay bounded: yields (first row, end row)."""
    _, at = utf8(texts)
    row = 0
    n = len(at) - 1
    while row < n:
        end = int(np.searchsorted(at, at[row] + most, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end
        row = end


def words(texts: pa.Array, letters: np.ndarray = _LOWER, gaps: np.ndarray = _SPACE) -> Words:
    """Words of every text of a string array. ``letters`` says what each byte becomes, ``gaps``
    which of the resulting bytes lie between words."""
    raw, at = utf8(texts)
    data = letters[raw]
    inside = np.ones(len(data) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~gaps[data]
    starts = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cut = at[1:-1]                      # a word never runs on into the next text
    cut = cut[(cut > 0) & (cut < len(data))]
    both = cut[inside[cut] & inside[cut + 1]]
    starts[both] = True
    ends[both] = True
    start, end = np.flatnonzero(starts[:len(data)]), np.flatnonzero(ends)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * _power(_BASE, len(data)), out=total[1:])
    hashes = (total[end] - total[start]) * _power(_INVERSE, len(data) + 1)[start]
    hashes = mix(hashes ^ ((end - start).astype(U64) << U64(48)))
    return Words(hashes, np.searchsorted(start, at), start, end, data, at, total)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of ``size`` consecutive words: (hash, first word, document). A document with fewer
    words, but at least one, gives its whole sequence as one shingle."""
    n = w.count()
    whole = np.maximum(n - size + 1, 0)
    at = _ranges(w.first[:-1], whole)
    value = np.zeros(len(at), dtype=U64)
    for k in range(size):
        value = mix(value * U64(0x9E3779B97F4A7C15) + w.hashes[at + k] + U64(k + 1))
    doc = np.repeat(np.arange(len(n)), whole)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        few = np.zeros(len(short), dtype=U64)
        for k in range(size - 1):
            has = n[short] > k
            few[has] = mix(few[has] * U64(0x9E3779B97F4A7C15) + w.hashes[w.first[short[has]] + k] + U64(k + 1))
        few = mix(few ^ U64(0xD6E8FEB86659FD93) * n[short].astype(U64))     # as in ``sequences``
        value = np.concatenate([value, few])
        at = np.concatenate([at, w.first[short]])
        doc = np.concatenate([doc, short])
        order = np.lexsort((at, doc))
        value, at, doc = value[order], at[order], doc[order]
    return value, at, doc


def sequences(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every ``n`` consecutive words, hashed as a whole sequence of fewer words than a shingle's is:
    (hash, first word, document)."""
    many = np.maximum(w.count() - n + 1, 0)
    at = _ranges(w.first[:-1], many)
    value = np.zeros(len(at), dtype=U64)
    for k in range(n):
        value = mix(value * U64(0x9E3779B97F4A7C15) + w.hashes[at + k] + U64(k + 1))
    value = mix(value ^ U64(0xD6E8FEB86659FD93) * np.full(len(at), n, U64))
    return value, at, np.repeat(np.arange(len(many)), many)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), first[1], ..."""
    total = int(count.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total) - np.repeat(ends - count, count) + np.repeat(first, count)


def distinct(value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, ordered by document and hash; ``doc`` must ascend."""
    if len(value) == 0:
        return value, doc
    value = value.copy()
    cuts = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    for part in np.split(value, cuts):      # views: each document's hashes are sorted in place
        part.sort()
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], doc[keep]

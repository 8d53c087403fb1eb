"""Cutting a text before a single space between two visible characters.

For byte-level BPE with the public pre-split pattern, such a space always
begins a new piece and nothing left of it looks past it, so the pieces of a
text are the pieces of its chunks one after the other; a single line break
between two visible characters is always one piece. Chunks repeat far more
often than texts, so their ids are kept in a bounded memory.

``cuts`` does the same on the UTF-8 of a whole batch, and cuts between
letters, digits and marks as well: no piece holds two of these kinds but one
that begins with an apostrophe, which counts as none of them.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_EDGE = re.compile(r"(?<=\S)(?= \S)")
_TOUCHING = re.compile(r"\s\s")


def split(text: str) -> list[str]:
    """Chunks of a text; every chunk but the first is given without its leading space. Where no
    white space touches another, a line break is a piece of its own and begins a chunk too."""
    if not _TOUCHING.search(text):
        return text.replace("\n", " \n").split(" ")
    parts = _EDGE.split(text)
    return [parts[0], *(p[1:] for p in parts[1:])]


#: What a byte is part of. Only characters whose kind no version of Unicode has changed are letters,
#: digits or marks; ``_OTHER`` may be any visible character.
_OTHER, _LETTER, _DIGIT, _MARK, _SPACE, _BREAK, _BLANK = range(7)


def _kind(code: int) -> int:
    c = chr(code)
    if c.isspace():
        return {" ": _SPACE, "\n": _BREAK}.get(c, _BLANK)
    if c == "'" or not (code < 0x180 or 0x2010 <= code < 0x2028 or 0x2030 <= code < 0x205f):
        return _OTHER
    if "0" <= c <= "9":
        return _DIGIT
    return {"L": _LETTER, "P": _MARK, "S": _MARK}.get(unicodedata.category(c)[0], _OTHER)


_ONE_BYTE = np.array([*map(_kind, range(128)), *[_OTHER] * 128], np.uint8)
_TWO_BYTES = np.array([*map(_kind, range(0x180))], np.uint8)
_THREE_BYTES = np.array([*map(_kind, range(0x4000))], np.uint8)
_VISIBLE = (_OTHER, _LETTER, _DIGIT, _MARK)
#: By 8 * kind before + kind after: a space or line break behind a visible character, or two kinds of them.
_CUT = np.array([after in (_SPACE, _BREAK) and before in _VISIBLE
                 or before != after and {before, after} <= {_LETTER, _DIGIT, _MARK}
                 for before in range(8) for after in range(8)])


def cuts(raw: np.ndarray) -> np.ndarray:
    """Whether a text with these bytes (UTF-8) may be cut before each of them. For the bytes of
    several texts, one after the other, this holds within each of them."""
    kind = _ONE_BYTE[raw]
    at = np.flatnonzero((raw >= 0xc2) & (raw <= 0xc5))
    kind[at] = kind[at + 1] = _TWO_BYTES[(raw[at] & 0x1f).astype(np.int64) << 6 | raw[at + 1] & 0x3f]
    at = np.flatnonzero((raw >= 0xe1) & (raw <= 0xe3))
    code = (raw[at] & 0x0f).astype(np.int64) << 12 | (raw[at + 1] & 0x3f).astype(np.int64) << 6 | raw[at + 2] & 0x3f
    kind[at] = kind[at + 1] = kind[at + 2] = _THREE_BYTES[code]
    cut = np.zeros(len(raw), bool)
    cut[1:] = _CUT[kind[:-1] << 3 | kind[1:]]
    alone = np.flatnonzero(kind == _BREAK) + 1       # behind a line break between two visible characters
    alone = alone[(alone > 1) & (alone < len(raw))]
    cut[alone[(kind[alone - 2] <= _MARK) & (kind[alone] <= _MARK)]] = True
    return cut


class Memory(dict):
    """chunk -> bytes; ``make`` fills it in on a miss. When it holds over ``most`` chunks, ``trim``
    lays them aside in place of those laid aside before; a chunk used again comes back from
    there. Only speed depends on it."""

    def __init__(self, make, most: int):
        super().__init__()
        self._make, self._most = make, most
        self._aside: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        value = self._aside.get(chunk)
        if value is None:
            value = self._make(chunk)
        self[chunk] = value
        return value

    def trim(self) -> None:
        if len(self) > self._most:
            self._aside = dict(self)
            self.clear()


class ChunkEncoder:
    """``encode`` gives the ids of a text as little-endian unsigned 32-bit integers.
    ``ids_of(piece)`` encodes a chunk that begins where a text or a safe space begins."""

    def __init__(self, ids_of, most: int = 450_000):
        self._ids_of = ids_of
        self._head = Memory(ids_of, most // 4)
        self._tail = Memory(self._behind, most)
        self._break = ids_of("\n")

    def _behind(self, chunk: str) -> bytes:
        if chunk[:1] == "\n":            # only from ``split``: a line break stands for the space
            return self._break + self._head[chunk[1:]]
        return self._ids_of(" " + chunk)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        parts = split(text)
        get = self._tail.__getitem__
        first = self._head[parts[0]]
        return b"".join((first, *map(get, parts[1:])))

    def get(self, chunk: str) -> bytes:
        """The ids of one chunk, with its leading space if it has one."""
        return self._tail[chunk[1:]] if chunk[:1] == " " else self._head[chunk]

    def trim(self) -> None:
        self._head.trim()
        self._tail.trim()

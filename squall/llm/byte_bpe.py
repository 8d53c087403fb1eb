"""Byte-level BPE by backtracking over longest matches, exact to the merge order of a rank file.

The token bytes, mapped to Latin-1, form an Aho-Corasick automaton that finds
all matches of a piece in one pass. The encoder walks the piece taking the
longest match; a token may follow another only if the two are compatible,
that is if merging their joined bytes by rank gives back the same two tokens
(worked out from their last merges and kept in memory by pair). If none fits, it steps back. A sequence whose
neighbours are all compatible is the sequence the merges give, so the first
complete one is the answer; each position is given up at most once.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squall.llm.common import alone, column, kept, map_arrow
from squall.llm.safe_chunks import ChunkEncoder
from squall.llm.words import slices


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BacktrackingBPE:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 450_000, most_pairs: int = 1_000_000):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        self._automaton = ahocorasick.Automaton()
        for b, r in ranks.items():
            self._automaton.add_word(b.decode("latin-1"), (len(b), r))
        self._automaton.make_automaton()
        self._pairs: dict[tuple[int, int], bool] = {}
        self._made_of: dict[int, tuple[int, int] | None] = {}
        self._most_pairs = most_pairs
        self._pieces = regex.compile(pattern).findall
        self._chunks = ChunkEncoder(self._chunk, most)

    def merge(self, piece: bytes, stop: int = 1) -> list[int]:
        """The definition: merge the neighbours of least rank, leftmost first, until none is left
        (or ``stop`` parts are)."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > stop:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
            if best == 1 << 62:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def last_merge(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes a token, (-1, -1) for a single byte, None for a token
        that merging its own bytes does not give."""
        if rank not in self._made_of:
            piece = self.token[rank]
            parts: tuple[int, int] | None = (-1, -1)
            if len(piece) > 1:
                before = self.merge(piece, stop=2)
                joined = len(before) == 2 and self.ranks.get(self.token[before[0]] + self.token[before[1]]) == rank
                parts = (before[0], before[1]) if joined else None
            self._made_of[rank] = parts
        return self._made_of[rank]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined bytes of two tokens gives the two tokens back."""
        pair = (left, right)
        known = self._pairs.get(pair)
        if known is None:
            known = self._pairs[pair] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        """Undo the merges of both tokens from the last to the first. At each moment ``a`` and
        ``b`` are the parts that meet; they merge with each other if that comes before the merge
        that takes ``a`` (on a tie the one further left is first) and not after the one that
        takes ``b``."""
        taken_a = taken_b = 1 << 62
        token, ranks = self.token, self.ranks
        while True:
            joined = ranks.get(token[a] + token[b])
            if joined is not None and joined < taken_a and joined <= taken_b:
                return False
            parts_a, parts_b = self.last_merge(a), self.last_merge(b)
            if parts_a is None or parts_b is None:
                return False
            made_a, made_b = (-1 if parts_a[0] < 0 else a), (-1 if parts_b[0] < 0 else b)
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                taken_a, a = a, parts_a[1]
            else:
                taken_b, b = b, parts_b[0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern; a piece that is itself a token is that token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, rank) in self._automaton.iter(piece.decode("latin-1")):
            matches[end - size + 1].append((size, rank))    # ends ascend, so the longest is last
        ids: list[int] = []
        starts: list[int] = []
        left = [len(m) for m in matches]     # candidates not tried yet on the way that led here
        dead = bytearray(n + 1)              # no valid rest begins here, after whatever token
        at = 0
        while at < n:
            k = left[at] = left[at] - 1
            if k < 0:
                # nothing fits at this place: step back and try a shorter token there
                if not ids:
                    return self.merge(piece)     # a table without all single bytes
                dead[at] = 1
                left[at] = len(matches[at])
                at = starts.pop()
                ids.pop()
                continue
            size, rank = matches[at][k]
            if dead[at + size] or (ids and not self.compatible(ids[-1], rank)) or (not ids and self.last_merge(rank) is None):
                continue
            ids.append(rank)
            starts.append(at)
            at += size
            if at < n:
                left[at] = len(matches[at])
        return ids

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in self._pieces(chunk):
            ids += self.encode_piece(piece.encode("utf-8"))
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return self._chunks.encode(text)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def trim(self) -> None:
        self._chunks.trim()
        if len(self._pairs) > self._most_pairs:
            self._pairs.clear()


@kept
def coder(path: str, most: int = 450_000) -> BacktrackingBPE:
    from public_tokenizers import PATTERN

    return BacktrackingBPE(read_ranks(path), PATTERN, most, 2 * most)


def encode_texts(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row: the ids of the whole text without special tokens. A null or empty
    text gives an empty list; repeated rows and null keys stay. No shuffle."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def encode(batches):
        bpe = coder(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [bpe.encode(t) for t in column(part, "text").to_pylist()]
                bpe.trim()
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([column(part, "key"), pa.ListArray.from_arrays(pa.array(offsets), flat)],
                                                 names=["key", "ids"])

    kind = dict(rows.dtypes)["key"]
    return map_arrow(rows, encode, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_ids(df: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data): the bytes of each list of ids; null for a null list."""
    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def decode(batches):
        bpe = coder(ranks_path)
        for batch in batches:
            data = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(data, pa.binary())], names=["key", "data"])

    kind = dict(rows.dtypes)["key"]
    return map_arrow(rows, decode, f"key {kind}, data binary").withColumnRenamed("key", key)


def round_trip(df: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text",
               most: int = 450_000) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, exact) of every row in one pass: the text is
    encoded, the ids decoded again, and both digested (ids as little-endian unsigned 32-bit
    integers); ``exact`` says whether the decoded bytes are the text's. Each worker keeps the ids of
    up to twice ``most`` chunks (about 0.2 KB each), which only saves time."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def both(batches):
        alone(coder)
        bpe = coder(ranks_path, most)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                n, first, second, exact = [], [], [], []
                for t in column(part, "text").to_pylist():
                    ids = bpe.encode(t)
                    data = bpe.decode(np.frombuffer(ids, "<u4"))
                    n.append(len(ids) // 4)
                    first.append(hashlib.sha256(ids).hexdigest())
                    second.append(hashlib.sha256(data).hexdigest())
                    exact.append(data == t.encode("utf-8"))
                    bpe.trim()
                yield pa.RecordBatch.from_arrays(
                    [column(part, "key"), pa.array(n, pa.int64()), pa.array(first, pa.string()),
                     pa.array(second, pa.string()), pa.array(exact, pa.bool_())],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256", "exact"])

    kind = dict(rows.dtypes)["key"]
    out = map_arrow(rows, both, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, exact boolean")
    return out.withColumnRenamed("key", key)

"""Token ids of a corpus as Parquet list columns in document order, and reading them back."""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squall.llm.common import column, map_arrow
from squall.llm.safe_chunks import cuts
from squall.llm.words import slices, utf8

#: Of the files: row groups and pages are small enough to read a few documents alone; the page
#: index (always written) finds them by doc_id; ids are dictionary-coded, offsets delta-coded.
FILE_OPTIONS = {
    "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(1 << 20), "parquet.page.row.count.limit": "20000",
    "parquet.dictionary.page.size": str(2 << 20), "parquet.enable.dictionary": "true",
}
#: One piece for sure: a run of Latin letters, of digits or of marks, maybe behind a space.
_PIECE = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
#: Bytes of text encoded at once, and characters of the longest chunk that is kept.
BLOCK, LONGEST = 4 << 20, 200


_ID = attrgetter("id")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself where it can be seen, else the
    next one from U+0100 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


class Known(dict):
    """chunk -> ids as bytes; ``make`` gives them on a miss. Long chunks are not kept, and when there
    are over ``most``, all but those just asked for go. Only speed depends on it."""

    def __init__(self, make, most: int):
        super().__init__()
        self._make, self._most = make, most

    def __missing__(self, chunk: str) -> bytes:
        ids = self._make(chunk)
        if len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def of(self, chunks: pa.LargeStringArray) -> pa.LargeListArray:
        """The ids of each chunk; each distinct one is asked for once."""
        chunks = chunks.dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [*map(self.__getitem__, distinct)]
        if len(self) > self._most:
            last = {c: self[c] for c in distinct if len(c) <= LONGEST}
            self.clear()
            self.update(last)
        ends = pa.array(np.cumsum([0, *map(len, ids)]) // 4)
        lists = pa.LargeListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<u4")))
        return lists.take(chunks.indices)


class LibraryEncoder:
    """Ids as the tokenizers library gives them. Each distinct chunk is encoded once as long as it
    is known: a single piece by the library's byte-level BPE model, any other chunk on the
    library's whole path. Texts that hold an added token are one chunk."""

    def __init__(self, path: str, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._tokenize = self._tokenizer.model.tokenize
        self._letters = _byte_letters()
        self._known = Known(self._chunk, most)

    def _library(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if _PIECE.fullmatch(chunk) is None or any(a in chunk for a in self._added):
            return self._library(chunk)
        if not chunk.isascii():
            chunk = chunk.encode().decode("latin-1").translate(self._letters)
        elif chunk[0] == " ":
            chunk = self._letters[32] + chunk[1:]
        return array("I", map(_ID, self._tokenize(chunk))).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text]))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin (and the end)."""
        raw, at = utf8(texts)
        if not len(raw):
            return np.zeros(0, "<u4"), np.zeros(len(at), np.int64)
        cut = cuts(raw)
        for added in self._added:
            for i in np.flatnonzero(pc.fill_null(pc.match_substring(texts, added), False)):
                cut[at[i]:at[i + 1]] = False
        cut[at[:-1][at[1:] > at[:-1]]] = True
        begin = np.flatnonzero(cut)
        chunks = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(raw))), pa.py_buffer(raw))
        lists = self._known.of(chunks)
        return np.asarray(lists.values), np.asarray(lists.offsets)[np.searchsorted(begin, at)]


@lru_cache(maxsize=2)
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_token_files(df: DataFrame, path: str, vocabulary: str, end_id: int = 2, key: str = "doc_id",
                      text: str = "text", partitions: int | None = None) -> None:
    """Encode every text and write ``path`` as Parquet: (shard, key, begin, n_tokens, ids).

    Files are in ascending order of the key: rows are range-partitioned and sorted by key (nulls
    first) and, for equal keys, by a hash of the text and the text, so equal keys never pile up in
    one task. ``shard`` numbers the files' partitions in that order and ``begin`` counts the ids of
    the partition before the row. ``end_id`` ends each document; an empty or null text has it
    alone. Repeated rows are written each time; other columns are not read."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie", "text").drop("tie")

    def encode(batches):
        from pyspark import TaskContext

        shard, begin = TaskContext.get().partitionId(), 0
        coder = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", BLOCK):
                flat, at = coder.encode_all(column(part, "text"))
                flat = pa.array(np.insert(flat, at[1:], end_id).astype(np.int32))
                offsets = at + np.arange(len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(part.num_rows, shard, np.int32)), column(part, "key"), pa.array(begin + offsets[:-1]),
                     pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)],
                    names=["shard", "key", "begin", "n_tokens", "ids"])
                begin += int(offsets[-1])

    kind = dict(rows.dtypes)["key"]
    out = map_arrow(rows, encode, f"shard int, key {kind}, begin long, n_tokens long, ids array<int>")
    out.withColumnRenamed("key", key).write.options(**FILE_OPTIONS).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as written; select columns and filter by key to read only their pages."""
    return spark.read.parquet(path)


def token_index(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, all from the files.

    ``n_tokens`` and the checksum come from the stored ids; ``start`` adds the totals of the
    earlier shards (one row a shard) to the offset in the shard."""
    files = read_tokens(spark, path)
    rows = files.select("shard", F.col(key).alias("key"), "begin", "ids")

    def check(batches):
        for batch in batches:
            ids = column(batch, "ids")
            at = np.asarray(ids.offsets)
            flat = np.asarray(ids.values).astype("<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "shard"), column(batch, "key"), column(batch, "begin"),
                 pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())],
                names=["shard", "key", "begin", "n_tokens", "ids_crc32"])

    kind = dict(rows.dtypes)["key"]
    docs = map_arrow(rows, check, f"shard int, key {kind}, begin long, n_tokens long, ids_crc32 long")
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    out = docs.join(F.broadcast(bases), "shard")     # one row a file partition, fixed by the writer
    return out.select(F.col("key").alias(key), (F.col("base") + F.col("begin")).alias("start"), "n_tokens",
                      "ids_crc32")

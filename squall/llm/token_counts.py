"""Token counts of whole texts with a SentencePiece model: Arrow batches in, lengths out."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squall.llm.common import column, map_arrow

BLANKS = " ▁"       # the model writes a space as U+2581, so both count as blanks


def safe_cut(text: str, at: int) -> int:
    """The first place at or after ``at`` of a single blank between two others characters that are
    not blanks, or -1. No piece of the model crosses it: no piece holds a blank behind another
    character (``cuts_safely``), and a cut-off rest gets the same blank back as the model's
    leading blank."""
    while True:
        at = text.find(" ", at)
        if at < 0 or at + 1 >= len(text):
            return -1
        if at and text[at - 1] not in BLANKS and text[at + 1] not in BLANKS:
            return at
        at += 1


def segments(text: str, most: int) -> list[str]:
    """A text in parts of about ``most`` characters that encode like the whole."""
    out, begin = [], 0
    while len(text) - begin > most:
        cut = safe_cut(text, begin + most)
        if cut < 0:
            break
        out.append(text[begin:cut])
        begin = cut + 1
    out.append(text[begin:])
    return out


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    cuts_safely = not any("▁" in p[1:] and p.strip("▁") for p in names) \
        and model.encode("a b") == model.encode("a") + model.encode("b")
    return model, cuts_safely


def count_batch(texts: list[str], path: str, segment_chars: int, batch_chars: int) -> np.ndarray:
    """Tokens of each text. The library gets batches of about ``batch_chars`` characters."""
    model, cuts_safely = _model(path)
    counts = np.zeros(len(texts), np.int64)
    batch, owner, size = [], [], 0

    def flush():
        nonlocal size
        if batch:
            lengths = [len(x) for x in model.encode(batch, num_threads=1)]
            np.add.at(counts, owner, lengths)
            batch.clear()
            owner.clear()
            size = 0

    for i, text in enumerate(texts):
        for part in segments(text, segment_chars) if cuts_safely else [text]:
            batch.append(part)
            owner.append(i)
            size += len(part)
            if size >= batch_chars:
                flush()
    flush()
    return counts


def token_counts(df: DataFrame, model_path: str, text: str = "text", key: str = "doc_id", limit: int = 4096,
                 segment_chars: int = 1 << 16, batch_chars: int = 1 << 18) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row.

    ``n_tokens`` is what the library counts for the whole text, without begin, end or other added
    tokens; strings that look like special tokens are ordinary text. Texts go to the library in
    batches of about ``batch_chars`` characters; texts over ``segment_chars`` are cut at places
    that no token crosses. A null or empty text has 0 bytes and 0 tokens; a null key is kept;
    repeated rows stay repeated; other columns are not read. No shuffle."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            texts = column(batch, "text").fill_null("")
            sizes = np.array([0] * len(texts), np.int64) if not len(texts) else \
                np.asarray(pa.compute.binary_length(texts), np.int64)
            for at in range(0, len(texts), 2000):
                part = texts.slice(at, 2000)
                n = count_batch(part.to_pylist(), model_path, segment_chars, batch_chars)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "key").slice(at, 2000), pa.array(sizes[at:at + 2000]), pa.array(n),
                     pa.array(n > limit)], names=["key", "n_bytes", "n_tokens", "over_limit"])

    kind = dict(rows.dtypes)["key"]
    out = map_arrow(rows, count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("key", key)

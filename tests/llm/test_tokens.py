"""Token counts, token files and byte-level BPE against their libraries."""
import base64
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from fixtures import EDGES, documents, empty, prose
from squall.llm import byte_bpe, token_counts, token_files
from squall.session import shared_dir

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


#: As many blanks other than space and line break as there are touching line breaks too many.
BLANKS = ["a\tb\tc\n\n", "id\tname\tvalue\n\n\nnext line", "a\u3000b\u3000c\n\n\nd", "a\u00a0b c\n\nd", "a\rb\rc\n\n\nd  e"]


def texts():
    r = random.Random(5)
    return [*EDGES, *BLANKS, *(prose(r, r.randint(1, 200)).capitalize() + ".\n" + prose(r, 20) for _ in range(40)), "x", "x"]


def test_token_counts_are_the_librarys(spark):
    got = {r["doc_id"]: r for r in token_counts.token_counts(documents(spark, texts()), PIECES, limit=100,
                                                             segment_chars=40, batch_chars=300).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, t in enumerate(texts()):
        n = len(model.encode(t or ""))
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 100)
    assert token_counts.token_counts(empty(spark), PIECES).collect() == []


def test_segments_cut_only_between_single_blanks():
    text = "ab  cd ▁ ef gh" * 50
    for most in (1, 5, 40):
        parts = token_counts.segments(text, most)
        assert " ".join(parts) == text and len(parts) > 1


def test_chunks_of_texts_of_any_blanks_give_the_librarys_ids():
    library = Tokenizer.from_file(VOCABULARY)
    coder = token_files.LibraryEncoder(VOCABULARY)
    ranks = byte_bpe.read_ranks(RANKS)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    bpe = byte_bpe.coder(RANKS)
    r = random.Random(11)
    mixed = ["".join(r.choice(["a", "be", "1", "'s", ".", "\u00e9", " ", " ", "\n", "\t", "\r", "\u00a0", "\u3000", "\x85", "\x1c"])
                     for _ in range(r.randint(1, 12))) for _ in range(5000)]
    for t in [*BLANKS, *mixed]:
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == other.encode_ordinary(t), t


#: Kinds of characters beside each other, among them letters and blanks of two and three bytes.
KINDS = ["a", "be", "Z", "1", "9", "\u0663", "\u00b2", "\u00bd", "'s", "'", "'re", ".", "$", "<", "|", "_", "-", "\u00bf", "\u00ab",
         "\u2014", "\u2019", "\u2026", "\u2044", "\u3001", "\u00e9", "\u00d7", "\u00f7", "\u00aa", "\u00b5", "\u017f", "\u0149", "\u03b1",
         "\u0301", "\u65e5", "\U0001f600", "\u200b", "\u00ad", "\x00", "\x7f", "\x1c", "\x1f", "\t", "\r", "\x0b", "\x85", "\u00a0",
         "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000", "<|endoftext|>", *" " * 8, *"\n" * 4]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_whole_batches_give_the_librarys_ids(kind):
    library = Tokenizer.from_file(VOCABULARY)
    coder = token_files.LibraryEncoder(VOCABULARY, most=50)
    r = random.Random(12)
    for _ in range(10):
        rows = [r.choice([None, ""]) if r.random() < 0.05 else "".join(r.choice(KINDS) for _ in range(r.randint(1, 14))) for _ in range(1000)]
        rows += EDGES + BLANKS
        flat, at = coder.encode_all(pa.array(["before", *rows, "after"], kind).slice(1, len(rows)))
        assert len(at) == len(rows) + 1 and at[0] == 0 and at[-1] == len(flat)
        for i, t in enumerate(rows):
            assert flat[at[i]:at[i + 1]].tolist() == library.encode(t or "", add_special_tokens=False).ids, t
    for rows in ([], [None], ["", None, ""]):
        flat, at = coder.encode_all(pa.array(rows, kind))
        assert len(flat) == 0 and at.tolist() == [0] * (len(rows) + 1)


def test_a_word_is_encoded_once_whatever_stands_beside_it():
    coder, made = token_files.LibraryEncoder(VOCABULARY), []
    for name in ("_tokenize", "_library"):
        def counted(piece, call=getattr(coder, name)):
            made.append(piece)
            return call(piece)
        setattr(coder, name, counted)
    rows = [f"{a}bakelo{b}nu." for a in ("", "\n", "no\n", "(", "1") for b in ("\n", ",\n", "$$$", ".", "...", "-", "/", "7", ") ")]
    library = Tokenizer.from_file(VOCABULARY)
    assert [np.frombuffer(coder.encode(t), "<u4").tolist() for t in rows] == [library.encode(t).ids for t in rows]
    assert sum("bakelo" in piece for piece in made) <= 2       # alone and behind a line break that begins a text


def test_known_chunks_are_bounded_and_long_ones_are_not_kept():
    asked = []
    known = token_files.Known(lambda chunk: asked.append(chunk) or np.array([len(chunk)], "<u4").tobytes(), 3)
    for rows in (["a", "bb", "a"], ["x" * 1000, "bb"], ["ccc", "dddd", "bb"], ["dddd", "a"]):
        got = known.of(pa.array(rows, pa.large_string()))
        assert got.to_pylist() == [[len(x)] for x in rows] and len(known) <= 4
    assert asked == ["a", "bb", "x" * 1000, "ccc", "dddd", "a"]


def test_token_files_hold_the_librarys_ids_in_key_order(spark):
    keys = [*range(100, 100 + len(texts()) - 2), None, 7]
    docs = documents(spark, texts(), keys).repartition(5)
    path = shared_dir(spark, "test-token-files")
    token_files.write_token_files(docs, path, VOCABULARY, end_id=2, partitions=4)
    library = Tokenizer.from_file(VOCABULARY)
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in zip(keys, texts(), strict=True)}
    stored = {r["doc_id"]: r["ids"] for r in token_files.read_tokens(spark, path).collect()}
    assert stored == ids
    start = 0
    got = {r["doc_id"]: r for r in token_files.token_index(spark, path).collect()}
    for k in sorted(ids, key=lambda k: (k is not None, k)):
        assert got[k]["start"] == start and got[k]["n_tokens"] == len(ids[k])
        assert got[k]["ids_crc32"] == zlib.crc32(np.array(ids[k], "<u4"))
        start += len(ids[k])


def test_token_files_are_selective_and_take_empty_and_repeated_rows(spark):
    path = shared_dir(spark, "test-token-files")
    token_files.write_token_files(empty(spark), path, VOCABULARY)
    assert token_files.token_index(spark, path).collect() == []
    path = shared_dir(spark, "test-token-files")
    token_files.write_token_files(documents(spark, ["a b", "a b", "c"], [1, 1, 2]), path, VOCABULARY)
    got = sorted(token_files.token_index(spark, path).select("doc_id", "start", "n_tokens").collect())
    assert [tuple(r) for r in got] == [(1, 0, 3), (1, 3, 3), (2, 6, 2)]
    plan = token_files.read_tokens(spark, path).where("doc_id = 2").select("n_tokens")._jdf.queryExecution().toString()
    assert "ids" not in plan.rsplit("ReadSchema", 1)[1] and "EqualTo(doc_id,2)" in plan


def test_byte_bpe_is_the_librarys_and_decodes_exactly(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = documents(spark, texts())
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(docs, RANKS).collect()}
    ids = byte_bpe.encode_texts(docs, RANKS)
    plain = {r["doc_id"]: r["ids"] for r in ids.collect()}
    data = {r["doc_id"]: bytes(r["data"]) for r in byte_bpe.decode_ids(ids, RANKS).collect()}
    for i, t in enumerate(texts()):
        expected = library.encode_ordinary(t or "")
        assert plain[i] == expected and data[i] == (t or "").encode()
        assert got[i]["n_tokens"] == len(expected) and got[i]["exact"]
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.round_trip(empty(spark), RANKS).collect() == []


@pytest.mark.parametrize("path", [RANKS, public_tokenizers.path("byte_bpe_50k.tiktoken")])
def test_backtracking_gives_what_the_merges_give(path):
    bpe = byte_bpe.coder(path)
    r = random.Random(9)
    tokens = list(bpe.ranks)
    for _ in range(4000):
        piece = b"".join(r.choice(tokens) for _ in range(r.randint(1, 4)))
        expected = [bpe.ranks[piece]] if piece in bpe.ranks else bpe.merge(piece)
        assert bpe.encode_piece(piece) == expected
    for _ in range(4000):
        a, b = bpe.ranks[r.choice(tokens)], bpe.ranks[r.choice(tokens)]
        assert bpe.compatible(a, b) == (bpe.merge(bpe.token[a] + bpe.token[b]) == [a, b])
    assert bpe.encode_piece(b"ab" * 2000) == bpe.merge(b"ab" * 2000)

"""Small tables for the subpackage's tests."""
import random

SYLLABLES = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu".split()


def word(r):
    return "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))


def prose(r, n):
    return " ".join(word(r) for _ in range(n))


def changed(r, text, n):
    """``text`` with n of its words replaced."""
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = word(r) + "x"
    return " ".join(words)


EDGES = ["", None, " ", "\n", "a", " a", "a ", "a  b\n\n c \t d", "it's they're 12345 !!??", "<|endoftext|> x<|endoftext|>",
         "<s> x </s>", "日本語 テキスト x  y", "a\x1c b \x85c", "😀😀 x", "a ▁b ▁▁ c", "\r\n\r\n  hello\r\n", "é ́x ñ Ñ",
         "'S 'LL 's 'll", "﻿a ﻿ b", "a\n b\n\n c", "x" * 3000, "ab " * 3000, "ÀÉ\nÖß.\nx,", "\x00 a\x00b", "a b  c"]


def documents(spark, texts, keys=None):
    """Documents with a few clashing columns more."""
    keys = list(range(len(texts))) if keys is None else keys
    rows = [(k, t, "en", f"s{i % 3}", len(t or ""), "clash", 7, 0.5, "row") for i, (k, t) in enumerate(zip(keys, texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, "
                                       "token long, score double, row string")


def empty(spark):
    return documents(spark, [])

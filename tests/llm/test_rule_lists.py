import random
import re

from fixtures import EDGES, documents, empty, prose
from pyspark.sql import functions as F

from squall.llm import rule_lists as rl


def counts_of(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def test_counts_against_brute_force(spark):
    r = random.Random(1)
    loops = [prose(r, 3) + " " + " ".join(["one two three four five"] * n) + " " + prose(r, 2) for n in range(5)]
    texts = [*EDGES, *loops, "a b c a b c a b c", "x\nx\n x\n\n\nx\ry\nx", "# * $ % & | < > é|", "a b c d e a b c d e",
             *(" ".join(r.choice("ab") for _ in range(40)) for _ in range(20))]
    got = {row["key"]: tuple(row[c] for c in rl.COUNTS) for row in rl.statistics(documents(spark, texts)).collect()}
    assert got == {i: counts_of(t) for i, t in enumerate(texts)}


def test_a_long_text_at_once():
    text = " ".join(f"w{i % 50000} x" for i in range(500_000))
    n, chars, _, _, repeats = rl.statistics_of(text.encode())[0]
    assert (n, chars) == (1_000_000, len(text) - 999_999)
    assert repeats == 1_000_000


def poor_and_good(spark):
    """Poor texts shout or are full of bars; a tenth of the labels is wrong in neither class."""
    r = random.Random(2)
    texts, labels = [], []
    for i in range(600):
        kind = i % 3
        text = prose(r, r.randint(20, 60))
        if kind == 1 and i % 2:
            text = " | ".join(text.split(" "))
        elif kind == 1:
            text = "!! ".join(text.upper().split(" "))
        texts.append(text)
        labels.append((i, 0 if kind == 1 else 1))
    return documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int")


def test_the_list_finds_what_labels_reject(spark):
    docs, labels = poor_and_good(spark)
    found, rules = rl.quality_rules(docs, labels)
    rows = found.join(labels, "doc_id").collect()
    assert 1 <= len(rules.rules) <= 4
    assert all(1 <= len(rule) <= 4 for rule in rules.rules)
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 100
    assert all(r["kept"] == (r["quality"] == 1) for r in held)
    assert all((r["reason"] is None) == r["kept"] for r in rows)
    said = {" and ".join(map(str, rule)) for rule in rules.rules}
    assert {r["reason"] for r in rows} <= said | {None, "base"}
    # the list is a plain ordered expression
    again = found.select("kept", (rules.column().isNull() & ~F.col("base_failed")).alias("own"))
    assert again.where("kept <> own").count() == 0


def test_edges(spark):
    docs, labels = poor_and_good(spark)
    rows, rules = rl.quality_rules(empty(spark), labels)
    assert rows.collect() == []
    assert rules.rules == []
    one_class, rules = rl.quality_rules(documents(spark, [prose(random.Random(3), 30), None, ""], [1, None, 2]),
                                        labels.where("quality = 1"))
    assert rules.rules == []
    got = {r["doc_id"]: (r["n_words"], r["base_failed"], r["kept"]) for r in one_class.collect()}
    assert got == {1: (30, False, True), None: (0, True, False), 2: (0, True, False)}

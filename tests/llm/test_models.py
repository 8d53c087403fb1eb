"""Toxicity and quality: held-out accuracy, and defined results for edge tables."""
import random
import zlib

import numpy as np
import pyarrow as pa

from fixtures import EDGES, documents, empty, prose
from squall.llm import quality, toxicity

BAD = ["grobzak", "vilenot", "ruxom"]


def held_out(k):
    return zlib.crc32(str(k).encode()) % 3 == 1


def labelled(spark, n=900):
    """Documents with made-up insults in a sixth and junk in another sixth, and their labels."""
    r = random.Random(11)
    texts, toxic, good = [], [], []
    for i in range(n):
        words = prose(r, r.randint(30, 120)).split(" ")
        toxic.append(int(i % 6 == 0))
        good.append(int(i % 6 != 3))
        if toxic[-1]:
            for _ in range(r.randint(2, 6)):
                words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "en", "ix"]))
        text = " ".join(words)
        if not good[-1]:
            text = "\n".join([" ".join(w + "###" for w in words[:12])] * 6)
        texts.append(text)
    rows = [(i, q, t) for i, (q, t) in enumerate(zip(good, toxic, strict=True))]
    labels = spark.createDataFrame([*rows, (None, 1, 1), (10 ** 9, 0, 1), (5, None, None)],
                                   "doc_id long, quality int, toxic int")
    return texts, toxic, good, labels


def test_toxicity_on_held_out_rows_and_edges(spark):
    texts, toxic, _, labels = labelled(spark)
    docs = documents(spark, [*texts, *EDGES, texts[0]], [*range(len(texts)), *range(5000, 5000 + len(EDGES)), None])
    got = toxicity.toxicity_scores(docs, labels).collect()
    assert len(got) == len(texts) + len(EDGES) + 1
    by_key = {x["doc_id"]: x for x in got}
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got)
    assert all(x["held_out"] == (x["doc_id"] is not None and held_out(x["doc_id"])) for x in got)
    held = [i for i in range(len(texts)) if held_out(i)]
    right = np.mean([by_key[i]["predicted"] == toxic[i] for i in held])
    caught = np.mean([by_key[i]["predicted"] for i in held if toxic[i]])
    assert right > 0.97 and caught > 0.9
    assert by_key[5000]["score"] == by_key[5001]["score"] and by_key[5000]["predicted"] == 0
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    bad = {x["doc_id"] for x in got if x["predicted"] and x["doc_id"] is not None}
    assert {x["doc_id"] for x in kept.collect()} - {None} == by_key.keys() - bad - {None}


def test_labels_of_held_out_rows_and_other_columns_change_no_score(spark):
    texts, _, _, labels = labelled(spark, 300)
    other = labels.selectExpr("doc_id", "quality", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic) as toxic")
    scores = [{x["doc_id"]: x["score"] for x in toxicity.toxicity_scores(d, l).collect()} for d, l in
              ((documents(spark, texts), labels), (documents(spark, texts).selectExpr("doc_id", "text", "'xx' lang"), other))]
    assert scores[0] == scores[1]


def test_features_of_obfuscated_insults_and_second_persons():
    none = (np.zeros(0, np.uint64), np.zeros(0))
    rows = toxicity.features_of(pa.array(["You are an id1ot", "an idiot", "a $tupid IDIOT!!!", "calm words", None, ""]), *none)
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    assert rows[0, at["insults"]] > 0 and rows[0, at["near_second_person"]] == 1 and rows[0, at["obfuscated"]] > 0
    assert rows[1, at["insults"]] > 0 and rows[1, at["near_second_person"]] == 0
    assert rows[2, at["insult_density"]] == 2 / 3 and rows[2, at["capital_words"]] > 0
    assert rows[3, at["insults"]] == 0 and not rows[4:].any()


def test_one_class_or_no_rows_give_the_share_of_labels(spark):
    docs = documents(spark, ["a", "b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x["score"] for x in toxicity.toxicity_scores(docs, none).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, none).count() == 3
    assert quality.drop_poor(docs, none).count() == 3
    clean = spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(docs, clean).count() == 3 and quality.drop_poor(docs, clean).count() == 3
    _, _, _, labels = labelled(spark, 60)
    assert toxicity.toxicity_scores(empty(spark), labels).collect() == []
    assert quality.quality_scores(empty(spark), labels).collect() == []


def test_quality_on_held_out_rows_and_edges(spark):
    texts, _, good, labels = labelled(spark)
    docs = documents(spark, [*texts, *EDGES], [*range(len(texts)), None, *range(5000, 4999 + len(EDGES))])
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(texts) + len(EDGES)
    by_key = {x["doc_id"]: x for x in got}
    held = [i for i in range(len(texts)) if held_out(i)]
    assert all(by_key[i]["predicted"] == 1 for i in held if good[i])
    assert np.mean([by_key[i]["predicted"] == good[i] for i in held]) > 0.97
    kept = quality.drop_poor(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(x["doc_id"] for x in kept.where("doc_id < 5000").collect()) == \
        [i for i in range(len(texts)) if by_key[i]["predicted"]]


def test_sparse_sites_are_drawn_to_their_hosts_and_hosts_to_the_whole(spark):
    r = random.Random(2)
    rows = []
    for host, rate in (("good", 0.95), ("bad", 0.2), ("middle", 0.6)):
        for path, n in (("large", 400), ("small", 2)):
            rows += [(host, path, 1.0 if r.random() < rate else 0.0) for _ in range(n)]
    rows.append(("new", "new", 0.0))
    got = {(x["host"], x["path"]): x for x in
           quality.site_rates(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    own = {h: np.mean([e for a, p, e in rows if a == h and p == "large"]) for h in ("good", "bad", "middle")}
    assert all(abs(got[h, "large"]["path_rate"] - own[h]) < 0.03 for h in own)
    assert all(abs(got[h, "small"]["path_rate"] - got[h, "small"]["host_rate"]) < 0.15 for h in own)
    assert 0.1 < got["new", "new"]["host_rate"] < 0.6
    assert got["bad", "large"]["host_rate"] < got["middle", "large"]["host_rate"] < got["good", "large"]["host_rate"]

"""The pipeline's stages on a small table with every kind of case planted, and the registration."""
import random

import duckdb
import public_tokenizers
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from fixtures import changed, documents, prose
from squall.llm import byte_bpe
from squall.llm.common import pinned


def test_queries_are_registered_once_for_each_operator():
    names = list(entry.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "decontamination", "encoding"]


def test_the_jaccard_join_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    expected = con.execute(entry.oracle_sql()["op6_ngram_join"]).fetchall()
    got = entry.queries()["op6_ngram_join"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def corpus(spark, path):
    r = random.Random(21)
    clean = [prose(r, r.randint(60, 150)).capitalize() + "." for _ in range(400)]
    toxic = []
    for _ in range(120):
        words = prose(r, 80).split(" ")
        for _ in range(5):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "scum", "moron"]))
        toxic.append(" ".join(words))
    junk = ["\n".join([" ".join(w + "&&&" for w in prose(r, 9).split(" "))] * 5) for _ in range(120)]
    items = [prose(r, n) for n in (20, 40, 55)]
    leaks = [f"{prose(r, 50)} {item} {prose(r, 50)}" for item in items]
    copies = [clean[0], clean[1], changed(r, clean[2] + " " + clean[3], 1), clean[2] + " " + clean[3]]
    texts = [*clean, *toxic, *junk, *leaks, *copies, None, ""]
    kind = ["clean"] * 400 + ["toxic"] * 120 + ["junk"] * 120 + ["leak"] * 3 + ["copy", "copy", "first", "copy"] + ["none"] * 2
    labels = [(i, int(k != "junk"), int(k == "toxic")) for i, k in enumerate(kind) if k in ("clean", "toxic", "junk")]
    documents(spark, texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return texts, kind


def test_each_stage_takes_out_its_cases_and_keeps_the_rest(spark, tmp_path):
    texts, kind = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left, columns = set(range(len(texts))), docs.columns
    gone = {"toxicity": {"toxic"}, "quality": {"junk"}, "near_copies": {"copy"}, "decontamination": {"leak"}}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = pinned(stage(spark, docs, str(tmp_path)), "test-stage")
        assert docs.columns == columns
        now = {x["doc_id"] for x in docs.select("doc_id").collect()}
        out, expected = left - now, {i for i in left if kind[i] in gone[name]}
        assert now <= left and len(out ^ expected) <= 0.03 * len(expected) + (2 if name == "quality" else 0), (name, out ^ expected)
        assert not {i for i in out if kind[i] in ("clean", "first")}
        left = now
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {x["doc_id"]: x for x in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()}
    assert got.keys() == left
    assert all(x["n_tokens"] == len(library.encode_ordinary(texts[i] or "")) and x["exact"] for i, x in got.items())
    assert {x["doc_id"] for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left

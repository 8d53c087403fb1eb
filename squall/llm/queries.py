"""The subpackage's registered queries: each applies its operator to the whole of its table."""

from __future__ import annotations

import public_tokenizers

from squall.llm import (byte_bpe, conversations, decontaminate, licenses, neighbours, ngram_join, phrases, quality, rule_lists, shards,
                        token_counts, token_files, toxicity)
from squall.llm.common import shared_dir, table

QUERIES = {}


def query(name):
    def add(f):
        QUERIES[name] = f
        return f

    return add


@query("op3_token_counts")
def token_counts_query(spark, sf_dir):
    """Tokens of every document under the 32k SentencePiece model."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_token_files")
def token_files_query(spark, sf_dir):
    """Documents encoded, written as Parquet list columns in doc_id order and read back."""
    path = shared_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.token_index(spark, path)


@query("op7_sharding")
def sharding_query(spark, sf_dir):
    """Every document dealt to one of 40 shards of nearly equal bytes."""
    return shards.shard_documents(table(spark, sf_dir, "documents"), 40)


@query("op10_byte_bpe")
def byte_bpe_query(spark, sf_dir):
    """Every document encoded by the 50k multilingual ranks and decoded again."""
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"),
                               public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op1_decontamination")
def decontamination_query(spark, sf_dir):
    """Documents with a window that matches a benchmark item, and where."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_toxicity")
def toxicity_query(spark, sf_dir):
    """Toxicity of every document, learned from the labels that are not held out."""
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_quality")
def quality_query(spark, sf_dir):
    """Quality of every document; sources are the hosts and their languages the paths."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_license_scan")
def license_scan_query(spark, sf_dir):
    """License texts and notices in every document."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op5_neighbours")
def neighbours_query(spark, sf_dir):
    """The 20 nearest of every twentieth embedding among all others."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), 20, 20)


@query("op6_ngram_join")
def ngram_join_query(spark, sf_dir):
    """Components of documents that share 90 % of their three-word shingles."""
    return ngram_join.join_components(table(spark, sf_dir, "documents"), size=3, percent=90)


@query("op11_conversation_repair")
def conversation_repair_query(spark, sf_dir):
    """Faults and cheapest repair of every conversation, after the damage that the contract names."""
    return conversations.repair_report(table(spark, sf_dir, "conversations"))


@query("op12_quality_rules")
def quality_rules_query(spark, sf_dir):
    """Statistics of every document and the verdict of the decision list learned from the labels."""
    return rule_lists.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


@query("op13_phrases")
def phrases_query(spark, sf_dir):
    """The 2,000 firmest phrases of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))

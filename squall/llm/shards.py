"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a vector of ``k`` sums. Differencing takes the two
partial partitions with the largest spread (largest minus smallest sum) and
adds one's sums in falling to the other's in rising order, until one is left.

Groups are taken by size, the largest first, in classes a factor apart. The
groups of a class are differenced in parallel buckets; each bucket starts with
its equal share of the sums that the larger groups have made, as one more
partial partition, so that smaller groups fill what larger ones left uneven.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squall.llm.common import pinned, ship
from squall.operators.blocks import global_position

#: A bucket's groups at most, about; the first class has groups of at least the total through this.
GROUPS_PER_BUCKET = 10_000
#: How much smaller the groups of each next class can be.
FACTOR = 64


def difference(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Differencing of partial partitions, each a vector of k sums in falling order.

    Returns the last partition's sums in falling order and, for each input, the place there that
    each of its sums went to (one row an input)."""
    n, k = len(vectors), len(vectors[0])
    sums = list(vectors)
    heap = [(-int(v[0] - v[-1]), i) for i, v in enumerate(vectors)]
    heapq.heapify(heap)
    made: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        added = sums[a] + sums[b][::-1]
        order = np.argsort(-added, kind="stable")
        made.append((a, b, order))
        sums.append(added[order])
        sums[a] = sums[b] = None
        heapq.heappush(heap, (-int(sums[-1][0] - sums[-1][-1]), len(sums) - 1))
    places: list = [None] * len(sums)
    places[-1] = np.arange(k)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = made[node - n]
        here = np.empty(k, dtype=np.int64)
        here[order] = places[node]
        places[a], places[b], places[node] = here, here[::-1], None
    return sums[-1], np.stack(places[:n])


def _deal(start: list[int]):
    """Difference one bucket's groups with the sums ``start``; a group goes where the shard of that
    place in ``start`` went."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("group").reset_index(drop=True)
        order = np.argsort(-np.array(start), kind="stable")
        vectors = [np.array(start, dtype=np.int64)[order]]
        for size in rows["size"].to_numpy():
            v = np.zeros(len(start), dtype=np.int64)
            v[0] = size
            vectors.append(v)
        _, places = difference(vectors)
        shard_at = np.empty(len(start), dtype=np.int32)
        shard_at[places[0]] = order
        return pd.DataFrame({"group": rows["group"], "size": rows["size"], "shard": shard_at[places[1:, 0]]})

    return run


def balanced_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(group, size, shard) for a table (group string, size long) with one row a group and sizes
    over 0: shards of nearly equal total size.

    A class ends at a size that its bucket's share of a shard exceeds several times, so a bucket
    can even out any of its groups; only a group larger than a shard's share cannot be."""
    ship(groups.sparkSession)
    count, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    sums, below, least, out = [0] * shards, None, total / GROUPS_PER_BUCKET, None
    while out is None or count:
        rest = groups if below is None else groups.where(F.col("size") < below)
        some = rest if count <= GROUPS_PER_BUCKET else rest.where(F.col("size") >= least)
        n = some.count()
        if n or out is None:
            buckets = max(1, -(-n // GROUPS_PER_BUCKET))
            bucket = F.pmod(F.xxhash64("group"), F.lit(buckets))
            dealt = pinned(some.groupBy(bucket.alias("bucket")).applyInPandas(
                _deal([s // buckets for s in sums]), "group string, size long, shard int"), "shard-class")
            for r in dealt.groupBy("shard").agg(F.sum("size").alias("size")).collect():
                sums[r["shard"]] += r["size"]
            out = dealt if out is None else out.unionByName(dealt)
        count, below, least = count - n, least, least / FACTOR
    return out


def shard_documents(df: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row, law ``bytes``.

    ``size`` is the UTF-8 length of the text plus 16; a null text counts as an empty one (size 16,
    checksum 0). Rows with equal texts form one indivisible group, so a group of more bytes than
    an even share makes its shard larger. ``slot`` numbers each shard's rows from 0 by key (nulls
    first; equal keys by checksum); repeated rows each get a slot of their own. ``grown_shard``
    is null: the byte law deals anew when the number of shards changes. Groups holding over a
    thousandth of all rows (so at most a thousand) are looked up by broadcast, which keeps their
    rows out of the shuffle; the rest join by key."""
    words = F.coalesce(F.col(text), F.lit(""))
    rows = pinned(df.select(F.col(key).alias("key"), (F.octet_length(words) + 16).cast("long").alias("size"),
                            F.crc32(words).alias("text_crc32"), F.sha2(words, 256).alias("group")), "shard-rows")
    groups = pinned(rows.groupBy("group").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")),
                    "shard-groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = pinned(groups.drop("size").join(balanced_groups(groups.select("group", "size"), shards).drop("size"), "group")
                    .select("group", "shard", (F.col("n") * 1000 > total).alias("hot")), "shard-placed")
    hot = F.broadcast(placed.where("hot").select("group", F.col("shard").alias("hot_shard")))
    marked = rows.join(hot, "group", "left")
    dealt = marked.where("hot_shard is not null").select("key", "size", "text_crc32",
                                                         F.col("hot_shard").alias("shard")) \
        .unionByName(marked.where("hot_shard is null").join(placed.where("not hot"), "group")
                     .select("key", "size", "text_crc32", "shard"))
    at = global_position(dealt, ["shard", "key", "text_crc32"], pos="at")
    counts = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))       # one row a shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return at.join(F.broadcast(starts), "shard").select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""Approximate nearest neighbours by largest inner product over shifted space-filling curves.

Vectors get one more component that makes all lengths equal, so that the
largest inner product is the least distance. Each curve projects them onto
its own random directions, shifts the grid and numbers the cells along a
Hilbert curve. Spark range-partitions the vectors by (curve, key); a query is
compared with all vectors of the key blocks its window reaches on each curve.
The window's width is fitted on a bounded sample of queries, whose true
neighbours are found by brute force over all rows.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squall.llm.common import column, map_arrow, pinned, ship
from squall.operators.blocks import global_position

CURVES, DIMENSIONS, BITS = 4, 8, 8
#: Bounds: vectors that fit the grids, queries that fit the window, rows of a block.
SAMPLE, SAMPLE_QUERIES = 5_000, 256
LEAST_BLOCK, MOST_BLOCK = 1024, 1 << 17
RECALL = 0.96


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (rows of unsigned coordinates) along the Hilbert curve."""
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(len(x)):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(b)) & one)
    return key


class Curves:
    """Directions, shifts and grid ranges of all curves."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int, dimensions: int, bits: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        width = sample.shape[1] + 1
        dimensions = min(dimensions, width)
        self.longest, self.bits, self.curves = longest, bits, curves
        self.directions, self.low, self.step = [], [], []
        data = self.lift(sample)
        for _ in range(curves):
            axes = np.linalg.qr(draw.standard_normal((width, dimensions)))[0]
            at = data @ axes
            low, high = at.min(axis=0), at.max(axis=0)
            span = np.maximum(high - low, 1e-12)
            # the grid is up to a quarter wider than the data, and shifted by what is left over
            step = span * 1.25 / (1 << bits)
            self.directions.append(axes)
            self.low.append(low - draw.random(dimensions) * span * 0.25)
            self.step.append(step)

    def lift(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        length = np.linalg.norm(vectors, axis=1)
        if query:
            return np.column_stack([vectors / length[:, None], np.zeros(len(vectors))])
        rest = np.sqrt(np.maximum(0.0, 1.0 - (length / self.longest) ** 2))
        return np.column_stack([vectors / self.longest, rest])

    def key(self, vectors: np.ndarray, curve: int, query: bool) -> np.ndarray:
        """Signed keys in the order of the curve."""
        at = self.lift(vectors, query) @ self.directions[curve]
        cells = np.clip((at - self.low[curve]) / self.step[curve], 0, (1 << self.bits) - 1)
        return (hilbert_key(cells, self.bits) ^ np.uint64(1 << 63)).view(np.int64)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of equal length as rows, in double precision."""
    flat = np.asarray(vectors.flatten(), np.float64)
    return flat.reshape(len(vectors), -1)


def _best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query row, id, score) of the k best vectors of each query; ties to the smaller id. Scores of
    those kept are summed anew in one fixed order, so equal vectors score equally."""
    out = []
    spare = min(len(ids), k + 8)
    for begin in range(0, len(queries), 256):
        q = queries[begin:begin + 256]
        rough = q @ vectors.T
        some = np.argpartition(-rough, spare - 1, axis=1)[:, :spare]
        least = np.take_along_axis(rough, some, axis=1).min(axis=1)
        for r in range(len(q)):
            mine = some[r]
            level = np.flatnonzero(rough[r] >= least[r] - 1e-9 * (1 + abs(least[r])))   # ties at the edge
            if len(level) > len(mine):
                mine = level
            score = (vectors[mine] * q[r]).sum(axis=1)
            first = np.lexsort((ids[mine], -score))[:k]
            out.append((np.full(len(first), begin + r), ids[mine][first], score[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """One row for each key with a vector of the commonest length, without null or non-finite
    components and not zero."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")) \
        .where("id is not null and vector is not null").where(~bad).where(F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows")) \
        .orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("vector") == (lengths[0]["n"] if lengths else 0)) \
        .groupBy("id").agg(F.min("vector").alias("vector"))


def exact_neighbours(queries: np.ndarray, rows: DataFrame, k: int) -> DataFrame:
    """(query, id, score): the k best of all rows (id, vector) for each given query vector."""
    def search(batches):
        for batch in batches:
            if batch.num_rows:
                q, i, s = _best(queries, np.asarray(column(batch, "id")), matrix(column(batch, "vector")), k)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(i), pa.array(s)],
                                                 names=["query", "id", "score"])

    found = map_arrow(rows, search, "query int, id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def _keyed(rows: DataFrame, curves: Curves) -> DataFrame:
    """Rows (id, is_query, vector) once for each curve with their key there."""
    def keys(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(column(batch, "vector"))
            query = np.asarray(column(batch, "is_query").to_pylist(), dtype=bool)
            for c in range(curves.curves):
                key = np.empty(len(vectors), np.int64)
                key[query] = curves.key(vectors[query], c, True) if query.any() else 0
                key[~query] = curves.key(vectors[~query], c, False) if (~query).any() else 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(vectors), c, np.int32)), pa.array(key), column(batch, "id"),
                     column(batch, "is_query"), column(batch, "vector")],
                    names=["curve", "key", "id", "is_query", "vector"])

    return map_arrow(rows, keys, "curve int, key long, id long, is_query boolean, vector array<double>")


def nearest(df: DataFrame, k: int = 20, every: int = 20, key: str = "vec_id", vector: str = "embedding",
            curves: int = CURVES, recall: float = RECALL, sample_queries: int = SAMPLE_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose key is divisible by
    ``every``, by largest inner product in double precision; ties to the smaller key.

    Candidates are all rows but the query's own. Rows with a null key, or a vector that is null,
    zero, of another length than most, or holds null or non-finite components, take no part; rows
    with the same key count once. Equal vectors are one point of the curves with its k + 1
    smallest keys, so copies neither crowd a window nor lose a place. The window is as wide as
    the share ``recall`` of the sample's true neighbours needs on their best curve."""
    spark = df.sparkSession
    ship(spark)
    rows = pinned(_usable(df, key, vector), "neighbour-rows")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    longest = rows.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    if longest is None:
        return empty
    # equal vectors: the point is named by its smallest key
    of_vector = Window.partitionBy("vector").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(of_vector)).where(F.col("n") <= k + 1)
    points = pinned(few.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("members"))
                    .select(F.element_at("members", 1).alias("id"), "vector", "members"), "neighbour-points")
    asked = pinned(rows.where(F.col("id") % every == 0).alias("q").join(points.alias("p"), "vector")
                   .select(F.col("q.id").alias("query_id"), F.col("p.id").alias("point")), "neighbour-queries")
    askers = asked.select(F.col("point").alias("id")).distinct()
    n = points.count()
    order = F.xxhash64(F.lit("sample"), "id")
    sample = np.array([r[0] for r in points.orderBy(order).limit(SAMPLE).select("vector").collect()])
    fitted = Curves(sample, float(longest), curves, DIMENSIONS, BITS)
    both = points.select("id", F.lit(False).alias("is_query"), "vector") \
        .unionByName(points.join(askers, "id").select("id", F.lit(True).alias("is_query"), "vector"))
    placed = global_position(_keyed(both, fitted), ["curve", "key", "is_query", "id"], pos="place")
    placed = pinned(placed.select("curve", "place", "id", "is_query", "vector"), "neighbour-places")

    # the window: how far the sample's true neighbours lie from their query on the nearest curve
    some = points.join(askers, "id").orderBy(order).limit(sample_queries).select("id", "vector").collect()
    if not some:
        return empty
    names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(some)], "query int, asker long")
    truth = exact_neighbours(np.array([r["vector"] for r in some]), points.select("id", "vector"), k + 1) \
        .join(F.broadcast(names), "query").where("id != asker")           # sample_queries * (k + 1) rows
    at = placed.select("curve", "place", "id", "is_query")
    near = at.where("not is_query").join(F.broadcast(truth.select("id", "asker")), "id") \
        .join(F.broadcast(at.where("is_query").join(F.broadcast(names.select(F.col("asker").alias("id"))), "id")
                          .select("curve", F.col("place").alias("from"), F.col("id").alias("asker"))),
              ["curve", "asker"]) \
        .groupBy("asker", "id").agg(F.min(F.abs(F.col("place") - F.col("from"))).alias("steps")).collect()
    window = int(np.quantile([r["steps"] for r in near], recall)) + 1 if near else n
    block = int(min(MOST_BLOCK, max(LEAST_BLOCK, window)))

    data = placed.where("not is_query").select("curve", F.floor(F.col("place") / block).alias("block"), "id", "vector")
    reach = F.sequence(F.floor((F.col("place") - window) / block), F.floor((F.col("place") + window) / block))
    asks = placed.where("is_query").select("curve", F.explode(reach).alias("block"), "id", "vector")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"asker": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "score": np.zeros(0)})
        q, i, s = _best(np.stack(right["vector"]), left["id"].to_numpy(), np.stack(left["vector"]), k + 1)
        return pd.DataFrame({"asker": right["id"].to_numpy()[q], "id": i, "score": s})

    found = data.groupBy("curve", "block").cogroup(asks.groupBy("curve", "block")) \
        .applyInPandas(compare, "asker long, id long, score double")
    # merge the windows of all curves, then put each point's members in its place
    merged = found.groupBy("asker", "id").agg(F.max("score").alias("score"))
    first = Window.partitionBy("asker").orderBy(F.desc("score"), "id")
    kept = merged.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    members = kept.join(points.select("id", "members"), "id") \
        .select("asker", "score", F.explode("members").alias("vec_id"))
    first = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    lists = members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1) \
        .groupBy("asker").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    own = F.filter("best", lambda x: x["vec_id"] != F.col("query_id"))
    return asked.join(lists, F.col("point") == F.col("asker")) \
        .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("at", "best")) \
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("best.vec_id").alias("vec_id"),
                F.col("best.score").alias("score"))

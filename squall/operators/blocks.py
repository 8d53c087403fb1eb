"""Split long series into time blocks and stitch them back exactly.

A window ``partitionBy(series).orderBy(ts)`` puts a whole series into one task;
a hot series (a third of all rows) would then run on one core and may not fit
in its memory.  Every per-series operator in this package instead runs its
window over ``(series, block)`` where ``block`` is a bucket of time, and
repairs what crosses a block border with a tiny per-block summary:

* **carries** (unbounded reach: last value before, first value after, run
  starts, running maxima) — aggregate each block to one row, scan those
  summary rows with a small window, join the result back on
  ``(series, block)``.  The summary has one row per block, so it is a few
  thousand rows even for years of data; Spark/AQE broadcasts it when its
  measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and falls
  back to a sort-merge join otherwise.
* **positions + halo** (bounded reach of ``k`` rows: lags, rolling windows,
  leads, sequences) — a global row position per series from per-block counts,
  then fixed-size *position* blocks; the last ``back`` rows of each position
  block are copied into the next one (and the first ``fwd`` rows into the
  previous one), so every window frame is complete inside its block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squall.functions.timecols import time_block

BLK = "_blk"
POS = "_pos"
DEFAULT_BLOCK_SECONDS = 7 * 24 * 3600
DEFAULT_BLOCK_ROWS = 200_000


def with_block(df: DataFrame, ts: str, seconds: int = DEFAULT_BLOCK_SECONDS,
               name: str = BLK) -> DataFrame:
    return df.withColumn(name, time_block(ts, seconds))


def block_window(keys: Sequence[str], order: Sequence[str], block: str = BLK):
    return Window.partitionBy(*keys, block).orderBy(*order)


def summary_window(keys: Sequence[str], block: str = BLK):
    w = Window.orderBy(block)
    return Window.partitionBy(*keys).orderBy(block) if keys else w


def carry_join(df: DataFrame, summary: DataFrame, keys: Sequence[str],
               block: str = BLK) -> DataFrame:
    """Attach per-block carry columns.  Summary has one row per block.  The
    join is null-safe, so readings without a series key form a series of
    their own."""
    right = summary.withColumnsRenamed({c: f"_s_{c}" for c in [*keys, block]})
    on = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in [*keys, block]]
    return df.join(right, on, "left").drop(*[f"_s_{c}" for c in [*keys, block]])


def global_position(df: DataFrame, order: Sequence[str], partitions: int | None = None,
                    pos: str = POS) -> DataFrame:
    """0-based position of every row in the global ``order`` (which must be
    unique), balanced whatever the key distribution.

    ``repartitionByRange`` picks partition boundaries from a sample of the
    order key, so every partition holds a similar number of rows even when
    many rows share a time.  The range-partitioned, sorted table is pinned
    with a reliable checkpoint (partition ids must not move on recompute);
    then position = rows in earlier partitions + index inside the partition
    (the low bits of ``monotonically_increasing_id``) — no further shuffle."""
    from squall.session import cut_lineage
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    r = cut_lineage(r.withColumn("_pid", F.spark_partition_id()))
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_pn"))       # one row per partition
    offs = counts.select("_pid", F.coalesce(F.sum("_pn").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    d = r.withColumn("_li", local)
    d = d.join(F.broadcast(offs), "_pid", "inner")
    return d.withColumn(pos, (F.col("_off") + F.col("_li")).cast("long")).drop("_pid", "_li", "_off")


def add_position(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                 ts: str, block_seconds: int = DEFAULT_BLOCK_SECONDS,
                 pos: str = POS) -> DataFrame:
    """0-based row position inside each series (``keys``), ordered by
    ``order``, computed without a whole-series window: local row numbers per
    time block plus the row count of all earlier blocks.  Without series
    keys the global position comes from range partitioning instead
    (``global_position``), which stays balanced when many rows share a
    time."""
    keys = list(keys)
    if not keys:
        return global_position(df, order, pos=pos)
    b = with_block(df, ts, block_seconds)
    wl = block_window(keys, order)
    local = b.withColumn("_lrn", F.row_number().over(wl) - 1)
    counts = b.groupBy(*keys, BLK).agg(F.count(F.lit(1)).alias("_bn"))
    ws = summary_window(keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, BLK, F.coalesce(F.sum("_bn").over(ws), F.lit(0)).alias("_off"))
    out = carry_join(local, offsets, keys)
    return out.withColumn(pos, (F.col("_off") + F.col("_lrn")).cast("long")).drop("_lrn", "_off", BLK)


def halo_apply(df: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str,
               back: int, fwd: int,
               build: Callable[[object], list[Column]],
               block_rows: int = DEFAULT_BLOCK_ROWS,
               block_seconds: int = DEFAULT_BLOCK_SECONDS,
               positioned: bool = False) -> DataFrame:
    """Evaluate bounded-reach window expressions exactly on position blocks.

    ``build(w)`` receives a window spec ordered by position inside one block
    and returns aliased columns.  Frames may reach at most ``back`` rows
    before and ``fwd`` rows after the current row.  Output: the input rows
    (once each, with ``_pos``) plus the built columns.
    """
    keys = list(keys)
    back, fwd = int(back), int(fwd)
    if back > block_rows or fwd > block_rows:
        raise ValueError("block_rows must be at least the window reach")
    d = df if positioned else add_position(df, keys, order, ts, block_seconds)
    pb = F.floor(F.col(POS) / F.lit(block_rows)).cast("long")
    off = F.col(POS) - pb * F.lit(block_rows)
    targets = F.array(F.struct(pb.alias("_pb"), F.lit(True).alias("_home")))
    if back > 0:
        targets = F.when(off >= F.lit(block_rows - back),
                         F.array_union(targets, F.array(F.struct((pb + 1).alias("_pb"), F.lit(False).alias("_home"))))
                         ).otherwise(targets)
    if fwd > 0:
        targets = F.when((off < F.lit(fwd)) & (pb > 0),
                         F.array_union(targets, F.array(F.struct((pb - 1).alias("_pb"), F.lit(False).alias("_home"))))
                         ).otherwise(targets)
    ex = d.withColumn("_t", F.explode(targets)).select("*", "_t._pb", "_t._home").drop("_t")
    w = Window.partitionBy(*keys, "_pb").orderBy(POS)
    out = ex.select("*", *build(w))
    return out.filter(F.col("_home")).drop("_pb", "_home")


def carry_fill(df: DataFrame, keys: Sequence[str], order: str, block: Column,
               cols: Sequence[str] = (), forward: bool = True,
               backward_cols: Sequence[str] = ()) -> DataFrame:
    """Last non-null value at or before each row (``cols`` with
    ``forward``) and/or the first at or after it (``cols`` without
    ``forward``, plus ``backward_cols``), per series ordered by ``order``,
    over blocks given by ``block`` (any column monotone in ``order``).

    Both directions share one window spec, one per-block summary and one
    carry join."""
    keys = list(keys)
    fwd = list(cols) if forward else []
    bwd = ([] if forward else list(cols)) + list(backward_cols)
    o = F.col(order)
    d = df.withColumn(BLK, block)
    wl = Window.partitionBy(*keys, BLK).orderBy(order)
    upto = wl.rowsBetween(Window.unboundedPreceding, 0)
    after = wl.rowsBetween(0, Window.unboundedFollowing)

    def tagged(c):
        return F.when(F.col(c).isNotNull(), F.struct(o.alias("o"), F.col(c).alias("v")))
    aggs = [F.max(tagged(c)).alias(f"_{c}_bf") for c in fwd] + [F.min(tagged(c)).alias(f"_{c}_bb") for c in bwd]
    summ = d.groupBy(*keys, BLK).agg(*aggs)
    ws = Window.partitionBy(*keys).orderBy(BLK) if keys else Window.orderBy(BLK)
    prev = ws.rowsBetween(Window.unboundedPreceding, -1)
    nxt = ws.rowsBetween(1, Window.unboundedFollowing)
    carry = summ.select(*keys, BLK,
                        *[F.max(f"_{c}_bf").over(prev).getField("v").alias(f"_{c}_cf") for c in fwd],
                        *[F.min(f"_{c}_bb").over(nxt).getField("v").alias(f"_{c}_cb") for c in bwd])
    j = carry_join(d, carry, keys)
    out = {}
    for c in fwd:
        out[c] = F.coalesce(F.last(c, ignorenulls=True).over(upto), F.col(f"_{c}_cf"))
    for c in bwd:
        out[c] = F.coalesce(F.first(c, ignorenulls=True).over(after), F.col(f"_{c}_cb"))
    rest = [c for c in df.columns if c not in out]
    return j.select(*rest, *[v.alias(k) for k, v in out.items()]).select(*df.columns)

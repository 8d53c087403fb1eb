"""Joins Spark has no single operator for (J2 interval join, J6 nearest cell)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from squall.functions.timecols import epoch_us


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], ts: str,
                  start: str, end: str, bucket_seconds: int = 86400) -> DataFrame:
    """Inner join of points with every interval of the same keys that
    contains them (``start <= ts <= end``), as an equi-join on time buckets.

    Each interval is exploded into the buckets it touches (its row count grows
    with its own length only); each point falls in exactly one bucket, so a
    (point, interval) pair is produced once.  Spark plans a hash or
    sort-merge join on (keys, bucket) — no nested-loop theta join."""
    keys = list(keys)
    width = int(bucket_seconds) * 1_000_000
    iv = intervals.withColumn(
        "_bk", F.explode(F.sequence(F.floor(epoch_us(start) / F.lit(width)).cast("long"),
                                    F.floor(epoch_us(end) / F.lit(width)).cast("long"))))
    pt = points.withColumn("_bk", F.floor(epoch_us(ts) / F.lit(width)).cast("long"))
    j = pt.join(iv, [*keys, "_bk"], "inner")
    return j.filter((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(end))).drop("_bk")


def nearest_cell(points: DataFrame, cells: DataFrame, axes: Sequence[tuple[str, str, float, float]]) -> DataFrame:
    """Every point with the nearest cell of a regular grid. ``axes`` are (point coordinate, integer
    cell coordinate, coordinate of cell 0, cell width): a point is rounded to a cell on each axis and
    clamped to the grid's extent (one row), then an equi-join finds the cell. Points without a
    coordinate, and places that the grid lacks, give no row."""
    extent = cells.agg(*[f(c).alias(f"_{n}_{c}") for _, c, _, _ in axes for n, f in (("lo", F.min), ("hi", F.max))])
    d = points.withColumn("_one", F.lit(1)).join(F.broadcast(extent.withColumn("_one", F.lit(1))), "_one").drop("_one")
    at = [F.least(F.greatest(F.round((F.col(x) - F.lit(float(zero))) / F.lit(float(width))), F.col(f"_lo_{c}")), F.col(f"_hi_{c}"))
          .cast("long").alias(c) for x, c, zero, width in axes]
    names = [c for _, c, _, _ in axes]
    kept = [c for c in points.columns if c not in names]
    d = d.where(" and ".join(f"`{x}` is not null" for x, *_ in axes)).select(*kept, *at)
    return d.join(cells, names, "inner")

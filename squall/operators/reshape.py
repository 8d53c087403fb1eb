"""Reshape, resample and fill.

* ``pivot_wide`` always pivots on an explicit value list (no extra distinct
  job) and keeps the first non-null value like pandas.
* ``resample`` bins by epoch-aligned buckets, then densifies: bins are
  generated per series from the (min, max) summary in coarse chunks, so no
  single task expands a long span, and left-joined to the aggregated bins.
* ``fill_forward_backward`` is forward fill, then backward fill, then an
  optional constant, computed over (series, time block) with block carries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from squall.functions.timecols import epoch_us
from squall.operators.blocks import BLK, DEFAULT_BLOCK_SECONDS, carry_join, with_block


def pivot_wide(df: DataFrame, index: str, by: str, values: Sequence[str], names: Sequence[str]) -> DataFrame:
    """R2: one row per ``index``; columns ``{name}_{value}``."""
    aggs = [F.first(v, ignorenulls=True).alias(v) for v in values]
    p = df.groupBy(index).pivot(by, list(names)).agg(*aggs)
    if len(values) == 1:
        p = p.select(index, *[F.col(n).alias(f"{n}_{values[0]}") for n in names])
    return p


def unpivot_wide(df: DataFrame, ids: Sequence[str], columns: Sequence[str], var: str = "variable",
                 value: str = "value") -> DataFrame:
    """Wide columns back to (variable, value) rows."""
    return df.unpivot(list(ids), list(columns), var, value)


def _bin_start(blk, seconds: int, like_ntz: bool):
    ts = F.timestamp_micros(blk * F.lit(int(seconds) * 1_000_000))
    return ts.cast("timestamp_ntz") if like_ntz else ts


def resample(df: DataFrame, keys: Sequence[str], ts: str, seconds: int,
             mean_cols: Sequence[str], max_cols: Sequence[str] = (), dense: bool = True,
             chunk_bins: int = 4096) -> DataFrame:
    """Mean of ``mean_cols`` and max of ``max_cols`` per bin of
    ``seconds`` (epoch aligned, closed left, labelled by bin start).  With
    ``dense`` every bin between a series' first and last bin is present
    (empty bins have NULL values)."""
    keys = list(keys)
    like_ntz = dict(df.dtypes)[ts] == "timestamp_ntz"
    b = df.withColumn("_bin", F.floor(epoch_us(ts) / F.lit(int(seconds) * 1_000_000)).cast("long"))
    agg = b.groupBy(*keys, "_bin").agg(*[F.avg(c).alias(c) for c in mean_cols],
                                       *[F.max(c).alias(c) for c in max_cols])
    if dense:
        span = agg.groupBy(*keys).agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi"))
        chunks = span.select(*keys, "_lo", "_hi",
                             F.explode(F.sequence(F.floor(F.col("_lo") / chunk_bins).cast("long"),
                                                  F.floor(F.col("_hi") / chunk_bins).cast("long"))).alias("_ch"))
        chunks = chunks.repartition(*keys, "_ch") if keys else chunks.repartition("_ch")
        bins = chunks.select(*keys, F.explode(F.sequence(
            F.greatest(F.col("_lo"), F.col("_ch") * chunk_bins),
            F.least(F.col("_hi"), F.col("_ch") * chunk_bins + chunk_bins - 1))).alias("_bin"))
        agg = bins.join(agg, [*keys, "_bin"], "left")
    return agg.select(*keys, _bin_start(F.col("_bin"), seconds, like_ntz).alias(ts),
                      *mean_cols, *max_cols)


def fill_forward_backward(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                          final=None, backward: bool = True,
                          block_seconds: int = DEFAULT_BLOCK_SECONDS) -> DataFrame:
    """Per series, NULLs take the last earlier non-null value, then
    (``backward``) the first later one, then ``final`` (e.g. 0) if given."""
    keys = list(keys)
    t = F.col(ts)
    b = with_block(df, ts, block_seconds)
    wl = Window.partitionBy(*keys, BLK).orderBy(ts)
    upto = wl.rowsBetween(Window.unboundedPreceding, 0)
    after = wl.rowsBetween(0, Window.unboundedFollowing)
    aggs = []
    for c in cols:
        v = F.when(F.col(c).isNotNull(), F.struct(t.alias("t"), F.col(c).alias("v")))
        aggs += [F.max(v).alias(f"_{c}_bl"), F.min(v).alias(f"_{c}_bf")]
    summ = b.groupBy(*keys, BLK).agg(*aggs)
    ws = Window.partitionBy(*keys).orderBy(BLK) if keys else Window.orderBy(BLK)
    prev = ws.rowsBetween(Window.unboundedPreceding, -1)
    nxt = ws.rowsBetween(1, Window.unboundedFollowing)
    carry = summ.select(*keys, BLK, *[F.max(f"_{c}_bl").over(prev).getField("v").alias(f"_{c}_cl") for c in cols],
                        *[F.min(f"_{c}_bf").over(nxt).getField("v").alias(f"_{c}_cf") for c in cols])
    j = carry_join(b, carry, keys)
    out = []
    for c in cols:
        parts = [F.col(c), F.last(c, ignorenulls=True).over(upto), F.col(f"_{c}_cl")]
        if backward:
            parts += [F.first(c, ignorenulls=True).over(after), F.col(f"_{c}_cf")]
        if final is not None:
            parts.append(F.lit(final).cast(dict(df.dtypes)[c]))
        out.append(F.coalesce(*parts).alias(c))
    rest = [c for c in df.columns if c not in cols]
    return j.select(*rest, *out).select(*df.columns)


def left_join_fill(df: DataFrame, side: DataFrame, on: str, side_cols: Sequence[str],
                   block_seconds: int = DEFAULT_BLOCK_SECONDS) -> DataFrame:
    """Left equi-join of a timeline with a side table on the timestamp,
    then forward -> backward -> 0 fill of the side columns over time."""
    j = df.join(side.select(on, *side_cols), on, "left")
    return fill_forward_backward(j, [], on, side_cols, final=0.0, block_seconds=block_seconds)


def null_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """P10: percentage of NULL per column (per ``by`` group), rounded to 2,
    in one aggregation pass, returned long (column, null_pct)."""
    aggs = [F.round(F.lit(100.0) * F.avg(F.col(c).isNull().cast("double")), 2).alias(c) for c in columns]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return g.unpivot(list(by), list(columns), "column", "null_pct")


def null_bands(profile: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ten half-open bands [0,10) ... [90,100); columns listed per band.
    A fully NULL column (100 %) falls in no band (reference behaviour)."""
    band = F.floor(F.col("null_pct") / 10).cast("int")
    return (profile.filter(F.col("null_pct") < 100)
            .groupBy(*by, (band * 10).alias("band_low"))
            .agg((F.col("band_low") + 10).alias("band_high"),
                 F.count(F.lit(1)).alias("n_columns"),
                 F.array_join(F.array_sort(F.collect_list("column")), ",").alias("columns")))


def columns_by_null_threshold(profile: DataFrame, threshold: float = 80.0) -> DataFrame:
    """Keep columns with at most ``threshold`` % NULL; counts of columns
    with 0, (0,20], (20,50], (50,80], >80 % NULL."""
    p = F.col("null_pct")
    return profile.agg(
        F.count(F.when(p == 0, 1)).alias("n_cols_0"),
        F.count(F.when((p > 0) & (p <= 20), 1)).alias("n_cols_0_20"),
        F.count(F.when((p > 20) & (p <= 50), 1)).alias("n_cols_20_50"),
        F.count(F.when((p > 50) & (p <= 80), 1)).alias("n_cols_50_80"),
        F.count(F.when(p > 80, 1)).alias("n_cols_80_100"),
        F.array_join(F.array_sort(F.collect_list(F.when(p <= F.lit(float(threshold)), F.col("column")))), ",")
        .alias("kept_columns"))


def keep_columns_below(profile: DataFrame, threshold: float = 100.0, by: Sequence[str] = ()) -> DataFrame:
    """Per group, the columns whose band's upper edge is <= threshold."""
    band_high = (F.floor(F.col("null_pct") / 10) + 1) * 10
    return (profile.filter((F.col("null_pct") < 100) & (band_high <= F.lit(float(threshold))))
            .groupBy(*by).agg(F.count(F.lit(1)).alias("n_kept"),
                              F.array_join(F.array_sort(F.collect_list("column")), ",").alias("kept_columns")))


def drop_all_null_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Names of the columns with at least one non-null value (one
    aggregation; only the column names reach the driver)."""
    row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] > 0]

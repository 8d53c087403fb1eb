"""Forecast features (W8-W17, P8): lags, rolling statistics, differences,
cross-series statistics, calendar encodings, threshold distances, future
targets and fixed-length sequences.

All row-count windows of one table share one window spec over position
blocks (``halo_apply``): after the position pass (one exchange by series and
time block), every lag, roll, diff, lead and sequence is computed by a single
exchange and sort, and no series is ever a single task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squall.functions.timecols import cyclic
from squall.operators.blocks import DEFAULT_BLOCK_ROWS, DEFAULT_BLOCK_SECONDS, halo_apply

# --- fixed values: lag sets and rolling windows of the reference ---
LAG_CONFIGS = {"short": [1, 2, 4, 8], "medium": [1, 2, 4, 8, 16, 24], "long": [1, 4, 8, 16, 24, 48, 96]}
ROLLING_WINDOWS = [4, 12, 24, 96]
# --- end of fixed values ------------------------------------------------------


def feature_exprs(w, cols: Sequence[str], lags: Sequence[int] = (), windows: Sequence[int] = (),
                  stats: Sequence[str] = ("mean", "std"), diffs: bool = False,
                  leads: Mapping[str, tuple[str, int]] | None = None,
                  sequence: tuple[Sequence[str], int] | None = None) -> list[Column]:
    """Window expressions over one ordered spec ``w``.

    * ``{c}_lag{k}`` — value k rows earlier.
    * ``{c}_roll{n}_{stat}`` — mean / sample std / min / max of the last n
      rows, NULL unless all n rows exist and are non-null (pandas default).
    * ``{c}_diff1``, ``{c}_diff2`` — first and second differences.
    * ``leads``: output name -> (column, h): value h rows later.
    * ``sequence``: (columns, L) -> ``seq`` = the last L rows as an array of
      structs (structs keep NULL readings), NULL until L rows exist.
    """
    out = []
    for c in cols:
        x = F.col(c)
        for k in lags:
            out.append(F.lag(x, k).over(w).alias(f"{c}_lag{k}"))
        for n in windows:
            fr = w.rowsBetween(-(n - 1), 0)
            full = F.count(x).over(fr) == F.lit(n)
            fn = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
            for s in stats:
                out.append(F.when(full, fn[s](x).over(fr)).alias(f"{c}_roll{n}_{s}"))
        if diffs:
            l1, l2 = F.lag(x, 1).over(w), F.lag(x, 2).over(w)
            out.append((x - l1).alias(f"{c}_diff1"))
            out.append((x - F.lit(2.0) * l1 + l2).alias(f"{c}_diff2"))
    for name, (c, h) in (leads or {}).items():
        out.append(F.lead(F.col(c), h).over(w).alias(name))
    if sequence:
        scols, L = sequence
        fr = w.rowsBetween(-(L - 1), 0)
        buf = F.collect_list(F.struct(*[F.col(c) for c in scols])).over(fr)
        out.append(F.when(F.count(F.lit(1)).over(fr) == F.lit(L), buf).alias("seq"))
    return out


def reach(lags=(), windows=(), diffs=False, leads=None, sequence=None) -> tuple[int, int]:
    back = max([0, *lags, *[n - 1 for n in windows], 2 if diffs else 0,
                (sequence[1] - 1) if sequence else 0])
    fwd = max([0, *[h for _, h in (leads or {}).values()]])
    return back, fwd


def temporal_features(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str],
                      lags: Sequence[int] = (), windows: Sequence[int] = (),
                      stats: Sequence[str] = ("mean", "std"), diffs: bool = False,
                      leads: Mapping[str, tuple[str, int]] | None = None,
                      sequence: tuple[Sequence[str], int] | None = None,
                      block_rows: int = DEFAULT_BLOCK_ROWS,
                      block_seconds: int = DEFAULT_BLOCK_SECONDS) -> DataFrame:
    """W8-W11, W15, W17 in one pass per series (rows, not minutes: Q2)."""
    back, fwd = reach(lags, windows, diffs, leads, sequence)

    def build(w):
        return feature_exprs(w, cols, lags, windows, stats, diffs, leads, sequence)
    return halo_apply(df, keys, [ts], ts, back, fwd, build, block_rows, block_seconds)


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows where every listed feature and the target is non-null."""
    return df.na.drop(how="any", subset=list(columns))


def _nonnull(cols: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())


def cross_series_stats(df: DataFrame, var: str, series: Sequence[str], sep: str = "_") -> DataFrame:
    """Per row, mean / sample std / range of ``{s}{sep}{var}`` across
    series (NULLs skipped), and each series' deviation from the mean.  Only
    built when at least two series carry the variable."""
    cols = [f"{s}{sep}{var}" for s in series if f"{s}{sep}{var}" in df.columns]
    if len(cols) < 2:
        return df
    arr = _nonnull(cols)
    n = F.size(arr)
    total = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.when(n > 0, total / n)
    d = df.withColumn(f"{var}_tower_mean", mean)
    m = F.col(f"{var}_tower_mean")
    ss = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
    d = d.withColumn(f"{var}_tower_std", F.when(n > 1, F.sqrt(ss / (n - 1))))
    d = d.withColumn(f"{var}_tower_range", F.array_max(arr) - F.array_min(arr))
    return d.select("*", *[(F.col(c) - m).alias(f"{c}_dev_from_mean") for c in cols])


def cyclic_time(df: DataFrame, ts: str) -> DataFrame:
    """sin/cos of hour/24, weekday/7 (Monday = 0) and month/12."""
    t = F.col(ts)
    return df.select("*",
                     cyclic(F.hour(t), 24, "sin").alias("hour_sin"), cyclic(F.hour(t), 24, "cos").alias("hour_cos"),
                     cyclic(F.weekday(t), 7, "sin").alias("dow_sin"), cyclic(F.weekday(t), 7, "cos").alias("dow_cos"),
                     cyclic(F.month(t), 12, "sin").alias("month_sin"),
                     cyclic(F.month(t), 12, "cos").alias("month_cos"))


def threshold_distance(df: DataFrame, limits: Mapping[str, float], suffix: Mapping[str, str]) -> DataFrame:
    """Column minus a limit, named ``{col}_dist_to_{suffix}``."""
    return df.select("*", *[(F.col(c) - F.lit(float(v))).alias(f"{c}_dist_to_{suffix[c]}")
                            for c, v in limits.items() if c in df.columns])


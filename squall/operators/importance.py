"""Feature-importance roll-ups.

Input: long importance rows (feature, importance, group keys such as tower
and event).  Ranks use ``row_number`` with a full tie-break (importance
desc, then feature name) so "first" is deterministic (T8, Q25).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squall.operators.blocks import global_position
from squall.operators.stats import cumulative_value_counts, quantiles_of

# Base variable of a feature name: text before `_NNNm`, `_lag` or `_roll`.
CATEGORY_SPLIT = "_[0-9]+m|_lag|_roll"


def category_of(feature: Column) -> Column:
    return F.split(feature, CATEGORY_SPLIT).getItem(0)


def family_of(feature: Column) -> Column:
    """Feature family by case-insensitive substring ('lag' first,
    then 'roll'); labels are the reference's."""
    f = F.lower(feature)
    return (F.when(f.contains("lag"), F.lit("Lag Features"))
            .when(f.contains("roll"), F.lit("Rolling Statistics")).otherwise(F.lit("Raw Features")))


def rank_features(df: DataFrame, keys: Sequence[str], feature: str = "feature",
                  importance: str = "importance", top_n: int | None = 20) -> DataFrame:
    """Rank 1.. by importance within each group, percent of the group
    total, optionally the top ``top_n``.  The group total is an aggregate
    joined back (no whole-group window); ``rank <= top_n`` lets Spark insert a
    per-partition group limit before the shuffle."""
    keys = list(keys)
    tot = df.groupBy(*keys).agg(F.sum(importance).alias("_tot"))
    w = Window.partitionBy(*keys).orderBy(F.col(importance).desc(), F.col(feature).asc())
    r = df.select("*", F.row_number().over(w).alias("rank"))
    if top_n:
        r = r.filter(F.col("rank") <= top_n)
    r = r.join(tot, keys, "inner")
    pct = F.when(F.col("_tot") != 0, F.lit(100.0) * F.col(importance) / F.col("_tot")).otherwise(F.lit(0.0))
    return r.select(*[c for c in df.columns], "rank", pct.alias("importance_pct"))


def argmax_rows(df: DataFrame, keys: Sequence[str], value: str, tiebreak: str) -> DataFrame:
    """K4: the row with the largest ``value`` per group (smallest
    ``tiebreak`` on ties) by two aggregations and a join — never a
    whole-group window or buffer."""
    keys = list(keys)
    mx = df.groupBy(*keys).agg(F.max(value).alias("_mx"))
    cand = df.join(mx, keys, "inner").filter(F.col(value) == F.col("_mx"))
    first = cand.groupBy(*keys).agg(F.min(tiebreak).alias(tiebreak))
    return cand.join(first, [*keys, tiebreak], "left_semi").drop("_mx")


def global_importance(df: DataFrame, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """Per feature mean, sample std, min, max, count."""
    return df.groupBy(feature).agg(F.avg(importance).alias("mean"), F.stddev_samp(importance).alias("std"),
                                   F.min(importance).alias("min"), F.max(importance).alias("max"),
                                   F.count(F.lit(1)).alias("count"))


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """K3: first ``k`` rows per group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def importance_by(df: DataFrame, by: str, k: int = 10, feature: str = "feature",
                  importance: str = "importance") -> DataFrame:
    """Per ``by`` value, the top ``k`` features by mean importance."""
    m = df.groupBy(by, feature).agg(F.avg(importance).alias("mean_importance"))
    return top_k_per_group(m, [by], [F.col("mean_importance").desc(), F.col(feature).asc()], k)


def category_importance(df: DataFrame, by: str, top: int = 15, feature: str = "feature",
                        importance: str = "importance") -> DataFrame:
    """A21 + J7: category totals, and the category x ``by`` matrix for the
    ``top`` categories (left-semi join with the top list)."""
    c = df.withColumn("category", category_of(F.col(feature)))
    tot = c.groupBy("category").agg(F.sum(importance).alias("total_importance"),
                                    F.avg(importance).alias("mean_importance"),
                                    F.stddev_samp(importance).alias("std_importance"), F.count(F.lit(1)).alias("n_features"))
    w = Window.orderBy(F.col("total_importance").desc(), F.col("category").asc())
    ranked = tot.withColumn("category_rank", F.row_number().over(w)).filter(F.col("category_rank") <= top)
    cell = c.groupBy("category", by).agg(F.sum(importance).alias("cell_importance"))
    kept = cell.join(ranked.select("category"), "category", "left_semi")
    return kept.join(ranked, "category", "inner")


def family_share(df: DataFrame, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """Mean, sum and count of importance per feature family."""
    return (df.groupBy(family_of(F.col(feature)).alias("family"))
            .agg(F.avg(importance).alias("mean_importance"), F.sum(importance).alias("sum_importance"),
                 F.count(F.lit(1)).alias("n_features")))


def importance_matrix(df: DataFrame, index: str, columns: str, values: Sequence[str],
                      importance: str = "importance") -> DataFrame:
    """``index`` x ``columns`` mean importance (explicit pivot values),
    missing cells 0, the row mean and the row's rank by that mean (the
    position in a range-partitioned order: no window over all rows)."""
    p = df.groupBy(index).pivot(columns, list(values)).agg(F.avg(importance))
    cells = [F.coalesce(F.col(v), F.lit(0.0)) for v in values]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    mean = total / F.lit(float(len(values)))
    p = p.select(index, *[c.alias(f"imp_{v}") for c, v in zip(cells, values)], mean.alias("row_mean"))
    d = global_position(p.withColumn("_down", -F.col("row_mean")), ["_down", index], pos="_at")
    return d.withColumn("row_rank", (F.col("_at") + 1).cast("int")).drop("_down", "_at")


def importance_cells(df: DataFrame, index: str, columns: str, importance: str = "importance") -> DataFrame:
    """A23 in long form, for any number of ``columns`` values: (index, column value, mean importance, row
    mean with missing cells as 0, row rank). Names stay in rows, so nothing grows with them; the number
    of values is one counted row."""
    cells = df.groupBy(index, columns).agg(F.avg(importance).alias("cell"))
    n = cells.select(columns).distinct().agg(F.count(F.lit(1)).alias("_n")).withColumn("_one", F.lit(1))
    rows = cells.groupBy(index).agg(F.sum("cell").alias("_total")).withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one")
    rows = rows.select(index, (F.col("_total") / F.col("_n")).alias("row_mean"))
    d = global_position(rows.withColumn("_down", -F.round("row_mean", 9)), ["_down", index], pos="_at")
    return cells.join(d.select(index, "row_mean", (F.col("_at") + 1).alias("row_rank")), index)


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles (exact, linear), IQR, whiskers at 1.5 IQR and the
    number of outliers per group, all from one table of value counts; groups
    without any value have no row."""
    cum = cumulative_value_counts(df, [by], value)
    q = quantiles_of(cum, [by], value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    nulls = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    j = cum.select(F.col(by).alias("_by"), F.col(value).alias("_v"), "_c").join(q, F.col("_by").eqNullSafe(F.col(by)))
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - F.lit(1.5) * iqr, F.col("q3") + F.lit(1.5) * iqr
    v = F.col("_v")
    found = j.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(v >= lo, v)).alias("whisker_low"), F.max(F.when(v <= hi, v)).alias("whisker_high"),
        F.sum(F.when((v < lo) | (v > hi), F.col("_c")).otherwise(0)).alias("n_outliers"))
    found = found.join(nulls.withColumnRenamed(by, "_by"), F.col("_by").eqNullSafe(F.col(by)))
    return found.select(by, "q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"), "whisker_low", "whisker_high",
                        "n_outliers", "n")


def total_by(df: DataFrame, by: str, importance: str = "importance") -> DataFrame:
    """Total importance per series."""
    return df.groupBy(by).agg(F.sum(importance).alias("total_importance"), F.count(F.lit(1)).alias("n_features"))

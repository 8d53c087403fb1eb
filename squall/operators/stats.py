"""Exact statistics that scale: quantiles, correlation, Spearman (A26-A30,
A34, A36).

Exact quantiles never gather a group's values in one buffer: values are first
counted per (group, value) — a partial aggregation — and the position of the
k-th value is then found by a running count over the *distinct* values,
which for sensor data is far smaller than the row count.  ``running_sums``
cuts these by size: blocks of at most ``BLOCK_VALUES`` values in the order of
(group, value), whatever the groups and the spread of their values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squall.operators.blocks import BLK, carry_join, global_position, with_block
from squall.session import cut_lineage


#: Values that one task adds up at most.
BLOCK_VALUES = 200_000


def running_sums(counts: DataFrame, keys: Sequence[str], value: str, cols: Sequence[str],
                 block_values: int = BLOCK_VALUES) -> DataFrame:
    """``counts`` (one row for each group and value; groups may be null) with, for every column of
    ``cols``, ``{c}_before``, the sum over smaller values of the group, and ``{c}_all``, the group's.

    The table is pinned and counted.  Up to ``block_values`` rows need one window by group.  More are
    put in the order of (group, value) by range partitions, numbered and cut into blocks of that many
    rows: sums run inside a block, and what earlier blocks of the same group hold is carried."""
    keys = list(keys)
    counts = cut_lineage(counts)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if counts.count() <= block_values:
        group = Window.partitionBy(*keys)
        return counts.select("*", *[before(c, group.orderBy(value)).alias(f"{c}_before") for c in cols],
                             *[F.sum(c).over(group).alias(f"{c}_all") for c in cols])
    placed = global_position(counts, [*keys, value], pos="_at")
    placed = placed.withColumn(BLK, F.floor(F.col("_at") / block_values).cast("long")).drop("_at")
    sums = placed.groupBy(*keys, BLK).agg(*[F.sum(c).alias(c) for c in cols])       # one row for each block and group in it
    group = Window.partitionBy(*keys)
    carry = sums.select(*keys, BLK, *[before(c, group.orderBy(BLK)).alias(f"_c_{c}") for c in cols],
                        *[F.sum(c).over(group).alias(f"{c}_all") for c in cols])
    inside = Window.partitionBy(*keys, BLK).orderBy(value)
    within = placed.select("*", *[before(c, inside).alias(f"_w_{c}") for c in cols])
    out = carry_join(within, carry, keys)
    return out.select(*counts.columns, *[(F.col(f"_c_{c}") + F.col(f"_w_{c}")).alias(f"{c}_before") for c in cols],
                      *[f"{c}_all" for c in cols])


def cumulative_value_counts(df: DataFrame, keys: Sequence[str], value: str,
                            block_values: int = BLOCK_VALUES) -> DataFrame:
    """(keys, value, _c, _prev, _cum, _n): count of each distinct value and
    the running count before / through it, per group; NULL and NaN left out."""
    keys = list(keys)
    v = F.col(value)
    cv = df.filter(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    r = running_sums(cv, keys, value, ["_c"], block_values)
    return r.select(*keys, value, "_c", F.col("_c_before").alias("_prev"), (F.col("_c_before") + F.col("_c")).alias("_cum"),
                    F.col("_c_all").alias("_n"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
                    names: Sequence[str] | None = None) -> DataFrame:
    """Linear-interpolated quantiles (NumPy / ``quantile_cont`` semantics)
    per group; NULL values are ignored."""
    return quantiles_of(cumulative_value_counts(df, keys, value), keys, value, qs, names)


def quantiles_of(cum: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
                 names: Sequence[str] | None = None) -> DataFrame:
    """Quantiles from running value counts."""
    keys = list(keys)
    names = list(names or [f"q{int(round(q * 100)):02d}" for q in qs])
    aggs = []
    for q, name in zip(qs, names):
        h = (F.col("_n") - 1).cast("double") * F.lit(float(q))
        lo, hi = F.floor(h), F.ceil(h)
        at = lambda i: (F.col("_prev") <= i) & (i < F.col("_cum"))
        aggs += [F.max(F.when(at(lo), F.col(value))).alias(f"_{name}_lo"),
                 F.max(F.when(at(hi), F.col(value))).alias(f"_{name}_hi"),
                 F.max(h - lo).alias(f"_{name}_f")]
    g = cum.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[(F.col(f"_{n}_lo") + F.col(f"_{n}_f") * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")))
                            .alias(n) for n in names])


def pearson_parts(x: Column, y: Column, prefix: str) -> list[Column]:
    """Raw sums for a NULL-safe, zero-variance-safe Pearson r."""
    both = x.isNotNull() & y.isNotNull()
    xv, yv = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return [F.count(xv).alias(f"{prefix}_n"), F.sum(xv).alias(f"{prefix}_sx"), F.sum(yv).alias(f"{prefix}_sy"),
            F.sum(xv * xv).alias(f"{prefix}_sxx"), F.sum(yv * yv).alias(f"{prefix}_syy"),
            F.sum(xv * yv).alias(f"{prefix}_sxy")]


def pearson_from_parts(prefix: str) -> Column:
    n, sx, sy = F.col(f"{prefix}_n"), F.col(f"{prefix}_sx"), F.col(f"{prefix}_sy")
    sxx, syy, sxy = F.col(f"{prefix}_sxx"), F.col(f"{prefix}_syy"), F.col(f"{prefix}_sxy")
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), (n * sxy - sx * sy) / F.sqrt(vx * vy))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank (ties share the mean of their positions), 1-based —
    from per-value running counts, so ties never need a row-level self join
    and no window holds a whole group; NULL values have no rank."""
    keys = list(keys)
    cv = cumulative_value_counts(df, keys, value)
    r = cv.select(*keys, value, (F.col("_prev") + (F.col("_c") + 1) / 2.0).alias(out))
    return df.join(r, [*keys, value], "left")


def rank_pairs(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """A26 core: (keys, x, y, n, r) — Spearman's r of every pair of columns per group, rows without
    either value left out.  Both columns of all pairs are ranked in one pass over long rows, then
    joined by row, so the input is read once whatever the pairs."""
    keys = list(keys)
    rows = cut_lineage(df.select(*keys, *dict.fromkeys(c for p in pairs for c in p))
                       .withColumn("_row", F.monotonically_increasing_id()))
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("_pair"), F.lit(s).alias("_side"), F.col(c).cast("double").alias("_v"))
                                for i, (x, y) in enumerate(pairs) for s, c in ((0, x), (1, y))
                                ])).alias("_e")
    long = rows.select(*keys, "_row", sides).select(*keys, "_row", "_e.*")
    ranked = average_rank(long, [*keys, "_pair", "_side"], "_v", "_r")
    both = ranked.groupBy(*keys, "_pair", "_row").agg(F.max(F.when(F.col("_side") == 0, F.col("_r"))).alias("_rx"),
                                                      F.max(F.when(F.col("_side") == 1, F.col("_r"))).alias("_ry"))
    g = both.groupBy(*keys, "_pair").agg(*pearson_parts(F.col("_rx"), F.col("_ry"), "_p"))
    names = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in pairs])
    return g.select(*keys, F.get(names, F.col("_pair")).alias("_xy"), F.col("_p_n").alias("n"), pearson_from_parts("_p").alias("r")) \
        .select(*keys, "_xy.x", "_xy.y", "n", "r")


def time_slices(df: DataFrame, ts: str, by: str, value: str, n: int, event: Column) -> DataFrame:
    """``n`` equal spans between the first and last time; per (slice,
    group): mean value, row count, event count.  The last slice is closed."""
    from squall.functions.timecols import epoch_us
    span = df.agg(F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    d = df.withColumn("_one", F.lit(1)).join(F.broadcast(span.withColumn("_one", F.lit(1))), "_one")
    span_us = (epoch_us("_t1") - epoch_us("_t0")).cast("double")
    rel = (epoch_us(ts) - epoch_us("_t0")).cast("double") * F.lit(float(n)) / span_us
    # a zero span (every reading at one time) puts all rows in slice 0
    sl = F.when(span_us > 0, F.least(F.floor(rel), F.lit(n - 1))).otherwise(F.lit(0)).cast("int")
    return (d.groupBy(sl.alias("slice"), F.col(by))
            .agg(F.round(F.avg(value), 6).alias("mean_value"), F.count(F.lit(1)).alias("n_rows"),
                 F.count(F.when(event, 1)).alias("n_events")))


def step_minutes(df: DataFrame, keys: Sequence[str], ts: str, fallback: float = 15.0) -> DataFrame:
    """Median minutes between consecutive readings per series."""
    from squall.functions.timecols import epoch_us
    keys = list(keys)
    # gaps in whole microseconds: the median is then exact (a half-integer at
    # worst) and the conversion to minutes is one division.  A gap inside a
    # time block is a lag; one across a border needs the last time before it.
    local = Window.partitionBy(*keys, BLK).orderBy(ts)
    d = with_block(df.select(*keys, ts), ts).select(*keys, BLK, epoch_us(ts).alias("_us"), F.lag(epoch_us(ts)).over(local).alias("_before"))
    inside = d.where("_before is not null").groupBy(*keys, (F.col("_us") - F.col("_before")).alias("_gap")).agg(F.count(F.lit(1)).alias("_c"))
    ends = d.groupBy(*keys, BLK).agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"))
    over = Window.partitionBy(*keys).orderBy(BLK)
    across = ends.select(*keys, (F.col("_first") - F.lag("_last").over(over)).alias("_gap"), F.lit(1).cast("long").alias("_c"))
    gaps = inside.unionByName(across).groupBy(*keys, "_gap").agg(F.sum("_c").alias("_c"))      # a row for each series at least
    r = running_sums(gaps.withColumn("_c", F.when(F.col("_gap").isNotNull(), F.col("_c")).otherwise(0)), keys, "_gap", ["_c"])
    cum = r.select(*keys, "_gap", "_c", F.col("_c_before").alias("_prev"), (F.col("_c_before") + F.col("_c")).alias("_cum"),
                   F.col("_c_all").alias("_n"))
    med = quantiles_of(cum, keys, "_gap", [0.5], ["_med"])
    return med.select(*keys, F.coalesce(F.col("_med") / F.lit(60_000_000.0), F.lit(float(fallback))).alias("step_minutes"))

"""Event rules as a table (P4, P5, W1, W2): which series can answer which rule, and their runs.

A rule is a set of terms (event, variable, op, lim), a column map says which column of a series
carries a variable. What a series lacks is found by relational division: a rule applies to a series
that has a present column for every variable it needs. Readings meet the terms in long form, so
any number of rules and series goes through one plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from squall.functions.rules import usable
from squall.functions.timecols import epoch_us, minutes_between
from squall.operators.blocks import BLK, DEFAULT_BLOCK_SECONDS, carry_join, with_block
from squall.operators.events import run_scan


def terms_table(spark: SparkSession, terms: Iterable[tuple[str, str, str, float, float]]) -> DataFrame:
    """(event, variable, op, lim, min_minutes) from (event, variable, op, limit, minimum hours)."""
    rows = [(e, v, op, float(x), 60.0 * float(h)) for e, v, op, x, h in terms]
    return spark.createDataFrame(rows, "event string, variable string, op string, lim double, min_minutes double")


def column_map_table(spark: SparkSession, colmap: Mapping[str, Mapping[str, str | None]]) -> DataFrame:
    """(series, variable, column); a variable that a series does not measure has no column."""
    rows = [(s, v, c) for s, m in colmap.items() for v, c in m.items()]
    return spark.createDataFrame(rows, "series string, variable string, column string")


def availability(terms: DataFrame, colmap: DataFrame, present: Sequence[str]) -> DataFrame:
    """P5: (series, event, n_needed, n_present, lacking, available) for every series of the map and every
    rule; ``lacking`` names the variables without a present column."""
    there = colmap.where(F.col("column").isin(list(present))).select("series", "variable", F.lit(True).alias("there"))
    needs = terms.agg(F.collect_set(F.struct("event", "variable")).alias("needs")).withColumn("_one", F.lit(1))     # one row: the rules
    pairs = colmap.select("series").distinct().withColumn("_one", F.lit(1)).join(F.broadcast(needs), "_one") \
        .select("series", F.inline("needs"))
    found = pairs.join(there, ["series", "variable"], "left").groupBy("series", "event").agg(
        F.count(F.lit(1)).alias("n_needed"), F.count("there").alias("n_present"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("variable")))), ",").alias("lacking"))
    return found.withColumn("available", F.col("n_needed") == F.col("n_present"))


def long_masks(readings: DataFrame, series: str, ts: str, terms: DataFrame, colmap: DataFrame) -> DataFrame:
    """(series, ts, event, m) for every reading time and every rule its series can answer; a term on
    a null or NaN reading does not hold. One shuffle, on (series, time, event)."""
    used = [c for c in readings.columns if c not in (series, ts)]
    able = availability(terms, colmap, used).where("available").select("series", "event")
    value = F.col("value")
    holds = F.when(F.col("op") == "<", value < F.col("lim")).when(F.col("op") == "<=", value <= F.col("lim")) \
        .when(F.col("op") == ">", value > F.col("lim")).when(F.col("op") == ">=", value >= F.col("lim"))
    long = readings.select(F.col(series).alias("series"), F.col(ts).alias("ts"), *[F.col(c).cast("double").alias(c) for c in used]) \
        .unpivot(["series", "ts"], used, "column", "value")
    met = long.join(colmap, ["series", "column"]).join(terms.join(able, "event"), ["series", "variable"])
    return met.groupBy("series", "ts", "event").agg(F.every(F.coalesce(holds & usable(value), F.lit(False))).alias("m"))


def segments(readings: DataFrame, series: str, ts: str, terms: DataFrame, colmap: DataFrame, keep_short: bool = False,
             max_gap_minutes: float | None = None, block_seconds: int = DEFAULT_BLOCK_SECONDS) -> DataFrame:
    """W1 + W2 for a table of rules: (series, event, start, end, duration_minutes, min_minutes), runs
    shorter than the rule's minimum only with ``keep_short``. With ``max_gap_minutes`` a longer step
    between readings ends a run at the reading before it."""
    masks = long_masks(readings, series, ts, terms, colmap)
    keys = ["series", "event"]
    if max_gap_minutes is not None:
        masks = gap_groups(masks, keys, "ts", max_gap_minutes, block_seconds)
        keys = [*keys, "gap_group"]
    runs = run_scan(masks, keys, "ts", ["m"], block_seconds).where("m_st")
    least = terms.groupBy("event").agg(F.max("min_minutes").alias("min_minutes"))
    found = runs.select("series", "event", F.col("ts").alias("start"), F.col("m_end").alias("end"),
                        minutes_between("ts", "m_end").alias("duration_minutes")).join(least, "event")
    return found if keep_short else found.where(F.col("duration_minutes") >= F.col("min_minutes"))


def gap_groups(df: DataFrame, keys: Sequence[str], ts: str, max_gap_minutes: float,
               block_seconds: int = DEFAULT_BLOCK_SECONDS, name: str = "gap_group") -> DataFrame:
    """Q2's option: number the stretches of each series without a step longer than ``max_gap_minutes``.
    Breaks are counted per time block; the last reading before a block and the breaks of all earlier
    blocks are carried over its border, so a gap at a border counts once and no series is one task."""
    keys = list(keys)
    gap_us = int(round(max_gap_minutes * 60_000_000))
    local = Window.partitionBy(*keys, BLK).orderBy(ts)
    d = with_block(df, ts, block_seconds).withColumn("_before", F.lag(epoch_us(ts)).over(local))
    inside = F.coalesce(epoch_us(ts) - F.col("_before") > gap_us, F.lit(False))
    summary = d.groupBy(*keys, BLK).agg(F.min(epoch_us(ts)).alias("_first"), F.max(epoch_us(ts)).alias("_last"),
                                        F.sum(inside.cast("long")).alias("_breaks"))
    over = Window.partitionBy(*keys).orderBy(BLK)
    summary = summary.withColumn("_at_border", F.coalesce(F.col("_first") - F.lag("_last").over(over) > gap_us, F.lit(False)).cast("long"))
    earlier = F.coalesce(F.sum(F.col("_breaks") + F.col("_at_border")).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carry = summary.select(*keys, BLK, (earlier + F.col("_at_border")).alias("_offset"))
    counted = F.sum(inside.cast("long")).over(local.rowsBetween(Window.unboundedPreceding, 0))
    d = carry_join(d.withColumn("_within", counted), carry, keys)
    return d.withColumn(name, F.col("_offset") + F.col("_within")).select(*df.columns, name)

"""Time helpers as Spark column expressions (session time zone is UTC)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ columns."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def minutes_between(start, end) -> Column:
    """(end - start) in minutes as DOUBLE."""
    return (epoch_us(end) - epoch_us(start)).cast("double") / F.lit(60_000_000.0)


def time_block(ts, seconds: int) -> Column:
    """Integer bucket of width ``seconds`` (epoch aligned) — the split key for
    long series.  Blocks are contiguous in time, so each block is an ordered
    slice of its series."""
    return F.floor(epoch_us(ts) / F.lit(int(seconds) * 1_000_000)).cast("long")


def cyclic(value: Column, period: float, fn: str) -> Column:
    """sin/cos of 2*pi*value/period."""
    arg = F.lit(2.0 * math.pi) * value.cast("double") / F.lit(float(period))
    return F.sin(arg) if fn == "sin" else F.cos(arg)


def exact_mean(col: str, scale: int = 6, input_scale: int = 9) -> Column:
    """Aggregate: mean of ``col`` rounded half away from zero to ``scale``
    places, computed exactly — values as DECIMAL(38, input_scale), an exact
    sum, and integral rounding division.  Unlike ``round(avg(x), 6)`` on
    doubles, the digits do not depend on summation order, so any partition
    layout (and the SQL oracle) gives the same result; no rounding ties."""
    x = f"CAST(`{col}` AS DECIMAL(38,{input_scale}))"
    units = f"CAST(sum({x}) * {10 ** input_scale} AS DECIMAL(38,0))"
    den = f"(count({x}) * {10 ** (input_scale - scale)})"
    q = f"((2 * abs({units}) + {den}) div (2 * {den}))"
    return F.expr(f"CASE WHEN count({x}) > 0 THEN CAST(sign({units}) * {q} AS DOUBLE) / {float(10 ** scale)} END")

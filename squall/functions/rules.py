"""Event rules: a name, the logical variables it needs, a predicate over
those variables, and a minimum duration.  Rules are plain Column builders,
never Python UDFs, so every mask stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventRule:
    name: str
    needs: tuple[str, ...]
    predicate: Callable[[Mapping[str, Column]], Column]
    min_hours: float

    @property
    def min_minutes(self) -> float:
        return float(self.min_hours) * 60.0


def usable(value: Column) -> Column:
    """A reading is usable when it is neither NULL nor NaN."""
    return value.isNotNull() & ~F.isnan(value)


def rule_mask(rule: EventRule, cols: Mapping[str, Column]) -> Column:
    """Predicate AND every needed reading usable; unknown counts as False."""
    cond = rule.predicate(cols)
    for v in rule.needs:
        cond = cond & usable(cols[v])
    return F.coalesce(cond, F.lit(False))


def available(rule: EventRule, columns: Sequence[str], mapping: Mapping[str, str | None]) -> bool:
    """A rule applies only when every needed variable maps to a present column."""
    return all(mapping.get(v) is not None and mapping[v] in columns for v in rule.needs)


def _lt(var, x):
    return lambda c: c[var] < F.lit(x)


def _gt(var, x):
    return lambda c: c[var] > F.lit(x)


# --- fixed values: event rules and column maps of the reference ------------
# Second labeler (active rules): name, variables, condition, minimum hours.
LABELER_RULES = (
    EventRule("E3_LowTemp_lt0", ("TempC",), _lt("TempC", 0.0), 2.0),
    EventRule("E4_HighWind_Peak_gt25", ("PkWSpdMph",), _gt("PkWSpdMph", 25.0), 1.0),
    EventRule("E5_LowWind_lt2", ("PkWSpdMph",), _lt("PkWSpdMph", 2.0), 3.0),
)

# First labeler: nine rules as terms (event, variable, op, limit, minimum hours).
FIRST_LABELER_TERMS = (
    ("E1_TempMoistHaz", "TempC", ">", 24.0, 2.0),
    ("E1_TempMoistHaz", "AbsHum", ">", 20.0, 2.0),
    ("E2_WindChill", "TempC", "<=", 4.8, 2.0),
    ("E2_WindChill", "PkWSpdMph", ">=", 3.0, 2.0),
    ("E3_LowTemp_lt0", "TempC", "<", 0.0, 2.0),
    ("E3_LowTemp_lt-5", "TempC", "<", -5.0, 2.0),
    ("E3_LowTemp_lt-10", "TempC", "<", -10.0, 2.0),
    ("E4_HighWind_Peak_gt25", "PkWSpdMph", ">", 25.0, 1.0),
    ("E5_LowWind_lt2", "PkWSpdMph", "<", 2.0, 3.0),
    ("E5_LowWind_lt1", "PkWSpdMph", "<", 1.0, 3.0),
    ("E5_LowWind_lt0_5", "PkWSpdMph", "<", 0.5, 3.0),
)

# Pooled (wide-table) script: same names, other limits and durations.
POOLED_RULES = (
    EventRule("E3_LowTemp_lt0", ("TempC",), _lt("TempC", 3.0), 2.0),
    EventRule("E4_HighWind_Peak_gt25", ("PkWSpdMph",), _gt("PkWSpdMph", 19.0), 0.5),
    EventRule("E5_LowWind_lt2", ("PkWSpdMph",), _lt("PkWSpdMph", 4.0), 1.0),
)

# Tower -> logical variable -> physical column (None = not measured).
TOWER_COLUMNS = {
    "TOWA": {"TempC": "TempC_030m", "AbsHum": "AbsHum_015m", "PkWSpdMph": "PkWSpdMph_030m"},
    "TOWB": {"TempC": "TempC_030m", "AbsHum": None, "PkWSpdMph": "PkWSpdMph_030m"},
    "TOWD": {"TempC": "TempC_035m", "AbsHum": "AbsHum_015m", "PkWSpdMph": "PkWSpdMph_035m"},
    "TOWF": {"TempC": "TempC_010m", "AbsHum": "AbsHum_010m", "PkWSpdMph": "PkWSpdMph_010m"},
    "TOWS": {"TempC": "TempC_025m", "AbsHum": None, "PkWSpdMph": "PkWSpdMph_025m"},
    "TOWY": {"TempC": "TempC_033m", "AbsHum": None, "PkWSpdMph": "PkWSpdMph_033m"},
}

# --- end of fixed values ----------------------------------------------------

# Rules on the driver's hourly `grid` view (temp = hourly mean, peak = max).
GRID_RULES = (
    EventRule("hot", ("temp",), _gt("temp", 60.0), 2.0),
    EventRule("calm", ("temp",), _lt("temp", 42.0), 3.0),
    EventRule("gusty", ("temp", "peak"),
              lambda c: (c["temp"] > F.lit(40.0)) & (c["peak"] > F.lit(100.0)), 1.0),
)


def column_for(var: str, colmap: Mapping[str, Mapping[str, str | None]], series_col: str,
               present: Sequence[str]) -> Column | None:
    """One expression picking each series' physical column for ``var``
    (CASE over the column map); NULL for series that lack it."""
    expr = None
    for series, m in colmap.items():
        name = m.get(var)
        if name is None or name not in present:
            continue
        branch = (F.col(series_col) == F.lit(series))
        expr = F.when(branch, F.col(name)) if expr is None else expr.when(branch, F.col(name))
    return expr.otherwise(F.lit(None).cast("double")) if expr is not None else None


def series_with(rule: EventRule, colmap: Mapping[str, Mapping[str, str | None]],
                present: Sequence[str]) -> list[str]:
    """Series that carry every variable the rule needs (rule availability)."""
    return [s for s, m in colmap.items() if available(rule, present, m)]

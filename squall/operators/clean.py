"""Projection, filter and type-cleaning operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: column-name rules of the reference -----------------------
DROP_SUFFIXES = ("_min", "_meets_duration")
SUMMARY_COLUMNS = ("event_count", "active_events", "event_durations", "has_any_event")
FEATURE_EXCLUDE = ("tower", "timestamp", "event_", "duration", "meets", "active", "count", "has_any",
                   "Unnamed", "index")
TRUE_TEXT = ("true", "1", "yes", "t")
FALSE_TEXT = ("false", "0", "no", "f", "")
# --- end of fixed values ------------------------------------------------------

_NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")


def drop_by_suffix(df: DataFrame, suffixes: Sequence[str] = DROP_SUFFIXES,
                   also: Sequence[str] = SUMMARY_COLUMNS) -> DataFrame:
    """Drop columns ending in any suffix, and the summary columns."""
    return df.drop(*[c for c in df.columns if c.endswith(tuple(suffixes)) or c in also])


def reorder_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """``first`` columns, then the rest in their order."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def select_features(df: DataFrame, exclude: Sequence[str] = FEATURE_EXCLUDE, target: str | None = None) -> list[str]:
    """Numeric columns whose name contains none of the patterns (driver
    side, over the schema only)."""
    return [c for c, t in df.dtypes if t.startswith(_NUMERIC) and c != target
            and not any(p in c for p in exclude)]


def unique_names(names: Sequence[str]) -> list[str]:
    """K7: a list of column names without repeats, in its order."""
    return list(dict.fromkeys(names))


def time_range(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Half-open [start, end) — pushed down to the Parquet scan."""
    return df.filter((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def series_subset(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Keep the listed series (IN filter, pushed down)."""
    return df.filter(F.col(col).isin(*values))


def to_numeric(c: Column) -> Column:
    """Text to DOUBLE, unparsable -> NULL (errors='coerce')."""
    return c.try_cast("double")


def text_to_bool(c: Column, true_text: Sequence[str] = TRUE_TEXT, false_text: Sequence[str] = FALSE_TEXT) -> Column:
    """Explicit text -> BOOLEAN (the text 'False' is False; unknown -> NULL)."""
    t = F.lower(F.trim(c))
    return F.when(t.isin(*true_text), F.lit(True)).when(t.isin(*false_text), F.lit(False))


def bool_to_int(c: Column) -> Column:
    return c.cast("int")


def sample_rows(df: DataFrame, n: int, seed: int, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Exactly ``n`` rows chosen by a seeded hash (md5 of the seed and
    ``key`` as text, so any engine can repeat it; a global top-n, planned as a
    per-partition top-n plus a merge), sorted by ``order``."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key]))
    return df.withColumn("_h", h).orderBy("_h", *key).limit(n).drop("_h").orderBy(*order)

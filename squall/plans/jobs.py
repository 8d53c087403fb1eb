"""End-to-end jobs for the reference's entry points on raw tower files.

These compose the library operators the way the reference scripts chain
their steps, so a user can point them at the tower CSVs directly:

* ``label_tower_files``  — read, detect runs per rule and tower, label every
  reading, optionally write both tables partitioned by tower (entry A);
* ``union_towers``       — merge segments across towers per event and the
  monthly totals (first labeler's union step);
* ``pooled_event_flags`` — pivot to one row per time with ``{tower}_{column}``
  columns, relabel with the pooled limits as k-step duration masks and OR
  across towers (entry C, before feature building).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.functions.rules import (LABELER_RULES, POOLED_RULES, TOWER_COLUMNS, EventRule, column_for,
                                    rule_mask)
from squall.operators import events as ev
from squall.operators import reshape as rs
from squall.sources import io as sio

TOWER_FILE = r"([A-Z]{4})[^/]*\.csv$"


def _needed(rules: Sequence[EventRule]) -> list[str]:
    return sorted({v for r in rules for v in r.needs})


def label_tower_files(spark: SparkSession, raw_path: str, value_cols: Sequence[str],
                      rules: Sequence[EventRule] = LABELER_RULES,
                      colmap: Mapping[str, Mapping[str, str | None]] = TOWER_COLUMNS,
                      tower_pattern: str = TOWER_FILE, out: str | None = None,
                      keep_short: bool = True) -> tuple[DataFrame, DataFrame]:
    """Entry A: (segments, labelled readings).  Each tower's physical column
    for a logical variable comes from ``colmap``; a tower lacking a needed
    variable never fires that rule."""
    df = sio.read_tower_csv(spark, raw_path, value_cols, tower_pattern=tower_pattern)
    cols = {v: column_for(v, colmap, "tower", df.columns) for v in _needed(rules)}
    cols = {v: (c if c is not None else F.lit(None).cast("double")) for v, c in cols.items()}
    segs = ev.event_segments(df, ["tower"], "ts", rules, cols=cols, keep_short=keep_short)
    lab = ev.label_rows(df, ["tower"], "ts", rules, cols=cols)
    if out:
        sio.write_table(segs, f"{out}/segments", "parquet", ["tower"])
        sio.write_table(lab, f"{out}/labelled", "parquet", ["tower"])
    return segs, lab


def union_towers(segments: DataFrame, max_gap_minutes: float = 0.0,
                 default_step_min: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """Merged intervals per event across towers and the monthly totals."""
    merged = ev.merge_intervals(segments, ["event"], max_gap_minutes=max_gap_minutes,
                                default_step_min=default_step_min)
    return merged, ev.monthly_summary(merged)


def pooled_event_flags(readings: DataFrame, towers: Sequence[str], value_cols: Sequence[str],
                       rules: Sequence[EventRule] = POOLED_RULES,
                       colmap: Mapping[str, Mapping[str, str | None]] = TOWER_COLUMNS,
                       step_minutes: float = 15.0, block_rows: int = 200_000) -> DataFrame:
    """Entry C: wide table ``{tower}_{column}`` per time, plus
    ``event_{rule}`` = the rule held for ``min_hours`` of consecutive rows at
    any tower (duration mask per tower, OR across towers)."""
    wide = rs.pivot_wide(readings.select("ts", "tower", *value_cols), "ts", "tower", list(value_cols), list(towers))
    present = set(wide.columns)
    masks, exprs = {}, []
    for rule in rules:
        k = max(1, math.ceil(rule.min_hours * 60.0 / step_minutes))    # a step over the minimum still needs one row
        for t in towers:
            m = colmap.get(t, {})
            names = {v: f"{t}_{m.get(v)}" for v in rule.needs}
            if any(m.get(v) is None or names[v] not in present for v in rule.needs):
                continue
            name = f"_m_{rule.name}_{t}"
            exprs.append(rule_mask(rule, {v: F.col(c) for v, c in names.items()}).alias(name))
            masks[name] = k
    d = wide.select("*", *exprs)
    if masks:
        d = ev.duration_mask(d, [], "ts", masks, block_rows=block_rows)
    flags = []
    for rule in rules:
        cs = [F.col(f"{n}_dur") for n in masks if n.startswith(f"_m_{rule.name}_")]
        acc = F.lit(False)
        for c in cs:
            acc = acc | F.coalesce(c, F.lit(False))
        flags.append(acc.alias(f"event_{rule.name}"))
    return d.select(*wide.columns, *flags)

"""Threshold events: masks -> runs -> segments -> per-row labels, plus the
cross-series interval merge and the event roll-ups (W1-W7, J2, A1-A3).

Runs are found in one pass for all rules at once (``run_scan``): a window over
``(series, time block)`` finds local starts and the next False reading, and a
per-block summary carries the open run and the next False reading across
block borders.  Segments are then simply the run-start rows; labels are the
rows themselves — no join of segments back onto readings is needed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from squall.functions.rules import EventRule, rule_mask
from squall.functions.timecols import epoch_us, minutes_between, time_block
from squall.operators.blocks import BLK, DEFAULT_BLOCK_SECONDS, carry_join, with_block
from squall.session import cut_lineage

SEGMENT_COLUMNS = ["event", "start", "end", "duration_minutes", "meets_min_duration",
                   "min_duration_required_min"]


def add_masks(df: DataFrame, rules: Sequence[EventRule],
              cols: Mapping[str, Column] | None = None) -> tuple[DataFrame, list[str]]:
    """Add one boolean mask column per rule (``_m{j}``).  ``cols`` maps the
    rule's logical variables to columns (default: same-named columns)."""
    present = set(df.columns)
    names = []
    exprs = []
    for j, rule in enumerate(rules):
        mapping = {v: (cols[v] if cols and v in cols else (F.col(v) if v in present else None))
                   for v in rule.needs}
        if any(c is None for c in mapping.values()):
            m = F.lit(False)          # rule not available: never fires
        else:
            m = rule_mask(rule, mapping)
        names.append(f"_m{j}")
        exprs.append(m.alias(f"_m{j}"))
    return df.select("*", *exprs), names


def run_scan(df: DataFrame, keys: Sequence[str], ts: str, masks: Sequence[str],
             block_seconds: int = DEFAULT_BLOCK_SECONDS) -> DataFrame:
    """Per row and per mask ``m``: ``{m}_prev`` (mask of the previous reading),
    ``{m}_st`` (a run starts here), ``{m}_lab`` (inside a run, or the first
    reading after a closed run), ``{m}_start`` / ``{m}_end`` (its run).

    A run ends at the first following False reading; an open run ends at the
    series' last reading.  Masks must be non-null; ``ts`` unique per series.
    """
    keys = list(keys)
    t = F.col(ts)
    b = with_block(df, ts, block_seconds)
    wl = Window.partitionBy(*keys, BLK).orderBy(ts)
    after = wl.rowsBetween(0, Window.unboundedFollowing)
    upto = wl.rowsBetween(Window.unboundedPreceding, 0)

    b1 = b.select("*", *[F.lag(F.col(m), 1).over(wl).alias(f"{m}_lp") for m in masks])
    local = []
    for m in masks:
        mc, lp = F.col(m), F.col(f"{m}_lp")
        local.append(F.min(F.when(~mc, t)).over(after).alias(f"{m}_lnf"))
        local.append(F.max(F.when(mc & (lp == F.lit(False)), t)).over(upto).alias(f"{m}_lls"))
    b2 = b1.select("*", *local)

    # One summary row per (series, block).
    aggs = [F.min(t).alias("_fts"), F.max(t).alias("_lts")]
    for m in masks:
        mc, lp = F.col(m), F.col(f"{m}_lp")
        aggs += [F.min_by(mc, t).alias(f"{m}_fm"), F.max_by(mc, t).alias(f"{m}_lm"),
                 F.max(F.when(mc & (lp == F.lit(False)), t)).alias(f"{m}_ls"),
                 F.min(F.when(~mc, t)).alias(f"{m}_mf")]
    summ = b2.groupBy(*keys, BLK).agg(*aggs)
    ws = Window.partitionBy(*keys).orderBy(BLK) if keys else Window.orderBy(BLK)
    s1 = summ.select("*", *[F.lag(f"{m}_lm", 1).over(ws).alias(f"{m}_plm") for m in masks])
    s2 = s1.select("*", *[(F.col(f"{m}_fm") & ~F.coalesce(F.col(f"{m}_plm"), F.lit(False))).alias(f"{m}_fis")
                          for m in masks])
    s3 = s2.select("*", *[F.greatest(F.col(f"{m}_ls"), F.when(F.col(f"{m}_fis"), F.col("_fts"))).alias(f"{m}_bls")
                          for m in masks])
    prev = ws.rowsBetween(Window.unboundedPreceding, -1)
    nxt = ws.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy()
    carry_cols = [F.max("_lts").over(whole).alias("_smax"), "_fts"]
    for m in masks:
        carry_cols += [f"{m}_plm", f"{m}_fis",
                       F.max(f"{m}_bls").over(prev).alias(f"{m}_cls"),
                       F.min(f"{m}_mf").over(nxt).alias(f"{m}_cnf")]
    carry = s3.select(*keys, BLK, *carry_cols)

    j = carry_join(b2, carry, keys)
    out = []
    for m in masks:
        mc = F.col(m)
        prev_m = F.coalesce(F.col(f"{m}_lp"), F.col(f"{m}_plm"))
        after_run = F.coalesce(prev_m, F.lit(False))
        lab = mc | after_run
        start = F.greatest(F.col(f"{m}_lls"), F.when(F.col(f"{m}_fis"), F.col("_fts")), F.col(f"{m}_cls"))
        end = (F.when(mc, F.coalesce(F.col(f"{m}_lnf"), F.col(f"{m}_cnf"), F.col("_smax")))
               .when(after_run, t))
        out += [prev_m.alias(f"{m}_prev"), (mc & ~after_run).alias(f"{m}_st"), lab.alias(f"{m}_lab"),
                F.when(lab, start).alias(f"{m}_start"), F.when(lab, end).alias(f"{m}_end")]
    base = [c for c in df.columns]
    return j.select(*base, *out)


def event_segments(df: DataFrame, keys: Sequence[str], ts: str, rules: Sequence[EventRule],
                   cols: Mapping[str, Column] | None = None, keep_short: bool = True,
                   block_seconds: int = DEFAULT_BLOCK_SECONDS) -> DataFrame:
    """One row per maximal run of each rule in each series.

    Columns: keys, event, start, end, duration_minutes, meets_min_duration,
    min_duration_required_min.  ``keep_short=False`` drops runs shorter than
    the rule's minimum (first labeler)."""
    keys = list(keys)
    d, masks = add_masks(df.select(*keys, ts, *[c for c in df.columns if c not in keys and c != ts]),
                         rules, cols)
    d = d.select(*keys, ts, *masks)
    r = run_scan(d, keys, ts, masks, block_seconds)
    structs = []
    for rule, m in zip(rules, masks):
        dur = minutes_between(F.col(ts), F.col(f"{m}_end"))
        structs.append(F.when(F.col(f"{m}_st"), F.struct(
            F.lit(rule.name).alias("event"), F.col(ts).alias("start"), F.col(f"{m}_end").alias("end"),
            dur.alias("duration_minutes"), (dur >= F.lit(rule.min_minutes)).alias("meets_min_duration"),
            F.lit(rule.min_minutes).alias("min_duration_required_min"))))
    segs = (r.select(*keys, F.explode(F.filter(F.array(*structs), lambda s: s.isNotNull())).alias("_s"))
            .select(*keys, "_s.*"))
    if not keep_short:
        segs = segs.filter(F.col("meets_min_duration"))
    return segs


def label_rows(df: DataFrame, keys: Sequence[str], ts: str, rules: Sequence[EventRule],
               cols: Mapping[str, Column] | None = None, end_inclusive: bool = True,
               block_seconds: int = DEFAULT_BLOCK_SECONDS) -> DataFrame:
    """Every reading with ``event_{name}``, ``event_{name}_duration_min``,
    ``event_{name}_meets_duration`` per rule, and ``event_count``,
    ``active_events``, ``event_durations``, ``has_any_event``.

    With ``end_inclusive`` (the reference behaviour) the first reading after
    a closed run is labelled with that run too."""
    keys = list(keys)
    d, masks = add_masks(df, rules, cols)
    r = run_scan(d, keys, ts, masks, block_seconds)
    outs, flags, actives, durs = [], [], [], []
    for rule, m in zip(rules, masks):
        lab = F.col(f"{m}_lab") if end_inclusive else F.col(m)
        dur = F.when(lab, minutes_between(F.col(f"{m}_start"), F.col(f"{m}_end")))
        meets = dur >= F.lit(rule.min_minutes)
        name = f"event_{rule.name}"
        outs += [lab.alias(name), F.coalesce(dur, F.lit(0.0)).alias(f"{name}_duration_min"),
                 F.coalesce(meets, F.lit(False)).alias(f"{name}_meets_duration")]
    r2 = r.select(*[c for c in df.columns], *outs)
    for rule in rules:
        name = f"event_{rule.name}"
        lab, dur, meets = F.col(name), F.col(f"{name}_duration_min"), F.col(f"{name}_meets_duration")
        flags.append(lab.cast("int"))
        actives.append(F.when(lab, F.when(meets, F.lit(rule.name)).otherwise(F.lit(rule.name + "*"))))
        durs.append(F.when(lab, F.format_string("%s:%.1fmin", F.lit(rule.name), dur)))
    count = sum(flags[1:], flags[0]) if flags else F.lit(0)
    act = F.concat_ws(",", F.filter(F.array(*actives), lambda x: x.isNotNull()))
    dl = F.concat_ws(",", F.filter(F.array(*durs), lambda x: x.isNotNull()))
    return r2.select("*", count.cast("int").alias("event_count"),
                     F.when(count > 0, act).otherwise(F.lit("none")).alias("active_events"),
                     F.when(count > 0, dl).otherwise(F.lit("none")).alias("event_durations"),
                     (count > 0).alias("has_any_event"))


def merge_intervals(segs: DataFrame, group: Sequence[str], start: str = "start", end: str = "end",
                    max_gap_minutes: float = 0.0, default_step_min: float = 15.0,
                    block_seconds: int = 30 * 24 * 3600, materialize: bool = True) -> DataFrame:
    """Union of intervals per ``group`` (e.g. per event across towers).

    Intervals sorted by (start, end); a new merged interval begins when its
    start is later than every previous end plus the gap.  Zero-length merged
    intervals count ``default_step_min`` minutes.  Runs on (group, block) with
    two carries: the running maximum of earlier ends, and the start of the
    merged interval still open at each block border.  Blocks are the range
    partitions of (group, start, end), of similar size however many
    intervals start in one month; unmaterialised input is cut by time."""
    group = list(group)
    gap_us = int(round(max_gap_minutes * 60_000_000))
    iv = segs.select(*group, F.col(start).alias("_s"), F.col(end).alias("_e"))
    if materialize:
        # the intervals feed three branches (two carries and the main scan);
        # pin them once (reliable checkpoint: small, one row per interval) so
        # the upstream run detection over all readings is not recomputed and
        # partition numbers stay as they are
        iv = cut_lineage(iv.repartitionByRange(*group, "_s", "_e")
                         .withColumn(BLK, F.spark_partition_id().cast("long")))
    else:
        iv = iv.withColumn(BLK, time_block("_s", block_seconds))
    ws = Window.partitionBy(*group).orderBy(BLK) if group else Window.orderBy(BLK)
    prev_blocks = ws.rowsBetween(Window.unboundedPreceding, -1)
    # carry 1: max end of all earlier blocks
    c1 = (iv.groupBy(*group, BLK).agg(F.max("_e").alias("_be"))
          .select(*group, BLK, F.max("_be").over(prev_blocks).alias("_ce")))
    wl = Window.partitionBy(*group, BLK).orderBy("_s", "_e")
    before = wl.rowsBetween(Window.unboundedPreceding, -1)
    a = carry_join(iv, c1, group)
    pe = F.greatest(F.max("_e").over(before), F.col("_ce"))
    a = a.select("*", pe.alias("_pe"))
    flag = F.col("_pe").isNull() | (epoch_us("_s") > epoch_us("_pe") + F.lit(gap_us))
    a = a.select("*", flag.alias("_new"))
    # carry 2: start of the merged interval open at the end of earlier blocks
    c2 = (a.groupBy(*group, BLK).agg(F.max(F.when(F.col("_new"), F.col("_s"))).alias("_bs"))
          .select(*group, BLK, F.max("_bs").over(prev_blocks).alias("_cs")))
    upto = wl.rowsBetween(Window.unboundedPreceding, 0)
    b = carry_join(a, c2, group)
    b = b.select(*group, "_s", "_e",
                 F.coalesce(F.max(F.when(F.col("_new"), F.col("_s"))).over(upto), F.col("_cs")).alias("_g"))
    m = b.groupBy(*group, "_g").agg(F.min("_s").alias(start), F.max("_e").alias(end))
    dur = minutes_between(F.col(start), F.col(end))
    return m.select(*group, start, end,
                    F.when(dur <= 0, F.lit(float(default_step_min))).otherwise(dur).alias("duration_minutes"))


def monthly_summary(merged: DataFrame, event: str = "event", start: str = "start") -> DataFrame:
    """A3: per (year, month of start, event): count and total minutes."""
    return (merged.groupBy(F.year(start).alias("year"), F.month(start).alias("month"), F.col(event).alias("event"))
            .agg(F.count(F.lit(1)).alias("union_count"), F.sum("duration_minutes").alias("union_total_minutes")))


def duration_mask(df: DataFrame, keys: Sequence[str], ts: str, masks: Mapping[str, int],
                  block_rows: int = 200_000, block_seconds: int = DEFAULT_BLOCK_SECONDS) -> DataFrame:
    """``{name}_dur`` True only from the k-th consecutive True reading
    (trailing, causal; the first k-1 readings of a series are False)."""
    from squall.operators.blocks import halo_apply
    reach = max(masks.values()) - 1

    def build(w):
        out = []
        for name, k in masks.items():
            fr = w.rowsBetween(-(k - 1), 0)
            out.append(((F.sum(F.col(name).cast("int")).over(fr) >= F.lit(k))
                        & (F.count(F.lit(1)).over(fr) == F.lit(k))).alias(f"{name}_dur"))
        return out
    return halo_apply(df, keys, [ts], ts, reach, 0, build, block_rows, block_seconds)


def event_frequency(labels: DataFrame, names: Sequence[str]) -> DataFrame:
    """A1: per event the labelled-row count, row count and percentage, plus
    the any-event row ('any') — one aggregation pass, then unpivot."""
    aggs = [F.sum(F.col(f"event_{n}").cast("long")).alias(n) for n in names]
    aggs += [F.sum(F.col("has_any_event").cast("long")).alias("any"), F.count(F.lit(1)).alias("n_rows")]
    wide = labels.agg(*aggs)
    long = wide.unpivot(["n_rows"], [*names, "any"], "event", "n_true")
    pct = F.when(F.col("n_rows") > 0, F.round(F.lit(100.0) * F.col("n_true") / F.col("n_rows"), 6))
    return long.select("event", F.col("n_true").cast("long").alias("n_true"), "n_rows", pct.alias("pct"))


def cooccurrence(labels: DataFrame, by: str, more_than: int = 2) -> DataFrame:
    """A2: rows per ``by`` with any event and with more than ``more_than``
    simultaneous events."""
    c = F.col("event_count")
    return labels.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(c >= 1, 1)).alias("n_any"),
        F.count(F.when(c > more_than, 1)).alias("n_multi"),
        F.max(c).alias("max_count"))

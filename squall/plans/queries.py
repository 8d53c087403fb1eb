"""Registered queries: (spark, sf_dir) -> DataFrame, one per SURVEY §5.3 key.

Every query reads the driver tables through ``squall.plans.views`` and runs
the library's operators over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from squall.functions.rules import GRID_RULES, rule_mask
from squall.functions.timecols import epoch_us
from squall.operators import events as ev
from squall.operators import clean as cl
from squall.operators import evaluate as evl
from squall.operators import features as fe
from squall.operators import importance as im
from squall.operators import joins as jn
from squall.operators import logs as lg
from squall.operators import model as ml
from squall.operators import pooled
from squall.operators import report as rp
from squall.operators import reshape as rs
from squall.operators import rule_table as rt
from squall.operators import settings as so
from squall.operators import stations as gs
from squall.operators import stats as st
from squall.session import cut_lineage, shared_dir
from squall.plans import views as V
from squall.sources import io as sio

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    """Round to 6 places (only where the two engines sum in other orders)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


# ---------------------------------------------------------------- events
def _segments(spark, sf, keep_short=True):
    g = V.grid(spark, sf)
    s = ev.event_segments(g, ["series"], "ts", GRID_RULES, keep_short=keep_short)
    return s.select("series", "event", "start", "end", r6("duration_minutes").alias("duration_minutes"),
                    "meets_min_duration", "min_duration_required_min")


@query("event_segments")
def q_event_segments(spark, sf):
    """P4 + W1 + W2: runs of the three grid rules per series."""
    return _segments(spark, sf)


@query("event_segments_min_duration")
def q_event_segments_min(spark, sf):
    """W1 variant of the first labeler: runs shorter than the minimum dropped."""
    return _segments(spark, sf, keep_short=False)


def _labels(spark, sf):
    return ev.label_rows(V.grid(spark, sf), ["series"], "ts", GRID_RULES)


@query("label_rows")
def q_label_rows(spark, sf):
    """W3 + W4: every grid reading labelled per rule, with the row summary."""
    lab = _labels(spark, sf)
    return lab.select(*[r6(c).alias(c) if c.endswith("_duration_min") else c for c in lab.columns])


@query("interval_label_join")
def q_interval_label_join(spark, sf):
    """J2(b): readings inside [start, end] of their series' segments, by the
    bucketised equi-join (no theta join)."""
    from squall.operators.joins import interval_join
    g = V.grid(spark, sf).select("series", "ts")
    segs = V.segments(spark, sf)
    j = interval_join(g, segs, ["series"], "ts", "start", "end", bucket_seconds=6 * 3600)
    return j.select("series", "ts", "event", r6("duration_minutes").alias("duration_minutes"),
                    "meets_min_duration")


def _merged(spark, sf):
    return ev.merge_intervals(V.segments(spark, sf), ["event"], max_gap_minutes=0.0)


@query("union_segments")
def q_union_segments(spark, sf):
    """Segments merged per event across the five series."""
    m = _merged(spark, sf)
    return m.select("event", "start", "end", r6("duration_minutes").alias("duration_minutes"))


@query("monthly_event_summary")
def q_monthly(spark, sf):
    """A3: merged segments per (year, month of start, event)."""
    s = ev.monthly_summary(_merged(spark, sf))
    return s.select("year", "month", "event", "union_count", r6("union_total_minutes").alias("union_total_minutes"))


@query("event_frequency")
def q_event_frequency(spark, sf):
    """A1 + R5: labelled rows per event and the any-event rate."""
    return ev.event_frequency(_labels(spark, sf), [r.name for r in GRID_RULES])


@query("event_cooccurrence")
def q_event_cooccurrence(spark, sf):
    """A2: active events per row; rows with more than two per series."""
    return ev.cooccurrence(_labels(spark, sf), "series", more_than=2)


# ---------------------------------------------------------------- reshape

WIDE_COLS = [f"{s}_{v}" for s in V.SERIES for v in ("temp", "peak")]
GRID_STEPS = {"hot": 2, "calm": 3, "gusty": 1}   # rule minimum in hourly steps


@query("wide_pivot")
def q_wide_pivot(spark, sf):
    """R2: grid pivoted to one row per hour."""
    return V.wide(spark, sf)


def _union_masks(spark, sf):
    """W6 + W7 on the pooled wide table: per series the rule must hold for k
    consecutive rows; OR across series.  The wide table has no series key,
    so the k-row windows run on position blocks with a halo."""
    w = V.wide(spark, sf)
    masks = {}
    exprs = []
    for rule in GRID_RULES:
        for s in V.SERIES:
            cols = {"temp": F.col(f"{s}_temp"), "peak": F.col(f"{s}_peak")}
            name = f"_m_{rule.name}_{s}"
            exprs.append(rule_mask(rule, cols).alias(name))
            masks[name] = GRID_STEPS[rule.name]
    d = w.select("*", *exprs)
    dm = ev.duration_mask(d, [], "ts", masks)      # keeps every wide column
    out = []
    for rule in GRID_RULES:
        cs = [F.col(f"_m_{rule.name}_{s}_dur") for s in V.SERIES]
        acc = cs[0]
        for c in cs[1:]:
            acc = acc | c
        out.append(acc.alias(f"event_{rule.name}"))
    return dm.select(*w.columns, *out)


@query("duration_mask_union")
def q_duration_mask_union(spark, sf):
    return _union_masks(spark, sf).select("ts", *[f"event_{r.name}" for r in GRID_RULES])


def _resampled(spark, sf):
    u = _union_masks(spark, sf)
    return rs.resample(u, [], "ts", 7200, WIDE_COLS, [f"event_{r.name}" for r in GRID_RULES])


def _filled(spark, sf):
    r = _resampled(spark, sf)
    f = rs.fill_forward_backward(r, [], "ts", WIDE_COLS, final=0.0)
    return f.select("ts", *WIDE_COLS, *[F.coalesce(F.col(f"event_{x.name}"), F.lit(False)).alias(f"event_{x.name}")
                                        for x in GRID_RULES])


@query("resample_2h")
def q_resample_2h(spark, sf):
    """2-hour bins (mean of readings, max of event flags), empty bins kept."""
    r = _resampled(spark, sf)
    return r.select("ts", *WIDE_COLS, *[f"event_{x.name}" for x in GRID_RULES])


@query("resample_fill")
def q_resample_fill(spark, sf):
    """R1 + W16: forward fill, backward fill, then 0; events False-filled."""
    f = _filled(spark, sf)
    return f.select("ts", *WIDE_COLS, *[f"event_{x.name}" for x in GRID_RULES])


@query("aux_left_join")
def q_aux_left_join(spark, sf):
    """Resampled timeline left-joined with the hourly side table, filled."""
    f = _filled(spark, sf)
    j = rs.left_join_fill(f, V.aux(spark, sf), "ts", ["aux_k"])
    return j.select("ts", r6("aux_k").alias("aux_k"), "click_temp", "event_hot")


def _null_profile(spark, sf):
    p = rs.null_profile(V.wide(spark, sf), WIDE_COLS)
    return p.select("column", F.substring_index("column", "_", 1).alias("tower"), "null_pct")


@query("null_profile")
def q_null_profile(spark, sf):
    """P10: % NULL per column of the wide table, by tower prefix."""
    return _null_profile(spark, sf)


@query("null_bands")
def q_null_bands(spark, sf):
    """Columns per 10 % NULL band per tower."""
    return rs.null_bands(_null_profile(spark, sf), ["tower"])


@query("keep_columns_below")
def q_keep_columns_below(spark, sf):
    """Per tower, the columns whose NULL band's upper edge is <= 30 %."""
    return rs.keep_columns_below(_null_profile(spark, sf), 30.0, ["tower"])


@query("columns_below_threshold")
def q_columns_below(spark, sf):
    """Columns kept at <= 80 % NULL and the band counts."""
    return rs.columns_by_null_threshold(_null_profile(spark, sf), 80.0)


# ---------------------------------------------------------------- features

OBS_KEYS = ["series", "var"]
OBS_LAGS = fe.LAG_CONFIGS["short"]
OBS_WINDOWS = [4, 12]


@query("lag_features")
def q_lag_features(spark, sf):
    """Value 1, 2, 4, 8 readings earlier per (series, variable)."""
    d = fe.temporal_features(V.obs(spark, sf), OBS_KEYS, "ts", ["value"], lags=OBS_LAGS)
    return d.select(*OBS_KEYS, "ts", "value", *[f"value_lag{k}" for k in OBS_LAGS])


@query("rolling_features")
def q_rolling_features(spark, sf):
    """W9 + W10: full-window rolling mean / sample std / min / max."""
    stats = ["mean", "std", "min", "max"]
    d = fe.temporal_features(V.obs(spark, sf), OBS_KEYS, "ts", ["value"], windows=OBS_WINDOWS, stats=stats)
    cols = [f"value_roll{n}_{s}" for n in OBS_WINDOWS for s in stats]
    return d.select(*OBS_KEYS, "ts", *[r6(c).alias(c) for c in cols])


@query("diff_features")
def q_diff_features(spark, sf):
    """First and second differences."""
    d = fe.temporal_features(V.obs(spark, sf), OBS_KEYS, "ts", ["value"], diffs=True)
    return d.select(*OBS_KEYS, "ts", "value_diff1", "value_diff2")


@query("future_target")
def q_future_target(spark, sf):
    """W15 + P8: target 4 readings ahead; rows with any missing feature or
    target dropped — lags, rolls and lead built in one pass."""
    o = V.obs(spark, sf).withColumn("target", (F.col("value") > F.lit(100.0)).cast("int"))
    d = fe.temporal_features(o, OBS_KEYS, "ts", ["value"], lags=OBS_LAGS, windows=[4], stats=["mean"],
                             leads={"target_h4": ("target", 4)})
    feats = [f"value_lag{k}" for k in OBS_LAGS] + ["value_roll4_mean", "target_h4"]
    d = fe.drop_incomplete(d, feats)
    return d.select(*OBS_KEYS, "ts", "value", r6("value_roll4_mean").alias("value_roll4_mean"), "target_h4")


@query("sequences")
def q_sequences(spark, sf):
    """The last 4 readings of each (series, variable) as one sample."""
    L = 4
    d = fe.temporal_features(V.obs(spark, sf), OBS_KEYS, "ts", ["value"], sequence=(["value"], L))
    d = d.filter(F.col("seq").isNotNull())
    return d.select(*OBS_KEYS, "ts", *[F.col("seq").getItem(i).getField("value").alias(f"seq_{i}") for i in range(L)])


def _wide_events(spark, sf):
    return _union_masks(spark, sf)


@query("cross_series_stats")
def q_cross_series_stats(spark, sf):
    """Mean, sample std, range across series and deviations, per hour."""
    w = V.wide(spark, sf)
    for var in ("temp", "peak"):
        w = fe.cross_series_stats(w, var, V.SERIES)
    out = [c for c in w.columns if c.endswith(("_tower_mean", "_tower_std", "_tower_range", "_dev_from_mean"))]
    return w.select("ts", *out)


@query("cyclic_time")
def q_cyclic_time(spark, sf):
    """Calendar encodings of the wide timeline."""
    w = fe.cyclic_time(V.wide(spark, sf).select("ts"), "ts")
    return w.select("ts", *[r6(c).alias(c) for c in w.columns if c != "ts"])


GRID_LIMITS = {"temp_hot": 60.0, "temp_calm": 42.0, "peak_gusty": 100.0}


@query("threshold_distance")
def q_threshold_distance(spark, sf):
    """Distance of each series' reading to the limit of each rule."""
    w = V.wide(spark, sf)
    limits, suffix = {}, {}
    for s in V.SERIES:
        for key, lim in GRID_LIMITS.items():
            var, rule = key.split("_")
            c = f"{s}_{var}"
            w = w.withColumn(f"{c}_{rule}", F.col(c))
            limits[f"{c}_{rule}"] = lim
            suffix[f"{c}_{rule}"] = f"{int(lim)}"
    d = fe.threshold_distance(w, limits, suffix)
    out = [c for c in d.columns if "_dist_to_" in c]
    return d.select("ts", *[r6(c).alias(c) for c in out])


@query("sensor_event_corr")
def q_sensor_event_corr(spark, sf):
    """|Pearson r| of every reading column with every event flag, one
    aggregation pass (zero variance -> NULL instead of an error)."""
    w = _wide_events(spark, sf)
    parts, names = [], []
    for c in WIDE_COLS:
        for r in GRID_RULES:
            p = f"{c}__{r.name}"
            parts += st.pearson_parts(F.col(c), F.col(f"event_{r.name}").cast("double"), p)
            names.append((c, r.name, p))
    a = w.agg(*parts)
    cols = [F.struct(F.lit(c).alias("column"), F.lit(e).alias("event"),
                     F.round(F.abs(st.pearson_from_parts(p)), 6).alias("abs_corr")) for c, e, p in names]
    return a.select(F.inline(F.array(*cols)))


@query("time_slices")
def q_time_slices(spark, sf):
    """8 equal time spans; mean value, rows and events per variable
    (the last slice is closed so the latest reading is kept)."""
    o = V.obs(spark, sf)
    return st.time_slices(o, "ts", "var", "value", 8, F.col("value") > F.lit(100.0))


@query("robust_range")
def q_robust_range(spark, sf):
    """Exact 5 % and 95 % quantiles of each variable."""
    q = st.exact_quantiles(V.obs(spark, sf), ["var"], "value", [0.05, 0.95], ["q05", "q95"])
    return q.select("var", r6("q05").alias("q05"), r6("q95").alias("q95"))


@query("step_minutes")
def q_step_minutes(spark, sf):
    """Median gap between consecutive readings per series, 15 when a
    series has fewer than two readings."""
    return st.step_minutes(V.obs(spark, sf), ["series"], "ts")


# ---------------------------------------------------------------- evaluation

K_FOLDS = 5
F2_GRID = [0.1 + i * 0.05 for i in range(10)]   # numpy.arange(0.1, 0.6, 0.05)


def _folded(spark, sf):
    return evl.assign_folds(V.scored(spark, sf), V.SCORED_ORDER, "l_shipdate", K_FOLDS)


@query("ts_folds")
def q_ts_folds(spark, sf):
    """Expanding-window folds over the time-ordered validation rows."""
    d = _folded(spark, sf)
    n = F.col("n_rows")
    aggs = []
    for j in range(1, K_FOLDS + 1):
        lo, _hi = evl.fold_bounds(n, K_FOLDS, j)
        aggs += [F.count(F.when(F.col("_pos") < lo, 1)).alias(f"tr{j}"),
                 F.count(F.when((F.col("_pos") < lo) & F.col("label"), 1)).alias(f"trp{j}"),
                 F.count(F.when(F.col("test_fold") == j, 1)).alias(f"te{j}"),
                 F.count(F.when((F.col("test_fold") == j) & F.col("label"), 1)).alias(f"tep{j}"),
                 F.min(F.when(F.col("test_fold") == j, F.col("_pos"))).alias(f"ts{j}")]
    a = d.agg(*aggs)
    rows = [F.struct(F.lit(j).alias("fold"), F.col(f"tr{j}").alias("n_train"), F.col(f"trp{j}").alias("train_positives"),
                     F.col(f"te{j}").alias("n_test"), F.col(f"tep{j}").alias("test_positives"),
                     F.col(f"ts{j}").alias("test_start")) for j in range(1, K_FOLDS + 1)]
    return a.select(F.inline(F.array(*rows)))


@query("holdout_split")
def q_holdout_split(spark, sf):
    """The first floor(0.8 n) rows in time order train, the rest test."""
    d = _folded(spark, sf)
    split = F.when(F.col("_pos") < F.floor(F.col("n_rows") * F.lit(0.8)), F.lit("train")).otherwise(F.lit("test"))
    return d.groupBy(split.alias("split")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("label"), 1)).alias("n_pos"),
        F.min("l_shipdate").alias("first_ts"), F.max("l_shipdate").alias("last_ts"))


@query("class_weights")
def q_class_weights(spark, sf):
    """M1 + M2: balanced and power-0.75 class weights of each fold's
    training rows."""
    folds = q_ts_folds(spark, sf)
    wp, wn = evl.class_weight_balanced(F.col("n_train"), F.col("train_positives"))
    return folds.select("fold", "n_train", "train_positives", r6(wp).alias("w_pos_balanced"),
                        r6(wn).alias("w_neg_balanced"),
                        r6(evl.class_weight_power(F.col("n_train"), F.col("train_positives"))).alias("w_pos_pow75"))


def _scores(spark, sf):
    return evl.score_table(V.scored(spark, sf), ["model"], "score", "label")


@query("confusion_metrics")
def q_confusion_metrics(spark, sf):
    """M7 + A35: cells, ten metrics and row shares at threshold 0.5."""
    s = V.scored(spark, sf)
    cells = evl.confusion_cells(s, ["model"], "label", F.col("score") >= F.lit(0.5))
    m = evl.confusion_shares(evl.metrics_from_cells(cells))
    return m


@query("roc_auc")
def q_roc_auc(spark, sf):
    """M8: exact ROC AUC per model (ties get average ranks)."""
    return evl.roc_auc(_scores(spark, sf), ["model"]).select("model", r6("roc_auc").alias("roc_auc"))


@query("average_precision")
def q_average_precision(spark, sf):
    """M9: average precision per model."""
    a = evl.average_precision(_scores(spark, sf), ["model"])
    return a.select("model", r6("average_precision").alias("average_precision"))


@query("best_threshold_f1")
def q_best_threshold_f1(spark, sf):
    """M5: best-F1 threshold over all distinct scores, lowest on ties."""
    b = evl.best_threshold_f1(_scores(spark, sf), ["model"])
    return b.select("model", "threshold", r6("f1").alias("f1"), "tp", "fp", "fn", "tn")


@query("best_threshold_f2")
def q_best_threshold_f2(spark, sf):
    """M6: F2 over the fixed grid 0.10 .. 0.55, first strict improvement."""
    b = evl.best_threshold_fbeta(V.scored(spark, sf), ["model"], "score", "label", F2_GRID, 2.0, 0.3)
    return b.select("model", "threshold", r6("fbeta").alias("fbeta"))


# ---------------------------------------------------------------- reports

EXP_KEYS = ["horizon", "event", "model"]
MODEL_NAMES = ["lightgbm", "xgboost"]


def _summary(spark, sf):
    long = rp.long_metrics(rp.with_rates(V.results(spark, sf)), [*EXP_KEYS, "split"])
    return rp.fold_summary(long, EXP_KEYS)


def _r6all(df, skip=()):
    return df.select(*[r6(c).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


@query("fold_summary")
def q_fold_summary(spark, sf):
    """A5: mean and population std of each metric over the folds (CV and
    test halves) per experiment; cells get the mean."""
    return _r6all(_summary(spark, sf))


def _means(spark, sf):
    return _summary(spark, sf).filter(F.col("metric").isin(*rp.METRICS))


@query("best_by_event")
def q_best_by_event(spark, sf):
    """A6 + A7 + A10: per event and model, best horizon per metric, mean
    and sample std across horizons, total samples and mean event rate."""
    b = rp.best_by_group(_means(spark, sf), "event", "horizon")
    t = rp.group_totals(V.results(spark, sf), "event", "horizon").drop("n_horizon")
    return _r6all(b.join(t, "event", "inner"))


@query("best_by_series")
def q_best_by_series(spark, sf):
    """A6 + A7 + A10: per series (horizon) and model, best event per metric,
    with the group's total samples and mean event rate."""
    b = rp.best_by_group(_means(spark, sf), "horizon", "event")
    t = rp.group_totals(V.results(spark, sf), "horizon", "event").drop("n_event")
    return _r6all(b.join(t, "horizon", "inner"))


def _auc_means(spark, sf):
    return _means(spark, sf).filter(F.col("metric") == "auc_roc")


@query("best_model_per_pair")
def q_best_model_per_pair(spark, sf):
    """Larger mean AUC wins per (horizon, event); tie -> first model."""
    return _r6all(rp.best_model_per_pair(_auc_means(spark, sf), ["horizon", "event"], MODEL_NAMES))


@query("rank_experiments")
def q_rank_experiments(spark, sf):
    """Every (horizon, event) ranked by mean AUC per model."""
    return _r6all(rp.rank_experiments(_auc_means(spark, sf), ["horizon", "event"]))


@query("overall_stats")
def q_overall_stats(spark, sf):
    """Mean, sample std, min, max per model and metric."""
    return _r6all(rp.overall_stats(_means(spark, sf)))


@query("search_summary")
def q_search_summary(spark, sf):
    """Best (over models) mean MCC per experiment, summarised per event."""
    m = _means(spark, sf).filter(F.col("metric") == "mcc").groupBy("horizon", "event").agg(F.max("mean").alias("best"))
    g = m.groupBy("event").agg(F.avg("best").alias("mean"), F.stddev_samp("best").alias("std"),
                               F.max("best").alias("max"), F.count(F.lit(1)).alias("n_experiments"))
    return _r6all(g)


def _ht(spark, sf):
    return rp.horizon_table(V.results(spark, sf), "horizon", "event", "model", "split")


def _hstats(spark, sf):
    return rp.horizon_stats(_ht(spark, sf), V.HORIZONS)


@query("horizon_stats")
def q_horizon_stats(spark, sf):
    """Mean and std of test AUC/F1/MCC per horizon (fixed order)."""
    return _r6all(_hstats(spark, sf))


@query("degradation")
def q_degradation(spark, sf):
    """% drop of each horizon's means against the 1hr baseline."""
    return _r6all(rp.degradation(_hstats(spark, sf), V.HORIZONS[0]))


@query("overfit_gap")
def q_overfit_gap(spark, sf):
    """CV minus test gaps by horizon and by model (grouping sets)."""
    return _r6all(rp.overfit_gap(_ht(spark, sf)))


@query("error_profile")
def q_error_profile(spark, sf):
    """False-alarm and miss rates by horizon and by event."""
    return _r6all(rp.error_profile(_ht(spark, sf)))


@query("pr_balance")
def q_pr_balance(spark, sf):
    """Precision-recall balance per horizon."""
    return _r6all(rp.pr_balance(_ht(spark, sf)))


@query("horizon_gate")
def q_horizon_gate(spark, sf):
    """Horizons meeting AUC > .90, F1 > .50, MCC > .50 and the cutoff."""
    return _r6all(rp.horizon_gate(_hstats(spark, sf)))


@query("reliability")
def q_reliability(spark, sf):
    """Reliability band per event and the model advantage."""
    return _r6all(rp.reliability(_ht(spark, sf), MODEL_NAMES))


@query("score_matrix")
def q_score_matrix(spark, sf):
    """Mean test F1 per model x event, one column per horizon."""
    return _r6all(rp.score_matrix(_ht(spark, sf), V.HORIZONS))


@query("paired_t")
def q_paired_t(spark, sf):
    """M14 + J3: paired t-test lightgbm vs xgboost on test AUC/F1/MCC."""
    return _r6all(rp.paired_t(_ht(spark, sf), ["horizon", "event"], MODEL_NAMES, ["test_auc", "test_f1", "test_mcc"]))


# ---------------------------------------------------------------- importance


def _files(spark, sf):
    """All importance rows with rank and percent of their (tower, event)
    total (W18 without its cut): the roll-ups count every feature."""
    return im.rank_features(V.importance(spark, sf), ["tower", "event"], top_n=None)


PCT = "importance_pct"


@query("global_importance")
def q_global_importance(spark, sf):
    """Per feature mean, sample std, min, max, count of importance %."""
    return _r6all(im.global_importance(_files(spark, sf), importance=PCT))


@query("importance_by_event")
def q_importance_by_event(spark, sf):
    """A20 + K3: top 10 features by mean importance % per event."""
    return _r6all(im.importance_by(_files(spark, sf), "event", 10, importance=PCT))


@query("category_importance")
def q_category_importance(spark, sf):
    """A21 + J7: category totals and the category x event matrix of the top 15."""
    return _r6all(im.category_importance(_files(spark, sf), "event", 15, importance=PCT))


@query("family_share")
def q_family_share(spark, sf):
    """Lag / rolling / raw share of importance %."""
    return _r6all(im.family_share(_files(spark, sf), importance=PCT))


@query("importance_matrix")
def q_importance_matrix(spark, sf):
    """Feature x event mean importance % (missing 0), ordered by row
    mean.  Pivot values are the distinct events (a tiny driver-side list)."""
    f = _files(spark, sf)
    events = sorted(r[0] for r in V.importance(spark, sf).select("event").distinct().collect())
    return _r6all(im.importance_matrix(f, "feature", "event", events, importance=PCT))


@query("rank_features")
def q_rank_features(spark, sf):
    """W18 + K2: rank, percent of total and top 20 per (tower, event) — the
    report whose feature the cut is."""
    return _r6all(im.rank_features(V.importance(spark, sf), ["tower", "event"], top_n=20))


@query("box_stats")
def q_box_stats(spark, sf):
    """Quartiles and whiskers of importance % per event."""
    return _r6all(im.box_stats(_files(spark, sf), "event", PCT))


@query("series_importance")
def q_series_importance(spark, sf):
    """Total importance % per tower."""
    return _r6all(im.total_by(_files(spark, sf), "tower", importance=PCT))


# ---------------------------------------------------------------- stations
def _stations(spark, sf):
    """G1 + G3-G6: coordinates, relative elevation, fallbacks, terrain class
    and derived attributes.  Whole-table extremes and the centre come from
    one single-row aggregate joined back (its size is one row)."""
    s = V.station(spark, sf)
    lat, lon = gs.utm_to_latlon(F.col("easting"), F.col("northing"))
    s = s.select("*", lat.alias("lat"), lon.alias("lon"))
    s = gs.with_fallbacks(s.withColumn("slope_deg", F.lit(None).cast("double")).withColumn("aspect_deg", F.lit(None).cast("int")))
    return _attributes(s)


def _attributes(s):
    s = s.withColumn("terrain_type", gs.terrain_class(F.col("rel_elev"), F.col("slope_deg")))
    s = s.withColumn("canopy_cover_pct", gs.canopy_pct(F.col("terrain_type"), F.col("rel_elev")))
    return s.select("*", gs.ridge_distance(F.col("terrain_type"), F.col("elevation_m"), F.col("max_elev")).alias("dist_to_ridge_m"),
                    gs.soil_type(F.col("terrain_type"), F.col("slope_deg")).alias("soil_type"),
                    gs.land_use(F.col("terrain_type"), F.col("canopy_cover_pct")).alias("land_use"),
                    gs.distance_km(F.col("lat"), F.col("lon"), F.col("center_lat"), F.col("center_lon")).alias("dist_from_center_km"),
                    (F.col("elevation_m") + F.col("height_m")).alias("total_height_m"))


@query("utm_to_latlon")
def q_utm_to_latlon(spark, sf):
    """G1: station coordinates by the UTM series expansion."""
    s = V.station(spark, sf)
    lat, lon = gs.utm_to_latlon(F.col("easting"), F.col("northing"))
    return s.select("tower", r6(lat).alias("lat"), r6(lon).alias("lon"))


@query("terrain_class")
def q_terrain_class(spark, sf):
    """G3 + G5: relative elevation, slope fallback, terrain type."""
    s = _stations(spark, sf)
    return _r6all(s.select("tower", "elevation_m", "rel_elev", "slope_deg", "terrain_type"))


@query("station_attributes")
def q_station_attributes(spark, sf):
    """G4 + G5 + G6: aspect fallback, ridge distance, canopy, soil, land use,
    distance from the centre."""
    s = _stations(spark, sf)
    return _r6all(s.select("tower", "aspect_deg", "dist_to_ridge_m", "canopy_cover_pct", "soil_type", "land_use",
                           "dist_from_center_km", "total_height_m"))


def _profile(spark, sf):
    """A25 + J4: per (event, tower) the top-5 importance share and the top
    feature, joined to the station dimension (towers without a station are
    skipped by the inner join)."""
    r = im.rank_features(V.importance(spark, sf), ["tower", "event"], top_n=5)
    # rounded to 9 places so float summation noise cannot break rank ties
    top = r.groupBy("tower", "event").agg(
        F.round(F.sum("importance_pct"), 9).alias("top5_importance"),
        F.min(F.when(F.col("rank") == 1, F.struct(F.col("feature"), F.col("importance_pct")))).alias("_t1"))
    st_ = _stations(spark, sf).select("tower", "elevation_m", "height_m", "total_height_m", "slope_deg",
                                      "canopy_cover_pct", "terrain_type", "dist_from_center_km", "lat", "lon")
    return top.join(st_, "tower", "inner").select(
        "event", "tower", "top5_importance", F.col("_t1.feature").alias("top1_feature"),
        F.col("_t1.importance_pct").alias("top1_importance"), "elevation_m", "height_m", "total_height_m",
        "slope_deg", "canopy_cover_pct", "terrain_type", "dist_from_center_km", "lat", "lon")


@query("station_profile")
def q_station_profile(spark, sf):
    return _r6all(_profile(spark, sf))


@query("spearman_geo")
def q_spearman_geo(spark, sf):
    """Spearman r (average ranks) of ground elevation and total height
    with the top-5 importance, per event, with t-based p and stars."""
    p = _profile(spark, sf)
    g = st.rank_pairs(p, ["event"], [(geo, "top5_importance") for geo in ("elevation_m", "total_height_m")])
    r, n = F.col("r"), F.col("n")
    t = r * F.sqrt((n - 2).cast("double") / (F.lit(1.0) - r * r))
    pv = rp.t_two_sided_p(t, (n - 2).cast("int"))
    u = g.filter(n >= 3).select("event", F.col("x").alias("variable"), "n", r.alias("spearman_r"),
                                F.when(F.abs(r) < 1, pv).when(r.isNotNull(), F.lit(0.0)).alias("p_value"))
    stars = (F.when(F.col("p_value") < 0.001, F.lit("***")).when(F.col("p_value") < 0.01, F.lit("**"))
             .when(F.col("p_value") < 0.05, F.lit("*")).otherwise(F.lit("ns")))
    return _r6all(u.select("*", stars.alias("significance")))


@query("linear_trend")
def q_linear_trend(spark, sf):
    """Least-squares slope and intercept of top-5 importance on elevation."""
    p = _profile(spark, sf)
    return _r6all(p.groupBy("event").agg(F.regr_slope("top5_importance", "elevation_m").alias("slope"),
                                         F.regr_intercept("top5_importance", "elevation_m").alias("intercept"),
                                         F.regr_count("top5_importance", "elevation_m").alias("n")))


@query("terrain_group")
def q_terrain_group(spark, sf):
    """Mean top-5 importance and count per terrain type, fixed order."""
    p = _profile(spark, sf)
    g = p.groupBy("terrain_type").agg(F.avg("top5_importance").alias("mean_top5"), F.count(F.lit(1)).alias("n"))
    return _r6all(rp.with_order(g, "terrain_type", gs.TERRAIN_ORDER, "terrain_order"))


@query("spatial_extent")
def q_spatial_extent(spark, sf):
    """N-S / E-W spread in km, elevation and height ranges, and the
    region bounds padded by 1 km."""
    s = _stations(spark, sf)
    a = s.agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"),
              F.max("lon").alias("max_lon"), F.avg("lat").alias("mean_lat"), F.min("elevation_m").alias("min_elev"),
              F.max("elevation_m").alias("max_elev"), F.min("height_m").alias("min_height"),
              F.max("height_m").alias("max_height"), F.min("total_height_m").alias("min_total"),
              F.max("total_height_m").alias("max_total"))
    km = F.lit(gs.KM_PER_DEGREE)
    lat_pad = F.lit(1.0) / km
    lon_pad = F.lit(1.0) / (km * F.cos(F.radians("mean_lat")))
    return _r6all(a.select(
        ((F.col("max_lat") - F.col("min_lat")) * km).alias("lat_spread_km"),
        F.abs((F.col("max_lon") - F.col("min_lon")) * km * F.cos(F.radians("mean_lat"))).alias("lon_spread_km"),
        "min_elev", "max_elev", (F.col("max_elev") - F.col("min_elev")).alias("elev_range"),
        "min_height", "max_height", "min_total", "max_total",
        (F.col("min_lat") - lat_pad).alias("bound_min_lat"), (F.col("max_lat") + lat_pad).alias("bound_max_lat"),
        (F.col("min_lon") - lon_pad).alias("bound_min_lon"), (F.col("max_lon") + lon_pad).alias("bound_max_lon")))


# ---------------------------------------------------------------- raster
CELL_SIZE_M = 100.0


@query("slope_aspect")
def q_slope_aspect(spark, sf):
    """Horn slope and aspect on every interior raster cell."""
    r = gs.slope_aspect(V.raster(spark, sf), CELL_SIZE_M)
    return _r6all(r.select("x", "y", "slope_deg", "aspect_deg"))


def _raster_ext(spark, sf):
    r = V.raster(spark, sf)
    ext = r.agg(F.min("z").alias("_zmin"), F.max("z").alias("_zmax"))
    return r.withColumn("_one", F.lit(1)).join(F.broadcast(ext.withColumn("_one", F.lit(1))), "_one").drop("_one")


@query("minmax_scale")
def q_minmax_scale(spark, sf):
    """Elevation scaled to [0, 1] over the whole raster."""
    r = _raster_ext(spark, sf)
    return _r6all(r.select("x", "y", gs.relative(F.col("z"), F.col("_zmin"), F.col("_zmax")).alias("z_scaled")))


def _zones(spark, sf):
    r = _raster_ext(spark, sf)
    q = st.exact_quantiles(V.raster(spark, sf), [], "z", gs.ZONE_PERCENTILES, ["p20", "p40", "p60", "p80"])
    r = r.withColumn("_one", F.lit(1)).join(F.broadcast(q.withColumn("_one", F.lit(1))), "_one").drop("_one")
    rel = gs.relative(F.col("z"), F.col("_zmin"), F.col("_zmax"))
    return r.select("x", "y", "z",
                    gs.zone_of(F.col("z"), [F.col(c) for c in ("p20", "p40", "p60", "p80")], False).alias("zone_percentile"),
                    gs.zone_of(rel, [F.lit(v) for v in gs.ZONE_RELATIVE], False).alias("zone_relative"),
                    gs.zone_of(F.col("z"), [F.lit(v) for v in gs.ZONE_ABSOLUTE], True).alias("zone_absolute"))


@query("elevation_zones")
def q_elevation_zones(spark, sf):
    """Zone of every cell by the percentile, relative and absolute methods."""
    return _zones(spark, sf).select("x", "y", "zone_percentile", "zone_relative", "zone_absolute")


@query("zone_stats")
def q_zone_stats(spark, sf):
    """Share of cells, min, max, mean elevation per percentile zone."""
    z = _zones(spark, sf)
    g = z.groupBy("zone_percentile").agg(F.count(F.lit(1)).alias("n_cells"), F.min("z").alias("min_z"),
                                         F.max("z").alias("max_z"), F.avg("z").alias("mean_z"))
    w = F.sum("n_cells").over(Window.partitionBy())
    g = g.select("*", (F.lit(100.0) * F.col("n_cells") / w).alias("pct_cells"),
                 F.element_at(F.array(*[F.lit(n) for n in gs.ZONE_NAMES]), F.col("zone_percentile") + 1).alias("zone_name"))
    return _r6all(g)


@query("point_zone")
def q_point_zone(spark, sf):
    """G8 + J6: each station's nearest raster cell (per axis, regular grid:
    rounded and clamped) and that cell's zone — an equi-join, no cross join."""
    d = jn.nearest_cell(V.station(spark, sf), _zones(spark, sf), [("easting", "x", 740000.0, 100.0), ("northing", "y", 3978000.0, 300.0)])
    return _r6all(d.select("tower", "x", "y", "z", "zone_percentile"))


@query("transects")
def q_transects(spark, sf):
    """Elevation along the middle row, middle column and the diagonal."""
    r = V.raster(spark, sf)
    ext = r.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    j = r.withColumn("_one", F.lit(1)).join(F.broadcast(ext.withColumn("_one", F.lit(1))), "_one")
    midy = F.floor((F.col("_y0") + F.col("_y1")) / 2)
    midx = F.floor((F.col("_x0") + F.col("_x1")) / 2)
    rows = F.array(F.when(F.col("y") == midy, F.struct(F.lit("row").alias("profile"), F.col("x").alias("position"))),
                   F.when(F.col("x") == midx, F.struct(F.lit("column").alias("profile"), F.col("y").alias("position"))),
                   F.when(F.col("x") == F.col("y"), F.struct(F.lit("diagonal").alias("profile"), F.col("x").alias("position"))))
    t = j.select("z", F.explode(F.filter(rows, lambda v: v.isNotNull())).alias("_t")).select("_t.*", "z")
    return _r6all(t)


@query("tile_index")
def q_tile_index(spark, sf):
    """Web-map tile (zoom 12) of each station."""
    s = V.station(spark, sf)
    lat, lon = gs.utm_to_latlon(F.col("easting"), F.col("northing"))
    tx, ty = gs.tile_of(lat, lon, 12)
    return s.select("tower", tx.alias("tile_x"), ty.alias("tile_y"))


# ---------------------------------------------------------------- logs and settings


@query("run_log_metrics")
def q_run_log_metrics(spark, sf):
    """Sections, metrics and confusion cells parsed back from run-log lines."""
    m = lg.run_log_metrics(V.logs(spark, sf))
    return _r6all(m.drop("file", "section"))


@query("run_log_importance")
def q_run_log_importance(spark, sf):
    """S12: 'rank. feature : value' lines under their section."""
    return _r6all(lg.run_log_importance(V.logs(spark, sf)).drop("file", "section"))


def _settings_docs(spark, sf):
    """Stand-in result folders: one JSON document per (model, run, experiment)
    in the search output layout ``{key: {params: {...}, mcc: ..}}``, whatever
    its score.  Nothing was tuned for the longest horizon, whose experiments
    show the defaults."""
    r = V.results(spark, sf)
    run = F.concat(F.lit("search_results_"), F.col("model"), F.lit("_"),
                   F.when(F.col("split") == "cv", F.lit("20251201_000000")).otherwise(F.lit("20251203_000000")))
    params = F.struct((F.lit(3) + F.pmod("tp", F.lit(5))).alias("max_depth"),
                      (F.lit(0.01) * (F.lit(1) + F.pmod("fn", F.lit(10)))).alias("learning_rate"),
                      F.when(F.pmod("tp", F.lit(2)) == 0, F.lit("[4, 12]")).otherwise(F.lit("[4, 12, 24]")).alias("rolling_windows"))
    doc = F.to_json(F.create_map(F.concat_ws("_", "horizon", "event"), F.struct(params.alias("params"), F.col("mcc").alias("mcc"))))
    return r.filter(F.col("horizon") != V.HORIZONS[-1]).select("model", run.alias("run_folder"), doc.alias("doc"))


@query("settings_lookup")
def q_settings_lookup(spark, sf):
    """S6 + S7: newest run folder per model, tuned values per experiment,
    defaults field by field where nothing was tuned (left join + coalesce)."""
    s = so.newest_run(so.parse_settings(_settings_docs(spark, sf)))
    exps = V.result_cells(spark, sf).select("horizon", "event", "model").distinct() \
        .withColumn("key", F.concat_ws("_", "horizon", "event"))
    defaults = {"max_depth": F.lit(6), "learning_rate": F.lit(0.05),
                "rolling_windows": F.array(*[F.lit(x) for x in fe.ROLLING_WINDOWS])}
    j = so.lookup(exps, s, ["model", "key"], defaults)
    return _r6all(j.select("model", "horizon", "event", "max_depth", "learning_rate",
                           F.array_join("rolling_windows", ",").alias("rolling_windows"), "tuned"))


@query("latest_settings")
def q_latest_settings(spark, sf):
    """Append-only settings rows; the latest per (model, key) wins."""
    s = so.parse_settings(_settings_docs(spark, sf))
    return _r6all(so.latest_per_key(s, ["model", "key"], "run_folder")
                  .select("model", "key", "run_folder", "mcc", "max_depth"))


# ---------------------------------------------------------------- projections, gates, reshapes


@query("clean_projection")
def q_clean_projection(spark, sf):
    """Labelled-table clean-up on the event readings —
    half-open time range and series subset (both pushed to the scan), text
    to number / bool, suffix drops, keys first, numeric features by name
    rules; the keys travel in the row (no index join)."""
    e = V.table(spark, sf, "events")
    e = cl.time_range(e, "ts", "2024-01-05 00:00:00", "2024-01-25 00:00:00")
    e = cl.series_subset(e, "event_type", ["click", "view", "purchase"])
    d = e.select(F.col("user_id").alias("series"), "ts", F.col("event_type").alias("var"), "value",
                 cl.to_numeric(F.get_json_object("props", "$.k")).alias("k"),
                 F.when(F.col("value") > 100, F.lit("True")).otherwise(F.lit("False")).alias("flag_text"),
                 F.lit(0.0).alias("event_x_duration_min"), F.lit(False).alias("event_x_meets_duration"))
    d = cl.drop_by_suffix(d)
    d = cl.reorder_columns(d, ["series", "ts"])
    feats = rs.drop_all_null_columns(d, cl.select_features(d, exclude=("series",)))   # P3 + P9
    return d.select("series", "ts", "var", *feats, cl.bool_to_int(cl.text_to_bool(F.col("flag_text"))).alias("flag"))


@query("experiment_gate")
def q_experiment_gate(spark, sf):
    """A4: samples, positives, rate and skip reason per experiment (variable)."""
    o = V.obs(spark, sf).withColumn("label", F.col("value") > F.lit(100.0))
    return _r6all(rp.experiment_gate(o, ["var"], "label", 100, 10))


@query("unpivot_events")
def q_unpivot_events(spark, sf):
    """Labelled event flags to (series, ts, event, flag) rows."""
    lab = _labels(spark, sf)
    cols = [f"event_{r.name}" for r in GRID_RULES]
    return rs.unpivot_wide(lab.select("series", "ts", *cols), ["series", "ts"], cols, "event", "flag")


@query("long_results_pivot")
def q_long_results_pivot(spark, sf):
    """Results written long (one row per metric), pivoted back to one
    column per model x metric with explicit pivot values."""
    long = rp.long_metrics(V.results(spark, sf), ["horizon", "event", "model", "split"], ["f1", "mcc"], with_cells=False)
    p = (long.withColumn("_c", F.concat_ws("_", "model", "metric"))
         .groupBy("horizon", "event", "split")
         .pivot("_c", [f"{m}_{x}" for m in MODEL_NAMES for x in ("f1", "mcc")]).agg(F.first("value")))
    return _r6all(p)


# ---------------------------------------------------------------- sorts, limits, sets
@query("topk_per_group")
def q_topk_per_group(spark, sf):
    """K3: three most important features per tower."""
    f = _files(spark, sf).select("feature", "tower", "event", PCT)
    t = im.top_k_per_group(f, ["tower"], [F.col(PCT).desc(), F.col("feature").asc(), F.col("event").asc()], 3)
    return _r6all(t)


@query("top_n")
def q_top_n(spark, sf):
    """K1 + K2: the ten most important rows overall (a top-k report)."""
    f = _files(spark, sf).select("feature", "tower", "event", PCT)
    return _r6all(f.orderBy(F.col(PCT).desc(), "feature", "tower", "event").limit(10))


@query("argmax_row")
def q_argmax_row(spark, sf):
    """K4: the feature with the largest mean importance % per event (first
    name on ties)."""
    m = _files(spark, sf).groupBy("event", "feature").agg(F.avg(PCT).alias("mean_importance"))
    return _r6all(im.argmax_rows(m, ["event"], "mean_importance", "feature"))


@query("union_all")
def q_union_all(spark, sf):
    """K5: union by name where one side has an extra column."""
    g = V.grid(spark, sf)
    a = g.filter(F.col("series").isin("click", "error")).withColumn("note", F.lit("first"))
    b = g.filter(~F.col("series").isin("click", "error"))
    return a.unionByName(b, allowMissingColumns=True)


@query("distinct_values")
def q_distinct_values(spark, sf):
    """K6: distinct towers per event, one row each, with the event's exact
    count (no list of all towers in one cell)."""
    pairs = V.importance(spark, sf).select("event", "tower").distinct()
    return pairs.join(pairs.groupBy("event").agg(F.count(F.lit(1)).alias("n_towers")), "event")


@query("sample_rows")
def q_sample_rows(spark, sf):
    """Exactly 500 readings chosen by a seeded hash, sorted by time."""
    o = V.obs(spark, sf).withColumn("at", epoch_us("ts"))
    return cl.sample_rows(o, 500, 42, ["series", "at", "var"], ["ts", "series"]).drop("at")


# ---------------------------------------------------------------- sources and sinks


@query("io_roundtrip")
def q_io_roundtrip(spark, sf):
    """S1 + S5 + S8: the grid written as raw tower CSVs (one folder per
    series, compact times, sentinel for NULL, a footer line) into a fresh
    folder under the shared checkpoint folder, read back with an explicit
    schema, the series taken from the file path."""
    base = shared_dir(spark, "io_roundtrip")
    g = V.grid(spark, sf)
    sio.write_tower_csv(g, f"{base}/towers", "ts", ["temp", "peak", "n"], "series")
    back = sio.read_tower_csv(spark, f"{base}/towers", ["temp", "peak", "n"], tower_pattern=r"series=([^/]+)/")
    return back.select(F.col("tower").alias("series"), "ts", "temp", "peak", F.col("n").cast("long").alias("n"))


@query("tower_rejects")
def q_tower_rejects(spark, sf):
    """Lines of raw tower files whose time does not parse, counted by
    tower.  Every tenth count of the grid is written a second time with a
    month 13, beside the good lines and the footer."""
    base = shared_dir(spark, "tower_rejects")
    g = V.grid(spark, sf).select("series", "ts", F.col("n").cast("double").alias("n"))
    sio.write_tower_csv(g, f"{base}/towers", "ts", ["n"], "series")
    broken = g.where(F.col("n") % 10 == 0).select("series", F.date_format("ts", "yyyy'13'ddHHmmss").alias("timestampUTC"), "n")
    broken.write.mode("append").partitionBy("series").option("header", True).csv(f"{base}/towers")
    rejects = sio.read_tower_rejects(spark, f"{base}/towers", ["n"], tower_pattern=r"series=([^/]+)/")
    good = sio.read_tower_csv(spark, f"{base}/towers", ["n"], tower_pattern=r"series=([^/]+)/")
    return good.groupBy("tower").agg(F.count(F.lit(1)).alias("n_readings")) \
        .join(rejects.groupBy("tower").agg(F.count(F.lit(1)).alias("n_rejects")), "tower", "left") \
        .select("tower", "n_readings", F.coalesce("n_rejects", F.lit(0)).alias("n_rejects"))


@query("metadata_roundtrip")
def q_metadata_roundtrip(spark, sf):
    """All station fields written as nested JSON documents of bounded size and read back by
    exploding the map."""
    back = sio.read_station_metadata(spark, _metadata_documents(spark, sf))
    return _r6all(back.select("tower", "lat", "lon", "elevation_m", "elevation_msl_m", "height_m", "name", "terrain_type", "slope_deg",
                              "aspect_deg", "canopy_cover_pct", "dist_to_ridge_m", "soil_type", "land_use", "color", "region"))


def _metadata_documents(spark, sf):
    path = f"{shared_dir(spark, 'metadata')}/stations"
    s = _stations(spark, sf).withColumn("elevation_msl_m", F.col("elevation_m")).withColumn("color", F.lit("#888888")) \
        .withColumn("name", F.concat(F.lit("Site "), F.col("tower")))
    regions = s.groupBy(F.col("region").alias("name")).agg(F.avg("lat").alias("center_lat"), F.avg("lon").alias("center_lon"),
                                                           F.count(F.lit(1)).cast("string").alias("state"))
    sio.write_station_metadata(s, path, regions=regions, per_document=7)
    return path


@query("region_info")
def q_region_info(spark, sf):
    """The region entries of the metadata documents."""
    return _r6all(sio.read_region_info(spark, _metadata_documents(spark, sf)).select("name", "state", "center_lat", "center_lon"))


@query("run_config")
def q_run_config(spark, sf):
    """A run's settings, taken from its results, written as one JSON document and read back."""
    base = shared_dir(spark, "run_config")
    r = V.results(spark, sf).agg(F.array_sort(F.collect_set("event")).alias("events"), F.array_sort(F.collect_set("model")).alias("models"),
                                 F.count(F.lit(1)).alias("n_results"), F.sum("n_samples").alias("n_samples")).first()       # one row of settings
    sio.write_run_config(spark, {"events": r["events"], "models": r["models"], "n_results": r["n_results"], "n_samples": r["n_samples"]}, base)
    return sio.read_run_config(spark, base).drop("file")


@query("importance_files")
def q_importance_files(spark, sf):
    """Importance rows written as one CSV per tower and event in named folders, read back with tower
    and event from the path."""
    base = shared_dir(spark, "importance_files")
    d = V.importance(spark, sf).withColumn("file", F.concat(F.lit("importance_"), F.regexp_replace("tower", "#", ""), F.lit("_event_"),
                                                            F.regexp_replace("event", " ", "-")))
    d.select("file", "feature", "importance").write.partitionBy("file").option("header", True).csv(base)
    back = sio.read_partitioned_by_name(spark, base, r"importance_([^/]+)_event_([^/]+)/", ["tower", "event"],
                                        T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType())]))
    g = back.groupBy("tower", "event").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("importance").cast("decimal(18,4)")).cast("double").alias("total"),
                                           F.max("feature").alias("last_feature"))
    return _r6all(g)


# ---------------------------------------------------------------- Spark ML jobs (rows-only checks)

ML_LAGS = [1, 2, 4]
ML_FOLDS = 3
ML_HORIZON = 2


def _ml_features(spark, sf):
    """Per (series, variable): value, lags, rolling mean/std, differences and
    the target 'value > 100' two readings ahead — one window pass; then
    calendar encodings."""
    o = V.obs(spark, sf).withColumn("event", (F.col("value") > F.lit(100.0)).cast("int"))
    d = fe.temporal_features(o, OBS_KEYS, "ts", ["value"], lags=ML_LAGS, windows=[4], stats=["mean", "std"],
                             diffs=True, leads={"target": ("event", ML_HORIZON)})
    d = fe.cyclic_time(d, "ts")
    names = ["value", *[f"value_lag{k}" for k in ML_LAGS], "value_roll4_mean", "value_roll4_std",
             "value_diff1", "value_diff2", "hour_sin", "hour_cos"]
    return d, names


def _prepared(spark, sf):
    d, names = _ml_features(spark, sf)
    return ml.prepare(d, names, "target", ["ts", "series", "var"], "ts", ML_FOLDS), names


@query("gbt_cross_validate")
def q_gbt_cross_validate(spark, sf):
    """M3 + M4 + M1 + M5 + M7-M10: expanding-window CV of boosted trees with
    balanced weights and early stopping; metrics per fold at the best-F1
    threshold."""
    d, _ = _prepared(spark, sf)
    m = ml.cross_validate(d, ML_FOLDS, ml.TreeSettings(max_iter=10, max_depth=3))
    return _r6all(m.select("fold", "threshold", "tp", "fp", "fn", "tn", "accuracy", "balanced_accuracy", "precision",
                           "recall", "f1", "specificity", "mcc", "kappa", "roc_auc", "average_precision"))


def _first_fold_model(spark, sf):
    d, names = _prepared(spark, sf)
    lo, _ = evl.fold_bounds(F.col("n_rows"), ML_FOLDS, 1)
    model = ml.gbt(ml.TreeSettings(max_iter=10, max_depth=3), "features", "is_val").fit(ml.weighted_train(d, lo))
    return d, names, model


@query("gbt_importance")
def q_gbt_importance(spark, sf):
    """M11 + W18: gain importance of the first fold's model by feature name,
    ranked, percent of total, top 20."""
    _, names, model = _first_fold_model(spark, sf)
    imp = spark.createDataFrame(ml.tree_importance(model, names), "feature string, importance double") \
        .withColumn("model", F.lit("gbt"))
    return _r6all(im.rank_features(imp, ["model"], top_n=20))


@query("permutation_importance")
def q_permutation_importance(spark, sf):
    """AUC drop per permuted feature on the first test fold."""
    d, names, model = _first_fold_model(spark, sf)
    return _r6all(ml.permutation_importance(model, d.filter(F.col("test_fold") == 1), names))


SEARCH_TRIALS = [pooled.Trial(lags, windows, ml.TreeSettings(max_iter=5, max_depth=depth))
                 for lags, windows, depth in (((1,), (), 2), ((1, 2, 4), (2, 4), 2), ((1, 2, 4), (2, 4, 12), 3), ((1, 2), (12,), 4))]


@query("search_settings")
def q_search_settings(spark, sf):
    """Trials of lag set, windows (none: rolling off), depth and trees over slices of one table of the
    gusty event; poor ones stop after their first fold, the best is scored anew on the last 20 %."""
    rows = _groups(spark, sf).where("event = 'gusty' and horizon = '3hr'").drop("event", "horizon")
    names = pooled.feature_names(GRID_SETTINGS[2], WIDE_COLS, GRID_GROUPS)
    return _r6all(pooled.search(rows, names, "ts", SEARCH_TRIALS, folds=2))


@query("labelled_roundtrip")
def q_labelled_roundtrip(spark, sf):
    """S8 + S2: labelled readings written as a Parquet table partitioned by
    series (fresh folder under the shared checkpoint folder), read back with
    the key columns first."""
    base = shared_dir(spark, "labelled_roundtrip")
    sio.write_table(_labels(spark, sf), f"{base}/labelled", "parquet", ["series"])
    back = sio.read_labeled(spark, f"{base}/labelled", ["series", "ts"])
    return back.select(*[r6(c).alias(c) if c.endswith("_duration_min") else c for c in back.columns])


@query("side_table_optional")
def q_side_table_optional(spark, sf):
    """S3: the hourly side table is written, then read through the optional
    reader; an absent path yields no table and the timeline continues
    without it (here: the side table is present, and a second, absent one
    adds nothing)."""
    base = shared_dir(spark, "side_tables")
    sio.write_table(V.aux(spark, sf), f"{base}/aux_present")
    present = sio.read_auxiliary(spark, f"{base}/aux_present")
    absent = sio.read_auxiliary(spark, f"{base}/aux_absent")
    timeline = V.grid(spark, sf).select("ts").distinct()
    out = timeline.join(present, "ts", "left") if present is not None else timeline
    if absent is not None:                      # never true here: the path does not exist
        out = out.join(absent, "ts", "left")
    return out.select("ts", "aux_k")


@query("tower_files_labels")
def q_tower_files_labels(spark, sf):
    """Entry A end to end (``plans.jobs.label_tower_files``): the grid
    written as raw tower CSV files (one folder per series, compact times,
    sentinel, footer), read back (S1), each series' columns resolved through
    a column map (P5), runs found and every reading labelled (W1-W4)."""
    from squall.plans import jobs
    base = shared_dir(spark, "tower_files")
    sio.write_tower_csv(V.grid(spark, sf), f"{base}/raw", "ts", ["temp", "peak", "n"], "series")
    colmap = {s: {"temp": "temp", "peak": "peak"} for s in V.SERIES}
    _, lab = jobs.label_tower_files(spark, f"{base}/raw", ["temp", "peak", "n"], rules=GRID_RULES, colmap=colmap,
                                    tower_pattern=r"series=([^/]+)/")
    cols = [c for c in lab.columns if c not in ("tower", "ts", "temp", "peak", "n")]
    return lab.select("tower", "ts", "temp", "peak", F.col("n").cast("long").alias("n"),
                      *[r6(c).alias(c) if c.endswith("_duration_min") else c for c in cols])


@query("tower_files_pooled_flags")
def q_tower_files_pooled_flags(spark, sf):
    """Entry C end to end (``plans.jobs.pooled_event_flags``): raw tower
    files read back (S1), pivoted to one row per hour with
    ``{tower}_{column}`` columns (R2), each rule as a k-row duration mask per
    tower (W6) and OR across towers (W7)."""
    from squall.plans import jobs
    base = shared_dir(spark, "tower_files_pooled")
    sio.write_tower_csv(V.grid(spark, sf), f"{base}/raw", "ts", ["temp", "peak"], "series")
    readings = sio.read_tower_csv(spark, f"{base}/raw", ["temp", "peak"], tower_pattern=r"series=([^/]+)/")
    colmap = {s: {"temp": "temp", "peak": "peak"} for s in V.SERIES}
    w = jobs.pooled_event_flags(readings, V.SERIES, ["temp", "peak"], rules=GRID_RULES, colmap=colmap,
                                step_minutes=60.0)
    return w.select("ts", *[f"event_{r.name}" for r in GRID_RULES])


# ---------------------------------------------------------------- pooled forecast job (entry C)

GRID_SETTINGS = (
    pooled.EventSettings("hot", 7200, (1, 2, 3, 4, 5, 6), (2, 6), {"2hr": 1, "6hr": 3}, "temp", 60.0, "60"),
    pooled.EventSettings("calm", 3600, (1, 2, 4), (2, 4, 12), {"1hr": 1, "6hr": 6}, "temp", 42.0, "42"),
    pooled.EventSettings("gusty", 3600, tuple(range(1, 13)), (6,), {"1hr": 1, "3hr": 3, "12hr": 12}, "peak", 100.0, "100"),
)
GRID_GROUPS = {v: [f"{s}_{v}" for s in V.SERIES] for v in ("temp", "peak")}
POOLED_FOLDS = 3


def _pooled(spark, sf):
    """Feature vectors of the three grid events, each with its own step, lags, windows and limit;
    readings are taken to two places."""
    d = _union_masks(spark, sf).select(
        "ts", *[(F.floor(F.col(c) * 100) / 100).alias(c) for c in WIDE_COLS], *[f"event_{r.name}" for r in GRID_RULES])
    return pooled.pooled_features(d, "ts", WIDE_COLS, GRID_GROUPS, GRID_SETTINGS)


@query("pooled_features")
def q_pooled_features(spark, sf):
    """W8-W15 as one job: all features of every event at its own step, long (event, ts, feature, value)."""
    d = _pooled(spark, sf)
    each = F.explode(F.arrays_zip(F.col("names").alias("feature"), F.col("features").alias("value")))
    return d.select("event", "ts", each.alias("_f")).select("event", "ts", "_f.feature", r6("_f.value").alias("value"))


@query("pooled_targets")
def q_pooled_targets(spark, sf):
    """W15 by event and horizon: the flag that many steps later, null past the end."""
    d = _pooled(spark, sf)
    return d.select("event", "ts", F.inline("targets")).select("event", "ts", "horizon", F.col("flag").cast("double").alias("target"))


def _groups(spark, sf):
    return cut_lineage(pooled.labelled_groups(_pooled(spark, sf), "ts"))


@query("training_grid")
def q_training_grid(spark, sf):
    """M2 + M4 + A4 + W20 + W21: for every event, horizon and fold (0 is the final fit on the first 80 %)
    rows, positives and weight, and why it is skipped."""
    rows = pooled.tagged(_groups(spark, sf), ["event", "horizon"], "ts", POOLED_FOLDS)
    plan = pooled.fit_plan(rows, ["event", "horizon"], POOLED_FOLDS)
    return plan.select("event", "horizon", "fold", "n_rows", "train_rows", "train_positives", "test_rows", "test_positives",
                       r6("pos_weight").alias("pos_weight"), "skipped")


def _scored_grid(spark, sf):
    return pooled.score_grid(_groups(spark, sf), ["event", "horizon"], "ts", POOLED_FOLDS,
                             ml.TreeSettings(max_iter=5, max_depth=3))


@query("grid_scored_rows")
def q_grid_scored_rows(spark, sf):
    """M4 + M10: every test row of every fitted (event, horizon, fold) with probability and prediction."""
    return _scored_grid(spark, sf)[0]


@query("grid_metrics")
def q_grid_metrics(spark, sf):
    """M4 + M7-M10: metrics of every fitted (event, horizon, fold), from its scored rows."""
    return _r6all(pooled.grid_metrics(_scored_grid(spark, sf)[0], ["event", "horizon"]))


# ---------------------------------------------------------------- rules as a table

GRID_TERMS = (("hot", "temp", ">", 60.0, 2.0), ("calm", "temp", "<", 42.0, 3.0), ("gusty", "temp", ">", 40.0, 1.0),
              ("gusty", "peak", ">", 100.0, 1.0), ("muggy", "temp", ">=", 55.0, 1.0), ("muggy", "hum", "<=", 2.0, 1.0))
GRID_MAP = {"click": {"temp": "temp", "peak": "peak", "hum": None}, "error": {"temp": "temp", "peak": None, "hum": "n"},
            "purchase": {"temp": "temp", "peak": "peak", "hum": "n"}, "signup": {"temp": "temp", "peak": "gust", "hum": None},
            "view": {"temp": "temp", "peak": "peak"}}


def _rule_tables(spark):
    return rt.terms_table(spark, GRID_TERMS), rt.column_map_table(spark, GRID_MAP)


@query("rule_availability")
def q_rule_availability(spark, sf):
    """P5: for every series and rule what the series lacks; a rule with a lacking variable is skipped."""
    terms, colmap = _rule_tables(spark)
    return rt.availability(terms, colmap, V.grid(spark, sf).columns)


@query("table_rule_segments")
def q_table_rule_segments(spark, sf):
    """P4 + P5 + W1 + W2 with rules and column map as tables: runs of at least the rule's minimum."""
    terms, colmap = _rule_tables(spark)
    return _r6all(rt.segments(V.grid(spark, sf), "series", "ts", terms, colmap))


@query("gap_segments")
def q_gap_segments(spark, sf):
    """W1 with Q2's option: a step of more than two hours between readings ends a run; all runs."""
    terms, colmap = _rule_tables(spark)
    return _r6all(rt.segments(V.grid(spark, sf), "series", "ts", terms, colmap, keep_short=True, max_gap_minutes=120.0))


# ---------------------------------------------------------------- files of a run


def _log_files(spark, sf):
    """The run log written as text files, one a horizon, and read back with line numbers."""
    base = shared_dir(spark, "run_logs")
    lines = V.logs(spark, sf).withColumn("part", F.floor(F.col("line_no") / 600).cast("int"))
    sio.write_log_lines(lines, base, "part")
    return sio.read_log_lines(spark, base)


@query("log_files_metrics")
def q_log_files_metrics(spark, sf):
    """S11 from text files: sections, metrics and confusion cells."""
    return _r6all(lg.run_log_metrics(_log_files(spark, sf)).drop("file", "section"))


@query("log_files_importance")
def q_log_files_importance(spark, sf):
    """S12 from text files."""
    return _r6all(lg.run_log_importance(_log_files(spark, sf)).drop("file", "section"))


def _settings_folders(spark, sf):
    """Documents of search runs in run folders: nested ones where tp is even, flat ones elsewhere, some
    fields absent, window lists as text or as a list; nothing was tuned for the longest horizon."""
    r = V.results(spark, sf).filter(F.col("horizon") != V.HORIZONS[-1])
    run = F.concat(F.lit("search_results_"), F.col("model"), F.lit("_"),
                   F.when(F.col("split") == "cv", F.lit("20251201_000000")).otherwise(F.lit("20251203_000000")))
    light = F.col("model") == "lightgbm"
    nested = F.pmod("tp", F.lit(2)) == 0
    fields = [F.when(F.pmod("tp", F.lit(3)) == 0, F.lit("short")).alias("lag_config"),
              F.when(F.pmod("tp", F.lit(4)) == 0, F.lit(False)).alias("use_rolling"),
              (F.lit(3) + F.pmod("tp", F.lit(5))).alias("max_depth"), (F.lit(0.01) * (F.lit(1) + F.pmod("fn", F.lit(10)))).alias("learning_rate"),
              F.when(light, F.lit(16) + F.pmod("fn", F.lit(64))).alias("num_leaves"),
              F.when(light & (F.pmod("fn", F.lit(2)) == 0), F.lit(0.25) * F.pmod("fp", F.lit(4))).alias("feature_fraction"),
              F.when(~light, F.lit(0.5) * F.pmod("fn", F.lit(3))).alias("gamma"),
              F.when(F.pmod("fp", F.lit(3)) == 1, F.lit("many")).otherwise(F.pmod("fp", F.lit(7)).cast("string")).alias("reg_alpha")]
    inside = F.struct(*fields, F.lit("[4, 12]").alias("rolling_windows"))
    flat = F.struct(*fields, F.array(F.lit(4), F.lit(12), F.lit(24)).alias("rolling_windows"))
    key = F.concat_ws("_", "horizon", "event")
    metrics = F.create_map(F.lit("f1"), F.col("f1"), F.lit("kappa"), F.col("kappa"))
    doc = F.when(nested, F.to_json(F.create_map(key, F.struct(inside.alias("params"), F.col("mcc"), metrics.alias("metrics"))))) \
        .otherwise(F.to_json(F.create_map(key, flat)))
    base = shared_dir(spark, "search_runs")
    r.select(run.alias("run_folder"), doc.alias("value")).write.partitionBy("run_folder").text(base)
    return so.read_run_settings(spark, base)


@query("settings_files")
def q_settings_files(spark, sf):
    """S6 + S7 from run folders: the newest run of each model, nested and flat documents, every field
    found or its model's default, and the metrics."""
    s = so.newest_run(_settings_folders(spark, sf))
    exps = V.result_cells(spark, sf).select("horizon", "event", "model").distinct() \
        .withColumn("key", F.concat_ws("_", "horizon", "event"))
    d = so.with_defaults(exps, s, ["model", "key"], fe.ROLLING_WINDOWS)
    whole = [F.col(c).cast("double").alias(c) for c, t in d.dtypes if t == "int"]        # null for the other model
    rest = [c for c, t in d.dtypes if t != "int" and c not in ("key", "metrics", "rolling_windows")]
    return _r6all(d.select(*rest, *whole, F.col("metrics")["f1"].alias("f1"), F.col("metrics")["kappa"].alias("kappa"),
                           F.array_join("rolling_windows", ",").alias("windows")))


@query("station_fallbacks")
def q_station_fallbacks(spark, sf):
    """G5 where some values are there: elevations, slopes and aspects are filled only where they lack,
    and the derived attributes follow."""
    k = F.regexp_extract("tower", "([0-9]+)", 1).cast("int")
    s = V.station(spark, sf)
    lat, lon = gs.utm_to_latlon(F.col("easting"), F.col("northing"))
    s = s.select("tower", "height_m", lat.alias("lat"), lon.alias("lon"), F.when(k % 5 != 0, F.floor("elevation_m").cast("double")).alias("elevation_m"),
                 F.when(k % 3 == 0, (k % 80) / 10).alias("slope_deg"), F.when(k % 4 == 0, k % 360).alias("aspect_deg"))
    d = _attributes(gs.with_fallbacks(s))
    return _r6all(d.select("tower", "elevation_m", "slope_deg", "aspect_deg", "terrain_type", "canopy_cover_pct", "dist_to_ridge_m",
                           "soil_type", "land_use"))


@query("tile_corner")
def q_tile_corner(spark, sf):
    """G9 and back: each station's tile and the tile's north-western corner."""
    s = V.station(spark, sf)
    lat, lon = gs.utm_to_latlon(F.col("easting"), F.col("northing"))
    x, y = gs.tile_of(lat, lon, 13)
    d = s.select("tower", x.alias("x"), y.alias("y"))
    north, west = gs.tile_corner(F.col("x"), F.col("y"), 13)
    return _r6all(d.select("*", north.alias("lat"), west.alias("lon")))


# ---------------------------------------------------------------- roll-ups by other keys


@query("importance_by_series")
def q_importance_by_series(spark, sf):
    """A20 by tower: its ten features with the largest mean importance %."""
    return _r6all(im.importance_by(_files(spark, sf), "tower", 10, importance=PCT))


@query("importance_cells")
def q_importance_cells(spark, sf):
    """A23 by tower, in long form: mean importance of every (family, tower), row means and ranks."""
    d = _files(spark, sf).withColumn("category", im.category_of(F.col("feature")))
    return _r6all(im.importance_cells(d, "category", "tower", importance=PCT))


@query("score_box_stats")
def q_score_box_stats(spark, sf):
    """A36 by model: quartiles, whiskers and outliers of F1 over all experiments."""
    return _r6all(im.box_stats(V.results(spark, sf), "model", "f1"))


@query("feature_columns")
def q_feature_columns(spark, sf):
    """P3 + K7: the numeric columns of the labelled table that none of the ten name patterns excludes, a
    list given twice over counted once, with how many values each has."""
    d = _labels(spark, sf)
    names = cl.unique_names(cl.select_features(d, target="event_hot") + cl.select_features(d))
    return d.agg(*[F.count(c).alias(c) for c in names]).unpivot([], names, "column", "n_values")


# ---------------------------------------------------------------- one model per series and event (entry B)

SERIES_LAGS, SERIES_WINDOWS, SERIES_STEPS = [1, 2, 4, 8], [4, 12], 4


def _series_groups(spark, sf):
    """Feature vectors of every labelled reading, one row for each (series, event) with the event's flag
    some readings later: lags, rolling mean and deviation of both variables in one window pass."""
    names = [r.name for r in GRID_RULES]
    d = _labels(spark, sf).select("series", "ts", "temp", "peak", *[F.col(f"event_{n}").cast("int").alias(f"event_{n}") for n in names])
    d = fe.temporal_features(d, ["series"], "ts", ["temp", "peak"], lags=SERIES_LAGS, windows=SERIES_WINDOWS, stats=["mean", "std"],
                             leads={f"target_{n}": (f"event_{n}", SERIES_STEPS) for n in names})
    cols = [f"{c}_{x}" for c in ("temp", "peak") for x in [*[f"lag{k}" for k in SERIES_LAGS],
                                                          *[f"roll{w}_{s}" for w in SERIES_WINDOWS for s in ("mean", "std")]]]
    d = d.na.drop(subset=cols)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("event"), F.col(f"target_{n}").cast("double").alias("label")) for n in names]))
    d = d.select("series", "ts", F.array("temp", "peak", *cols).alias("features"), each.alias("_e")).select("series", "ts", "features", "_e.*")
    return cut_lineage(d.where("label is not null"))


@query("series_training_grid")
def q_series_training_grid(spark, sf):
    """Entry B: M1 + A4 + W20 + W21 for every (series, event): rows, positives and balanced weights of every
    fold and of the final fit, and why it is skipped."""
    rows = pooled.tagged(_series_groups(spark, sf), ["series", "event"], "ts", POOLED_FOLDS)
    return _r6all(pooled.fit_plan(rows, ["series", "event"], POOLED_FOLDS, power=None).drop("train_end"))


@query("series_grid_metrics")
def q_series_grid_metrics(spark, sf):
    """Entry B: M3 + M4 + M7-M10, one model for each (series, event), fold and final fit; metrics from the
    scored rows."""
    scored, _ = pooled.score_grid(_series_groups(spark, sf), ["series", "event"], "ts", 2, ml.TreeSettings(max_iter=3, max_depth=3), power=None)
    return _r6all(pooled.grid_metrics(scored, ["series", "event"]))

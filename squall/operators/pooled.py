"""The pooled forecast job: one feature table for several events, each with its own step, lags,
windows, horizons and limit (W8-W15, P8, and the folds and fits of M4 and M10).

What differs between events is a table, joined to the readings: one aggregation resamples every
event's timeline at its own step, and one window collects the last readings of a row into a bounded
buffer. All features are array expressions over that buffer and the settings in the row, so neither
the plan nor its one sort grows with lags, windows or columns. Windows run on position blocks with a
halo, so no timeline is one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from squall.functions.timecols import cyclic, epoch_us
from squall.operators import evaluate as evl
from squall.operators import model as ml
from squall.operators.blocks import DEFAULT_BLOCK_ROWS, POS, add_position, halo_apply
from squall.operators.reshape import fill_forward_backward
from squall.session import cut_lineage

STATS = ("mean", "std", "min", "max")


@dataclass(frozen=True)
class EventSettings:
    """What one event's forecast is made of; steps are counted in ``step_seconds``."""

    event: str
    step_seconds: int
    lags: tuple[int, ...]
    windows: tuple[int, ...]
    horizons: Mapping[str, int]
    variable: str
    limit: float
    limit_name: str

    @property
    def reach(self) -> int:
        return max([2, *self.lags, *(w - 1 for w in self.windows)])


# --- fixed values: the pooled script's settings by event ------------------------------------------
_LAGS = tuple(range(1, 25))
_WINDOWS = (2, 6, 12, 24)
_WIND_HORIZONS = {"1hr": 2, "3hr": 6, "6hr": 12, "12hr": 24, "24hr": 48}
POOLED_SETTINGS = (
    EventSettings("E3_LowTemp_lt0", 7200, _LAGS, _WINDOWS, {"2hr": 1, "4hr": 2, "6hr": 3, "12hr": 6, "24hr": 12, "48hr": 24},
                  "TempC_030m", 3.0, "3C"),
    EventSettings("E4_HighWind_Peak_gt25", 1800, _LAGS, _WINDOWS, _WIND_HORIZONS, "PkWSpdMph_030m", 20.0, "20mph"),
    EventSettings("E5_LowWind_lt2", 1800, _LAGS, _WINDOWS, _WIND_HORIZONS, "PkWSpdMph_030m", 4.0, "4mph"),
)
# --- end of fixed values --------------------------------------------------------------------------


def feature_names(s: EventSettings, columns: Sequence[str], groups: Mapping[str, Sequence[str]]) -> list[str]:
    """Names of one event's features, in the order of its vector. ``groups`` names the columns that
    carry one variable at several series; it counts with two or more."""
    names = []
    for c in columns:
        names += [f"{c}_lag{k}" for k in s.lags]
        names += [f"{c}_roll{w}_{stat}" for w in s.windows for stat in STATS]
        names += [f"{c}_diff1", f"{c}_diff2"]
    for var, members in groups.items():
        if len(members) > 1:
            names += [f"{var}_tower_mean", f"{var}_tower_std", f"{var}_tower_range"]
            names += [f"{c}_dev_from_mean" for c in members]
    names += [f"{part}_{f}" for part in ("hour", "dow", "month") for f in ("sin", "cos")]
    return names + [f"{c}_dist_to_{s.limit_name}" for c in groups.get(s.variable, [])]


def settings_table(spark: SparkSession, settings: Sequence[EventSettings], columns: Sequence[str],
                   groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row an event: the settings that drive the job, with feature names and the places of the
    columns that its limit is for."""
    rows = [(s.event, s.step_seconds, list(s.lags), list(s.windows), [(n, h) for n, h in s.horizons.items()],
             [columns.index(c) for c in groups.get(s.variable, [])], float(s.limit), feature_names(s, columns, groups))
            for s in settings]
    return spark.createDataFrame(rows, "event string, step long, lags array<int>, windows array<int>, "
                                       "horizons array<struct<horizon:string,steps:int>>, limited array<int>, lim double, "
                                       "names array<string>")


def event_timelines(readings: DataFrame, ts: str, columns: Sequence[str], settings: DataFrame,
                    chunk_bins: int = 4096) -> DataFrame:
    """R1 + W16 at each event's own step: (event, bin, ts, columns, flag, settings). Readings are
    averaged and the flags ``event_{name}`` ORed by bin, every bin between the first and the last is
    there, empty ones are filled forward, then backward, then with 0."""
    flags = [c for c in readings.columns if c.startswith("event_")]
    by_event = readings.select(ts, *columns, F.explode(F.array(*[
        F.struct(F.lit(c.removeprefix("event_")).alias("event"), F.col(c).alias("flag")) for c in flags])).alias("_e"))
    steps = settings.select("event", "step")                       # one row an event
    d = by_event.select(ts, *columns, "_e.event", "_e.flag").join(F.broadcast(steps), "event")
    bins = d.groupBy("event", "step", F.floor(epoch_us(ts) / (F.col("step") * 1_000_000)).cast("long").alias("bin")).agg(
        *[F.avg(c).alias(c) for c in columns], F.max("flag").alias("flag"))
    span = bins.groupBy("event").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    chunks = span.select("event", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / chunk_bins), F.floor(F.col("hi") / chunk_bins)))
                         .alias("chunk")).repartition("event", "chunk")
    every = chunks.select("event", F.explode(F.sequence(F.greatest("lo", F.col("chunk") * chunk_bins),
                                                        F.least("hi", F.col("chunk") * chunk_bins + chunk_bins - 1))).alias("bin"))
    dense = every.join(bins.drop("step"), ["event", "bin"], "left").join(F.broadcast(settings), "event")
    start = F.timestamp_micros(F.col("bin") * F.col("step") * 1_000_000)
    dense = dense.withColumn(ts, start.cast(readings.schema[ts].dataType)).withColumn(
        "flag", F.coalesce("flag", F.lit(False)))
    return fill_forward_backward(dense, ["event"], ts, list(columns), final=0.0)


def _rolled(rows: Column, j: Column, size: Column, width: Column) -> Column:
    """Mean, sample standard deviation, least and greatest of column ``j`` over the last ``width`` rows;
    null where fewer exist or one is null."""
    values = F.transform(F.slice(rows, size - width + 1, width), lambda r: F.get(r, j))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    mean = total / width
    spread = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    std = F.when(width > 1, F.sqrt(spread / (width - 1)))
    whole = (size >= width) & ~F.exists(values, lambda x: x.isNull())
    none = F.lit(None).cast("double")
    return F.when(whole, F.array(mean, std, F.array_min(values), F.array_max(values))).otherwise(F.array(none, none, none, none))


def _trailing(columns: int) -> Column:
    """Lags, rolling statistics and differences of every column, from the buffer ``_rows`` (the row
    itself last) and the lags and windows of the row's event."""
    rows, size = F.col("_rows"), F.size("_rows")

    def of(j):
        def back(k):
            return F.get(F.get(rows, size - 1 - k), j)

        now = back(F.lit(0))
        lags = F.transform("lags", back)
        rolls = F.flatten(F.transform("windows", lambda w: _rolled(rows, j, size, w)))
        return F.concat(lags, rolls, F.array(now - back(F.lit(1)), now - F.lit(2.0) * back(F.lit(1)) + back(F.lit(2))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), of))


def _across(members: Sequence[str]) -> Column:
    """Mean, sample standard deviation and range of the non-null members, and deviations."""
    values = F.filter(F.array(*[F.col(c).cast("double") for c in members]), lambda x: x.isNotNull())
    n = F.size(values)
    mean = F.when(n > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n)
    spread = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.array(mean, F.when(n > 1, F.sqrt(spread / (n - 1))), F.array_max(values) - F.array_min(values),
                   *[F.col(c) - mean for c in members])


def pooled_features(readings: DataFrame, ts: str, columns: Sequence[str], groups: Mapping[str, Sequence[str]],
                    settings: Sequence[EventSettings], block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(event, bin, ts, names, features, targets): every event's feature vector at every step, and
    its flag at each horizon later (``targets``: horizon, flag; null past the end). A feature is null
    where its rows do not all exist. ``columns`` are doubles; ``readings`` has a boolean
    ``event_{name}`` for every event of ``settings``."""
    columns = list(columns)
    plan = settings_table(readings.sparkSession, settings, columns, groups)
    d = event_timelines(readings, ts, columns, plan).withColumn(POS, F.col("bin"))
    back = max(s.reach for s in settings)
    ahead = max(h for s in settings for h in s.horizons.values())

    def build(w):
        values = F.array(*[F.col(c).cast("double") for c in columns])
        return [F.collect_list(values).over(w.rowsBetween(-back, 0)).alias("_rows"),
                F.collect_list("flag").over(w.rowsBetween(0, ahead)).alias("_flags")]

    d = halo_apply(d, ["event"], [ts], ts, back, ahead, build, max(block_rows, back, ahead), positioned=True)
    t = F.col(ts)
    parts = [_trailing(len(columns)), *[_across(m) for m in groups.values() if len(m) > 1],
             F.array(*[cyclic(f(t), n, kind) for f, n in ((F.hour, 24), (F.weekday, 7), (F.month, 12)) for kind in ("sin", "cos")]),
             F.transform("limited", lambda j: F.get(F.get("_rows", F.size("_rows") - 1), j) - F.col("lim"))]
    targets = F.transform("horizons", lambda h: F.struct(h["horizon"].alias("horizon"), F.get("_flags", h["steps"]).alias("flag")))
    return d.select("event", "bin", ts, "names", F.concat(*parts).alias("features"), targets.alias("targets"))


def labelled_groups(features: DataFrame, ts: str) -> DataFrame:
    """P8 + W15: (event, horizon, ts, label, features), one row for each horizon, only where every
    feature and the target exist."""
    d = features.select("event", ts, "features", F.explode("targets").alias("_t"))
    d = d.select("event", "_t.horizon", ts, F.col("_t.flag").cast("double").alias("label"), "features")
    return d.where(F.col("label").isNotNull() & ~F.exists("features", lambda x: x.isNull()))


def tagged(rows: DataFrame, keys: Sequence[str], ts: str, folds: int, train_share: float = 0.8) -> DataFrame:
    """Rows of every group with position, group size and ``fold``: 0 for the last part (test of the
    final fit), 1 to ``folds`` for the test blocks of the expanding folds on the first ``train_share``,
    null for the head that is only trained on. Fold j trains on positions before its block; no row is
    copied."""
    keys = list(keys)
    d = add_position(rows, keys, [ts], ts)
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    d = d.join(n, keys).withColumn("n_train", F.floor(F.col("n_rows") * F.lit(train_share)))
    size = F.floor(F.col("n_train") / (folds + 1))
    first = F.col("n_train") - folds * size
    fold = F.when(F.col(POS) >= F.col("n_train"), 0).when((size > 0) & (F.col(POS) >= first), F.floor((F.col(POS) - first) / size) + 1)
    return d.withColumn("fold", fold.cast("int"))


def fit_plan(rows: DataFrame, keys: Sequence[str], folds: int, least_rows: int = 100, least_positives: int = 10,
             power: float | None = 0.75) -> DataFrame:
    """One row for every (group, fold) to fit: training rows and positives, test rows and positives, the
    weights of both classes (M2 with ``power``, M1's balanced ones without), and why a group or fold is
    skipped (null where it is not). One aggregation."""
    keys = list(keys)
    size = F.floor(F.col("n_train") / (folds + 1))
    end = F.when(F.col("part") == 0, F.col("n_train")).otherwise(F.col("n_train") - (folds + 1 - F.col("part")) * size)
    each = rows.select(*keys, POS, "n_rows", "n_train", "fold", "label", F.explode(F.sequence(F.lit(0), F.lit(folds))).alias("part"))
    train, test, hit = F.col(POS) < end, F.col("fold") == F.col("part"), F.col("label") > 0
    found = each.groupBy(*keys, F.col("part").alias("fold"), "n_rows").agg(
        F.count_if(train).alias("train_rows"), F.count_if(train & hit).alias("train_positives"),
        F.count_if(test).alias("test_rows"), F.count_if(test & hit).alias("test_positives"), F.max(end).alias("train_end"))
    whole = rows.groupBy(*keys).agg(F.count_if(hit).alias("positives"))
    why = F.when(F.col("n_rows") < least_rows, F.lit("insufficient data")) \
        .when(F.col("positives") < least_positives, F.lit("too few positive events")) \
        .when((F.col("train_positives") == 0) | (F.col("train_positives") == F.col("train_rows")), F.lit("one class in training")) \
        .when(F.col("test_rows") == 0, F.lit("no test rows"))
    if power is None:
        pos, neg = evl.class_weight_balanced(F.col("train_rows"), F.col("train_positives"))
    else:
        pos, neg = evl.class_weight_power(F.col("train_rows"), F.col("train_positives"), power), F.lit(1.0)
    return found.join(whole, keys).select(*keys, "fold", "n_rows", "train_rows", "train_positives", "test_rows", "test_positives",
                                          "train_end", pos.alias("pos_weight"), neg.alias("neg_weight"), why.alias("skipped"))


def score_grid(rows: DataFrame, keys: Sequence[str], ts: str, folds: int, settings: ml.TreeSettings,
               at_once: int = 4, thresholds: Sequence[float] = tuple(0.1 + 0.05 * i for i in range(10)), **gates) -> tuple[DataFrame, DataFrame]:
    """M4 + M10: (scored rows, fit plan). Every (group, fold) that the plan does not skip is fitted on the
    rows before its test block, with its weight, and its test block scored: (keys, fold, ts, label, prob,
    threshold, predicted), the threshold by the best F2. Fits are independent Spark jobs over one pinned
    table, ``at_once`` at a time; the driver holds the plan's rows only (groups x folds)."""
    keys = list(keys)
    table = cut_lineage(tagged(rows, keys, ts, folds).withColumn("features", array_to_vector("features")))
    plan = cut_lineage(fit_plan(table, keys, folds, **gates))
    todo = [r.asDict() for r in plan.where("skipped is null").orderBy(*keys, "fold").collect()]

    def fit(part: dict) -> DataFrame:
        own = table
        for k in keys:
            own = own.where(F.col(k).eqNullSafe(F.lit(part[k])))
        train = own.where(F.col(POS) < part["train_end"])
        tail = part["train_end"] - part["train_end"] // 10          # the last tenth says when to stop
        train = train.withColumn("weight", F.when(F.col("label") > 0, F.lit(float(part["pos_weight"])))
                                 .otherwise(F.lit(float(part["neg_weight"])))).withColumn("is_val", F.col(POS) >= tail)
        model = ml.gbt(settings, "features", "is_val").fit(train)
        scored = ml.score(model, own.where(F.col("fold") == part["fold"]))
        return cut_lineage(scored.select(*keys, "fold", ts, "label", "prob"))

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        parts = list(pool.map(inheritable_thread_target(rows.sparkSession)(fit), todo))
    if not parts:
        empty = table.select(*keys, "fold", ts, "label", F.lit(0.0).alias("prob"), F.lit(0.0).alias("threshold"),
                             F.lit(0).alias("predicted"))
        return empty.limit(0), plan
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    best = evl.best_threshold_fbeta(scored, [*keys, "fold"], "prob", "label", thresholds).select(*keys, "fold", "threshold")
    scored = scored.join(best, [*keys, "fold"])
    return scored.withColumn("predicted", (F.col("prob") >= F.col("threshold")).cast("int")), plan


def grid_metrics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The ten metrics, ROC AUC and average precision of every (group, fold), from scored rows alone."""
    by = [*keys, "fold"]
    cells = evl.confusion_cells(scored, by, "label", F.col("predicted") == 1)
    table = evl.score_table(scored.withColumn("label", F.col("label").cast("int")), by, "prob", "label")
    return evl.metrics_from_cells(cells).join(evl.roc_auc(table, by), by, "left").join(evl.average_precision(table, by), by, "left")


@dataclass(frozen=True)
class Trial:
    """One setting of the search: lags and windows to use (no windows: without rolling features) and
    trees."""

    lags: tuple[int, ...]
    windows: tuple[int, ...]
    trees: ml.TreeSettings


def trial_places(names: Sequence[str], trial: Trial) -> list[int]:
    """Places of a trial's features in the vector of all: what is neither a lag nor a rolling
    statistic belongs to every trial."""
    def wanted(name: str) -> bool:
        tail = name.rsplit("_", 1)[-1]
        if tail.startswith("lag") and tail[3:].isdigit():
            return int(tail[3:]) in trial.lags
        middle = name.rsplit("_", 2)[-2] if name.count("_") > 1 else ""
        if middle.startswith("roll") and middle[4:].isdigit():
            return int(middle[4:]) in trial.windows
        return True

    return [i for i, name in enumerate(names) if wanted(name)]


def search(rows: DataFrame, names: Sequence[str], ts: str, trials: Sequence[Trial], folds: int = 3, first_folds: int = 1,
           keep: float = 0.5, least_rows: int = 500, at_once: int = 4) -> DataFrame:
    """Every trial scored by the mean MCC of its folds, on slices of one feature table built with
    all lags and windows: (trial, lags, windows, max_depth, max_iter, step_size, n_folds, mean_mcc, status).

    Rows (ts, label, features) of one group; fewer than ``least_rows`` complete ones score -1. All trials
    are scored on the first ``first_folds`` folds, the worse ones (all but the share ``keep``) stop there,
    the others get the rest, and the best of them is fitted anew on the first 80 % and scored on the last
    part (``status`` best, its ``test_mcc``). ``trials`` is a short list; the driver holds their scores."""
    spark = rows.sparkSession
    table = cut_lineage(tagged(rows.withColumn("_group", F.lit(0)), ["_group"], ts, folds).withColumn("features", array_to_vector("features")))
    plan = fit_plan(table, ["_group"], folds, least_rows=least_rows, least_positives=1)
    plan = {r["fold"]: r for r in plan.collect()}                      # folds + 1 rows
    schema = ("trial int, lags string, windows string, max_depth int, max_iter int, step_size double, n_folds int, mean_mcc double, "
              "test_mcc double, status string")

    def line(i: int, scores: list[float], status: str, test: float | None = None) -> tuple:
        t = trials[i]
        mean = sum(scores) / len(scores) if scores else -1.0
        return (i, ",".join(map(str, t.lags)), ",".join(map(str, t.windows)), t.trees.max_depth, t.trees.max_iter, t.trees.step_size,
                len(scores), mean, test, status)

    able = [j for j in range(1, folds + 1) if j in plan and plan[j]["skipped"] is None]
    if not able:
        return spark.createDataFrame([line(i, [], "insufficient data") for i in range(len(trials))], schema)
    sliced = {i: ml.VectorSlicer(inputCol="features", outputCol="slice", indices=trial_places(names, t)) for i, t in enumerate(trials)}

    def mcc(job: tuple[int, int]) -> float:
        i, fold = job
        part = plan[fold]
        d = sliced[i].transform(table)
        train = d.where(F.col(POS) < part["train_end"])
        train = train.withColumn("weight", F.when(F.col("label") > 0, F.lit(float(part["pos_weight"]))).otherwise(F.lit(1.0))) \
            .withColumn("is_val", F.col(POS) >= part["train_end"] - part["train_end"] // 10)
        model = ml.gbt(trials[i].trees, "slice", "is_val").fit(train)
        scored = ml.score(model, d.where(F.col("fold") == fold)).withColumn("one", F.lit(1))
        best = evl.best_threshold_f1(evl.score_table(scored.withColumn("label", F.col("label").cast("int")), ["one"], "prob", "label"), ["one"])
        found = evl.metrics_from_cells(best.drop("f1")).first()
        return float(found["mcc"]) if found else 0.0

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        def scored_all(jobs):
            return dict(zip(jobs, pool.map(inheritable_thread_target(spark)(mcc), jobs), strict=True))

        scores = scored_all([(i, j) for i in range(len(trials)) for j in able[:first_folds]])
        early = {i: sum(scores[i, j] for j in able[:first_folds]) for i in range(len(trials))}
        alive = sorted(early, key=lambda i: (-early[i], i))[:max(1, round(keep * len(trials)))]
        scores |= scored_all([(i, j) for i in alive for j in able[first_folds:]])
        own = {i: [s for (k, _), s in sorted(scores.items()) if k == i] for i in range(len(trials))}
        best = max(alive, key=lambda i: (sum(own[i]) / len(own[i]), -i))
        test = mcc((best, 0)) if plan[0]["skipped"] is None else None
    rows_out = [line(i, own[i], "best" if i == best else "scored" if i in alive else "stopped early", test if i == best else None)
                for i in range(len(trials))]
    return spark.createDataFrame(rows_out, schema)

"""Result roll-ups over the long score table.

The score table is small (one row per experiment x metric), but every
roll-up is still a plain aggregation or a window over explicit keys, so the
same code serves thousands of experiments.  Argmax is taken with ordered
structs (value, then a deterministic tie-break) instead of ``max_by``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "specificity", "mcc", "kappa",
           "auc_roc"]
CELLS = {"tp": "true_positives", "tn": "true_negatives", "fp": "false_positives", "fn": "false_negatives"}


def with_rates(results: DataFrame) -> DataFrame:
    """auc_roc of a hard classifier (= balanced accuracy), FPR and FNR."""
    fp, tn, fn, tp = (F.col(c).cast("double") for c in ("fp", "tn", "fn", "tp"))
    return results.select("*", F.col("balanced_accuracy").alias("auc_roc"),
                          F.when(fp + tn != 0, fp / (fp + tn)).otherwise(F.lit(0.0)).alias("fpr"),
                          F.when(fn + tp != 0, fn / (fn + tp)).otherwise(F.lit(0.0)).alias("fnr"))


def long_metrics(results: DataFrame, ids: Sequence[str], metrics: Sequence[str] = METRICS,
                 with_cells: bool = True) -> DataFrame:
    """Wide metric columns -> rows (ids..., metric, value)."""
    cols = [F.col(m).cast("double").alias(m) for m in metrics]
    names = list(metrics)
    if with_cells:
        cols += [F.col(c).cast("double").alias(n) for c, n in CELLS.items()]
        names += list(CELLS.values())
    return results.select(*ids, *cols).unpivot(list(ids), names, "metric", "value")


def fold_summary(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A5: mean and population std over folds per (keys, metric); confusion
    cells get the mean only."""
    is_cell = F.col("metric").isin(*CELLS.values())
    return (long.groupBy(*keys, "metric")
            .agg(F.avg("value").alias("mean"),
                 F.when(~F.first(is_cell), F.stddev_pop("value")).alias("std"),
                 F.count(F.lit(1)).alias("n_folds")))


def best_by_group(summary: DataFrame, group: str, label: str, model: str = "model") -> DataFrame:
    """A6 + A7 + A10: per (group, model, metric): best mean and which
    ``label`` has it (first in ascending label order on ties), mean and
    sample std across labels, distinct labels."""
    w = Window.partitionBy(group, model, "metric").orderBy(F.col("mean").desc(), F.col(label).asc())
    ranked = summary.withColumn("_rn", F.row_number().over(w))
    best = ranked.filter(F.col("_rn") == 1).select(group, model, "metric", F.col("mean").alias("best_value"),
                                                   F.col(label).alias(f"best_{label}"))
    stats = summary.groupBy(group, model, "metric").agg(
        F.avg("mean").alias("avg_value"), F.stddev_samp("mean").alias("std_value"),
        F.countDistinct(label).alias(f"n_{label}"))
    return best.join(stats, [group, model, "metric"], "inner")


def group_totals(results: DataFrame, group: str, label: str) -> DataFrame:
    """A10: distinct labels, total samples and mean event rate per group."""
    return results.groupBy(group).agg(F.countDistinct(label).alias(f"n_{label}"),
                                      F.sum("n_samples").alias("total_samples"),
                                      F.avg("event_rate").alias("avg_event_rate"))


def best_model_per_pair(mean_auc: DataFrame, keys: Sequence[str], models: Sequence[str],
                        metric: str = "auc_roc") -> DataFrame:
    """Per pair, the model with the larger score (tie -> first model;
    missing score counts 0)."""
    p = mean_auc.groupBy(*keys).pivot("model", list(models)).agg(F.first("mean"))
    a, b = (F.coalesce(F.col(m), F.lit(0.0)) for m in models[:2])
    return p.select(*keys, a.alias(f"{models[0]}_{metric}"), b.alias(f"{models[1]}_{metric}"),
                    F.when(a >= b, F.lit(models[0])).otherwise(F.lit(models[1])).alias("best_model"),
                    F.greatest(a, b).alias("best_value"))


def rank_experiments(mean_auc: DataFrame, keys: Sequence[str], model: str = "model") -> DataFrame:
    """Rank every pair per model by score (desc), ties by keys."""
    w = Window.partitionBy(model).orderBy(F.col("mean").desc(), *[F.col(k).asc() for k in keys])
    return mean_auc.select(model, *keys, F.col("mean").alias("value"), F.row_number().over(w).alias("rank"))


def overall_stats(summary: DataFrame, model: str = "model") -> DataFrame:
    """Mean, sample std, min, max per (model, metric)."""
    return summary.groupBy(model, "metric").agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("std"),
                                                F.min("mean").alias("min"), F.max("mean").alias("max"))


def horizon_table(results: DataFrame, horizon: str, event: str, model: str, split: str) -> DataFrame:
    """CV and test metrics side by side per (horizon, event, model) — a pivot
    with explicit split values."""
    r = with_rates(results)
    vals = {"auc": "auc_roc", "f1": "f1", "mcc": "mcc", "precision": "precision", "recall": "recall",
            "fpr": "fpr", "fnr": "fnr"}
    p = r.groupBy(horizon, event, model).pivot(split, ["cv", "test"]).agg(
        *[F.first(c).alias(k) for k, c in vals.items()])
    return p.select(horizon, event, model,
                    *[F.col(f"cv_{k}").alias(f"cv_{k}") for k in ("auc", "f1", "mcc")],
                    *[F.col(f"test_{k}").alias(f"test_{k}") for k in ("auc", "f1", "mcc")],
                    *[F.col(f"test_{k}").alias(k) for k in ("precision", "recall", "fpr", "fnr")])


def with_order(df: DataFrame, col: str, order: Sequence[str], name: str = "horizon_order") -> DataFrame:
    """Join-free fixed ordering: position in a literal array."""
    return df.withColumn(name, F.array_position(F.array(*[F.lit(x) for x in order]), F.col(col)).cast("int"))


def horizon_stats(ht: DataFrame, order: Sequence[str]) -> DataFrame:
    """Mean and sample std of test AUC/F1/MCC per horizon."""
    g = ht.groupBy("horizon").agg(*[f(F.col(f"test_{m}")).alias(f"{m}_{n}") for m in ("auc", "f1", "mcc")
                                    for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    return with_order(g, "horizon", order)


def degradation(hs: DataFrame, baseline: str) -> DataFrame:
    """% drop of each horizon's mean against the baseline horizon."""
    base = hs.filter(F.col("horizon") == baseline).select(
        F.lit(1).alias("_one"), *[F.col(f"{m}_mean").alias(f"_b_{m}") for m in ("auc", "f1", "mcc")])
    j = hs.withColumn("_one", F.lit(1)).join(F.broadcast(base), "_one")   # one baseline row
    return j.select("horizon", "horizon_order", *[
        F.when(F.col(f"_b_{m}") != 0, (F.col(f"_b_{m}") - F.col(f"{m}_mean")) / F.col(f"_b_{m}") * F.lit(100.0))
        .alias(f"{m}_drop_pct") for m in ("auc", "f1", "mcc")])


def overfit_gap(ht: DataFrame) -> DataFrame:
    """CV minus test per metric; mean and sample std by horizon and the
    mean by model — both groupings in one grouping-sets aggregation."""
    d = ht.select("horizon", "model", *[(F.col(f"cv_{m}") - F.col(f"test_{m}")).alias(f"{m}_gap")
                                        for m in ("auc", "f1", "mcc")])
    aggs = []
    for m in ("auc", "f1", "mcc"):
        aggs += [F.avg(f"{m}_gap").alias(f"{m}_gap_mean"), F.stddev_samp(f"{m}_gap").alias(f"{m}_gap_std")]
    g = d.groupingSets([["horizon"], ["model"]], "horizon", "model").agg(F.grouping("horizon").alias("_other"), *aggs)
    return g.select(F.when(F.col("_other") == 0, F.lit("horizon")).otherwise(F.lit("model")).alias("level"),
                    "horizon", "model", *[c for c in g.columns if c.endswith(("_mean", "_std"))])


def error_profile(ht: DataFrame) -> DataFrame:
    """FPR/FNR mean and std and their ratio by horizon; FPR, FNR,
    precision, recall means by event."""
    g = ht.groupingSets([["horizon"], ["event"]], "horizon", "event").agg(
        F.grouping("horizon").alias("_other"),
        F.avg("fpr").alias("fpr_mean"), F.stddev_samp("fpr").alias("fpr_std"),
        F.avg("fnr").alias("fnr_mean"), F.stddev_samp("fnr").alias("fnr_std"),
        F.avg("precision").alias("precision_mean"), F.avg("recall").alias("recall_mean"))
    by_h = F.col("_other") == 0
    return g.select(F.when(by_h, F.lit("horizon")).otherwise(F.lit("event")).alias("level"), "horizon", "event",
                    "fpr_mean", F.when(by_h, F.col("fpr_std")).alias("fpr_std"), "fnr_mean",
                    F.when(by_h, F.col("fnr_std")).alias("fnr_std"),
                    F.when(by_h & (F.col("fnr_mean") > 0), F.col("fpr_mean") / F.col("fnr_mean")).alias("fpr_fnr_ratio"),
                    F.when(~by_h, F.col("precision_mean")).alias("precision_mean"),
                    F.when(~by_h, F.col("recall_mean")).alias("recall_mean"))


def pr_balance(ht: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """|mean precision - mean recall| per horizon, flagged when < 0.1."""
    g = ht.groupBy("horizon").agg(F.avg("precision").alias("precision_mean"),
                                  F.avg("recall").alias("recall_mean"), F.avg("test_f1").alias("f1_mean"))
    bal = F.abs(F.col("precision_mean") - F.col("recall_mean"))
    return g.select("*", bal.alias("balance"), (bal < F.lit(tolerance)).alias("balanced"))


def horizon_gate(hs: DataFrame, auc: float = 0.90, f1: float = 0.50, mcc: float = 0.50) -> DataFrame:
    """A horizon passes when mean AUC > .90, F1 > .50 and MCC > .50;
    the cutoff is the last passing horizon in the fixed order."""
    passes = (F.col("auc_mean") > F.lit(auc)) & (F.col("f1_mean") > F.lit(f1)) & (F.col("mcc_mean") > F.lit(mcc))
    d = hs.select("horizon", "horizon_order", "auc_mean", "f1_mean", "mcc_mean", passes.alias("passes"))
    cut = d.agg(F.max(F.when(F.col("passes"), F.struct("horizon_order", "horizon"))).alias("_c"))
    j = d.withColumn("_one", F.lit(1)).join(F.broadcast(cut.withColumn("_one", F.lit(1))), "_one")
    return j.select("horizon", "horizon_order", "auc_mean", "f1_mean", "mcc_mean", "passes",
                    F.col("_c.horizon").alias("cutoff"))


def reliability(ht: DataFrame, models: Sequence[str]) -> DataFrame:
    """Per event mean test F1 / AUC, reliability band (EXCELLENT > .7,
    GOOD > .5, MODERATE > .3, POOR), rank by F1; and the relative F1
    advantage of the first model over the second."""
    e = ht.groupBy("event").agg(F.avg("test_f1").alias("avg_f1"), F.avg("test_auc").alias("avg_auc"))
    band = (F.when(F.col("avg_f1") > 0.7, F.lit("EXCELLENT")).when(F.col("avg_f1") > 0.5, F.lit("GOOD"))
            .when(F.col("avg_f1") > 0.3, F.lit("MODERATE")).otherwise(F.lit("POOR")))
    w = Window.orderBy(F.col("avg_f1").desc(), F.col("event").asc())
    a, b = models[:2]
    m = ht.agg(F.avg(F.when(F.col("model") == a, F.col("test_f1"))).alias("_a"),
               F.avg(F.when(F.col("model") == b, F.col("test_f1"))).alias("_b"))
    adv = F.when(F.col("_b") != 0, (F.col("_a") - F.col("_b")) / F.col("_b") * F.lit(100.0))
    j = e.withColumn("_one", F.lit(1)).join(F.broadcast(m.withColumn("_one", F.lit(1))), "_one")
    return j.select("event", "avg_f1", "avg_auc", band.alias("reliability"),
                    F.row_number().over(w).alias("f1_rank"), adv.alias(f"{a}_f1_advantage_pct"))


def score_matrix(ht: DataFrame, horizons: Sequence[str]) -> DataFrame:
    """Model x event rows, one mean test-F1 column per horizon."""
    p = ht.groupBy("model", "event").pivot("horizon", list(horizons)).agg(F.avg("test_f1"))
    return p.select("model", "event", *[F.col(h).alias(f"f1_{h}") for h in horizons])


def t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t with integer ``df`` >= 1, by the
    finite closed-form series (no special-function library)."""
    theta = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    c2 = F.cos(theta) * F.cos(theta)
    # even df: A = sin(th) * sum_{k=0}^{(df-2)/2} c_k cos^{2k}, c_k = c_{k-1}(2k-1)/(2k)
    # odd df:  A = 2/pi (th + sin(th) cos(th) sum_{k=0}^{(df-3)/2} d_k cos^{2k}), d_k = d_{k-1}(2k)/(2k+1)
    kmax_even = F.floor((df - 2) / 2).cast("int")
    kmax_odd = F.floor((df - 3) / 2).cast("int")

    def series(kmax: Column, odd: bool) -> Column:
        acc0 = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

        def step(acc, k):
            kd = k.cast("double")
            r = (F.lit(2.0) * kd) / (F.lit(2.0) * kd + F.lit(1.0)) if odd else \
                (F.lit(2.0) * kd - F.lit(1.0)) / (F.lit(2.0) * kd)
            term = acc["term"] * r * c2
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))
        s = F.aggregate(F.sequence(F.lit(1), F.greatest(kmax, F.lit(1))), acc0, step)
        return F.when(kmax >= 1, s["total"]).when(kmax == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    a_even = F.sin(theta) * series(kmax_even, False)
    a_odd = F.lit(2.0 / math.pi) * (theta + F.sin(theta) * F.cos(theta) * series(kmax_odd, True))
    a = F.when(F.pmod(df, F.lit(2)) == 0, a_even).otherwise(a_odd)
    return F.lit(1.0) - a


def paired_t(ht: DataFrame, keys: Sequence[str], models: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """M14 + J3: pair model A and B rows with the same keys (only when each
    side has exactly one row), paired t-test of A - B per metric, with
    significance stars at .001 / .01 / .05."""
    a, b = models[:2]
    aggs = []
    for m in metrics:
        for x in (a, b):
            aggs += [F.first(F.when(F.col("model") == x, F.col(m)), ignorenulls=True).alias(f"{x}__{m}")]
    aggs += [F.count(F.when(F.col("model") == x, 1)).alias(f"_n_{x}") for x in (a, b)]
    pairs = ht.groupBy(*keys).agg(*aggs).filter((F.col(f"_n_{a}") == 1) & (F.col(f"_n_{b}") == 1))
    long = pairs.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{a}__{m}").alias("a"),
                                                            F.col(f"{b}__{m}").alias("b")) for m in metrics])).alias("_x")
                        ).select(*keys, "_x.*")
    g = long.groupBy("metric").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("a").alias(f"{a}_mean"),
                                   F.avg("b").alias(f"{b}_mean"), F.avg(F.col("a") - F.col("b")).alias("mean_diff"),
                                   F.stddev_samp(F.col("a") - F.col("b")).alias("_sd"))
    t = F.when(F.col("_sd") > 0, F.col("mean_diff") / (F.col("_sd") / F.sqrt(F.col("n_pairs").cast("double"))))
    g = g.filter(F.col("n_pairs") > 1).select("*", t.alias("t_stat"))
    p = t_two_sided_p(F.col("t_stat"), F.col("n_pairs") - 1)
    g = g.select("*", p.alias("p_value"))
    stars = (F.when(F.col("p_value") < 0.001, F.lit("***")).when(F.col("p_value") < 0.01, F.lit("**"))
             .when(F.col("p_value") < 0.05, F.lit("*")).otherwise(F.lit("ns")))
    return g.select("metric", "n_pairs", f"{a}_mean", f"{b}_mean", "mean_diff", "t_stat", "p_value",
                    stars.alias("significance"))


def experiment_gate(df: DataFrame, keys: Sequence[str], label: str, min_rows: int = 100,
                    min_pos: int = 10) -> DataFrame:
    """A4: samples, positives and rate per experiment; too few rows or
    positives gives a skip reason."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"),
                              F.sum(F.col(label).cast("long")).alias("n_positive"))
    reason = (F.when(F.col("n_samples") < min_rows, F.lit("insufficient samples"))
              .when(F.col("n_positive") < min_pos, F.lit("insufficient positives")))
    return g.select("*", (F.col("n_positive") / F.col("n_samples")).alias("event_rate"), reason.alias("skip_reason"))

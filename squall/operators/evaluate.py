"""Exact evaluation as aggregations.

Everything is computed from a *score table*: one row per (group, distinct
score) with its row and positive counts and running totals.  That table is
built by partial aggregation and a two-level running sum, so exact ROC AUC
(ties averaged), average precision and the best-F1 threshold need no sort of
the raw rows and no single-task window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from squall.operators.blocks import add_position
from squall.operators.stats import BLOCK_VALUES, running_sums


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is 0 (zero_division=0)."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def metrics_from_cells(df: DataFrame, tp="tp", fp="fp", fn="fn", tn="tn") -> DataFrame:
    """M7: the ten classification metrics from confusion cells.

    Adds n_samples, event_rate, accuracy, balanced_accuracy, precision,
    recall, f1, specificity, mcc, kappa (all DOUBLE; zero denominators
    give 0)."""
    TP, FP, FN, TN = _d(tp), _d(fp), _d(fn), _d(tn)
    n = TP + FP + FN + TN
    prec = ratio(TP, TP + FP)
    rec = ratio(TP, TP + FN)
    spec = ratio(TN, TN + FP)
    f1 = ratio(F.lit(2.0) * prec * rec, prec + rec)
    mcc_den = F.sqrt((TP + FP) * (TP + FN) * (TN + FP) * (TN + FN))
    mcc = ratio(TP * TN - FP * FN, mcc_den)
    po = ratio(TP + TN, n)
    pe = ratio((TP + FP) * (TP + FN) + (FN + TN) * (FP + TN), n * n)
    kappa = ratio(po - pe, F.lit(1.0) - pe)
    return df.select("*", n.cast("long").alias("n_samples"), ratio(TP + FN, n).alias("event_rate"),
                     po.alias("accuracy"), ((rec + spec) / F.lit(2.0)).alias("balanced_accuracy"),
                     prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                     spec.alias("specificity"), mcc.alias("mcc"), kappa.alias("kappa"))


def confusion_cells(df: DataFrame, keys: Sequence[str], label: str, pred: Column) -> DataFrame:
    """Confusion cells per group in one conditional-sum aggregation."""
    y = F.col(label).cast("boolean")
    p = pred.cast("boolean")
    return df.groupBy(*keys).agg(
        F.count(F.when(y & p, 1)).alias("tp"), F.count(F.when(~y & p, 1)).alias("fp"),
        F.count(F.when(y & ~p, 1)).alias("fn"), F.count(F.when(~y & ~p, 1)).alias("tn"))


def confusion_shares(cells: DataFrame) -> DataFrame:
    """Confusion cells as row percentages (per actual class)."""
    TP, FP, FN, TN = _d("tp"), _d("fp"), _d("fn"), _d("tn")
    return cells.select("*", ratio(F.lit(100.0) * TN, TN + FP).alias("tn_pct"),
                        ratio(F.lit(100.0) * FP, TN + FP).alias("fp_pct"),
                        ratio(F.lit(100.0) * FN, FN + TP).alias("fn_pct"),
                        ratio(F.lit(100.0) * TP, FN + TP).alias("tp_pct"))


def score_table(df: DataFrame, keys: Sequence[str], score: str, label: str, block_values: int = BLOCK_VALUES) -> DataFrame:
    """One row per (group, distinct score): ``n``, ``ps`` (positives),
    ``n_lt`` / ``ps_lt`` (rows / positives with a lower score), ``n_tot``,
    ``p_tot``, by sums that run over blocks of bounded size."""
    keys = list(keys)
    b = (df.filter(F.col(score).isNotNull())
         .groupBy(*keys, score).agg(F.count(F.lit(1)).alias("n"),
                                    F.sum(F.col(label).cast("long")).alias("ps")))
    r = running_sums(b, keys, score, ["n", "ps"], block_values)
    return r.select(*keys, score, "n", "ps", F.col("n_all").alias("n_tot"), F.col("ps_all").alias("p_tot"),
                    F.col("n_before").alias("n_lt"), F.col("ps_before").alias("ps_lt"))


def roc_auc(st: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M8: exact ROC AUC with ties = Mann-Whitney U with average ranks."""
    avg_rank = _d("n_lt") + (_d("n") + F.lit(1.0)) / F.lit(2.0)
    g = st.groupBy(*keys).agg(F.sum(_d("ps") * avg_rank).alias("_r"), F.first("p_tot").alias("_p"),
                              F.first("n_tot").alias("_n"))
    P, N = _d("_p"), _d("_n") - _d("_p")
    auc = F.when((P > 0) & (N > 0), (F.col("_r") - P * (P + F.lit(1.0)) / F.lit(2.0)) / (P * N))
    return g.select(*keys, auc.alias("roc_auc"))


def average_precision(st: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M9: AP = sum over distinct scores (high to low) of recall step times
    precision at that score."""
    n_ge = _d("n_tot") - _d("n_lt")
    ps_ge = _d("p_tot") - _d("ps_lt")
    term = F.when(_d("p_tot") > 0, (_d("ps") / _d("p_tot")) * (ps_ge / n_ge))
    return st.groupBy(*keys).agg(F.sum(term).alias("average_precision"))


def best_threshold_f1(st: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M5: every distinct score is a threshold (predict score >= t); pick
    the largest 2PR/(P+R+1e-10), the lowest threshold on ties.  Returns the
    threshold, its F1 and the confusion cells there (an aggregate argmax —
    no window over the thresholds)."""
    tp = _d("p_tot") - _d("ps_lt")
    pp = _d("n_tot") - _d("n_lt")
    prec = ratio(tp, pp)
    rec = F.when(_d("p_tot") > 0, tp / _d("p_tot")).otherwise(F.lit(1.0))
    f1 = F.lit(2.0) * prec * rec / (prec + rec + F.lit(1e-10))
    cand = F.struct(f1.alias("f1"), (-F.col(st.columns[len(keys)])).alias("_neg"),
                    F.col(st.columns[len(keys)]).alias("threshold"),
                    tp.cast("long").alias("tp"), (pp - tp).cast("long").alias("fp"),
                    (_d("p_tot") - tp).cast("long").alias("fn"),
                    (_d("n_tot") - pp - (_d("p_tot") - tp)).cast("long").alias("tn"))
    g = st.groupBy(*keys).agg(F.max(cand).alias("_b"))
    return g.select(*keys, "_b.threshold", "_b.f1", "_b.tp", "_b.fp", "_b.fn", "_b.tn")


def fbeta(tp: Column, fp: Column, fn: Column, beta: float) -> Column:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    b2 = F.lit(float(beta * beta))
    return ratio((F.lit(1.0) + b2) * p * r, b2 * p + r)


def best_threshold_fbeta(df: DataFrame, keys: Sequence[str], score: str, label: str,
                         thresholds: Sequence[float], beta: float = 2.0, default: float = 0.3) -> DataFrame:
    """M6: scan a fixed threshold grid in order; keep the first strict
    improvement of F-beta over 0 (default threshold otherwise).  All grid
    points are counted in one conditional-sum aggregation."""
    s, y = F.col(score), F.col(label).cast("boolean")
    aggs = []
    for i, t in enumerate(thresholds):
        aggs += [F.count(F.when(y & (s >= F.lit(t)), 1)).alias(f"_tp{i}"),
                 F.count(F.when(~y & (s >= F.lit(t)), 1)).alias(f"_fp{i}"),
                 F.count(F.when(y & ~(s >= F.lit(t)), 1)).alias(f"_fn{i}")]
    g = df.groupBy(*keys).agg(*aggs)
    scores = [F.struct(fbeta(_d(f"_tp{i}"), _d(f"_fp{i}"), _d(f"_fn{i}"), beta).alias("f"),
                       F.lit(-i).alias("_neg"), F.lit(float(t)).alias("threshold"))
              for i, t in enumerate(thresholds)]
    best = F.array_max(F.array(*scores))
    g = g.select(*keys, best.alias("_b"))
    return g.select(*keys, F.when(F.col("_b.f") > 0, F.col("_b.threshold")).otherwise(F.lit(float(default)))
                    .alias("threshold"), F.greatest(F.col("_b.f"), F.lit(0.0)).alias("fbeta"))


def assign_folds(df: DataFrame, order: Sequence[str], ts: str, k: int,
                 keys: Sequence[str] = (), block_seconds: int = 3600) -> DataFrame:
    """Expanding-window time-series folds.  With n rows and t = n div
    (k+1), fold j (1..k) tests positions [n-(k-j+1)t, n-(k-j)t) and trains
    on every earlier position.  Adds ``_pos``, ``n_rows`` and ``test_fold``
    (NULL for the head that is never tested); the training set of fold j is
    ``_pos < n_rows - (k-j+1)*t`` — no row is copied per fold."""
    keys = list(keys)
    d = add_position(df, keys, order, ts, block_seconds)
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    d = (d.join(n, keys, "inner") if keys else
         d.withColumn("_one", F.lit(1)).join(F.broadcast(n.withColumn("_one", F.lit(1))), "_one").drop("_one"))
    t = F.floor(F.col("n_rows") / F.lit(k + 1))
    first_test = F.col("n_rows") - F.lit(k) * t
    fold = F.when((t > 0) & (F.col("_pos") >= first_test), F.floor((F.col("_pos") - first_test) / t) + 1)
    return d.withColumn("test_fold", fold.cast("int"))


def fold_bounds(n_rows: Column, k: int, j: int) -> tuple[Column, Column]:
    t = F.floor(n_rows / F.lit(k + 1))
    return n_rows - F.lit(k - j + 1) * t, n_rows - F.lit(k - j) * t


def class_weight_balanced(n: Column, n_pos: Column) -> tuple[Column, Column]:
    """M1: n/(2 n_pos) for positives, n/(2 n_neg) for negatives; 1.0 for an
    empty class."""
    n_neg = n - n_pos
    wp = F.when(n_pos > 0, _d(n) / (F.lit(2.0) * _d(n_pos))).otherwise(F.lit(1.0))
    wn = F.when(n_neg > 0, _d(n) / (F.lit(2.0) * _d(n_neg))).otherwise(F.lit(1.0))
    return wp, wn


def class_weight_power(n: Column, n_pos: Column, power: float = 0.75) -> Column:
    """M2: (n_neg / n_pos) ** power for positives (negatives weigh 1)."""
    n_neg = n - n_pos
    return F.when(n_pos > 0, F.pow(_d(n_neg) / _d(n_pos), F.lit(float(power)))).otherwise(F.lit(1.0))

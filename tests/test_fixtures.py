"""Golden micro-fixtures (hand-checked values)."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from squall.functions.rules import EventRule
from squall.operators import evaluate as evl
from squall.operators import events as ev
from squall.operators import reshape as rs
from squall.operators import stats as st

READINGS = [1, -1, -2, -1, -3, -1, -1, -1, -2, 1, -1, None, -4, -5]
T0 = dt.datetime(2024, 1, 1)
NEG = EventRule("neg", ("v",), lambda c: c["v"] < F.lit(0.0), 2.0)


def readings(spark):
    rows = [("s", T0 + dt.timedelta(minutes=15 * i), None if v is None else float(v)) for i, v in enumerate(READINGS)]
    return spark.createDataFrame(rows, "series string, ts timestamp, v double")


@pytest.mark.parametrize("block", [3600, 900, 86400 * 7])
def test_runs(spark, block):
    s = ev.event_segments(readings(spark), ["series"], "ts", [NEG], block_seconds=block).orderBy("start").collect()
    got = [(r.start.strftime("%H:%M"), r.end.strftime("%H:%M"), r.duration_minutes, r.meets_min_duration) for r in s]
    assert got == [("00:15", "02:15", 120.0, True), ("02:30", "02:45", 15.0, False), ("03:00", "03:15", 15.0, False)]


@pytest.mark.parametrize("block", [3600, 86400])
def test_labels_inclusive_end(spark, block):
    lab = ev.label_rows(readings(spark), ["series"], "ts", [NEG], block_seconds=block).orderBy("ts").collect()
    assert [int(r.event_neg) for r in lab] == [0] + [1] * 13
    assert lab[9].event_neg_duration_min == 120.0 and lab[9].event_neg_meets_duration
    assert lab[11].event_neg_duration_min == 15.0
    assert lab[1].active_events == "neg" and lab[10].active_events == "neg*"
    assert lab[0].active_events == "none" and lab[1].event_durations == "neg:120.0min"


def test_duration_mask(spark):
    d, masks = ev.add_masks(readings(spark), [NEG])
    dm = ev.duration_mask(d, ["series"], "ts", {masks[0]: 8}, block_rows=7).orderBy("ts").collect()
    assert [i for i, r in enumerate(dm) if r[f"{masks[0]}_dur"]] == [8]


@pytest.mark.parametrize("gap,expected", [
    (0.0, [(0, 45, 45.0), (60, 90, 30.0), (100, 100, 15.0)]),
    (15.0, [(0, 100, 100.0)])])
def test_merge(spark, gap, expected):
    iv = [(0, 30), (30, 45), (60, 90), (70, 80), (100, 100)]
    rows = [("e", T0 + dt.timedelta(minutes=a), T0 + dt.timedelta(minutes=b)) for a, b in iv]
    df = spark.createDataFrame(rows, "event string, start timestamp, end timestamp")
    for block in (600, 3600 * 24):
        m = ev.merge_intervals(df, ["event"], max_gap_minutes=gap, block_seconds=block).orderBy("start").collect()
        got = [(int((r.start - T0).total_seconds() // 60), int((r.end - T0).total_seconds() // 60), r.duration_minutes)
               for r in m]
        assert got == expected


def test_folds(spark):
    rows = [(T0 + dt.timedelta(hours=i), i) for i in range(11)]
    df = spark.createDataFrame(rows, "ts timestamp, i int")
    d = evl.assign_folds(df, ["ts"], "ts", 3).orderBy("ts").collect()
    assert [r.test_fold for r in d] == [None] * 5 + [1, 1, 2, 2, 3, 3]
    lo = [11 - (3 - j + 1) * (11 // 4) for j in (1, 2, 3)]
    assert lo == [5, 7, 9]


def scores(spark):
    y = [0, 0, 1, 1, 0, 1]
    p = [.1, .4, .35, .8, .4, .4]
    return spark.createDataFrame([("m", bool(a), b) for a, b in zip(y, p)], "model string, label boolean, score double")


def test_scores(spark):
    stab = evl.score_table(scores(spark), ["model"], "score", "label")
    auc = evl.roc_auc(stab, ["model"]).first().roc_auc
    ap = evl.average_precision(stab, ["model"]).first().average_precision
    best = evl.best_threshold_f1(stab, ["model"]).first()
    assert round(auc, 6) == 0.666667 and round(ap, 6) == 0.7
    assert best.threshold == 0.35 and round(best.f1, 6) == 0.75
    assert (best.tp, best.fp, best.fn, best.tn) == (3, 2, 0, 1)
    m = evl.metrics_from_cells(spark.createDataFrame([(3, 2, 0, 1)], "tp long, fp long, fn long, tn long")).first()
    assert round(m.mcc, 6) == 0.447214 and round(m.kappa, 6) == 0.333333


def test_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 4, 10)], "v double")
    q = st.exact_quantiles(df, [], "v", [0.05, 0.2, 0.4], ["a", "b", "c"]).first()
    assert (round(q.a, 6), round(q.b, 6), round(q.c, 6)) == (1.15, 1.6, 2.4)


def test_fill(spark):
    rows = [(T0 + dt.timedelta(hours=i), v) for i, v in enumerate([None, 5.0, None, 7.0])]
    df = spark.createDataFrame(rows, "ts timestamp, x double")
    for block in (3600, 86400):
        f = rs.fill_forward_backward(df, [], "ts", ["x"], final=0.0, block_seconds=block).orderBy("ts").collect()
        assert [r.x for r in f] == [5.0, 5.0, 5.0, 7.0]


def test_labels_exclusive_end(spark):
    lab = ev.label_rows(readings(spark), ["series"], "ts", [NEG], end_inclusive=False).orderBy("ts").collect()
    assert [int(r.event_neg) for r in lab] == [0, 1, 1, 1, 1, 1, 1, 1, 1, 0, 1, 0, 1, 1]

"""Cases the oracle's tables do not hold: NULL keys, negative log values, skewed values, long steps."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from squall.functions.rules import EventRule
from squall.operators import clean, events, logs, stats
from squall.session import _is_local

T0 = dt.datetime(2024, 1, 1)


def test_a_null_series_is_one_series(spark):
    rows = [(s, T0 + dt.timedelta(hours=12 * i), 5.0) for s in (None, "a") for i in range(60)]
    d = spark.createDataFrame(rows, "series string, ts timestamp, v double")
    rule = EventRule("warm", ["v"], lambda c: c["v"] > 1, 1.0)
    got = events.event_segments(d, ["series"], "ts", [rule], cols={"v": F.col("v")}).collect()
    assert sorted((x["series"] or "", x["start"]) for x in got) == [("", T0), ("a", T0)]


LINES = ["FORECAST HORIZON: 1hr", "EVENT: storm", "  TN= 1,000 | FP= 2", "  FN= 3 | TP= 4", "  1. f1 : 0.5", "  2. mcc : -0.25",
         "XGBOOST Results:", "  CV: AUC=0.5, F1=0.1, MCC=-0.02", "  Test: AUC=0.6, F1=0.2, MCC=-0.03"]


def test_log_sections_with_negative_values_and_twice_in_a_file(spark):
    again = [x.replace("0.6", "0.7").replace("-0.03", "0.04") for x in LINES]
    rows = [("a.log", i, x) for i, x in enumerate([*LINES, *again])]
    d = spark.createDataFrame(rows, "file string, line_no long, line string")
    got = sorted(logs.run_log_metrics(d).collect(), key=lambda x: x["section"])
    assert [(x["section"], x["cv_mcc"], x["test_auc"], x["test_mcc"], x["tn"]) for x in got] == \
        [(6, -0.02, 0.6, -0.03, 1000), (15, -0.02, 0.7, 0.04, 1000)]
    values = sorted((x["section"], x["feature"], x["importance"]) for x in logs.run_log_importance(d).collect())
    assert values == [(6, "f1", 0.5), (6, "mcc", -0.25), (15, "f1", 0.5), (15, "mcc", -0.25)]


def test_a_far_value_changes_no_quantile(spark):
    d = spark.range(20_000).select((F.col("id") / 20_000).alias("v"), F.lit("g").alias("g"))
    d = d.unionByName(spark.createDataFrame([(1e12, "g")], "v double, g string"))
    got = stats.exact_quantiles(d, ["g"], "v", [0.0, 0.5, 1.0]).first()
    assert (got["q00"], got["q50"], got["q100"]) == (0.0, 0.5, 1e12)


def test_average_ranks(spark):
    values = [3.0, 1.0, 3.0, None, 2.0, 3.0]
    d = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    got = sorted((x["v"], x["r"]) for x in stats.average_rank(d, ["g"], "v", "r").collect() if x["v"] is not None)
    assert got == [(1.0, 1.0), (2.0, 2.0), (3.0, 4.0), (3.0, 4.0), (3.0, 4.0)]


def test_unions_of_many_series_starting_together(spark):
    r = [(f"t{i}", "e", T0 + dt.timedelta(minutes=7 * (i % 50)), T0 + dt.timedelta(minutes=7 * (i % 50) + 5)) for i in range(3000)]
    d = spark.createDataFrame(r, "tower string, event string, start timestamp, end timestamp")
    assert events.merge_intervals(d, ["event"]).count() == 50
    assert events.merge_intervals(d, ["event"], max_gap_minutes=2.0).count() == 1
    assert events.merge_intervals(d, ["event"], materialize=False).count() == 50


def test_sampling_repeats(spark):
    d = spark.range(1000).select("id", (F.col("id") % 7).alias("ts"))
    picked = [x["id"] for x in clean.sample_rows(d, 50, 1, ["id"], ["id"]).collect()]
    assert picked == sorted(picked) and len(set(picked)) == 50
    assert picked == [x["id"] for x in clean.sample_rows(d.repartition(7), 50, 1, ["id"], ["id"]).collect()]


@pytest.mark.parametrize("n", [1, 2, 7919, 704791, 7919 * 7920])
def test_the_permutations_multiplier_has_no_common_factor(n):
    mult = 7919
    while math.gcd(mult, n) > 1:
        mult += 1
    assert math.gcd(mult, n) == 1 and mult < 7919 + 100


def test_a_local_cluster_is_no_local_session():
    class Fake:
        class sparkContext:
            master = "local-cluster[3,2,1000]"

    assert not _is_local(Fake)
    Fake.sparkContext.master = "local[4]"
    assert _is_local(Fake)

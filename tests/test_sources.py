"""Sources and sinks on small files written by the test itself."""
import datetime as dt
import os

from pyspark.sql import functions as F

from squall.functions.rules import LABELER_RULES, TOWER_COLUMNS, column_for, series_with
from squall.operators import events as ev
from squall.session import shared_dir
from squall.sources import io as sio
from squall.streaming.ingest import ingest

COLS = ["TempC_030m", "PkWSpdMph_030m", "TempC_035m", "PkWSpdMph_035m"]


def local(uri: str) -> str:
    """Local-filesystem path of a file: URI (tests write files directly)."""
    return uri[len("file:"):] if uri.startswith("file:") else uri


def _write_raw(base, tower, rows):
    base = local(base)
    os.makedirs(base, exist_ok=True)
    with open(os.path.join(base, f"{tower}_2021.csv"), "w") as f:
        f.write("timestampUTC," + ",".join(COLS) + "\n")
        for r in rows:
            f.write(",".join(str(x) for x in r) + "\n")
        f.write("Data provided as is,,,,\n")      # footer line


def _raw_rows(n, temp0):
    t0 = dt.datetime(2021, 1, 1)
    out = []
    for i in range(n):
        ts = (t0 + dt.timedelta(minutes=15 * i)).strftime("%Y%m%d%H%M%S")
        temp = -999 if i == 3 else temp0 - i
        out.append((ts, temp, 30 - i, temp, 30 - i))
    return out


def test_read_tower_csv_and_rules(spark):
    base = shared_dir(spark, "raw")
    _write_raw(base, "TOWA", _raw_rows(12, 2))
    _write_raw(base, "TOWD", _raw_rows(12, 5))
    df = sio.read_tower_csv(spark, base, COLS, tower_pattern=r"([A-Z]{4})_\d+\.csv")
    assert df.count() == 24                                   # footers dropped
    assert df.filter(F.col("TempC_030m").isNull()).count() == 2   # sentinel -> NULL
    present = df.columns
    cols = {v: column_for(v, TOWER_COLUMNS, "tower", present) for v in ("TempC", "PkWSpdMph")}
    segs = ev.event_segments(df, ["tower"], "ts", LABELER_RULES, cols=cols).collect()
    got = {(r.tower, r.event, r.start.strftime("%H:%M")) for r in segs}
    # TOWA: temp 2,1,0,NULL,-2,... -> below 0 from 01:00 (NULL at 00:45 breaks nothing before)
    assert ("TOWA", "E3_LowTemp_lt0", "01:00") in got
    assert ("TOWD", "E3_LowTemp_lt0", "01:30") in got
    assert ("TOWA", "E4_HighWind_Peak_gt25", "00:00") in got
    assert series_with(LABELER_RULES[0], TOWER_COLUMNS, present) == ["TOWA", "TOWB", "TOWD"]


def test_optional_side_table_and_sinks(spark):
    base = shared_dir(spark, "sinks")
    assert sio.read_auxiliary(spark, f"{base}/missing") is None
    df = spark.range(10).select((F.col("id") % 2).alias("tower"), F.col("id").alias("v"))
    sio.write_table(df, f"{base}/t", "csv", ["tower"])
    back = sio.read_partitioned_by_name(spark, f"{base}/t", r"tower=(\d+)/", ["tower_from_path"],
                                        schema="v long")
    assert sorted((r.tower_from_path, r.v) for r in back.collect()) == sorted((str(i % 2), i) for i in range(10))
    sio.write_table(df, f"{base}/p")
    assert sio.read_auxiliary(spark, f"{base}/p").count() == 10
    lab = sio.read_labeled(spark, f"{base}/p", ["v"])
    assert lab.columns[0] == "v"


def test_log_reader(spark):
    base = shared_dir(spark, "logs")
    os.makedirs(local(base), exist_ok=True)
    with open(f"{local(base)}/run.log", "w") as f:
        f.write("FORECAST HORIZON: 1hr\nEVENT: event_E5_LowWind_lt2\n  TN= 6,123 | FP= 45\n  FN= 12 | TP= 300\n"
                "  1. TOWA_TempC_030m_lag4 : 0.399188\nXGBOOST Results:\n  CV: AUC=0.9597, F1=0.8228, MCC=0.7323\n"
                "  Test: AUC=0.9550, F1=0.8200, MCC=0.7154\n")
    from squall.operators.logs import run_log_importance, run_log_metrics
    lines = sio.read_log_lines(spark, base)
    m = run_log_metrics(lines).first()
    assert (m.horizon, m.event, m.model, m.tn, m.fp, m.fn, m.tp) == ("1hr", "event_E5_LowWind_lt2", "xgboost", 6123, 45, 12, 300)
    assert (m.cv_auc, m.test_mcc) == (0.9597, 0.7154)
    i = run_log_importance(lines).first()
    assert (i.feature, i.importance, i.model) == ("TOWA_TempC_030m_lag4", 0.399188, "xgboost")


def test_streaming_ingest_exactly_once(spark):
    src = shared_dir(spark, "stream_src")
    dst = shared_dir(spark, "stream_dst")
    ck = shared_dir(spark, "stream_ck")
    _write_raw(src, "TOWA", _raw_rows(6, 2))
    ingest(spark, src, dst, ck, COLS)
    assert spark.read.parquet(dst).count() == 6
    _write_raw(src, "TOWD", _raw_rows(4, 5))
    ingest(spark, src, dst, ck, COLS)                  # only the new file is read
    d = spark.read.parquet(dst)
    assert d.count() == 10 and sorted(r.tower for r in d.select("tower").distinct().collect()) == ["TOWA", "TOWD"]

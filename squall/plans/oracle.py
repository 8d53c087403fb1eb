"""DuckDB oracle SQL for every registered query (same views, same rules).

Views are written as CTE fragments and composed per query.  Doubles are
rounded to 6 places on both sides.
"""

from __future__ import annotations

def exact_mean_sql(nv: str, u: str) -> str:
    """Mean rounded half away from zero to 6 places from an exact decimal
    sum ``u`` (in 1e-9 units) and a count ``nv`` — same digits as the engine."""
    return f"CASE WHEN {nv} > 0 THEN sign({u}) * ((2 * abs({u}) + {nv} * 1000) // (2 * {nv} * 1000)) / 1e6 END"


V_GRID = """grid AS (SELECT series, ts, """ + exact_mean_sql("nv", "u") + """ AS temp, peak, n FROM (
  SELECT event_type AS series, date_trunc('hour', ts) AS ts, count(value) AS nv,
         (sum(value::DECIMAL(38,9)) * 1000000000)::HUGEINT AS u, max(value) AS peak, count(*) AS n
  FROM events GROUP BY 1, 2))"""

V_OBS = """obs AS (SELECT user_id AS series, ts, event_type AS var, value FROM events)"""

# masks of the three grid rules, long form
V_MASKS = V_GRID + """,
masks AS (
  SELECT series, ts, 'hot' AS event, 120.0::DOUBLE AS min_minutes, coalesce(temp > 60, false) AS m FROM grid
  UNION ALL SELECT series, ts, 'calm', 180.0::DOUBLE, coalesce(temp < 42, false) FROM grid
  UNION ALL SELECT series, ts, 'gusty', 60.0::DOUBLE, coalesce(temp > 40 AND peak > 100, false) FROM grid),
runs AS (
  SELECT *, m AND NOT coalesce(lag(m) OVER w, false) AS st,
         coalesce(lag(m) OVER w, false) AS prev_m,
         min(CASE WHEN NOT m THEN ts END) OVER (PARTITION BY series, event ORDER BY ts
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nf,
         max(ts) OVER (PARTITION BY series, event) AS smax
  FROM masks WINDOW w AS (PARTITION BY series, event ORDER BY ts))"""

V_SEGMENTS = V_MASKS + """,
segments AS (
  SELECT series, event, ts AS start, coalesce(nf, smax) AS "end",
         (epoch_us(coalesce(nf, smax)) - epoch_us(ts)) / 60000000.0 AS duration_minutes,
         (epoch_us(coalesce(nf, smax)) - epoch_us(ts)) / 60000000.0 >= min_minutes AS meets_min_duration,
         min_minutes AS min_duration_required_min
  FROM runs WHERE st)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SQL: dict[str, str] = {}

SQL["event_segments"] = with_(V_SEGMENTS) + """
SELECT series, event, start, "end", round(duration_minutes, 6) AS duration_minutes,
       meets_min_duration, min_duration_required_min FROM segments"""

SQL["event_segments_min_duration"] = with_(V_SEGMENTS) + """
SELECT series, event, start, "end", round(duration_minutes, 6) AS duration_minutes,
       meets_min_duration, min_duration_required_min FROM segments WHERE meets_min_duration"""

V_LABELS = V_MASKS + """,
lab AS (
  SELECT series, ts, event, min_minutes, m OR prev_m AS lab,
         CASE WHEN m OR prev_m THEN
           (epoch_us(CASE WHEN m THEN coalesce(nf, smax) ELSE ts END)
            - epoch_us(max(CASE WHEN st THEN ts END) OVER (PARTITION BY series, event ORDER BY ts
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))) / 60000000.0 END AS dur
  FROM runs),
labw AS (
  SELECT g.series, g.ts, g.temp, g.peak, g.n,
    coalesce(bool_or(lab) FILTER (WHERE event = 'hot'), false) AS event_hot,
    coalesce(max(dur) FILTER (WHERE event = 'hot' AND lab), 0.0) AS event_hot_duration_min,
    coalesce(bool_or(dur >= min_minutes) FILTER (WHERE event = 'hot' AND lab), false) AS event_hot_meets_duration,
    coalesce(bool_or(lab) FILTER (WHERE event = 'calm'), false) AS event_calm,
    coalesce(max(dur) FILTER (WHERE event = 'calm' AND lab), 0.0) AS event_calm_duration_min,
    coalesce(bool_or(dur >= min_minutes) FILTER (WHERE event = 'calm' AND lab), false) AS event_calm_meets_duration,
    coalesce(bool_or(lab) FILTER (WHERE event = 'gusty'), false) AS event_gusty,
    coalesce(max(dur) FILTER (WHERE event = 'gusty' AND lab), 0.0) AS event_gusty_duration_min,
    coalesce(bool_or(dur >= min_minutes) FILTER (WHERE event = 'gusty' AND lab), false) AS event_gusty_meets_duration
  FROM grid g JOIN lab l ON g.series = l.series AND g.ts = l.ts
  GROUP BY g.series, g.ts, g.temp, g.peak, g.n),
labels AS (
  SELECT *, (event_hot::INT + event_calm::INT + event_gusty::INT) AS event_count,
    CASE WHEN event_hot OR event_calm OR event_gusty THEN concat_ws(',',
      CASE WHEN event_hot THEN CASE WHEN event_hot_meets_duration THEN 'hot' ELSE 'hot*' END END,
      CASE WHEN event_calm THEN CASE WHEN event_calm_meets_duration THEN 'calm' ELSE 'calm*' END END,
      CASE WHEN event_gusty THEN CASE WHEN event_gusty_meets_duration THEN 'gusty' ELSE 'gusty*' END END)
    ELSE 'none' END AS active_events,
    CASE WHEN event_hot OR event_calm OR event_gusty THEN concat_ws(',',
      CASE WHEN event_hot THEN printf('hot:%.1fmin', event_hot_duration_min) END,
      CASE WHEN event_calm THEN printf('calm:%.1fmin', event_calm_duration_min) END,
      CASE WHEN event_gusty THEN printf('gusty:%.1fmin', event_gusty_duration_min) END)
    ELSE 'none' END AS event_durations,
    (event_hot OR event_calm OR event_gusty) AS has_any_event
  FROM labw)"""

V_MERGED = V_SEGMENTS + """,
mp AS (SELECT event, start AS s, "end" AS e,
         max("end") OVER (PARTITION BY event ORDER BY start, "end"
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM segments),
mg AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY event
             ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS gid FROM mp),
merged AS (SELECT event, min(s) AS start, max(e) AS "end",
         CASE WHEN (epoch_us(max(e)) - epoch_us(min(s))) / 60000000.0 <= 0 THEN 15.0
              ELSE (epoch_us(max(e)) - epoch_us(min(s))) / 60000000.0 END AS duration_minutes
         FROM mg GROUP BY event, gid)"""

SQL["label_rows"] = with_(V_LABELS) + "SELECT * FROM labels"

SQL["interval_label_join"] = with_(V_SEGMENTS) + """
SELECT g.series, g.ts, s.event, round(s.duration_minutes, 6) AS duration_minutes,
       s.meets_min_duration
FROM grid g JOIN segments s ON g.series = s.series AND g.ts BETWEEN s.start AND s."end\""""

SQL["union_segments"] = with_(V_MERGED) + """
SELECT event, start, "end", round(duration_minutes, 6) AS duration_minutes FROM merged"""

SQL["monthly_event_summary"] = with_(V_MERGED) + """
SELECT year(start)::INT AS year, month(start)::INT AS month, event, count(*) AS union_count,
       round(sum(duration_minutes), 6) AS union_total_minutes
FROM merged GROUP BY 1, 2, 3"""

SQL["event_frequency"] = with_(V_LABELS) + """
SELECT event, n_true, n_rows, round(100.0 * n_true / n_rows, 6) AS pct FROM (
  SELECT 'hot' AS event, sum(event_hot::INT)::BIGINT AS n_true, count(*) AS n_rows FROM labels
  UNION ALL SELECT 'calm', sum(event_calm::INT)::BIGINT, count(*) FROM labels
  UNION ALL SELECT 'gusty', sum(event_gusty::INT)::BIGINT, count(*) FROM labels
  UNION ALL SELECT 'any', sum(has_any_event::INT)::BIGINT, count(*) FROM labels)"""

SQL["event_cooccurrence"] = with_(V_LABELS) + """
SELECT series, count(*) AS n_rows, count(*) FILTER (WHERE event_count >= 1) AS n_any,
       count(*) FILTER (WHERE event_count > 2) AS n_multi, max(event_count) AS max_count
FROM labels GROUP BY series"""

# ---------------------------------------------------------------- reshape
SERIES = ["click", "error", "purchase", "signup", "view"]
WIDE_COLS = [f"{s}_{v}" for s in SERIES for v in ("temp", "peak")]
V_WIDE = V_GRID + """,
wide AS (SELECT ts, """ + ", ".join(
    f"max(CASE WHEN series = '{s}' THEN {v} END) AS {s}_{v}" for s in SERIES for v in ("temp", "peak")
) + " FROM grid GROUP BY ts)"

# rule name -> (SQL predicate over {s}_temp/{s}_peak, steps for the hourly grid)
_GRID_RULES_SQL = {"hot": ("{s}_temp > 60", 2), "calm": ("{s}_temp < 42", 3),
                   "gusty": ("{s}_temp > 40 AND {s}_peak > 100", 1)}


def _dur(mask: str, k: int) -> str:
    fr = f"OVER (ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"(sum(CASE WHEN {mask} THEN 1 ELSE 0 END) {fr} >= {k} AND count(*) {fr} = {k})"


V_UNION_MASK = V_WIDE + """,
umask AS (SELECT ts, """ + ", ".join(
    "(" + " OR ".join(_dur("coalesce(" + p.format(s=s) + ", false)", k) for s in SERIES) + f") AS event_{r}"
    for r, (p, k) in _GRID_RULES_SQL.items()
) + " FROM wide)"

V_RESAMPLED = V_UNION_MASK + """,
wev AS (SELECT w.*, u.event_hot, u.event_calm, u.event_gusty FROM wide w JOIN umask u USING (ts)),
rb AS (SELECT time_bucket(INTERVAL 2 HOUR, ts) AS ts, """ + ", ".join(
    [f"avg({c}) AS {c}" for c in WIDE_COLS] + [f"bool_or(event_{r}) AS event_{r}" for r in _GRID_RULES_SQL]
) + """ FROM wev GROUP BY 1),
bins AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 2 HOUR)) AS ts FROM rb),
resampled AS (SELECT bins.ts, """ + ", ".join(
    [f"rb.{c}" for c in WIDE_COLS] + [f"rb.event_{r}" for r in _GRID_RULES_SQL]) + """
  FROM bins LEFT JOIN rb ON bins.ts = rb.ts),
filled AS (SELECT ts, """ + ", ".join(
    [f"coalesce({c}, last_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
     f"first_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS {c}"
     for c in WIDE_COLS] + [f"coalesce(event_{r}, false) AS event_{r}" for r in _GRID_RULES_SQL]) + """
  FROM resampled)"""

V_AUX = """aux AS (SELECT ts, """ + exact_mean_sql("nv", "u") + """ AS aux_k FROM (
  SELECT date_trunc('hour', ts) AS ts, count(k) AS nv, (sum(k::DECIMAL(38,9)) * 1000000000)::HUGEINT AS u
  FROM (SELECT ts, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) GROUP BY 1))"""

SQL["wide_pivot"] = with_(V_WIDE) + "SELECT * FROM wide"

SQL["duration_mask_union"] = with_(V_UNION_MASK) + "SELECT * FROM umask"

SQL["resample_2h"] = with_(V_RESAMPLED) + "SELECT ts, " + ", ".join(
    WIDE_COLS + [f"event_{r}" for r in _GRID_RULES_SQL]) + " FROM resampled"

SQL["resample_fill"] = with_(V_RESAMPLED) + "SELECT ts, " + ", ".join(
    WIDE_COLS + [f"event_{r}" for r in _GRID_RULES_SQL]) + " FROM filled"

SQL["aux_left_join"] = with_(V_RESAMPLED, V_AUX) + """
SELECT ts, round(coalesce(aux_k,
         last_value(aux_k IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         first_value(aux_k IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
         0.0), 6) AS aux_k, click_temp, event_hot
FROM filled LEFT JOIN aux USING (ts)"""

V_NULLPROF = V_WIDE + """,
nprof AS (""" + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{c.split('_')[0]}' AS tower, "
    f"round(100.0 * avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 2) AS null_pct FROM wide"
    for c in WIDE_COLS) + ")"

SQL["null_profile"] = with_(V_NULLPROF) + "SELECT * FROM nprof"

SQL["null_bands"] = with_(V_NULLPROF) + """
SELECT tower, (floor(null_pct / 10) * 10)::INT AS band_low, (floor(null_pct / 10) * 10)::INT + 10 AS band_high,
       count(*) AS n_columns, array_to_string(list_sort(list("column")), ',') AS columns
FROM nprof WHERE null_pct < 100 GROUP BY 1, 2, 3"""

SQL["keep_columns_below"] = with_(V_NULLPROF) + """
SELECT tower, count(*) AS n_kept, array_to_string(list_sort(list("column")), ',') AS kept_columns
FROM nprof WHERE null_pct < 100 AND (floor(null_pct / 10) + 1) * 10 <= 30 GROUP BY tower"""

SQL["columns_below_threshold"] = with_(V_NULLPROF) + """
SELECT count(*) FILTER (WHERE null_pct = 0) AS n_cols_0,
       count(*) FILTER (WHERE null_pct > 0 AND null_pct <= 20) AS n_cols_0_20,
       count(*) FILTER (WHERE null_pct > 20 AND null_pct <= 50) AS n_cols_20_50,
       count(*) FILTER (WHERE null_pct > 50 AND null_pct <= 80) AS n_cols_50_80,
       count(*) FILTER (WHERE null_pct > 80) AS n_cols_80_100,
       array_to_string(list_sort(list("column") FILTER (WHERE null_pct <= 80)), ',') AS kept_columns
FROM nprof"""

# ---------------------------------------------------------------- features
_W_OBS = "(PARTITION BY series, var ORDER BY ts)"


def _fr(n: int) -> str:
    return f"(PARTITION BY series, var ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SQL["lag_features"] = with_(V_OBS) + "SELECT series, var, ts, value, " + ", ".join(
    f"lag(value, {k}) OVER {_W_OBS} AS value_lag{k}" for k in (1, 2, 4, 8)) + " FROM obs"

_ROLL_FN = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
SQL["rolling_features"] = with_(V_OBS) + "SELECT series, var, ts, " + ", ".join(
    f"round(CASE WHEN count(value) OVER {_fr(n)} = {n} THEN {_ROLL_FN[s]}(value) OVER {_fr(n)} END, 6)"
    f" AS value_roll{n}_{s}" for n in (4, 12) for s in ("mean", "std", "min", "max")) + " FROM obs"

SQL["diff_features"] = with_(V_OBS) + f"""
SELECT series, var, ts, value - lag(value, 1) OVER {_W_OBS} AS value_diff1,
       value - 2.0 * lag(value, 1) OVER {_W_OBS} + lag(value, 2) OVER {_W_OBS} AS value_diff2
FROM obs"""

SQL["future_target"] = with_(V_OBS) + f"""
SELECT series, var, ts, value, round(value_roll4_mean, 6) AS value_roll4_mean, target_h4 FROM (
  SELECT series, var, ts, value,
    lag(value, 1) OVER {_W_OBS} AS l1, lag(value, 2) OVER {_W_OBS} AS l2,
    lag(value, 4) OVER {_W_OBS} AS l4, lag(value, 8) OVER {_W_OBS} AS l8,
    CASE WHEN count(value) OVER {_fr(4)} = 4 THEN avg(value) OVER {_fr(4)} END AS value_roll4_mean,
    lead(CASE WHEN value > 100 THEN 1 ELSE 0 END, 4) OVER {_W_OBS} AS target_h4
  FROM obs)
WHERE l1 IS NOT NULL AND l2 IS NOT NULL AND l4 IS NOT NULL AND l8 IS NOT NULL
  AND value_roll4_mean IS NOT NULL AND target_h4 IS NOT NULL"""

SQL["sequences"] = with_(V_OBS) + f"""
SELECT series, var, ts, l3 AS seq_0, l2 AS seq_1, l1 AS seq_2, value AS seq_3 FROM (
  SELECT series, var, ts, value, lag(value, 1) OVER {_W_OBS} AS l1, lag(value, 2) OVER {_W_OBS} AS l2,
         lag(value, 3) OVER {_W_OBS} AS l3, count(*) OVER {_fr(4)} AS n FROM obs)
WHERE n = 4"""


def _row_stats(var: str) -> str:
    cols = [f"{s}_{var}" for s in SERIES]
    n = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cols)
    tot = "0.0 + " + " + ".join(f"coalesce({c}, 0.0)" for c in cols)
    return f"({n}) AS {var}_n, ({tot}) AS {var}_tot, greatest({', '.join(cols)}) AS {var}_mx, " \
           f"least({', '.join(cols)}) AS {var}_mn"


def _row_stats2(var: str) -> str:
    cols = [f"{s}_{var}" for s in SERIES]
    mean = f"(CASE WHEN {var}_n > 0 THEN {var}_tot / {var}_n END)"
    ss = "0.0 + " + " + ".join(f"coalesce(({c} - {mean}) * ({c} - {mean}), 0.0)" for c in cols)
    out = [f"{mean} AS {var}_tower_mean",
           f"CASE WHEN {var}_n > 1 THEN sqrt(({ss}) / ({var}_n - 1)) END AS {var}_tower_std",
           f"{var}_mx - {var}_mn AS {var}_tower_range"]
    out += [f"{c} - {mean} AS {c}_dev_from_mean" for c in cols]
    return ", ".join(out)


SQL["cross_series_stats"] = with_(V_WIDE) + "SELECT ts, " + _row_stats2("temp") + ", " + _row_stats2("peak") + \
    " FROM (SELECT *, " + _row_stats("temp") + ", " + _row_stats("peak") + " FROM wide)"

SQL["cyclic_time"] = with_(V_WIDE) + "SELECT ts, " + ", ".join(
    f"round({fn}(2 * pi() * {x} / {p}), 6) + 0.0 AS {name}_{fn}"
    for name, x, p in (("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12))
    for fn in ("sin", "cos")) + " FROM wide"

SQL["threshold_distance"] = with_(V_WIDE) + "SELECT ts, " + ", ".join(
    f"round({s}_{var} - {lim}, 6) AS {s}_{var}_{rule}_dist_to_{int(lim)}"
    for s in SERIES for var, rule, lim in (("temp", "hot", 60.0), ("temp", "calm", 42.0), ("peak", "gusty", 100.0))
) + " FROM wide"


def _corr(c: str, e: str) -> str:
    x = f"CASE WHEN {c} IS NOT NULL AND {e} IS NOT NULL THEN {c} END"
    y = f"CASE WHEN {c} IS NOT NULL AND {e} IS NOT NULL THEN {e}::DOUBLE END"
    n, sx, sy = f"count({x})", f"sum({x})", f"sum({y})"
    sxx, syy, sxy = f"sum(({x}) * ({x}))", f"sum(({y}) * ({y}))", f"sum(({x}) * ({y}))"
    vx, vy = f"({n} * {sxx} - {sx} * {sx})", f"({n} * {syy} - {sy} * {sy})"
    return f"round(abs(CASE WHEN {vx} > 0 AND {vy} > 0 THEN ({n} * {sxy} - {sx} * {sy}) / sqrt({vx} * {vy}) END), 6)"


SQL["sensor_event_corr"] = with_(V_RESAMPLED) + "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{r}' AS event, {_corr(c, 'event_' + r)} AS abs_corr FROM wev"
    for c in WIDE_COLS for r in _GRID_RULES_SQL)

SQL["time_slices"] = with_(V_OBS) + """
SELECT least(floor((epoch_us(ts) - epoch_us(t0))::DOUBLE * 8.0 / (epoch_us(t1) - epoch_us(t0))::DOUBLE), 7)::INT AS slice,
       var, round(avg(value), 6) AS mean_value, count(*) AS n_rows, count(*) FILTER (WHERE value > 100) AS n_events
FROM obs, (SELECT min(ts) AS t0, max(ts) AS t1 FROM obs) GROUP BY 1, 2"""

SQL["robust_range"] = with_(V_OBS) + """
SELECT var, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.95), 6) AS q95
FROM obs GROUP BY var"""

SQL["step_minutes"] = with_(V_OBS) + """
SELECT series, coalesce(quantile_cont(gap, 0.5) / 60000000.0::DOUBLE, 15.0::DOUBLE) AS step_minutes FROM (
  SELECT series, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY series ORDER BY ts)) AS gap
  FROM obs) GROUP BY series"""

# ---------------------------------------------------------------- evaluation
V_SCORED = """scored AS (SELECT l_returnflag = 'R' AS label, l_discount * 10 AS score, l_linestatus AS model,
  l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
V_FOLDED = V_SCORED + """,
folded AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
                  count(*) OVER () AS n_rows FROM scored),
folds AS (SELECT *, n_rows // 6 AS t,
  CASE WHEN n_rows // 6 > 0 AND pos >= n_rows - 5 * (n_rows // 6)
       THEN (pos - (n_rows - 5 * (n_rows // 6))) // (n_rows // 6) + 1 END AS test_fold FROM folded),
foldsum AS (SELECT j AS fold,
    count(*) FILTER (WHERE pos < n_rows - (5 - j + 1) * t) AS n_train,
    count(*) FILTER (WHERE pos < n_rows - (5 - j + 1) * t AND label) AS train_positives,
    count(*) FILTER (WHERE test_fold = j) AS n_test,
    count(*) FILTER (WHERE test_fold = j AND label) AS test_positives,
    min(pos) FILTER (WHERE test_fold = j) AS test_start
  FROM folds, range(1, 6) r(j) GROUP BY j)"""

SQL["ts_folds"] = with_(V_FOLDED) + "SELECT fold::INT AS fold, n_train, train_positives, n_test, test_positives, test_start FROM foldsum"

SQL["holdout_split"] = with_(V_FOLDED) + """
SELECT CASE WHEN pos < floor(n_rows * 0.8) THEN 'train' ELSE 'test' END AS split, count(*) AS n_rows,
       count(*) FILTER (WHERE label) AS n_pos, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts
FROM folded GROUP BY 1"""

SQL["class_weights"] = with_(V_FOLDED) + """
SELECT fold::INT AS fold, n_train, train_positives,
  round(CASE WHEN train_positives > 0 THEN n_train::DOUBLE / (2.0 * train_positives::DOUBLE) ELSE 1.0 END, 6) + 0.0 AS w_pos_balanced,
  round(CASE WHEN n_train - train_positives > 0 THEN n_train::DOUBLE / (2.0 * (n_train - train_positives)::DOUBLE) ELSE 1.0 END, 6) + 0.0 AS w_neg_balanced,
  round(CASE WHEN train_positives > 0 THEN pow((n_train - train_positives)::DOUBLE / train_positives::DOUBLE, 0.75) ELSE 1.0 END, 6) + 0.0 AS w_pos_pow75
FROM foldsum"""


def metrics_sql(src: str, keys: str) -> str:
    """Ten metrics from cells tp, fp, fn, tn (same formula order as Spark)."""
    TP, FP, FN, TN = "tp::DOUBLE", "fp::DOUBLE", "fn::DOUBLE", "tn::DOUBLE"
    n = f"({TP} + {FP} + {FN} + {TN})"

    def ratio(a, b):
        return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE 0.0 END)"
    prec, rec, spec = ratio(TP, f"{TP} + {FP}"), ratio(TP, f"{TP} + {FN}"), ratio(TN, f"{TN} + {FP}")
    f1 = ratio(f"2.0 * {prec} * {rec}", f"{prec} + {rec}")
    mcc = ratio(f"{TP} * {TN} - {FP} * {FN}", f"sqrt(({TP} + {FP}) * ({TP} + {FN}) * ({TN} + {FP}) * ({TN} + {FN}))")
    po = ratio(f"{TP} + {TN}", n)
    pe = ratio(f"({TP} + {FP}) * ({TP} + {FN}) + ({FN} + {TN}) * ({FP} + {TN})", f"{n} * {n}")
    kappa = ratio(f"{po} - {pe}", f"1.0 - {pe}")
    return (f"SELECT {keys}, tp, fp, fn, tn, {n}::BIGINT AS n_samples, {ratio(f'{TP} + {FN}', n)} AS event_rate, "
            f"{po} AS accuracy, ({rec} + {spec}) / 2.0 AS balanced_accuracy, {prec} AS precision, {rec} AS recall, "
            f"{f1} AS f1, {spec} AS specificity, {mcc} AS mcc, {kappa} AS kappa FROM {src}")


SQL["confusion_metrics"] = with_(V_SCORED, """cells AS (SELECT model,
    count(*) FILTER (WHERE label AND score >= 0.5::DOUBLE) AS tp, count(*) FILTER (WHERE NOT label AND score >= 0.5::DOUBLE) AS fp,
    count(*) FILTER (WHERE label AND NOT score >= 0.5::DOUBLE) AS fn, count(*) FILTER (WHERE NOT label AND NOT score >= 0.5::DOUBLE) AS tn
  FROM scored GROUP BY model)""", "m AS (" + metrics_sql("cells", "model") + ")") + """
SELECT *, CASE WHEN tn + fp <> 0 THEN 100.0 * tn::DOUBLE / (tn::DOUBLE + fp::DOUBLE) ELSE 0.0 END AS tn_pct,
  CASE WHEN tn + fp <> 0 THEN 100.0 * fp::DOUBLE / (tn::DOUBLE + fp::DOUBLE) ELSE 0.0 END AS fp_pct,
  CASE WHEN fn + tp <> 0 THEN 100.0 * fn::DOUBLE / (fn::DOUBLE + tp::DOUBLE) ELSE 0.0 END AS fn_pct,
  CASE WHEN fn + tp <> 0 THEN 100.0 * tp::DOUBLE / (fn::DOUBLE + tp::DOUBLE) ELSE 0.0 END AS tp_pct
FROM m"""

V_SCORETAB = V_SCORED + """,
sv AS (SELECT model, score, count(*) AS n, sum(label::INT) AS ps FROM scored GROUP BY 1, 2),
stab AS (SELECT model, score, n, ps,
   coalesce(sum(n) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_lt,
   coalesce(sum(ps) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ps_lt,
   sum(n) OVER (PARTITION BY model) AS n_tot, sum(ps) OVER (PARTITION BY model) AS p_tot FROM sv)"""

SQL["roc_auc"] = with_(V_SCORETAB) + """
SELECT model, round((sum(ps * (n_lt + (n + 1.0) / 2.0)) - max(p_tot) * (max(p_tot) + 1.0) / 2.0)
                    / (max(p_tot) * (max(n_tot) - max(p_tot))), 6) + 0.0 AS roc_auc
FROM stab GROUP BY model"""

SQL["average_precision"] = with_(V_SCORETAB) + """
SELECT model, round(sum((ps::DOUBLE / p_tot) * ((p_tot - ps_lt)::DOUBLE / (n_tot - n_lt))), 6) + 0.0 AS average_precision
FROM stab GROUP BY model"""

SQL["best_threshold_f1"] = with_(V_SCORETAB) + """,
f AS (SELECT model, score AS threshold, (p_tot - ps_lt) AS tp, (n_tot - n_lt) - (p_tot - ps_lt) AS fp,
        p_tot - (p_tot - ps_lt) AS fn, n_tot - (n_tot - n_lt) - (p_tot - (p_tot - ps_lt)) AS tn,
        CASE WHEN n_tot - n_lt <> 0 THEN (p_tot - ps_lt)::DOUBLE / (n_tot - n_lt) ELSE 0.0 END AS p,
        CASE WHEN p_tot > 0 THEN (p_tot - ps_lt)::DOUBLE / p_tot ELSE 1.0 END AS r FROM stab),
g AS (SELECT *, 2.0 * p * r / (p + r + 1e-10) AS f1 FROM f),
b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold ASC) AS rn FROM g)
SELECT model, threshold, round(f1, 6) + 0.0 AS f1, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn
FROM b WHERE rn = 1"""

_F2 = [0.1 + i * 0.05 for i in range(10)]
SQL["best_threshold_f2"] = with_(V_SCORED, "grid AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(_F2)) + ") g(i, t))", """c AS (
  SELECT model, i, t, count(*) FILTER (WHERE label AND score >= t)::DOUBLE AS tp,
         count(*) FILTER (WHERE NOT label AND score >= t)::DOUBLE AS fp,
         count(*) FILTER (WHERE label AND NOT score >= t)::DOUBLE AS fn
  FROM scored, grid GROUP BY model, i, t)""", """fb AS (SELECT model, i, t,
  CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END AS r FROM c)""",
    """s AS (SELECT model, i, t, CASE WHEN 4.0 * p + r <> 0 THEN (1.0 + 4.0) * p * r / (4.0 * p + r) ELSE 0.0 END AS f FROM fb)""",
    "b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f DESC, i ASC) AS rn FROM s)") + """
SELECT model, CASE WHEN f > 0 THEN t ELSE 0.3 END AS threshold, round(greatest(f, 0.0), 6) + 0.0 AS fbeta FROM b WHERE rn = 1"""

# ---------------------------------------------------------------- reports
HORIZONS = ["1hr", "3hr", "6hr", "12hr", "24hr", "48hr", "96hr"]
_HARR = "[" + ", ".join(f"'{h}'" for h in HORIZONS) + "]"
_METRICS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "specificity", "mcc", "kappa", "auc_roc"]
_CELLS = {"tp": "true_positives", "tn": "true_negatives", "fp": "false_positives", "fn": "false_negatives"}
_MLIST = ", ".join(f"'{m}'" for m in _METRICS)
_CLIST = ", ".join(f"'{m}'" for m in _CELLS.values())


def R(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


V_RESULTS = with_(f"""rcells AS (SELECT {_HARR}[l_linenumber] AS horizon, 'event_' || l_returnflag AS event,
    CASE WHEN l_linestatus = 'F' THEN 'lightgbm' ELSE 'xgboost' END AS model,
    CASE WHEN l_orderkey % 2 = 0 THEN 'cv' ELSE 'test' END AS split,
    count(*) FILTER (WHERE l_quantity > 25 AND l_extendedprice > 40000) AS tp,
    count(*) FILTER (WHERE NOT l_quantity > 25 AND l_extendedprice > 40000) AS fp,
    count(*) FILTER (WHERE l_quantity > 25 AND NOT l_extendedprice > 40000) AS fn,
    count(*) FILTER (WHERE NOT l_quantity > 25 AND NOT l_extendedprice > 40000) AS tn
  FROM lineitem GROUP BY 1, 2, 3, 4)""", "results AS (" + metrics_sql("rcells", "horizon, event, model, split") + ")",
    """rr AS (SELECT *, balanced_accuracy AS auc_roc,
    CASE WHEN fp::DOUBLE + tn::DOUBLE <> 0 THEN fp::DOUBLE / (fp::DOUBLE + tn::DOUBLE) ELSE 0.0 END AS fpr,
    CASE WHEN fn::DOUBLE + tp::DOUBLE <> 0 THEN fn::DOUBLE / (fn::DOUBLE + tp::DOUBLE) ELSE 0.0 END AS fnr FROM results)""",
    "rlong AS (SELECT * FROM (UNPIVOT (SELECT horizon, event, model, split, " + ", ".join(_METRICS) + ", " +
    ", ".join(f"{c}::DOUBLE AS {n}" for c, n in _CELLS.items()) + " FROM rr) ON " + ", ".join(_METRICS + list(_CELLS.values())) +
    " INTO NAME metric VALUE value))",
    f"""summ AS (SELECT horizon, event, model, metric, avg(value) AS mean,
    CASE WHEN metric IN ({_CLIST}) THEN NULL ELSE stddev_pop(value) END AS std, count(*) AS n_folds
  FROM rlong GROUP BY 1, 2, 3, 4)""",
    f"means AS (SELECT * FROM summ WHERE metric IN ({_MLIST}))",
    """ht AS (SELECT horizon, event, model,
    max(auc_roc) FILTER (WHERE split = 'cv') AS cv_auc, max(f1) FILTER (WHERE split = 'cv') AS cv_f1,
    max(mcc) FILTER (WHERE split = 'cv') AS cv_mcc, max(auc_roc) FILTER (WHERE split = 'test') AS test_auc,
    max(f1) FILTER (WHERE split = 'test') AS test_f1, max(mcc) FILTER (WHERE split = 'test') AS test_mcc,
    max(precision) FILTER (WHERE split = 'test') AS precision, max(recall) FILTER (WHERE split = 'test') AS recall,
    max(fpr) FILTER (WHERE split = 'test') AS fpr, max(fnr) FILTER (WHERE split = 'test') AS fnr
  FROM rr GROUP BY 1, 2, 3)""",
    f"""hs AS (SELECT horizon, avg(test_auc) AS auc_mean, stddev_samp(test_auc) AS auc_std,
    avg(test_f1) AS f1_mean, stddev_samp(test_f1) AS f1_std, avg(test_mcc) AS mcc_mean, stddev_samp(test_mcc) AS mcc_std,
    list_position({_HARR}, horizon)::INT AS horizon_order FROM ht GROUP BY horizon)""")

SQL["fold_summary"] = V_RESULTS + f"SELECT horizon, event, model, metric, {R('mean', 'mean')}, {R('std', 'std')}, n_folds FROM summ"


def _best_by(group: str, label: str) -> str:
    return V_RESULTS + f"""
SELECT b.{group}, b.model, b.metric, {R('b.mean', 'best_value')}, b.{label} AS best_{label},
       {R('s.avg_value', 'avg_value')}, {R('s.std_value', 'std_value')}, s.n_{label},
       t.total_samples, {R('t.avg_event_rate', 'avg_event_rate')}
FROM (SELECT *, row_number() OVER (PARTITION BY {group}, model, metric ORDER BY mean DESC, {label} ASC) AS rn FROM means) b
JOIN (SELECT {group}, model, metric, avg(mean) AS avg_value, stddev_samp(mean) AS std_value,
             count(DISTINCT {label}) AS n_{label} FROM means GROUP BY 1, 2, 3) s USING ({group}, model, metric)
JOIN (SELECT {group}, sum(n_samples)::BIGINT AS total_samples, avg(event_rate) AS avg_event_rate FROM results GROUP BY 1) t
  USING ({group})
WHERE rn = 1"""


SQL["best_by_event"] = _best_by("event", "horizon")
SQL["best_by_series"] = _best_by("horizon", "event")

SQL["best_model_per_pair"] = V_RESULTS + f"""
SELECT horizon, event, {R('a', 'lightgbm_auc_roc')}, {R('b', 'xgboost_auc_roc')},
       CASE WHEN a >= b THEN 'lightgbm' ELSE 'xgboost' END AS best_model, {R('greatest(a, b)', 'best_value')}
FROM (SELECT horizon, event, coalesce(max(mean) FILTER (WHERE model = 'lightgbm'), 0.0) AS a,
             coalesce(max(mean) FILTER (WHERE model = 'xgboost'), 0.0) AS b
      FROM means WHERE metric = 'auc_roc' GROUP BY 1, 2)"""

SQL["rank_experiments"] = V_RESULTS + f"""
SELECT model, horizon, event, {R('mean', 'value')},
       (row_number() OVER (PARTITION BY model ORDER BY mean DESC, horizon ASC, event ASC))::INTEGER AS rank
FROM means WHERE metric = 'auc_roc'"""

SQL["overall_stats"] = V_RESULTS + f"""
SELECT model, metric, {R('avg(mean)', 'mean')}, {R('stddev_samp(mean)', 'std')}, {R('min(mean)', 'min')},
       {R('max(mean)', 'max')} FROM means GROUP BY 1, 2"""

SQL["search_summary"] = V_RESULTS + f"""
SELECT event, {R('avg(best)', 'mean')}, {R('stddev_samp(best)', 'std')}, {R('max(best)', 'max')}, count(*) AS n_experiments
FROM (SELECT horizon, event, max(mean) AS best FROM means WHERE metric = 'mcc' GROUP BY 1, 2) GROUP BY event"""

SQL["horizon_stats"] = V_RESULTS + "SELECT horizon, " + ", ".join(
    R(f"{m}_{n}", f"{m}_{n}") for m in ("auc", "f1", "mcc") for n in ("mean", "std")) + ", horizon_order FROM hs"

SQL["degradation"] = V_RESULTS + "SELECT h.horizon, h.horizon_order, " + ", ".join(
    R(f"CASE WHEN b.{m}_mean <> 0 THEN (b.{m}_mean - h.{m}_mean) / b.{m}_mean * 100.0 END", f"{m}_drop_pct")
    for m in ("auc", "f1", "mcc")) + " FROM hs h, (SELECT * FROM hs WHERE horizon = '1hr') b"

SQL["overfit_gap"] = V_RESULTS + """, gaps AS (SELECT horizon, model, cv_auc - test_auc AS auc_gap,
    cv_f1 - test_f1 AS f1_gap, cv_mcc - test_mcc AS mcc_gap FROM ht)
SELECT CASE WHEN horizon IS NOT NULL THEN 'horizon' ELSE 'model' END AS level, horizon, model, """ + ", ".join(
    R(f"{f}({m}_gap)", f"{m}_gap_{n}") for m in ("auc", "f1", "mcc") for n, f in (("mean", "avg"), ("std", "stddev_samp"))
) + " FROM gaps GROUP BY GROUPING SETS ((horizon), (model))"

SQL["error_profile"] = V_RESULTS + """
SELECT CASE WHEN horizon IS NOT NULL THEN 'horizon' ELSE 'event' END AS level, horizon, event, """ + ", ".join([
    R("avg(fpr)", "fpr_mean"), R("CASE WHEN horizon IS NOT NULL THEN stddev_samp(fpr) END", "fpr_std"),
    R("avg(fnr)", "fnr_mean"), R("CASE WHEN horizon IS NOT NULL THEN stddev_samp(fnr) END", "fnr_std"),
    R("CASE WHEN horizon IS NOT NULL AND avg(fnr) > 0 THEN avg(fpr) / avg(fnr) END", "fpr_fnr_ratio"),
    R("CASE WHEN horizon IS NULL THEN avg(precision) END", "precision_mean"),
    R("CASE WHEN horizon IS NULL THEN avg(recall) END", "recall_mean")]) + \
    " FROM ht GROUP BY GROUPING SETS ((horizon), (event))"

SQL["pr_balance"] = V_RESULTS + f"""
SELECT horizon, {R('p', 'precision_mean')}, {R('r', 'recall_mean')}, {R('f', 'f1_mean')}, {R('abs(p - r)', 'balance')},
       abs(p - r) < 0.1 AS balanced
FROM (SELECT horizon, avg(precision) AS p, avg(recall) AS r, avg(test_f1) AS f FROM ht GROUP BY horizon)"""

SQL["horizon_gate"] = V_RESULTS + f""", g AS (SELECT *, auc_mean > 0.90 AND f1_mean > 0.50 AND mcc_mean > 0.50 AS passes FROM hs)
SELECT horizon, horizon_order, {R('auc_mean', 'auc_mean')}, {R('f1_mean', 'f1_mean')}, {R('mcc_mean', 'mcc_mean')}, passes,
       (SELECT arg_max(horizon, horizon_order) FROM g WHERE passes) AS cutoff FROM g"""

SQL["reliability"] = V_RESULTS + f""", e AS (SELECT event, avg(test_f1) AS avg_f1, avg(test_auc) AS avg_auc FROM ht GROUP BY event),
m AS (SELECT avg(test_f1) FILTER (WHERE model = 'lightgbm') AS a, avg(test_f1) FILTER (WHERE model = 'xgboost') AS b FROM ht)
SELECT event, {R('avg_f1', 'avg_f1')}, {R('avg_auc', 'avg_auc')},
  CASE WHEN avg_f1 > 0.7 THEN 'EXCELLENT' WHEN avg_f1 > 0.5 THEN 'GOOD' WHEN avg_f1 > 0.3 THEN 'MODERATE' ELSE 'POOR' END AS reliability,
  (row_number() OVER (ORDER BY avg_f1 DESC, event ASC))::INTEGER AS f1_rank,
  {R('CASE WHEN b <> 0 THEN (a - b) / b * 100.0 END', 'lightgbm_f1_advantage_pct')}
FROM e, m"""

SQL["score_matrix"] = V_RESULTS + "SELECT model, event, " + ", ".join(
    R(f"avg(test_f1) FILTER (WHERE horizon = '{h}')", f"f1_{h}") for h in HORIZONS) + " FROM ht GROUP BY 1, 2"


def _t_p_sql(t: str, df: str) -> str:
    """Two-sided Student-t p-value by the same finite series as the engine."""
    th = f"atan(abs({t}) / sqrt({df}::DOUBLE))"
    c2 = f"(cos({th}) * cos({th}))"
    even_terms = (f"list_transform(range(0, (({df}) - 2) // 2 + 1), lambda k: "
                  f"exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4.0)) * pow({c2}, k))")
    odd_terms = (f"list_transform(range(0, (({df}) - 3) // 2 + 1), lambda k: "
                 f"exp(2 * k * ln(2.0) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * pow({c2}, k))")
    even = f"sin({th}) * list_sum({even_terms})"
    odd = f"2.0 / pi() * ({th} + sin({th}) * cos({th}) * coalesce(list_sum({odd_terms}), 0.0))"
    return f"(1.0 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


SQL["paired_t"] = V_RESULTS + """, pairs AS (
  SELECT horizon, event,
    max(test_auc) FILTER (WHERE model = 'lightgbm') AS a_auc, max(test_auc) FILTER (WHERE model = 'xgboost') AS b_auc,
    max(test_f1) FILTER (WHERE model = 'lightgbm') AS a_f1, max(test_f1) FILTER (WHERE model = 'xgboost') AS b_f1,
    max(test_mcc) FILTER (WHERE model = 'lightgbm') AS a_mcc, max(test_mcc) FILTER (WHERE model = 'xgboost') AS b_mcc
  FROM ht GROUP BY 1, 2
  HAVING count(*) FILTER (WHERE model = 'lightgbm') = 1 AND count(*) FILTER (WHERE model = 'xgboost') = 1),
lp AS (SELECT 'test_auc' AS metric, a_auc AS a, b_auc AS b FROM pairs UNION ALL SELECT 'test_f1', a_f1, b_f1 FROM pairs
       UNION ALL SELECT 'test_mcc', a_mcc, b_mcc FROM pairs),
g AS (SELECT metric, count(*) AS n_pairs, avg(a) AS am, avg(b) AS bm, avg(a - b) AS mean_diff, stddev_samp(a - b) AS sd
      FROM lp GROUP BY metric HAVING count(*) > 1),
t AS (SELECT *, CASE WHEN sd > 0 THEN mean_diff / (sd / sqrt(n_pairs::DOUBLE)) END AS t_stat FROM g),
p AS (SELECT *, """ + _t_p_sql("t_stat", "(n_pairs - 1)") + """ AS p_value FROM t)
SELECT metric, n_pairs, """ + ", ".join([R("am", "lightgbm_mean"), R("bm", "xgboost_mean"), R("mean_diff", "mean_diff"),
                                         R("t_stat", "t_stat"), R("p_value", "p_value")]) + """,
  CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*' ELSE 'ns' END AS significance
FROM p"""

# ---------------------------------------------------------------- importance / stations / raster
import math as _m  # noqa: E402

V_IMP = """imp AS (SELECT replace(p_name, ' ', '_') || '_' || lpad(p_size::VARCHAR, 3, '0') || 'm' ||
   CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN '_lag' || ((p_size % 24) + 1)::VARCHAR
        ELSE '_roll' || ((p_size % 24) + 1)::VARCHAR || '_mean' END AS feature,
   p_brand AS tower, p_type AS event, p_retailprice AS importance FROM part)"""

V_RANKED = V_IMP + """,
ranked AS (SELECT *, row_number() OVER (PARTITION BY tower, event ORDER BY importance DESC, feature ASC) AS rank,
   100.0 * importance / sum(importance) OVER (PARTITION BY tower, event) AS importance_pct FROM imp)"""

V_FILES = V_RANKED + """,
files AS (SELECT feature, tower, event, importance, rank, importance_pct FROM ranked)"""

SQL["global_importance"] = with_(V_FILES) + f"""
SELECT feature, {R('avg(importance_pct)', 'mean')}, {R('stddev_samp(importance_pct)', 'std')}, {R('min(importance_pct)', 'min')},
       {R('max(importance_pct)', 'max')}, count(*) AS count FROM files GROUP BY feature"""

SQL["importance_by_event"] = with_(V_FILES) + f"""
SELECT event, feature, {R('mean_importance', 'mean_importance')}, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event ORDER BY mean_importance DESC, feature ASC) AS rank
  FROM (SELECT event, feature, avg(importance_pct) AS mean_importance FROM files GROUP BY 1, 2)) WHERE rank <= 10"""

SQL["category_importance"] = with_(V_FILES, """c AS (SELECT *, regexp_split_to_array(feature, '_[0-9]+m|_lag|_roll')[1] AS category FROM files)""",
                                   """tot AS (SELECT category, sum(importance_pct) AS total_importance, avg(importance_pct) AS mean_importance,
     stddev_samp(importance_pct) AS std_importance, count(*) AS n_features FROM c GROUP BY 1)""",
                                   """rk AS (SELECT *, row_number() OVER (ORDER BY total_importance DESC, category ASC) AS category_rank FROM tot)""") + f"""
SELECT x.category, x.event, {R('x.cell_importance', 'cell_importance')}, {R('rk.total_importance', 'total_importance')},
       {R('rk.mean_importance', 'mean_importance')}, {R('rk.std_importance', 'std_importance')}, rk.n_features, rk.category_rank::INTEGER AS category_rank
FROM (SELECT category, event, sum(importance_pct) AS cell_importance FROM c GROUP BY 1, 2) x
JOIN rk ON x.category = rk.category WHERE rk.category_rank <= 15"""

SQL["family_share"] = with_(V_FILES) + f"""
SELECT CASE WHEN contains(lower(feature), 'lag') THEN 'Lag Features' WHEN contains(lower(feature), 'roll') THEN 'Rolling Statistics'
            ELSE 'Raw Features' END AS family,
       {R('avg(importance_pct)', 'mean_importance')}, {R('sum(importance_pct)', 'sum_importance')}, count(*) AS n_features
FROM files GROUP BY 1"""

_EVENTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
_cells = [f"coalesce(avg(importance_pct) FILTER (WHERE event = '{e}'), 0.0)" for e in _EVENTS]
SQL["importance_matrix"] = with_(V_FILES) + "SELECT feature, " + ", ".join(f"imp_{e}" for e in _EVENTS) + \
    ", row_mean, (row_number() OVER (ORDER BY row_mean_raw DESC, feature ASC))::INTEGER AS row_rank " \
    "FROM (SELECT feature, " + ", ".join(R(c, f"imp_{e}") for c, e in zip(_cells, _EVENTS)) + \
    ", " + R("(" + " + ".join(_cells) + f") / {float(len(_EVENTS))}", "row_mean") + \
    ", (" + " + ".join(_cells) + f") / {float(len(_EVENTS))} AS row_mean_raw FROM files GROUP BY feature)"

SQL["rank_features"] = with_(V_FILES) + f"""
SELECT feature, tower, event, {R('importance', 'importance')}, rank::INTEGER AS rank, {R('importance_pct', 'importance_pct')} FROM files WHERE rank <= 20"""

SQL["box_stats"] = with_(V_FILES, """q AS (SELECT event, quantile_cont(importance_pct, 0.25) AS q1, quantile_cont(importance_pct, 0.5) AS median,
   quantile_cont(importance_pct, 0.75) AS q3 FROM files GROUP BY event)""") + f"""
SELECT i.event, {R('q.q1', 'q1')}, {R('q.median', 'median')}, {R('q.q3', 'q3')}, {R('q.q3 - q.q1', 'iqr')},
  {R('min(importance_pct) FILTER (WHERE importance_pct >= q.q1 - 1.5 * (q.q3 - q.q1))', 'whisker_low')},
  {R('max(importance_pct) FILTER (WHERE importance_pct <= q.q3 + 1.5 * (q.q3 - q.q1))', 'whisker_high')},
  count(*) FILTER (WHERE importance_pct < q.q1 - 1.5 * (q.q3 - q.q1) OR importance_pct > q.q3 + 1.5 * (q.q3 - q.q1)) AS n_outliers,
  count(*) AS n
FROM files i JOIN q ON i.event = q.event GROUP BY i.event, q.q1, q.median, q.q3"""

SQL["series_importance"] = with_(V_FILES) + f"""
SELECT tower, {R('sum(importance_pct)', 'total_importance')}, count(*) AS n_features FROM files GROUP BY tower"""


def _utm_sql(east: str, north: str, zone: int = 16) -> tuple[str, str]:
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e = _m.sqrt(2 * f - f ** 2)
    e2 = e ** 2
    ep2 = e2 / (1 - e2)
    lon0 = (zone - 1) * 6 - 180 + 3

    def L(v):
        return f"{float(v)!r}::DOUBLE"
    x = f"({east} - {L(500000.0)})"
    y = f"({north})"
    mu = f"(({y} / {L(k0)}) / {L(a * (1 - e2 / 4 - 3 * e ** 4 / 64 - 5 * e ** 6 / 256))})"
    e1 = (1 - _m.sqrt(1 - e2)) / (1 + _m.sqrt(1 - e2))
    phi = (f"({mu} + {L(3 * e1 / 2 - 27 * e1 ** 3 / 32)} * sin({L(2.0)} * {mu}) + {L(21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32)}"
           f" * sin({L(4.0)} * {mu}) + {L(151 * e1 ** 3 / 96)} * sin({L(6.0)} * {mu}))")
    s = f"sin({phi})"
    n1 = f"({L(a)} / sqrt({L(1.0)} - {L(e2)} * {s} * {s}))"
    t1 = f"(tan({phi}) * tan({phi}))"
    c1 = f"({L(ep2)} * cos({phi}) * cos({phi}))"
    r1 = f"({L(a * (1 - e2))} / pow({L(1.0)} - {L(e2)} * {s} * {s}, {L(1.5)}))"
    d = f"({x} / ({n1} * {L(k0)}))"
    lat = (f"({phi} - ({n1} * tan({phi}) / {r1}) * ({d} * {d} / 2 - ({L(5.0)} + 3 * {t1} + 10 * {c1} - 4 * {c1} * {c1}"
           f" - {L(9 * ep2)}) * pow({d}, 4) / 24 + ({L(61.0)} + 90 * {t1} + 298 * {c1} + 45 * {t1} * {t1} - {L(252 * ep2)}"
           f" - 3 * {c1} * {c1}) * pow({d}, 6) / 720))")
    lon = (f"({L(lon0)} + degrees(({d} - ({L(1.0)} + 2 * {t1} + {c1}) * pow({d}, 3) / 6 + ({L(5.0)} - 2 * {c1} + 28 * {t1}"
           f" - 3 * {c1} * {c1} + {L(8 * ep2)} + 24 * {t1} * {t1}) * pow({d}, 5) / 120) / cos({phi})))")
    return f"degrees({lat})", lon


_LAT, _LON = _utm_sql("easting", "northing")
V_STATION0 = f"""station AS (SELECT 'Brand#' || s_suppkey::VARCHAR AS tower, s_suppkey, 740000.0::DOUBLE + 100.0::DOUBLE * s_suppkey AS easting,
   3978000.0::DOUBLE + 300.0::DOUBLE * s_nationkey AS northing, 250.0::DOUBLE + (s_acctbal + 1000.0::DOUBLE) / 100.0::DOUBLE AS elevation_m,
   10.0::DOUBLE * ((s_nationkey % 4) + 1) AS height_m, r_name AS region
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
st0 AS (SELECT *, {_LAT} AS lat, {_LON} AS lon FROM station)"""

# fixed tables of the derived attributes, as VALUES
_TERRAIN_SQL = """
bands(start, over, under, inside, outside) AS (VALUES (0.0, NULL, 3, 'Valley Floor', 'Valley Slope'),
  (0.25, NULL, 4, 'Valley Floor', 'Valley Slope'), (0.5, 5, NULL, 'Ridge Slope', 'Valley Slope'), (0.75, NULL, 4, 'Ridge Top', 'Ridge Slope')),
facts(terrain, ridge, least, most) AS (VALUES ('Valley Floor', 1.2, 5, 20), ('Valley Slope', 0.8, 20, 40), ('Ridge Slope', 0.5, 35, 55),
  ('Ridge Top', 0.0, 50, 70), ('Unknown', 1.2, 25, 35), ('Flat', 1.2, 10, 30)),
soils(terrain, over, under, inside, outside) AS (VALUES ('Valley Floor', 0, 2, 'Clay', 'Clay Loam'), ('Flat', 0, 2, 'Clay', 'Clay Loam'),
  ('Valley Slope', 5, NULL, 'Loam', 'Silt Loam'), ('Ridge Slope', 6, NULL, 'Sandy Loam', 'Silt Loam'), ('Ridge Top', NULL, NULL, 'Rocky Loam', 'Rocky Loam')),
uses(over, slopes, elsewhere) AS (VALUES (50, 'Deciduous Forest', 'Deciduous Forest'), (35, 'Mixed Forest', 'Mixed Forest'),
  (20, 'Shrubland', 'Grassland'), (10, 'Grassland', 'Grassland'), (-1, 'Open Field', 'Open Field'))"""


def _stations_sql(name: str, source: str) -> str:
    """``name``: the stations of ``source`` with what lacks filled in and all derived attributes."""
    between = "coalesce(s.slope_deg > {t}.over, true) AND coalesce(s.slope_deg < {t}.under, true)"
    return f"""
{name}_all AS (SELECT floor(avg(elevation_m)) AS emean, min(elevation_m) AS emin, max(elevation_m) AS emax, avg(lat) AS clat, avg(lon) AS clon
  FROM {source}),
{name}_1 AS (SELECT s.* REPLACE (coalesce(elevation_m, emean) AS elevation_m), emin, emax, clat, clon FROM {source} s, {name}_all),
{name}_2 AS (SELECT *, CASE WHEN emax > emin THEN (elevation_m - emin) / (emax - emin) END AS rel_elev FROM {name}_1),
{name}_3 AS (SELECT * REPLACE (coalesce(slope_deg, round_even(1.0::DOUBLE + coalesce(rel_elev, 0.5::DOUBLE) * 7.0::DOUBLE, 1)) AS slope_deg,
    coalesce(aspect_deg, trunc((((degrees(atan2(lon - clon, lat - clat)) + 180.0::DOUBLE) % 360.0::DOUBLE) + 360.0::DOUBLE) % 360.0::DOUBLE)::INT)
      AS aspect_deg) FROM {name}_2),
{name}_4 AS (SELECT s.*, CASE WHEN s.rel_elev IS NULL THEN 'Flat' WHEN {between.format(t="b")} THEN b.inside ELSE b.outside END AS terrain_type
  FROM {name}_3 s ASOF LEFT JOIN bands b ON s.rel_elev >= b.start),
{name}_5 AS (SELECT s.*, trunc(f.least + coalesce(s.rel_elev, 0.5) * (f.most - f.least))::INT AS canopy_cover_pct,
    trunc((s.emax - s.elevation_m) * 10.0 * f.ridge)::INT AS dist_to_ridge_m,
    CASE WHEN {between.format(t="o")} THEN o.inside ELSE o.outside END AS soil_type
  FROM {name}_4 s JOIN facts f ON f.terrain = s.terrain_type JOIN soils o ON o.terrain = s.terrain_type),
{name} AS (SELECT s.*, CASE WHEN s.terrain_type LIKE '%Slope' THEN u.slopes ELSE u.elsewhere END AS land_use,
    sqrt(pow((lat - clat) * 111.0::DOUBLE, 2) + pow((lon - clon) * 111.0::DOUBLE * cos(radians(lat)), 2)) AS dist_from_center_km,
    elevation_m + height_m AS total_height_m
  FROM {name}_5 s ASOF JOIN uses u ON s.canopy_cover_pct > u.over)"""


V_STATION = ",".join([V_STATION0, _TERRAIN_SQL, """
bare AS (SELECT * EXCLUDE (s_suppkey), NULL::DOUBLE AS slope_deg, NULL::INT AS aspect_deg FROM st0)""", _stations_sql("stations", "bare")])

SQL["utm_to_latlon"] = with_(V_STATION) + f"SELECT tower, {R('lat', 'lat')}, {R('lon', 'lon')} FROM stations"
SQL["terrain_class"] = with_(V_STATION) + f"""
SELECT tower, {R('elevation_m', 'elevation_m')}, {R('rel_elev', 'rel_elev')}, {R('slope_deg', 'slope_deg')}, terrain_type FROM stations"""
SQL["station_attributes"] = with_(V_STATION) + f"""
SELECT tower, aspect_deg, dist_to_ridge_m, canopy_cover_pct, soil_type, land_use, {R('dist_from_center_km', 'dist_from_center_km')},
       {R('total_height_m', 'total_height_m')} FROM stations"""

V_PROFILE = V_RANKED + ",\n" + V_STATION + """,
top AS (SELECT tower, event, round(sum(importance_pct), 9) AS top5_importance, arg_min(feature, rank) AS top1_feature,
   arg_min(importance_pct, rank) AS top1_importance FROM ranked WHERE rank <= 5 GROUP BY 1, 2),
profile AS (SELECT t.event, t.tower, t.top5_importance, t.top1_feature, t.top1_importance, s.elevation_m, s.height_m,
   s.total_height_m, s.slope_deg, s.canopy_cover_pct, s.terrain_type, s.dist_from_center_km, s.lat, s.lon
   FROM top t JOIN stations s ON t.tower = s.tower)"""

SQL["station_profile"] = with_(V_PROFILE) + "SELECT event, tower, " + ", ".join(
    [R("top5_importance", "top5_importance"), "top1_feature", R("top1_importance", "top1_importance"),
     R("elevation_m", "elevation_m"), R("height_m", "height_m"), R("total_height_m", "total_height_m"),
     R("slope_deg", "slope_deg"), "canopy_cover_pct", "terrain_type", R("dist_from_center_km", "dist_from_center_km"),
     R("lat", "lat"), R("lon", "lon")]) + " FROM profile"


def _spearman(geo: str) -> str:
    rx = f"(SELECT event, {geo} AS v, count(*) OVER (PARTITION BY event ORDER BY {geo} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY event, {geo}) - 1) / 2.0 AS rx FROM profile)"
    return f"""SELECT event, '{geo}' AS variable, n, r AS spearman_r,
  CASE WHEN abs(r) < 1 THEN {_t_p_sql('r * sqrt((n - 2)::DOUBLE / (1.0 - r * r))', '(n - 2)')} WHEN r IS NOT NULL THEN 0.0 END AS p_value FROM (
  SELECT event, count(*) AS n, CASE WHEN count(*) * sum(rx * rx) - sum(rx) * sum(rx) > 0 AND count(*) * sum(ry * ry) - sum(ry) * sum(ry) > 0
     THEN (count(*) * sum(rx * ry) - sum(rx) * sum(ry)) / sqrt((count(*) * sum(rx * rx) - sum(rx) * sum(rx)) * (count(*) * sum(ry * ry) - sum(ry) * sum(ry))) END AS r
  FROM (SELECT p.event, (SELECT DISTINCT rx FROM {rx} q WHERE q.event = p.event AND q.v = p.{geo}) AS rx,
               (SELECT DISTINCT rx FROM (SELECT event, top5_importance AS v, count(*) OVER (PARTITION BY event ORDER BY top5_importance RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY event, top5_importance) - 1) / 2.0 AS rx FROM profile) q WHERE q.event = p.event AND q.v = p.top5_importance) AS ry
        FROM profile p) GROUP BY event HAVING count(*) >= 3)"""


SQL["spearman_geo"] = with_(V_PROFILE) + "SELECT event, variable, n, " + R("spearman_r", "spearman_r") + ", " + \
    R("p_value", "p_value") + """, CASE WHEN p_value < 0.001 THEN '***' WHEN p_value < 0.01 THEN '**' WHEN p_value < 0.05 THEN '*'
    ELSE 'ns' END AS significance FROM (""" + _spearman("elevation_m") + " UNION ALL " + _spearman("total_height_m") + ")"

SQL["linear_trend"] = with_(V_PROFILE) + f"""
SELECT event, {R('regr_slope(top5_importance, elevation_m)', 'slope')}, {R('regr_intercept(top5_importance, elevation_m)', 'intercept')},
       regr_count(top5_importance, elevation_m)::BIGINT AS n FROM profile GROUP BY event"""

SQL["terrain_group"] = with_(V_PROFILE) + f"""
SELECT terrain_type, {R('avg(top5_importance)', 'mean_top5')}, count(*) AS n,
       list_position(['Valley Floor', 'Valley Slope', 'Ridge Slope', 'Ridge Top'], terrain_type)::INT AS terrain_order
FROM profile GROUP BY terrain_type"""

SQL["spatial_extent"] = with_(V_STATION) + "SELECT " + ", ".join([
    R("(max(lat) - min(lat)) * 111.0::DOUBLE", "lat_spread_km"),
    R("abs((max(lon) - min(lon)) * 111.0::DOUBLE * cos(radians(avg(lat))))", "lon_spread_km"),
    R("min(elevation_m)", "min_elev"), R("max(elevation_m)", "max_elev"), R("max(elevation_m) - min(elevation_m)", "elev_range"),
    R("min(height_m)", "min_height"), R("max(height_m)", "max_height"), R("min(total_height_m)", "min_total"),
    R("max(total_height_m)", "max_total"), R("min(lat) - 1.0::DOUBLE / 111.0::DOUBLE", "bound_min_lat"),
    R("max(lat) + 1.0::DOUBLE / 111.0::DOUBLE", "bound_max_lat"),
    R("min(lon) - 1.0::DOUBLE / (111.0::DOUBLE * cos(radians(avg(lat))))", "bound_min_lon"),
    R("max(lon) + 1.0::DOUBLE / (111.0::DOUBLE * cos(radians(avg(lat))))", "bound_max_lon")]) + " FROM stations"

V_RASTER = """raster AS (SELECT (u.pos - 1)::BIGINT AS x, vec_id AS y, 100.0::DOUBLE * u.v::DOUBLE AS z
  FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(v, pos)),
rext AS (SELECT min(z) AS zmin, max(z) AS zmax, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM raster)"""

SQL["slope_aspect"] = with_(V_RASTER, """nb AS (SELECT c.x, c.y,
   n1.z AS z1, n2.z AS z2, n3.z AS z3, n4.z AS z4, n6.z AS z6, n7.z AS z7, n8.z AS z8, n9.z AS z9 FROM raster c
   LEFT JOIN raster n1 ON n1.x = c.x - 1 AND n1.y = c.y - 1 LEFT JOIN raster n2 ON n2.x = c.x AND n2.y = c.y - 1
   LEFT JOIN raster n3 ON n3.x = c.x + 1 AND n3.y = c.y - 1 LEFT JOIN raster n4 ON n4.x = c.x - 1 AND n4.y = c.y
   LEFT JOIN raster n6 ON n6.x = c.x + 1 AND n6.y = c.y LEFT JOIN raster n7 ON n7.x = c.x - 1 AND n7.y = c.y + 1
   LEFT JOIN raster n8 ON n8.x = c.x AND n8.y = c.y + 1 LEFT JOIN raster n9 ON n9.x = c.x + 1 AND n9.y = c.y + 1)""",
                              """g AS (SELECT x, y, ((z3 + 2 * z6 + z9) - (z1 + 2 * z4 + z7)) / 800.0::DOUBLE AS dx,
   ((z1 + 2 * z2 + z3) - (z7 + 2 * z8 + z9)) / 800.0::DOUBLE AS dy FROM nb)""") + f"""
SELECT x, y, {R('degrees(atan(sqrt(dx * dx + dy * dy)))', 'slope_deg')},
       {R('(((90.0::DOUBLE - degrees(atan2(-dy, dx))) % 360.0::DOUBLE) + 360.0::DOUBLE) % 360.0::DOUBLE', 'aspect_deg')} FROM g"""

SQL["minmax_scale"] = with_(V_RASTER) + f"SELECT x, y, {R('CASE WHEN zmax > zmin THEN (z - zmin) / (zmax - zmin) END', 'z_scaled')} FROM raster, rext"

V_ZONES = V_RASTER + """,
pq AS (SELECT quantile_cont(z, 0.2) AS p20, quantile_cont(z, 0.4) AS p40, quantile_cont(z, 0.6) AS p60, quantile_cont(z, 0.8) AS p80 FROM raster),
zones AS (SELECT x, y, z,
   CASE WHEN z <= p20 THEN 0 WHEN z <= p40 THEN 1 WHEN z <= p60 THEN 2 WHEN z <= p80 THEN 3 ELSE 4 END AS zone_percentile,
   CASE WHEN rel <= 0.15 THEN 0 WHEN rel <= 0.35 THEN 1 WHEN rel <= 0.55 THEN 2 WHEN rel <= 0.75 THEN 3 ELSE 4 END AS zone_relative,
   CASE WHEN z < 260 THEN 0 WHEN z < 290 THEN 1 WHEN z < 320 THEN 2 WHEN z < 350 THEN 3 ELSE 4 END AS zone_absolute
 FROM (SELECT raster.*, CASE WHEN zmax > zmin THEN (z - zmin) / (zmax - zmin) END AS rel FROM raster, rext), pq)"""

SQL["elevation_zones"] = with_(V_ZONES) + "SELECT x, y, zone_percentile, zone_relative, zone_absolute FROM zones"

SQL["zone_stats"] = with_(V_ZONES) + f"""
SELECT zone_percentile, count(*) AS n_cells, {R('min(z)', 'min_z')}, {R('max(z)', 'max_z')}, {R('avg(z)', 'mean_z')},
  {R('100.0 * count(*) / sum(count(*)) OVER ()', 'pct_cells')},
  ['Valley/Basin', 'Lower Plain', 'Upper Plain', 'Foothill', 'Ridge/Hill'][zone_percentile + 1] AS zone_name
FROM zones GROUP BY zone_percentile"""

SQL["point_zone"] = with_(V_ZONES, V_STATION.split(",\nst0 AS")[0]) + f"""
SELECT s.tower, z.x, z.y, {R('z.z', 'z')}, z.zone_percentile FROM (
  SELECT tower, least(greatest(round((easting - 740000.0::DOUBLE) / 100.0::DOUBLE), x0), x1)::BIGINT AS x,
         least(greatest(round((northing - 3978000.0::DOUBLE) / 300.0::DOUBLE), y0), y1)::BIGINT AS y FROM station, rext) s
JOIN zones z ON s.x = z.x AND s.y = z.y"""

SQL["transects"] = with_(V_RASTER) + f"""
SELECT 'row' AS profile, x AS position, {R('z', 'z')} FROM raster, rext WHERE y = floor((y0 + y1) / 2)
UNION ALL SELECT 'column', y, {R('z', 'z')} FROM raster, rext WHERE x = floor((x0 + x1) / 2)
UNION ALL SELECT 'diagonal', x, {R('z', 'z')} FROM raster WHERE x = y"""

SQL["tile_index"] = with_(V_STATION) + """
SELECT tower, trunc((lon + 180.0::DOUBLE) / 360.0::DOUBLE * 4096.0::DOUBLE)::INT AS tile_x,
  trunc((1.0::DOUBLE - ln(tan(radians(lat)) + 1.0::DOUBLE / cos(radians(lat))) / pi()) / 2.0::DOUBLE * 4096.0::DOUBLE)::INT AS tile_y
FROM stations"""

# ---------------------------------------------------------------- logs, settings, projections
def _f6(x: str) -> str:
    k = f"floor(abs({x}) * 1e6 + 0.5)::BIGINT"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || ({k} // 1000000)::VARCHAR || '.' || lpad(({k} % 1000000)::VARCHAR, 6, '0'))"


V_LOGS = V_RESULTS + f""", blocks AS (
  SELECT row_number() OVER (ORDER BY list_position({_HARR}, h.horizon), h.event, h.model) AS b,
   ['FORECAST HORIZON: ' || h.horizon, 'EVENT: ' || h.event, 'Confusion Matrix:',
    '  TN= ' || format('{{:,}}', r.tn) || ' | FP= ' || format('{{:,}}', r.fp),
    '  FN= ' || format('{{:,}}', r.fn) || ' | TP= ' || format('{{:,}}', r.tp),
    'Top 20 Most Important Features (SHAP):',
    '  1. f1 : ' || {_f6('h.test_f1')}, '  2. mcc : ' || {_f6('h.test_mcc')}, '  3. kappa : ' || {_f6('r.kappa')},
    upper(h.model) || ' Results:',
    '  CV: AUC=' || {_f6('h.cv_auc')} || ', F1=' || {_f6('h.cv_f1')} || ', MCC=' || {_f6('h.cv_mcc')},
    '  Test: AUC=' || {_f6('h.test_auc')} || ', F1=' || {_f6('h.test_f1')} || ', MCC=' || {_f6('h.test_mcc')}] AS lines
  FROM ht h JOIN rr r ON h.horizon = r.horizon AND h.event = r.event AND h.model = r.model AND r.split = 'test'),
loglines AS (SELECT 'run.log' AS file, b * 100 + u.p - 1 AS line_no, u.line FROM blocks, unnest(lines) WITH ORDINALITY AS u(line, p)),
tagged AS (SELECT *,
   last_value(CASE WHEN regexp_matches(line, 'FORECAST HORIZON: (\\w+)') THEN nullif(regexp_extract(line, 'FORECAST HORIZON: (\\w+)', 1), '') END IGNORE NULLS)
     OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS horizon,
   last_value(CASE WHEN regexp_matches(line, 'EVENT: ([\\w_]+)') THEN nullif(regexp_extract(line, 'EVENT: ([\\w_]+)', 1), '') END IGNORE NULLS)
     OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS event,
   last_value(lower(CASE WHEN regexp_matches(line, '(LIGHTGBM|XGBOOST) Results:') THEN regexp_extract(line, '(LIGHTGBM|XGBOOST) Results:', 1) END) IGNORE NULLS)
     OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model_prev,
   first_value(lower(CASE WHEN regexp_matches(line, '(LIGHTGBM|XGBOOST) Results:') THEN regexp_extract(line, '(LIGHTGBM|XGBOOST) Results:', 1) END) IGNORE NULLS)
     OVER (ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS model_next
  FROM loglines)"""


def _xs(pat: str, i: int) -> str:
    return f"CASE WHEN regexp_matches(line, '{pat}') AND regexp_extract(line, '{pat}', {i}) <> '' THEN regexp_extract(line, '{pat}', {i}) END"


_RE_CV = r"CV: AUC=(-?[\d.]+), F1=(-?[\d.]+), MCC=(-?[\d.]+)"
_RE_TEST = r"Test: AUC=(-?[\d.]+), F1=(-?[\d.]+), MCC=(-?[\d.]+)"
_RE_TNFP = r"TN=\s*([\d,]+).*FP=\s*([\d,]+)"
_RE_FNTP = r"FN=\s*([\d,]+).*TP=\s*([\d,]+)"
_RE_IMP = r"\d+\.\s+([\w_]+)\s*:\s+(-?[\d.]+)"

SQL["run_log_metrics"] = with_(V_LOGS.replace("WITH ", "", 1)) + f""", parsed AS (
  SELECT horizon, event, CASE WHEN regexp_matches(line, '{_RE_CV}') OR regexp_matches(line, '{_RE_TEST}') THEN model_prev ELSE model_next END AS model,
   ({_xs(_RE_CV, 1)})::DOUBLE AS cv_auc, ({_xs(_RE_CV, 2)})::DOUBLE AS cv_f1, ({_xs(_RE_CV, 3)})::DOUBLE AS cv_mcc,
   ({_xs(_RE_TEST, 1)})::DOUBLE AS test_auc, ({_xs(_RE_TEST, 2)})::DOUBLE AS test_f1, ({_xs(_RE_TEST, 3)})::DOUBLE AS test_mcc,
   replace({_xs(_RE_TNFP, 1)}, ',', '')::BIGINT AS tn, replace({_xs(_RE_TNFP, 2)}, ',', '')::BIGINT AS fp,
   replace({_xs(_RE_FNTP, 1)}, ',', '')::BIGINT AS fn, replace({_xs(_RE_FNTP, 2)}, ',', '')::BIGINT AS tp
  FROM tagged),
g AS (SELECT horizon, event, model, max(cv_auc) AS cv_auc, max(cv_f1) AS cv_f1, max(cv_mcc) AS cv_mcc, max(test_auc) AS test_auc,
   max(test_f1) AS test_f1, max(test_mcc) AS test_mcc, max(tn) AS tn, max(fp) AS fp, max(fn) AS fn, max(tp) AS tp
  FROM parsed WHERE horizon IS NOT NULL AND event IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2, 3 HAVING max(test_auc) IS NOT NULL)
SELECT horizon, event, model, """ + ", ".join(R(c, c) for c in ("cv_auc", "cv_f1", "cv_mcc", "test_auc", "test_f1", "test_mcc")) + \
    ", tn, fp, fn, tp, " + ", ".join([
        R("CASE WHEN tp::DOUBLE + fp::DOUBLE > 0 THEN tp::DOUBLE / (tp::DOUBLE + fp::DOUBLE) ELSE 0.0 END", "precision"),
        R("CASE WHEN tp::DOUBLE + fn::DOUBLE > 0 THEN tp::DOUBLE / (tp::DOUBLE + fn::DOUBLE) ELSE 0.0 END", "recall"),
        R("CASE WHEN tn::DOUBLE + fp::DOUBLE > 0 THEN tn::DOUBLE / (tn::DOUBLE + fp::DOUBLE) ELSE 0.0 END", "specificity"),
        R("CASE WHEN fp::DOUBLE + tn::DOUBLE > 0 THEN fp::DOUBLE / (fp::DOUBLE + tn::DOUBLE) ELSE 0.0 END", "fpr"),
        R("CASE WHEN fn::DOUBLE + tp::DOUBLE > 0 THEN fn::DOUBLE / (fn::DOUBLE + tp::DOUBLE) ELSE 0.0 END", "fnr")]) + " FROM g"

SQL["run_log_importance"] = with_(V_LOGS.replace("WITH ", "", 1)) + f"""
SELECT horizon, event, model_next AS model, regexp_extract(line, '{_RE_IMP}', 1) AS feature,
  {R(f"regexp_extract(line, '{_RE_IMP}', 2)::DOUBLE", 'importance')}
FROM tagged WHERE regexp_matches(line, '{_RE_IMP}') AND horizon IS NOT NULL AND event IS NOT NULL AND model_next IS NOT NULL"""

_LAST_HORIZON = HORIZONS[-1]
V_SETTINGS = V_RESULTS + f""", sdocs AS (
  SELECT model, 'search_results_' || model || '_' || CASE WHEN split = 'cv' THEN '20251201_000000' ELSE '20251203_000000' END AS run_folder,
    horizon || '_' || event AS key, 3 + tp % 5 AS max_depth, 0.01::DOUBLE * (1 + fn % 10) AS learning_rate,
    CASE WHEN tp % 2 = 0 THEN '4,12' ELSE '4,12,24' END AS rolling_windows, mcc FROM results WHERE horizon <> '{_LAST_HORIZON}')"""

SQL["settings_lookup"] = V_SETTINGS + """,
newest AS (SELECT * FROM sdocs WHERE (model, run_folder) IN (SELECT (model, max(run_folder)) FROM sdocs GROUP BY model)),
exps AS (SELECT DISTINCT horizon, event, model FROM rcells)
SELECT e.model, e.horizon, e.event, coalesce(n.max_depth, 6)::INTEGER AS max_depth, round(coalesce(n.learning_rate, 0.05), 6) + 0.0 AS learning_rate,
  coalesce(n.rolling_windows, '4,12,24,96') AS rolling_windows, n.run_folder IS NOT NULL AS tuned
FROM exps e LEFT JOIN newest n ON e.model = n.model AND n.key = e.horizon || '_' || e.event"""

SQL["latest_settings"] = V_SETTINGS + """
SELECT model, key, run_folder, round(mcc, 6) + 0.0 AS mcc, max_depth::INTEGER AS max_depth FROM (
  SELECT *, row_number() OVER (PARTITION BY model, key ORDER BY run_folder DESC) AS rn FROM sdocs) WHERE rn = 1"""

SQL["clean_projection"] = """
SELECT user_id AS series, ts, event_type AS var, value, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  CASE WHEN value > 100 THEN 1 ELSE 0 END AS flag
FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-25 00:00:00'
  AND event_type IN ('click', 'view', 'purchase')"""

SQL["experiment_gate"] = with_(V_OBS) + """
SELECT var, count(*) AS n_samples, count(*) FILTER (WHERE value > 100) AS n_positive,
  round(count(*) FILTER (WHERE value > 100) / count(*), 6) + 0.0 AS event_rate,
  CASE WHEN count(*) < 100 THEN 'insufficient samples' WHEN count(*) FILTER (WHERE value > 100) < 10 THEN 'insufficient positives' END AS skip_reason
FROM obs GROUP BY var"""

SQL["unpivot_events"] = with_(V_LABELS) + """
SELECT series, ts, 'event_hot' AS event, event_hot AS flag FROM labels
UNION ALL SELECT series, ts, 'event_calm', event_calm FROM labels
UNION ALL SELECT series, ts, 'event_gusty', event_gusty FROM labels"""

SQL["long_results_pivot"] = V_RESULTS + " SELECT horizon, event, split, " + ", ".join(
    R(f"max({x}) FILTER (WHERE model = '{m}')", f"{m}_{x}") for m in ("lightgbm", "xgboost") for x in ("f1", "mcc")
) + " FROM results GROUP BY 1, 2, 3"

SQL["topk_per_group"] = with_(V_FILES) + """
SELECT feature, tower, event, round(importance_pct, 6) + 0.0 AS importance_pct, k::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tower ORDER BY importance_pct DESC, feature ASC, event ASC) AS k FROM files) WHERE k <= 3"""

SQL["top_n"] = with_(V_FILES) + """
SELECT feature, tower, event, round(importance_pct, 6) + 0.0 AS importance_pct FROM files
ORDER BY importance_pct DESC, feature, tower, event LIMIT 10"""

SQL["argmax_row"] = with_(V_FILES, "m AS (SELECT event, feature, avg(importance_pct) AS mean_importance FROM files GROUP BY 1, 2)") + """
SELECT event, min(feature) AS feature, round(max(mean_importance), 6) + 0.0 AS mean_importance FROM m
WHERE (event, mean_importance) IN (SELECT (event, max(mean_importance)) FROM m GROUP BY event) GROUP BY event"""

SQL["union_all"] = with_(V_GRID) + """
SELECT series, ts, temp, peak, n, CASE WHEN series IN ('click', 'error') THEN 'first' END AS note FROM grid"""

SQL["distinct_values"] = """
SELECT event, tower, count(*) OVER (PARTITION BY event) AS n_towers
FROM (SELECT DISTINCT p_type AS event, p_brand AS tower FROM part)"""

SQL["sample_rows"] = """
SELECT user_id AS series, ts, event_type AS var, value FROM events
ORDER BY md5('42|' || coalesce(user_id::VARCHAR, 'null') || '|' || coalesce(epoch_us(ts)::VARCHAR, 'null') || '|' || coalesce(event_type, 'null')),
  user_id, ts, event_type LIMIT 500"""

SQL["io_roundtrip"] = with_(V_GRID) + "SELECT series, ts, temp, peak, n FROM grid"

SQL["tower_rejects"] = with_(V_GRID) + """
SELECT series AS tower, count(*) AS n_readings, count(*) FILTER (WHERE n % 10 = 0) AS n_rejects FROM grid GROUP BY series"""

SQL["metadata_roundtrip"] = with_(V_STATION) + f"""
SELECT tower, {R('lat', 'lat')}, {R('lon', 'lon')}, {R('elevation_m', 'elevation_m')}, {R('elevation_m', 'elevation_msl_m')},
  {R('height_m', 'height_m')}, 'Site ' || tower AS name, terrain_type, {R('slope_deg', 'slope_deg')}, aspect_deg::DOUBLE AS aspect_deg,
  canopy_cover_pct::DOUBLE AS canopy_cover_pct, dist_to_ridge_m::DOUBLE AS dist_to_ridge_m, soil_type, land_use, '#888888' AS color, region
FROM stations"""

SQL["region_info"] = with_(V_STATION) + f"""
SELECT region AS name, count(*)::VARCHAR AS state, {R('avg(lat)', 'center_lat')}, {R('avg(lon)', 'center_lon')} FROM stations GROUP BY region"""

SQL["run_config"] = V_RESULTS + """
SELECT 'events' AS setting, '["' || string_agg(DISTINCT event, '","' ORDER BY event) || '"]' AS value FROM results
UNION ALL SELECT 'models', '["' || string_agg(DISTINCT model, '","' ORDER BY model) || '"]' FROM results
UNION ALL SELECT 'n_results', count(*)::VARCHAR FROM results
UNION ALL SELECT 'n_samples', sum(n_samples)::BIGINT::VARCHAR FROM results"""

SQL["importance_files"] = with_(V_IMP) + """
SELECT replace(tower, '#', '') AS tower, replace(event, ' ', '-') AS event, count(*) AS n,
  round(sum(importance::DECIMAL(18,4))::DOUBLE, 6) + 0.0 AS total, max(feature) AS last_feature
FROM imp GROUP BY 1, 2"""

SQL["labelled_roundtrip"] = with_(V_LABELS) + "SELECT * FROM labels"

SQL["side_table_optional"] = with_(V_GRID, V_AUX) + """
SELECT t.ts, a.aux_k FROM (SELECT DISTINCT ts FROM grid) t LEFT JOIN aux a ON t.ts = a.ts"""

SQL["tower_files_labels"] = with_(V_LABELS) + """
SELECT series AS tower, ts, temp, peak, n, event_hot, event_hot_duration_min, event_hot_meets_duration,
  event_calm, event_calm_duration_min, event_calm_meets_duration, event_gusty, event_gusty_duration_min,
  event_gusty_meets_duration, event_count, active_events, event_durations, has_any_event FROM labels"""

SQL["tower_files_pooled_flags"] = with_(V_UNION_MASK) + "SELECT * FROM umask"

# ---------------------------------------------------------------- pooled forecast job
# event: (hours a step, lags, windows, horizons, variable of the limit, limit)
_EVENT_SETTINGS = {"hot": (2, range(1, 7), (2, 6), {"2hr": 1, "6hr": 3}, "temp", 60),
                   "calm": (1, (1, 2, 4), (2, 4, 12), {"1hr": 1, "6hr": 6}, "temp", 42),
                   "gusty": (1, range(1, 13), (6,), {"1hr": 1, "3hr": 3, "12hr": 12}, "peak", 100)}


def _timeline(event: str) -> str:
    step = _EVENT_SETTINGS[event][0]
    cut = ", ".join(f"avg(floor({c} * 100) / 100) AS {c}" for c in WIDE_COLS)
    fill = ", ".join(
        f"coalesce({c}, last_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
        f"first_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS {c}"
        for c in WIDE_COLS)
    return f"""
{event}_bins AS (SELECT time_bucket(INTERVAL {step} HOUR, ts) AS ts, {cut}, bool_or(event_{event}) AS flag
  FROM wide JOIN umask USING (ts) GROUP BY 1),
{event}_dense AS (SELECT d.ts, {", ".join(WIDE_COLS)}, coalesce(flag, false) AS flag
  FROM (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL {step} HOUR)) AS ts FROM {event}_bins) d
  LEFT JOIN {event}_bins b ON b.ts = d.ts),
{event}_line AS (SELECT ts, flag, {fill} FROM {event}_dense)"""


def _feature_columns(event: str) -> dict[str, str]:
    _, lags, windows, _, variable, limit = _EVENT_SETTINGS[event]
    out = {}
    for c in WIDE_COLS:
        out |= {f"{c}_lag{k}": f"lag({c}, {k}) OVER (ORDER BY ts)" for k in lags}
        for w in windows:
            frame = f"OVER (ORDER BY ts ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
            for stat, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")):
                out[f"{c}_roll{w}_{stat}"] = f"CASE WHEN count({c}) {frame} = {w} THEN {f}({c}) {frame} END"
        out[f"{c}_diff1"] = f"{c} - lag({c}) OVER (ORDER BY ts)"
        out[f"{c}_diff2"] = f"{c} - 2 * lag({c}) OVER (ORDER BY ts) + lag({c}, 2) OVER (ORDER BY ts)"
    for v in ("temp", "peak"):
        members = ", ".join(f"{s}_{v}" for s in SERIES)
        mean = f"list_avg([{members}])"
        out |= {f"{v}_tower_mean": mean, f"{v}_tower_std": f"list_stddev_samp([{members}])",
                f"{v}_tower_range": f"greatest({members}) - least({members})"}
        out |= {f"{s}_{v}_dev_from_mean": f"{s}_{v} - {mean}" for s in SERIES}
    for name, x, n in (("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12)):
        out |= {f"{name}_{f}": f"{f}(2 * pi() * {x} / {n})" for f in ("sin", "cos")}
    return out | {f"{s}_{variable}_dist_to_{limit}": f"{s}_{variable} - {limit}" for s in SERIES}


def _feature_rows(event: str) -> str:
    columns = _feature_columns(event)
    made, names = ", ".join(f'round({x}, 6) + 0.0 AS "{n}"' for n, x in columns.items()), ", ".join(columns)
    return f"""
{event}_wide AS (SELECT '{event}' AS event, ts, {made} FROM {event}_line),
{event}_rows AS (SELECT event, ts, feature, value FROM {event}_wide UNPIVOT INCLUDE NULLS (value FOR feature IN ({names})))"""


def _target_rows(event: str) -> str:
    return f"{event}_targets AS (" + " UNION ALL ".join(
        f"SELECT '{event}' AS event, ts, '{h}' AS horizon, lead(flag::INT::DOUBLE, {k}) OVER (ORDER BY ts) AS target FROM {event}_line"
        for h, k in _EVENT_SETTINGS[event][3].items()) + ")"


V_LINES = V_UNION_MASK + "," + ",".join(_timeline(e) for e in _EVENT_SETTINGS)

SQL["pooled_features"] = with_(V_LINES, *[_feature_rows(e) for e in _EVENT_SETTINGS]) + " UNION ALL ".join(
    f"SELECT event, ts, feature, value FROM {e}_rows" for e in _EVENT_SETTINGS)

SQL["pooled_targets"] = with_(V_LINES, *[_target_rows(e) for e in _EVENT_SETTINGS]) + " UNION ALL ".join(
    f"SELECT * FROM {e}_targets" for e in _EVENT_SETTINGS)


def _reach(event: str) -> int:
    _, lags, windows, *_ = _EVENT_SETTINGS[event]
    return max([2, *lags, *(w - 1 for w in windows)])


SQL["training_grid"] = with_(
    V_LINES, *[_target_rows(e) for e in _EVENT_SETTINGS],
    "numbered AS (" + " UNION ALL ".join(
        f"SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY ts) AS i, {_reach(e)} AS reach FROM {e}_targets"
        for e in _EVENT_SETTINGS) + ")",
    """kept AS (SELECT event, horizon, target AS y, row_number() OVER (PARTITION BY event, horizon ORDER BY ts) - 1 AS p,
  count(*) OVER (PARTITION BY event, horizon) AS n FROM numbered WHERE target IS NOT NULL AND i > reach)""",
    "sized AS (SELECT *, floor(n * 0.8)::BIGINT AS m, (floor(n * 0.8)::BIGINT // 4) AS size FROM kept)",
    """spans AS (SELECT *, CASE WHEN fold = 0 THEN m ELSE m - (4 - fold) * size END AS cut,
  CASE WHEN fold = 0 THEN n ELSE m - (3 - fold) * size END AS stop FROM sized, range(4) AS folds(fold))""",
    """counts AS (SELECT event, horizon, fold, n AS n_rows, count(*) FILTER (p < cut) AS train_rows,
  count(*) FILTER (p < cut AND y = 1) AS train_positives, count(*) FILTER (p >= cut AND p < stop) AS test_rows,
  count(*) FILTER (p >= cut AND p < stop AND y = 1) AS test_positives, count(*) FILTER (y = 1) AS positives
  FROM spans GROUP BY ALL)""") + """
SELECT event, horizon, fold::INT AS fold, n_rows, train_rows, train_positives, test_rows, test_positives,
  CASE WHEN train_positives > 0 THEN round(pow((train_rows - train_positives) / train_positives, 0.75), 6) ELSE 1.0 END AS pos_weight,
  CASE WHEN n_rows < 100 THEN 'insufficient data' WHEN positives < 10 THEN 'too few positive events'
       WHEN train_positives = 0 OR train_positives = train_rows THEN 'one class in training'
       WHEN test_rows = 0 THEN 'no test rows' END AS skipped FROM counts"""

# ---------------------------------------------------------------- rules as a table
# series -> column of each variable that it has
_MAP = {"click": {"temp": "temp", "peak": "peak"}, "error": {"temp": "temp", "hum": "n"},
        "purchase": {"temp": "temp", "peak": "peak", "hum": "n"}, "signup": {"temp": "temp"},
        "view": {"temp": "temp", "peak": "peak"}}
_TERMS = {"hot": (("temp",), "{temp} > 60", 120.0), "calm": (("temp",), "{temp} < 42", 180.0),
          "gusty": (("temp", "peak"), "{temp} > 40 AND {peak} > 100", 60.0),
          "muggy": (("temp", "hum"), "{temp} >= 55 AND {hum} <= 2", 60.0)}

SQL["rule_availability"] = " UNION ALL ".join(
    f"SELECT '{s}' AS series, '{e}' AS event, {len(needs)}::BIGINT AS n_needed, {sum(v in m for v in needs)}::BIGINT AS n_present, "
    f"'{','.join(sorted(v for v in needs if v not in m))}' AS lacking, {all(v in m for v in needs)} AS available"
    for s, m in _MAP.items() for e, (needs, _, _) in _TERMS.items())

V_MASKS = V_GRID + ", masks AS (" + " UNION ALL ".join(
    f"SELECT series, ts, '{e}' AS event, coalesce({p.format(**m)}, false) AS m, {h} AS min_minutes FROM grid WHERE series = '{s}'"
    for s, m in _MAP.items() for e, (needs, p, h) in _TERMS.items() if all(v in m for v in needs)) + ")"


def _runs(groups: str, where: str) -> str:
    by = "PARTITION BY series, event, gap_group"
    return with_(V_MASKS, f"grouped AS ({groups})", f"""
marked AS (SELECT *, m AND NOT coalesce(lag(m) OVER ({by} ORDER BY ts), false) AS st,
  coalesce(min(CASE WHEN NOT m THEN ts END) OVER ({by} ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
           max(ts) OVER ({by})) AS e FROM grouped),
found AS (SELECT series, event, ts AS start, e AS "end", round((epoch_us(e) - epoch_us(ts)) / 60000000.0, 6) + 0.0 AS duration_minutes,
  min_minutes FROM marked WHERE st)""") + f"SELECT * FROM found {where}"


SQL["table_rule_segments"] = _runs("SELECT *, 0 AS gap_group FROM masks", "WHERE duration_minutes >= min_minutes")

SQL["gap_segments"] = _runs("""SELECT *, sum(brk::INT) OVER (PARTITION BY series, event ORDER BY ts) AS gap_group FROM (
  SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY series, event ORDER BY ts) > INTERVAL 120 MINUTE, false) AS brk FROM masks)""", "")

SQL["log_files_metrics"] = SQL["run_log_metrics"]
SQL["log_files_importance"] = SQL["run_log_importance"]

_MODEL_DEFAULTS = {
    "lightgbm": {"num_leaves": 31, "max_depth": -1, "min_child_samples": 20, "min_child_weight": 0.001, "reg_alpha": 0.0,
                 "reg_lambda": 0.0, "min_split_gain": 0.0, "feature_fraction": 0.9, "bagging_fraction": 0.8, "bagging_freq": 5,
                 "learning_rate": 0.05, "n_estimators": 1000},
    "xgboost": {"max_depth": 6, "min_child_weight": 1.0, "max_delta_step": 0, "reg_alpha": 0.0, "reg_lambda": 1.0, "gamma": 0.0,
                "subsample": 0.8, "colsample_bytree": 0.9, "colsample_bylevel": 1.0, "colsample_bynode": 1.0,
                "learning_rate": 0.05, "n_estimators": 1000}}
_FOUND = {"max_depth": "n.max_depth", "learning_rate": "n.learning_rate", "num_leaves": "n.num_leaves",
          "feature_fraction": "n.feature_fraction", "gamma": "n.gamma", "reg_alpha": "n.reg_alpha"}


def _field(name: str) -> str:
    cases = []
    for model, fields in _MODEL_DEFAULTS.items():
        if name in fields:
            found = _FOUND.get(name, "NULL")
            cases.append(f"WHEN e.model = '{model}' THEN round(coalesce({found}, {fields[name]})::DOUBLE, 6) + 0.0")
    return f"CASE {' '.join(cases)} END AS {name}"


SQL["settings_files"] = V_RESULTS + f""", docs AS (
  SELECT model, split, horizon || '_' || event AS key, CASE WHEN tp % 3 = 0 THEN 'short' END AS lag_config,
    CASE WHEN tp % 4 = 0 THEN false END AS use_rolling, 3 + tp % 5 AS max_depth, 0.01::DOUBLE * (1 + fn % 10) AS learning_rate,
    16 + fn % 64 AS num_leaves, CASE WHEN fn % 2 = 0 THEN 0.25 * (fp % 4) END AS feature_fraction, 0.5 * (fn % 3) AS gamma,
    CASE WHEN fp % 3 <> 1 THEN fp % 7 END AS reg_alpha, CASE WHEN tp % 2 = 0 THEN '4,12' ELSE '4,12,24' END AS windows,
    CASE WHEN tp % 2 = 0 THEN mcc END AS mcc, CASE WHEN tp % 2 = 0 THEN f1 END AS f1, CASE WHEN tp % 2 = 0 THEN kappa END AS kappa
  FROM results WHERE horizon <> '{_LAST_HORIZON}'),
newest AS (SELECT * FROM docs WHERE (model, split = 'cv') IN (SELECT (model, bool_and(split = 'cv')) FROM docs GROUP BY model)),
exps AS (SELECT DISTINCT horizon, event, model FROM rcells)
SELECT e.horizon, e.event, e.model, coalesce(n.lag_config, 'long') AS lag_config, coalesce(n.use_rolling, true) AS use_rolling,
  {", ".join(_field(f) for f in dict.fromkeys(f for m in _MODEL_DEFAULTS.values() for f in m))},
  coalesce(n.windows, '4,12,24,96') AS windows, round(n.mcc, 6) + 0.0 AS mcc, round(n.f1, 6) + 0.0 AS f1,
  round(n.kappa, 6) + 0.0 AS kappa, n.key IS NOT NULL AS tuned
FROM exps e LEFT JOIN newest n ON e.model = n.model AND n.key = e.horizon || '_' || e.event"""

SQL["station_fallbacks"] = with_(V_STATION0, _TERRAIN_SQL.strip(), """
partial AS (SELECT tower, height_m, lat, lon, CASE WHEN s_suppkey % 5 <> 0 THEN floor(elevation_m) END AS elevation_m,
  CASE WHEN s_suppkey % 3 = 0 THEN (s_suppkey % 80) / 10 END AS slope_deg, CASE WHEN s_suppkey % 4 = 0 THEN (s_suppkey % 360)::INT END AS aspect_deg
  FROM st0)""", _stations_sql("mended", "partial")) + f"""
SELECT tower, {R('elevation_m', 'elevation_m')}, {R('slope_deg', 'slope_deg')}, aspect_deg, terrain_type, canopy_cover_pct, dist_to_ridge_m,
  soil_type, land_use FROM mended"""

SQL["tile_corner"] = with_(V_STATION) + f"""
SELECT tower, x, y, {R("degrees(atan(sinh(pi() * (1.0::DOUBLE - 2.0::DOUBLE * y / 8192.0::DOUBLE))))", "lat")},
  {R("x / 8192.0::DOUBLE * 360.0::DOUBLE - 180.0::DOUBLE", "lon")}
FROM (SELECT tower, trunc((lon + 180.0::DOUBLE) / 360.0::DOUBLE * 8192.0::DOUBLE)::INT AS x,
  trunc((1.0::DOUBLE - ln(tan(radians(lat)) + 1.0::DOUBLE / cos(radians(lat))) / pi()) / 2.0::DOUBLE * 8192.0::DOUBLE)::INT AS y FROM stations)"""

# ---------------------------------------------------------------- roll-ups by other keys
SQL["importance_by_series"] = SQL["importance_by_event"].replace("SELECT event, feature,", "SELECT tower, feature,").replace(
    "PARTITION BY event", "PARTITION BY tower")

SQL["importance_cells"] = with_(V_FILES, """
c AS (SELECT regexp_split_to_array(feature, '_[0-9]+m|_lag|_roll')[1] AS category, tower, avg(importance_pct) AS cell FROM files GROUP BY 1, 2)""",
                                "m AS (SELECT category, sum(cell) / (SELECT count(DISTINCT tower) FROM files) AS row_mean FROM c GROUP BY 1)") + f"""
SELECT category, tower, {R('cell', 'cell')}, {R('row_mean', 'row_mean')}, rank AS row_rank
FROM c JOIN (SELECT *, row_number() OVER (ORDER BY round(row_mean, 9) DESC, category) AS rank FROM m) USING (category)"""

SQL["score_box_stats"] = V_RESULTS + f""",
q AS (SELECT model, quantile_cont(f1, 0.25) AS q1, quantile_cont(f1, 0.5) AS median, quantile_cont(f1, 0.75) AS q3 FROM results GROUP BY model),
l AS (SELECT r.f1, q.*, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM results r JOIN q USING (model))
SELECT model, {R('q1', 'q1')}, {R('median', 'median')}, {R('q3', 'q3')}, {R('q3 - q1', 'iqr')},
  {R('min(f1) FILTER (f1 >= lo)', 'whisker_low')}, {R('max(f1) FILTER (f1 <= hi)', 'whisker_high')},
  count(*) FILTER (f1 < lo OR f1 > hi) AS n_outliers, count(*) AS n
FROM l GROUP BY model, q1, median, q3"""

SQL["feature_columns"] = with_(V_LABELS) + """
SELECT * FROM (SELECT count(temp) AS temp, count(peak) AS peak, count(n) AS n FROM labels)
UNPIVOT (n_values FOR "column" IN (temp, peak, n))"""

# ---------------------------------------------------------------- one model per series and event
SQL["series_training_grid"] = with_(V_LABELS, """
placed AS (SELECT series, ts, event_hot, event_calm, event_gusty, temp, peak, row_number() OVER (PARTITION BY series ORDER BY ts) AS i,
  count(*) OVER (PARTITION BY series) AS c FROM labels)""", "targets AS (" + " UNION ALL ".join(
      f"SELECT series, ts, i, c, '{e}' AS event, lead(event_{e}::INT, 4) OVER (PARTITION BY series ORDER BY ts) AS y FROM placed"
      for e in ("hot", "calm", "gusty")) + ")",
    """kept AS (SELECT series, event, y, row_number() OVER (PARTITION BY series, event ORDER BY ts) - 1 AS p,
  count(*) OVER (PARTITION BY series, event) AS n FROM targets WHERE y IS NOT NULL AND i >= 12)""",
    "sized AS (SELECT *, floor(n * 0.8)::BIGINT AS m, (floor(n * 0.8)::BIGINT // 4) AS size FROM kept)",
    """spans AS (SELECT *, CASE WHEN fold = 0 THEN m ELSE m - (4 - fold) * size END AS cut,
  CASE WHEN fold = 0 THEN n ELSE m - (3 - fold) * size END AS stop FROM sized, range(4) AS folds(fold))""",
    """counts AS (SELECT series, event, fold, n AS n_rows, count(*) FILTER (p < cut) AS train_rows,
  count(*) FILTER (p < cut AND y = 1) AS train_positives, count(*) FILTER (p >= cut AND p < stop) AS test_rows,
  count(*) FILTER (p >= cut AND p < stop AND y = 1) AS test_positives, count(*) FILTER (y = 1) AS positives
  FROM spans GROUP BY ALL)""") + """
SELECT series, event, fold::INT AS fold, n_rows, train_rows, train_positives, test_rows, test_positives,
  CASE WHEN train_positives > 0 THEN round(train_rows / (2.0 * train_positives), 6) ELSE 1.0 END::DOUBLE AS pos_weight,
  CASE WHEN train_rows > train_positives THEN round(train_rows / (2.0 * (train_rows - train_positives)), 6) ELSE 1.0 END::DOUBLE AS neg_weight,
  CASE WHEN n_rows < 100 THEN 'insufficient data' WHEN positives < 10 THEN 'too few positive events'
       WHEN train_positives = 0 OR train_positives = train_rows THEN 'one class in training'
       WHEN test_rows = 0 THEN 'no test rows' END AS skipped FROM counts"""

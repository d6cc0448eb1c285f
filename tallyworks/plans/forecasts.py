"""Forecast queries at district and outlet grain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.operators import features as ft
from tallyworks.operators import forecast as fc
from tallyworks.plans.registry import CTES, as_of, as_text, query, rounded
from tallyworks.plans.retail import RECENT
from tallyworks.sources.views import Views

CTES["series"] = """
  SELECT c.district, c.date, COALESCE(d.v, 0) AS y, ROW_NUMBER() OVER (PARTITION BY c.district ORDER BY c.date) AS i,
    COUNT(*) OVER (PARTITION BY c.district) AS n, c.active
  FROM (SELECT district, active, CAST(UNNEST(GENERATE_SERIES(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (
      SELECT district, MIN(date) AS lo, MAX(date) AS hi, COUNT(*) AS active FROM {daily} GROUP BY 1 HAVING COUNT(*) >= 14)) c
  LEFT JOIN {daily} d ON c.district = d.district AND c.date = d.date"""
CTES["daily"] = """
  SELECT district, date, SUM(sale_value) AS v FROM {sales} WHERE date <= DATE '2001-08-01' AND district IS NOT NULL GROUP BY 1, 2"""
CTES["train"] = """
  SELECT district, MAX(y) FILTER (WHERE i = n - 14) AS last_y, LIST(y ORDER BY i) FILTER (WHERE i > n - 21) AS last7,
    AVG(y) FILTER (WHERE i > n - 21) AS ma7 FROM {series} WHERE i <= n - 14 GROUP BY 1"""
CTES["errors"] = """
  SELECT s.district, s.date, s.y, i - (n - 14) - 1 AS j, last_y AS naive_last, last7[(i - (n - 14) - 1) % 7 + 1] AS seasonal_naive_7d,
    ma7 AS moving_avg_7d FROM {series} s JOIN {train} t ON s.district = t.district WHERE i > n - 14"""
CTES["metrics"] = """
  SELECT *, CASE WHEN naive_last_mae <= seasonal_naive_7d_mae AND naive_last_mae <= moving_avg_7d_mae THEN 'naive_last'
      WHEN seasonal_naive_7d_mae <= moving_avg_7d_mae THEN 'seasonal_naive_7d' ELSE 'moving_avg_7d' END AS best_model
  FROM (SELECT district, """ + ", ".join(
    f"AVG(ABS(y - {m})) AS {m}_mae, AVG(ABS(y - {m}) / y) FILTER (WHERE y > 0) * 100 AS {m}_mape" for m in fc.MODELS
) + " FROM {errors} GROUP BY 1)"
CTES["tail"] = """
  SELECT district, MAX(date) AS last_date, LIST(y ORDER BY i) FILTER (WHERE i > n - 7) AS last7, AVG(y) FILTER (WHERE i > n - 7) AS ma7,
    MAX(y) FILTER (WHERE i = n) AS last_y, STDDEV_SAMP(y) FILTER (WHERE i > n - 30) / GREATEST(AVG(y) FILTER (WHERE i > n - 30), 1) AS cv,
    AVG(y) FILTER (WHERE i > n - 14) > AVG(y) FILTER (WHERE i > n - 28 AND i <= n - 14) AS up,
    AVG(y) FILTER (WHERE isodow(date) >= 6) / GREATEST(AVG(y) FILTER (WHERE isodow(date) < 6), 1) AS uplift FROM {series} GROUP BY 1"""
CTES["ahead"] = """
  SELECT t.district, t.last_date + CAST(h AS INTEGER) AS date, h, CASE best_model WHEN 'seasonal_naive_7d' THEN last7[(h - 1) % 7 + 1]
    WHEN 'moving_avg_7d' THEN ma7 ELSE last_y END AS value
  FROM {tail} t JOIN {metrics} m ON t.district = m.district CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(1, 14)) AS h)"""
CTES["top_outlets"] = "SELECT outlet_code FROM {feats} ORDER BY total_sale_value DESC, outlet_code LIMIT 300"
CTES["odaily"] = """
  SELECT outlet_code, date, SUM(sale_value) AS v FROM {sales} WHERE date <= DATE '2001-08-01' AND outlet_code IN (SELECT outlet_code FROM {top_outlets})
  GROUP BY 1, 2"""
CTES["oseries"] = """
  SELECT c.outlet_code, c.date, COALESCE(d.v, 0) AS y, ROW_NUMBER() OVER (PARTITION BY c.outlet_code ORDER BY c.date) AS i,
    COUNT(*) OVER (PARTITION BY c.outlet_code) AS n
  FROM (SELECT outlet_code, CAST(UNNEST(GENERATE_SERIES(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM (
      SELECT outlet_code, MIN(date) AS lo, MAX(date) AS hi FROM {odaily} GROUP BY 1 HAVING COUNT(*) >= 14)) c
  LEFT JOIN {odaily} d ON c.outlet_code = d.outlet_code AND c.date = d.date"""
CTES["points"] = """
  SELECT outlet_code, 'actual' AS kind, date, y AS value FROM {oseries} WHERE i > n - 28
  UNION ALL SELECT outlet_code, 'forecast', hi + CAST(h AS INTEGER), last7[(h - 1) % 7 + 1] FROM (
    SELECT outlet_code, MAX(date) AS hi, LIST(y ORDER BY i) FILTER (WHERE i > n - 7) AS last7 FROM {oseries} GROUP BY 1)
    CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(1, 14)) AS h)"""
CTES["depot_points"] = """
  SELECT p.*, COALESCE(NULLIF(TRIM(o.depot_code), ''), 'Unassigned') AS depot, COALESCE(o.district, '—') AS district
  FROM {points} p LEFT JOIN {outlets} o ON p.outlet_code = o.outlet_code"""
CTES["dpoints"] = """
  SELECT district, 'actual' AS kind, date, y AS value FROM {series} WHERE i > n - 28
  UNION ALL SELECT district, 'forecast', date, value FROM {ahead}"""


def series(v: Views) -> DataFrame:
    return fc.daily_series(ft.not_after(v.sales, as_of()), "district", "sale_value")


def forecast(v: Views) -> DataFrame:
    return fc.forecast(v.sales, "district", "sale_value", as_of())


def points(v: Views) -> DataFrame:
    f = ft.outlet_features(v.sales, None, as_of(), RECENT)
    return fc.explode_points(fc.forecast_top(f, v.sales, as_of()), "outlet_code")


def depot_points(v: Views) -> DataFrame:
    return fc.with_depot(points(v), v.outlets)


@query("ts_01_daily_series", """
  SELECT district, ANY_VALUE(active) AS active_days, COUNT(*) AS days, ROUND(SUM(y), 2) AS total, COUNT(*) FILTER (WHERE y = 0) AS zero_days
  FROM {series} GROUP BY 1""")  # fmt: skip
def ts_01(v: Views) -> DataFrame:
    return series(v).select(
        "district", F.col("active_days").cast("long").alias("active_days"), F.size("y").cast("long").alias("days"),
        fc.total(F.col("y")).alias("total"), F.size(F.filter("y", lambda x: x == 0)).cast("long").alias("zero_days"))


@query("ts_02_holdout_split", """
  SELECT district, COUNT(*) FILTER (WHERE i <= n - 14) AS train_days, COUNT(*) FILTER (WHERE i > n - 14) AS test_days,
    SUM(y) FILTER (WHERE i > n - 14) AS test_total FROM {series} GROUP BY 1""")  # fmt: skip
def ts_02(v: Views) -> DataFrame:
    b = fc.backtest(series(v))
    return b.select("district", F.size("train").cast("long").alias("train_days"), F.size("test").cast("long").alias("test_days"),
                    fc.total(F.col("test")).alias("test_total"))


@query("ts_03_naive_last", "SELECT district, last_y AS naive_last FROM {train}")
def ts_03(v: Views) -> DataFrame:
    return fc.backtest(series(v)).select("district", "naive_last")


@query("ts_04_seasonal_naive", "SELECT district, j, seasonal_naive_7d AS value FROM {errors}")
def ts_04(v: Views) -> DataFrame:
    return fc.backtest(series(v)).select("district", F.posexplode("seasonal_naive_7d").alias("j", "value")).withColumn("j", F.col("j").cast("long"))


@query("ts_05_moving_average", "SELECT district, ROUND(ma7, 4) AS moving_avg_7d FROM {train}")
def ts_05(v: Views) -> DataFrame:
    return rounded(fc.backtest(series(v)).select("district", "moving_avg_7d"), 4, "moving_avg_7d")


@query("ts_06_errors", "SELECT district, " + ", ".join(f"ROUND({m}_mae, 4) AS {m}_mae, ROUND({m}_mape, 6) AS {m}_mape" for m in fc.MODELS)
       + " FROM {metrics}")
def ts_06(v: Views) -> DataFrame:
    b = fc.backtest(series(v)).select("district", *[f"{m}_{k}" for m in fc.MODELS for k in ("mae", "mape")])
    return rounded(rounded(b, 4, *[f"{m}_mae" for m in fc.MODELS]), 6, *[f"{m}_mape" for m in fc.MODELS])


@query("ts_07_best_model", "SELECT district, best_model FROM {metrics}")
def ts_07(v: Views) -> DataFrame:
    return fc.backtest(series(v)).select("district", "best_model")


@query("ts_08_forward_forecast", "SELECT district, CAST(date AS VARCHAR) AS date, ROUND(value, 4) AS value FROM {ahead}")
def ts_08(v: Views) -> DataFrame:
    f = fc.project(fc.backtest(series(v)), "best_model").select("district", F.inline("forecast_next_14d"))
    return as_text(rounded(f, 4, "value"), "date")


@query("ts_09_confidence", "SELECT district, ROUND(LEAST(0.95, GREATEST(0.4, 1 - cv * 0.5)), 6) AS confidence FROM {tail}")
def ts_09(v: Views) -> DataFrame:
    return rounded(fc.confidence(series(v)).select("district", "confidence"), 6, "confidence")


@query("ts_10_drivers", """
  SELECT district, CASE WHEN up THEN 'up' ELSE 'down' END AS recent_trend, ROUND_EVEN(cv * 1000, 0) / 1000 AS volatility_cv,
    ROUND_EVEN(uplift * 100, 0) / 100 AS weekend_uplift FROM {tail}""")  # fmt: skip
def ts_10(v: Views) -> DataFrame:
    return fc.confidence(series(v)).select("district", "recent_trend", "volatility_cv", "weekend_uplift")


@query("ts_11_packed_output", """
  SELECT district, ARRAY_TO_STRING(LIST(CAST(date AS VARCHAR) || '=' || CAST(CAST(ROUND(value) AS BIGINT) AS VARCHAR) ORDER BY date) FILTER (WHERE kind = 'actual'), ' ')
    AS actual, COUNT(*) FILTER (WHERE kind = 'forecast') AS horizon, CAST(MIN(date) FILTER (WHERE kind = 'forecast') AS VARCHAR) AS first_day
  FROM {dpoints} GROUP BY 1""")  # fmt: skip
def ts_11(v: Views) -> DataFrame:
    past = F.transform("actual_last_28d", lambda p: F.concat(p["date"].cast("string"), F.lit("="), p["value"].cast("long").cast("string")))
    return forecast(v).select(
        "district", F.array_join(past, " ").alias("actual"), F.size("forecast_next_14d").cast("long").alias("horizon"),
        F.col("forecast_next_14d")[0]["date"].cast("string").alias("first_day"))


@query("ts_12_top_outlet_forecast", "SELECT outlet_code, kind, CAST(date AS VARCHAR) AS date, value FROM {points}")
def ts_12(v: Views) -> DataFrame:
    return as_text(points(v), "date")


@query("win_04_rolling_mean", """
  SELECT district, ROUND(m, 4) AS rolling7 FROM (SELECT district, i, n, AVG(y) OVER (PARTITION BY district ORDER BY i ROWS 6 PRECEDING) AS m FROM {series})
  WHERE i = n""")  # fmt: skip
def win_04(v: Views) -> DataFrame:
    return rounded(series(v).select("district", fc.mean(fc.last_n("y", 7)).alias("rolling7")), 4, "rolling7")


@query("win_10_series_slices", """
  SELECT district, SUM(y) FILTER (WHERE i > n - 14) AS last14, SUM(y) FILTER (WHERE i > n - 28 AND i <= n - 14) AS prev14,
    SUM(y) FILTER (WHERE i > n - 30) AS last30 FROM {series} GROUP BY 1""")  # fmt: skip
def win_10(v: Views) -> DataFrame:
    return series(v).select("district", fc.total(fc.last_n("y", 14)).alias("last14"), fc.total(fc.last_n("y", 14, 14)).alias("prev14"),
                            fc.total(fc.last_n("y", 30)).alias("last30"))


@query("jn_10_forecast_depots", """
  SELECT depot, district, COUNT(*) AS n, ROUND(SUM(value), 2) AS value FROM {depot_points} GROUP BY 1, 2""")  # fmt: skip
def jn_10(v: Views) -> DataFrame:
    return depot_points(v).groupBy("depot", "district").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


@query("agg_30_depot_rollup", """
  SELECT a.*, ROUND(CASE WHEN prev14 > 0 THEN (recent14 - prev14) / prev14 ELSE 0 END, 6) AS momentum, t.total_outlets, d.top_districts, c.outlet_count
  FROM (SELECT depot, COALESCE(SUM(v) FILTER (WHERE kind = 'actual' AND r <= 14), 0) AS recent14, COALESCE(SUM(v) FILTER (WHERE kind = 'actual' AND r > 14 AND r <= 28), 0) AS prev14,
      COALESCE(SUM(v) FILTER (WHERE kind = 'forecast' AND u <= 14), 0) AS next14_forecast FROM (
      SELECT depot, kind, date, SUM(value) AS v, ROW_NUMBER() OVER (PARTITION BY depot, kind ORDER BY date DESC) AS r,
        ROW_NUMBER() OVER (PARTITION BY depot, kind ORDER BY date) AS u FROM {depot_points} GROUP BY 1, 2, 3) GROUP BY 1) a
  JOIN (SELECT depot_code AS depot, COUNT(*) AS total_outlets FROM {outlets} GROUP BY 1) t ON a.depot = t.depot
  JOIN (SELECT depot, COUNT(DISTINCT outlet_code) AS outlet_count FROM {depot_points} GROUP BY 1) c ON a.depot = c.depot
  JOIN (SELECT depot, ARRAY_TO_STRING(LIST(district ORDER BY n DESC, district)[1:3], ', ') AS top_districts FROM (
      SELECT depot, district, COUNT(DISTINCT outlet_code) AS n FROM {depot_points} GROUP BY 1, 2) GROUP BY 1) d ON a.depot = d.depot""")  # fmt: skip
def agg_30(v: Views) -> DataFrame:
    return rounded(as_text(fc.depot_rollup(depot_points(v), v.outlets), "top_districts"), 6, "momentum")


@query("agg_31_state_rollup", """
  SELECT district, kind, CAST(date AS VARCHAR) AS date, ROUND(SUM(value), 3) AS value, GROUPING(district) = 1 AS is_total FROM {dpoints}
  GROUP BY GROUPING SETS ((district, kind, date), (kind, date))""")  # fmt: skip
def agg_31(v: Views) -> DataFrame:
    p = fc.explode_points(forecast(v), "district")
    s = fc.state_rollup(p, "district").withColumn("is_total", F.col("is_total") == 1)
    return as_text(rounded(s, 3, "value"), "date")


@query("agg_32_outlook", """
  SELECT ROUND(SUM(value) FILTER (WHERE h = 1), 3) AS tomorrow, ROUND(SUM(value) FILTER (WHERE h <= 7), 3) AS week,
    (SELECT ROUND(AVG(LEAST(0.95, GREATEST(0.4, 1 - cv * 0.5))), 6) FROM {tail}) AS confidence FROM {ahead}""")  # fmt: skip
def agg_32(v: Views) -> DataFrame:
    return rounded(rounded(fc.outlook(forecast(v)), 3, "tomorrow", "week"), 6, "confidence")


@query("agg_33_forecast_quality", """
  SELECT ROUND(AVG(CASE best_model WHEN 'naive_last' THEN naive_last_mape WHEN 'seasonal_naive_7d' THEN seasonal_naive_7d_mape
      ELSE moving_avg_7d_mape END), 6) AS mean_mape, ROUND((AVG(ROUND_EVEN(uplift * 100, 0) / 100) - 1) * 100, 6) AS weekend_uplift_pct,
    ROUND((COUNT(*) FILTER (WHERE up) - COUNT(*) FILTER (WHERE NOT up)) / COUNT(*), 6) AS trend_bias
  FROM {metrics} m JOIN {tail} t ON m.district = t.district""")  # fmt: skip
def agg_33(v: Views) -> DataFrame:
    return rounded(fc.quality(forecast(v)), 6, "mean_mape", "weekend_uplift_pct", "trend_bias")


@query("jn_11_districts_with_forecast", """
  SELECT r.district, ROUND(r.rev, 2) AS recent30_revenue, m.best_model FROM (SELECT district, SUM(recent30_value) AS rev FROM {feats} GROUP BY 1) r
  LEFT JOIN {metrics} m ON r.district = m.district ORDER BY 2 DESC""")  # fmt: skip
def jn_11(v: Views) -> DataFrame:
    d = ft.outlet_features(v.sales, v.outlets, as_of(), RECENT).groupBy("district").agg(F.sum("recent30_value").alias("recent30_revenue"))
    j = d.join(forecast(v).select("district", "best_model"), "district", "left")
    return rounded(j.orderBy(F.desc("recent30_revenue"), "district"), 2, "recent30_revenue")


@query("flt_14_range_slice", """
  SELECT district, COUNT(*) FILTER (WHERE i > n - 7) AS last7, COUNT(*) FILTER (WHERE date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31') AS q1,
    SUM(y) FILTER (WHERE i > n - 7) AS total7 FROM {series} GROUP BY 1""")  # fmt: skip
def flt_14(v: Views) -> DataFrame:
    s = series(v)
    pts = s.select("district", F.inline(F.arrays_zip(F.sequence("first_date", "last_date").alias("date"), F.col("y").alias("value")))).toDF("district", "date", "value")
    a = fc.slice_points(pts, "district", days=7).groupBy("district").agg(F.count(F.lit(1)).alias("last7"), F.sum("value").alias("total7"))
    lo, hi = F.lit("2000-01-01").cast("date"), F.lit("2000-03-31").cast("date")
    b = fc.slice_points(pts, "district", first=lo, last=hi).groupBy("district").agg(F.count(F.lit(1)).alias("q1"))
    return a.join(b, "district")


@query("arr_03_cyclic_lookup", """
  SELECT district, ARRAY_TO_STRING(LIST(CAST(CAST(value AS BIGINT) AS VARCHAR) ORDER BY h), ' ') AS fc FROM (
    SELECT district, h, last7[(h - 1) % 7 + 1] AS value FROM {tail} CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(1, 14)) AS h)) GROUP BY 1""")  # fmt: skip
def arr_03(v: Views) -> DataFrame:
    f = fc.project(series(v), "seasonal_naive_7d")
    return f.select("district", F.array_join(F.transform("forecast_next_14d", lambda p: p["value"].cast("long").cast("string")), " ").alias("fc"))


@query("ts_13_scenarios", """
  SELECT scenario_id, base AS baseline, ROUND(base * p * 0.6 + base * q * 0.1 - base * (r / 30.0) * 0.5 + COALESCE(own, 0) * u * 0.5, 3) AS projected_delta,
    ROUND((base * p * 0.6 + base * q * 0.1 - base * (r / 30.0) * 0.5 + COALESCE(own, 0) * u * 0.5) / base, 9) AS projected_pct,
    CASE WHEN c > 0.7 THEN 'Low' WHEN c > 0.5 THEN 'Medium' ELSE 'High' END AS risk, ROUND_EVEN(c * 100, 0) / 100 AS confidence
  FROM (SELECT s_suppkey AS scenario_id, (s_suppkey % 7)::DOUBLE / 16 AS p, (s_suppkey % 5)::DOUBLE / 8 AS q, (s_suppkey % 4)::DOUBLE AS r,
      (s_suppkey % 3)::DOUBLE / 4 AS u, d.rev AS own, (SELECT SUM(recent30_value) FROM {feats}) AS base,
      GREATEST(0.35, 0.8 - ABS((s_suppkey % 7)::DOUBLE / 16 + (s_suppkey % 5)::DOUBLE / 8) * 0.5) AS c
    FROM supplier LEFT JOIN (SELECT district, SUM(recent30_value) AS rev FROM {feats} GROUP BY 1) d ON d.district = 'NATION_' || s_nationkey)""")  # fmt: skip
def ts_13(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    sc = v.supplier.select(
        k.alias("scenario_id"), ((k % 7) / 16).alias("premium_mix_delta"), ((k % 5) / 8).alias("sku_prune_pct"),
        (k % 4).cast("double").alias("route_delay_days"), ((k % 3) / 4).alias("event_uplift"),
        F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("event_district"))
    d = ft.outlet_features(v.sales, v.outlets, as_of(), RECENT).groupBy("district").agg(F.sum("recent30_value").alias("recent30_revenue"))
    out = rounded(rounded(fc.simulate(sc, d), 3, "projected_delta"), 9, "projected_pct")
    return out.select("scenario_id", "baseline", "projected_delta", "projected_pct", "risk", "confidence")

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import dates, text
from tallyworks.operators import forecast as fc
from tallyworks.operators import models
from tallyworks.operators import retail as rt
from tallyworks.sinks import tables as snk


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first().y


def test_text_helpers(spark):
    assert one(spark, text.clean_name("x"), "  M/s. A &amp;amp; B  &lt;x&gt; ") == "M/s. A & B <x>"
    assert one(spark, text.clean_name("x"), "Caf&eacute; &#38; Bar &#x20b9;5 D&apos;S &#8377 &nope; &#0; &#128;&nbsp;&") == "Café & Bar ₹5 D'S ₹ &nope; \ufffd € &"
    assert one(spark, text.clean_name("x"), None) == ""
    assert one(spark, text.leading_code("x"), "1713282-M/s. Foo Bar") == "1713282"
    assert one(spark, text.leading_code("x"), "1234-Foo") is None
    assert one(spark, text.leading_code("x"), "123456789-Foo") is None
    assert [one(spark, text.depot_code("x"), v) for v in ("98-Depot", "098-Depot", "1234-Depot", "7-x")] == ["098", "098", "1234", None]
    assert one(spark, text.strip_depot("x"), "098-Excise Depot &amp; Co") == "Excise Depot & Co"
    assert str(one(spark, text.money("x"), "Rs. 18,45,00,000.50")) == "184500000.50"
    assert one(spark, text.money("x", drop_point=True), "12.50") == 1250
    assert one(spark, text.money("x", drop_point=True), "Rs 10") is None
    assert one(spark, text.strip_fences("x"), 'a ```json\n{"a": 1}\n``` b') == '{"a": 1}'
    assert one(spark, text.guess_language("x"), "తెలుగు text") == "te"
    assert one(spark, text.guess_language("x"), "plain text") == "en"
    assert one(spark, text.safe_file_name("x", 12), "..a b/c-very-long.pdf") == "a_b_c-ve.pdf"


def test_dates(spark):
    for v in ("05-03-2025", "2025-03-05", "05/03/2025"):
        assert one(spark, dates.parse_date("x"), v) == dt.date(2025, 3, 5)
    assert one(spark, dates.parse_date("x"), "03/25/2025") == dt.date(2025, 3, 25)
    assert one(spark, dates.parse_date("x"), "soon") is None


def test_daily_sales(spark):
    outlets = rt.build_outlets(spark.createDataFrame(
        [("1713282", "A &amp; B", "x", "D1", "C1", "098-Depot One", 16.1, 80.2, "Active", "A4"),
         ("2222222", "No sales", "x", "D2", "C1", "12-Depot Two", None, None, "Active", None)],
        "code string, name string, address string, district string, circle string, depot string, lat double, lng double, status string, "
        "vendor_type string"))  # fmt: skip
    monthly = spark.createDataFrame(
        [("1713282-M/s. Foo", dt.date(2025, 1, 1), 1, 2, 14, 100.0), ("1713282-M/s. Foo", dt.date(2025, 1, 2), 1, 2, 14, 50.0),
         ("bad", dt.date(2025, 1, 3), 1, 1, 1, 1.0)],
        "vendor_id string, date date, cases int, bottles int, total_bottles int, sale_value double")
    yearly = spark.createDataFrame(
        [("1713282-Foo", "01-01-2025", "98-D", "9", "x", "9", "100.0"), ("1713282-Foo", "02-01-2025", "98-D", "9", None, "9", "70.5"),
         ("1713282-Foo", "someday", "98-D", "9", "1", "9", "1")],
        "vendor_id string, date_raw string, depot_raw string, cases string, bottles string, total_bottles string, sale_value string")
    got = {r.date.day: r for r in rt.build_sales_daily(monthly, yearly, outlets).collect()}
    assert len(got) == 2
    assert got[1].cases == 1 and got[1].depot_code == "098"  # equal values: the first feed wins, depot from the master
    assert got[2].cases == 9 and got[2].bottles == 0 and got[2].sale_value == 70.5
    assert got[1].district == "D1"


def test_label_flags_exclude_each_other(spark):
    rows = spark.createDataFrame([("Renewal",), ("New Label",), ("Renewal of New Label",), (None,)], "label_category string")
    rows = rows.withColumn("approval_date", F.lit("2025-05-01").cast("date"))
    got = [(r.is_renewal, r.is_new, r.ym) for r in rt.label_flags(rows).collect()]
    assert got == [(True, False, "2025-05"), (False, True, "2025-05"), (True, False, "2025-05"), (False, False, "2025-05")]


def test_profile_and_key(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "b", "x")], "outlet_code int, kind string, note string")
    prof = {r.name: r for r in rt.column_profile(df).collect()}
    assert prof["note"].null_pct == 33.33 and prof["note"].n_unique == 1 and prof["kind"].sample == ["a", "b"]
    assert rt.likely_key(rt.column_profile(df)).first().primary_key == "outlet_code"
    audit = rt.audit_failures(rt.audit_tables({"t": df}), {"u": "missing file"})
    assert audit.where("error is not null").first().table == "u"


def series(spark, values, start=dt.date(2025, 1, 1)):
    rows = [("k", start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values) if v is not None]
    return fc.daily_series(spark.createDataFrame(rows, "k string, date date, v double"), "k", "v")


def test_gaps_are_filled_with_zero(spark):
    vals = [5, None, None, 7] + [1] * 12 + [None, 2]
    got = series(spark, vals).first()
    assert got.y == [float(v or 0) for v in vals]
    assert got.active_days == 15 and got.last_date == dt.date(2025, 1, 18)


def test_short_series_has_no_training_part(spark):
    got = fc.backtest(series(spark, range(1, 15))).first()
    assert got.train == [] and got.naive_last is None and got.seasonal_naive_7d is None and got.best_model is None
    assert fc.daily_series(spark.createDataFrame([("k", dt.date(2025, 1, 1), 1.0)], "k string, date date, v double"), "k", "v").count() == 0


def test_backtest_prefers_the_weekly_pattern(spark):
    week = [10, 20, 30, 40, 50, 60, 70]
    got = fc.confidence(fc.project(fc.backtest(series(spark, week * 6)), "best_model")).first()
    assert got.best_model == "seasonal_naive_7d" and got.seasonal_naive_7d_mae == 0
    assert [p.value for p in got.forecast_next_14d] == week * 2
    assert got.forecast_next_14d[0].date == dt.date(2025, 2, 12)
    assert len(got.actual_last_28d) == 28 and 0.4 <= got.confidence <= 0.95


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, t string, seq int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1), (3, "e", 2)], "id int, t string, seq int")
    m = snk.upsert(old, new, ["id"], ["seq"])
    assert sorted((r.id, r.t) for r in m.collect()) == [(1, "a"), (2, "c"), (3, "e")]
    assert snk.upsert(m, new, ["id"], ["seq"]).count() == 3


def test_forest_finds_planted_outliers(spark):
    rows = [(str(i), float(i % 10), float(i % 7) / 10, 0.0, 1.0, False) for i in range(300)]
    rows += [(f"odd{i}", 500.0 + i, 9.0, 5.0, -90.0, True) for i in range(6)]
    df = spark.createDataFrame(rows, "outlet_code string, avg_daily_value double, volatility double, growth_30d double, trend_slope double, dormant boolean")
    got = models.anomalies(df, trees=40).collect()
    flagged = {r.outlet_code for r in got if r.anomaly}
    assert {f"odd{i}" for i in range(6)} <= flagged
    assert abs(len(flagged) / len(got) - 0.08) < 0.02
    assert all((r.anomaly_reason is not None) == r.anomaly for r in got)


def test_segments_are_named(spark):
    rows = [(str(i), float(10 ** (i % 3)), float(100 * 10 ** (i % 3)), 0.1 * (i % 3), 1.0 * (i % 3), 0.0, i % 30) for i in range(60)]
    df = spark.createDataFrame(rows, "outlet_code string, avg_daily_value double, total_sale_value double, volatility double, trend_slope double, "
                                     "growth_30d double, active_days int")  # fmt: skip
    out, centroids = models.segment(df, k=3, restarts=2)
    names = models.name_clusters(centroids)
    assert names.count() == 3 and names.select("segment").distinct().count() == 3
    assert out.groupBy("cluster_id").count().count() == 3


def test_forest_draws_rows_at_any_size():
    for n in (1, 100, 10**6, 10**9, 10**12):
        assert n * models.drawn_share(n, 256) == pytest.approx(min(n, 320))

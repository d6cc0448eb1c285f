"""The forms for huge groups must equal the plain ones, and both must equal pandas."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyworks.functions import ranking as rk
from tallyworks.functions.skew import join_stats
from tallyworks.operators import features as ft


@pytest.fixture(scope="module")
def rows(spark):
    # Group 'a' holds two thirds of the rows; values repeat; one null group, some null values.
    data = [(i, "a" if i % 3 else ("b" if i % 2 else None), None if i % 17 == 0 else float((i * 7) % 23)) for i in range(400)]
    return spark.createDataFrame(data, "id int, g string, v double")


def as_pandas(rows):
    return pd.DataFrame([(r.id, r.g, r.v) for r in rows.collect()], columns=["id", "g", "v"])


@pytest.mark.parametrize("hot", [0, 10**9])
def test_percent_rank_in_groups(rows, hot):
    got = {r.id: r.p for r in rk.percent_rank_avg(rows, ["g"], "v", "p", ["id"], hot).collect()}
    pdf = as_pandas(rows)
    want = pdf.groupby("g", dropna=False)["v"].rank(pct=True, na_option="bottom")
    assert got == pytest.approx(dict(zip(pdf["id"], want)))


@pytest.mark.parametrize("hot", [0, 10**9])
def test_percent_rank_of_all(rows, hot):
    got = {r.id: r.p for r in rk.percent_rank_avg(rows, [], "v", "p", ["id"], hot).collect()}
    pdf = as_pandas(rows)
    assert got == pytest.approx(dict(zip(pdf["id"], pdf["v"].rank(pct=True, na_option="bottom"))))


@pytest.mark.parametrize("hot", [0, 10**9])
@pytest.mark.parametrize("q", [0.5, 0.92])
def test_quantiles(rows, hot, q):
    keyed = rows.where("g is not null")
    got = {r.g: r.m for r in rk.group_quantile(keyed, ["g"], "v", q, "m", hot).collect()}
    pdf = as_pandas(keyed)
    assert got == pytest.approx(pdf.groupby("g")["v"].quantile(q).to_dict())
    one = rk.group_quantile(keyed, [], "v", q, "m", hot).first().m
    assert one == pytest.approx(pdf["v"].quantile(q))


@pytest.mark.parametrize("hot", [0, 10**9])
def test_row_numbers_and_ranks(rows, hot):
    keyed = rows.where("v is not null")
    got = {r.id: r["rank"] for r in rk.row_numbers(keyed, ["g"], ["v", "id"], "rank", hot).collect()}
    pdf = as_pandas(keyed).sort_values(["v", "id"])
    pdf["n"] = pdf.groupby("g", dropna=False).cumcount() + 1
    assert got == dict(zip(pdf["id"], pdf["n"]))
    low = {r.id: r.k for r in rk.rank_min(keyed, ["g"], "v", "k", ["id"], hot).collect()}
    want = pdf.groupby("g", dropna=False)["v"].rank(method="min")
    assert low == pytest.approx(dict(zip(pdf["id"], want)))


@pytest.mark.parametrize("hot", [0, 50, 10**9])
def test_join_stats_keeps_every_row(rows, hot):
    st = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
    got = join_stats(rows, st, ["g"], "n", ["id"], hot)
    assert got.count() == 400
    assert got.where("n is null").count() == 0


@pytest.mark.parametrize("hot", [0, 10**9])
def test_upper_peer_median(spark, hot):
    data = [(str(i), "d1" if i < 7 else "d2", float((i * 5) % 7)) for i in range(10)] + [("x", "d3", 1.0)]
    df = spark.createDataFrame(data, "outlet_code string, district string, avg_daily_value double")
    got = {r.outlet_code: r.peer_upper_median for r in ft.upper_peer_median(df, hot=hot).collect()}
    for c, d, _ in data:
        others = sorted(v for c2, d2, v in data if d2 == d and c2 != c)
        assert got[c] == (others[len(others) // 2] if others else 0.0)


def test_scores_do_not_depend_on_partitions(spark):
    from tallyworks.plans.retail import RECENT
    from tallyworks.plans.registry import as_of
    from tallyworks.sources.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    f = ft.outlet_features(v.sales, v.outlets, as_of(), RECENT)

    def scores(df, hot):
        return {r.outlet_code: round(r.opportunity_score, 9) for r in ft.opportunity_scores(df, hot=hot).collect()}

    assert scores(f, 10**9) == scores(f.repartition(7), 0)

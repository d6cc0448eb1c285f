"""Short-horizon forecasts per group, with a hold-out test of three baselines.

After the daily sums a group has at most one value per calendar day, so its
whole series is one bounded array on one row.  All steps are array expressions:
no window, no join and no Python, whatever share of the raw rows a group holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.dates import horizon
from tallyworks.functions.numbers import best_key, clamp, col, computed_once, half_even

MODELS = ("naive_last", "seasonal_naive_7d", "moving_avg_7d")


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def mean(arr: Column) -> Column:
    """Mean of an array; null when empty."""
    return total(arr) / F.nullif(F.size(arr), F.lit(0))


def sample_std(arr: Column) -> Column:
    m = mean(arr)
    ss = F.aggregate(F.transform(arr, lambda x: (x - m) * (x - m)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(ss / F.nullif(F.size(arr) - 1, F.lit(0)))


def last_n(arr: str | Column, n: int, skip: int = 0) -> Column:
    """The ``n`` elements before the last ``skip`` ones, or all there are (WIN-10)."""
    a = col(arr)
    stop = F.greatest(F.size(a) - skip, F.lit(0))
    start = F.greatest(stop - n, F.lit(0))
    return F.slice(a, start + 1, stop - start)


def daily_series(df: DataFrame, key: str, value: str, date: str = "date", min_days: int = 14) -> DataFrame:
    """Daily sums, zero-filled from first to last day, as one array per key (TS-01).

    A gap is filled by repeating zero behind the day before it, so no calendar
    has to be joined.
    """
    days = (
        df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
        .groupBy(key, date)
        .agg(F.sum(value).alias("_v"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("d"), F.col("_v").alias("v")))).alias("_s"))
        .where(F.size("_s") >= min_days)
    )
    s = F.col("_s")

    def with_gap(x: Column, i: Column) -> Column:
        nxt = F.coalesce(F.get(s, i + 1)["d"], F.date_add(x["d"], 1))
        return F.concat(F.array(x["v"]), F.array_repeat(F.lit(0.0), F.datediff(nxt, x["d"]) - 1))

    filled = computed_once(days).select(
        key,
        s[0]["d"].alias("first_date"),
        F.element_at(s, -1)["d"].alias("last_date"),
        F.size(s).alias("active_days"),
        F.flatten(F.transform(s, with_gap)).alias("y"),
    )
    return computed_once(filled)


def backtest(series: DataFrame, test_days: int = 14) -> DataFrame:
    """Hold out the last days, forecast them three ways, and measure (TS-02 to TS-07).

    A model that the training part is too short for has null forecasts and null
    errors, and the others compete.
    """
    n = F.size("y")
    cut = F.greatest(n - test_days, F.lit(0))
    df = series.withColumns(
        {"train": F.slice("y", F.lit(1), cut), "test": F.slice("y", cut + 1, n - cut)}
    ).withColumn("_last7", last_n("train", 7))
    df = computed_once(df)
    enough = F.size("_last7") == 7
    day = F.sequence(F.lit(0), F.size("test") - 1)
    seasonal = F.transform(day, lambda i: F.get("_last7", F.pmod(i, F.lit(7))))
    ma = F.when(enough, mean(F.col("_last7"))).otherwise(mean(F.col("train")))
    df = df.withColumns(
        {
            "naive_last": F.get("train", F.size("train") - 1),
            "seasonal_naive_7d": F.when(enough, seasonal),
            "moving_avg_7d": ma,
        }
    )
    df = computed_once(df)

    def flat(m: str) -> Column:
        return F.when(F.col(m).isNotNull(), F.transform("test", lambda _: F.col(m)))

    fc = {
        "naive_last": flat("naive_last"),
        "seasonal_naive_7d": F.col("seasonal_naive_7d"),
        "moving_avg_7d": flat("moving_avg_7d"),
    }
    cols = {}
    for m, f in fc.items():
        err = F.zip_with("test", f, lambda a, b: F.abs(a - b))
        rel = F.zip_with("test", f, lambda a, b: F.when(a > 0, F.abs(a - b) / F.nullif(a, F.lit(0.0))))
        cols[f"{m}_mae"] = mean(err)
        cols[f"{m}_mape"] = mean(F.filter(rel, lambda x: x.isNotNull())) * 100
    df = computed_once(df.withColumns(cols))
    return df.withColumn("best_model", best_key({m: F.col(f"{m}_mae") for m in MODELS})).drop("_last7")


def project(series: DataFrame, model: Column | str, days: int = 14) -> DataFrame:
    """Forward forecast of the full series by the given model (TS-08), packed (TS-11)."""
    m = F.lit(model) if isinstance(model, str) and model in MODELS else col(model)
    series = computed_once(series.withColumns({"_l7": last_n("y", 7), "_l28": last_n("y", 28)}))
    last7, last28 = F.col("_l7"), F.col("_l28")
    step = F.sequence(F.lit(0), F.lit(days - 1))
    flat = F.when(m == "moving_avg_7d", mean(last7)).otherwise(F.element_at("y", -1))
    values = F.when(
        m == "seasonal_naive_7d", F.transform(step, lambda i: F.get(last7, F.pmod(i, F.size(last7))))
    ).otherwise(F.transform(step, lambda _: flat))
    past = F.transform(
        last28,
        lambda v, i: F.struct(F.date_sub("last_date", F.size(last28) - 1 - i).alias("date"), v.alias("value")),
    )
    ahead = F.zip_with(
        horizon("last_date", days), values, lambda d, v: F.struct(d.alias("date"), v.alias("value"))
    )
    return series.withColumns({"actual_last_28d": past, "forecast_next_14d": ahead}).drop("_l7", "_l28")


def weekday_mean(weekend: bool) -> Column:
    """Mean over weekend days or over working days; Monday is 0 (DAT-04)."""

    def wanted(i: Column) -> Column:
        day = F.pmod(F.weekday("first_date") + i, F.lit(7))
        return day >= 5 if weekend else day < 5

    picked = F.filter(F.transform("y", lambda v, i: F.when(wanted(i), v)), lambda v: v.isNotNull())
    return mean(picked)


def confidence(series: DataFrame) -> DataFrame:
    """Confidence from the variation of the last 30 days, and drivers (TS-09, TS-10)."""
    last30 = last_n("y", 30)
    cv = sample_std(last30) / F.greatest(mean(last30), F.lit(1.0))
    up = mean(last_n("y", 14)) > mean(last_n("y", 14, 14))
    uplift = weekday_mean(True) / F.greatest(weekday_mean(False), F.lit(1.0))
    return series.withColumn("_cv", cv).withColumns(
        {
            "confidence": clamp(1 - F.col("_cv") * 0.5, 0.4, 0.95),
            "recent_trend": F.when(up, "up").otherwise("down"),
            "volatility_cv": half_even("_cv", 3),
            "weekend_uplift": half_even(uplift, 2),
        }
    )


def forecast(df: DataFrame, key: str, value: str, as_of: Column, date: str = "date", days: int = 14) -> DataFrame:
    """Best-of-baselines forecast per key, rows up to ``as_of`` only."""
    s = daily_series(df.where(F.col(date) <= as_of), key, value, date)
    out = confidence(project(backtest(s), "best_model", days))
    models = F.create_map(
        *[
            x
            for m in MODELS
            for x in (F.lit(m), F.struct(F.col(f"{m}_mape").alias("mape"), F.col(f"{m}_mae").alias("mae")))
        ]
    )
    return out.withColumn("models", models)


def forecast_top(
    feats: DataFrame, sales: DataFrame, as_of: Column, top: int = 300, key: str = "outlet_code", days: int = 14
) -> DataFrame:
    """Seasonal-naive forecast for the outlets with the largest total (TS-12)."""
    best = feats.orderBy(F.desc("total_sale_value"), key).limit(top).select(key)
    picked = sales.where(F.col("date") <= as_of).join(F.broadcast(best), key, "left_semi")
    return project(daily_series(picked, key, "sale_value"), "seasonal_naive_7d", days)


def explode_points(fc: DataFrame, key: str) -> DataFrame:
    """Long form of the packed arrays: kind, date, value."""
    both = F.concat(
        F.transform("actual_last_28d", lambda p: F.struct(F.lit("actual").alias("kind"), p["date"].alias("date"), p["value"].alias("value"))),
        F.transform("forecast_next_14d", lambda p: F.struct(F.lit("forecast").alias("kind"), p["date"].alias("date"), p["value"].alias("value"))),
    )
    return fc.select(key, F.inline(both))


def depot_name(code: str = "depot_code") -> Column:
    return F.coalesce(F.nullif(F.trim(code), F.lit("")), F.lit("Unassigned"))


def with_depot(points: DataFrame, outlets: DataFrame) -> DataFrame:
    """Depot and district of each forecast outlet, with defaults (JN-10)."""
    o = outlets.select("outlet_code", "depot_code", "district")
    return (
        points.join(o, "outlet_code", "left")
        .withColumn("depot", depot_name())
        .withColumn("district", F.coalesce("district", F.lit("—")))
        .drop("depot_code")
    )


def depot_rollup(points: DataFrame, outlets: DataFrame) -> DataFrame:
    """Depot totals: outlet counts, top districts, momentum, next 14 days (AGG-30, WIN-10, TOP-10).

    ``points`` is the long form with depot and district.  A depot has at most 28
    past and 14 future dates per outlet cohort; sums per (depot, date) come first.
    """
    per_day = points.groupBy("depot", "kind", "date").agg(F.sum("value").alias("v"))
    series = per_day.groupBy("depot").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "actual", F.struct("date", "v")))).alias("a"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "forecast", F.struct("date", "v")))).alias("f"),
    )

    def part(arr: Column) -> Column:
        return total(F.transform(arr, lambda p: p["v"]))

    members = points.select("depot", "district", "outlet_code").distinct()
    per_district = members.groupBy("depot", "district").agg(F.count(F.lit(1)).alias("n"))
    # One row per district of a depot: bounded by the district list.
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("district"))))
    top3 = per_district.groupBy("depot").agg(
        F.sum("n").alias("outlet_count"),
        F.transform(F.slice(ranked, 1, 3), lambda s: s["district"]).alias("top_districts"),
    )
    total_outlets = outlets.groupBy(depot_name().alias("depot")).agg(F.count(F.lit(1)).alias("total_outlets"))
    out = series.select(
        "depot",
        part(last_n("a", 14)).alias("recent14"),
        part(last_n("a", 14, 14)).alias("prev14"),
        part(F.slice("f", 1, 14)).alias("next14_forecast"),
    )
    momentum = F.when(F.col("prev14") > 0, (F.col("recent14") - F.col("prev14")) / F.nullif("prev14", F.lit(0.0)))
    return (
        out.withColumn("momentum", F.coalesce(momentum, F.lit(0.0)))
        .join(top3, "depot", "left")
        .join(total_outlets, "depot", "left")
    )


def state_rollup(points: DataFrame, key: str) -> DataFrame:
    """Sums per (key, date) and per date in one pass (AGG-31, grouping sets)."""
    g = points.groupingSets([[F.col(key), "kind", "date"], ["kind", "date"]], F.col(key), "kind", "date")
    return g.agg(F.sum("value").alias("value"), F.grouping(key).alias("is_total"))


def outlook(fc: DataFrame) -> DataFrame:
    """Tomorrow, next 7 days, mean confidence (AGG-32)."""
    week = total(F.transform(F.slice("forecast_next_14d", 1, 7), lambda p: p["value"]))
    first = F.coalesce(F.get("forecast_next_14d", F.lit(0))["value"], F.lit(0.0))
    return fc.agg(F.sum(first).alias("tomorrow"), F.sum(week).alias("week"), F.avg("confidence").alias("confidence"))


def quality(fc: DataFrame) -> DataFrame:
    """Mean MAPE of the chosen models, weekend uplift %, trend bias (AGG-33)."""
    up, down = F.count_if(F.col("recent_trend") == "up"), F.count_if(F.col("recent_trend") == "down")
    return fc.agg(
        F.avg(F.element_at("models", F.col("best_model"))["mape"]).alias("mean_mape"),
        ((F.avg("weekend_uplift") - 1) * 100).alias("weekend_uplift_pct"),
        ((up - down) / F.nullif(up + down, F.lit(0))).alias("trend_bias"),
    )


def slice_points(points: DataFrame, key: str, days: int | None = None, first: Column | None = None,
                 last: Column | None = None) -> DataFrame:
    """Last ``days`` dates of each key, or an inclusive date range (FLT-14).

    The newest day per key is a map-side maximum; series are daily, so the last
    n rows are the last n days.
    """
    if days is None:
        df = points if first is None else points.where(F.col("date") >= first)
        return df if last is None else df.where(F.col("date") <= last)
    newest = points.groupBy(key).agg(F.max("date").alias("_max"))
    return points.join(newest, key).where(F.datediff("_max", "date") < days).drop("_max")


def simulate(scenarios: DataFrame, districts: DataFrame) -> DataFrame:
    """Linear what-if projection of many scenarios (TS-13).

    scenarios: scenario_id, premium_mix_delta, sku_prune_pct, event_district,
    event_uplift, route_delay_days.  Districts are unique rows with recent30_revenue.
    """
    base = districts.agg(F.coalesce(F.sum("recent30_revenue"), F.lit(0.0))).scalar()
    own = districts.select(F.col("district").alias("event_district"), F.col("recent30_revenue").alias("_own"))
    s = scenarios.join(own, "event_district", "left").withColumn("baseline", base)
    s = s.withColumns(
        {
            "premium_mix": F.col("baseline") * F.col("premium_mix_delta") * 0.6,
            "sku_prune": F.col("baseline") * F.col("sku_prune_pct") * 0.1,
            "route_delay": -F.col("baseline") * (F.col("route_delay_days") / 30) * 0.5,
            "event_impact": F.coalesce("_own", F.lit(0.0)) * F.col("event_uplift") * 0.5,
            "_conf": F.greatest(F.lit(0.35), 0.8 - F.abs(F.col("premium_mix_delta") + F.col("sku_prune_pct")) * 0.5),
        }
    )
    delta = F.col("premium_mix") + F.col("sku_prune") + F.col("route_delay") + F.col("event_impact")
    return s.withColumns(
        {
            "projected_delta": delta,
            "projected_pct": F.coalesce(delta / F.nullif("baseline", F.lit(0.0)), F.lit(0.0)),
            "risk": F.when(F.col("_conf") > 0.7, "Low").when(F.col("_conf") > 0.5, "Medium").otherwise("High"),
            "confidence": half_even("_conf", 2),
        }
    ).drop("_own", "_conf")

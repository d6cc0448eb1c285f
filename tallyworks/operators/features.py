"""Outlet features, peer comparison, opportunity scores, roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.numbers import clamp, col, ratio
from tallyworks.functions.ranking import group_median, percent_ranks, rank_min, row_numbers
from tallyworks.functions.skew import HOT_ROWS, join_stats, largest_group
from tallyworks.session import checkpointed


def not_after(df: DataFrame, as_of: Column, date: str = "date") -> DataFrame:
    """Rows up to the as-of day (FLT-02)."""
    return df.where(F.col(date) <= as_of)


def in_window(date: str | Column, as_of: Column, start: int, stop: int | None = None) -> Column:
    """Days [as_of-start, as_of-stop), or open at the end when ``stop`` is None (FLT-03)."""
    d = col(date)
    inside = d >= F.date_sub(as_of, start)
    return inside if stop is None else inside & (d < F.date_sub(as_of, stop))


def window_sum(value: str, date: str, as_of: Column, start: int, stop: int | None = None) -> Column:
    return F.coalesce(F.sum(F.when(in_window(date, as_of, start, stop), F.col(value))), F.lit(0.0))


def growth(recent: str | Column, previous: str | Column) -> Column:
    return ratio(col(recent) - col(previous), previous)


def outlet_features(
    sales: DataFrame, outlets: DataFrame | None, as_of: Column, recent: int = 30, slope_rows: int = 10,
    hot: int = HOT_ROWS,
) -> DataFrame:
    """Base statistics, trend and window sums per outlet in one aggregate (AGG-01 to 03, JN-02, PRJ-04, JN-03).

    An outlet above ``hot`` rows gets its exact median from prefix counts
    instead of the buffering aggregate.
    """
    s = not_after(sales, as_of)
    small_groups = largest_group(s, ["outlet_code"]) <= hot
    day = F.datediff("date", as_of)
    n = F.count(F.lit(1))
    slope = F.when((n >= slope_rows) & (F.min("date") < F.max("date")), F.regr_slope("sale_value", day.cast("double")))
    g = s.groupBy("outlet_code").agg(
        F.min("date").alias("first_sale"),
        F.max("date").alias("last_sale"),
        F.sum("sale_value").alias("total_sale_value"),
        F.avg("sale_value").alias("avg_daily_value"),
        (F.median("sale_value") if small_groups else F.lit(None).cast("double")).alias("median_daily_value"),
        F.stddev_samp("sale_value").alias("std_daily_value"),
        F.sum("cases").alias("total_cases"),
        F.sum("total_bottles").alias("total_bottles"),
        F.countDistinct("date").alias("active_days"),
        F.coalesce(slope, F.lit(0.0)).alias("trend_slope"),
        window_sum("sale_value", "date", as_of, recent).alias("recent30_value"),
        window_sum("sale_value", "date", as_of, 2 * recent, recent).alias("prev30_value"),
    )
    if not small_groups:
        med = group_median(s, ["outlet_code"], "sale_value", "median_daily_value", hot).drop("_n")
        g = g.drop("median_daily_value").join(med, "outlet_code", "left")
    g = g.withColumns(
        {
            "growth_30d": growth("recent30_value", "prev30_value"),
            "volatility": ratio("std_daily_value", "avg_daily_value"),
            "dormant": F.datediff(as_of, "last_sale") > recent,
        }
    )
    if outlets is None:
        return g
    attrs = outlets.select(
        "outlet_code", "outlet_name", "district", "depot_code", "circle", "vendor_type", "lat", "lng"
    )
    return g.join(attrs, "outlet_code", "left")


def peer_median(
    feats: DataFrame, keys: Sequence[str], value: str, out: str, row_id: str = "outlet_code", hot: int = HOT_ROWS
) -> DataFrame:
    """Median of the peer group on every row; null group keys give null (WIN-01)."""
    keyed = feats.dropna(subset=list(keys))
    med = group_median(keyed, keys, value, out, hot)
    return join_stats(feats, med, keys, "_n", [row_id], hot).drop("_n")


def opportunity_scores(
    feats: DataFrame, keys: Sequence[str] = ("district", "vendor_type"), row_id: str = "outlet_code",
    hot: int = HOT_ROWS,
) -> DataFrame:
    """Peer gap, growth, stability and activity ranks combined to 0..100 (RUL-01)."""
    # Written twice, one row per outlet: five ranks and medians read these frames.
    f = peer_median(checkpointed(feats), keys, "avg_daily_value", "peer_avg", row_id, hot)
    f = checkpointed(f.withColumn("peer_gap", clamp(F.col("peer_avg") - F.col("avg_daily_value"), 0.0)))
    ranks = {"_gap": (keys, "peer_gap"), "growth_component": ([], "growth_30d"), "_vol": ([], "volatility"), "activity_component": ([], "active_days")}
    f = percent_ranks(f, ranks, row_id, hot)
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    f = f.withColumns(
        {
            "peer_gap_pct": F.when(keyed, F.col("_gap")).otherwise(0.0),
            "stability_component": 1 - F.col("_vol"),
            "estimated_uplift_inr": F.col("peer_gap") * 30,
        }
    )
    score = (
        0.35 * F.col("peer_gap_pct")
        + 0.25 * F.col("growth_component")
        + 0.2 * F.col("stability_component")
        + 0.2 * F.col("activity_component")
    ) * 100
    return f.withColumn("opportunity_score", score).drop("_gap", "_vol")


def peer_zscore(
    feats: DataFrame, keys: Sequence[str], value: str, out: str = "peer_z", row_id: str = "outlet_code",
    hot: int = HOT_ROWS,
) -> DataFrame:
    """Distance from the peer mean in sample standard deviations (ML-05)."""
    st = feats.groupBy(*keys).agg(
        F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    j = join_stats(feats, st, keys, "_n", [row_id], hot)
    return j.withColumn(out, ratio(F.col(value) - F.col("_m"), "_s")).drop("_m", "_s", "_n")


def peer_rank(
    feats: DataFrame, key: str = "district", value: str = "avg_daily_value", row_id: str = "outlet_code",
    hot: int = HOT_ROWS,
) -> DataFrame:
    """1 + number of peers with a lower value, and the peer count (WIN-07)."""
    size = feats.groupBy(key).agg(F.count(F.lit(1)).alias("peers"))
    ranked = rank_min(feats, [key], value, "peer_rank", [row_id], hot)
    return join_stats(ranked, size, [key], "peers", [row_id], hot)


def upper_peer_median(
    feats: DataFrame, key: str = "district", value: str = "avg_daily_value", row_id: str = "outlet_code",
    hot: int = HOT_ROWS,
) -> DataFrame:
    """Element at floor(n/2) of the sorted peers without the row itself (WIN-11).

    With m rows in the group and the row at position p, the answer is position
    k=floor((m-1)/2) of the others: the group's element k when p > k, else k+1.
    So two elements per group are enough, and no peer list is built.
    """
    keyed = feats.where(F.col(key).isNotNull())
    ranked = row_numbers(keyed, [key], [value, row_id], "_p", hot)
    size = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("_m"))
    pos = checkpointed(join_stats(ranked, size, [key], "_m", [row_id], hot))
    k = F.floor((F.col("_m") - 1) / 2)
    at = pos.groupBy(key).agg(
        F.max(F.when(F.col("_p") - 1 == k, F.col(value))).alias("_lo"),
        F.max(F.when(F.col("_p") - 1 == k + 1, F.col(value))).alias("_hi"),
        F.max("_m").alias("_gm"),
    )
    j = join_stats(pos, at, [key], "_gm", [row_id], hot)
    med = F.when(F.col("_p") - 1 > k, F.col("_lo")).otherwise(F.col("_hi"))
    return j.withColumn("peer_upper_median", F.coalesce(med, F.lit(0.0))).drop("_p", "_m", "_lo", "_hi", "_gm")


def recommendation_confidence() -> Column:
    """Confidence of an outlet recommendation (PRJ-07); a capped volatility of 0 counts as 0.5."""
    v = F.least(F.lit(1.0), F.col("volatility"))
    v = F.when(v.isNull() | (v == 0), F.lit(0.5)).otherwise(v)
    cover = F.least(F.lit(1.0), F.col("active_days") / 90)
    return F.when(F.col("dormant"), 0.85).otherwise(F.least(F.lit(0.95), 0.4 + cover * 0.5 - v * 0.2))


def district_rollup(feats: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """One row per district; rows without a district are left out (AGG-06)."""
    f = feats.where(F.col("district").isNotNull())
    aggs = [
        F.count("outlet_code").alias("outlets"),
        F.count_if(F.col("active_days") > 0).alias("active_outlets"),
        F.count_if("dormant").alias("dormant_outlets"),
        F.sum("total_sale_value").alias("total_revenue"),
        F.sum("recent30_value").alias("recent30_revenue"),
    ]
    for c in ("opportunity_score", "anomaly"):
        if c in feats.columns:
            aggs.append(F.avg(c).alias("mean_opportunity") if c == "opportunity_score" else F.count_if(c).alias("anomalies"))
    med = group_median(f, ["district"], "growth_30d", "avg_growth", hot).drop("_n")
    return f.groupBy("district").agg(*aggs).join(med, "district", "left")


def vendor_rollup(feats: DataFrame) -> DataFrame:
    """Outlets, active outlets, revenue and mean per vendor type (AGG-16)."""
    return feats.groupBy("vendor_type").agg(
        F.count("outlet_code").alias("outlets"),
        F.count_if(~F.col("dormant")).alias("active"),
        F.sum("recent30_value").alias("revenue_30d"),
        F.avg("avg_daily_value").alias("avg_daily"),
    )


def district_scores(districts: DataFrame, top: int = 5) -> DataFrame:
    """Districts that need action first: 2*anomalies + dormant/outlets (AGG-34)."""
    score = F.col("anomalies") * 2 + F.col("dormant_outlets") / F.greatest("outlets", F.lit(1))
    return districts.withColumn("score", score).orderBy(F.desc("score"), "district").limit(top)


def valid_coordinates(outlets: DataFrame) -> DataFrame:
    """Outlets with usable coordinates (FLT-10)."""
    return outlets.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & (F.col("lat") != 0) & (F.col("lng") != 0))

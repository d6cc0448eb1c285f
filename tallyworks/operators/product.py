"""Product, supplier and label-approval intelligence."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions.numbers import half_even
from tallyworks.operators.retail import BANDS

# Expected share of each price band by outlet class.
PRIORS: Mapping[str, Mapping[str, float]] = {
    "Bars": {"Economy": 0.20, "Value": 0.35, "Premium": 0.35, "Luxury": 0.10},
    "Clubs": {"Economy": 0.05, "Value": 0.25, "Premium": 0.50, "Luxury": 0.20},
    "Tourism": {"Economy": 0.05, "Value": 0.20, "Premium": 0.50, "Luxury": 0.25},
    "A4": {"Economy": 0.40, "Value": 0.35, "Premium": 0.20, "Luxury": 0.05},
}
DEFAULT_CLASS = "A4"
# Weights of the supplier aggression score.
AGGRESSION = (
    ("new_labels_180d", 0.40),
    ("pack_sizes_touched", 0.25),
    ("brands_touched", 0.20),
    ("active_months", 0.15),
)


def _n(c: str) -> Column:
    return F.countDistinct(c)


def _flag(c: str) -> Column:
    return F.count_if(c)


def density(products: DataFrame) -> DataFrame:
    """SKU counts by band, bucket and category, null keys kept (AGG-07)."""
    return products.groupBy("price_band", "pack_bucket", "category").agg(F.count(F.lit(1)).alias("sku_count"))


def label_timeline(labels: DataFrame) -> DataFrame:
    """New, renewals and total per month with the change to the month before (AGG-08, WIN-05).

    The window runs over one row per month.
    """
    m = labels.groupBy("ym").agg(
        _flag("is_new").alias("new_labels"), _flag("is_renewal").alias("renewals"), F.count("application_no").alias("total")
    )
    prev = F.lag("total").over(Window.orderBy("ym"))
    return m.withColumn("mom_delta", F.coalesce(F.col("total") - prev, F.lit(0)))


def supplier_aggression(labels: DataFrame, since: Column, top: int | None = 20) -> DataFrame:
    """Weighted, max-normalised activity of each distillery (AGG-09)."""
    g = labels.where(F.col("approval_date") >= since).groupBy("distillery").agg(
        _flag("is_new").alias("new_labels_180d"),
        _flag("is_renewal").alias("renewals_180d"),
        F.count("application_no").alias("total_labels_180d"),
        _n("size_ml").alias("pack_sizes_touched"),
        _n("brand_name").alias("brands_touched"),
        _n("ym").alias("active_months"),
        F.avg("mrp").alias("mean_mrp"),
    )
    maxima = g.agg(F.struct(*[F.max(c).alias(c) for c, _ in AGGRESSION])).scalar()
    g = g.withColumn("_max", maxima)
    score = F.lit(0.0)
    for c, w in AGGRESSION:
        score = score + F.coalesce(F.col(c) / F.nullif(F.col(f"_max.{c}"), F.lit(0)), F.lit(0.0)) * w
    g = g.withColumn("aggression_score", half_even(score, 3)).drop("_max")
    return g if top is None else g.orderBy(F.desc("aggression_score"), F.asc_nulls_last("distillery")).limit(top)


def brand_labels(labels: DataFrame, since: Column) -> DataFrame:
    """New and renewed labels per brand (AGG-10)."""
    g = labels.where(F.col("approval_date") >= since).groupBy("brand_name").agg(
        _flag("is_new").alias("new_labels"),
        _flag("is_renewal").alias("renewals"),
        _n("distillery").alias("distilleries"),
        _n("size_ml").alias("pack_sizes"),
        F.min("approval_date").alias("first_approval"),
        F.max("approval_date").alias("last_approval"),
    )
    t = F.col("new_labels") + F.col("renewals")
    return g.withColumns(
        {"total": t, "new_share": half_even(F.col("new_labels") / F.greatest(t, F.lit(1)), 3)}
    )


def emerging(brand_lbl: DataFrame, top: int = 20) -> DataFrame:
    df = brand_lbl.where("new_share >= 0.5 AND new_labels >= 1")
    return df.orderBy(F.desc("new_labels"), F.desc("pack_sizes"), "brand_name").limit(top)


def renewal_heavy(brand_lbl: DataFrame, top: int = 20) -> DataFrame:
    return brand_lbl.where("renewals >= 2 AND new_share <= 0.33").orderBy(F.desc("renewals"), "brand_name").limit(top)


def supplier_timeline(labels: DataFrame, aggression: DataFrame, top: int = 10) -> DataFrame:
    """Labels per month of the most active suppliers (AGG-11)."""
    best = (
        aggression.where(F.col("distillery").isNotNull())
        .orderBy(F.desc("aggression_score"), "distillery")
        .limit(top)
        .select("distillery")
    )
    return (
        labels.join(F.broadcast(best), "distillery", "left_semi")
        .groupBy("distillery", "ym")
        .agg(F.count(F.lit(1)).alias("labels"))
    )


def overcrowded(products: DataFrame, least: int = 10, top: int = 15) -> DataFrame:
    """SKUs per brand by category and band (AGG-12)."""
    g = products.groupBy("category", "price_band").agg(
        _n("product_code").alias("sku_count"),
        _n("brand_code").alias("brand_count"),
        _n("supplier_code").alias("supplier_count"),
        F.avg("mrp").alias("mean_mrp"),
    )
    d = half_even(F.col("sku_count") / F.greatest("brand_count", F.lit(1)), 2)
    return (
        g.withColumn("density_score", d)
        .where(F.col("sku_count") >= least)
        .orderBy(F.desc("sku_count"), F.desc("density_score"), "category", "price_band")
        .limit(top)
    )


def pack_proliferation(products: DataFrame, least: int = 3, top: int = 20) -> DataFrame:
    """Brands in many sizes, with the sorted size list (AGG-13)."""
    g = products.groupBy("brand_name", "brand_type").agg(
        _n("size_ml").alias("pack_sizes"),
        _n("product_code").alias("sku_count"),
        F.array_sort(F.collect_set(F.col("size_ml").cast("int"))).alias("pack_list"),
        _n("distillery").alias("distilleries"),
    )
    return (
        g.where(F.col("pack_sizes") >= least)
        .orderBy(F.desc("pack_sizes"), F.desc("sku_count"), "brand_name", "brand_type")
        .limit(top)
    )


def redundancy(products: DataFrame, least: int = 3, top: int = 50) -> DataFrame:
    """Cannibalisation score of brand x bucket (AGG-14)."""
    g = (
        products.groupBy("brand_name", "pack_bucket")
        .agg(
            _n("product_code").alias("sku_count"),
            F.coalesce(F.max("mrp") - F.min("mrp"), F.lit(0.0)).alias("price_spread"),
            _n("supplier_code").alias("supplier_count"),
        )
        .where(F.col("sku_count") >= least)
    )
    widest = F.greatest(g.agg(F.max("price_spread")).scalar(), F.lit(1.0))
    score = (
        (F.col("sku_count") - 1) * 0.3 + (F.col("supplier_count") - 1) * 0.2 + F.col("price_spread") / widest * 0.5
    )
    return (
        g.withColumn("cannibalization_score", half_even(score, 2))
        .orderBy(F.desc("cannibalization_score"), F.desc("sku_count"), "brand_name", "pack_bucket")
        .limit(top)
    )


def catalogue_mix(products: DataFrame) -> DataFrame:
    """Share of distinct SKUs per price band (AGG-15)."""
    g = (
        products.where(F.col("price_band").isin(*BANDS))
        .groupBy("price_band")
        .agg(_n("product_code").alias("sku_count"))
    )
    return g.withColumn(
        "share", half_even(F.col("sku_count") / F.greatest(g.agg(F.sum("sku_count")).scalar(), F.lit(1)), 3)
    )


def fit_profile(
    vendors: DataFrame, mix: DataFrame, priors: Mapping[str, Mapping[str, float]] = PRIORS, default: str = DEFAULT_CLASS
) -> DataFrame:
    """Catalogue share against the expected share per outlet class and band (JN-05, AGG-17).

    The four bands are unpacked from a literal per class; unknown classes use
    the default prior.
    """

    def target(band: str) -> Column:
        out = None
        for name, shares in priors.items():
            hit = F.col("vendor_type") == name
            out = F.when(hit, F.lit(shares[band])) if out is None else out.when(hit, F.lit(shares[band]))
        return out.otherwise(F.lit(priors[default][band]))

    bands = F.array(
        *[F.struct(F.lit(b).alias("price_band"), target(b).alias("target_pct")) for b in priors[default]]
    )
    cells = vendors.select("vendor_type", "outlets", F.col("active").alias("active_outlets"), "revenue_30d",
                           F.inline(bands))
    # The mix has one row per band.
    m = F.broadcast(mix.select("price_band", F.col("share").alias("_share")))
    gap = F.col("gap_pct")
    return (
        cells.join(m, "price_band", "left")
        .withColumn("catalog_pct", F.coalesce("_share", F.lit(0.0)))
        .withColumn("gap_pct", half_even(F.col("catalog_pct") - F.col("target_pct"), 3))
        .withColumn(
            "direction",
            F.when(gap < -0.05, "under-represented").when(gap > 0.05, "over-represented").otherwise("aligned"),
        )
        .drop("_share")
    )


def fit_grid(profile: DataFrame) -> DataFrame:
    """Gap per class and band as a grid (AGG-38)."""
    return profile.groupBy("vendor_type").pivot("price_band", list(BANDS)).agg(F.max("gap_pct"))


def mix(products: DataFrame, *keys: str) -> DataFrame:
    """Rows, distinct SKUs, brands and suppliers of a grouping (AGG-18)."""
    return products.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        _n("product_code").alias("sku_count"),
        _n("brand_code").alias("brand_count"),
        _n("supplier_code").alias("supplier_count"),
    )


def leaderboard(brands: DataFrame, top: int = 40) -> DataFrame:
    """Brands by SKU count and mean price, lists as text (AGG-19)."""
    return (
        brands.orderBy(F.desc("sku_count"), F.desc("mean_mrp"), "brand_name", "brand_type")
        .limit(top)
        .withColumns({c: F.array_join(c, ", ") for c in ("price_bands", "pack_buckets")})
    )


def supplier_footprint(products: DataFrame, top: int = 30) -> DataFrame:
    """Reach of each supplier with its most frequent category (AGG-20).

    The mode is taken from (supplier, category) counts, so no group is buffered.
    """
    keys = ["supplier_code", "supplier_type"]
    base = products.groupBy(*keys).agg(
        _n("product_code").alias("sku_count"),
        _n("brand_code").alias("brand_count"),
        _n("distillery").alias("distillery_count"),
        F.avg("mrp").alias("mean_mrp"),
        F.array_join(F.array_sort(F.collect_set("brand_type")), ", ").alias("brand_types"),
    )
    best = base.orderBy(F.desc("sku_count"), "supplier_code", "supplier_type").limit(top)
    counts = products.where(F.col("category").isNotNull()).groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n"))
    modes = counts.groupBy(*keys).agg(F.min_by("category", F.struct(-F.col("n"), F.col("category"))).alias("_mode"))
    m = modes.select(F.col(keys[0]).alias("_a"), F.col(keys[1]).alias("_b"), "_mode")
    on = F.col(keys[0]).eqNullSafe(F.col("_a")) & F.col(keys[1]).eqNullSafe(F.col("_b"))
    return best.join(m, on, "left").withColumn("top_category", F.coalesce("_mode", F.lit("—"))).drop("_a", "_b", "_mode")


def distillery_footprint(products: DataFrame, labels: DataFrame, since: Column, top: int | None = 30) -> DataFrame:
    """Reach of each distillery with its recent labels; null keys match (AGG-21, JN-04)."""
    recent = labels.where(F.col("approval_date") >= since).groupBy(F.col("distillery").alias("_d")).agg(
        F.count("application_no").alias("_r"), _flag("is_new").alias("_rn")
    )
    g = products.groupBy("distillery").agg(
        _n("product_code").alias("sku_count"),
        _n("brand_code").alias("brand_count"),
        _n("supplier_code").alias("supplier_count"),
        F.avg("mrp").alias("mean_mrp"),
        F.array_join(F.array_sort(F.collect_set("brand_type")), ", ").alias("brand_types"),
    )
    out = (
        g.join(recent, F.col("distillery").eqNullSafe(F.col("_d")), "left")
        .withColumns(
            {
                "recent_labels_90d": F.coalesce("_r", F.lit(0)),
                "recent_new_90d": F.coalesce("_rn", F.lit(0)),
            }
        )
        .drop("_d", "_r", "_rn")
    )
    if top is None:
        return out
    return out.orderBy(F.desc("sku_count"), F.desc("recent_labels_90d"), "distillery").limit(top)


def label_churn(labels: DataFrame) -> DataFrame:
    """Approvals per month (AGG-22)."""
    return labels.groupBy(F.col("ym").alias("month")).agg(F.count(F.lit(1)).alias("approvals"))


def launch_watchlist(labels: DataFrame, since: Column, top: int = 40) -> DataFrame:
    """Recent labels per distillery and brand (AGG-23)."""
    return (
        labels.where(F.col("approval_date") >= since)
        .groupBy("distillery", "brand_name")
        .agg(
            F.count("application_no").alias("recent_labels"),
            _flag("is_new").alias("new_labels"),
            _flag("is_renewal").alias("renewals"),
        )
        .orderBy(F.desc("recent_labels"), F.asc_nulls_last("distillery"), "brand_name")
        .limit(top)
    )


def scalar_totals(products: DataFrame, brands: DataFrame, labels: DataFrame, since: Column) -> DataFrame:
    """Nine counters in one row (AGG-24)."""
    recent = F.col("approval_date") >= since
    lab = labels.agg(
        F.count(F.lit(1)).alias("label_total"),
        _flag("is_new").alias("new_labels_total"),
        _flag("is_renewal").alias("renewal_total"),
        F.count_if(recent).alias("recent_90d_labels"),
        F.count_if(recent & F.col("is_new")).alias("recent_90d_new_labels"),
    )
    prod = products.agg(
        F.count(F.lit(1)).alias("sku_total"),
        _n("supplier_code").alias("supplier_total"),
        _n("distillery").alias("distillery_total"),
    )
    return prod.withColumns({c: lab.select(c).scalar() for c in lab.columns}).withColumn(
        "brand_total", brands.agg(F.count(F.lit(1))).scalar()
    )


def category_distribution(products: DataFrame) -> DataFrame:
    """Rows per category without nulls (AGG-25)."""
    return products.where(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def band_pack_matrix(cells: DataFrame, buckets: list[str]) -> DataFrame:
    """Band x bucket grid with zero fill and the largest cell (AGG-37)."""
    grid = cells.groupBy("price_band").pivot("pack_bucket", buckets).agg(F.sum("sku_count")).fillna(0)
    return grid.withColumn(
        "max_cell", F.greatest(grid.agg(F.greatest(*[F.max(f"`{b}`") for b in buckets], F.lit(1))).scalar(), F.lit(1))
    )

"""Retail tables: outlet master, daily sales, products, brands, label approvals, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions import dates, text
from tallyworks.functions.numbers import col, half_even, kept, to_number

# Upper limits of the price bands and of the pack buckets.
PRICE_BANDS = ((200, "Economy"), (600, "Value"), (1500, "Premium"))
TOP_BAND = "Luxury"
BANDS = ("Economy", "Value", "Premium", "Luxury")
PACK_BUCKETS = (
    (90, "Nip (<=90ml)"),
    (180, "Quarter (<=180ml)"),
    (375, "Half (<=375ml)"),
    (500, "Pint (<=500ml)"),
    (750, "Full (<=750ml)"),
)
TOP_BUCKET = "Magnum (>750ml)"
KEY_WORDS = ("code", "id", "license", "no", "number")


def price_band(mrp: str | Column) -> Column:
    """Price band of an MRP; null is UNKNOWN (PRJ-01)."""
    m = col(mrp)
    out = F.when(m.isNull(), "UNKNOWN")
    for top, name in PRICE_BANDS:
        out = out.when(m < top, name)
    return out.otherwise(TOP_BAND)


def pack_bucket(size: str | Column) -> Column:
    """Pack bucket of a size in ml; null is UNKNOWN (PRJ-02)."""
    s = col(size).cast("int")
    out = F.when(s.isNull(), "UNKNOWN")
    for top, name in PACK_BUCKETS:
        out = out.when(s <= top, name)
    return out.otherwise(TOP_BUCKET)


def build_outlets(raw: DataFrame) -> DataFrame:
    """Outlet master from raw columns code, name, address, district, circle, depot, lat, lng, status, vendor_type."""
    return raw.select(
        F.trim(F.col("code").cast("string")).alias("outlet_code"),
        text.clean_name("name").alias("outlet_name"),
        "address",
        text.clean_name("district").alias("district"),
        text.clean_name("circle").alias("circle"),
        text.depot_code("depot").alias("depot_code"),
        text.strip_depot("depot").alias("depot_name"),
        "lat",
        "lng",
        "status",
        text.clean_name("vendor_type").alias("vendor_type"),
    )


def drop_unusable(df: DataFrame, *cols: str) -> DataFrame:
    """Drop rows with a null key or an unparsed date (FLT-01)."""
    return df.dropna(subset=list(cols))


def merge_feeds(feeds: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """Union the feeds and keep the highest value per key; the earlier feed wins ties (SET-01).

    max_by combines map-side, so a key repeated in a third of all rows costs one
    partial row per task.
    """
    tagged = [f.withColumn("_src", F.lit(-i)) for i, f in enumerate(feeds)]
    both = tagged[0]
    for f in tagged[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_src"]
    best = F.max_by(F.struct(*rest), F.struct(F.col(value), F.col("_src"))).alias("_r")
    return both.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def enrich_sales(sales: DataFrame, outlets: DataFrame) -> DataFrame:
    """Outlet attributes on sales; a missing depot comes from the master (JN-01)."""
    master = outlets.select(
        "outlet_code", "district", F.col("depot_code").alias("_depot"), "circle", "vendor_type"
    )
    return (
        sales.join(master, "outlet_code", "left")
        .withColumn("depot_code", F.coalesce("depot_code", "_depot"))
        .drop("_depot")
    )


def build_sales_daily(monthly: DataFrame, yearly: DataFrame, outlets: DataFrame) -> DataFrame:
    """Daily sales from both feeds, one row per outlet and day.

    monthly: vendor_id, date, cases, bottles, total_bottles, sale_value
    yearly: vendor_id, date_raw, depot_raw, cases, bottles, total_bottles, sale_value
    """
    amounts = ["cases", "bottles", "total_bottles", "sale_value"]
    m = monthly.select(
        text.leading_code("vendor_id").alias("outlet_code"), F.col("date").try_cast("date").alias("date"), *amounts
    )
    y = yearly.select(
        text.leading_code("vendor_id").alias("outlet_code"),
        dates.parse_date("date_raw").alias("date"),
        text.depot_code("depot_raw").alias("depot_code"),
        to_number("cases", "int", 0).alias("cases"),
        to_number("bottles", "int", 0).alias("bottles"),
        to_number("total_bottles", "int").alias("total_bottles"),
        to_number("sale_value").alias("sale_value"),
    )
    feeds = [drop_unusable(f, "outlet_code", "date") for f in (m, y)]
    merged = merge_feeds(feeds, ["outlet_code", "date"], "sale_value")
    return enrich_sales(merged, outlets).select(
        "outlet_code", "date", *amounts, "district", "depot_code", "circle", "vendor_type"
    )


def build_products(raw: DataFrame) -> DataFrame:
    """Product master with clean names, price band and pack bucket."""
    return raw.withColumns(
        {
            "brand_name": text.clean_name("brand_name"),
            "category": text.clean_name(F.coalesce("category", F.lit("UNSPECIFIED"))),
            "distillery": text.clean_name(F.coalesce("distillery", F.lit("UNSPECIFIED"))),
            "price_band": price_band("mrp"),
            "pack_bucket": pack_bucket("size_ml"),
        }
    )


def banded(products: DataFrame) -> DataFrame:
    return products.withColumns({"price_band": price_band("mrp"), "pack_bucket": pack_bucket("size_ml")})


def brand_rollup(products: DataFrame) -> DataFrame:
    """One row per brand with its spread of SKUs, prices and suppliers (AGG-04, WIN-06)."""
    brands = products.groupBy("brand_code", "brand_name", "brand_type").agg(
        F.countDistinct("product_code").alias("sku_count"),
        F.avg("mrp").alias("mean_mrp"),
        F.min("mrp").alias("min_mrp"),
        F.max("mrp").alias("max_mrp"),
        F.countDistinct("supplier_code").alias("supplier_count"),
        F.countDistinct("distillery").alias("distillery_count"),
        # Both sets are bounded by the fixed lists of bands and buckets.
        F.array_sort(F.collect_set("price_band")).alias("price_bands"),
        F.array_sort(F.collect_set("pack_bucket")).alias("pack_buckets"),
    )
    return brands.withColumn("sku_spread_ratio", F.col("sku_count") / brands.agg(F.max("sku_count")).scalar())


def build_labels(raw: DataFrame) -> DataFrame:
    """Label approvals from raw text columns."""
    return drop_unusable(
        raw.select(
            "application_no",
            "type",
            "label_type",
            "label_category",
            dates.parse_date("approval_date").alias("approval_date"),
            text.clean_name(F.coalesce("distillery", F.lit("UNSPECIFIED"))).alias("distillery"),
            "unit_name",
            text.clean_name("brand_name").alias("brand_name"),
            text.first_int("size_ml_raw").cast("double").alias("size_ml"),
            "pack_type",
            to_number("basic_price").alias("basic_price"),
            to_number("mrp").alias("mrp"),
            F.coalesce("label_type", F.lit("UNSPECIFIED")).alias("category"),
        ),
        "approval_date",
    )


def label_flags(labels: DataFrame, bucket: str = "yyyy-MM") -> DataFrame:
    """Exclusive renewal and new flags, and the month bucket (PRJ-03, DAT-02)."""
    c = F.lower(F.coalesce("label_category", F.lit("")))
    renewal = F.contains(c, F.lit("renewal"))
    return labels.withColumns(
        {
            "is_renewal": renewal,
            "is_new": F.contains(c, F.lit("new label")) & ~renewal,
            "ym": dates.month("approval_date", bucket),
        }
    )


# --- data quality -----------------------------------------------------------------


def quality_totals(
    outlets: DataFrame, sales: DataFrame, products: DataFrame, brands: DataFrame, labels: DataFrame, as_of: Column
) -> DataFrame:
    """One row of counts over all tables (AGG-26); each table is one aggregate.

    Dormant is all outlets minus the distinct outlets seen in sales.
    """
    s = sales.agg(
        F.countDistinct("outlet_code").alias("outlets_with_sales"),
        F.count(F.lit(1)).alias("sales_rows"),
        F.min("date").cast("string").alias("date_min"),
        F.max("date").cast("string").alias("date_max"),
        F.count_if(F.col("date") > as_of).alias("future_rows"),
    )
    o = outlets.agg(
        F.count(F.lit(1)).alias("outlets"),
        F.countDistinct("district").alias("districts"),
        F.countDistinct("depot_code").alias("depots"),
        F.count_if(F.col("lat").isNull()).alias("missing_geo"),
    )
    rows = F.count(F.lit(1))
    return (
        o.withColumn("_s", s.select(F.struct("*")).scalar())
        .select("*", "_s.*")
        .drop("_s")
        .withColumn("products_master", products.agg(rows).scalar())
        .withColumn("brands", brands.agg(rows).scalar())
        .withColumn("label_approvals", labels.agg(rows).scalar())
        .withColumn("dormant_outlets", F.col("outlets") - F.col("outlets_with_sales"))
    )


# Severity, code, message (counts in braces), affected area, mitigation.
ISSUES = (
    ("info", "NO_SKU_LEVEL_SALES", "Sales grain is outlet x date only. True SKU forecasting is not possible until outlet x SKU x date feed is added.",
     "all SKU analytics", "Rule-based SKU rationalization engine marked 'interim'; placeholder module scaffolded for real SKU feed."),
    ("warning", "DORMANT_OUTLETS", "{dormant_outlets:,} of {outlets:,} outlets have no sales rows in the provided feed.",
     "outlet intelligence coverage", "Flagged in outlet table; excluded from forecasting but still surfaced as dormant risk."),
    ("warning", "MISSING_COORDINATES", "{missing_geo} outlets lack lat/lng and will not appear on the map.",
     "map view coverage", "Map view renders only geo-located outlets; others surfaced in table views."),
    ("info", "FUTURE_DATED_ROWS", "{future_rows} sales rows bear dates beyond today (likely Excel type coercion or forward entries).",
     "trend slope, latest-week aggregates", "Forecasting uses a train cutoff of today to avoid leakage."),
    ("info", "NO_GPS_SURAKSHA", "GPS logs, Suraksha App transactions, and depot dispatch schedules are not present in the uploaded files.",
     "route intelligence, consumer intelligence, depot balancing", "Dedicated modules are scaffolded with wire-in contracts; UI surfaces placeholders."),
)


def quality_issues(totals: DataFrame) -> DataFrame:
    """Issue rows with counts in their text, the area affected and the mitigation (AGG-27)."""

    def filled(message: str) -> Column:
        parts = [
            part
            for text, name, form, _ in Formatter().parse(message)
            for part in (F.lit(text), *([F.format_number(name, 0) if form else F.col(name).cast("string")] if name else []))
        ]
        return F.concat(*parts)

    items = [
        F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), filled(m).alias("message"), F.lit(a).alias("affected"), F.lit(g).alias("mitigation"))
        for s, c, m, a, g in ISSUES
    ]
    return totals.select(F.inline(F.array(*items)))


def column_profile(df: DataFrame, samples: int = 3) -> DataFrame:
    """One row per column: rows, non-null, null %, distinct, samples, type (AGG-28).

    Counts of all columns come from one pass.  Distinct counts run on
    (column, value) pairs, which combine map-side per column.
    """
    cells = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.lit(t).alias("dtype"),
                          F.col(c).cast("string").alias("v")) for i, (c, t) in enumerate(df.dtypes)]
    long = df.select(F.inline(F.array(*cells)))
    per_value = long.groupBy("position", "name", "dtype", "v").agg(F.count(F.lit(1)).alias("n"))
    prof = per_value.groupBy("position", "name", "dtype").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_null"),
        F.count("v").alias("n_unique"),
        F.min("v").alias("_s0"),
    )
    for i in range(1, samples):
        seen = prof.select(F.col("position").alias("_p"), F.col(f"_s{i - 1}").alias("_prev"))
        nxt = (
            per_value.join(F.broadcast(seen), F.col("position") == F.col("_p"))
            .where(F.col("v") > F.col("_prev"))
            .groupBy(F.col("_p"))
            .agg(F.min("v").alias(f"_s{i}"))
        )
        prof = prof.join(nxt, F.col("position") == F.col("_p"), "left").drop("_p")
    pct = half_even(100.0 * (F.col("rows") - F.col("non_null")) / F.greatest("rows", F.lit(1)), 2)
    sample = kept(*[F.col(f"_s{i}") for i in range(samples)])
    return prof.select("position", "name", "dtype", "rows", "non_null", pct.alias("null_pct"), "n_unique",
                       sample.alias("sample"))


def likely_key(profile: DataFrame, words: Sequence[str] = KEY_WORDS) -> DataFrame:
    """First all-distinct column, preferring key-like names (AGG-29)."""
    named = F.lit(False)
    for w in words:
        named = named | F.contains(F.lower("name"), F.lit(w))
    full = profile.where((F.col("non_null") == F.col("rows")) & (F.col("n_unique") == F.col("rows")))
    return full.agg(F.min_by("name", F.struct(~named, F.col("position"))).alias("primary_key"))


def audit_tables(inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Column profiles of many inputs under one table name each."""
    out = None
    for name, df in inputs.items():
        one = column_profile(df).withColumn("table", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no inputs")
    return out.withColumn("error", F.lit(None).cast("string"))


def audit_failures(profiles: DataFrame, failures: Mapping[str, str]) -> DataFrame:
    """Add one row per input that could not be read."""
    if not failures:
        return profiles
    spark = profiles.sparkSession
    rows = spark.createDataFrame(list(failures.items()), "table string, error string")
    return profiles.unionByName(rows, allowMissingColumns=True)

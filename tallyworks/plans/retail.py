"""Retail queries: ETL, features, scores, roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.functions import dates, numbers, text
from tallyworks.operators import actions as act
from tallyworks.operators import features as ft
from tallyworks.operators import models
from tallyworks.operators import retail as rt
from tallyworks.plans.registry import CTES, as_of, as_text, query, rounded
from tallyworks.sinks import tables as snk
from tallyworks.sources import readers
from tallyworks.sources.views import Views

# The driver's customers order rarely, so "recent" is a year here.
RECENT = 365

CTES["feats"] = """
  SELECT g.*, o.outlet_name, o.district, o.depot_code, o.circle, o.vendor_type, o.lat, o.lng,
    CASE WHEN prev30_value = 0 THEN 0 ELSE (recent30_value - prev30_value) / prev30_value END AS growth_30d,
    COALESCE(std_daily_value / NULLIF(avg_daily_value, 0), 0) AS volatility,
    date_diff('day', last_sale, DATE '2001-08-01') > 365 AS dormant
  FROM (SELECT outlet_code, MIN(date) AS first_sale, MAX(date) AS last_sale, SUM(sale_value) AS total_sale_value,
      AVG(sale_value) AS avg_daily_value, MEDIAN(sale_value) AS median_daily_value,
      STDDEV_SAMP(sale_value) AS std_daily_value, CAST(SUM(cases) AS BIGINT) AS total_cases,
      CAST(SUM(total_bottles) AS BIGINT) AS total_bottles, COUNT(DISTINCT date) AS active_days,
      CASE WHEN COUNT(*) >= 10 AND MIN(date) < MAX(date)
        THEN REGR_SLOPE(sale_value, CAST(date_diff('day', DATE '1995-01-01', date) AS DOUBLE)) ELSE 0 END AS trend_slope,
      COALESCE(SUM(CASE WHEN date >= DATE '2001-08-01' - 365 THEN sale_value END), 0) AS recent30_value,
      COALESCE(SUM(CASE WHEN date >= DATE '2001-08-01' - 730 AND date < DATE '2001-08-01' - 365 THEN sale_value END), 0)
        AS prev30_value
    FROM {sales} WHERE date <= DATE '2001-08-01' GROUP BY outlet_code) g
  LEFT JOIN {outlets} o ON g.outlet_code = o.outlet_code"""

CTES["peers"] = """
  SELECT f.*, MEDIAN(avg_daily_value) OVER (PARTITION BY district, vendor_type) AS peer_avg FROM {feats} f"""

CTES["scored"] = """
  SELECT r.*, gap * 30 AS estimated_uplift_inr, gap AS peer_gap,
    (0.35 * gap_pct + 0.25 * growth_component + 0.2 * (1 - vol_rank) + 0.2 * activity_component) * 100 AS opportunity_score
  FROM (SELECT p.*,
      (RANK() OVER (PARTITION BY district, vendor_type ORDER BY gap)
        + (COUNT(*) OVER (PARTITION BY district, vendor_type, gap) - 1) / 2.0)
        / COUNT(*) OVER (PARTITION BY district, vendor_type) AS gap_pct,
      (RANK() OVER (ORDER BY growth_30d) + (COUNT(*) OVER (PARTITION BY growth_30d) - 1) / 2.0) / COUNT(*) OVER ()
        AS growth_component,
      (RANK() OVER (ORDER BY volatility) + (COUNT(*) OVER (PARTITION BY volatility) - 1) / 2.0) / COUNT(*) OVER ()
        AS vol_rank,
      (RANK() OVER (ORDER BY active_days) + (COUNT(*) OVER (PARTITION BY active_days) - 1) / 2.0) / COUNT(*) OVER ()
        AS activity_component
    FROM (SELECT q.*, GREATEST(peer_avg - avg_daily_value, 0) AS gap FROM {peers} q) p) r"""

# Anomaly flags come from a seeded model in production; for roll-ups that only
# count flags a plain threshold stands in on both sides.
CTES["flagged"] = """
  SELECT s.*, ABS(growth_30d) > 1.5 OR volatility > 0.8 AS anomaly,
    CASE WHEN volatility < 0.45 THEN 'Stable High-Throughput' WHEN growth_30d < -0.3 THEN 'Declining — Intervention Needed'
      ELSE 'Steady Mid-Tier' END AS segment
  FROM {scored} s"""


def feats(v: Views) -> DataFrame:
    return ft.outlet_features(v.sales, v.outlets, as_of(), RECENT)


def scored(v: Views) -> DataFrame:
    return ft.opportunity_scores(feats(v))


def flagged_from(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "anomaly": (F.abs("growth_30d") > 1.5) | (F.col("volatility") > 0.8),
            "segment": F.when(F.col("volatility") < 0.45, "Stable High-Throughput")
            .when(F.col("growth_30d") < -0.3, "Declining — Intervention Needed")
            .otherwise("Steady Mid-Tier"),
        }
    )


def flagged(v: Views) -> DataFrame:
    return flagged_from(scored(v))


# --- sources and ETL ------------------------------------------------------------


@query("src_01_read_canonical", """
  SELECT CAST(o_orderdate AS DATE)::VARCHAR AS date, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total
  FROM orders GROUP BY 1""")  # fmt: skip
def src_01(v: Views) -> DataFrame:
    df = readers.read_table(v.spark, f"{v.folder}/orders.parquet", date="o_orderdate")
    return df.groupBy(F.col("o_orderdate").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@query("flt_01_drop_unusable", """
  SELECT COUNT(*) AS kept, MIN(application_no) AS first_no FROM {label_approvals} WHERE distillery IS NOT NULL
    AND approval_date IS NOT NULL""")  # fmt: skip
def flt_01(v: Views) -> DataFrame:
    df = rt.drop_unusable(v.label_approvals, "distillery", "approval_date")
    return df.agg(F.count(F.lit(1)).alias("kept"), F.min("application_no").alias("first_no"))


@query("str_01_clean_name", """
  SELECT p_partkey, TRIM(REGEXP_REPLACE('  ' || p_name || ' & <b>' || p_type || ' é₹' || chr(CAST(9000 + p_partkey % 500 AS INTEGER)), '\\s+', ' ', 'g'))
    AS name FROM part""")  # fmt: skip
def str_01(v: Views) -> DataFrame:
    number = (F.col("p_partkey") % 500 + 9000).cast("string")
    raw = F.concat(F.lit("  "), "p_name", F.lit(" &amp;amp; &lt;b&gt;"), "p_type", F.lit("&nbsp;&eacute;&#x20b9;&#"), number, F.lit(";"))
    return v.part.select("p_partkey", text.clean_name(raw).alias("name"))


@query("str_02_leading_code", """
  SELECT c_custkey, CASE WHEN LENGTH(CAST(c_custkey * 7919 AS VARCHAR)) BETWEEN 5 AND 8
    THEN CAST(c_custkey * 7919 AS VARCHAR) END AS code FROM customer""")  # fmt: skip
def str_02(v: Views) -> DataFrame:
    raw = F.concat((F.col("c_custkey") * 7919).cast("string"), F.lit("-M/s. "), "c_name")
    return v.customer.select("c_custkey", text.leading_code(raw).alias("code"))


@query("str_03_depot_code", """
  SELECT s_suppkey, CASE WHEN LENGTH(d) < 2 OR LENGTH(d) > 4 THEN NULL WHEN LENGTH(d) = 2 THEN '0' || d ELSE d END AS depot,
    'Excise Depot ' || s_name AS depot_name
  FROM (SELECT *, CAST(s_suppkey * 13 + 10 AS VARCHAR) AS d FROM supplier)""")  # fmt: skip
def str_03(v: Views) -> DataFrame:
    code = (F.col("s_suppkey") * 13 + 10).cast("string")
    raw = F.concat(code, F.lit("-Excise Depot "), "s_name")
    return v.supplier.select("s_suppkey", text.depot_code(raw).alias("depot"), text.strip_depot(raw).alias("depot_name"))


@query("str_05_first_int", """
  SELECT p_partkey, CAST(REGEXP_EXTRACT(p_brand, '(\\d+)', 1) AS BIGINT) AS brand_no,
    CAST(p_size AS BIGINT) AS months, p_retailprice AS price FROM part""")  # fmt: skip
def str_05(v: Views) -> DataFrame:
    return v.part.select(
        "p_partkey",
        text.first_int("p_brand").alias("brand_no"),
        text.first_int(F.concat(F.col("p_size").cast("string"), F.lit(" months")), leading=True).alias("months"),
        numbers.to_number(F.col("p_retailprice").cast("string")).alias("price"),
    )


@query("str_06_to_number", """
  SELECT event_id, COALESCE(TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(CAST(FLOOR(value) AS BIGINT) AS VARCHAR) END
    AS INTEGER), 0) AS n FROM events""")  # fmt: skip
def str_06(v: Views) -> DataFrame:
    raw = F.when(F.col("event_type") == "error", "n/a").otherwise(F.floor("value").cast("string"))
    return v.events.select("event_id", numbers.to_number(raw, "int", 0).alias("n"))


@query("dat_01_parse_dates", """
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS parsed
  FROM orders""")  # fmt: skip
def dat_01(v: Views) -> DataFrame:
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = (
        F.when(k == 0, F.date_format(d, "dd-MM-yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(k == 2, F.date_format(d, "dd/MM/yyyy")).when(k == 3, F.concat(F.lit(" "), F.date_format(d, "dd-MM-yyyy")))
        .otherwise("not a date")
    )
    return v.orders.select("o_orderkey", dates.parse_date(raw).cast("string").alias("parsed"))


@query("dat_03_whole_days", """
  SELECT id, CASE WHEN approved_at IS NULL THEN 0 ELSE date_diff('day', submitted_at, approved_at) END AS days,
    isodow(submitted_at) >= 6 AS weekend, strftime(submitted_at, '%Y-%m') AS ym FROM {apps}""")  # fmt: skip
def dat_03(v: Views) -> DataFrame:
    return v.apps.select(
        "id",
        dates.whole_days("submitted_at", "approved_at").alias("days"),
        dates.is_weekend("submitted_at").alias("weekend"),
        dates.month("submitted_at").alias("ym"),
    )


@query("dat_05_calendar", """
  SELECT district, CAST(UNNEST(GENERATE_SERIES(lo, hi + 14, INTERVAL 1 DAY)) AS DATE)::VARCHAR AS day
  FROM (SELECT district, MIN(date) AS lo, MAX(date) AS hi FROM {sales} GROUP BY district)""")  # fmt: skip
def dat_05(v: Views) -> DataFrame:
    ends = v.sales.groupBy("district").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    first = ends.select("district", F.explode(dates.day_range("lo", F.col("hi"))).alias("day"))
    rest = ends.select("district", F.explode(dates.horizon(F.col("hi"), 14)).alias("day"))
    return as_text(first.unionByName(rest), "day")


@query("prj_01_price_band", """
  SELECT product_code, CASE WHEN mrp IS NULL THEN 'UNKNOWN' WHEN mrp < 200 THEN 'Economy' WHEN mrp < 600 THEN 'Value'
    WHEN mrp < 1500 THEN 'Premium' ELSE 'Luxury' END AS band FROM {products}""")  # fmt: skip
def prj_01(v: Views) -> DataFrame:
    return v.products.select("product_code", rt.price_band("mrp").alias("band"))


@query("prj_02_pack_bucket", """
  SELECT product_code, CASE WHEN size_ml IS NULL THEN 'UNKNOWN' WHEN size_ml <= 90 THEN 'Nip (<=90ml)' WHEN size_ml <= 180
    THEN 'Quarter (<=180ml)' WHEN size_ml <= 375 THEN 'Half (<=375ml)' WHEN size_ml <= 500 THEN 'Pint (<=500ml)'
    WHEN size_ml <= 750 THEN 'Full (<=750ml)' ELSE 'Magnum (>750ml)' END AS bucket FROM {products}""")  # fmt: skip
def prj_02(v: Views) -> DataFrame:
    return v.products.select("product_code", rt.pack_bucket("size_ml").alias("bucket"))


@query("prj_03_label_flags", """
  SELECT application_no, LOWER(label_category) LIKE '%renewal%' AS is_renewal,
    LOWER(label_category) LIKE '%new label%' AND LOWER(label_category) NOT LIKE '%renewal%' AS is_new,
    strftime(approval_date, '%Y-%m') AS ym FROM {label_approvals}""")  # fmt: skip
def prj_03(v: Views) -> DataFrame:
    return rt.label_flags(v.label_approvals).select("application_no", "is_renewal", "is_new", "ym")


CTES["yearly"] = """
  SELECT CAST(o_custkey AS VARCHAR) AS outlet_code, CAST(o_orderdate AS DATE) AS date, SUM(l_extendedprice) AS sale_value,
    CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cases
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"""


@query("set_01_merge_feeds", """
  SELECT outlet_code, CAST(date AS VARCHAR) AS date, ROUND(sale_value, 2) AS sale_value, cases, depot_code FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY outlet_code, date ORDER BY sale_value DESC, src) AS rn FROM (
      SELECT outlet_code, date, sale_value, cases, NULL AS depot_code, 0 AS src FROM {sales}
      UNION ALL SELECT outlet_code, date, sale_value, cases, 'D' || outlet_code, 1 FROM {yearly}) ) WHERE rn = 1""")  # fmt: skip
def set_01(v: Views) -> DataFrame:
    # Both feeds are reduced to (customer, day) before they meet.
    lines = v.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("x"), F.sum(F.col("l_quantity").cast("long")).alias("q")
    )
    yearly = (
        v.orders.join(lines, "o_orderkey")
        .groupBy(F.col("o_custkey").cast("string").alias("outlet_code"), F.to_date("o_orderdate").alias("date"))
        .agg(F.sum("x").alias("sale_value"), F.sum("q").alias("cases"))
        .withColumn("depot_code", F.concat(F.lit("D"), "outlet_code"))
    )
    monthly = v.sales.select("outlet_code", "date", "sale_value", "cases")
    return as_text(rounded(rt.merge_feeds([monthly, yearly], ["outlet_code", "date"], "sale_value"), 2, "sale_value"), "date")


@query("jn_01_enrich_sales", """
  SELECT outlet_code, CAST(date AS VARCHAR) AS date, district, circle, vendor_type,
    CASE WHEN cases > 20 THEN 'OWN' ELSE depot_code END AS depot_code FROM {sales}""")  # fmt: skip
def jn_01(v: Views) -> DataFrame:
    bare = v.sales.select(
        "outlet_code", "date", F.when(F.col("cases") > 20, "OWN").alias("depot_code")
    )
    return as_text(rt.enrich_sales(bare, v.outlets), "date")


CTES["brands"] = """
  SELECT brand_code, brand_name, brand_type, COUNT(DISTINCT product_code) AS sku_count, AVG(mrp) AS mean_mrp, MIN(mrp) AS min_mrp,
    MAX(mrp) AS max_mrp, COUNT(DISTINCT supplier_code) AS supplier_count, COUNT(DISTINCT distillery) AS distillery_count,
    ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT price_band)), ', ') AS price_bands,
    ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT pack_bucket)), ', ') AS pack_buckets
  FROM {banded} GROUP BY ALL"""
CTES["banded"] = """
  SELECT *, CASE WHEN mrp IS NULL THEN 'UNKNOWN' WHEN mrp < 200 THEN 'Economy' WHEN mrp < 600 THEN 'Value'
    WHEN mrp < 1500 THEN 'Premium' ELSE 'Luxury' END AS price_band,
    CASE WHEN size_ml IS NULL THEN 'UNKNOWN' WHEN size_ml <= 90 THEN 'Nip (<=90ml)' WHEN size_ml <= 180
    THEN 'Quarter (<=180ml)' WHEN size_ml <= 375 THEN 'Half (<=375ml)' WHEN size_ml <= 500 THEN 'Pint (<=500ml)'
    WHEN size_ml <= 750 THEN 'Full (<=750ml)' ELSE 'Magnum (>750ml)' END AS pack_bucket
  FROM {products}"""


@query("agg_04_brand_rollup", """
  SELECT * REPLACE (ROUND(mean_mrp, 4) AS mean_mrp, ROUND(min_mrp, 4) AS min_mrp, ROUND(max_mrp, 4) AS max_mrp),
    ROUND(sku_count / MAX(sku_count) OVER (), 6) AS sku_spread_ratio FROM {brands}""")  # fmt: skip
def agg_04(v: Views) -> DataFrame:
    b = as_text(rt.brand_rollup(rt.banded(v.products)), "price_bands", "pack_buckets")
    return rounded(rounded(b, 4, "mean_mrp", "min_mrp", "max_mrp"), 6, "sku_spread_ratio")


CTES["totals"] = """
  SELECT o.*, s.*, outlets - outlets_with_sales AS dormant_outlets,
    (SELECT COUNT(*) FROM {products}) AS products_master,
    (SELECT COUNT(*) FROM {brands}) AS brands, (SELECT COUNT(*) FROM {label_approvals}) AS label_approvals
  FROM (SELECT COUNT(*) AS outlets, COUNT(DISTINCT district) AS districts, COUNT(DISTINCT depot_code) AS depots,
      COUNT(*) FILTER (WHERE lat IS NULL) AS missing_geo FROM {outlets}) o,
    (SELECT COUNT(DISTINCT outlet_code) AS outlets_with_sales, COUNT(*) AS sales_rows, CAST(MIN(date) AS VARCHAR) AS date_min,
      CAST(MAX(date) AS VARCHAR) AS date_max, COUNT(*) FILTER (WHERE date > DATE '2001-03-01') AS future_rows FROM {sales}) s"""


def totals(v: Views) -> DataFrame:
    brands = rt.brand_rollup(rt.banded(v.products))
    return rt.quality_totals(v.outlets, v.sales, v.products, brands, v.label_approvals, F.lit("2001-03-01").cast("date"))


@query("agg_26_quality_totals", "SELECT * FROM {totals}")
def agg_26(v: Views) -> DataFrame:
    return totals(v)


def _issues_sql() -> str:
    def message(m: str) -> str:
        for name in ("dormant_outlets", "outlets"):
            m = m.replace("{" + name + ":,}", f"' || FORMAT('{{:,}}', {name}) || '")
        for name in ("missing_geo", "future_rows"):
            m = m.replace("{" + name + "}", f"' || {name} || '")
        return m

    rows = [(s, c, message(m), a.replace("'", "''"), g.replace("'", "''")) for s, c, m, a, g in rt.ISSUES]
    return " UNION ALL ".join(
        f"SELECT '{s}' AS severity, '{c}' AS code, '{m}' AS message, '{a}' AS affected, '{g}' AS mitigation FROM {{totals}}" for s, c, m, a, g in rows
    )


@query("agg_27_quality_issues", _issues_sql())
def agg_27(v: Views) -> DataFrame:
    return rt.quality_issues(totals(v))


def _profile_sql(table: str, cols: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS name, COUNT(*) AS rows, COUNT({c}) AS non_null,
        ROUND(100.0 * (COUNT(*) - COUNT({c})) / COUNT(*), 2) AS null_pct, COUNT(DISTINCT {c}) AS n_unique,
        ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT CAST({c} AS VARCHAR)))[1:3], ', ') AS sample FROM {table}"""
        for i, c in enumerate(cols)
    )


@query("agg_28_column_profile", _profile_sql(
    "{label_approvals}", ["application_no", "approval_date", "label_category", "category", "distillery", "brand_name", "size_ml", "mrp"]))
def agg_28(v: Views) -> DataFrame:
    df = v.label_approvals.select("application_no", "approval_date", "label_category", "category", "distillery", "brand_name", "size_ml", "mrp")
    return as_text(rt.column_profile(df).drop("dtype"), "sample")


@query("agg_29_primary_key", "SELECT 'o_orderkey' AS primary_key")
def agg_29(v: Views) -> DataFrame:
    return rt.likely_key(rt.column_profile(v.orders))


# --- sinks ------------------------------------------------------------------------


@query("src_08_flatten_sources", """
  SELECT 's' || s_suppkey AS source_id, s_acctbal > 3000 AS approved, CASE WHEN s_suppkey % 2 = 0 THEN 'by ' || s_name ELSE '' END AS reviewed_by,
    CASE WHEN s_acctbal > 5000 THEN 'sitemap' ELSE 'manual_seed' END AS discovery_mode, CAST(s_suppkey % 7 AS INTEGER) AS max_pages_per_run
  FROM supplier""")  # fmt: skip
def src_08(v: Views) -> DataFrame:
    even = F.col("s_suppkey") % 2 == 0
    none = F.lit(None)
    raw = v.supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("source_id"), F.col("s_name").alias("source_name"),
        F.lit("https://portal.example").alias("base_url"), F.lit("IN").alias("country"), F.lit("official_portal").alias("source_type"),
        F.array(F.lit("/public/")).alias("allowed_paths"), F.lit("table").alias("parser_name"),
        F.array(F.lit("pdf")).alias("allowed_file_extensions"), F.lit(True).alias("robots_required"),
        F.struct(F.when(F.col("s_acctbal") > 3000, True).alias("approved"), F.lit("").alias("tos_url"), none.cast("string").alias("tos_summary"),
                 F.when(even, F.concat(F.lit("by "), "s_name")).alias("reviewed_by"), F.lit("").alias("reviewed_on")).alias("review"),
        F.struct(F.lit(2.0).alias("rate_limit_seconds"), (F.col("s_suppkey") % 7).cast("int").alias("max_pages_per_run"),
                 F.lit(5).alias("max_documents_per_run")).alias("limits"),
        F.struct(F.when(F.col("s_acctbal") > 5000, "sitemap").alias("mode"), none.cast("string").alias("sitemap_url"),
                 none.cast("array<string>").alias("search_pages")).alias("discovery"),
    )
    return readers.flatten_sources(raw).select("source_id", "approved", "reviewed_by", "discovery_mode", "max_pages_per_run")


@query("snk_02_clean_numbers", """
  SELECT id, CASE WHEN value < 50 THEN NULL ELSE value END AS value FROM {audit_log}""")  # fmt: skip
def snk_02(v: Views) -> DataFrame:
    x = F.when(F.col("value") < 20, float("nan")).when(F.col("value") < 50, float("inf")).otherwise(F.col("value"))
    return snk.clean_floats(v.audit_log.select("id", x.alias("value")))


@query("snk_03_csv_cells", """
  SELECT CAST(bid_id AS VARCHAR) AS bid_id, COALESCE(CASE WHEN n_missing > 0 THEN company END, '') AS company,
    '["' || jv_status || '","' || solvency_age || '"]' AS tags FROM {bids}""")  # fmt: skip
def snk_03(v: Views) -> DataFrame:
    df = v.bids.select("bid_id", F.when(F.col("n_missing") > 0, F.col("company")).alias("company"),
                       F.array("jv_status", "solvency_age").alias("tags"), F.lit(1).alias("extra"))
    return snk.csv_cells(df, ["bid_id", "company", "tags"])


@query("snk_06_keyed_upsert", """
  SELECT user_id, event_id, event_type, value FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY
    ts >= TIMESTAMP '2024-01-15' DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")  # fmt: skip
def snk_06(v: Views) -> DataFrame:
    cols = ["user_id", "event_id", "event_type", "value"]
    old = v.events.where("ts < timestamp_ntz'2024-01-15'").select(cols)
    new = v.events.where("ts >= timestamp_ntz'2024-01-15'").select(cols)
    return snk.upsert(old, new, ["user_id"], ["event_id"])


@query("snk_07_partial_upsert", """
  SELECT COALESCE(o.user_id, n.user_id) AS user_id, COALESCE(o.first_value, n.first_value) AS first_value,
    CAST(COALESCE(n.fetched_at, o.fetched_at) AS VARCHAR) AS fetched_at
  FROM (SELECT user_id, MIN(value) AS first_value, MAX(ts)::DATE AS fetched_at FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1) o
  FULL JOIN (SELECT user_id, MIN(value) AS first_value, MAX(ts)::DATE AS fetched_at FROM events WHERE ts >= TIMESTAMP '2024-01-15'
    GROUP BY 1) n ON o.user_id = n.user_id""")  # fmt: skip
def snk_07(v: Views) -> DataFrame:
    def part(cond: str) -> DataFrame:
        return v.events.where(cond).groupBy("user_id").agg(
            F.min("value").alias("first_value"), F.to_date(F.max("ts")).alias("fetched_at")
        )

    old, new = part("ts < timestamp_ntz'2024-01-15'"), part("ts >= timestamp_ntz'2024-01-15'")
    return as_text(snk.upsert_columns(old, new, ["user_id"], ["fetched_at"]), "fetched_at")


@query("snk_08_runs", """
  SELECT run_id, CASE WHEN run_id = 'R-2024-01-05' THEN 0 END AS exit_status,
    CASE WHEN run_id = 'R-2024-01-05' THEN '{"pages":3}' END AS counts, run_id < 'R-2024-01-15' AS was_known
  FROM (SELECT DISTINCT run_id FROM {compliance_log})""")  # fmt: skip
def snk_08(v: Views) -> DataFrame:
    runs = v.compliance_log.select("run_id").distinct()
    known = runs.where("run_id < 'R-2024-01-15'").select(
        "run_id", F.lit(None).cast("int").alias("exit_status"), F.lit(None).cast("string").alias("counts"),
        F.lit(True).alias("was_known"))
    asked = runs.select("run_id", F.lit(None).cast("int").alias("exit_status"), F.lit(None).cast("string").alias("counts"),
                        F.lit(False).alias("was_known"))
    return snk.finish_run(snk.insert_absent(known, asked, "run_id"), "R-2024-01-05", 0, {"pages": 3})


# --- features -----------------------------------------------------------------------


@query("agg_01_outlet_features", """
  SELECT outlet_code, CAST(first_sale AS VARCHAR) AS first_sale, CAST(last_sale AS VARCHAR) AS last_sale,
    ROUND(total_sale_value, 2) AS total_sale_value, ROUND(avg_daily_value, 4) AS avg_daily_value,
    ROUND(median_daily_value, 4) AS median_daily_value, ROUND(std_daily_value, 4) AS std_daily_value, total_cases,
    total_bottles, active_days FROM {feats}""")  # fmt: skip
def agg_01(v: Views) -> DataFrame:
    f = ft.outlet_features(v.sales, None, as_of(), RECENT).select(
        "outlet_code", "first_sale", "last_sale", "total_sale_value", "avg_daily_value", "median_daily_value",
        "std_daily_value", "total_cases", "total_bottles", "active_days")
    f = rounded(rounded(f, 2, "total_sale_value"), 4, "avg_daily_value", "median_daily_value", "std_daily_value")
    return as_text(f, "first_sale", "last_sale")


@query("agg_02_trend_slope", "SELECT outlet_code, ROUND(trend_slope, 6) AS trend_slope FROM {feats}")
def agg_02(v: Views) -> DataFrame:
    return rounded(ft.outlet_features(v.sales, None, as_of(), RECENT).select("outlet_code", "trend_slope"), 6, "trend_slope")


@query("agg_03_window_sums", """
  SELECT outlet_code, ROUND(recent30_value, 2) AS recent30_value, ROUND(prev30_value, 2) AS prev30_value FROM {feats}""")  # fmt: skip
def agg_03(v: Views) -> DataFrame:
    f = ft.outlet_features(v.sales, None, as_of(), RECENT).select("outlet_code", "recent30_value", "prev30_value")
    return rounded(f, 2, "recent30_value", "prev30_value")


@query("flt_02_as_of", """
  SELECT district, COUNT(*) AS n, ROUND(SUM(sale_value), 2) AS value FROM {sales} WHERE date <= DATE '1999-06-30' GROUP BY 1""")  # fmt: skip
def flt_02(v: Views) -> DataFrame:
    df = ft.not_after(v.sales, F.lit("1999-06-30").cast("date"))
    return df.groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sale_value"), 2).alias("value"))


@query("flt_03_windows", """
  SELECT district, COUNT(*) FILTER (WHERE date >= DATE '2001-08-01' - 30) AS d30,
    COUNT(*) FILTER (WHERE date >= DATE '2001-08-01' - 60 AND date < DATE '2001-08-01' - 30) AS d60,
    COUNT(*) FILTER (WHERE date >= DATE '2001-08-01' - 90) AS d90, COUNT(*) FILTER (WHERE date >= DATE '2001-08-01' - 180) AS d180
  FROM {sales} GROUP BY district""")  # fmt: skip
def flt_03(v: Views) -> DataFrame:
    t = as_of()
    return v.sales.groupBy("district").agg(
        F.count_if(ft.in_window("date", t, 30)).alias("d30"),
        F.count_if(ft.in_window("date", t, 60, 30)).alias("d60"),
        F.count_if(ft.in_window("date", t, 90)).alias("d90"),
        F.count_if(ft.in_window("date", t, 180)).alias("d180"),
    )


@query("prj_04_ratios", """
  SELECT outlet_code, ROUND(growth_30d, 6) AS growth_30d, ROUND(volatility, 6) AS volatility, dormant FROM {feats}""")  # fmt: skip
def prj_04(v: Views) -> DataFrame:
    f = ft.outlet_features(v.sales, None, as_of(), RECENT).select("outlet_code", "growth_30d", "volatility", "dormant")
    return rounded(f, 6, "growth_30d", "volatility")


@query("jn_02_feature_blocks", """
  SELECT outlet_code, active_days, ROUND(trend_slope, 6) AS trend_slope, ROUND(recent30_value, 2) AS recent30_value FROM {feats}""")  # fmt: skip
def jn_02(v: Views) -> DataFrame:
    f = ft.outlet_features(v.sales, None, as_of(), RECENT)
    f = f.select("outlet_code", "active_days", "trend_slope", "recent30_value")
    return rounded(rounded(f, 6, "trend_slope"), 2, "recent30_value")


@query("jn_03_feature_attributes", """
  SELECT outlet_code, outlet_name, district, depot_code, circle, vendor_type, lat, lng, active_days FROM {feats}""")  # fmt: skip
def jn_03(v: Views) -> DataFrame:
    return feats(v).select(
        "outlet_code", "outlet_name", "district", "depot_code", "circle", "vendor_type", "lat", "lng", "active_days"
    )


@query("win_01_peer_median", "SELECT outlet_code, ROUND(peer_avg, 4) AS peer_avg FROM {peers}")
def win_01(v: Views) -> DataFrame:
    f = ft.peer_median(feats(v), ["district", "vendor_type"], "avg_daily_value", "peer_avg")
    return rounded(f.select("outlet_code", "peer_avg"), 4, "peer_avg")


@query("win_02_group_percent_rank", """
  SELECT outlet_code, ROUND((RANK() OVER (PARTITION BY district ORDER BY active_days)
    + (COUNT(*) OVER (PARTITION BY district, active_days) - 1) / 2.0) / COUNT(*) OVER (PARTITION BY district), 9) AS pct
  FROM {feats}""")  # fmt: skip
def win_02(v: Views) -> DataFrame:
    from tallyworks.functions.ranking import percent_rank_avg

    f = percent_rank_avg(feats(v), ["district"], "active_days", "pct", ["outlet_code"])
    return rounded(f.select("outlet_code", "pct"), 9, "pct")


@query("win_03_global_percent_rank", """
  SELECT outlet_code, ROUND(growth_component, 9) AS growth_component, ROUND(vol_rank, 9) AS vol_rank FROM {scored}""")  # fmt: skip
def win_03(v: Views) -> DataFrame:
    from tallyworks.functions.ranking import percent_rank_avg

    f = ft.outlet_features(v.sales, None, as_of(), RECENT).select("outlet_code", "growth_30d", "volatility")
    f = percent_rank_avg(f, [], "growth_30d", "growth_component", ["outlet_code"])
    f = percent_rank_avg(f, [], "volatility", "vol_rank", ["outlet_code"])
    return rounded(f.select("outlet_code", "growth_component", "vol_rank"), 9, "growth_component", "vol_rank")


@query("win_07_peer_rank", """
  SELECT outlet_code, RANK() OVER (PARTITION BY district ORDER BY avg_daily_value) AS peer_rank,
    COUNT(*) OVER (PARTITION BY district) AS peers FROM {feats}""")  # fmt: skip
def win_07(v: Views) -> DataFrame:
    return ft.peer_rank(feats(v)).select("outlet_code", "peer_rank", "peers")


@query("win_11_upper_peer_median", """
  SELECT a.outlet_code, ROUND(COALESCE(LIST_SORT(LIST(b.avg_daily_value) FILTER (WHERE b.outlet_code <> a.outlet_code))
    [CAST(FLOOR(COUNT(*) FILTER (WHERE b.outlet_code <> a.outlet_code) / 2) AS BIGINT) + 1], 0), 4) AS peer_upper_median
  FROM {feats} a JOIN {feats} b ON a.district = b.district GROUP BY a.outlet_code""")  # fmt: skip
def win_11(v: Views) -> DataFrame:
    f = ft.upper_peer_median(feats(v)).select("outlet_code", "peer_upper_median")
    return rounded(f, 4, "peer_upper_median")


@query("rul_01_opportunity_score", """
  SELECT outlet_code, ROUND(opportunity_score, 6) AS opportunity_score, ROUND(peer_gap, 4) AS peer_gap,
    ROUND(estimated_uplift_inr, 3) AS estimated_uplift_inr FROM {scored}""")  # fmt: skip
def rul_01(v: Views) -> DataFrame:
    f = scored(v).select("outlet_code", "opportunity_score", "peer_gap", "estimated_uplift_inr")
    return rounded(rounded(rounded(f, 6, "opportunity_score"), 4, "peer_gap"), 3, "estimated_uplift_inr")


@query("prj_07_recommendation_confidence", """
  SELECT outlet_code, ROUND(CASE WHEN dormant THEN 0.85 ELSE LEAST(0.95, 0.4 + LEAST(1, active_days / 90.0) * 0.5
    - (CASE WHEN LEAST(1, volatility) = 0 THEN 0.5 ELSE LEAST(1, volatility) END) * 0.2) END, 6) AS confidence FROM {feats}""")  # fmt: skip
def prj_07(v: Views) -> DataFrame:
    return rounded(feats(v).select("outlet_code", ft.recommendation_confidence().alias("confidence")), 6, "confidence")


@query("ml_05_peer_zscore", """
  SELECT outlet_code, ROUND(COALESCE((avg_daily_value - AVG(avg_daily_value) OVER w) / NULLIF(STDDEV_SAMP(avg_daily_value) OVER w, 0), 0), 6)
    AS peer_z FROM {feats} WINDOW w AS (PARTITION BY district)""")  # fmt: skip
def ml_05(v: Views) -> DataFrame:
    return rounded(ft.peer_zscore(feats(v), ["district"], "avg_daily_value").select("outlet_code", "peer_z"), 6, "peer_z")


@query("mth_02_standardise", """
  SELECT outlet_code, ROUND((LN(1 + avg_daily_value) - AVG(LN(1 + avg_daily_value)) OVER ()) / STDDEV_POP(LN(1 + avg_daily_value)) OVER (), 6)
    AS z_avg_daily_value, ROUND((volatility - AVG(volatility) OVER ()) / STDDEV_POP(volatility) OVER (), 6) AS z_volatility FROM {feats}""")  # fmt: skip
def mth_02(v: Views) -> DataFrame:
    z = models.standardised(feats(v)).select("outlet_code", "z_avg_daily_value", "z_volatility")
    return rounded(z, 6, "z_avg_daily_value", "z_volatility")


# --- roll-ups and lists ------------------------------------------------------------


@query("agg_06_district_rollup", """
  SELECT district, COUNT(outlet_code) AS outlets, COUNT(*) FILTER (WHERE active_days > 0) AS active_outlets,
    COUNT(*) FILTER (WHERE dormant) AS dormant_outlets, ROUND(SUM(total_sale_value), 2) AS total_revenue,
    ROUND(SUM(recent30_value), 2) AS recent30_revenue, ROUND(MEDIAN(growth_30d), 6) AS avg_growth,
    ROUND(AVG(opportunity_score), 4) AS mean_opportunity, COUNT(*) FILTER (WHERE anomaly) AS anomalies
  FROM {flagged} GROUP BY district""")  # fmt: skip
def agg_06(v: Views) -> DataFrame:
    d = ft.district_rollup(flagged(v))
    d = rounded(rounded(d, 2, "total_revenue", "recent30_revenue"), 6, "avg_growth")
    return rounded(d, 4, "mean_opportunity")


@query("agg_05_segment_summary", """
  SELECT segment, COUNT(*) AS size, ROUND(AVG(avg_daily_value), 4) AS avg_daily_value, ROUND(AVG(growth_30d), 6) AS growth_30d,
    ROUND(AVG(volatility), 6) AS volatility, CASE segment WHEN 'Stable High-Throughput' THEN 'Maintain current assortment; monitor weekly.'
      WHEN 'Declining — Intervention Needed' THEN 'Depot review; audit for competitor / policy impact.'
      ELSE 'Standard replenishment; opportunistic premium upsell.' END AS recommended_stocking
  FROM {flagged} GROUP BY segment""")  # fmt: skip
def agg_05(v: Views) -> DataFrame:
    f = flagged_from(feats(v)).withColumn("cluster_id", F.lit(0))
    return rounded(rounded(models.segment_summary(f).drop("cluster_id"), 4, "avg_daily_value"), 6, "growth_30d", "volatility")


@query("ml_02_cluster_names", """
  SELECT cluster_id, CASE WHEN n = 1 THEN base ELSE base || ' ' || n END AS segment FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY base ORDER BY cluster_id) AS n FROM (
      SELECT n_nationkey AS cluster_id, CASE WHEN a > 0.6 AND g > 0.2 THEN 'Premium Growth Engine' WHEN a > 0.6 AND s < 0
        THEN 'Stable High-Throughput' WHEN s > 0.8 THEN 'Volatile — Tighter Replenishment' WHEN g < -0.3
        THEN 'Declining — Intervention Needed' WHEN a < -0.3 AND d < 0 THEN 'Low-Productivity — Rationalize'
        ELSE 'Steady Mid-Tier' END AS base
      FROM (SELECT n_nationkey, (n_nationkey % 5 - 2) / 2.0 AS a, (n_nationkey % 3 - 1) / 2.0 AS g, (n_nationkey % 4 - 1) / 2.0 AS s,
        (n_nationkey % 7 - 3) / 1.0 AS d FROM nation)))""")  # fmt: skip
def ml_02(v: Views) -> DataFrame:
    k = F.col("n_nationkey")
    c = v.nation.select(
        k.alias("cluster_id"), ((k % 5 - 2) / 2).alias("avg_daily_value"), ((k % 3 - 1) / 2).alias("growth_30d"),
        ((k % 4 - 1) / 2).alias("volatility"), ((k % 7 - 3) / 1).alias("active_days"))
    return models.name_clusters(c)


@query("ml_04_anomaly_reason", """
  SELECT outlet_code, CASE WHEN NOT anomaly THEN NULL WHEN parts = '' THEN 'Unusual combination of volume, trend and volatility vs population' ELSE parts END AS reason
  FROM (SELECT outlet_code, anomaly, CONCAT_WS(' · ',
      CASE WHEN growth_30d < -0.3 THEN 'Sharp decline: last 30d revenue down ' || FORMAT('{:.0f}', ROUND_EVEN(growth_30d * 100, 0)) || '% vs prior 30d' END,
      CASE WHEN growth_30d > 0.5 THEN 'Sudden spike: last 30d revenue up ' || FORMAT('{:.0f}', ROUND_EVEN(growth_30d * 100, 0)) || '% vs prior 30d' END,
      CASE WHEN volatility > 1.0 THEN 'High volatility (CV=' || FORMAT('{:.2f}', ROUND_EVEN(volatility * 100, 0) / 100) || ')' END,
      CASE WHEN dormant THEN 'No sales in last 30 days' END) AS parts FROM {flagged})""")  # fmt: skip
def ml_04(v: Views) -> DataFrame:
    return flagged_from(feats(v)).select("outlet_code", models.anomaly_reason().alias("reason"))


@query("ml_01_segments")
def ml_01(v: Views) -> DataFrame:
    rows, centroids = models.segment(feats(v))
    return rows.join(F.broadcast(models.name_clusters(centroids)), "cluster_id").select("outlet_code", "cluster_id", "segment")


@query("ml_01_segment_invariants", "SELECT COUNT(*) AS outlets, 6 AS clusters, 0 AS misplaced FROM {feats}")
def ml_01_invariants(v: Views) -> DataFrame:
    """Rows in no cluster, or at another one than the nearest, are misplaced."""
    f = feats(v)
    rows, centroids = models.segment(f)
    every = centroids.agg(F.collect_list(F.struct("cluster_id", *models.FEATURES))).scalar()
    z = models.standardised(f).withColumn("_c", every)
    far = F.transform("_c", lambda c: F.struct(c["cluster_id"].alias("c"), sum(F.pow(F.col(f"z_{x}") - c[x], 2) for x in models.FEATURES).alias("d")))
    near = z.select("outlet_code", far.alias("d"))
    met = near.join(rows.select("outlet_code", "cluster_id"), "outlet_code", "left")
    own = F.get(F.filter("d", lambda x: x["c"] == F.col("cluster_id")), F.lit(0))["d"]
    lost = ~F.coalesce(own <= F.array_min(F.transform("d", lambda x: x["d"])) + 1e-6, F.lit(False))
    return met.agg(F.count(F.lit(1)).alias("outlets"), F.countDistinct("cluster_id").cast("int").alias("clusters"), F.count_if(lost).cast("int").alias("misplaced"))


@query("ml_03_isolation_forest")
def ml_03(v: Views) -> DataFrame:
    return models.anomalies(feats(v)).select("outlet_code", "anomaly_raw", "anomaly", "anomaly_reason")


@query("ml_03_forest_invariants", """
  SELECT COUNT(*) + COUNT(*) FILTER (WHERE CAST(outlet_code AS BIGINT) % 50 = 7) AS outlets,
    COUNT(*) FILTER (WHERE CAST(outlet_code AS BIGINT) % 50 = 7) AS planted_flagged, TRUE AS share_kept, 0 AS without_reason FROM {feats}""")  # fmt: skip
def ml_03_invariants(v: Views) -> DataFrame:
    """Every fiftieth outlet comes again with values far from all others; all of these copies must be flagged."""
    f = feats(v)
    odd = f.where(F.col("outlet_code").cast("long") % 50 == 7).withColumns(
        {"outlet_code": F.concat(F.lit("odd"), "outlet_code"), **{c: F.abs(c) * 40 + 400 for c in models.ANOMALY_FEATURES}}
    )
    got = models.anomalies(f.unionByName(odd))
    n, flagged = F.count(F.lit(1)), F.count_if("anomaly")
    return got.agg(
        n.alias("outlets"), F.count_if(F.col("anomaly") & F.col("outlet_code").startswith("odd")).alias("planted_flagged"),
        (flagged <= F.ceil(n * 0.08)).alias("share_kept"), F.count_if(F.col("anomaly") != F.col("anomaly_reason").isNotNull()).cast("int").alias("without_reason"))


@query("agg_34_districts_needing_action", """
  SELECT district, ROUND(COUNT(*) FILTER (WHERE anomaly) * 2 + COUNT(*) FILTER (WHERE dormant) / COUNT(*), 6) AS score
  FROM {flagged} GROUP BY district ORDER BY 2 DESC, 1 LIMIT 5""")  # fmt: skip
def agg_34(v: Views) -> DataFrame:
    d = ft.district_rollup(flagged_from(feats(v)))
    return rounded(ft.district_scores(d).select("district", "score"), 6, "score")


@query("agg_35_district_detail", """
  SELECT 'segment' AS kind, segment AS name, CAST(COUNT(*) AS DOUBLE) AS amount FROM {flagged} WHERE district = 'NATION_3' GROUP BY segment
  UNION ALL SELECT 'depot', COALESCE(depot_code, '—'), ROUND(SUM(recent30_value), 2) FROM {flagged} WHERE district = 'NATION_3' GROUP BY 2""")  # fmt: skip
def agg_35(v: Views) -> DataFrame:
    f = flagged_from(feats(v)).where("district = 'NATION_3'")
    seg = f.groupBy(F.lit("segment").alias("kind"), F.col("segment").alias("name")).agg(
        F.count(F.lit(1)).cast("double").alias("amount"))
    dep = f.groupBy(F.lit("depot").alias("kind"), F.coalesce("depot_code", F.lit("—")).alias("name")).agg(
        F.round(F.sum("recent30_value"), 2).alias("amount"))
    return seg.unionByName(dep)


@query("agg_40_map_centroid", """
  SELECT ROUND(AVG(lat), 6) AS lat, ROUND(AVG(lng), 6) AS lng, COUNT(*) AS n FROM {outlets} WHERE lat IS NOT NULL AND lat <> 0
    AND lng IS NOT NULL AND lng <> 0""")  # fmt: skip
def agg_40(v: Views) -> DataFrame:
    return rounded(
        ft.valid_coordinates(v.outlets).agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng"), F.count(F.lit(1)).alias("n")),
        6, "lat", "lng")


@query("flt_10_valid_coordinates", """
  SELECT outlet_code, lat, lng, district FROM {outlets} WHERE lat IS NOT NULL AND lng IS NOT NULL AND lat <> 0 AND lng <> 0""")  # fmt: skip
def flt_10(v: Views) -> DataFrame:
    return ft.valid_coordinates(v.outlets).select("outlet_code", "lat", "lng", "district")


@query("flt_04_outlet_filter", """
  SELECT outlet_code, district, vendor_type FROM {outlets} WHERE district = 'NATION_7' AND vendor_type = 'BUILDING'
  ORDER BY outlet_code LIMIT 5000""")  # fmt: skip
def flt_04(v: Views) -> DataFrame:
    from tallyworks.operators.filters import equals

    df = equals(v.outlets, {"district": "NATION_7", "vendor_type": "BUILDING"}, limit=5000, order="outlet_code")
    return df.select("outlet_code", "district", "vendor_type")


@query("flt_05_point_lookup", """
  SELECT o.outlet_code, o.outlet_name, ROUND(f.avg_daily_value, 4) AS avg_daily_value FROM {outlets} o
  LEFT JOIN {feats} f ON o.outlet_code = f.outlet_code WHERE o.outlet_code = '42'""")  # fmt: skip
def flt_05(v: Views) -> DataFrame:
    from tallyworks.operators.filters import lookup_row

    side = ft.outlet_features(v.sales.where("outlet_code = '42'"), None, as_of(), RECENT)
    df = lookup_row(v.outlets, "outlet_code", "42", side.select("outlet_code", "avg_daily_value"))
    return rounded(df.select("outlet_code", "outlet_name", "avg_daily_value"), 4, "avg_daily_value")


@query("flt_06_search", """
  SELECT outlet_code, outlet_name, district FROM {outlets} WHERE LOWER(outlet_name) LIKE '%00001%' OR LOWER(district) LIKE '%00001%'
    OR LOWER(outlet_code) LIKE '%00001%'""")  # fmt: skip
def flt_06(v: Views) -> DataFrame:
    from tallyworks.operators.filters import search

    df = search(v.outlets, ["outlet_name", "outlet_code", "district"], " 00001 ")
    return df.select("outlet_code", "outlet_name", "district")


@query("set_08_facets", "SELECT DISTINCT district FROM {outlets} WHERE district <> '' ORDER BY district")
def set_08(v: Views) -> DataFrame:
    from tallyworks.operators.filters import facet

    return facet(v.outlets, "district")


@query("top_03_dashboard", """
  SELECT * FROM (SELECT 'opportunity' AS list, outlet_code, ROUND(opportunity_score, 6) AS v FROM {flagged} WHERE NOT dormant
    AND opportunity_score > 0 ORDER BY opportunity_score DESC, outlet_code LIMIT 8)
  UNION ALL SELECT * FROM (SELECT 'anomaly', outlet_code, ROUND(ABS(growth_30d), 6) FROM {flagged} WHERE anomaly
    ORDER BY ABS(growth_30d) DESC, outlet_code LIMIT 8)""")  # fmt: skip
def top_03(v: Views) -> DataFrame:
    f = flagged(v)
    opp = f.where("NOT dormant AND opportunity_score > 0").orderBy(F.desc("opportunity_score"), "outlet_code").limit(8)
    ano = f.where("anomaly").orderBy(F.desc(F.abs("growth_30d")), "outlet_code").limit(8)
    return opp.select(F.lit("opportunity").alias("list"), "outlet_code", F.round("opportunity_score", 6).alias("v")).unionByName(
        ano.select(F.lit("anomaly").alias("list"), "outlet_code", F.round(F.abs("growth_30d"), 6).alias("v")))


@query("top_04_district_lists", """
  SELECT * FROM (SELECT 'opportunity' AS list, outlet_code, ROUND(opportunity_score, 6) AS v FROM {flagged} WHERE district = 'NATION_5'
    AND NOT dormant ORDER BY opportunity_score DESC, outlet_code LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'decline', outlet_code, ROUND(growth_30d, 6) FROM {flagged} WHERE district = 'NATION_5'
    AND NOT dormant AND growth_30d < 0 ORDER BY growth_30d, outlet_code LIMIT 10)""")  # fmt: skip
def top_04(v: Views) -> DataFrame:
    f = scored(v).where("district = 'NATION_5' AND NOT dormant")
    opp = f.orderBy(F.desc("opportunity_score"), "outlet_code").limit(10)
    dec = f.where("growth_30d < 0").orderBy("growth_30d", "outlet_code").limit(10)
    return opp.select(F.lit("opportunity").alias("list"), "outlet_code", F.round("opportunity_score", 6).alias("v")).unionByName(
        dec.select(F.lit("decline").alias("list"), "outlet_code", F.round("growth_30d", 6).alias("v")))


@query("top_05_outlet_table", """
  SELECT outlet_code, ROUND(recent30_value, 2) AS recent30_value FROM {feats} ORDER BY {feats}.recent30_value DESC, outlet_code LIMIT 500""")  # fmt: skip
def top_05(v: Views) -> DataFrame:
    f = ft.outlet_features(v.sales, None, as_of(), RECENT)
    return rounded(f.orderBy(F.desc("recent30_value"), "outlet_code").limit(500).select("outlet_code", "recent30_value"), 2, "recent30_value")


@query("top_02_nlargest", """
  SELECT * FROM (SELECT 'largest' AS side, outlet_code FROM {feats} ORDER BY total_sale_value DESC, outlet_code LIMIT 40)
  UNION ALL SELECT * FROM (SELECT 'smallest', outlet_code FROM {feats} ORDER BY growth_30d, outlet_code LIMIT 30)""")  # fmt: skip
def top_02(v: Views) -> DataFrame:
    f = ft.outlet_features(v.sales, None, as_of(), RECENT)
    big = act.largest(f, "total_sale_value", 40).select(F.lit("largest").alias("side"), "outlet_code")
    return big.unionByName(act.smallest(f, "growth_30d", 30).select(F.lit("smallest").alias("side"), "outlet_code"))

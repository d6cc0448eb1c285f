"""Product and label queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.operators import features as ft
from tallyworks.operators import product as pr
from tallyworks.operators import retail as rt
from tallyworks.plans.registry import CTES, as_text, events_as_of, query, rounded
from tallyworks.plans.retail import feats
from tallyworks.sources.views import Views

# The event feed covers one month: days stand in for months, and the windows are
# 20 and 10 days.
BUCKET, LONG, SHORT = "yyyy-MM-dd", 20, 10

CTES["labels2"] = """
  SELECT *, LOWER(label_category) LIKE '%renewal%' AS is_renewal,
    LOWER(label_category) LIKE '%new label%' AND LOWER(label_category) NOT LIKE '%renewal%' AS is_new,
    strftime(approval_date, '%Y-%m-%d') AS ym FROM {label_approvals}"""
CTES["aggression"] = """
  SELECT *, ROUND_EVEN((new_labels_180d / MAX(new_labels_180d) OVER () * 0.40 + pack_sizes_touched / MAX(pack_sizes_touched) OVER () * 0.25
    + brands_touched / MAX(brands_touched) OVER () * 0.20 + active_months / MAX(active_months) OVER () * 0.15) * 1000, 0) / 1000 AS aggression_score
  FROM (SELECT distillery, COUNT(*) FILTER (WHERE is_new) AS new_labels_180d, COUNT(*) FILTER (WHERE is_renewal) AS renewals_180d,
    COUNT(application_no) AS total_labels_180d, COUNT(DISTINCT size_ml) AS pack_sizes_touched, COUNT(DISTINCT brand_name) AS brands_touched,
    COUNT(DISTINCT ym) AS active_months, AVG(mrp) AS mean_mrp
    FROM {labels2} WHERE approval_date >= DATE '2024-01-30' - 20 GROUP BY distillery)"""
CTES["brand_lbl"] = """
  SELECT *, new_labels + renewals AS total, ROUND_EVEN(new_labels / GREATEST(new_labels + renewals, 1) * 1000, 0) / 1000 AS new_share
  FROM (SELECT brand_name, COUNT(*) FILTER (WHERE is_new) AS new_labels, COUNT(*) FILTER (WHERE is_renewal) AS renewals,
    COUNT(DISTINCT distillery) AS distilleries, COUNT(DISTINCT size_ml) AS pack_sizes FROM {labels2}
    WHERE approval_date >= DATE '2024-01-30' - 20 GROUP BY brand_name)"""
CTES["mix"] = """
  SELECT price_band, n AS sku_count, ROUND_EVEN(n / SUM(n) OVER () * 1000, 0) / 1000 AS share FROM (
    SELECT price_band, COUNT(DISTINCT product_code) AS n FROM {banded} WHERE price_band <> 'UNKNOWN' GROUP BY 1)"""
CTES["fit"] = """
  SELECT vt.vendor_type, vt.outlets, vt.active AS active_outlets, b.price_band, b.target_pct, COALESCE(m.share, 0) AS catalog_pct,
    ROUND_EVEN((COALESCE(m.share, 0) - b.target_pct) * 1000, 0) / 1000 AS gap_pct
  FROM (SELECT vendor_type, COUNT(*) AS outlets, COUNT(*) FILTER (WHERE NOT dormant) AS active FROM {feats} GROUP BY 1) vt
  JOIN (SELECT * FROM (VALUES ('BUILDING', 'Economy', 0.2e0), ('BUILDING', 'Value', 0.35e0), ('BUILDING', 'Premium', 0.35e0), ('BUILDING', 'Luxury', 0.1e0),
    ('*', 'Economy', 0.4e0), ('*', 'Value', 0.35e0), ('*', 'Premium', 0.2e0), ('*', 'Luxury', 0.05e0)) p(cls, price_band, target_pct)) b
    ON b.cls = CASE WHEN vt.vendor_type = 'BUILDING' THEN 'BUILDING' ELSE '*' END
  LEFT JOIN {mix} m ON m.price_band = b.price_band"""


def since(days: int) -> Column:
    return F.date_sub(events_as_of(), days)


def products(v: Views) -> DataFrame:
    return rt.banded(v.products)


def labels(v: Views) -> DataFrame:
    return rt.label_flags(v.label_approvals, BUCKET)


def aggression(v: Views) -> DataFrame:
    return pr.supplier_aggression(labels(v), since(LONG), None)


def fit(v: Views) -> DataFrame:
    priors = {"BUILDING": pr.PRIORS["Bars"], "*": pr.PRIORS["A4"]}
    vendors = ft.vendor_rollup(feats(v))
    return pr.fit_profile(vendors, pr.catalogue_mix(products(v)), priors, "*")


@query("agg_07_density_cube", """
  SELECT price_band, pack_bucket, category, COUNT(*) AS sku_count FROM {banded} GROUP BY ALL""")  # fmt: skip
def agg_07(v: Views) -> DataFrame:
    return pr.density(products(v))


@query("agg_08_label_timeline", """
  SELECT *, COALESCE(total - LAG(total) OVER (ORDER BY ym), 0) AS mom_delta FROM (SELECT ym, COUNT(*) FILTER (WHERE is_new) AS new_labels,
    COUNT(*) FILTER (WHERE is_renewal) AS renewals, COUNT(application_no) AS total FROM {labels2} GROUP BY ym)""")  # fmt: skip
def agg_08(v: Views) -> DataFrame:
    return pr.label_timeline(labels(v))


@query("win_05_first_difference", """
  SELECT ym, COALESCE(COUNT(*) - LAG(COUNT(*)) OVER (ORDER BY ym), 0) AS mom_delta FROM {labels2} GROUP BY ym""")  # fmt: skip
def win_05(v: Views) -> DataFrame:
    return pr.label_timeline(labels(v)).select("ym", "mom_delta")


@query("agg_09_supplier_aggression", """
  SELECT * REPLACE (ROUND(mean_mrp, 4) AS mean_mrp) FROM {aggression} ORDER BY aggression_score DESC, distillery NULLS LAST LIMIT 20""")  # fmt: skip
def agg_09(v: Views) -> DataFrame:
    return rounded(pr.supplier_aggression(labels(v), since(LONG)), 4, "mean_mrp")


@query("agg_10_brand_label_mix", """
  SELECT * FROM (SELECT 'emerging' AS list, * FROM {brand_lbl} WHERE new_share >= 0.5 AND new_labels >= 1
    ORDER BY new_labels DESC, pack_sizes DESC, brand_name LIMIT 20)
  UNION ALL SELECT * FROM (SELECT 'renewal_heavy', * FROM {brand_lbl} WHERE renewals >= 2 AND new_share <= 0.33
    ORDER BY renewals DESC, brand_name LIMIT 20)""")  # fmt: skip
def agg_10(v: Views) -> DataFrame:
    b = pr.brand_labels(labels(v), since(LONG)).drop("first_approval", "last_approval")
    return pr.emerging(b).withColumn("list", F.lit("emerging")).unionByName(
        pr.renewal_heavy(b).withColumn("list", F.lit("renewal_heavy")))


@query("agg_11_supplier_timeline", """
  SELECT distillery, ym, COUNT(*) AS labels FROM {labels2} WHERE distillery IN (SELECT distillery FROM {aggression}
    WHERE distillery IS NOT NULL ORDER BY aggression_score DESC, distillery LIMIT 10) GROUP BY 1, 2""")  # fmt: skip
def agg_11(v: Views) -> DataFrame:
    return pr.supplier_timeline(labels(v), aggression(v))


@query("agg_12_overcrowded", """
  SELECT * REPLACE (ROUND(mean_mrp, 4) AS mean_mrp) FROM (SELECT category, price_band, COUNT(DISTINCT product_code) AS sku_count,
    COUNT(DISTINCT brand_code) AS brand_count, COUNT(DISTINCT supplier_code) AS supplier_count, AVG(mrp) AS mean_mrp,
    ROUND_EVEN(COUNT(DISTINCT product_code) / COUNT(DISTINCT brand_code) * 100, 0) / 100 AS density_score FROM {banded} GROUP BY 1, 2)
  WHERE sku_count >= 10 ORDER BY sku_count DESC, density_score DESC, category, price_band LIMIT 15""")  # fmt: skip
def agg_12(v: Views) -> DataFrame:
    return rounded(pr.overcrowded(products(v)), 4, "mean_mrp")


@query("agg_13_pack_proliferation", """
  SELECT brand_name, brand_type, COUNT(DISTINCT size_ml) AS pack_sizes, COUNT(DISTINCT product_code) AS sku_count,
    ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT size_ml)), ', ') AS pack_list, COUNT(DISTINCT distillery) AS distilleries
  FROM {banded} GROUP BY 1, 2 HAVING COUNT(DISTINCT size_ml) >= 3 ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 20""")  # fmt: skip
def agg_13(v: Views) -> DataFrame:
    return as_text(pr.pack_proliferation(products(v)), "pack_list")


@query("agg_14_redundancy", """
  SELECT *, ROUND_EVEN(((sku_count - 1) * 0.3 + (supplier_count - 1) * 0.2 + price_spread / GREATEST(MAX(price_spread) OVER (), 1) * 0.5) * 100, 0) / 100
    AS cannibalization_score FROM (SELECT brand_name, pack_bucket, COUNT(DISTINCT product_code) AS sku_count,
      COALESCE(MAX(mrp) - MIN(mrp), 0) AS price_spread, COUNT(DISTINCT supplier_code) AS supplier_count FROM {banded} GROUP BY 1, 2
      HAVING COUNT(DISTINCT product_code) >= 3) ORDER BY cannibalization_score DESC, sku_count DESC, brand_name, pack_bucket LIMIT 50""")  # fmt: skip
def agg_14(v: Views) -> DataFrame:
    return pr.redundancy(products(v))


@query("agg_15_catalogue_mix", "SELECT * FROM {mix}")
def agg_15(v: Views) -> DataFrame:
    return pr.catalogue_mix(products(v))


@query("agg_16_vendor_rollup", """
  SELECT vendor_type, COUNT(*) AS outlets, COUNT(*) FILTER (WHERE NOT dormant) AS active, ROUND(SUM(recent30_value), 2) AS revenue_30d,
    ROUND(AVG(avg_daily_value), 4) AS avg_daily FROM {feats} GROUP BY 1""")  # fmt: skip
def agg_16(v: Views) -> DataFrame:
    return rounded(rounded(ft.vendor_rollup(feats(v)), 2, "revenue_30d"), 4, "avg_daily")


@query("jn_05_target_priors", "SELECT vendor_type, price_band, target_pct FROM {fit}")
def jn_05(v: Views) -> DataFrame:
    return fit(v).select("vendor_type", "price_band", "target_pct")


@query("agg_17_fit_profile", """
  SELECT *, CASE WHEN gap_pct < -0.05 THEN 'under-represented' WHEN gap_pct > 0.05 THEN 'over-represented' ELSE 'aligned' END AS direction
  FROM {fit}""")  # fmt: skip
def agg_17(v: Views) -> DataFrame:
    return fit(v).drop("revenue_30d")


@query("agg_38_fit_grid", """
  SELECT vendor_type, MAX(gap_pct) FILTER (WHERE price_band = 'Economy') AS "Economy", MAX(gap_pct) FILTER (WHERE price_band = 'Value') AS "Value",
    MAX(gap_pct) FILTER (WHERE price_band = 'Premium') AS "Premium", MAX(gap_pct) FILTER (WHERE price_band = 'Luxury') AS "Luxury"
  FROM {fit} GROUP BY 1""")  # fmt: skip
def agg_38(v: Views) -> DataFrame:
    return pr.fit_grid(fit(v))


@query("agg_18_mixes", """
  SELECT 'brand_type' AS dim, brand_type AS a, NULL AS b, COUNT(*) AS rows, COUNT(DISTINCT product_code) AS sku_count,
    COUNT(DISTINCT brand_code) AS brand_count, COUNT(DISTINCT supplier_code) AS supplier_count FROM {banded} GROUP BY 2
  UNION ALL SELECT 'supplier_type', supplier_type, NULL, COUNT(*), COUNT(DISTINCT product_code), COUNT(DISTINCT brand_code),
    COUNT(DISTINCT supplier_code) FROM {banded} GROUP BY 2
  UNION ALL SELECT 'type_band', brand_type, price_band, COUNT(*), COUNT(DISTINCT product_code), COUNT(DISTINCT brand_code),
    COUNT(DISTINCT supplier_code) FROM {banded} GROUP BY 2, 3""")  # fmt: skip
def agg_18(v: Views) -> DataFrame:
    p = products(v)

    def dim(name: str, *keys: str) -> DataFrame:
        m = pr.mix(p, *keys)
        b = F.col(keys[1]) if len(keys) > 1 else F.lit(None).cast("string")
        return m.select(F.lit(name).alias("dim"), F.col(keys[0]).alias("a"), b.alias("b"), "rows", "sku_count", "brand_count", "supplier_count")

    return dim("brand_type", "brand_type").unionByName(dim("supplier_type", "supplier_type")).unionByName(
        dim("type_band", "brand_type", "price_band"))


@query("agg_19_brand_leaderboard", """
  SELECT brand_name, brand_type, sku_count, supplier_count, ROUND(mean_mrp, 4) AS mean_mrp, price_bands, pack_buckets FROM {brands}
  ORDER BY sku_count DESC, {brands}.mean_mrp DESC, brand_name, brand_type LIMIT 40""")  # fmt: skip
def agg_19(v: Views) -> DataFrame:
    b = pr.leaderboard(rt.brand_rollup(products(v)))
    return rounded(b.select("brand_name", "brand_type", "sku_count", "supplier_count", "mean_mrp", "price_bands", "pack_buckets"), 4, "mean_mrp")


@query("win_06_share_of_max", """
  SELECT brand_name, brand_type, ROUND(sku_count / MAX(sku_count) OVER (), 6) AS proliferation FROM {brands}""")  # fmt: skip
def win_06(v: Views) -> DataFrame:
    b = rt.brand_rollup(products(v)).select("brand_name", "brand_type", F.col("sku_spread_ratio").alias("proliferation"))
    return rounded(b, 6, "proliferation")


@query("agg_20_supplier_footprint", """
  SELECT supplier_code, supplier_type, COUNT(DISTINCT product_code) AS sku_count, COUNT(DISTINCT brand_code) AS brand_count,
    COUNT(DISTINCT distillery) AS distillery_count, ROUND(AVG(mrp), 4) AS mean_mrp,
    ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT brand_type)), ', ') AS brand_types,
    (SELECT category FROM {banded} q WHERE q.supplier_code = p.supplier_code GROUP BY category ORDER BY COUNT(*) DESC, category LIMIT 1) AS top_category
  FROM {banded} p GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 30""")  # fmt: skip
def agg_20(v: Views) -> DataFrame:
    return rounded(pr.supplier_footprint(products(v)), 4, "mean_mrp")


CTES["distilleries"] = """
  SELECT p.*, COALESCE(l.n, 0) AS recent_labels_90d, COALESCE(l.m, 0) AS recent_new_90d FROM (
    SELECT distillery, COUNT(DISTINCT product_code) AS sku_count, COUNT(DISTINCT brand_code) AS brand_count,
      COUNT(DISTINCT supplier_code) AS supplier_count, ROUND(AVG(mrp), 4) AS mean_mrp,
      ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT brand_type)), ', ') AS brand_types FROM {banded} GROUP BY 1) p
  LEFT JOIN (SELECT distillery, COUNT(*) AS n, COUNT(*) FILTER (WHERE is_new) AS m FROM {labels2}
    WHERE approval_date >= DATE '2024-01-30' - 10 GROUP BY 1) l ON p.distillery IS NOT DISTINCT FROM l.distillery"""


@query("agg_21_distillery_footprint", "SELECT * FROM {distilleries} ORDER BY sku_count DESC, recent_labels_90d DESC, distillery LIMIT 30")
def agg_21(v: Views) -> DataFrame:
    return rounded(pr.distillery_footprint(products(v), labels(v), since(SHORT)), 4, "mean_mrp")


@query("jn_04_null_key_join", "SELECT distillery, recent_labels_90d, recent_new_90d FROM {distilleries}")
def jn_04(v: Views) -> DataFrame:
    d = pr.distillery_footprint(products(v), labels(v), since(SHORT), None)
    return d.select("distillery", "recent_labels_90d", "recent_new_90d")


@query("agg_22_label_churn", "SELECT ym AS month, COUNT(*) AS approvals FROM {labels2} GROUP BY ym")
def agg_22(v: Views) -> DataFrame:
    return pr.label_churn(labels(v))


@query("agg_23_launch_watchlist", """
  SELECT distillery, brand_name, COUNT(*) AS recent_labels, COUNT(*) FILTER (WHERE is_new) AS new_labels, COUNT(*) FILTER (WHERE is_renewal) AS renewals
  FROM {labels2} WHERE approval_date >= DATE '2024-01-30' - 10 GROUP BY 1, 2 ORDER BY 3 DESC, 1 NULLS LAST, 2 LIMIT 40""")  # fmt: skip
def agg_23(v: Views) -> DataFrame:
    return pr.launch_watchlist(labels(v), since(SHORT))


@query("agg_24_scalar_totals", """
  SELECT (SELECT COUNT(*) FROM {banded}) AS sku_total, (SELECT COUNT(*) FROM {brands}) AS brand_total,
    (SELECT COUNT(DISTINCT supplier_code) FROM {banded}) AS supplier_total, (SELECT COUNT(DISTINCT distillery) FROM {banded}) AS distillery_total,
    COUNT(*) AS label_total, COUNT(*) FILTER (WHERE is_new) AS new_labels_total, COUNT(*) FILTER (WHERE is_renewal) AS renewal_total,
    COUNT(*) FILTER (WHERE approval_date >= DATE '2024-01-30' - 10) AS recent_90d_labels,
    COUNT(*) FILTER (WHERE approval_date >= DATE '2024-01-30' - 10 AND is_new) AS recent_90d_new_labels FROM {labels2}""")  # fmt: skip
def agg_24(v: Views) -> DataFrame:
    return pr.scalar_totals(products(v), rt.brand_rollup(products(v)), labels(v), since(SHORT))


@query("agg_25_category_distribution", "SELECT category, COUNT(*) AS n FROM {banded} WHERE category IS NOT NULL GROUP BY 1")
def agg_25(v: Views) -> DataFrame:
    return pr.category_distribution(products(v))


_BUCKETS = [n for _, n in rt.PACK_BUCKETS] + [rt.TOP_BUCKET]


@query("agg_37_band_pack_matrix", "SELECT *, GREATEST(1, " + ", ".join(f'MAX("{b}") OVER ()' for b in _BUCKETS) + ") AS max_cell FROM (SELECT price_band, "
       + ", ".join(f"COUNT(*) FILTER (WHERE pack_bucket = '{b}') AS \"{b}\"" for b in _BUCKETS) + " FROM {banded} GROUP BY 1)")
def agg_37(v: Views) -> DataFrame:
    return pr.band_pack_matrix(pr.density(products(v)), _BUCKETS)


@query("top_01_sorted_heads", """
  SELECT * FROM (SELECT 'category' AS list, category AS name, COUNT(*) AS n FROM {banded} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
  UNION ALL SELECT * FROM (SELECT 'brand', brand_name, SUM(sku_count)::BIGINT FROM {brands} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 12)""")  # fmt: skip
def top_01(v: Views) -> DataFrame:
    cats = pr.category_distribution(products(v)).orderBy(F.desc("n"), "category").limit(10)
    brands = rt.brand_rollup(products(v)).groupBy("brand_name").agg(F.sum("sku_count").alias("n"))
    return cats.select(F.lit("category").alias("list"), F.col("category").alias("name"), "n").unionByName(
        brands.orderBy(F.desc("n"), "brand_name").limit(12).select(F.lit("brand").alias("list"), F.col("brand_name").alias("name"), "n"))

"""Action and signal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.ranking import row_numbers
from tallyworks.operators import actions as act
from tallyworks.operators import product as pr
from tallyworks.plans.product import aggression, products
from tallyworks.plans.registry import CTES, query, rounded
from tallyworks.plans.retail import feats, flagged, flagged_from, scored
from tallyworks.session import checkpointed
from tallyworks.sources.views import Views

_W = "FORMAT('{{:.0f}}', ROUND_EVEN({0}, 0))"
_G = "FORMAT('{{:,}}', CAST(ROUND_EVEN({0}, 0) AS BIGINT))"
_T = "FORMAT('{{:.2f}}', ROUND_EVEN(({0}) * 100, 0) / 100)"
_OUT = "'outlet' AS entity_type, district, depot_code AS depot, outlet_name AS outlet, outlet_code"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _text(branch: str) -> str:
    t = act.TEXTS[branch]
    return f"{_lit(t['category'])} AS category, {_lit(t['issue'])} AS issue, {_lit(t['action'])} AS action, {_lit(t['window'])} AS expected_outcome_window, '{branch}' AS branch"


CTES["rising"] = f"""
  SELECT {_OUT}, {_text('rising')}, ROUND_EVEN(LEAST(0.95, 0.6 + (1 - volatility) * 0.3) * 100, 0) / 100 AS confidence,
    recent30_value * GREATEST(growth_30d, 0) * 0.3 AS revenue_impact_inr, CASE WHEN growth_30d > 0.5 THEN 'High' ELSE 'Medium' END AS urgency,
    'Last 30d revenue up ' || {_W.format('growth_30d * 100')} || '% vs prior 30d; CV=' || {_T.format('volatility')} ||
    ' (stable). Segment ''' || segment || ''' typically has absorption capacity for premium.' AS reason, 'sales-demand' AS data_source
  FROM (SELECT * FROM {{flagged}} WHERE growth_30d > 0.25 AND volatility < 0.8 AND NOT dormant ORDER BY recent30_value DESC, outlet_code LIMIT 40)"""
CTES["peer_gap_actions"] = f"""
  SELECT {_OUT}, {_text('peer_gap')}, ROUND_EVEN((0.55 + opportunity_score / 100 * 0.35) * 100, 0) / 100 AS confidence,
    estimated_uplift_inr AS revenue_impact_inr, 'Medium' AS urgency, 'Avg daily revenue ₹' || {_G.format('avg_daily_value')} || ' vs district peer median ₹' ||
    {_G.format('peer_avg')} || '. Opportunity score ' || {_W.format('opportunity_score')} || '/100.' AS reason, 'sales-demand' AS data_source
  FROM (SELECT * FROM {{flagged}} ORDER BY opportunity_score DESC, outlet_code LIMIT 40) WHERE opportunity_score >= 70 AND NOT dormant"""
CTES["declining"] = f"""
  SELECT {_OUT}, {_text('declining')}, 0.78e0 AS confidence, GREATEST(prev30_value - recent30_value, 0) AS revenue_impact_inr, 'High' AS urgency,
    'Revenue down ' || {_W.format('growth_30d * 100')} || '% in last 30d vs prior 30d while peers in ' || district || ' remained stable.' AS reason,
    'sales-demand' AS data_source
  FROM (SELECT * FROM {{flagged}} WHERE growth_30d < -0.3 AND NOT dormant AND active_days > 8 ORDER BY growth_30d, outlet_code LIMIT 30)"""
CTES["dormant_actions"] = f"""
  SELECT {_OUT}, {_text('dormant')}, 0.85e0 AS confidence, avg_daily_value * 30 AS revenue_impact_inr, 'High' AS urgency,
    'Outlet had ₹' || {_G.format('total_sale_value')} || ' lifetime revenue but 0 sales in last 30d.' AS reason, 'sales-demand' AS data_source
  FROM (SELECT * FROM {{flagged}} WHERE dormant AND total_sale_value > 0 ORDER BY total_sale_value DESC, outlet_code LIMIT 20)"""
CTES["district_actions"] = f"""
  SELECT 'district' AS entity_type, district, NULL AS depot, NULL AS outlet, NULL AS outlet_code, 'All' AS category,
    'District-wide demand trending up (median outlet growth ' || {_W.format('growth * 100')} || '%)' AS issue,
    {_lit(act.TEXTS['district_push']['action'])} AS action, '21 days' AS expected_outcome_window, 'district_push' AS branch, 0.7e0 AS confidence,
    total * growth * 0.2 AS revenue_impact_inr, 'Medium' AS urgency, outlets || ' outlets in ' || district || ' show consistent uplift in last 30d.' AS reason,
    'sales-demand' AS data_source
  FROM (SELECT district, SUM(recent30_value) AS total, COUNT(*) AS outlets, MEDIAN(growth_30d) AS growth FROM {{flagged}} GROUP BY 1) WHERE growth > -0.05"""
CTES["churn_action"] = f"""
  SELECT 'supplier' AS entity_type, NULL AS district, NULL AS depot, NULL AS outlet, NULL AS outlet_code, {_text('supplier_churn')}, 0.6e0 AS confidence,
    CAST(NULL AS DOUBLE) AS revenue_impact_inr, 'Low' AS urgency, {_lit(act.TEXTS['supplier_churn']['reason'])} AS reason, 'sales-demand' AS data_source"""
_NONE = "NULL AS district, NULL AS depot, NULL AS outlet, NULL AS outlet_code"
CTES["aggressive"] = f"""
  SELECT 'supplier' AS entity_type, {_NONE}, 'Brand & label proxy' AS category, 'Aggressive supplier expansion — ' || new_labels_180d || ' new labels across ' ||
    pack_sizes_touched || ' pack sizes in 180 days' AS issue, 'Monitor ' || COALESCE(distillery, 'distillery') ||
    ' rollout; pre-allocate shelf in high-throughput outlets where brand mix fits' AS action, '45–90 days' AS expected_outcome_window,
    'aggressive_supplier' AS branch, ROUND_EVEN(LEAST(0.9, 0.55 + aggression_score * 0.35) * 100, 0) / 100 AS confidence, CAST(NULL AS DOUBLE) AS revenue_impact_inr,
    CASE WHEN aggression_score > 0.5 THEN 'Medium' ELSE 'Low' END AS urgency, 'Label feed: ' || new_labels_180d || ' new / ' || renewals_180d || ' renewal across ' ||
    brands_touched || ' brands in ' || active_months || ' active months. Aggression score ' || {_T.format('aggression_score')} || '.' AS reason,
    'proxy-brand-label' AS data_source
  FROM (SELECT * FROM {{aggression}} ORDER BY aggression_score DESC, distillery NULLS LAST LIMIT 6) WHERE new_labels_180d >= 3"""
CTES["crowded"] = """
  SELECT category, price_band, COUNT(DISTINCT product_code) AS sku_count, COUNT(DISTINCT brand_code) AS brand_count, COUNT(DISTINCT supplier_code) AS supplier_count,
    ROUND_EVEN(COUNT(DISTINCT product_code) / COUNT(DISTINCT brand_code) * 100, 0) / 100 AS density_score FROM {banded} GROUP BY 1, 2
  HAVING COUNT(DISTINCT product_code) >= 10"""
CTES["crowded_actions"] = f"""
  SELECT 'category' AS entity_type, {_NONE}, category || ' · ' || price_band AS category, 'Overcrowded segment — ' || sku_count || ' SKUs / ' || brand_count ||
    ' brands / ' || supplier_count || ' suppliers' AS issue, {_lit(act.TEXTS['overcrowded']['action'])} AS action, 'Next excise year' AS expected_outcome_window,
    'overcrowded' AS branch, 0.65e0 AS confidence, CAST(NULL AS DOUBLE) AS revenue_impact_inr, 'Low' AS urgency, 'Density ' || density_score ||
    ' SKUs per brand suggests cannibalization.' AS reason, 'proxy-brand-label' AS data_source
  FROM (SELECT * FROM {{crowded}} ORDER BY sku_count DESC, density_score DESC, category, price_band LIMIT 5) WHERE sku_count >= 40"""
CTES["pack_actions"] = f"""
  SELECT 'brand' AS entity_type, {_NONE}, 'Brand & label proxy' AS category, 'Pack-size proliferation — ''' || brand_name || ''' across ' || pack_sizes || ' sizes' AS issue,
    {_lit(act.TEXTS['pack_proliferation']['action'])} AS action, '60 days' AS expected_outcome_window, 'pack_proliferation' AS branch, 0.55e0 AS confidence,
    CAST(NULL AS DOUBLE) AS revenue_impact_inr, 'Low' AS urgency, sku_count || ' SKUs · ' || distilleries || ' distilleries · sizes [' || pack_list || ']' AS reason,
    'proxy-brand-label' AS data_source
  FROM (SELECT brand_name, brand_type, COUNT(DISTINCT size_ml) AS pack_sizes, COUNT(DISTINCT product_code) AS sku_count, COUNT(DISTINCT distillery) AS distilleries,
      ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT size_ml)), ', ') AS pack_list FROM {{banded}} GROUP BY 1, 2 HAVING COUNT(DISTINCT size_ml) >= 3
    ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 6)"""
CTES["premium"] = f"""
  SELECT {_OUT}, {_text('premium_push')}, 0.7e0 AS confidence, recent30_value * 0.08 AS revenue_impact_inr, 'Medium' AS urgency, '30d growth ' ||
    {_W.format('growth_30d * 100')} || '% · vendor_type ' || vendor_type || ' · prior assortment fit suggests headroom at higher band.' AS reason,
    'proxy-brand-label' AS data_source
  FROM (SELECT * FROM {{flagged}} WHERE growth_30d > 0.3 AND NOT dormant AND vendor_type IN ('BUILDING', 'MACHINERY') ORDER BY recent30_value DESC, outlet_code LIMIT 15)"""
CTES["prune_actions"] = f"""
  SELECT {_OUT}, {_text('prune')}, 0.6e0 AS confidence, CAST(NULL AS DOUBLE) AS revenue_impact_inr, 'Low' AS urgency, 'Segment ''' || segment ||
    ''' · avg daily revenue ₹' || {_G.format('avg_daily_value')} || '. Pack proliferation signal suggests pruning has low demand risk.' AS reason,
    'proxy-brand-label' AS data_source
  FROM (SELECT * FROM {{flagged}} WHERE vendor_type = 'FURNITURE' AND NOT dormant AND (segment LIKE '%Low-Productivity%' OR segment LIKE '%Declining%')
    ORDER BY recent30_value, outlet_code LIMIT 10)"""
_BRANCHES = (
    "rising", "peer_gap_actions", "declining", "dormant_actions", "district_actions", "churn_action", "aggressive", "crowded_actions",
    "pack_actions", "premium", "prune_actions",
)
CTES["all_actions"] = " UNION ALL BY NAME ".join(f"SELECT * FROM {{{b}}}" for b in _BRANCHES)


def _sql(cte: str) -> str:
    return f"SELECT * REPLACE (ROUND(revenue_impact_inr, 3) AS revenue_impact_inr) FROM {{{cte}}}"


def _out(df: DataFrame) -> DataFrame:
    return rounded(df, 3, "revenue_impact_inr")


def declining(f: DataFrame) -> DataFrame:
    # Driver customers have about ten sales days; the operator's own bound is 30.
    return act.declining(f, more_days=8)


def branches(v: Views) -> list[DataFrame]:
    f = checkpointed(flagged(v))  # seven branches read the scored outlets
    p = products(v)
    return [
        act.rising(f), act.peer_gap(f), declining(f), act.dormant(f), act.district_push(f, -0.05), act.supplier_churn(f),
        act.aggressive_suppliers(aggression(v)), act.overcrowded_segments(pr.overcrowded(p)), act.pack_pruning(pr.pack_proliferation(p)),
        act.premium_push(f, ("BUILDING", "MACHINERY")), act.prune(f, "FURNITURE"),
    ]


@query("act_01_rising", _sql("rising"))
def act_01(v: Views) -> DataFrame:
    return _out(act.rising(flagged_from(feats(v))))


@query("act_02_peer_gap", _sql("peer_gap_actions"))
def act_02(v: Views) -> DataFrame:
    return _out(act.peer_gap(scored(v)))


@query("act_03_declining", _sql("declining"))
def act_03(v: Views) -> DataFrame:
    return _out(declining(feats(v)))


@query("act_04_dormant", _sql("dormant_actions"))
def act_04(v: Views) -> DataFrame:
    return _out(act.dormant(feats(v)))


@query("act_05_district_push", _sql("district_actions"))
def act_05(v: Views) -> DataFrame:
    return _out(act.district_push(feats(v), -0.05))


@query("act_07_aggressive_suppliers", _sql("aggressive"))
def act_07(v: Views) -> DataFrame:
    return _out(act.aggressive_suppliers(aggression(v)))


@query("act_08_overcrowded", _sql("crowded_actions"))
def act_08(v: Views) -> DataFrame:
    return _out(act.overcrowded_segments(pr.overcrowded(products(v))))


@query("act_09_pack_pruning", _sql("pack_actions"))
def act_09(v: Views) -> DataFrame:
    return _out(act.pack_pruning(pr.pack_proliferation(products(v))))


@query("act_10_premium_push", _sql("premium"))
def act_10(v: Views) -> DataFrame:
    return _out(act.premium_push(feats(v), ("BUILDING", "MACHINERY")))


@query("act_11_prune", _sql("prune_actions"))
def act_11(v: Views) -> DataFrame:
    return _out(act.prune(flagged_from(feats(v)), "FURNITURE"))


@query("set_05_action_union", _sql("all_actions"))
def set_05(v: Views) -> DataFrame:
    """All eleven branches, among them the standing notice (ACT-06)."""
    return _out(act.union(*branches(v)))


@query("agg_36_action_counters", """
  SELECT COUNT(*) FILTER (WHERE urgency = 'High') AS high, COUNT(*) FILTER (WHERE urgency = 'Medium') AS medium, COUNT(*) FILTER (WHERE urgency = 'Low') AS low,
    ROUND(SUM(COALESCE(revenue_impact_inr, 0)), 2) AS total_impact, COUNT(*) FILTER (WHERE data_source = 'sales-demand') AS sales_count,
    COUNT(*) FILTER (WHERE data_source = 'proxy-brand-label') AS proxy_count FROM {all_actions}""")  # fmt: skip
def agg_36(v: Views) -> DataFrame:
    return rounded(act.counters(act.union(*branches(v))), 2, "total_impact")


@query("top_06_action_order", """
  SELECT branch, outlet_code, district, urgency, ROW_NUMBER() OVER (ORDER BY CASE urgency WHEN 'High' THEN 0 WHEN 'Medium' THEN 1 WHEN 'Low' THEN 2 ELSE 3 END,
    COALESCE(ROUND(revenue_impact_inr, 3), 0) DESC, branch, outlet_code NULLS FIRST, district NULLS FIRST, reason NULLS FIRST) AS place FROM {all_actions}""")  # fmt: skip
def top_06(v: Views) -> DataFrame:
    """The whole list with its places."""
    a = _out(act.union(*branches(v))).withColumns({"u": act.urgency_rank(), "i": F.coalesce("revenue_impact_inr", F.lit(0.0))})
    return row_numbers(a, [], ["u", F.desc("i"), *act.TIES], "place").select("branch", "outlet_code", "district", "urgency", "place")


@query("str_18_template_text", """
  SELECT s_suppkey, 'Balance ₹' || FORMAT('{:,}', CAST(ROUND_EVEN(s_acctbal, 0) AS BIGINT)) || ' up ' || FORMAT('{:.0f}', ROUND_EVEN(s_acctbal / 8, 0)) || '% CV='
    || FORMAT('{:.2f}', ROUND_EVEN(s_acctbal / 7 * 100, 0) / 100) AS message FROM supplier""")  # fmt: skip
def str_18(v: Views) -> DataFrame:
    b = F.col("s_acctbal")
    msg = act.text("Balance ₹", act.grouped(b), " up ", act.whole(b / 8), "% CV=", act.two(b / 7))
    return v.supplier.select("s_suppkey", msg.alias("message"))


CTES["signals"] = """
  SELECT event_id AS source, value / 400 AS confidence, CASE event_type WHEN 'click' THEN 'forecast' WHEN 'view' THEN 'forecast + mix'
    WHEN 'error' THEN 'action priorities' ELSE 'mix' END AS alters FROM events"""


def signals(v: Views) -> DataFrame:
    t = F.col("event_type")
    alters = F.when(t == "click", "forecast").when(t == "view", "forecast + mix").when(t == "error", "action priorities").otherwise("mix")
    return v.events.select(F.col("event_id").alias("source"), (F.col("value") / 400).alias("confidence"), alters.alias("alters"))


@query("agg_39_signal_counters", """
  SELECT COUNT(*) AS signals, COUNT(*) FILTER (WHERE confidence > 0.7) AS high_confidence, COUNT(*) FILTER (WHERE alters LIKE '%forecast%') AS alters_forecast,
    COUNT(*) FILTER (WHERE alters LIKE '%action%') AS alters_action FROM {signals}""")  # fmt: skip
def agg_39(v: Views) -> DataFrame:
    return act.signal_counters(signals(v))

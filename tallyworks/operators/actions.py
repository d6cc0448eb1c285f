"""Ranked action rows from sales features and from label and product signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.numbers import half_even
from tallyworks.functions.ranking import group_median
from tallyworks.functions.skew import HOT_ROWS

FIELDS = (
    "entity_type", "district", "depot", "outlet", "outlet_code", "category", "issue", "confidence",
    "revenue_impact_inr", "urgency", "action", "reason", "expected_outcome_window", "data_source", "branch",
)

# Texts of the rows, by branch.
TEXTS = {
    "rising": {
        "category": "Premium / IMFL",
        "issue": "Outlet demand rising sharply with stable delivery pattern",
        "action": "Increase allocation by 10–20% and push premium pack mix",
        "window": "14–21 days",
    },
    "peer_gap": {
        "category": "Mixed assortment",
        "issue": "Outlet underperforming vs district peer median",
        "action": "Review assortment fit — push higher-band packs; audit supplier mix",
        "window": "30–60 days",
    },
    "declining": {
        "category": "All categories",
        "issue": "Sharp revenue decline vs peer district",
        "action": "Visit outlet; check competitor activity and stock fill rate",
        "window": "7–14 days",
    },
    "dormant": {
        "category": "All",
        "issue": "No sales in last 30 days — historically active outlet",
        "action": "Contact outlet; verify license status and replenishment block",
        "window": "Immediate",
    },
    "district_push": {
        "category": "All",
        "action": "Coordinate with depot to front-load next 2 weekly dispatches",
        "window": "21 days",
    },
    "supplier_churn": {
        "category": "New labels (last 90d)",
        "issue": "Elevated label-approval activity may shift outlet mix",
        "action": "Prioritize supplier / replenishment review for distilleries with >3 new labels in 90 days",
        "reason": "Label approval feed shows concentrated activity by a small set of distilleries.",
        "window": "30 days",
    },
    "aggressive_supplier": {"category": "Brand & label proxy", "window": "45–90 days"},
    "overcrowded": {
        "action": "Review assortment discipline; encourage consolidation of lowest-velocity SKUs at next "
        "label-renewal cycle",
        "window": "Next excise year",
    },
    "pack_proliferation": {
        "category": "Brand & label proxy",
        "action": "Prune pack-size variants in low-throughput (A4 low-productivity) outlets",
        "window": "60 days",
    },
    "premium_push": {
        "category": "Brand-mix / assortment",
        "issue": "High-growth outlet — premium SKU presence likely under-penetrated",
        "action": "Increase Premium / Luxury SKU presence; track weekly offtake",
        "window": "30 days",
    },
    "prune": {
        "category": "Brand-mix / assortment",
        "issue": "Low-productivity outlet — redundant pack sizes likely drag mix",
        "action": "Simplify assortment — drop duplicate packs, retain top-velocity SKU per brand",
        "window": "45 days",
    },
}
SALES, PROXY = "sales-demand", "proxy-brand-label"
PUSH_CLASSES = ("Bars", "Clubs", "Tourism", "A4")


def whole(c: str | Column) -> Column:
    """Number without decimals, ties to even, as text."""
    return F.format_string("%.0f", half_even(c))


def grouped(c: str | Column) -> Column:
    """Number without decimals, with thousands separators."""
    return F.format_number(half_even(c), 0)


def two(c: str | Column) -> Column:
    return F.format_string("%.2f", half_even(c, 2))


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _rows(df: DataFrame, branch: str, entity: str, source: str, outlet: bool = False, **over: Column | str) -> DataFrame:
    t = TEXTS[branch]
    none = F.lit(None).cast("string")
    vals: dict[str, Column] = {
        "entity_type": F.lit(entity),
        "district": F.col("district") if outlet else none,
        "depot": F.col("depot_code") if outlet else none,
        "outlet": F.col("outlet_name") if outlet else none,
        "outlet_code": F.col("outlet_code") if outlet else none,
        "category": F.lit(t.get("category")),
        "issue": F.lit(t.get("issue")),
        "action": F.lit(t.get("action")),
        "reason": F.lit(t.get("reason")),
        "revenue_impact_inr": F.lit(None).cast("double"),
        "expected_outcome_window": F.lit(t["window"]),
        "data_source": F.lit(source),
        "branch": F.lit(branch),
    }
    vals.update({k: F.lit(v) if isinstance(v, str) else v for k, v in over.items()})
    return df.select(*[vals[f].alias(f) for f in FIELDS])


def largest(df: DataFrame, by: str, n: int, tie: str = "outlet_code") -> DataFrame:
    """The n rows with the largest value; nulls never qualify (TOP-02)."""
    return df.where(F.col(by).isNotNull()).orderBy(F.desc(by), tie).limit(n)


def smallest(df: DataFrame, by: str, n: int, tie: str = "outlet_code") -> DataFrame:
    return df.where(F.col(by).isNotNull()).orderBy(F.asc(by), tie).limit(n)


def rising(f: DataFrame, top: int = 40) -> DataFrame:
    """Rising and steady outlets (ACT-01)."""
    df = largest(f.where("growth_30d > 0.25 AND volatility < 0.8 AND NOT dormant"), "recent30_value", top)
    g = F.col("growth_30d")
    seg = F.coalesce("segment", F.lit("mid")) if "segment" in f.columns else F.lit("mid")
    return _rows(
        df, "rising", "outlet", SALES, True,
        confidence=half_even(F.least(F.lit(0.95), 0.6 + (1 - F.col("volatility")) * 0.3), 2),
        revenue_impact_inr=F.col("recent30_value") * F.greatest(g, F.lit(0.0)) * 0.3,
        urgency=F.when(g > 0.5, "High").otherwise("Medium"),
        reason=text("Last 30d revenue up ", whole(g * 100), "% vs prior 30d; CV=", two("volatility"),
                    " (stable). Segment '", seg, "' typically has absorption capacity for premium."),
    )


def peer_gap(f: DataFrame, top: int = 40, least: float = 70.0) -> DataFrame:
    """Outlets below their peers: the top scores first, then the threshold (ACT-02)."""
    df = largest(f, "opportunity_score", top).where((F.col("opportunity_score") >= least) & ~F.col("dormant"))
    return _rows(
        df, "peer_gap", "outlet", SALES, True,
        confidence=half_even(0.55 + F.col("opportunity_score") / 100 * 0.35, 2),
        revenue_impact_inr=F.col("estimated_uplift_inr"),
        urgency="Medium",
        reason=text("Avg daily revenue ₹", grouped("avg_daily_value"), " vs district peer median ₹",
                    grouped("peer_avg"), ". Opportunity score ", whole("opportunity_score"), "/100."),
    )


def declining(f: DataFrame, top: int = 30, more_days: int = 30) -> DataFrame:
    """Outlets in decline with more than ``more_days`` sales days (ACT-03)."""
    fits = f.where((F.col("growth_30d") < -0.3) & ~F.col("dormant") & (F.col("active_days") > more_days))
    df = smallest(fits, "growth_30d", top)
    return _rows(
        df, "declining", "outlet", SALES, True,
        confidence=F.lit(0.78),
        revenue_impact_inr=F.greatest(F.col("prev30_value") - F.col("recent30_value"), F.lit(0.0)),
        urgency="High",
        reason=text("Revenue down ", whole(F.col("growth_30d") * 100), "% in last 30d vs prior 30d while peers in ",
                    F.col("district"), " remained stable."),
    )


def dormant(f: DataFrame, top: int = 20) -> DataFrame:
    """Once active outlets without recent sales (ACT-04)."""
    df = largest(f.where("dormant AND total_sale_value > 0"), "total_sale_value", top)
    return _rows(
        df, "dormant", "outlet", SALES, True,
        confidence=F.lit(0.85),
        revenue_impact_inr=F.col("avg_daily_value") * 30,
        urgency="High",
        reason=text("Outlet had ₹", grouped("total_sale_value"), " lifetime revenue but 0 sales in last 30d."),
    )


def district_push(f: DataFrame, least: float = 0.15, hot: int = HOT_ROWS) -> DataFrame:
    """Districts whose median outlet grows (ACT-05)."""
    keyed = f.where(F.col("district").isNotNull())
    med = group_median(keyed, ["district"], "growth_30d", "growth", hot).where(F.col("growth") > least).drop("_n")
    totals = keyed.groupBy("district").agg(
        F.sum("recent30_value").alias("total"), F.count("outlet_code").alias("outlets")
    )
    df = totals.join(med, "district")
    return _rows(
        df, "district_push", "district", SALES,
        district=F.col("district"),
        issue=text("District-wide demand trending up (median outlet growth ", whole(F.col("growth") * 100), "%)"),
        confidence=F.lit(0.7),
        revenue_impact_inr=F.col("total") * F.col("growth") * 0.2,
        urgency="Medium",
        reason=text(F.col("outlets").cast("string"), " outlets in ", F.col("district"),
                    " show consistent uplift in last 30d."),
    )


def supplier_churn(f: DataFrame) -> DataFrame:
    """One standing notice (ACT-06)."""
    one = f.sparkSession.range(1)
    return _rows(one, "supplier_churn", "supplier", SALES, confidence=F.lit(0.6), urgency="Low")


def aggressive_suppliers(aggression: DataFrame, top: int = 6, least: int = 3) -> DataFrame:
    """Suppliers that expand fast: the top scores first, then the threshold (ACT-07)."""
    df = aggression.orderBy(F.desc("aggression_score"), F.asc_nulls_last("distillery")).limit(top)
    df = df.where(F.col("new_labels_180d") >= least)
    s = {c: F.col(c).cast("string") for c in df.columns}
    score = F.col("aggression_score")
    return _rows(
        df, "aggressive_supplier", "supplier", PROXY,
        issue=text("Aggressive supplier expansion — ", s["new_labels_180d"], " new labels across ",
                   s["pack_sizes_touched"], " pack sizes in 180 days"),
        confidence=half_even(F.least(F.lit(0.9), 0.55 + score * 0.35), 2),
        urgency=F.when(score > 0.5, "Medium").otherwise("Low"),
        action=text("Monitor ", F.coalesce("distillery", F.lit("distillery")),
                    " rollout; pre-allocate shelf in high-throughput outlets where brand mix fits"),
        reason=text("Label feed: ", s["new_labels_180d"], " new / ", s["renewals_180d"], " renewal across ",
                    s["brands_touched"], " brands in ", s["active_months"], " active months. Aggression score ",
                    two(score), "."),
    )


def overcrowded_segments(segments: DataFrame, top: int = 5, least: int = 40) -> DataFrame:
    """Crowded product segments (ACT-08)."""
    df = segments.orderBy(F.desc("sku_count"), F.desc("density_score"), "category", "price_band").limit(top)
    df = df.where(F.col("sku_count") >= least)
    s = {c: F.col(c).cast("string") for c in df.columns}
    dash = F.lit("—")
    return _rows(
        df, "overcrowded", "category", PROXY,
        category=text(F.coalesce("category", dash), " · ", F.coalesce("price_band", dash)),
        issue=text("Overcrowded segment — ", s["sku_count"], " SKUs / ", s["brand_count"], " brands / ",
                   s["supplier_count"], " suppliers"),
        confidence=F.lit(0.65),
        urgency="Low",
        reason=text("Density ", s["density_score"], " SKUs per brand suggests cannibalization."),
    )


def pack_pruning(prolif: DataFrame, top: int = 6) -> DataFrame:
    """Brands in too many pack sizes (ACT-09)."""
    df = prolif.orderBy(F.desc("pack_sizes"), F.desc("sku_count"), "brand_name", "brand_type").limit(top)
    s = {c: F.col(c).cast("string") for c in ("sku_count", "distilleries", "pack_sizes")}
    sizes = text("[", F.array_join(F.transform("pack_list", lambda x: x.cast("string")), ", "), "]")
    return _rows(
        df, "pack_proliferation", "brand", PROXY,
        issue=text("Pack-size proliferation — '", F.coalesce("brand_name", F.lit("—")), "' across ",
                   s["pack_sizes"], " sizes"),
        confidence=F.lit(0.55),
        urgency="Low",
        reason=text(s["sku_count"], " SKUs · ", s["distilleries"], " distilleries · sizes ", sizes),
    )


def premium_push(f: DataFrame, classes: tuple[str, ...] = PUSH_CLASSES, top: int = 15) -> DataFrame:
    """Growing outlets of the given classes (ACT-10)."""
    df = f.where((F.col("growth_30d") > 0.3) & ~F.col("dormant") & F.col("vendor_type").isin(*classes))
    df = largest(df, "recent30_value", top)
    return _rows(
        df, "premium_push", "outlet", PROXY, True,
        confidence=F.lit(0.7),
        revenue_impact_inr=F.col("recent30_value") * 0.08,
        urgency="Medium",
        reason=text("30d growth ", whole(F.col("growth_30d") * 100), "% · vendor_type ", F.col("vendor_type"),
                    " · prior assortment fit suggests headroom at higher band."),
    )


def prune(f: DataFrame, vendor: str = "A4", top: int = 10) -> DataFrame:
    """Weak outlets of one class (ACT-11)."""
    df = f.where((F.col("vendor_type") == vendor) & ~F.col("dormant")
                 & F.col("segment").rlike("Low-Productivity|Declining"))
    df = smallest(df, "recent30_value", top)
    return _rows(
        df, "prune", "outlet", PROXY, True,
        confidence=F.lit(0.6),
        urgency="Low",
        reason=text("Segment '", F.col("segment"), "' · avg daily revenue ₹", grouped("avg_daily_value"),
                    ". Pack proliferation signal suggests pruning has low demand risk."),
    )


def union(*frames: DataFrame) -> DataFrame:
    """All branches in one table (SET-05)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def urgency_rank(c: str = "urgency") -> Column:
    """Sort key of the urgency (PRJ-08)."""
    u = F.col(c)
    return F.when(u == "High", 0).when(u == "Medium", 1).when(u == "Low", 2).otherwise(3)


# What tells actions of one urgency and impact apart.
TIES = ("branch", "outlet_code", "district", "reason")


def in_order(actions: DataFrame) -> DataFrame:
    """Urgency first, then impact; ties by branch and place, so that a cut is the same each time (TOP-06)."""
    return actions.orderBy(urgency_rank(), F.desc(F.coalesce("revenue_impact_inr", F.lit(0.0))), *TIES)


def counters(actions: DataFrame) -> DataFrame:
    """Counts by urgency and source, and total impact (AGG-36)."""
    return actions.agg(
        *[F.count_if(F.col("urgency") == u).alias(u.lower()) for u in ("High", "Medium", "Low")],
        F.sum(F.coalesce("revenue_impact_inr", F.lit(0.0))).alias("total_impact"),
        F.count_if(F.coalesce("data_source", F.lit(SALES)) == SALES).alias("sales_count"),
        F.count_if(F.col("data_source") == PROXY).alias("proxy_count"),
    )


def signal_counters(signals: DataFrame) -> DataFrame:
    """Signals that are sure, that alter the forecast, that alter actions (AGG-39)."""
    return signals.agg(
        F.count(F.lit(1)).alias("signals"),
        F.count_if(F.col("confidence") > 0.7).alias("high_confidence"),
        F.count_if(F.contains("alters", F.lit("forecast"))).alias("alters_forecast"),
        F.count_if(F.contains("alters", F.lit("action"))).alias("alters_action"),
    )

"""Scrutiny of building, layout and occupancy applications, and fees."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.numbers import clamp, col, computed_once, half_up, kept, lookup, within_pct
from tallyworks.functions.text import said

PACK_COLUMNS = (
    "category", "label", "maxHeightM", "minRoadWidthM", "maxFAR", "maxGroundCoveragePercent", "minFrontSetbackM",
    "minRearSetbackM", "minSideSetbackM", "parkingPerDwellingUnit", "rainwaterHarvestingRequired", "solarRequired",
)
# Thresholds by category.
PACKS = (
    ("residential_low_rise", "Residential — low-rise (<= 10m)", 10.0, 6.0, 1.75, 65.0, 1.5, 1.0, 1.0, 1.0, True, False),
    ("residential_mid_rise", "Residential — mid-rise (10–15m)", 15.0, 9.0, 2.5, 50.0, 3.0, 2.0, 2.0, 1.25, True, True),
    ("residential_high_rise", "Residential — high-rise (>15m)", 60.0, 12.0, 3.5, 35.0, 6.0, 4.0, 4.0, 1.5, True, True),
    ("commercial", "Commercial", 30.0, 12.0, 3.0, 50.0, 4.5, 3.0, 3.0, 2.0, True, True),
    ("mixed_use", "Mixed use", 24.0, 9.0, 2.75, 50.0, 3.5, 2.5, 2.5, 1.5, True, True),
    ("institutional", "Institutional", 18.0, 9.0, 2.0, 45.0, 4.5, 3.0, 3.0, 1.0, True, True),
    ("industrial", "Industrial", 18.0, 12.0, 1.5, 55.0, 6.0, 4.5, 4.5, 1.0, True, False),
)
MIN_OPEN_SPACE, MIN_INTERNAL_ROAD, MIN_APPROACH = 10.0, 9.0, 9.0
# Fee schedule.
BASE_FEE = {
    "building_permission": 1500.0,
    "layout_permission": 5000.0,
    "occupancy_certificate": 2500.0,
    "renovation_addition": 1000.0,
}
AREA_FEE = {"residential": 8.0, "commercial": 24.0, "mixed_use": 16.0, "institutional": 12.0, "industrial": 18.0}
DEFAULT_BASE, DEFAULT_AREA, SCRUTINY_FEE, HEIGHT_FEE, HIGH_M = 1000.0, 8.0, 750.0, 25000.0, 15.0
# Name, explanation of a pass, explanation otherwise, suggested correction; {x} stands for a value.
TEXTS = {
    "jurisdiction": ("Jurisdiction identified", "Plot location maps to a recognised village/ULB boundary.",
        "Plot does not fall fully inside known boundaries — manual GIS verification required.", None),
    "boundary": ("Plot boundary provided", "Applicant-drawn polygon captured.",
        "No plot polygon submitted — system cannot run jurisdiction or monitoring checks.", None),
    "plot_area_match": ("Plot area matches drawn boundary", "Declared plot area is within tolerance of the drawn polygon.",
        "Declared area differs from polygon by more than 5%. Recheck declared area or boundary.", "Verify declared plot area against drawn polygon."),
    "front_setback": ("Minimum front setback", "Meets the minimum setback for this category.",
        "Required minimum setback for {label} is {need} m.", "Increase to at least {need} m."),
    "rear_setback": ("Minimum rear setback", "Meets the minimum setback for this category.",
        "Required minimum setback for {label} is {need} m.", "Increase to at least {need} m."),
    "side_setback": ("Minimum side setback", "Both side setbacks meet the requirement.",
        "Minimum side setback must be ≥ {need} m. Either side currently violates the rule.", "Increase the smaller side setback to {need} m."),
    "far": ("FAR / built-up area", "Built-up area is within the FAR cap.",
        "Built-up area exceeds the maximum FAR of {need} for {label}.", "Reduce proposed built-up area or split into more plots."),
    "ground_coverage": ("Ground coverage", "Ground coverage within permissible limit.", "Ground coverage exceeds the cap of {need}%.", None),
    "building_height": ("Building height category", "Height fits within the chosen category.",
        "Height {have} m exceeds limit {need} m for {label}.", None),
    "parking": ("Parking provision", "Adequate parking provision.",
        "Need {need} bays for {floors} floors at {unit}/unit.", "Add {more} more parking bays."),
    "road_width": ("Road width compatibility", "Abutting road meets the minimum width requirement.",
        "Abutting road of {have} m is below required {need} m for {label}.", None),
    "road_width_missing": ("Road width compatibility", "", "Road width could not be auto-verified from GIS. Field verification required.", None),
    "rainwater": ("Rainwater harvesting", "Rainwater harvesting committed.", "Rainwater harvesting is mandatory for this category.", None),
    "solar": ("Solar provision", "Solar provision included as required.", "Solar provision recommended for this category.", None),
    "internal_road_width": ("Internal road width", "Internal roads meet minimum width.", "Internal road width must be ≥ 9 m.", None),
    "open_space": ("Open space percentage", "Open space allocation is sufficient.", "Layouts must reserve ≥ 10% open space.", None),
    "plot_count": ("Plot count", "Plot count provided.", "At least one plot required.", None),
    "utilities": ("Utility provision", "All three utility commitments are mandatory.", "All three utility commitments are mandatory.", None),
    "approach_road": ("Approach road availability", "Approach road sufficient.", "Approach road must be ≥ 9 m.", None),
    "boundary_within_jurisdiction": ("Boundary within jurisdiction", "Layout polygon is inside selected jurisdiction.",
        "Layout polygon overlaps outside the selected village/ULB.", None),
    "floors_match": ("Floors match approved plan", "Constructed floors match the sanctioned plan.",
        "Constructed floors differ from the sanctioned plan.", None),
    "usage_match": ("Usage matches approved plan", "Usage matches the sanctioned plan.", "Usage on completion differs from sanctioned usage.", None),
    "setbacks_match": ("Setbacks match approved plan", "All setbacks meet or exceed sanctioned values.",
        "One or more setbacks fall below sanctioned values.", None),
    "parking_provided": ("Parking provided", "Final parking count must be at least sanctioned.",
        "Final parking count must be at least sanctioned.", None),
    "road_width_verified": ("Road width verified", "Road width verified during inspection.",
        "Road width has not been re-verified at the site.", None),
    "completion_documents": ("Completion documents uploaded", "Completion notice and supporting documents uploaded.",
        "Completion notice or supporting documents missing.", None),
}


def number(c: str | Column) -> Column:
    """Number as text, without '.0' on whole numbers."""
    v = col(c).cast("double")
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def category(use: str = "building_use", height: str = "height") -> Column:
    """Rule category of a building: by use, residential by height."""
    u, h = F.col(use), F.col(height)
    return (
        F.when(u.isin("commercial", "mixed_use", "institutional", "industrial"), u)
        .when(h > 15, "residential_high_rise")
        .when(h > 10, "residential_mid_rise")
        .otherwise("residential_low_rise")
    )


def packs(spark) -> DataFrame:
    kinds = ["string", "string", *["double"] * 8, "boolean", "boolean"]
    return spark.createDataFrame(list(PACKS), ", ".join(f"{c} {k}" for c, k in zip(PACK_COLUMNS, kinds)))


def with_pack(apps: DataFrame, rule_packs: DataFrame) -> DataFrame:
    """Applications with the thresholds of their category (JN-18); one pack row per category."""
    return apps.withColumn("category", category()).join(F.broadcast(rule_packs), "category", "left")


def one_check(cid: str, ok: Column, bad: str, severity: str, have: Column | str, need: Column | str, key: str = "", /,
          texts: bool = True, **values: Column) -> Column:
    """One check with its texts of ``TEXTS``: pass/low when ok, else the given status, severity and correction.

    Without ``texts`` it has id, status and severity only.
    """

    def c(x: Column | str) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    good = F.coalesce(ok, F.lit(False))
    verdict = F.when(good, "pass").otherwise(bad).alias("status"), F.when(good, "low").otherwise(severity).alias("severity")
    if not texts:
        return F.struct(F.lit(cid).alias("id"), *verdict)
    name, good_text, bad_text, correction = TEXTS[key or cid]
    return F.struct(
        F.lit(cid).alias("id"),
        F.lit(name).alias("name"),
        *verdict,
        c(have).alias("applicant_value"),
        c(need).alias("required_value"),
        F.when(good, good_text).otherwise(said(bad_text, values)).alias("explanation"),
        F.when(~good, said(correction, values)).alias("suggested_correction"),
    )


def _t(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _yes(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def building_checks(df: DataFrame, texts: bool = True) -> DataFrame:
    """Up to 13 checks of a building application with its pack (RUL-10, MTH-05, MTH-06).

    Counts and scores need no ``texts``: left out, no text is built.
    """
    c, check = F.col, partial(one_check, texts=texts)
    known, drawn, far_cap = c("jurisdiction_known"), c("has_boundary"), number("maxFAR")
    label = F.coalesce(F.nullif("label", F.lit("")), "category")
    side = F.least("left_setback", "right_setback")
    far = F.when(c("plot_area") > 0, c("built_up_area") / F.nullif(c("plot_area"), F.lit(0.0))).otherwise(0.0)
    floors = F.when(F.coalesce("floors", F.lit(0)) == 0, 1).otherwise(c("floors"))
    bays = F.ceil(floors * c("parkingPerDwellingUnit"))

    def metres(x: Column | str) -> Column:
        return _t(number(x), " m")

    def setback(side_name: str, have: Column, need: str, more: str = "") -> Column:
        return check(f"{side_name}_setback", have >= c(need), "fail", "high", _t(number(have), " m", more), _t("≥ ", metres(need)), label=label, need=number(need))

    cover, tall, road = number("maxGroundCoveragePercent"), number("maxHeightM"), number("minRoadWidthM")
    items = [
        check("jurisdiction", known, "manual_review", "medium", F.when(known, "Identified").otherwise("Uncertain"), "Identified"),
        check("boundary", drawn, "fail", "high", F.when(drawn, "Drawn").otherwise("Missing"), "Drawn"),
        F.when(c("geom_area").isNotNull(), check(
            "plot_area_match", within_pct("plot_area", "geom_area"), "warning", "medium",
            _t(F.format_string("%.0f", half_up("plot_area")), " sq m"), _t(F.format_string("%.0f", half_up("geom_area")), " sq m (±5%)"))),
        setback("front", c("front_setback"), "minFrontSetbackM"),
        setback("rear", c("rear_setback"), "minRearSetbackM"),
        setback("side", side, "minSideSetbackM", " (min of L/R)"),
        check("far", far <= c("maxFAR"), "fail", "high", _t("FAR ", F.format_string("%.2f", half_up(far, 2))), _t("≤ ", far_cap), need=far_cap, label=label),
        check("ground_coverage", c("ground_coverage") <= c("maxGroundCoveragePercent"), "fail", "medium", _t(number("ground_coverage"), "%"),
              _t("≤ ", cover, "%"), need=cover),
        check("building_height", c("height") <= c("maxHeightM"), "fail", "high", _t(metres("height"), " / ", number("floors"), " floors"),
              _t("≤ ", tall, " m"), have=number("height"), need=tall, label=label),
        check("parking", c("parking") >= bays, "fail", "medium", _t(number("parking"), " bays"), _t("≥ ", number(bays), " bays"),
              need=number(bays), floors=number("floors"), unit=number("parkingPerDwellingUnit"), more=number(bays - c("parking"))),
        F.when(c("road_gis_missing"), check("road_width", F.lit(False), "manual_review", "medium", _t(metres("road_width"), " (declared)"), _t("≥ ", road, " m"),
               "road_width_missing")).otherwise(
            check("road_width", c("road_width") >= c("minRoadWidthM"), "fail", "high", metres("road_width"), _t("≥ ", road, " m"),
                  have=number("road_width"), need=road, label=label)),
        F.when(c("rainwaterHarvestingRequired"), check("rainwater", c("rainwater"), "fail", "medium", _yes(c("rainwater")), "Yes")),
        F.when(c("solarRequired"), check("solar", c("solar"), "warning", "medium", _yes(c("solar")), "Yes")),
    ]
    return computed_once(df.withColumn("checks", kept(*items)))


def layout_checks(df: DataFrame) -> DataFrame:
    """Six checks of a layout application (RUL-11)."""
    c, check = F.col, one_check
    all_three = c("drainage") & c("water") & c("lighting")
    have = kept(F.when(c("drainage"), F.lit("drainage")), F.when(c("water"), F.lit("water")), F.when(c("lighting"), F.lit("lighting")))
    inside = c("inside_boundary")
    items = [
        check("internal_road_width", c("internal_road") >= MIN_INTERNAL_ROAD, "fail", "high", _t(number("internal_road"), " m"), "≥ 9 m"),
        check("open_space", c("open_space") >= MIN_OPEN_SPACE, "fail", "medium", _t(number("open_space"), "%"), "≥ 10%"),
        check("plot_count", c("plots") >= 1, "fail", "high", number("plots"), "≥ 1"),
        check("utilities", all_three, "fail", "medium", F.when(F.size(have) > 0, F.array_join(have, ", ")).otherwise("none"), "drainage, water, lighting"),
        check("approach_road", c("approach_road") >= MIN_APPROACH, "fail", "high", _t(number("approach_road"), " m"), "≥ 9 m"),
        check("boundary_within_jurisdiction", inside, "warning", "high", F.when(inside, "Inside").otherwise("Crosses boundary"), "Inside"),
    ]
    return computed_once(df.withColumn("checks", F.array(*items)))


def occupancy_checks(requests: DataFrame, sanctioned: DataFrame, link: str = "sanctioned_id", key: str = "id") -> DataFrame:
    """Six checks of an occupancy request against its sanctioned plan (RUL-12, JN-24).

    Without a sanctioned plan the comparisons pass.
    """
    plan_cols = ("floors", "building_use", "front_setback", "rear_setback", "left_setback", "right_setback", "parking")
    plan = sanctioned.select(F.col(key).alias(link), *[F.col(x).alias(f"p_{x}") for x in plan_cols])
    j = requests.join(plan, link, "left")
    c, check = F.col, one_check
    absent = c("p_floors").isNull()

    def same(cond: Column) -> Column:
        return absent | cond

    sides = ("front", "rear", "left", "right")
    wide = F.lit(True)
    for s in sides:
        wide = wide & (c(f"r_{s}") >= c(f"p_{s}_setback"))
    marks = ("F ", ", R ", ", L ", ", Ri ")
    r_text = _t(*[x for m, s in zip(marks, sides) for x in (m, number(f"r_{s}"))])
    dash = F.lit("—")
    p_text = F.coalesce(_t(*[x for m, s in zip(marks, sides) for x in (m, number(f"p_{s}_setback"))]), dash)
    seen, filed = c("road_verified"), c("documents_uploaded")
    items = [
        check("floors_match", same(c("r_floors") == c("p_floors")), "fail", "high", number("r_floors"), F.coalesce(number("p_floors"), dash)),
        check("usage_match", same(c("r_usage") == c("p_building_use")), "fail", "high", c("r_usage"), F.coalesce(c("p_building_use"), dash)),
        check("setbacks_match", same(wide), "fail", "high", r_text, p_text),
        check("parking_provided", same(c("r_parking") >= c("p_parking")), "fail", "medium", number("r_parking"), F.coalesce(number("p_parking"), dash)),
        check("road_width_verified", seen, "manual_review", "medium", _yes(seen), "Yes"),
        check("completion_documents", filed, "fail", "high", F.when(filed, "Uploaded").otherwise("Missing"), "Uploaded"),
    ]
    return computed_once(j.withColumn("checks", F.array(*items)))


def check_lines(checks: str = "checks") -> Column:
    """All checks of an application as text, one line per check, fields parted by ' | '."""
    fields = ("id", "name", "status", "severity", "applicant_value", "required_value", "explanation", "suggested_correction")
    return F.array_join(F.transform(checks, lambda x: F.concat_ws(" | ", *[F.coalesce(x[f], F.lit("")) for f in fields])), "\n")


def _n(status: str, severity: str | None = None) -> Column:
    return F.size(
        F.filter("checks", lambda x: (x["status"] == status) & (F.lit(True) if severity is None else x["severity"] == severity))
    )


def finalize(df: DataFrame, building: bool = False) -> DataFrame:
    """Outcome, escalation reasons, rule score and risk score from the checks (RUL-13)."""
    d = df.withColumns(
        {"_fh": _n("fail", "high"), "_f": _n("fail"), "_w": _n("warning"), "_m": _n("manual_review"), "_p": _n("pass"), "_n": F.size("checks")}
    )
    c = F.col
    first = (
        F.when(c("_fh") >= 2, "reject_recommendation")
        .when(c("_f") > 0, "needs_correction")
        .when(c("_m") > 0, "field_verification_required")
        .otherwise("auto_pass_eligible")
    )
    if building:
        big, shop, tall = c("built_up_area") > 1500, c("building_use") == "commercial", c("height") > HIGH_M
    else:
        big = shop = tall = F.lit(False)
    road = F.exists("checks", lambda x: (x["id"] == "road_width") & (x["status"] != "pass"))
    why = kept(
        F.when(big, F.lit("High built-up area")),
        F.when(shop, F.lit("Commercial use")),
        F.when(tall, F.lit("Height threshold crossed")),
        F.when(c("_w") > 0, F.lit("Rule ambiguity")),
        F.when(c("_m") > 0, F.lit("Boundary mismatch")),
        F.when(road, F.lit("Road width missing")),
    )
    d = d.withColumns({"_first": first, "why_escalated": why})
    nudged = (F.size("why_escalated") > 0) & (c("_first") == "auto_pass_eligible")
    risk = c("_f") * 18 + c("_w") * 8 + c("_m") * 6 + F.when(tall, 10).otherwise(0) + F.when(shop, 5).otherwise(0)
    score = half_up(c("_p") / F.greatest(c("_n"), F.lit(1)) * 100)
    return d.withColumns(
        {
            "outcome": F.when(nudged, "needs_technical_review").otherwise(c("_first")),
            "rule_score": clamp(score, 0, 100).cast("int"),
            "risk_score": clamp(risk, 0, 100),
        }
    ).drop("_fh", "_f", "_w", "_m", "_p", "_n", "_first")


def estimate_fees(df: DataFrame, kind: str = "type", use: str = "building_use", area: Column | None = None) -> DataFrame:
    """Fee estimate of an application (RUL-14, MAP-01)."""
    size = F.coalesce(F.col("built_up_area"), F.col("layout_area"), F.lit(0.0)) if area is None else area
    d = df.withColumns(
        {
            "base_fee": lookup(kind, BASE_FEE, DEFAULT_BASE),
            "area_fee": half_up(size * lookup(F.coalesce(use, F.lit("residential")), AREA_FEE, DEFAULT_AREA)),
            "scrutiny_fee": F.lit(SCRUTINY_FEE),
            "height_fee": F.when(F.coalesce(F.col("height") > HIGH_M, F.lit(False)), HEIGHT_FEE).otherwise(0.0),
        }
    )
    return d.withColumn("total_fee", F.col("base_fee") + F.col("area_fee") + F.col("scrutiny_fee") + F.col("height_fee"))


def reconcile_fees(df: DataFrame, paid: str = "fee_paid") -> DataFrame:
    """Pending amount and warnings of the paid fee (RUL-14, ARR-02)."""
    p = F.coalesce(paid, F.lit(0.0))
    return df.withColumns(
        {
            "pending": F.greatest(F.col("total_fee") - p, F.lit(0.0)),
            "fee_warnings": kept(
                F.when(p < F.col("total_fee"), F.lit("Fee paid lower than estimated")), F.when(p == 0, F.lit("Receipt missing"))
            ),
        }
    )


def failing(df: DataFrame, part: str) -> DataFrame:
    """Applications with a check of the given kind that did not pass (FLT-16)."""
    return df.where(F.exists("checks", lambda x: F.contains(x["id"], F.lit(part)) & (x["status"] != "pass")))


def authority(inside_ulb: str | Column, village: str | Column) -> Column:
    """Sanctioning authority (PRJ-06)."""
    return (
        F.when(F.coalesce(col(inside_ulb), F.lit(False)), "ulb_officer")
        .when(col(village).isNotNull(), "panchayat_secretary")
        .otherwise("manual_verification")
    )


def risk_band(risk: str = "risk_score") -> Column:
    """low below 30, medium below 60, else high (FLT-09); a missing score is 0."""
    r = F.coalesce(risk, F.lit(0))
    return F.when(r < 30, "low").when(r < 60, "medium").otherwise("high")


def severity_of(outcome: str = "outcome") -> Column:
    """Severity of an outcome for ordering (PRJ-08)."""
    o = F.col(outcome)
    return (
        F.when(o.isin("reject_recommendation", "needs_correction"), "high")
        .when(o.isin("needs_technical_review", "field_verification_required"), "medium")
        .otherwise("low")
    )

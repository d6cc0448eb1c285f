"""Rule verification, scrutiny, fee and caseload queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.functions import numbers
from tallyworks.operators import caseload as cl
from tallyworks.operators import filters as fl
from tallyworks.operators import rules as rl
from tallyworks.operators import scrutiny as sc
from tallyworks.plans.registry import CTES, as_of, query
from tallyworks.sources import schemas
from tallyworks.sources.views import Views

# --- rule verification ----------------------------------------------------------------

RULES = (
    {"rule_id": "FRONT_01", "description": "Residential low-rise front setback", "python_logic": "REQUIRE front_setback_m >= 1.5"},
    {"rule_id": "FIRE_01", "description": "High-rise fire setback", "python_logic": "IF height_m > 18: REQUIRE rear_setback_m >= 3"},
    {"rule_id": "PARK_01", "description": "Commercial parking", "python_logic": "REQUIRE (parking >= 4) AND (road_width_m >= 6)"},
    {"rule_id": "RAIN_01", "description": "Rainwater", "python_logic": "REQUIRE rainwater == True OR NOT (plot_area_m2 > 200)"},
    {"rule_id": "FUNC_01", "description": "Not supported", "python_logic": "REQUIRE sqrt(plot_area_m2) > 5"},
    {"rule_id": "MISS_01", "description": "Absent input", "python_logic": "IF rainwater == False: REQUIRE borewell_depth_m < 50"},
)


def _inputs() -> dict:
    return {
        "front_setback_m": F.col("front_setback"), "height_m": F.when(~F.col("road_gis_missing"), F.col("height")),
        "rear_setback_m": F.when(F.col("has_boundary"), F.col("rear_setback")), "parking": F.when(F.col("solar"), F.col("parking")),
        "road_width_m": F.when(F.col("drainage"), F.col("road_width")), "rainwater": F.col("rainwater"), "plot_area_m2": F.col("plot_area"),
    }


CTES["verdicts"] = """
  SELECT k, UNNEST(['FRONT_01', 'FIRE_01', 'PARK_01', 'RAIN_01', 'FUNC_01', 'MISS_01']) AS rule_id, UNNEST([
      CASE WHEN front_setback >= 1.5 THEN 'pass' ELSE 'fail' END,
      CASE WHEN road_gis_missing THEN 'manual_review' WHEN NOT height > 18 THEN 'pass' WHEN NOT has_boundary THEN 'manual_review'
        WHEN rear_setback >= 3 THEN 'pass' ELSE 'fail' END,
      CASE WHEN NOT solar THEN 'manual_review' WHEN NOT parking >= 4 THEN 'fail' WHEN NOT drainage THEN 'manual_review' WHEN road_width >= 6 THEN 'pass'
        ELSE 'fail' END,
      CASE WHEN rainwater OR NOT plot_area > 200 THEN 'pass' ELSE 'fail' END,
      'manual_review', CASE WHEN rainwater THEN 'pass' ELSE 'manual_review' END]) AS status,
    UNNEST([CASE WHEN front_setback >= 1.5 THEN 'check satisfied' ELSE 'required condition not met' END,
      CASE WHEN road_gis_missing THEN 'missing input: height_m' WHEN NOT height > 18 THEN 'precondition not applicable'
        WHEN NOT has_boundary THEN 'missing input: rear_setback_m' WHEN rear_setback >= 3 THEN 'check satisfied' ELSE 'required condition not met' END,
      CASE WHEN NOT solar THEN 'missing input: parking' WHEN NOT parking >= 4 THEN 'required condition not met' WHEN NOT drainage
        THEN 'missing input: road_width_m' WHEN road_width >= 6 THEN 'check satisfied' ELSE 'required condition not met' END,
      CASE WHEN rainwater OR NOT plot_area > 200 THEN 'check satisfied' ELSE 'required condition not met' END,
      'unparseable rule: value expected', CASE WHEN rainwater THEN 'precondition not applicable' ELSE 'missing input: borewell_depth_m' END]) AS reason
  FROM {apps}"""


def verified(v: Views) -> DataFrame:
    v.spread("orders")
    return rl.checks(v.apps, RULES, _inputs())


@query("rul_08_rule_verdicts", "SELECT k, status, reason FROM {verdicts} WHERE rule_id = 'FIRE_01'")
def rul_08(v: Views) -> DataFrame:
    return v.apps.withColumn("v", rl.verdict(RULES[1]["python_logic"], _inputs())).select("k", "v.status", "v.reason")


@query("rul_09_verification_report", "SELECT k, rule_id, status, reason FROM {verdicts}")
def rul_09(v: Views) -> DataFrame:
    return rl.report(verified(v), "k").drop("description")


@query("jn_17_applications_by_rules", "SELECT rule_id, status, COUNT(*) AS n FROM {verdicts} GROUP BY 1, 2")
def jn_17(v: Views) -> DataFrame:
    return rl.report(verified(v), "k").groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("agg_56_verification_summary", """
  SELECT k, p AS pass_count, f AS fail_count, m AS manual_review_count, CASE WHEN f > 0 THEN 'needs_correction' WHEN m > 0
    THEN 'manual_verification_required' ELSE 'auto_pass_eligible' END AS outcome FROM (SELECT k, COUNT(*) FILTER (WHERE status = 'pass') AS p,
    COUNT(*) FILTER (WHERE status = 'fail') AS f, COUNT(*) FILTER (WHERE status = 'manual_review') AS m FROM {verdicts} GROUP BY k)""")  # fmt: skip
def agg_56(v: Views) -> DataFrame:
    o = rl.outcome(verified(v), "k")
    return o.withColumns({c: F.col(c).cast("long") for c in ("pass_count", "fail_count", "manual_review_count")})


# Rules of the driver: one per part, written from its attributes.
CTES["part_rules"] = """
  SELECT 'R_' || p_partkey AS rule_id, CASE p_type WHEN 'ECONOMY' THEN 'Residential low-rise' WHEN 'PROMO' THEN 'Commercial' WHEN 'LARGE' THEN 'High-rise residential'
    WHEN 'SMALL' THEN 'Mixed use' WHEN 'MEDIUM' THEN 'Industrial' ELSE 'Unclear' END AS description, p_size,
    ['front_setback_m', 'rear_setback_m', 'height_m', 'road_width_m', 'far', 'parking_bays', 'colour'][p_partkey % 7 + 1] AS name,
    p_partkey % 3 AS form FROM part"""
CTES["part_packs"] = """
  SELECT *, CASE description WHEN 'Residential low-rise' THEN 'residential_low_rise' WHEN 'Commercial' THEN 'commercial' WHEN 'High-rise residential' THEN
      'residential_high_rise' WHEN 'Mixed use' THEN 'mixed_use' WHEN 'Industrial' THEN 'industrial' END AS category,
    CASE name WHEN 'front_setback_m' THEN 'minFrontSetbackM' WHEN 'rear_setback_m' THEN 'minRearSetbackM' WHEN 'height_m' THEN 'maxHeightM'
      WHEN 'road_width_m' THEN 'minRoadWidthM' WHEN 'far' THEN 'maxFAR' WHEN 'parking_bays' THEN 'parkingPerDwellingUnit'
      ELSE CASE WHEN form = 2 THEN 'maxHeightM' END END AS key,
    CASE WHEN name = 'colour' AND form = 2 THEN 18 ELSE p_size END::DOUBLE AS value FROM {part_rules}"""


def part_rules(v: Views) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("front_setback_m", "rear_setback_m", "height_m", "road_width_m", "far", "parking_bays", "colour")])
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    name = names[(k % 7).cast("int")]
    logic = (
        F.when(k % 3 == 0, F.concat(F.lit("REQUIRE "), name, F.lit(" >= "), size))
        .when(k % 3 == 1, F.concat(F.lit("REQUIRE "), size, F.lit(" <= "), name))
        .otherwise(F.concat(F.lit("IF height_m > 18: REQUIRE "), name, F.lit(" >= "), size))
    )
    kinds = {"ECONOMY": "Residential low-rise", "PROMO": "Commercial", "LARGE": "High-rise residential", "SMALL": "Mixed use", "MEDIUM": "Industrial"}
    return v.part.select(
        F.concat(F.lit("R_"), k.cast("string")).alias("rule_id"), numbers.lookup("p_type", kinds, "Unclear").alias("description"),
        F.lit("as stated").alias("verbatim_chunk"), logic.alias("python_logic"))


@query("rul_06_rule_category", "SELECT rule_id, category FROM {part_packs}")
def rul_06(v: Views) -> DataFrame:
    return part_rules(v).select("rule_id", rl.rule_category("description", "verbatim_chunk").alias("category"))


@query("rul_07_thresholds", "SELECT rule_id, key, CASE WHEN key IS NOT NULL THEN value END AS value FROM {part_packs}")
def rul_07(v: Views) -> DataFrame:
    return part_rules(v).withColumn("t", rl.threshold("python_logic")).select("rule_id", "t.key", "t.value")


@query("agg_55_rule_packs", """
  SELECT category, key, CASE WHEN key LIKE 'min%' OR key = 'parkingPerDwellingUnit' THEN MAX(value) ELSE MIN(value) END AS value FROM {part_packs}
  WHERE category IS NOT NULL AND key IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
def agg_55(v: Views) -> DataFrame:
    return rl.derive_packs(part_rules(v))


@query("win_14_page_windows", """
  SELECT doc, window_no, MIN(p) AS start_page, MAX(p) AS end_page, STRING_AGG('[Page ' || p || ']' || CHR(10) || role, CHR(10) || CHR(10) ORDER BY p) AS text FROM (
    SELECT c.conv_id AS doc, c.turn + 1 AS p, c.role, w AS window_no FROM conversations c JOIN (SELECT conv_id, MAX(turn) + 1 AS last FROM conversations GROUP BY 1) l
      ON c.conv_id = l.conv_id, (SELECT UNNEST(RANGE(0, 50)) AS w)
    WHERE c.turn >= w * 2 AND c.turn < w * 2 + 3 AND (w = 0 OR (w - 1) * 2 + 3 < last)) GROUP BY 1, 2""")  # fmt: skip
def win_14(v: Views) -> DataFrame:
    p = v.conversations.select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page_number"), F.col("role").alias("text"))
    return rl.page_windows(p, 3, 1)




def _extractions(v: Views) -> DataFrame:
    body = F.concat(F.lit('```json\n{"Rules":[{"rule_id":"R_'), (F.col("user_id") % 40).cast("string"), F.lit('","description":"d'), F.col("event_id").cast("string"),
                    F.lit('","associated_assets":["A_'), (F.col("user_id") % 9).cast("string"), F.lit('"]}],"Processes":[{"process_name":"P'),
                    (F.col("user_id") % 12).cast("string"), F.lit('","associated_rules":["R_'), (F.col("user_id") % 45).cast("string"),
                    F.lit('"]}],"Visual_Assets":[{"asset_id":"A_'), (F.col("user_id") % 7).cast("string"), F.lit('","asset_type":"Table","page_number":1}]}\n```'))
    body = F.when(F.col("event_type") == "error", F.lit("not json {")).otherwise(body)
    raw = v.events.select("event_id", "user_id", (F.length("props") + F.col("user_id")).alias("input_tokens"), F.lit(10).alias("output_tokens"), body.alias("body"))
    return rl.parse_extractions(raw, schemas.EXTRACTION)


@query("jsn_01_parse_extractions", """
  SELECT event_id, event_type = 'error' AS malformed, CASE WHEN event_type <> 'error' THEN 'R_' || (user_id % 40) END AS rule_id FROM events""")  # fmt: skip
def jsn_01(v: Views) -> DataFrame:
    return _extractions(v).select("event_id", "malformed", F.get("parsed.Rules", F.lit(0))["rule_id"].alias("rule_id"))


@query("set_02_first_wins_merge", """
  SELECT 'R_' || (user_id % 40) AS rule_id, 'd' || MIN(event_id) AS description FROM events WHERE event_type <> 'error' GROUP BY 1""")  # fmt: skip
def set_02(v: Views) -> DataFrame:
    good = _extractions(v).where("NOT malformed").select(F.col("event_id").alias("window_no"), F.posexplode("parsed.Rules").alias("pos", "r"))
    rules = good.select("window_no", "pos", "r.*")
    return fl.first_wins([rules], ["rule_id"], ["window_no", "pos"]).select("rule_id", "description")


@query("jn_16_cross_references", """
  SELECT 'process ''' || p || ''' references unknown rule ' || r AS warning FROM (SELECT 'P' || (user_id % 12) AS p, 'R_' || (user_id % 45) AS r,
      ROW_NUMBER() OVER (PARTITION BY user_id % 12 ORDER BY event_id) AS n FROM events WHERE event_type <> 'error') WHERE n = 1 AND r NOT IN (
      SELECT 'R_' || (user_id % 40) FROM events WHERE event_type <> 'error')
  UNION ALL SELECT 'rule ' || r || ' references unknown asset ' || a FROM (SELECT 'R_' || (user_id % 40) AS r, 'A_' || (user_id % 9) AS a,
      ROW_NUMBER() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS n FROM events WHERE event_type <> 'error') WHERE n = 1 AND a NOT IN (
      SELECT 'A_' || (user_id % 7) FROM events WHERE event_type <> 'error')""")  # fmt: skip
def jn_16(v: Views) -> DataFrame:
    good = _extractions(v).where("NOT malformed")

    def merged(part: str, key: str) -> DataFrame:
        rows = good.select(F.col("event_id").alias("window_no"), F.posexplode(f"parsed.{part}").alias("pos", "r")).select("window_no", "pos", "r.*")
        return fl.first_wins([rows], [key], ["window_no", "pos"])

    return rl.cross_reference_warnings(merged("Rules", "rule_id"), merged("Processes", "process_name"), merged("Visual_Assets", "asset_id"))


@query("agg_57_token_totals", "SELECT CAST(SUM(LENGTH(props) + user_id) AS BIGINT) AS input_tokens, CAST(10 * COUNT(*) AS BIGINT) AS output_tokens FROM events")
def agg_57(v: Views) -> DataFrame:
    return rl.token_totals(_extractions(v))


@query("jsn_02_schema_problems", """
  SELECT event_id, CONCAT_WS(',', CASE WHEN event_type = 'view' THEN 'extra_keys' END, CASE WHEN user_id % 3 = 0 THEN 'bad_id' END,
    CASE WHEN user_id % 5 = 0 THEN 'bad_page_number' END, CASE WHEN event_type = 'click' THEN 'bad_type' END) AS problems FROM events""")  # fmt: skip
def jsn_02(v: Views) -> DataFrame:
    u, t = F.col("user_id"), F.col("event_type")
    body = F.concat(F.lit('{"asset_id":"'), F.when(u % 3 == 0, "low_case").otherwise("A_1"), F.lit('","page_number":'), (u % 5).cast("string"),
                    F.lit(',"asset_type":"'), F.when(t == "click", "Video").otherwise("Table"), F.lit('"'), F.when(t == "view", ',"note":"x"').otherwise(""), F.lit("}"))
    d = rl.schema_problems(v.events.withColumn("body", body), "body", ["asset_id", "page_number", "asset_type"])
    return d.select("event_id", F.array_join("problems", ",").alias("problems"))


# --- scrutiny ---------------------------------------------------------------------------


def _num(x: str) -> str:
    return f"REGEXP_REPLACE(CAST(CAST({x} AS DOUBLE) AS VARCHAR), '\\.0$', '')"


def _checks_sql(specs: list[tuple[str, ...]], shown: dict[str, tuple]) -> str:
    """specs: id, ok condition, status otherwise, severity otherwise, present condition; shown: key of the texts, value, need, values in texts."""
    parts = ", ".join(f"CASE WHEN {on} THEN '{i}:' || CASE WHEN {ok} THEN 'pass' ELSE '{bad}' END END" for i, ok, bad, _, on in specs)

    def text(key: str, which: int) -> str:
        out = (sc.TEXTS[key][which] or "").replace("'", "''")
        for name, value in (shown[key][2] if len(shown[key]) > 2 else {}).items():
            out = out.replace("{" + name + "}", f"' || {value} || '")
        return f"'{out}'"

    def line(i: str, ok: str, bad: str, sev: str, on: str) -> str:
        key = i if ok != "FALSE" else f"{i}_missing"
        have, need = shown[key][:2]
        cells = [f"'{i}'", text(key, 0), f"CASE WHEN {ok} THEN 'pass' ELSE '{bad}' END", f"CASE WHEN {ok} THEN 'low' ELSE '{sev}' END", have, need,
                 f"CASE WHEN {ok} THEN {text(key, 1)} ELSE {text(key, 2)} END", f"CASE WHEN {ok} THEN '' ELSE {text(key, 3)} END"]
        return f"CASE WHEN {on} THEN {' || \' | \' || '.join(cells)} END"

    def n(test: str) -> str:
        return " + ".join(f"CASE WHEN {on} AND NOT ({ok}) AND {test.format(bad=bad, sev=sev)} THEN 1 ELSE 0 END" for _, ok, bad, sev, on in specs)

    present = " + ".join(f"CASE WHEN {on} THEN 1 ELSE 0 END" for *_, on in specs)
    passed = " + ".join(f"CASE WHEN {on} AND ({ok}) THEN 1 ELSE 0 END" for _, ok, _, _, on in specs)
    return f"""CONCAT_WS(' ', {parts}) AS statuses, {n("'{bad}' = 'fail' AND '{sev}' = 'high'")} AS fh, {n("'{bad}' = 'fail'")} AS f,
      {n("'{bad}' = 'warning'")} AS w, {n("'{bad}' = 'manual_review'")} AS m, {present} AS n, {passed} AS p,
      CONCAT_WS(CHR(10), {", ".join(line(*x) for x in specs)}) AS checks"""


_B = [
    ("jurisdiction", "k % 29 <> 0", "manual_review", "medium", "TRUE"), ("boundary", "has_boundary", "fail", "high", "TRUE"),
    ("plot_area_match", "ABS(plot_area - geom_area) <= ABS(geom_area) * 0.05e0", "warning", "medium", "geom_area IS NOT NULL"),
    ("front_setback", "front_setback >= minfront", "fail", "high", "TRUE"), ("rear_setback", "rear_setback >= minrear", "fail", "high", "TRUE"),
    ("side_setback", "LEAST(left_setback, right_setback) >= minside", "fail", "high", "TRUE"),
    ("far", "built_up_area / plot_area <= maxfar", "fail", "high", "TRUE"), ("ground_coverage", "ground_coverage <= maxgc", "fail", "medium", "TRUE"),
    ("building_height", "height <= maxh", "fail", "high", "TRUE"), ("parking", "parking >= CEIL(floors * park)", "fail", "medium", "TRUE"),
    ("road_width", "FALSE", "manual_review", "medium", "road_gis_missing"), ("road_width", "road_width >= minroad", "fail", "high", "NOT road_gis_missing"),
    ("rainwater", "rainwater", "fail", "medium", "TRUE"), ("solar", "solar", "warning", "medium", "needsolar"),
]
_YES, _HALF = "CASE WHEN {} THEN 'Yes' ELSE 'No' END", "CAST(CAST(FLOOR({} + 0.5) AS BIGINT) AS VARCHAR)"
_BAYS = "CEIL(floors * park)"
_SHOWN_B = {
    "jurisdiction": ("CASE WHEN k % 29 <> 0 THEN 'Identified' ELSE 'Uncertain' END", "'Identified'"),
    "boundary": ("CASE WHEN has_boundary THEN 'Drawn' ELSE 'Missing' END", "'Drawn'"),
    "plot_area_match": (f"{_HALF.format('plot_area')} || ' sq m'", f"{_HALF.format('geom_area')} || ' sq m (±5%)'"),
    "front_setback": (f"{_num('front_setback')} || ' m'", f"'≥ ' || {_num('minfront')} || ' m'", {"label": "label", "need": _num("minfront")}),
    "rear_setback": (f"{_num('rear_setback')} || ' m'", f"'≥ ' || {_num('minrear')} || ' m'", {"label": "label", "need": _num("minrear")}),
    "side_setback": (f"{_num('LEAST(left_setback, right_setback)')} || ' m (min of L/R)'", f"'≥ ' || {_num('minside')} || ' m'", {"need": _num("minside")}),
    "far": ("'FAR ' || FORMAT('{:.2f}', FLOOR(built_up_area / plot_area * 100 + 0.5) / 100)", f"'≤ ' || {_num('maxfar')}", {"label": "label", "need": _num("maxfar")}),
    "ground_coverage": (f"{_num('ground_coverage')} || '%'", f"'≤ ' || {_num('maxgc')} || '%'", {"need": _num("maxgc")}),
    "building_height": (f"{_num('height')} || ' m / ' || floors || ' floors'", f"'≤ ' || {_num('maxh')} || ' m'",
                        {"have": _num("height"), "need": _num("maxh"), "label": "label"}),
    "parking": ("parking || ' bays'", f"'≥ ' || {_num(_BAYS)} || ' bays'",
                {"need": _num(_BAYS), "floors": "floors", "unit": _num("park"), "more": _num(f"({_BAYS} - parking)")}),
    "road_width": (f"{_num('road_width')} || ' m'", f"'≥ ' || {_num('minroad')} || ' m'", {"have": _num("road_width"), "need": _num("minroad"), "label": "label"}),
    "road_width_missing": (f"{_num('road_width')} || ' m (declared)'", f"'≥ ' || {_num('minroad')} || ' m'"),
    "rainwater": (_YES.format("rainwater"), "'Yes'"), "solar": (_YES.format("solar"), "'Yes'"),
}
CTES["packs"] = (
    "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else (str(x).upper() if isinstance(x, bool) else f"{x!r}::DOUBLE") for x in r) + ")"
                                         for r in sc.PACKS)
    + ") p(cat, label, maxh, minroad, maxfar, maxgc, minfront, minrear, minside, park, rain, needsolar)"
)
CTES["building"] = f"""
  SELECT *, {_checks_sql(_B, _SHOWN_B)} FROM (SELECT *, CASE WHEN building_use <> 'residential' THEN building_use WHEN height > 15 THEN 'residential_high_rise'
    WHEN height > 10 THEN 'residential_mid_rise' ELSE 'residential_low_rise' END AS cat FROM {{apps}} WHERE type IN ('building_permission', 'renovation_addition')) a
  JOIN {{packs}} USING (cat)"""
_FINAL = """
  SELECT *, CASE WHEN fh >= 2 THEN 'reject_recommendation' WHEN f > 0 THEN 'needs_correction' WHEN m > 0 THEN 'field_verification_required'
    WHEN why <> '' THEN 'needs_technical_review' ELSE 'auto_pass_eligible' END AS outcome, CAST(FLOOR(p / n * 100 + 0.5) AS INTEGER) AS rule_score,
    LEAST(100, f * 18 + w * 8 + m * 6 + {risk}) AS risk_score FROM (SELECT *, CONCAT_WS(', ', {why}) AS why FROM {{src}})"""
CTES["final_b"] = _FINAL.replace("{risk}", "CASE WHEN height > 15 THEN 10 ELSE 0 END + CASE WHEN building_use = 'commercial' THEN 5 ELSE 0 END").replace(
    "{why}", "CASE WHEN built_up_area > 1500 THEN 'High built-up area' END, CASE WHEN building_use = 'commercial' THEN 'Commercial use' END, "
    "CASE WHEN height > 15 THEN 'Height threshold crossed' END, CASE WHEN w > 0 THEN 'Rule ambiguity' END, CASE WHEN m > 0 THEN 'Boundary mismatch' END, "
    "CASE WHEN CONTAINS(statuses, 'road_width:') AND NOT CONTAINS(statuses, 'road_width:pass') THEN 'Road width missing' END").replace("{{src}}", "{building}")  # fmt: skip
_L = [
    ("internal_road_width", "internal_road >= 9", "fail", "high", "TRUE"), ("open_space", "open_space >= 10", "fail", "medium", "TRUE"),
    ("plot_count", "plots >= 1", "fail", "high", "TRUE"), ("utilities", "drainage AND water AND lighting", "fail", "medium", "TRUE"),
    ("approach_road", "approach_road >= 9", "fail", "high", "TRUE"), ("boundary_within_jurisdiction", "has_boundary", "warning", "high", "TRUE"),
]
_SHOWN_L = {
    "internal_road_width": (f"{_num('internal_road')} || ' m'", "'≥ 9 m'"), "open_space": (f"{_num('open_space')} || '%'", "'≥ 10%'"),
    "plot_count": (_num("plots"), "'≥ 1'"), "approach_road": (f"{_num('approach_road')} || ' m'", "'≥ 9 m'"),
    "utilities": ("COALESCE(NULLIF(CONCAT_WS(', ', CASE WHEN drainage THEN 'drainage' END, CASE WHEN water THEN 'water' END, CASE WHEN lighting THEN 'lighting' END), ''), 'none')",
                  "'drainage, water, lighting'"),
    "boundary_within_jurisdiction": ("CASE WHEN has_boundary THEN 'Inside' ELSE 'Crosses boundary' END", "'Inside'"),
}
CTES["layouts"] = f"SELECT *, {_checks_sql(_L, _SHOWN_L)} FROM {{apps}} WHERE type = 'layout_permission'"
CTES["final_l"] = _FINAL.replace("{risk}", "0").replace("{why}", "CASE WHEN w > 0 THEN 'Rule ambiguity' END, CASE WHEN m > 0 THEN 'Boundary mismatch' END").replace(
    "{{src}}", "{layouts}")
_O = [
    ("floors_match", "b.k IS NULL OR a.floors + CASE WHEN a.k % 6 = 0 THEN 1 ELSE 0 END = b.floors", "fail", "high", "TRUE"),
    ("usage_match", "b.k IS NULL OR a.building_use = b.building_use", "fail", "high", "TRUE"),
    ("setbacks_match", "b.k IS NULL OR (a.front_setback >= b.front_setback AND a.rear_setback >= b.rear_setback AND a.left_setback >= b.left_setback AND a.right_setback >= b.right_setback)", "fail", "high", "TRUE"),
    ("parking_provided", "b.k IS NULL OR a.parking >= b.parking", "fail", "medium", "TRUE"),
    ("road_width_verified", "NOT a.road_gis_missing", "manual_review", "medium", "TRUE"),
    ("completion_documents", "a.has_boundary", "fail", "high", "TRUE"),
]


def _sides(t: str) -> str:
    return " || ".join(f"'{m}' || {_num(f'{t}.{x}_setback')}" for m, x in (("F ", "front"), (", R ", "rear"), (", L ", "left"), (", Ri ", "right")))


_SHOWN_O = {
    "floors_match": (_num("a.floors + CASE WHEN a.k % 6 = 0 THEN 1 ELSE 0 END"), f"COALESCE({_num('b.floors')}, '—')"),
    "usage_match": ("a.building_use", "COALESCE(b.building_use, '—')"), "setbacks_match": (_sides("a"), f"COALESCE({_sides('b')}, '—')"),
    "parking_provided": (_num("a.parking"), f"COALESCE({_num('b.parking')}, '—')"),
    "road_width_verified": (_YES.format("NOT a.road_gis_missing"), "'Yes'"),
    "completion_documents": ("CASE WHEN a.has_boundary THEN 'Uploaded' ELSE 'Missing' END", "'Uploaded'"),
}
CTES["occupancies"] = f"""
  SELECT a.k, a.id, {_checks_sql(_O, _SHOWN_O)} FROM (SELECT * FROM {{apps}} WHERE type = 'occupancy_certificate') a
  LEFT JOIN (SELECT * FROM {{apps}} WHERE type = 'building_permission') b ON b.k = a.k - 1"""
CTES["final_o"] = CTES["final_l"].replace("{layouts}", "{occupancies}")


BUILT = "type IN ('building_permission', 'renovation_addition')"


def building(v: Views, where: str = BUILT, texts: bool = False) -> DataFrame:
    v.spread("orders")
    a = v.apps.where(where).withColumn("jurisdiction_known", F.col("k") % 29 != 0)
    return sc.finalize(sc.building_checks(sc.with_pack(a, sc.packs(v.spark)), texts), building=True)


def layouts(v: Views) -> DataFrame:
    v.spread("orders")
    return sc.finalize(sc.layout_checks(v.apps.where("type = 'layout_permission'").withColumn("inside_boundary", F.col("has_boundary"))))


def occupancies(v: Views) -> DataFrame:
    v.spread("orders")
    a = v.apps.where("type = 'occupancy_certificate'").select(
        "k", "id", (F.col("k") - 1).alias("sanctioned_k"), (F.col("floors") + F.when(F.col("k") % 6 == 0, 1).otherwise(0)).alias("r_floors"),
        F.col("building_use").alias("r_usage"), *[F.col(f"{s}_setback").alias(f"r_{s}") for s in ("front", "rear", "left", "right")],
        F.col("parking").alias("r_parking"), (~F.col("road_gis_missing")).alias("road_verified"), F.col("has_boundary").alias("documents_uploaded"))
    plans = v.apps.where("type = 'building_permission'")
    return sc.finalize(sc.occupancy_checks(a, plans, "sanctioned_k", "k"))


def _flat(df: DataFrame) -> DataFrame:
    st = F.transform("checks", lambda c: F.concat(c["id"], F.lit(":"), c["status"]))
    return df.select("k", F.array_join(st, " ").alias("statuses"), sc.check_lines().alias("checks"), "outcome", "rule_score", "risk_score",
                     F.array_join("why_escalated", ", ").alias("why"))


_COLS = "k, statuses, checks, outcome, rule_score, risk_score, why"


@query("rul_10_building_scrutiny", f"SELECT {_COLS} FROM {{final_b}}")
def rul_10(v: Views) -> DataFrame:
    return _flat(building(v, texts=True))


@query("rul_11_layout_scrutiny", f"SELECT {_COLS} FROM {{final_l}}")
def rul_11(v: Views) -> DataFrame:
    return _flat(layouts(v))


@query("rul_12_occupancy_scrutiny", f"SELECT {_COLS} FROM {{final_o}}")
def rul_12(v: Views) -> DataFrame:
    return _flat(occupancies(v))


@query("rul_13_outcomes", "SELECT outcome, COUNT(*) AS n, CAST(SUM(risk_score) AS BIGINT) AS risk FROM {final_b} GROUP BY 1")
def rul_13(v: Views) -> DataFrame:
    return building(v).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("risk_score").alias("risk"))


@query("jn_18_pack_join", "SELECT k, cat AS category, label, maxh FROM {building}")
def jn_18(v: Views) -> DataFrame:
    a = sc.with_pack(v.apps.where("type IN ('building_permission', 'renovation_addition')"), sc.packs(v.spark))
    return a.select("k", "category", "label", F.col("maxHeightM").alias("maxh"))


@query("jn_24_sanctioned_plan", "SELECT k, CONTAINS(statuses, 'usage_match:pass') AS usage_ok FROM {final_o}")
def jn_24(v: Views) -> DataFrame:
    ok = F.exists("checks", lambda c: (c["id"] == "usage_match") & (c["status"] == "pass"))
    return occupancies(v).select("k", ok.alias("usage_ok"))


@query("flt_16_failing_setbacks", "SELECT k FROM {final_b} WHERE REGEXP_MATCHES(statuses, 'setback:(fail|warning)')")
def flt_16(v: Views) -> DataFrame:
    return sc.failing(building(v), "setback").select("k")


@query("flt_09_risk_bands", """
  SELECT CASE WHEN risk_score < 30 THEN 'low' WHEN risk_score < 60 THEN 'medium' ELSE 'high' END AS band, district, COUNT(*) AS n FROM {final_b}
  WHERE type = 'building_permission' GROUP BY 1, 2""")  # fmt: skip
def flt_09(v: Views) -> DataFrame:
    b = fl.equals(building(v), {"type": "building_permission", "district": None})
    return b.withColumn("band", sc.risk_band()).groupBy("band", "district").agg(F.count(F.lit(1)).alias("n"))


@query("agg_48_risk_matrix", """
  SELECT 'risk' AS kind, CASE WHEN risk_score < 30 THEN 'low' WHEN risk_score < 60 THEN 'medium' ELSE 'high' END AS name, COUNT(*) AS n FROM {final_b} GROUP BY 2
  UNION ALL SELECT 'detection', match_status, COUNT(*) FROM {detections} GROUP BY 2""")  # fmt: skip
def agg_48(v: Views) -> DataFrame:
    a = cl.count_by(building(v), sc.risk_band(), "name").withColumn("kind", F.lit("risk"))
    return a.unionByName(cl.count_by(v.detections, F.col("match_status"), "name").withColumn("kind", F.lit("detection")))


@query("prj_08_severity_rank", """
  SELECT k, CASE WHEN outcome IN ('reject_recommendation', 'needs_correction') THEN 'high' WHEN outcome IN ('needs_technical_review', 'field_verification_required')
    THEN 'medium' ELSE 'low' END AS severity FROM {final_b}""")  # fmt: skip
def prj_08(v: Views) -> DataFrame:
    return building(v).select("k", sc.severity_of().alias("severity"))


@query("top_07_worklist", "SELECT k, risk_score FROM {final_b} ORDER BY risk_score DESC, k LIMIT 10")
def top_07(v: Views) -> DataFrame:
    return building(v).orderBy(F.desc("risk_score"), "k").limit(10).select("k", "risk_score")


@query("prj_06_authority", """
  SELECT k, CASE WHEN inside_ulb THEN 'ulb_officer' WHEN village IS NOT NULL THEN 'panchayat_secretary' ELSE 'manual_verification' END AS authority FROM {apps}""")  # fmt: skip
def prj_06(v: Views) -> DataFrame:
    return v.apps.select("k", sc.authority("inside_ulb", "village").alias("authority"))


# --- fees and caseload ----------------------------------------------------------------

CTES["fees"] = """
  SELECT *, GREATEST(total_fee - paid, 0) AS pending, CONCAT_WS(', ', CASE WHEN paid < total_fee THEN 'Fee paid lower than estimated' END,
    CASE WHEN paid = 0 THEN 'Receipt missing' END) AS warnings FROM (SELECT *, base_fee + area_fee + 750 + height_fee AS total_fee FROM (SELECT *,
      CASE type WHEN 'building_permission' THEN 1500 WHEN 'layout_permission' THEN 5000 WHEN 'occupancy_certificate' THEN 2500 ELSE 1000 END::DOUBLE AS base_fee,
      FLOOR(built_up_area * CASE building_use WHEN 'commercial' THEN 24 WHEN 'mixed_use' THEN 16 WHEN 'institutional' THEN 12 WHEN 'industrial' THEN 18 ELSE 8 END
        + 0.5)::DOUBLE AS area_fee, CASE WHEN height > 15 THEN 25000 ELSE 0 END::DOUBLE AS height_fee,
      CASE WHEN k % 5 = 0 THEN 0 ELSE FLOOR(fee_paid / 10) END::DOUBLE AS paid FROM {apps}))"""
CTES["cases_all"] = """
  SELECT f.*, b.outcome, COALESCE(b.why, '') AS why, b.risk_score FROM {fees} f LEFT JOIN {final_b} b ON f.k = b.k"""


def fees(v: Views, apps: DataFrame | None = None) -> DataFrame:
    v.spread("orders")
    a = (v.apps if apps is None else apps).withColumn("fee_paid", F.when(F.col("k") % 5 == 0, 0.0).otherwise(F.floor(F.col("fee_paid") / 10).cast("double")))
    return sc.reconcile_fees(sc.estimate_fees(a))


def caseload(v: Views) -> DataFrame:
    # One reading of the applications: every row is checked, and other types than buildings lose the result.
    b, no_reason = F.expr(BUILT), F.array().cast("array<string>")
    a = building(v, "true").withColumns(
        {"outcome": F.when(b, F.col("outcome")), "risk_score": F.when(b, F.col("risk_score")), "why_escalated": F.when(b, F.col("why_escalated")).otherwise(no_reason)}
    )
    return fees(v, a).withColumn("is_high_rise", F.col("height") > 15)


@query("rul_14_fees", "SELECT k, base_fee, area_fee, height_fee, total_fee, pending, warnings FROM {fees}")
def rul_14(v: Views) -> DataFrame:
    return fees(v).select("k", "base_fee", "area_fee", "height_fee", "total_fee", "pending", F.array_join("fee_warnings", ", ").alias("warnings"))


@query("mth_05_tolerance", """
  SELECT k, ABS(plot_area - geom_area) <= ABS(geom_area) * 0.05e0 AS near FROM {apps}""")  # fmt: skip
def mth_05(v: Views) -> DataFrame:
    return v.apps.select("k", numbers.within_pct("plot_area", "geom_area").alias("near"))


@query("agg_41_state_dashboard", """
  SELECT COUNT(*) AS received, COUNT(outcome) AS auto_scrutinized, COUNT(*) FILTER (WHERE status IN ('approved', 'construction_monitoring_active', 'occupancy_review')) AS approved,
    COUNT(*) FILTER (WHERE status = 'correction_requested' OR COALESCE(outcome, '') = 'needs_correction') AS correction_required,
    COUNT(*) FILTER (WHERE status = 'field_inspection_assigned') AS inspections_pending, SUM(paid) AS fee_collected, COUNT(*) FILTER (WHERE warnings <> '') AS fee_mismatch,
    CAST(FLOOR(AVG(date_diff('day', submitted_at, approved_at)) + 0.5) AS BIGINT) AS mean_approval_days,
    (SELECT COUNT(*) FROM {detections} WHERE match_status <> 'matches_approval') AS violations FROM {cases_all}""")  # fmt: skip
def agg_41(v: Views) -> DataFrame:
    return cl.state_metrics(caseload(v), v.detections)


CTES["districts2"] = """
  SELECT k AS district, CAST(SUM(a) AS BIGINT) AS applications, CAST(SUM(b) AS BIGINT) AS violations FROM (SELECT district AS k, 1 AS a, 0 AS b FROM {apps} UNION ALL
    SELECT district, 0, CASE WHEN match_status <> 'matches_approval' THEN 1 ELSE 0 END FROM {detections}) GROUP BY 1"""


@query("agg_42_by_district", "SELECT * FROM {districts2} WHERE applications > 0 OR violations > 0")
def agg_42(v: Views) -> DataFrame:
    return cl.by_district(v.apps, v.detections)


@query("agg_43_by_place", """
  SELECT k AS place, CAST(SUM(a) AS BIGINT) AS applications, CAST(SUM(b) AS BIGINT) AS violations FROM (SELECT COALESCE(ulb, village, 'Unallocated') AS k, 1 AS a, 0 AS b FROM {apps}
    UNION ALL SELECT COALESCE(ulb, village, 'Unallocated'), 0, CASE WHEN match_status <> 'matches_approval' THEN 1 ELSE 0 END FROM {detections}) GROUP BY 1""")  # fmt: skip
def agg_43(v: Views) -> DataFrame:
    return cl.by_place(v.apps, v.detections)


@query("agg_44_high_risk", """
  SELECT district, violations || CASE WHEN violations = 1 THEN ' violation detected' ELSE ' violations detected' END AS reason,
    CASE WHEN violations > 1 THEN 'high' ELSE 'medium' END AS severity FROM {districts2} WHERE violations > 0""")  # fmt: skip
def agg_44(v: Views) -> DataFrame:
    return cl.high_risk(cl.by_district(v.apps, v.detections))


@query("agg_45_officer_queue", """
  SELECT COUNT(*) FILTER (WHERE status IN ('submitted', 'auto_scrutiny_completed')) AS new_applications, COUNT(*) FILTER (WHERE outcome = 'auto_pass_eligible') AS auto_pass,
    COUNT(*) FILTER (WHERE status = 'correction_requested' OR COALESCE(outcome, '') = 'needs_correction') AS correction,
    COUNT(*) FILTER (WHERE DATE '2001-08-01' - submitted_at > 21 AND status NOT IN ('approved', 'closed', 'rejected')) AS sla_breach,
    COUNT(*) FILTER (WHERE status = 'field_inspection_assigned') AS field_visits_due, COUNT(*) FILTER (WHERE outcome = 'reject_recommendation') AS possible_violations,
    SUM(pending) AS fees_pending FROM {cases_all}""")  # fmt: skip
def agg_45(v: Views) -> DataFrame:
    return cl.queue_counters(caseload(v), as_of())


@query("agg_46_citizen_counters", """
  SELECT COUNT(*) FILTER (WHERE status = 'draft') AS draft, COUNT(*) FILTER (WHERE status IN ('submitted', 'auto_scrutiny_completed', 'officer_review_pending', 'field_inspection_assigned'))
    AS in_review, COUNT(*) FILTER (WHERE status IN ('approved', 'construction_monitoring_active', 'occupancy_review', 'closed')) AS approved,
    COUNT(*) FILTER (WHERE status = 'correction_requested') AS corrections FROM {apps}""")  # fmt: skip
def agg_46(v: Views) -> DataFrame:
    return cl.citizen_counters(v.apps)


@query("agg_47_revenue", """
  SELECT SUM(total_fee) AS assessed, SUM(paid) AS paid, SUM(total_fee) - SUM(paid) AS pending, COUNT(*) FILTER (WHERE warnings <> '') AS mismatch,
    COUNT(*) FILTER (WHERE type = 'building_permission') AS building, COUNT(*) FILTER (WHERE type = 'building_permission' AND status IN ('approved',
      'construction_monitoring_active', 'occupancy_review')) AS building_approved, COUNT(*) FILTER (WHERE type = 'layout_permission') AS layout,
    COUNT(*) FILTER (WHERE type = 'occupancy_certificate') AS occupancy, COUNT(*) FILTER (WHERE type = 'renovation_addition') AS renovation,
    MAX(top) AS top_district_fees FROM {fees}, (SELECT MAX(s) AS top FROM (SELECT SUM(paid) AS s FROM {fees} GROUP BY district))""")  # fmt: skip
def agg_47(v: Views) -> DataFrame:
    f = fees(v)
    return cl.revenue(f).withColumn("top_district_fees", cl.fees_by_district(f).agg(F.max("fees")).scalar())


@query("flt_08_role_scope", """
  SELECT 'ulb_officer' AS role, COUNT(*) AS n, MIN(k) AS first_k FROM {cases_all} WHERE inside_ulb
  UNION ALL SELECT 'panchayat_secretary', COUNT(*), MIN(k) FROM {cases_all} WHERE NOT inside_ulb AND village IS NOT NULL
  UNION ALL SELECT 'dtcp_reviewer', COUNT(*), MIN(k) FROM {cases_all} WHERE why <> '' OR COALESCE(outcome, '') = 'needs_technical_review' OR type = 'layout_permission' OR height > 15
    OR building_use = 'commercial'
  UNION ALL SELECT 'field_inspector', COUNT(*), MIN(k) FROM {cases_all} WHERE status IN ('field_inspection_assigned', 'construction_monitoring_active')
  UNION ALL SELECT role, COUNT(*), MIN(k) FROM {cases_all}, (VALUES ('state_admin'), ('mandal_officer'), ('district_panchayat_officer')) r(role) GROUP BY role
  UNION ALL SELECT role, COUNT(*), MIN(k) FROM {cases_all}, (VALUES ('citizen', '7'), ('architect', '13')) r(role, part) WHERE contains('c' || k || '@mail.example', part) GROUP BY role""")  # fmt: skip
def flt_08(v: Views) -> DataFrame:
    c = caseload(v)
    out = None
    c = c.withColumn("email", F.concat(F.lit("C"), F.col("k").cast("string"), F.lit("@Mail.example")))
    own = {"citizen": "7", "architect": "13"}  # part of the user's own mail address
    for role in ("ulb_officer", "panchayat_secretary", "dtcp_reviewer", "field_inspector", "state_admin", "mandal_officer", "district_panchayat_officer", *own):
        one = cl.visible_to(c, role, own.get(role)).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_k")).withColumn("role", F.lit(role))
        out = one if out is None else out.unionByName(one)
    return out


@query("flt_15_unmatched_detections", "SELECT id, match_status, district FROM {detections} WHERE match_status <> 'matches_approval'")
def flt_15(v: Views) -> DataFrame:
    return cl.unmatched(v.detections).select("id", "match_status", "district")


@query("flt_07_token_search", """
  SELECT k FROM {apps} WHERE (LOWER(id) LIKE '%app-1%' OR LOWER(ulb) LIKE '%app-1%' OR LOWER(village) LIKE '%app-1%' OR LOWER(district) LIKE '%app-1%')
    AND (LOWER(id) LIKE '%nation_4%' OR LOWER(ulb) LIKE '%nation_4%' OR LOWER(village) LIKE '%nation_4%' OR LOWER(district) LIKE '%nation_4%')""")  # fmt: skip
def flt_07(v: Views) -> DataFrame:
    return fl.search_tokens(v.apps, ["id", "ulb", "village", "district"], "APP-1 nation_4").select("k")


CTES["routed"] = """
  SELECT a.*, CASE WHEN inside_ulb THEN u.officer_id ELSE p.officer_id END AS officer FROM {cases_all} a
  LEFT JOIN (SELECT ulb, ARG_MIN(officer_id, ord) AS officer_id FROM {officers} WHERE role = 'ulb_officer' GROUP BY 1) u ON a.ulb = u.ulb
  LEFT JOIN (SELECT village, ARG_MIN(officer_id, ord) AS officer_id FROM {officers} WHERE role = 'panchayat_secretary' GROUP BY 1) p ON a.village = p.village"""


@query("jn_20_officer_assignment", """
  SELECT k, officer AS assigned_officer, CASE WHEN officer IS NOT NULL THEN 'officer_review_pending' ELSE status END AS status FROM {routed}""")  # fmt: skip
def jn_20(v: Views) -> DataFrame:
    return cl.route(caseload(v), v.officers).select("k", "assigned_officer", "status")


@query("rul_23_routing_alerts", """
  SELECT id AS application_id, (SELECT ARG_MIN(officer_id, ord) FROM {officers} WHERE role = 'dtcp_reviewer') AS assigned_user, id || ' flagged for DTCP scrutiny.' AS body
  FROM {cases_all} WHERE height > 15 OR building_use = 'commercial' OR type = 'layout_permission' OR COALESCE(outcome, '') = 'needs_technical_review'""")  # fmt: skip
def rul_23(v: Views) -> DataFrame:
    return cl.routing_alerts(cl.route(caseload(v), v.officers)).select("application_id", "assigned_user", "body")


CTES["commands"] = """
  SELECT 'APP-' || user_id AS id, event_id AS seq, CAST(ts AS DATE) AS at, CASE event_type WHEN 'click' THEN 'submit' WHEN 'view' THEN 'correct' WHEN 'purchase' THEN 'approve'
    WHEN 'error' THEN 'reject' ELSE 'inspect' END AS command FROM events"""


def commands(v: Views) -> DataFrame:
    t = F.col("event_type")
    name = F.when(t == "click", "submit").when(t == "view", "correct").when(t == "purchase", "approve").when(t == "error", "reject").otherwise("inspect")
    return v.events.select(
        F.concat(F.lit("APP-"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("seq"), F.to_date("ts").alias("at"),
        name.alias("command"), F.lit("ulb_officer").alias("by_role"), F.concat(F.lit("remark "), F.col("event_id").cast("string")).alias("remarks"))


@query("snk_12_state_changes", """
  SELECT a.id, CASE c.command WHEN 'submit' THEN 'auto_scrutiny_completed' WHEN 'correct' THEN 'correction_requested' WHEN 'approve' THEN CASE WHEN type = 'occupancy_certificate'
      THEN 'closed' ELSE 'approved' END WHEN 'reject' THEN 'rejected' WHEN 'inspect' THEN 'field_inspection_assigned' ELSE a.status END AS status,
    CAST(COALESCE(p.approved, a.approved_at) AS VARCHAR) AS approved_at, COALESCE(n.n, 0) AS audit_rows, COALESCE(n.al, 0) AS alert_rows
  FROM {apps} a LEFT JOIN (SELECT id, ARG_MAX(command, seq) AS command FROM {commands} GROUP BY 1) c ON a.id = c.id
  LEFT JOIN (SELECT id, MAX("at") AS approved FROM {commands} WHERE command = 'approve' GROUP BY 1) p ON a.id = p.id
  LEFT JOIN (SELECT id, COUNT(*) AS n, COUNT(*) FILTER (WHERE command IN ('correct', 'approve', 'inspect')) AS al FROM {commands} GROUP BY 1) n ON a.id = n.id""")  # fmt: skip
def snk_12(v: Views) -> DataFrame:
    apps, audit, alerts = cl.apply_commands(v.apps, commands(v))
    n = audit.groupBy("id").agg(F.count(F.lit(1)).alias("audit_rows"))
    m = alerts.groupBy("id").agg(F.count(F.lit(1)).alias("alert_rows"))
    out = apps.join(n, "id", "left").join(m, "id", "left").fillna(0, ["audit_rows", "alert_rows"])
    return out.select("id", "status", F.col("approved_at").cast("string").alias("approved_at"), "audit_rows", "alert_rows")


@query("top_09_latest_audit", """
  SELECT id, module FROM {audit_log} WHERE case_id = 7 ORDER BY id DESC""")  # fmt: skip
def top_09(v: Views) -> DataFrame:
    return fl.case_rows(v.audit_log, 7).orderBy(F.desc("at"), F.desc("id")).select("id", "module")


@query("top_10_top_per_group", """
  SELECT district, k, risk_score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY district ORDER BY risk_score DESC, k) AS rn FROM {final_b}) WHERE rn <= 3""")  # fmt: skip
def top_10(v: Views) -> DataFrame:
    return fl.top_per_group(building(v), ["district"], [F.desc("risk_score"), F.col("k")], 3).select("district", "k", "risk_score")


@query("mth_06_rounded_quantities", """
  SELECT k, CAST(CEIL(floors * 1.25e0) AS BIGINT) AS bays, FLOOR(built_up_area * 8 + 0.5) AS fee, ROUND_EVEN(built_up_area * 10, 0) / 10 AS half_even1 FROM {apps}""")  # fmt: skip
def mth_06(v: Views) -> DataFrame:
    return v.apps.select("k", F.ceil(F.col("floors") * 1.25).alias("bays"), numbers.half_up(F.col("built_up_area") * 8).alias("fee"),
                         numbers.half_even("built_up_area", 1).alias("half_even1"))

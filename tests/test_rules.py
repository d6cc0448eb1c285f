import pytest
from pyspark.sql import functions as F

from tallyworks.operators import bids as bd
from tallyworks.operators import caseload as cl
from tallyworks.operators import filters as fl
from tallyworks.operators import geo
from tallyworks.operators import rules as rl
from tallyworks.operators import scrutiny as sc

CASES = [
    ("REQUIRE gap >= 4.25", 4.25, 2, "pass"),
    ("REQUIRE gap >= 4.25", 4.24, 2, "fail"),
    ("IF rise > 9: REQUIRE gap >= 3", 3.5, 12, "pass"),
    ("IF rise > 9: REQUIRE gap >= 3", 2.5, 12, "fail"),
    ("if rise > 9: require gap >= 3", 0.0, 9, "pass"),
    ("REQUIRE (gap >= 4) AND (rise <= 2)", 4.0, 2, "pass"),
    ("REQUIRE (gap >= 4) and (rise <= 2)", 3.0, None, "fail"),
    ("REQUIRE (rise <= 2) AND (gap >= 4)", 3.0, None, "manual_review"),
    ("REQUIRE gap >= 4 OR rise > 5", 4.0, None, "pass"),
    ("REQUIRE gap >= 4 OR rise > 5", 3.0, None, "manual_review"),
    ("REQUIRE NOT (gap < 2)", 2.0, 2, "pass"),
    ("REQUIRE NOT (gap < 2)", 1.0, 2, "fail"),
    ("REQUIRE gap >= 4.25", None, 2, "manual_review"),
    ("REQUIRE shade >= 4.25", 5.0, 2, "manual_review"),
    ("REQUIRE os.getcwd() > 5", 5.0, 2, "manual_review"),
    ("REQUIRE floor(gap) >= 5", 5.0, 2, "manual_review"),
    ("REQUIRE gap >= -2", 5.0, 2, "manual_review"),
    ("REQUIRE 2 < gap < 6", 5.0, 2, "manual_review"),
    ("gap > 2", 5.0, 2, "manual_review"),
    ("REQUIRE open == True", 5.0, 2, "pass"),
    ("REQUIRE open == False", 5.0, 2, "fail"),
]


@pytest.mark.parametrize("logic,gap,rise,want", CASES)
def test_verdicts(spark, logic, gap, rise, want):
    df = spark.createDataFrame([(gap, None if rise is None else float(rise), True)], "gap double, rise double, open boolean")
    v = df.select(rl.verdict(logic, {c: F.col(c) for c in df.columns}).alias("v")).first().v
    assert v.status == want
    if "unparseable" not in v.reason and want == "manual_review":
        assert v.reason.startswith("missing input: ")


def test_report_outcomes(spark):
    rules = [{"rule_id": "STREET", "description": "gap to the street", "python_logic": "REQUIRE street_gap >= 4"},
             {"rule_id": "TOWER", "description": "towers stand apart", "python_logic": "IF rise > 25: REQUIRE side_gap >= 9"}]
    df = spark.createDataFrame([(1, 4.5, 30.0, 9.5), (2, 3.5, 12.0, 0.0), (3, 4.5, None, None)], "id int, street_gap double, rise double, side_gap double")
    c = rl.checks(df, rules, {x: F.col(x) for x in df.columns[1:]})
    assert {r.id: r.outcome for r in rl.outcome(c, "id").collect()} == {1: "auto_pass_eligible", 2: "needs_correction", 3: "manual_verification_required"}
    assert rl.report(c, "id").count() == 6


def test_rule_packs(spark):
    rows = [("A", "Front setback of a residential low-rise house", "REQUIRE front_setback_m >= 3.25"), ("B", "Residential: front, larger plots", "REQUIRE front_setback_m >= 4.5"),
            ("C", "Rear setback, residential low-rise", "REQUIRE rear_setback_m >= 2.75"), ("D", "FAR of commercial plots", "REQUIRE far <= 2.25"),
            ("E", "Front setback for high-rise residential", "IF height_m > 18: REQUIRE 8 <= front_setback_m"), ("F", "Colour of the fence", "REQUIRE hue > 1")]
    df = spark.createDataFrame([(*r, "") for r in rows], "rule_id string, description string, python_logic string, verbatim_chunk string")
    p = {r.category: r for r in rl.packs_wide(rl.derive_packs(df)).collect()}
    assert p["residential_low_rise"].minFrontSetbackM == 4.5 and p["residential_low_rise"].minRearSetbackM == 2.75
    assert p["commercial"].maxFAR == 2.25 and p["residential_high_rise"].minFrontSetbackM == 8
    assert [r.rule_id for r in rl.unmappable(df).collect()] == ["F"]


@pytest.mark.parametrize("pages,size,overlap,want", [
    (10, 4, 0, [(1, 4), (5, 8), (9, 10)]), (10, 4, 1, [(1, 4), (4, 7), (7, 10)]), (3, 8, 1, [(1, 3)]), (9, 4, 1, [(1, 4), (4, 7), (7, 9)]), (1, 1, 0, [(1, 1)]),
])
def test_page_windows(spark, pages, size, overlap, want):
    df = spark.createDataFrame([("d", i, f"p{i}") for i in range(1, pages + 1)], "doc string, page_number int, text string")
    got = sorted((r.window_no, r.start_page, r.end_page) for r in rl.page_windows(df, size, overlap).collect())
    assert [(a, b) for _, a, b in got] == want


def test_scrutiny_edges(spark):
    cols = ("id string, building_use string, height double, floors int, plot_area double, geom_area double, built_up_area double, front_setback double, "
            "rear_setback double, left_setback double, right_setback double, ground_coverage double, parking int, road_width double, rainwater boolean, "
            "solar boolean, has_boundary boolean, road_gis_missing boolean, jurisdiction_known boolean")  # fmt: skip
    good = ("a", "residential", 9.0, 2, 100.0, 102.0, 150.0, 2.0, 1.0, 1.0, 1.0, 50.0, 2, 6.0, True, False, True, False, True)
    bad = ("b", "commercial", 40.0, 2, 100.0, None, 500.0, 1.0, 1.0, 1.0, 1.0, 90.0, 0, 6.0, False, False, False, True, False)
    df = spark.createDataFrame([good, bad], cols)
    got = {r.id: r for r in sc.finalize(sc.building_checks(sc.with_pack(df, sc.packs(spark))), building=True).collect()}
    assert got["a"].outcome == "auto_pass_eligible" and got["a"].rule_score == 100 and got["a"].risk_score == 0
    assert [c.id for c in got["a"].checks][-1] == "rainwater"  # no solar rule for low-rise
    assert got["a"].checks[3].required_value == "≥ 1.5 m" and got["a"].checks[3].applicant_value == "2 m"
    assert got["a"].checks[5].applicant_value == "1 m (min of L/R)" and got["a"].checks[5].suggested_correction is None
    b = {c.id: c for c in got["b"].checks}
    assert b["side_setback"].suggested_correction == "Increase the smaller side setback to 3 m."
    assert b["parking"].explanation == "Need 4 bays for 2 floors at 2/unit." and b["parking"].suggested_correction == "Add 4 more parking bays."
    assert b["road_width"].name == "Road width compatibility" and b["road_width"].applicant_value == "6 m (declared)"
    assert got["b"].outcome == "reject_recommendation" and got["b"].risk_score == 100
    assert "plot_area_match" not in [c.id for c in got["b"].checks]
    assert got["b"].why_escalated == ["Commercial use", "Height threshold crossed", "Rule ambiguity", "Boundary mismatch", "Road width missing"]


def test_bid_lists(spark):
    cols = ("bid_id int, case_id int, bid_amount double, turnover double, solvency_age string, jv_status string, quality_plan boolean, safety_plan boolean, "
            "technical_approach boolean, missing_documents array<string>, unsupported_claims array<string>, altered_forms array<string>")  # fmt: skip
    good = (1, 7, 100.0, 40.0, "2 months", "Notarized", True, True, True, [], None, [])
    poor = (2, 7, 70.0, 1.0, "9 months", "missing", False, True, True, ["EMD"], ["Bridge", "Road"], ["FIN-7"])
    cases = spark.createDataFrame([(7, 100.0, 100.0)], "case_id int, estimated_value double, benchmark_value double")
    a, b = sorted(bd.evaluate_bids(spark.createDataFrame([good, poor], cols), cases).collect(), key=lambda r: r.bid_id)
    assert a.recommendation == "Qualified" and [s.notes for s in a.stages] == ["OK"] * 6 + ["Qualified"] and a.evidence_missing == []
    assert [x.decision for x in a.explainability] == ["Turnover meets threshold"]
    assert b.recommendation == "Disqualified" and b.evidence_missing == ["EMD"]
    assert [s.notes for s in b.stages] == ["1 required docs missing", "Eligibility deficiencies detected", "Quality / Safety plan deficiencies",
                                           "Turnover below threshold", "Δ -30.0% vs benchmark", "5 red flag(s)", "Disqualified"]
    assert b.clarification_questions[-1] == "Submit completion certificate(s) for: Bridge; Road."
    assert [x.evidence_missing for x in b.explainability] == ["—", "Recent solvency", "JV Agreement", "Bridge; Road", "FIN-7", "Computed additional security"]


def test_section_issues(spark):
    cols = "draft_id int, case_id int, pos int, section_id int, section_type string, is_placeholder boolean, technical_approval boolean, missing_variables array<string>"
    rows = [(1, 1, 1, 11, "Scope", True, True, ["x"]), (1, 1, 2, 12, "Forms", False, True, ["x", "y"]), (1, 1, 3, 13, "Cover", False, True, None)]
    got = sorted(bd.detected_issues(spark.createDataFrame(rows, cols)).collect(), key=lambda r: r.pos)
    assert [r.rule_id for r in got] == ["rule_002", None]
    assert got[0].evidence == "Section 11 source = Placeholder; technicalApprovalRequired = true"
    assert got[1].description == "Forms contains placeholder variable(s): x, y." and got[1].suggested_fix == "Officer to provide values for x."


@pytest.mark.parametrize("hot", [0, 10**9])
def test_bid_rank(spark, hot):
    rows = [(i, 1, "Qualified" if i % 3 else "Disqualified", float(i % 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "bid_id int, case_id int, recommendation string, bid_amount double")
    got = {r.bid_id: r.l1_rank for r in bd.rank_bids(df, hot).collect()}
    q = sorted((a, i) for i, _, r, a in rows if r == "Qualified")
    assert got == {**{i: None for i, _, r, _ in rows if r != "Qualified"}, **{i: n + 1 for n, (_, i) in enumerate(q)}}


def ring(*pts):
    return F.array(*[geo.point(float(x), float(y)) for x, y in (*pts, pts[0])])


def test_polygon_with_hole_and_boundary(spark):
    outer, hole = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (3, 1), (3, 3), (1, 3))
    layer = spark.range(1).select(F.lit(0).alias("layer_order"), F.lit("A").alias("name"), F.array(F.array(outer, hole)).alias("polygons"))
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 1.0, 2.0), (4, 4.0, 4.0), (5, 5.0, 1.0), (6, 3.5, 2.0)], "id int, lng double, lat double")
    got = {r.id for r in geo.point_in_polygon(pts, layer, "id", "name", size=1.0).collect()}
    assert got == {1, 3, 4, 6}
    whole = layer.select(geo.area("polygons").alias("a"), geo.area(F.array(F.array(outer))).alias("o"), geo.area(F.array(F.array(hole))).alias("h")).first()
    assert whole.a == pytest.approx(whole.o - whole.h)


def test_overlap_of_concave_shapes():
    def poly(*pts):
        return [[[{"x": x, "y": y} for x, y in (*pts, pts[0])]]]

    ell = poly((0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2))
    box = poly((0.5, 0.5), (1.5, 0.5), (1.5, 1.5), (0.5, 1.5))
    three = geo.overlap_sqm(ell, box)
    quarter = geo.overlap_sqm(poly((0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1)), box)
    assert three == pytest.approx(3 * quarter, rel=1e-3)
    assert geo.overlap_sqm(box, ell) == pytest.approx(three, rel=1e-6)
    holed = [box[0] + [[{"x": x, "y": y} for x, y in ((0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1), (0.5, 0.5))]]]
    assert geo.overlap_sqm(holed, box) == pytest.approx(3 * quarter, rel=1e-3)


def test_nearest_line_keeps_the_first_on_ties(spark):
    line = lambda y: F.array(geo.point(F.lit(0.0), F.lit(y)), geo.point(F.lit(0.01), F.lit(y)))
    lines = spark.range(1).select(F.lit(1).alias("layer_order"), F.lit("north").alias("name"), line(0.001).alias("line")).unionByName(
        spark.range(1).select(F.lit(2).alias("layer_order"), F.lit("south").alias("name"), line(-0.001).alias("line")))
    pts = spark.createDataFrame([(1, 0.005, 0.0), (2, 0.005, 0.5), (3, 0.005, -0.0005)], "id int, lng double, lat double")
    got = {r.id: (r.name, round(r.distance_m)) for r in geo.nearest_line(pts, lines, "id", "name").collect()}
    assert got == {1: ("north", 111), 3: ("south", 56)}


def test_commands_on_unknown_applications(spark):
    apps = spark.createDataFrame([("A", "occupancy_certificate", "submitted", "citizen", None)], "id string, type string, status string, applicant_type string, approved_at date")
    cmd = spark.createDataFrame([("A", 1, "approve", None, "o", "r1"), ("Z", 2, "reject", None, "o", "r2")], "id string, seq int, command string, at date, by_role string, remarks string")
    out, audit, alerts = cl.apply_commands(apps, cmd)
    assert out.first().status == "closed" and audit.count() == 1 and alerts.first().assigned_role == "citizen"


def test_first_issue_of_a_hot_key_over_given_tasks(spark):
    """Dealt by a salt of the order first: the same first rows, nulls in order included."""
    known = spark.createDataFrame([("d1", None, "Minor")] + [("d1", i, "Critical") for i in range(300)] + [("d2", i, "Moderate") for i in range(3)], "draft_id string, pos long, severity string")
    seen = spark.createDataFrame([(d, i, "Minor") for d in ("d1", "d3", None) for i in range(40, 0, -1)], "draft_id string, pos long, severity string")
    read = lambda **kw: sorted(map(str, fl.first_wins([known, seen], ["draft_id"], ["pos", "severity"], **kw).collect()))
    assert read(tasks=7) == read() and len(read()) == 4

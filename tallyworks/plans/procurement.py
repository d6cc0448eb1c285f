"""Bid, draft, readiness and graph queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.operators import bids as bd
from tallyworks.operators import filters as fl
from tallyworks.plans.registry import CTES, query, rounded
from tallyworks.sinks import tables as snk
from tallyworks.sources.views import Views

DOCUMENTS, CLAIMS, FORMS, VARIABLES = ("EMD receipt", "FIN-10"), ("Bridge 2021", "Road 2022"), ("FIN-7",), ("bid_security", "completion_period")


def _list(words: tuple[str, ...], n: str) -> str:
    """SQL list of the first n words."""
    return f"[{', '.join(repr(w) for w in words)}][1:{n}]"


CTES["bid_facts"] = f"""
  SELECT b.*, {_list(DOCUMENTS, "n_missing")} AS missing, ARRAY_TO_STRING({_list(CLAIMS, "n_unsupported")}, '; ') AS claims,
    ARRAY_TO_STRING({_list(FORMS, "n_altered")}, '; ') AS forms, c.estimated_value, c.benchmark_value, (bid_amount - benchmark_value) / benchmark_value * 100 AS delta, turnover < estimated_value * 0.3 AS poor,
    LOWER(jv_status) LIKE '%missing%' AS nojv, solvency_age LIKE '%month%' AND TRY_CAST(REGEXP_EXTRACT(solvency_age, '^\\s*(\\d+)', 1) AS BIGINT) > 6 AS old
  FROM {{bids}} b JOIN {{cases}} c ON b.case_id = c.case_id"""
CTES["judged"] = """
  SELECT *, CASE WHEN poor THEN 'Disqualified' WHEN flags = '' AND n_missing = 0 THEN 'Qualified' ELSE 'Needs Clarification' END AS recommendation FROM (SELECT *,
    CONCAT_WS('; ', CASE WHEN old THEN 'Solvency certificate older than allowed 6 months' END, CASE WHEN nojv THEN 'Missing notarized JV agreement' END,
      CASE WHEN n_unsupported > 0 THEN 'Unsupported similar-work claim' END, CASE WHEN n_altered > 0 THEN 'Altered/forged form detected' END,
      CASE WHEN delta > 5 THEN 'Bid amount ' || FORMAT('{:.1f}', FLOOR(delta * 10 + 0.5) / 10) || '% above internal benchmark'
        WHEN delta < -25 THEN 'Abnormally low bid (' || FORMAT('{:.1f}', FLOOR(delta * 10 + 0.5) / 10) || '% below benchmark)' END) AS flags,
    old::INT + nojv::INT + (n_unsupported > 0)::INT + (n_altered > 0)::INT + (delta > 5 OR delta < -25)::INT AS n_flags FROM {bid_facts})"""


def _first(words: tuple[str, ...], n: str) -> Column:
    return F.slice(F.array(*[F.lit(w) for w in words]), F.lit(1), F.col(n))


def bids(v: Views) -> DataFrame:
    return v.bids.withColumns(
        {"missing_documents": _first(DOCUMENTS, "n_missing"), "unsupported_claims": _first(CLAIMS, "n_unsupported"), "altered_forms": _first(FORMS, "n_altered")}
    )


def sections(v: Views) -> DataFrame:
    return v.sections.withColumn("missing_variables", _first(VARIABLES, "n_missing_vars"))


def judged(v: Views) -> DataFrame:
    return bd.evaluate_bids(bids(v), v.cases)


def _why_sql() -> str:
    """Explainability entries of a bid as lines."""
    tests = {"turnover": "NOT poor", "poor": "poor", "solvency": "old", "jv": "nojv", "claims": "n_unsupported > 0", "forms": "n_altered > 0",
             "high": "delta > 5", "low": "delta < -25"}
    pct = "FORMAT('{:.1f}', FLOOR(delta * 10 + 0.5) / 10)"
    out = []
    for key, test in tests.items():
        text = " | ".join(str(x).lower() if isinstance(x, bool) else str(x) for x in bd.REASONS[key]).replace("'", "''")
        for name, value in (("claims", "claims"), ("forms", "forms"), ("delta", pct)):
            text = text.replace("{" + name + "}", f"' || {value} || '")
        out.append(f"CASE WHEN {test} THEN '{text}' END")
    return f"CONCAT_WS(CHR(10), {', '.join(out)})"


@query("jn_25_bid_case_join", "SELECT bid_id, ROUND(delta, 6) AS delta, poor FROM {bid_facts}")
def jn_25(v: Views) -> DataFrame:
    j = judged(v)
    return rounded(j.select("bid_id", F.col("benchmark_delta_pct").alias("delta"), (F.size("disqualification_reasons") > 0).alias("poor")), 6, "delta")


@query("rul_15_bid_evaluation", """
  SELECT bid_id, flags, ARRAY_TO_STRING(missing, '; ') AS evidence_missing, CONCAT_WS('; ', CASE WHEN NOT poor THEN 'Average annual turnover meets 30% threshold' END,
      CASE WHEN NOT old THEN 'Solvency certificate within 6 months' END, CASE WHEN delta BETWEEN -25 AND 5 THEN 'Bid within benchmark band (−5%..+5%)' END) AS evidence_found,
    """ + _why_sql() + """ AS explainability, CONCAT_WS('; ', CASE WHEN n_missing > 0 THEN n_missing || ' required docs missing' ELSE 'OK' END,
      CASE WHEN poor OR nojv THEN 'Eligibility deficiencies detected' ELSE 'OK' END,
      CASE WHEN quality_plan AND safety_plan THEN 'OK' ELSE 'Quality / Safety plan deficiencies' END, CASE WHEN poor THEN 'Turnover below threshold' ELSE 'OK' END,
      CASE WHEN delta > 5 OR delta < -25 THEN 'Δ ' || FORMAT('{:.1f}', FLOOR(delta * 10 + 0.5) / 10) || '% vs benchmark' ELSE 'OK' END,
      CASE WHEN n_flags > 0 THEN n_flags || ' red flag(s)' ELSE 'OK' END, recommendation) AS notes, recommendation, CASE WHEN delta < -25 THEN ROUND(GREATEST(0.75e0 * benchmark_value - bid_amount, 0), 4) END AS additional_security,
    CASE WHEN delta > 5 THEN 'Moderate' WHEN delta < -25 THEN 'High' ELSE 'Low' END AS risk, CONCAT_WS(' ', CASE WHEN n_missing > 0 THEN 60 ELSE 100 END,
    CASE WHEN poor OR nojv THEN 55 ELSE 100 END, CASE WHEN quality_plan AND safety_plan THEN 100 WHEN technical_approach THEN 75 ELSE 40 END,
    CASE WHEN poor THEN 50 ELSE 100 END, CASE WHEN delta > 5 OR delta < -25 THEN 60 ELSE 100 END, CASE WHEN n_flags > 0 THEN 100 - LEAST(40, n_flags * 10) ELSE 100 END,
    CASE WHEN recommendation = 'Qualified' THEN 100 ELSE 70 END) AS scores FROM {judged}""")  # fmt: skip
def rul_15(v: Views) -> DataFrame:
    cells = lambda x: [x[f].cast("string") for f in bd.REASON_FIELDS]
    why = F.array_join(F.transform("explainability", lambda x: F.concat_ws(" | ", *cells(x))), "\n").alias("explainability")
    notes = F.array_join(F.transform("stages", lambda s: s["notes"]), "; ").alias("notes")
    joined = [F.array_join(c, "; ").alias(c) for c in ("evidence_missing", "evidence_found")]
    j = judged(v).select("bid_id", F.array_join("red_flags", "; ").alias("flags"), *joined, why, notes, "recommendation", "additional_security", F.col("reasonableness_risk").alias("risk"),
                         F.array_join(F.transform("stages", lambda s: s["score"].cast("string")), " ").alias("scores"))
    return rounded(j, 4, "additional_security")


@query("rul_16_bid_anomalies", """
  SELECT bid_id, CONCAT_WS(' ', CASE WHEN n_altered > 0 THEN 'altered_form:Critical' END, CASE WHEN n_unsupported > 0 THEN 'unsupported_claim:Moderate' END,
    CASE WHEN old THEN 'old_solvency:Moderate' END, CASE WHEN nojv THEN 'missing_jv:Critical' END) AS flags FROM {bid_facts}""")  # fmt: skip
def rul_16(v: Views) -> DataFrame:
    f = F.transform("flags", lambda x: F.concat(x["code"], F.lit(":"), x["severity"]))
    return bd.bid_anomalies(v.bids).select("bid_id", F.array_join(f, " ").alias("flags"))


@query("win_09_l1_rank", """
  SELECT bid_id, CASE WHEN recommendation = 'Qualified' THEN ROW_NUMBER() OVER (PARTITION BY case_id, recommendation ORDER BY bid_amount, bid_id) END AS l1_rank
  FROM {judged}""")  # fmt: skip
def win_09(v: Views) -> DataFrame:
    return bd.rank_bids(judged(v)).select("bid_id", "l1_rank")


@query("agg_58_flattened_reasons", """
  SELECT bid_id, company, UNNEST(LIST_FILTER([CASE WHEN old THEN 'Submit a solvency certificate issued within the last 6 months.' END,
    CASE WHEN nojv THEN 'Submit notarized JV agreement signed by all partners.' END,
    CASE WHEN n_unsupported > 0 THEN 'Submit completion certificate(s) for: ' || claims || '.' END], lambda x: x IS NOT NULL)) AS reason FROM {bid_facts}
  UNION ALL SELECT bid_id, company, 'Average annual turnover below 30% threshold' FROM {bid_facts} WHERE poor""")  # fmt: skip
def agg_58(v: Views) -> DataFrame:
    j = judged(v)
    return bd.flatten_reasons(j, "clarification_questions").unionByName(bd.flatten_reasons(j, "disqualification_reasons"))


def _issue_sql(key: str) -> str:
    """Columns of a detected issue."""
    out = []
    for name, text in zip(bd.ISSUE_FIELDS, bd.SECTION_ISSUES[key]):
        cell = "NULL" if text is None else "'" + text.replace("'", "''") + "'"
        for mark, value in (("title", "section_type"), ("id", "section_id"), ("variables", "ARRAY_TO_STRING(vars, ', ')"), ("first", "vars[1]")):
            cell = cell.replace("{" + mark + "}", f"' || {value} || '")
        out.append(f"{cell} AS {name}")
    return ", ".join(out)


CTES["found"] = f"""
  SELECT draft_id, case_id, section_type AS source_section, pos, section_id, {_issue_sql("engineering")}, FALSE AS auto_fixable, TRUE AS officer_decision
  FROM (SELECT *, {_list(VARIABLES, "n_missing_vars")} AS vars FROM {{sections}}) WHERE is_placeholder AND technical_approval
  UNION ALL SELECT draft_id, case_id, section_type, pos, section_id, {_issue_sql("variables")}, FALSE, TRUE
  FROM (SELECT *, {_list(VARIABLES, "n_missing_vars")} AS vars FROM {{sections}}) WHERE n_missing_vars > 0 AND NOT is_placeholder"""
CTES["merged"] = """
  SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY draft_id, category, source_section, description ORDER BY frame, pos, severity, auto_fixable, officer_decision, evidence) AS rn FROM (
    SELECT draft_id, category, description AS source_section, description, severity, auto_fixable, officer_decision, issue_id AS pos, 0 AS frame, NULL AS rule_id, NULL AS evidence,
      NULL AS suggested_fix, NULL AS impact FROM {issues}
    UNION ALL SELECT draft_id, category, source_section, description, severity, auto_fixable, officer_decision, pos, 1, rule_id, evidence, suggested_fix, impact FROM {found})) WHERE rn = 1"""
CTES["validated"] = """
  SELECT d.draft_id, COUNT(*) FILTER (WHERE severity = 'Critical') AS critical, COUNT(*) FILTER (WHERE severity = 'Moderate') AS moderate,
    COUNT(*) FILTER (WHERE severity = 'Minor') AS minor, COUNT(*) FILTER (WHERE auto_fixable) AS auto_fixable, COUNT(*) FILTER (WHERE officer_decision) AS officer_decisions
  FROM (SELECT DISTINCT draft_id FROM {sections}) d LEFT JOIN {merged} m ON d.draft_id = m.draft_id GROUP BY 1"""


def merged(v: Views, texts: bool = True) -> DataFrame:
    known = v.issues.select("draft_id", "category", F.col("description").alias("source_section"), "description", "severity", "auto_fixable", "officer_decision",
                            F.col("issue_id").alias("pos"))
    found = bd.detected_issues(sections(v)).drop("case_id").withColumn("pos", F.col("pos").cast("long"))
    # Counts need no texts.
    found = found if texts else found.drop("rule_id", "evidence", "suggested_fix", "impact")
    return bd.merged_issues(known, found, v.tasks("lineitem"))


@query("set_03_merged_issues", """
  SELECT draft_id, category, source_section, description, severity, auto_fixable, rule_id, evidence, suggested_fix, impact FROM {merged}""")  # fmt: skip
def set_03(v: Views) -> DataFrame:
    return merged(v).select("draft_id", "category", "source_section", "description", "severity", "auto_fixable", "rule_id", "evidence", "suggested_fix", "impact")


@query("rul_17_draft_validation", """
  SELECT *, GREATEST(0, 100 - critical * 14 - moderate * 6 - minor * 2) AS score, CASE WHEN critical > 0 THEN 'Not Ready' WHEN moderate > 0 THEN 'Needs Review'
    WHEN minor > 0 THEN 'Ready with Minor Issues' ELSE 'Ready' END AS readiness FROM {validated}""")  # fmt: skip
def rul_17(v: Views) -> DataFrame:
    return bd.validate_drafts(v.sections.select("draft_id").distinct(), merged(v, texts=False), v.tasks("lineitem"))


@query("arr_01_section_score_map", """
  SELECT draft_id, STRING_AGG(section_type || '=' || completion_score, ', ' ORDER BY section_type) AS scores FROM (SELECT *,
    ROW_NUMBER() OVER (PARTITION BY draft_id, section_type ORDER BY pos DESC, section_id DESC, completion_score DESC) AS rn FROM {sections}) WHERE rn = 1 GROUP BY 1""")  # fmt: skip
def arr_01(v: Views) -> DataFrame:
    m = bd.section_scores(v.sections)
    pairs = F.transform(F.map_entries("section_scores"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("draft_id", F.array_join(F.array_sort(pairs), ", ").alias("scores"))


@query("set_06_auto_fix", "SELECT issue_id, severity FROM {issues} WHERE issue_id NOT IN (SELECT issue_id FROM {issues} WHERE auto_fixable)")
def set_06(v: Views) -> DataFrame:
    return fl.without_ids(v.issues, v.issues.where("auto_fixable"), "issue_id").select("issue_id", "severity")


@query("agg_50_draft_summary", """
  SELECT draft_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE NOT is_placeholder AND approval_status NOT IN ('Required', 'Pending')) AS ready,
    COUNT(*) FILTER (WHERE is_placeholder) AS placeholder, COUNT(*) FILTER (WHERE source IN ('Rulebook', 'Template')) AS rulebook_derived,
    COUNT(*) FILTER (WHERE source = 'Historical Tender') AS historical_derived, COUNT(*) FILTER (WHERE source = 'Officer Input') AS officer_provided,
    COUNT(*) FILTER (WHERE technical_approval) AS technical_approval FROM {sections} GROUP BY 1""")  # fmt: skip
def agg_50(v: Views) -> DataFrame:
    return bd.draft_summary(v.sections)


_PLAN = ", ".join(f"({i}, '{t}', '{s}', {str(a).upper()}, {str(k).upper()})" for i, (t, s, a, k) in enumerate(bd.SECTION_PLAN))


@query("rul_22_section_plan", f"""
  SELECT case_id, pos, title, source, CASE WHEN technical AND stage <> 'Published' THEN 25 WHEN source = 'Placeholder' THEN 30 WHEN source = 'AI Suggestion' THEN 80
      WHEN source = 'Officer Input' THEN 92 ELSE 100 END AS completion_score, CASE WHEN technical AND stage <> 'Published' THEN 0.4e0 WHEN source = 'AI Suggestion' THEN 0.8e0
      ELSE 0.95e0 END AS confidence, CASE WHEN technical AND stage <> 'Published' THEN 'Critical' WHEN approval THEN 'Moderate' ELSE 'Low' END AS risk_level
  FROM {{cases}} CROSS JOIN (SELECT * FROM (VALUES {_PLAN}) p(pos, title, source, approval, technical))""")  # fmt: skip
def rul_22(v: Views) -> DataFrame:
    c = v.cases.withColumn("given", F.col("stage") == "Published")
    return bd.plan_sections(c, "given").select("case_id", "pos", "title", "source", "completion_score", "confidence", "risk_level")


@query("agg_51_corrigendum_impact", """
  SELECT corrigendum_id, case_id, COUNT(*) AS total_changes, COUNT(*) FILTER (WHERE propagated) AS fully_propagated, COUNT(*) FILTER (WHERE NOT propagated) AS pending_propagation
  FROM {changes} GROUP BY 1, 2""")  # fmt: skip
def agg_51(v: Views) -> DataFrame:
    return bd.corrigendum_impact(v.changes)


@query("agg_52_feedback_counters", """
  SELECT COUNT(*) FILTER (WHERE officer_action = 'accepted') AS accepted, COUNT(*) FILTER (WHERE officer_action = 'rejected') AS rejected,
    COUNT(*) FILTER (WHERE officer_action = 'edited') AS edited, COUNT(*) FILTER (WHERE officer_action = 'false_positive') AS false_positive FROM {approvals}""")  # fmt: skip
def agg_52(v: Views) -> DataFrame:
    return bd.feedback_counters(v.approvals)


@query("agg_53_grouped_categories", "SELECT category, COUNT(*) AS n, MIN(approval_id) AS first_id FROM {approvals} GROUP BY 1")
def agg_53(v: Views) -> DataFrame:
    return bd.grouped_counts(v.approvals.withColumn("id", F.col("approval_id")), "category")


CTES["ready"] = """
  SELECT c.case_id, COALESCE(s.n, 0) AS sections, COALESCE(s.gap, FALSE) AS gap, COALESCE(ch.clear, TRUE) AS clear, COALESCE(a.legal, FALSE) AS legal, COALESCE(a.finance, FALSE) AS finance,
    COALESCE(a.n, 0) AS approvals, COALESCE(a.pending, 0) AS pending, COALESCE(l.n, 0) AS audit_rows, t.case_id IS NOT NULL AS tech FROM {cases} c
  LEFT JOIN (SELECT case_id, COUNT(DISTINCT section_type) AS n, BOOL_OR(technical_approval AND is_placeholder) AS gap FROM {sections} GROUP BY 1) s ON c.case_id = s.case_id
  LEFT JOIN (SELECT case_id, BOOL_AND(propagated) AS clear FROM {changes} GROUP BY 1) ch ON c.case_id = ch.case_id
  LEFT JOIN (SELECT case_id, BOOL_OR(category = 'Legal' AND status = 'Approved') AS legal, BOOL_OR(category = 'Finance' AND status = 'Approved') AS finance, COUNT(*) AS n,
    COUNT(*) FILTER (WHERE status = 'Pending') AS pending FROM {approvals} GROUP BY 1) a ON c.case_id = a.case_id
  LEFT JOIN (SELECT case_id, COUNT(*) AS n FROM {audit_log} GROUP BY 1) l ON c.case_id = l.case_id
  LEFT JOIN (SELECT DISTINCT case_id FROM {approvals} WHERE category = 'Technical' AND status = 'Approved') t ON c.case_id = t.case_id"""


@query("rul_18_readiness", """
  SELECT case_id, CONCAT_WS(' ', CASE WHEN sections >= 5 THEN 'ok' ELSE 'fail' END, CASE WHEN tech OR NOT gap THEN 'ok' ELSE 'fail' END, CASE WHEN tech THEN 'ok' ELSE 'warn' END,
    'ok', 'ok', 'ok', CASE WHEN clear THEN 'ok' ELSE 'warn' END, CASE WHEN legal THEN 'ok' ELSE 'warn' END, CASE WHEN finance THEN 'ok' ELSE 'warn' END,
    CASE WHEN tech THEN 'ok' ELSE 'fail' END, CASE WHEN approvals > 0 AND pending = 0 THEN 'ok' ELSE 'warn' END, CASE WHEN audit_rows > 0 THEN 'ok' ELSE 'warn' END) AS statuses,
    NOT (sections >= 5 AND (tech OR NOT gap) AND tech) AS blocked FROM {ready}""")  # fmt: skip
def rul_18(v: Views) -> DataFrame:
    tech = v.approvals.where("category = 'Technical' AND status = 'Approved'")
    r = bd.readiness(v.cases, v.sections, v.changes, v.approvals, v.audit_log, tech, 5)
    flat = r.select("case_id", F.array_join(F.transform("items", lambda i: i["status"]), " ").alias("statuses"))
    return flat.join(bd.blockers(r).select("case_id", "blocked"), "case_id")


@query("agg_49_procurement_dashboard", """
  SELECT COUNT(*) AS cases, COUNT(*) FILTER (WHERE stage IN ('Drafting', 'Pre-RFP Validation')) AS draft_pending, COUNT(*) FILTER (WHERE stage = 'Bid Evaluation') AS bids_pending,
    COUNT(*) FILTER (WHERE compliance_score < 75) AS low_compliance, CAST(FLOOR(AVG(compliance_score) + 0.5) AS BIGINT) AS mean_readiness,
    COUNT(*) FILTER (WHERE case_id IN (SELECT case_id FROM {issues} WHERE severity = 'Critical')) AS blocked,
    (SELECT CAST(SUM(old::INT + nojv::INT + (n_unsupported > 0)::INT) AS BIGINT) FROM {bid_facts}) AS clarifications FROM {cases}""")  # fmt: skip
def agg_49(v: Views) -> DataFrame:
    return bd.dashboard(v.cases, v.issues, judged(v))


@query("jn_15_blocked_cases", "SELECT case_id FROM {cases} WHERE case_id IN (SELECT case_id FROM {issues} WHERE severity = 'Critical')")
def jn_15(v: Views) -> DataFrame:
    return v.cases.join(v.issues.where("severity = 'Critical'").select("case_id"), "case_id", "left_semi").select("case_id")


@query("flt_17_case_rows", """
  SELECT 'bid' AS kind, bid_id AS id FROM {bids} WHERE case_id = 41 UNION ALL SELECT 'issue', issue_id FROM {issues} WHERE case_id = 41""")  # fmt: skip
def flt_17(v: Views) -> DataFrame:
    b = fl.case_rows(v.bids, 41).select(F.lit("bid").alias("kind"), F.col("bid_id").alias("id"))
    return b.unionByName(fl.case_rows(v.issues, 41).select(F.lit("issue").alias("kind"), F.col("issue_id").alias("id")))


@query("set_09_rule_upsert", """
  SELECT p_partkey AS rule_id, CASE WHEN p_size > 25 THEN 'revised' ELSE 'base' END AS version, p_partkey <> 7 AS enabled FROM part""")  # fmt: skip
def set_09(v: Views) -> DataFrame:
    base = v.part.select(F.col("p_partkey").alias("rule_id"), F.lit("base").alias("version"), F.lit(True).alias("enabled"))
    new = v.part.where("p_size > 25").select(F.col("p_partkey").alias("rule_id"), F.lit("revised").alias("version"), F.lit(True).alias("enabled"))
    return bd.toggle_rule(snk.upsert(base, new, ["rule_id"], ["version"]), 7)


# --- graph ----------------------------------------------------------------------------


@query("flt_12_scope_filter", "SELECT id, type FROM {kg_edges} WHERE (case_id IS NULL OR case_id = 3) AND type = 'requires'")
def flt_12(v: Views) -> DataFrame:
    return fl.global_or_case(v.kg_edges, 3).where("type = 'requires'").select("id", "type")


@query("grf_01_case_subgraph", """
  SELECT 'node' AS kind, id FROM {kg_nodes} WHERE case_id IS NULL OR case_id = 3 UNION ALL SELECT 'edge', id FROM {kg_edges} WHERE case_id IS NULL OR case_id = 3""")  # fmt: skip
def grf_01(v: Views) -> DataFrame:
    n = fl.global_or_case(v.kg_nodes, 3).select(F.lit("node").alias("kind"), "id")
    return n.unionByName(fl.global_or_case(v.kg_edges, 3).select(F.lit("edge").alias("kind"), "id"))


@query("grf_02_edge_explorer", """
  SELECT e.id, a.label AS src_label, b.label AS dst_label FROM {kg_edges} e LEFT JOIN {kg_nodes} a ON e.src = a.id LEFT JOIN {kg_nodes} b ON e.dst = b.id
  WHERE e.type = 'requires'""")  # fmt: skip
def grf_02(v: Views) -> DataFrame:
    return bd.edges_with_labels(v.kg_edges, v.kg_nodes, "requires").select("id", "src_label", "dst_label")


@query("grf_03_nodes_by_type", "SELECT type, COUNT(*) AS n, MIN(id) AS first_id FROM {kg_nodes} GROUP BY 1")
def grf_03(v: Views) -> DataFrame:
    return bd.grouped_counts(v.kg_nodes, "type")

"""Bid evaluation, draft validation, readiness, corrigenda, approvals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.numbers import clamp, computed_once, half_up, kept
from tallyworks.functions.ranking import row_numbers
from tallyworks.functions.skew import HOT_ROWS
from tallyworks.functions.text import first_int, said
from tallyworks.operators.filters import first_wins

STAGES = (
    "Responsiveness", "Eligibility", "Technical qualification", "Financial qualification",
    "Commercial reasonableness", "Red flag and anomaly review", "Final recommendation",
)

# Decision, rule, evidence found, evidence missing ({claims}, {forms}, {delta} stand for values), section, confidence,
# officer approval, risk if ignored.
REASONS = {
    "turnover": ("Turnover meets threshold", "ec_turnover", "Audited statements 3 FY", "—", "Evaluation and Qualification Criteria", 0.96, False,
        "Eligibility may be wrongly granted otherwise."),
    "poor": ("Turnover insufficient", "ec_turnover", "Audited statements 3 FY", "—", "Evaluation and Qualification Criteria", 0.94, True,
        "Disqualification ought to be officer-confirmed."),
    "solvency": ("Solvency certificate too old", "ec_solvency", "FIN-10", "Recent solvency", "Evaluation and Qualification Criteria", 0.92, True,
        "Could disqualify bid; needs officer review."),
    "jv": ("JV agreement missing", "rule_005", "FIN-7", "JV Agreement", "Tender Forms", 0.93, True, "JV bid not legally enforceable without agreement."),
    "claims": ("Unsupported similar-work claim", "ec_similar", "Completion Certificate", "{claims}", "Evaluation and Qualification Criteria", 0.9, True,
        "Eligibility cannot be confirmed without evidence."),
    "forms": ("Altered forms detected", "rule_audit", "Form integrity check", "{forms}", "Tender Forms", 0.88, True,
        "Possible fraud — must be escalated to officer."),
    "high": ("Bid above benchmark", "rule_010", "Internal benchmark", "{delta}%", "Special Conditions of Contract", 0.95, True, "Cost overrun risk."),
    "low": ("Abnormally low bid", "rule_010", "Bid amount + benchmark", "Computed additional security", "Special Conditions of Contract", 0.96, True,
        "Performance risk; additional security required."),
}
REASON_FIELDS = ("decision", "rule_applied", "evidence_found", "evidence_missing", "source_section", "confidence", "officer_approval_required", "risk_if_ignored")


def old_solvency(age: str = "solvency_age") -> Column:
    """A certificate of more than six months."""
    return F.contains(age, F.lit("month")) & F.coalesce(first_int(age, leading=True) > 6, F.lit(False))


def evaluate_bids(bids: DataFrame, cases: DataFrame) -> DataFrame:
    """Thresholds, flags, delta, security, recommendation and stage scores per bid (RUL-15, JN-25).

    Bids carry the lists missing_documents, unsupported_claims and altered_forms (null: empty).  Cases are unique
    rows with estimated_value and benchmark_value.
    """
    c = F.col
    lists = ("missing_documents", "unsupported_claims", "altered_forms")
    bids = bids.withColumns({x: F.coalesce(x, F.array().cast("array<string>")) for x in lists})
    j = bids.join(cases.select("case_id", "estimated_value", "benchmark_value"), "case_id")
    d = j.withColumns(
        {
            "benchmark_delta_pct": (c("bid_amount") - c("benchmark_value")) / F.nullif("benchmark_value", F.lit(0.0)) * 100,
            "_poor": c("turnover") < c("estimated_value") * 0.3,
            "_nojv": F.contains(F.lower("jv_status"), F.lit("missing")),
            "_old": old_solvency(),
            "_claims": F.array_join("unsupported_claims", "; "),
            "_forms": F.array_join("altered_forms", "; "),
        }
    )
    d = computed_once(d)
    n_missing, claimed, altered = F.size("missing_documents"), F.size("unsupported_claims") > 0, F.size("altered_forms") > 0
    delta = c("benchmark_delta_pct")
    high, low = delta > 5, delta < -25
    pct = F.format_string("%.1f", half_up(delta, 1))
    shown = {"claims": c("_claims"), "forms": c("_forms"), "delta": pct}

    def reason(key: str) -> Column:
        cells = (said(x, shown) if isinstance(x, str) else F.lit(x) for x in REASONS[key])
        return F.struct(*[x.alias(f) for f, x in zip(REASON_FIELDS, cells)])

    d = d.withColumns(
        {
            "red_flags": kept(
                F.when(c("_old"), F.lit("Solvency certificate older than allowed 6 months")),
                F.when(c("_nojv"), F.lit("Missing notarized JV agreement")),
                F.when(claimed, F.lit("Unsupported similar-work claim")),
                F.when(altered, F.lit("Altered/forged form detected")),
                F.when(high, F.concat(F.lit("Bid amount "), pct, F.lit("% above internal benchmark"))).when(
                    low, F.concat(F.lit("Abnormally low bid ("), pct, F.lit("% below benchmark)"))),
            ),
            "evidence_found": kept(
                F.when(~c("_poor"), F.lit("Average annual turnover meets 30% threshold")),
                F.when(~c("_old"), F.lit("Solvency certificate within 6 months")),
                F.when(~(high | low), F.lit("Bid within benchmark band (−5%..+5%)")),
            ),
            "clarification_questions": kept(
                F.when(c("_old"), F.lit("Submit a solvency certificate issued within the last 6 months.")),
                F.when(c("_nojv"), F.lit("Submit notarized JV agreement signed by all partners.")),
                F.when(claimed, F.concat(F.lit("Submit completion certificate(s) for: "), c("_claims"), F.lit("."))),
            ),
            "disqualification_reasons": kept(F.when(c("_poor"), F.lit("Average annual turnover below 30% threshold"))),
            "evidence_missing": c("missing_documents"),
            "explainability": kept(
                F.when(~c("_poor"), reason("turnover")).otherwise(reason("poor")),
                F.when(c("_old"), reason("solvency")),
                F.when(c("_nojv"), reason("jv")),
                F.when(claimed, reason("claims")),
                F.when(altered, reason("forms")),
                F.when(high, reason("high")).when(low, reason("low")),
            ),
            "additional_security": F.when(low, F.greatest(0.75 * c("benchmark_value") - c("bid_amount"), F.lit(0.0))),
            "reasonableness_risk": F.when(high, "Moderate").when(low, "High").otherwise("Low"),
        }
    )
    d = d.withColumn(
        "recommendation",
        F.when(c("_poor"), "Disqualified")
        .when((F.size("red_flags") == 0) & (n_missing == 0), "Qualified")
        .otherwise("Needs Clarification"),
    )
    d = computed_once(d)
    flags = F.size("red_flags")
    weak_plan = ~c("quality_plan") | ~c("safety_plan")
    approach = c("technical_approach")
    good = c("recommendation") == "Qualified"
    # stage: (problem, passed when there is one, its score, its note)
    facts: Sequence[tuple[Column, Column, Column, Column]] = (
        (n_missing > 0, F.lit(False), F.lit(60), F.concat(n_missing.cast("string"), F.lit(" required docs missing"))),
        (c("_poor") | c("_nojv"), F.lit(False), F.lit(55), F.lit("Eligibility deficiencies detected")),
        (weak_plan, approach, F.when(approach, 75).otherwise(40), F.lit("Quality / Safety plan deficiencies")),
        (c("_poor"), F.lit(False), F.lit(50), F.lit("Turnover below threshold")),
        (high | low, F.lit(False), F.lit(60), F.concat(F.lit("Δ "), pct, F.lit("% vs benchmark"))),
        (flags > 0, F.lit(False), 100 - F.least(F.lit(40), flags * 10), F.concat(flags.cast("string"), F.lit(" red flag(s)"))),
        (~good, F.lit(False), F.lit(70), c("recommendation")),
    )
    stages = [
        F.struct(
            F.lit(name).alias("stage"),
            F.when(bad, passed).otherwise(True).alias("passed"),
            F.when(bad, score).otherwise(100).alias("score"),
            F.when(bad, note).otherwise("Qualified" if name == STAGES[-1] else "OK").alias("notes"),
        )
        for name, (bad, passed, score, note) in zip(STAGES, facts)
    ]
    return d.withColumn("stages", F.array(*stages)).drop("_poor", "_nojv", "_old", "_claims", "_forms")


def score_map(stages: str = "stages") -> Column:
    """Score by stage, without the final recommendation."""
    return F.map_from_entries(F.transform(F.slice(stages, 1, 6), lambda s: F.struct(s["stage"], s["score"])))


def rank_bids(evaluated: DataFrame, hot: int = HOT_ROWS) -> DataFrame:
    """L1 rank of qualified bids per case by amount (WIN-09)."""
    q = evaluated.where(F.col("recommendation").isin("Qualified", "Award Recommended")).select("case_id", "bid_id", "bid_amount")
    r = row_numbers(q, ["case_id"], ["bid_amount", "bid_id"], "l1_rank", hot).select("bid_id", "l1_rank")
    return evaluated.join(r, "bid_id", "left")


def bid_anomalies(bids: DataFrame) -> DataFrame:
    """Anomaly flags per bid (RUL-16)."""
    c = F.col

    def flag(code: str, severity: str) -> Column:
        return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))

    return bids.withColumn(
        "flags",
        kept(
            F.when(c("n_altered") > 0, flag("altered_form", "Critical")),
            F.when(c("n_unsupported") > 0, flag("unsupported_claim", "Moderate")),
            F.when(old_solvency(), flag("old_solvency", "Moderate")),
            F.when(F.contains(F.lower("jv_status"), F.lit("missing")), flag("missing_jv", "Critical")),
        ),
    )


def flatten_reasons(evaluated: DataFrame, col: str) -> DataFrame:
    """One row per reason or question (AGG-58)."""
    return evaluated.select("bid_id", "company", F.explode(col).alias("reason"))


# --- drafts ---------------------------------------------------------------------------


# Rule, category, severity, description, evidence, suggested fix, impact of the issues seen in sections.
SECTION_ISSUES = {
    "engineering": ("rule_002", "Engineering content not approved", "Critical",
        "{title} is a placeholder; project-specific engineering content not provided.",
        "Section {id} source = Placeholder; technicalApprovalRequired = true",
        "Upload approved {title} or select an approved historical template; assign to Technical Officer.",
        "Tender cannot be published; engineering disputes during execution."),
    "variables": (None, "Placeholder values", "Moderate",
        "{title} contains placeholder variable(s): {variables}.",
        "Section {id} missingVariables = [{variables}]",
        "Officer to provide values for {first}.",
        "Bidder confusion; possible contract dispute."),
}
ISSUE_FIELDS = ("rule_id", "category", "severity", "description", "evidence", "suggested_fix", "impact")


def detected_issues(sections: DataFrame, title: str = "section_type") -> DataFrame:
    """Issues seen in the sections of drafts: unapproved placeholders and open variables (RUL-17).

    Sections carry the list missing_variables (null: empty).
    """
    c = F.col
    names = F.coalesce("missing_variables", F.array().cast("array<string>"))
    shown = {"title": c(title), "id": c("section_id").cast("string"), "variables": F.array_join(names, ", "), "first": F.get(names, F.lit(0))}

    def issue(key: str) -> Column:
        return F.struct(*[said(x, shown).alias(f) for f, x in zip(ISSUE_FIELDS, SECTION_ISSUES[key])])

    found = kept(
        F.when(c("is_placeholder") & c("technical_approval"), issue("engineering")),
        F.when((F.size(names) > 0) & ~c("is_placeholder"), issue("variables")),
    )
    rows = sections.select("draft_id", "case_id", c("section_type").alias("source_section"), "pos", F.explode(found).alias("i"))
    decided = (F.lit(False).alias("auto_fixable"), F.lit(True).alias("officer_decision"))
    return rows.select("draft_id", "case_id", "source_section", "pos", "i.*", *decided)


def merged_issues(known: DataFrame, detected: DataFrame, tasks: int | None = None) -> DataFrame:
    """Known issues first, then detected ones, one per category, section and text (SET-03).

    Columns that one side lacks (rule, evidence, fix, impact) are null there.
    """
    keys = ["draft_id", "category", "source_section", "description"]
    ties = [c for c in ("evidence",) if c in detected.columns]
    return first_wins([known, detected], keys, ["pos", "severity", "auto_fixable", "officer_decision", *ties], tasks)


def validate_drafts(drafts: DataFrame, issues: DataFrame, tasks: int | None = None) -> DataFrame:
    """Severity counts, score and readiness per draft (RUL-17); with ``tasks`` given, drafts are dealt over so many."""
    n = issues.groupBy("draft_id").agg(
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("Critical", "Moderate", "Minor")],
        F.count_if("auto_fixable").alias("auto_fixable"),
        F.count_if("officer_decision").alias("officer_decisions"),
    )
    if tasks is not None:
        drafts, n = drafts.repartition(tasks, "draft_id"), n.repartition(tasks, "draft_id")
    d = drafts.join(n, "draft_id", "left").fillna(0, ["critical", "moderate", "minor", "auto_fixable", "officer_decisions"])
    c = F.col
    return d.withColumns(
        {
            "score": clamp(100 - c("critical") * 14 - c("moderate") * 6 - c("minor") * 2, 0),
            "readiness": F.when(c("critical") > 0, "Not Ready")
            .when(c("moderate") > 0, "Needs Review")
            .when(c("minor") > 0, "Ready with Minor Issues")
            .otherwise("Ready"),
        }
    )


def section_scores(sections: DataFrame) -> DataFrame:
    """Map of section title to completion per draft; the last section of a title wins (RUL-17).

    max_by per (draft, title) first: the map has one entry per title.
    """
    last = sections.groupBy("draft_id", "section_type").agg(F.max_by("completion_score", F.struct("pos", "section_id", "completion_score")).alias("s"))
    return last.groupBy("draft_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section_type", "s")))).alias("section_scores"))


def draft_summary(sections: DataFrame) -> DataFrame:
    """Seven counters per draft (AGG-50)."""
    c = F.col
    open_ = c("approval_status").isin("Required", "Pending")
    return sections.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~c("is_placeholder") & ~open_).alias("ready"),
        F.count_if("is_placeholder").alias("placeholder"),
        F.count_if(c("source").isin("Rulebook", "Template")).alias("rulebook_derived"),
        F.count_if(c("source") == "Historical Tender").alias("historical_derived"),
        F.count_if(c("source") == "Officer Input").alias("officer_provided"),
        F.count_if("technical_approval").alias("technical_approval"),
    )


# Section plan (title, source, needs approval, technical).
SECTION_PLAN = (
    ("Cover Page", "Template", False, False),
    ("Invitation to Tender", "Rulebook", False, False),
    ("Instructions to Tenderers (ITT)", "Rulebook", False, False),
    ("Tender Data Sheet (TDS)", "Officer Input", False, False),
    ("Evaluation and Qualification Criteria", "Historical Tender", True, False),
    ("Tender Forms Checklist", "Template", False, False),
    ("Schedule of Payments", "Template", False, False),
    ("Scope of Work", "Officer Input", False, False),
    ("Technical Specifications", "Placeholder", True, True),
    ("Design Criteria", "Placeholder", True, True),
    ("General Requirements", "Template", False, False),
    ("General Conditions of Contract (GCC)", "Rulebook", False, False),
    ("Special Conditions of Contract (SCC)", "AI Suggestion", True, False),
    ("Contract Forms", "Template", False, False),
)
COMPLETION = {"Placeholder": 30, "AI Suggestion": 80, "Officer Input": 92}


def plan_sections(cases: DataFrame, technical_input: str) -> DataFrame:
    """Fourteen planned sections per case (RUL-22); the plan is a literal unpacked per row."""
    given = F.coalesce(technical_input, F.lit(False))
    rows = []
    for i, (title, source, approval, technical) in enumerate(SECTION_PLAN):
        lacking = ~given & F.lit(technical)
        rows.append(
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(title).alias("title"),
                F.lit(source).alias("source"),
                F.when(lacking, 25).otherwise(COMPLETION.get(source, 100)).alias("completion_score"),
                F.when(lacking, 0.4).otherwise(0.8 if source == "AI Suggestion" else 0.95).alias("confidence"),
                F.when(lacking, "Critical").otherwise("Moderate" if approval else "Low").alias("risk_level"),
                F.lit("Required" if approval else "Not Required").alias("approval_status"),
                F.lit(source == "Placeholder").alias("is_placeholder"),
            )
        )
    return cases.select("case_id", F.inline(F.array(*rows)))


# --- readiness, corrigenda, approvals ------------------------------------------------


def corrigendum_impact(changes: DataFrame) -> DataFrame:
    """Totals per corrigendum (AGG-51)."""
    return changes.groupBy("corrigendum_id", "case_id").agg(
        F.count(F.lit(1)).alias("total_changes"),
        F.count_if("propagated").alias("fully_propagated"),
        F.count_if(~F.col("propagated")).alias("pending_propagation"),
    )


def feedback_counters(approvals: DataFrame) -> DataFrame:
    """Officer actions (AGG-52)."""
    a = F.col("officer_action")
    return approvals.agg(
        *[F.count_if(a == x).alias(x) for x in ("accepted", "rejected", "edited", "false_positive")]
    )


def grouped_counts(df: DataFrame, key: str) -> DataFrame:
    """Rows and smallest id per category (AGG-53, GRF-03)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def readiness(
    cases: DataFrame, sections: DataFrame, changes: DataFrame, approvals: DataFrame, audit: DataFrame, technical: DataFrame,
    least_sections: int = 12,
) -> DataFrame:
    """Twelve checklist rows per case (RUL-18, ARR-01).

    Each fact is reduced to one row per case before the join.  ``technical``
    holds the case ids whose technical input is approved.
    """
    c = F.col
    s = sections.groupBy("case_id").agg(
        F.countDistinct("section_type").alias("sections"), F.bool_or(c("technical_approval") & c("is_placeholder")).alias("tech_gap"))
    ch = changes.groupBy("case_id").agg(F.bool_and("propagated").alias("clear"), F.count(F.lit(1)).alias("changes"))
    legal, finance, pending = c("category") == "Legal", c("category") == "Finance", c("status") == "Pending"
    ap = approvals.groupBy("case_id").agg(
        F.bool_or(legal & (c("status") == "Approved")).alias("legal"), F.bool_or(finance & (c("status") == "Approved")).alias("finance"),
        F.count(F.lit(1)).alias("approvals"), F.count_if(pending).alias("pending"))
    au = audit.groupBy("case_id").agg(F.count(F.lit(1)).alias("audit_rows"))
    t = technical.select("case_id").distinct().withColumn("tech", F.lit(True))
    j = cases.select("case_id")
    for side in (s, ch, ap, au, t):
        j = j.join(side, "case_id", "left")
    yes = F.coalesce("tech", F.lit(False))

    def row(label: str, ok: Column, otherwise: str) -> Column:
        return F.struct(F.lit(label).alias("label"), F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise(otherwise).alias("status"))

    always = F.lit(True)
    rows = [
        row("Mandatory sections complete", c("sections") >= least_sections, "fail"),
        row("Technical inputs uploaded", yes | ~F.coalesce("tech_gap", F.lit(False)), "fail"),
        row("Design criteria approved", yes, "warn"),
        row("Required clauses present", always, "fail"),
        row("Financial thresholds checked", always, "fail"),
        row("Eligibility criteria mapped to forms", always, "fail"),
        row("Corrigendum status clear", F.coalesce("clear", F.lit(True)), "warn"),
        row("Legal review complete", c("legal"), "warn"),
        row("Finance review complete", c("finance"), "warn"),
        row("Technical review complete", yes, "fail"),
        row("Officer approval complete", (c("approvals") > 0) & (c("pending") == 0), "warn"),
        row("Audit trail complete", c("audit_rows") > 0, "warn"),
    ]
    return j.select("case_id", F.array(*rows).alias("items"))


def blockers(ready: DataFrame) -> DataFrame:
    """Blocked flag and the failing labels of each case (RUL-18)."""
    bad = F.transform(F.filter("items", lambda i: i["status"] == "fail"), lambda i: i["label"])
    return ready.select("case_id", bad.alias("reasons"), (F.size(bad) > 0).alias("blocked"))


def dashboard(cases: DataFrame, issues: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Procurement counters (AGG-49, JN-15)."""
    blocked = cases.join(issues.where("severity = 'Critical'").select("case_id"), "case_id", "left_semi")
    score = F.avg("compliance_score")
    return cases.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("stage").isin("Drafting", "Pre-RFP Validation")).alias("draft_pending"),
        F.count_if(F.col("stage") == "Bid Evaluation").alias("bids_pending"),
        F.count_if(F.col("compliance_score") < 75).alias("low_compliance"),
        F.coalesce(F.floor(score + 0.5), F.lit(0)).alias("mean_readiness"),
    ).withColumns(
        {
            "blocked": blocked.agg(F.count(F.lit(1))).scalar(),
            "clarifications": evaluated.agg(F.sum(F.size("clarification_questions"))).scalar(),
        }
    )


def toggle_rule(rules: DataFrame, rule_id: object, key: str = "rule_id") -> DataFrame:
    """Flip one rule's enabled flag (SET-09)."""
    return rules.withColumn("enabled", F.when(F.col(key) == rule_id, ~F.col("enabled")).otherwise(F.col("enabled")))


def edges_with_labels(edges: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """Edges of one relation with the labels of both ends (GRF-02).

    A hub node may be an end of a third of all edges; node ids are unique, so
    the joins add no rows and a hub is split by the adaptive skew join.
    """
    e = edges if kind is None else edges.where(F.col("type") == kind)
    n1 = nodes.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
    n2 = nodes.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    return e.join(n1, "src", "left").join(n2, "dst", "left")

"""Caseload metrics, role filters, routing and state transitions of applications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.dates import whole_days
from tallyworks.functions.skew import BROADCAST_ROWS, HOT_ROWS, spread_lookup

APPROVED = ("approved", "construction_monitoring_active", "occupancy_review")


def _is(*statuses: str) -> Column:
    return F.col("status").isin(*statuses)


def state_metrics(apps: DataFrame, detections: DataFrame) -> DataFrame:
    """Nine counters and the mean approval days (AGG-41)."""
    days = F.datediff("approved_at", "submitted_at")
    bad = detections.agg(F.count_if(F.col("match_status") != "matches_approval")).scalar()
    return apps.agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col("outcome").isNotNull()).alias("auto_scrutinized"),
        F.count_if(_is(*APPROVED)).alias("approved"),
        F.count_if(_is("correction_requested") | (F.coalesce("outcome", F.lit("")) == "needs_correction")).alias("correction_required"),
        F.count_if(_is("field_inspection_assigned")).alias("inspections_pending"),
        F.sum(F.coalesce("fee_paid", F.lit(0.0))).alias("fee_collected"),
        F.count_if(F.size("fee_warnings") > 0).alias("fee_mismatch"),
        F.coalesce(F.floor(F.avg(days) + 0.5), F.lit(0)).alias("mean_approval_days"),
    ).withColumn("violations", bad)


def two_facts(apps: DataFrame, detections: DataFrame, key_a: Column, key_d: Column) -> DataFrame:
    """Applications and violations per key, from two facts in one aggregate (AGG-42)."""
    a = apps.select(key_a.alias("k"), F.lit(1).alias("a"), F.lit(0).alias("v"))
    bad = (F.col("match_status") != "matches_approval").cast("int")
    d = detections.select(key_d.alias("k"), F.lit(0).alias("a"), bad.alias("v"))
    return a.unionByName(d).groupBy("k").agg(F.sum("a").alias("applications"), F.sum("v").alias("violations"))


def by_district(apps: DataFrame, detections: DataFrame) -> DataFrame:
    """Districts with an application or a violation (AGG-42)."""
    t = two_facts(apps, detections, F.coalesce("district", F.lit("Unknown")), F.col("district"))
    return t.where((F.col("applications") > 0) | (F.col("violations") > 0)).withColumnRenamed("k", "district")


def place() -> Column:
    return F.coalesce("ulb", "village", F.lit("Unallocated"))


def by_place(apps: DataFrame, detections: DataFrame) -> DataFrame:
    """The same by ULB or village (AGG-43)."""
    return two_facts(apps, detections, place(), place()).withColumnRenamed("k", "place")


def high_risk(districts: DataFrame) -> DataFrame:
    """Districts with violations; more than one is high (AGG-44)."""
    v = F.col("violations")
    text = F.concat(v.cast("string"), F.when(v == 1, " violation detected").otherwise(" violations detected"))
    return districts.where(v > 0).select("district", text.alias("reason"), F.when(v > 1, "high").otherwise("medium").alias("severity"))


def queue_counters(apps: DataFrame, as_of: Column, sla_days: int = 21) -> DataFrame:
    """Officer queue (AGG-45)."""
    o = F.coalesce("outcome", F.lit(""))
    late = (whole_days("submitted_at", as_of) > sla_days) & ~_is("approved", "closed", "rejected")
    return apps.agg(
        F.count_if(_is("submitted", "auto_scrutiny_completed")).alias("new_applications"),
        F.count_if(o == "auto_pass_eligible").alias("auto_pass"),
        F.count_if(_is("correction_requested") | (o == "needs_correction")).alias("correction"),
        F.count_if(late).alias("sla_breach"),
        F.count_if(_is("field_inspection_assigned")).alias("field_visits_due"),
        F.count_if(o == "reject_recommendation").alias("possible_violations"),
        F.sum(F.coalesce("pending", F.lit(0.0))).alias("fees_pending"),
    )


def citizen_counters(apps: DataFrame) -> DataFrame:
    """Applications by family of status (AGG-46)."""
    return apps.agg(
        F.count_if(_is("draft")).alias("draft"),
        F.count_if(_is("submitted", "auto_scrutiny_completed", "officer_review_pending", "field_inspection_assigned")).alias("in_review"),
        F.count_if(_is(*APPROVED, "closed")).alias("approved"),
        F.count_if(_is("correction_requested")).alias("corrections"),
    )


def revenue(apps: DataFrame) -> DataFrame:
    """Fees assessed, paid, pending, mismatches and the split by type (AGG-47)."""
    t = F.col("type")
    return apps.agg(
        F.sum(F.coalesce("total_fee", F.lit(0.0))).alias("assessed"),
        F.sum(F.coalesce("fee_paid", F.lit(0.0))).alias("paid"),
        F.count_if(F.size("fee_warnings") > 0).alias("mismatch"),
        F.count_if(t == "building_permission").alias("building"),
        F.count_if((t == "building_permission") & _is(*APPROVED)).alias("building_approved"),
        F.count_if(t == "layout_permission").alias("layout"),
        F.count_if(t == "occupancy_certificate").alias("occupancy"),
        F.count_if(t == "renovation_addition").alias("renovation"),
    ).withColumn("pending", F.col("assessed") - F.col("paid"))


def fees_by_district(apps: DataFrame) -> DataFrame:
    return apps.groupBy(F.coalesce("district", F.lit("Unknown")).alias("district")).agg(
        F.sum(F.coalesce("fee_paid", F.lit(0.0))).alias("fees")
    )


def count_by(df: DataFrame, key: Column, name: str) -> DataFrame:
    """Rows per bucket (AGG-48)."""
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def unmatched(detections: DataFrame) -> DataFrame:
    """Detections that do not match an approval (FLT-15)."""
    return detections.where(F.col("match_status") != "matches_approval")


def visible_to(apps: DataFrame, role: str, user_mail_part: str | None = None) -> DataFrame:
    """Applications a role may see (FLT-08)."""
    inside = F.coalesce("inside_ulb", F.lit(False))
    flagged = (
        (F.coalesce("outcome", F.lit("")) == "needs_technical_review")
        | (F.size("why_escalated") > 0)
        | (F.col("type") == "layout_permission")
        | F.coalesce("is_high_rise", F.lit(False))
        | (F.coalesce("building_use", F.lit("")) == "commercial")
    )
    rule = {
        "ulb_officer": inside,
        "panchayat_secretary": ~inside & F.col("village").isNotNull(),
        "dtcp_reviewer": flagged,
        "field_inspector": _is("field_inspection_assigned", "construction_monitoring_active"),
    }.get(role)
    if role in ("citizen", "architect") and user_mail_part is not None:
        rule = F.contains(F.lower("email"), F.lit(user_mail_part))
    return apps if rule is None else apps.where(rule)


def alerts_for(alerts: DataFrame, role: str) -> DataFrame:
    """Alerts assigned to a role; the state admin sees all (FLT-08)."""
    return alerts if role == "state_admin" else alerts.where(F.col("assigned_role") == role)


def first_officer(officers: DataFrame, role: str, key: str) -> DataFrame:
    """First officer of a role per jurisdiction, in list order."""
    return (
        officers.where((F.col("role") == role) & F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min_by("officer_id", "ord").alias("officer_id"))
    )


def route(
    apps: DataFrame, officers: DataFrame, row: Sequence[str] = ("id",), hot: int = HOT_ROWS, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Officer by ULB, else by village; new status; escalation flag (JN-20, RUL-23).

    The officer tables hold one row per jurisdiction.  Applications outside of any ULB, and those of a large one, do not
    meet in one task: ``spread_lookup`` deals them over all tasks by ``row``.
    """
    ulb = first_officer(officers, "ulb_officer", "ulb").withColumnRenamed("officer_id", "_u")
    vil = first_officer(officers, "panchayat_secretary", "village").withColumnRenamed("officer_id", "_v")
    reviewer = officers.where("role = 'dtcp_reviewer'").agg(F.min_by("officer_id", "ord")).scalar()
    j = spread_lookup(spread_lookup(apps, ulb, "ulb", row, hot, limit), vil, "village", row, hot, limit)
    by_ulb = F.coalesce("inside_ulb", F.lit(False)) & F.col("ulb").isNotNull()
    officer = F.when(by_ulb, F.col("_u")).otherwise(F.col("_v"))
    escalate = (
        F.coalesce("is_high_rise", F.lit(False))
        | (F.coalesce("building_use", F.lit("")) == "commercial")
        | (F.col("type") == "layout_permission")
        | (F.coalesce("outcome", F.lit("")) == "needs_technical_review")
    )
    return j.withColumns(
        {
            "assigned_officer": officer,
            "status": F.when(officer.isNotNull(), "officer_review_pending").otherwise(F.col("status")),
            "reviewer": F.when(escalate, reviewer),
        }
    ).drop("_u", "_v")


def routing_alerts(routed: DataFrame) -> DataFrame:
    """Alert rows of escalated applications (RUL-23)."""
    return routed.where(F.col("reviewer").isNotNull()).select(
        F.lit("manual_review_required").alias("kind"), F.lit("medium").alias("severity"), F.lit("dtcp_reviewer").alias("assigned_role"),
        F.col("reviewer").alias("assigned_user"), F.col("id").alias("application_id"),
        F.concat("id", F.lit(" flagged for DTCP scrutiny.")).alias("body"))


# Command, new status, audit action, alert kind and severity.
COMMANDS = (
    ("submit", "auto_scrutiny_completed", "Application submitted for scrutiny", None, None),
    ("correct", "correction_requested", "Correction requested", "missing_document", "medium"),
    ("approve", "approved", "Preliminary approval issued", "approval_ready", "low"),
    ("reject", "rejected", "Application rejected", None, None),
    ("inspect", "field_inspection_assigned", "Field inspection assigned", "field_inspection_assigned", "medium"),
)


def apply_commands(apps: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batch of state changes: (applications, audit rows, alert rows) (SNK-12).

    commands: id, seq, command, at, by_role, remarks.  The last command of an
    application sets its status; every command leaves an audit row.  Unknown
    applications are ignored.
    """
    c = F.col("command")
    closed = (c == "approve") & (F.col("type") == "occupancy_certificate")
    new = action = kind = sev = None
    for name, status, text, alert, severity in COMMANDS:
        hit = c == name
        new = F.when(hit, status) if new is None else new.when(hit, status)
        action = F.when(hit, text) if action is None else action.when(hit, text)
        kind = F.when(hit, F.lit(alert)) if kind is None else kind.when(hit, F.lit(alert))
        sev = F.when(hit, F.lit(severity)) if sev is None else sev.when(hit, F.lit(severity))
    known = commands.join(apps.select("id", "type", F.col("applicant_type").alias("_at")), "id")
    audit = known.select("id", "seq", "at", "by_role", "remarks", action.alias("action"), new.alias("status_to"))
    to = F.when(c.isin("submit", "correct", "approve"), F.when(c == "submit", F.lit(None)).otherwise(
        F.when((c == "approve") & (F.col("_at") == "architect"), "architect").otherwise("citizen"))).otherwise("field_inspector")
    alerts = known.where(kind.isNotNull()).select("id", "seq", kind.alias("kind"), sev.alias("severity"), to.alias("assigned_role"))
    last = known.groupBy("id").agg(
        F.max_by(F.struct(F.when(closed, "closed").otherwise(new).alias("status"), "remarks"), "seq").alias("_l"),
        F.max(F.when(c == "approve", F.col("at"))).alias("_approved"),
    )
    out = (
        apps.join(last, "id", "left")
        .withColumns(
            {
                "status": F.coalesce("_l.status", "status"),
                "approved_at": F.coalesce("_approved", "approved_at"),
                "remarks": F.col("_l.remarks"),
            }
        )
        .drop("_l", "_approved")
    )
    return out, audit, alerts

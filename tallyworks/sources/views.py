"""Logical tables as views over the driver's tables.

Each view is one portable SELECT.  Spark runs it through ``spark.sql`` with
DataFrame parameters; the check queries use the same text as a common table
expression, so both sides start from the same rows.  Derived attributes come
from keys and measures by plain arithmetic, on every row of the table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Newest day of the retail, bid and permit facts, and of the event facts.
AS_OF = "2001-08-01"
EVENTS_AS_OF = "2024-01-30"

# Rows of a base table that one task of costly row-wise work gets at most.
TASK_ROWS = 50_000

VIEWS: dict[str, str] = {
    # --- retail
    "outlets": """
        SELECT CAST(c_custkey AS STRING) AS outlet_code, c_name AS outlet_name, n_name AS district,
          r_name AS depot_code, c_mktsegment || '-' || CAST(n_regionkey AS STRING) AS circle,
          c_mktsegment AS vendor_type,
          CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 10 + (c_custkey % 900) / 100e0 END AS lat,
          CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 70 + (c_custkey % 1300) / 100e0 END AS lng
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "sales": """
        SELECT d.*, o.district, o.depot_code, o.circle, o.vendor_type FROM (
          SELECT CAST(o_custkey AS STRING) AS outlet_code, CAST(o_orderdate AS DATE) AS date,
            CAST(SUM(CAST(FLOOR(o_totalprice / 10000) AS BIGINT)) AS BIGINT) AS cases,
            CAST(SUM(CAST(FLOOR(o_totalprice) AS BIGINT) % 12) AS BIGINT) AS bottles,
            CAST(SUM(CAST(FLOOR(o_totalprice / 10000) AS BIGINT) * 12) AS BIGINT) AS total_bottles,
            CAST(SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS DOUBLE) AS sale_value
          FROM {orders} GROUP BY o_custkey, CAST(o_orderdate AS DATE)) d
        LEFT JOIN {outlets} o ON d.outlet_code = o.outlet_code""",
    "products": """
        SELECT CAST(p_partkey AS STRING) AS product_code, p_brand AS brand_code, p_brand AS brand_name,
          p_type AS brand_type, p_size * 20 AS size_ml, ROUND((p_retailprice - 900) * 20) AS mrp,
          SUBSTRING(p_name, POSITION(' ' IN p_name) + 1) AS category, CAST(sk AS STRING) AS supplier_code,
          n_name AS distillery, CASE WHEN s_acctbal < 0 THEN 'Local' WHEN s_acctbal < 5000 THEN 'Regional'
            ELSE 'National' END AS supplier_type
        FROM {part} LEFT JOIN (SELECT l_partkey, MIN(l_suppkey) AS sk FROM {lineitem} GROUP BY l_partkey) m
          ON p_partkey = l_partkey LEFT JOIN {supplier} ON sk = s_suppkey
          LEFT JOIN {nation} ON s_nationkey = n_nationkey""",
    "label_approvals": """
        SELECT CAST(event_id AS STRING) AS application_no, CAST(ts AS DATE) AS approval_date,
          CASE WHEN event_type = 'signup' THEN 'New Label' WHEN event_type = 'purchase' THEN 'RENEWAL'
            WHEN event_type = 'view' THEN 'Renewal of New Label' ELSE 'Amendment' END AS label_category,
          CASE WHEN user_id % 17 = 0 THEN NULL ELSE 'NATION_' || CAST(user_id % 25 AS STRING) END AS distillery,
          'Brand#' || CAST(CAST(FLOOR(value) AS BIGINT) % 25 + 1 AS STRING) AS brand_name,
          CAST(FLOOR(value) AS INT) % 9 * 100 + 50 AS size_ml, value AS mrp, event_type AS category
        FROM {events}""",
    # --- permits
    "apps": """
        SELECT a.*, CASE WHEN status IN ('approved', 'construction_monitoring_active', 'closed')
            THEN submitted_at + CAST(k % 45 + 1 AS INT) END AS approved_at,
          CASE WHEN use_key IS NULL THEN 'residential' ELSE use_key END AS building_use
        FROM (SELECT o_orderkey AS k, 'APP-' || CAST(o_orderkey AS STRING) AS id, o_custkey AS cust, n_name AS district,
          CASE o_orderpriority WHEN '2-HIGH' THEN 'layout_permission' WHEN '3-MEDIUM' THEN 'occupancy_certificate'
            WHEN '4-NOT SPECIFIED' THEN 'renovation_addition' ELSE 'building_permission' END AS type,
          CASE o_orderkey % 11 WHEN 0 THEN 'draft' WHEN 1 THEN 'submitted' WHEN 2 THEN 'auto_scrutiny_completed'
            WHEN 3 THEN 'officer_review_pending' WHEN 4 THEN 'field_inspection_assigned' WHEN 5 THEN 'approved'
            WHEN 6 THEN 'construction_monitoring_active' WHEN 7 THEN 'occupancy_review' WHEN 8 THEN 'closed'
            WHEN 9 THEN 'rejected' ELSE 'correction_requested' END AS status,
          CASE WHEN o_orderkey % 3 = 0 THEN 'architect' ELSE 'citizen' END AS applicant_type,
          CASE c_mktsegment WHEN 'MACHINERY' THEN 'industrial' WHEN 'AUTOMOBILE' THEN 'commercial'
            WHEN 'FURNITURE' THEN 'mixed_use' WHEN 'HOUSEHOLD' THEN 'institutional' END AS use_key,
          CASE WHEN o_custkey % 3 = 0 THEN 'ULB-' || CAST(o_custkey % 40 AS STRING) END AS ulb,
          CASE WHEN o_custkey % 4 <> 0 THEN 'V-' || CAST(o_custkey % 60 AS STRING) END AS village,
          o_custkey % 3 = 0 AS inside_ulb, CAST(o_orderdate AS DATE) AS submitted_at,
          o_totalprice / 1000 AS plot_area, o_totalprice / (300 + o_orderkey % 500) AS built_up_area,
          CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 1000 * (1 + (o_orderkey % 5) / 40e0) END AS geom_area,
          4e0 + o_orderkey % 28 AS height, CAST(1 + o_orderkey % 9 AS INT) AS floors,
          1 + (o_orderkey % 12) * 0.5e0 AS front_setback, 0.5e0 + (o_orderkey % 9) * 0.5e0 AS rear_setback,
          0.5e0 + (o_orderkey % 7) * 0.5e0 AS left_setback, 0.5e0 + (o_orderkey % 8) * 0.5e0 AS right_setback,
          20e0 + o_orderkey % 60 AS ground_coverage, CAST(o_orderkey % 25 AS INT) AS parking,
          4e0 + o_orderkey % 14 AS road_width, o_orderkey % 3 <> 0 AS rainwater, o_orderkey % 4 <> 0 AS solar,
          o_orderkey % 19 <> 0 AS has_boundary, o_orderkey % 23 = 0 AS road_gis_missing,
          CAST(o_orderkey % 40 AS INT) AS plots, 6e0 + o_orderkey % 8 AS internal_road, 5e0 + o_orderkey % 12 AS open_space,
          o_orderkey % 5 <> 0 AS drainage, o_orderkey % 6 <> 0 AS water, o_orderkey % 7 <> 0 AS lighting,
          6e0 + o_orderkey % 6 AS approach_road, o_totalprice AS fee_paid, o_totalprice AS layout_area
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey) a""",
    "detections": """
        SELECT l_orderkey * 10 + l_linenumber AS id, n_name AS district,
          CASE WHEN l_suppkey % 3 = 0 THEN 'ULB-' || CAST(l_suppkey % 40 AS STRING) END AS ulb,
          'V-' || CAST(l_suppkey % 60 AS STRING) AS village,
          CASE l_returnflag WHEN 'N' THEN 'matches_approval' WHEN 'A' THEN 'deviation_detected'
            ELSE 'no_approval_found' END AS match_status,
          CASE l_linestatus WHEN 'F' THEN 'high' ELSE 'medium' END AS alert_severity,
          l_quantity * 10 AS detected_area, 1 - l_discount AS confidence
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey""",
    "officers": """
        SELECT 'OFF-' || CAST(s_suppkey AS STRING) AS officer_id, s_suppkey AS ord, s_name AS officer_name,
          CASE s_suppkey % 4 WHEN 0 THEN 'ulb_officer' WHEN 1 THEN 'panchayat_secretary' WHEN 2 THEN 'field_inspector'
            ELSE 'dtcp_reviewer' END AS role,
          CASE WHEN s_suppkey % 4 = 0 THEN 'ULB-' || CAST(s_suppkey % 40 AS STRING) END AS ulb,
          CASE WHEN s_suppkey % 4 = 1 THEN 'V-' || CAST(s_suppkey % 60 AS STRING) END AS village, n_name AS district
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    # --- documents
    "docs": """
        SELECT CAST(doc_id AS STRING) AS document_id, doc_id, source AS source_id, 'T-' || source AS tender_id, text, lang,
          'notice_' || CAST(doc_id AS STRING) || '.pdf' AS file_name, n_chars * 8 AS file_size_bytes, source AS reference_number,
          CASE lang WHEN 'en' THEN 'Tender_Document' WHEN 'de' THEN 'Corrigendum' WHEN 'fr' THEN 'BOQ' END AS suggested_type,
          CASE WHEN n_chars < 300 THEN 'failed' ELSE 'ok' END AS status, n_chars,
          CAST(FLOOR(n_chars / 1800e0) AS INT) AS page_count
        FROM {documents}""",
    "compliance_log": """
        SELECT event_id AS id, ts AS at, 'R-' || CAST(CAST(ts AS DATE) AS STRING) AS run_id,
          'src' || CAST(user_id % 20 AS STRING) AS source_id,
          CASE WHEN event_type = 'error' THEN 'SKIP' ELSE 'ALLOW' END AS decision,
          CASE WHEN event_type <> 'error' THEN NULL WHEN value < 20 THEN 'tripwire_phrase' WHEN value < 60
            THEN 'robots_disallow' ELSE 'blocked_path' END AS rule_triggered, event_type, user_id, value
        FROM {events}""",
    "vectors": """
        SELECT vec_id AS chunk_id, label AS tender_id, label % 3 AS source_id,
          CASE WHEN vec_id % 2 = 0 THEN 'Scope_of_Work' ELSE 'BOQ' END AS classified_type, embedding
        FROM {embeddings}""",
    # --- procurement
    "cases": """
        SELECT c_custkey AS case_id, n_name AS department, c_mktsegment AS category,
          100000e0 + c_acctbal * 20 AS estimated_value, 230000e0 + c_acctbal * 5 AS benchmark_value,
          CAST(c_custkey % 101 AS INT) AS compliance_score,
          CASE c_custkey % 4 WHEN 0 THEN 'Draft' WHEN 1 THEN 'Approval Pending' WHEN 2 THEN 'Published'
            ELSE 'Evaluation' END AS stage
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "bids": """
        SELECT o_orderkey AS bid_id, o_custkey AS case_id, 'Vendor ' || CAST(o_orderkey AS STRING) AS company,
          o_totalprice AS bid_amount, o_totalprice / (2 + o_orderkey % 9) AS turnover,
          CASE WHEN o_orderkey % 10 = 3 THEN '1 year' ELSE CAST(o_orderkey % 12 AS STRING) || ' months' END AS solvency_age,
          CASE WHEN o_orderkey % 7 = 0 THEN 'Agreement MISSING' ELSE 'Notarized' END AS jv_status,
          o_orderkey % 5 <> 0 AS quality_plan, o_orderkey % 6 <> 0 AS safety_plan, o_orderkey % 4 <> 0 AS technical_approach,
          CAST(o_orderkey % 3 AS INT) AS n_missing, CASE WHEN o_orderkey % 8 = 0 THEN 2 ELSE 0 END AS n_unsupported,
          CASE WHEN o_orderkey % 31 = 0 THEN 1 ELSE 0 END AS n_altered
        FROM {orders}""",
    "sections": """
        SELECT l_orderkey AS draft_id, o_custkey AS case_id, l_linenumber AS pos, l_partkey AS section_id,
          CASE l_linenumber WHEN 1 THEN 'Cover Page' WHEN 2 THEN 'Scope of Work' WHEN 3 THEN 'Technical Specifications'
            WHEN 4 THEN 'Design Criteria' WHEN 5 THEN 'Tender Forms' WHEN 6 THEN 'Contract Forms'
            ELSE 'General Requirements' END AS section_type,
          CASE WHEN l_discount > 0.08 THEN 'Placeholder' WHEN l_discount > 0.06 THEN 'Historical Tender'
            WHEN l_discount > 0.04 THEN 'Officer Input' WHEN l_discount > 0.02 THEN 'Rulebook' ELSE 'Template' END AS source,
          CASE l_returnflag WHEN 'A' THEN 'Required' WHEN 'R' THEN 'Pending' ELSE 'Not Required' END AS approval_status,
          l_discount > 0.08 AS is_placeholder, l_linestatus = 'F' AS technical_approval,
          CASE WHEN l_tax > 0.06 THEN 2 WHEN l_tax > 0.04 THEN 1 ELSE 0 END AS n_missing_vars,
          CAST(l_quantity * 2 AS INT) AS completion_score
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "issues": """
        SELECT l_orderkey * 10 + l_linenumber AS issue_id, l_orderkey AS draft_id, o_custkey AS case_id,
          CASE WHEN l_quantity < 10 THEN 'Critical' WHEN l_quantity < 25 THEN 'Moderate' ELSE 'Minor' END AS severity,
          'Clause ' || CAST(l_linenumber % 3 AS STRING) AS category, 'Finding ' || CAST(l_suppkey % 3 AS STRING) AS description,
          l_tax < 0.04 AS auto_fixable, l_tax > 0.02 AS officer_decision
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""",
    "changes": """
        SELECT l_orderkey AS corrigendum_id, o_custkey AS case_id, l_linenumber AS pos, 'Item ' || CAST(l_linenumber AS STRING) AS item,
          CASE l_returnflag WHEN 'A' THEN 'Critical' WHEN 'R' THEN 'Moderate' ELSE 'Low' END AS risk, l_linestatus = 'F' AS propagated
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "approvals": """
        SELECT event_id AS approval_id, user_id AS case_id, ts AS at,
          CASE event_type WHEN 'click' THEN 'Legal' WHEN 'view' THEN 'Finance' ELSE 'Technical' END AS category,
          CASE WHEN value < 30 THEN 'Pending' WHEN value < 90 THEN 'Approved' ELSE 'Rejected' END AS status,
          CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'rejected' WHEN 'signup' THEN 'edited'
            WHEN 'error' THEN 'false_positive' ELSE 'other' END AS officer_action
        FROM {events}""",
    "audit_log": """
        SELECT event_id AS id, ts AS at, user_id AS case_id, event_type AS module, value,
          'User ' || CAST(user_id AS STRING) AS actor
        FROM {events}""",
    "kg_nodes": """
        SELECT 'S' || CAST(s_suppkey AS STRING) AS id, s_name AS label, 'Supplier' AS type,
          CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_nationkey END AS case_id FROM {supplier}
        UNION ALL SELECT 'N' || CAST(n_nationkey AS STRING), n_name, 'Department', NULL FROM {nation}
        UNION ALL SELECT 'P' || CAST(p_partkey AS STRING), p_name, 'Item', NULL FROM {part}""",
    "kg_edges": """
        SELECT 'E' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS id, 'P' || CAST(l_partkey AS STRING) AS src,
          'S' || CAST(l_suppkey AS STRING) AS dst, CASE WHEN (l_partkey + l_suppkey) % 3 = 0 THEN 'requires' ELSE 'supplies' END AS type,
          CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_suppkey % 25 AS INT) END AS case_id
        FROM {lineitem} GROUP BY l_partkey, l_suppkey""",
}

_NAME = re.compile(r"\{(\w+)\}")


class Views:
    """Driver tables and logical views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def spread(self, *tables: str) -> Views:
        """Deal base tables whose splits are fewer than their tasks, so that a larger table has more tasks, not longer ones.

        For row-wise work that costs far more than a shuffle of its input, such
        as text scans.  A table of many splits is left as it is.
        """
        for t in tables:
            df, n = getattr(self, t), self.tasks(t)
            if df.rdd.getNumPartitions() < n:
                self._made[t] = df.repartition(n)
        return self

    def tasks(self, table: str) -> int:
        """Tasks for all rows of a base table, counted from the file's own row counts: one per core, at most TASK_ROWS each."""
        return max(self.spark.sparkContext.defaultParallelism, -(-getattr(self, table).count() // TASK_ROWS))

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        made = self._made
        if name not in made:
            if name in TABLES:
                made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name in VIEWS:
                text = VIEWS[name]
                made[name] = self.spark.sql(text, **{n: getattr(self, n) for n in set(_NAME.findall(text))})
            else:
                raise AttributeError(name)
        return made[name]


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the views it names in braces, as common table expressions."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for n in _NAME.findall(text):
            if n in known and n not in order:
                visit(known[n])
                order.append(n)

    visit(body)
    plain = lambda s: _NAME.sub(r"\1", s)
    ctes = ", ".join(f"{n} AS ({plain(known[n])})" for n in order)
    return f"WITH {ctes} {plain(body)}" if ctes else plain(body)

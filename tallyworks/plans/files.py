"""Round trips through files, and column helpers on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.functions import dates, numbers, text
from tallyworks.operators import geo
from tallyworks.operators import models
from tallyworks.operators import similarity as sim
from tallyworks.plans.registry import query, rounded
from tallyworks.plans.spatial import districts
from tallyworks.session import new_path
from tallyworks.sinks import tables as snk
from tallyworks.sources import readers
from tallyworks.sources.views import Views


@query("src_02_read_sheet", "SELECT CAST(c_custkey AS VARCHAR) AS outlet_code, c_name AS outlet_name, c_acctbal AS balance FROM customer")
def src_02(v: Views) -> DataFrame:
    path = new_path(v.spark, "sheet")
    v.customer.select(F.col("c_custkey").alias("Code"), F.col("c_name").alias("Name"), F.col("c_acctbal").alias("Balance")).write.option("header", True).csv(path)
    return readers.read_sheet(v.spark, path, "Code string, Name string, Balance double", {"Code": "outlet_code", "Name": "outlet_name", "Balance": "balance"})


@query("src_03_read_manifest", """
  SELECT document_id, tender_id, COALESCE(suggested_type, 'Unknown') AS document_type, CASE WHEN status = 'ok' THEN page_count ELSE 0 END AS relevance_score FROM {docs}""")  # fmt: skip
def src_03(v: Views) -> DataFrame:
    path = new_path(v.spark, "manifest")
    rows = v.docs.select("document_id", "tender_id", F.col("suggested_type").alias("document_type"), F.when(F.col("status") == "ok", F.col("page_count")).alias("relevance_score"))
    rows.write.json(path)
    return readers.read_manifest(v.spark, path).select("document_id", "tender_id", "document_type", "relevance_score")


@query("src_09_read_geojson", """
  SELECT n_name AS district, 1 AS parts, 5 AS corners, ROUND(70 + (n_nationkey % 5) * 2.5e0, 6) AS x0 FROM nation""")  # fmt: skip
def src_09(v: Views) -> DataFrame:
    path = new_path(v.spark, "layer")
    ring = F.transform(F.col("polygons")[0][0], lambda p: F.array(p["x"], p["y"], F.lit(0.0)))
    feature = F.struct(
        F.lit("Feature").alias("type"), F.create_map(F.lit("NEW_DISTRI"), F.upper("district")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    # A layer file is one document; the nations are a fixed dimension.
    layer = districts(v).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value"))
    layer.coalesce(1).write.text(path)
    got = readers.read_geojson(v.spark, path, {"district": "district"}, {"district": "NEW_DISTRI"})
    got = got.select(F.upper("district").alias("district"), F.size("polygons").alias("parts"), F.size(F.col("polygons")[0][0]).alias("corners"),
                     geo.bbox("polygons")["x0"].alias("x0"))
    return rounded(got, 6, "x0")


@query("snk_01_write_parquet", "SELECT outlet_code, district, lat FROM {outlets}")
def snk_01(v: Views) -> DataFrame:
    path = new_path(v.spark, "outlets")
    snk.write_parquet(v.outlets.select("outlet_code", "lat", "district"), path, ["district"])
    return readers.read_table(v.spark, path, "outlet_code string, lat double, district string")


@query("snk_04_write_json", "SELECT bid_id, company, CASE WHEN bid_amount < 100000 THEN NULL ELSE bid_amount END AS amount FROM {bids}")
def snk_04(v: Views) -> DataFrame:
    path = new_path(v.spark, "bids")
    x = F.when(F.col("bid_amount") < 100000, float("nan")).otherwise(F.col("bid_amount"))
    snk.write_json(v.bids.select("bid_id", "company", x.alias("amount")), path)
    return v.spark.read.schema("bid_id long, company string, amount double").json(path)


@query("snk_09_append_log", "SELECT decision, COUNT(*) AS n FROM {compliance_log} GROUP BY 1")
def snk_09(v: Views) -> DataFrame:
    path = new_path(v.spark, "log")
    for part in ("decision = 'SKIP'", "decision = 'ALLOW'"):
        snk.append_log(v.compliance_log.where(part), path)
    return v.spark.read.schema("decision string").parquet(path).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("win_12_unique_names", """
  SELECT s_suppkey AS cluster_id, CASE WHEN n = 1 THEN base ELSE base || ' ' || n END AS segment FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY base ORDER BY s_suppkey) AS n
    FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Volatile — Tighter Replenishment' ELSE 'Steady Mid-Tier' END AS base FROM supplier))""")  # fmt: skip
def win_12(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    zero = F.lit(0.0)
    c = v.supplier.select(k.alias("cluster_id"), zero.alias("avg_daily_value"), zero.alias("growth_30d"), F.when(k % 2 == 0, 0.9).otherwise(0.0).alias("volatility"),
                          zero.alias("active_days"))
    return models.name_clusters(c)


@query("win_13_chunk_offsets", "SELECT doc_id, 0 AS misplaced FROM documents")
def win_13(v: Views) -> DataFrame:
    """The text at a chunk's offset begins with the chunk's first characters, and chunks without an offset occur nowhere."""
    c = sim.chunks(v.documents, "doc_id", "text", 400).select("doc_id", "char_offset", F.substring("text", 1, 40).alias("head"))
    j = c.join(v.documents.select("doc_id", F.col("text").alias("whole")), "doc_id")
    there = F.substring("whole", F.col("char_offset") + 1, F.length("head"))
    wrong = F.when(F.col("char_offset") < 0, F.instr("whole", F.col("head")) > 0).otherwise(there != F.col("head"))
    return j.groupBy("doc_id").agg(F.count_if(wrong).cast("int").alias("misplaced"))


@query("str_04_depot_name", "SELECT s_suppkey, 'Depot & ' || s_name AS depot FROM supplier")
def str_04(v: Views) -> DataFrame:
    raw = F.concat(F.lit(" "), (F.col("s_suppkey") % 90 + 10).cast("string"), F.lit("- Depot &amp;  "), "s_name")
    return v.supplier.select("s_suppkey", text.strip_depot(raw).alias("depot"))


@query("dat_02_month_bucket", "SELECT strftime(o_orderdate, '%Y-%m') AS ym, COUNT(*) AS n FROM orders GROUP BY 1")
def dat_02(v: Views) -> DataFrame:
    return v.orders.groupBy(dates.month("o_orderdate").alias("ym")).agg(F.count(F.lit(1)).alias("n"))


@query("dat_04_weekend_flag", "SELECT isodow(o_orderdate) >= 6 AS weekend, COUNT(*) AS n FROM orders GROUP BY 1")
def dat_04(v: Views) -> DataFrame:
    return v.orders.groupBy(dates.is_weekend("o_orderdate").alias("weekend")).agg(F.count(F.lit(1)).alias("n"))


@query("mth_01_clamp", "SELECT c_custkey, GREATEST(0, LEAST(5000, c_acctbal)) AS v FROM customer")
def mth_01(v: Views) -> DataFrame:
    return v.customer.select("c_custkey", numbers.clamp("c_acctbal", 0.0, 5000.0).alias("v"))


@query("mth_03_half_even", "SELECT p_partkey, ROUND_EVEN(p_size / 4 * 10, 0) / 10 AS one, ROUND_EVEN(p_size / 2, 0) AS whole FROM part")
def mth_03(v: Views) -> DataFrame:
    return v.part.select("p_partkey", numbers.half_even(F.col("p_size") / 4, 1).alias("one"), numbers.half_even(F.col("p_size") / 2).alias("whole"))


@query("arr_02_kept_reasons", """
  SELECT bid_id, CONCAT_WS(',', CASE WHEN n_missing > 0 THEN 'missing' END, CASE WHEN n_altered > 0 THEN 'altered' END, CASE WHEN NOT quality_plan THEN 'plan' END) AS reasons
  FROM {bids}""")  # fmt: skip
def arr_02(v: Views) -> DataFrame:
    r = numbers.kept(F.when(F.col("n_missing") > 0, F.lit("missing")), F.when(F.col("n_altered") > 0, F.lit("altered")), F.when(~F.col("quality_plan"), F.lit("plan")))
    return v.bids.select("bid_id", F.array_join(r, ",").alias("reasons"))


@query("map_02_best_key", """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_tax <= l_discount AND l_tax <= l_quantity / 100 THEN 'tax' WHEN l_discount <= l_quantity / 100 THEN 'discount'
    ELSE 'quantity' END AS best FROM lineitem""")  # fmt: skip
def map_02(v: Views) -> DataFrame:
    best = numbers.best_key({"tax": F.col("l_tax"), "discount": F.col("l_discount"), "quantity": F.col("l_quantity") / 100})
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", best.alias("best"))

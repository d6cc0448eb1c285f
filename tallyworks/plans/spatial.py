"""Spatial queries: plots and districts are rectangles derived from keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyworks.operators import geo
from tallyworks.plans.registry import CTES, query, rounded
from tallyworks.sources.views import Views

_R = geo.EARTH_M

# Districts overlap a little, so that the layer order matters.
CTES["dist"] = """
  SELECT n_nationkey AS ord, n_name AS district, 70 + (n_nationkey % 5) * 2.5e0 AS x0, 10 + CAST(FLOOR(n_nationkey / 5) AS INTEGER) * 1.75e0 AS y0,
    70 + (n_nationkey % 5) * 2.5e0 + 2.625e0 AS x1, 10 + CAST(FLOOR(n_nationkey / 5) AS INTEGER) * 1.75e0 + 1.5e0 AS y1 FROM nation"""
CTES["ulb"] = """
  SELECT s_suppkey AS ord, 'ULB-' || s_suppkey AS ulb, 'NATION_' || s_nationkey AS district, 70 + (s_suppkey % 50) * 0.25e0 AS x0, 10 + (s_suppkey % 37) * 0.25e0 AS y0,
    70 + (s_suppkey % 50) * 0.25e0 + 0.125e0 AS x1, 10 + (s_suppkey % 37) * 0.25e0 + 0.375e0 AS y1 FROM supplier"""
CTES["plot"] = """
  SELECT c_custkey AS id, 70 + (c_custkey % 1300) / 100e0 AS x0, 10 + (c_custkey % 900) / 100e0 AS y0, 70 + (c_custkey % 1300) / 100e0 + 0.5e0 AS x1,
    10 + (c_custkey % 900) / 100e0 + 0.25e0 AS y1 FROM customer"""
CTES["pts"] = "SELECT outlet_code, lng, lat FROM {outlets} WHERE lat IS NOT NULL"
CTES["road"] = """
  SELECT p_partkey AS ord, 'Road ' || p_partkey AS name, p_size::DOUBLE AS width_m, 70 + (p_partkey % 130) / 10e0 AS x0, 10 + (p_partkey % 90) / 10e0 AS y0,
    70 + (p_partkey % 130) / 10e0 + 0.05e0 AS x1, 10 + (p_partkey % 90) / 10e0 AS y1 FROM part"""
CTES["seg"] = """
  SELECT outlet_code, ord, name, width_m, lng, lat, x0 + LEAST(1, GREATEST(0, (lng - x0) / (x1 - x0))) * (x1 - x0) AS fx, y0 AS fy
  FROM {pts} JOIN {road} ON lat BETWEEN y0 - 0.01 AND y0 + 0.01 AND lng BETWEEN x0 - 0.01 AND x1 + 0.01"""
CTES["dists"] = f"""
  SELECT *, 2 * {_R!r} * ATAN2(SQRT(h), SQRT(1 - h)) AS distance_m FROM (SELECT *, POW(SIN(RADIANS(fy - lat) / 2), 2) + COS(RADIANS(lat)) * COS(RADIANS(fy)) *
    POW(SIN(RADIANS(fx - lng) / 2), 2) AS h FROM {{seg}})"""


def _box(df: DataFrame, x0, y0, w: float, h: float) -> DataFrame:
    return df.withColumn("polygons", geo.rectangle(x0, y0, x0 + w, y0 + h))


def districts(v: Views) -> DataFrame:
    k = F.col("n_nationkey")
    n = v.nation.select(k.alias("layer_order"), F.col("n_name").alias("district"), k)
    return _box(n, 70 + (k % 5) * 2.5, 10 + F.floor(k / 5) * 1.75, 2.625, 1.5).drop("n_nationkey")


def ulbs(v: Views) -> DataFrame:
    k = F.col("s_suppkey")
    s = v.supplier.select(k.alias("layer_order"), F.concat(F.lit("ULB-"), k.cast("string")).alias("ulb"),
                          F.concat(F.lit("NATION_"), F.col("s_nationkey").cast("string")).alias("district"), k)
    return _box(s, 70 + (k % 50) * 0.25, 10 + (k % 37) * 0.25, 0.125, 0.375).drop("s_suppkey")


def plots(v: Views) -> DataFrame:
    k = F.col("c_custkey")
    return _box(v.customer.select(k.alias("id"), k), 70 + (k % 1300) / 100, 10 + (k % 900) / 100, 0.5, 0.25).drop("c_custkey")


def points(v: Views) -> DataFrame:
    return v.outlets.select("outlet_code", "lng", "lat")


@query("geo_01_area_centroid_bbox", f"""
  SELECT id, ROUND(RADIANS(x1 - x0) * (SIN(RADIANS(y1)) - SIN(RADIANS(y0))) * {_R!r} * {_R!r}, 1) AS area_sqm, ROUND((x0 + x1) / 2, 6) AS cx, ROUND((y0 + y1) / 2, 6) AS cy,
    ROUND(x0, 6) AS x0, ROUND(y1, 6) AS y1 FROM {{plot}}""")  # fmt: skip
def geo_01(v: Views) -> DataFrame:
    p = plots(v).select("id", geo.area("polygons").alias("area_sqm"), geo.centroid("polygons").alias("c"), geo.bbox("polygons").alias("b"))
    p = p.select("id", "area_sqm", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.col("b.x0").alias("x0"), F.col("b.y1").alias("y1"))
    return rounded(rounded(p, 1, "area_sqm"), 6, "cx", "cy", "x0", "y1")


@query("geo_02_closed_ring", "SELECT c_custkey AS id, 3 + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS n FROM customer")
def geo_02(v: Views) -> DataFrame:
    k = F.col("c_custkey").cast("double")
    last = F.when(F.col("c_custkey") % 2 == 0, geo.point(k + 1, F.lit(1.0))).otherwise(geo.point(k, F.lit(0.0)))
    ring = F.array(geo.point(k, F.lit(0.0)), geo.point(k + 1, F.lit(0.0)), last)
    return v.customer.select(F.col("c_custkey").alias("id"), F.size(geo.closed_ring(ring)).alias("n"))


@query("geo_03_point_in_polygon", """
  SELECT outlet_code, ARG_MIN(district, ord) AS district FROM {pts} JOIN {dist} ON lng BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY 1""")  # fmt: skip
def geo_03(v: Views) -> DataFrame:
    return geo.point_in_polygon(points(v), districts(v), "outlet_code", "district")


@query("jn_21_spatial_join", """
  SELECT ulb, COUNT(*) AS n FROM (SELECT outlet_code, ARG_MIN(ulb, ord) AS ulb FROM {pts} JOIN {ulb} ON lng BETWEEN x0 AND x1 AND lat BETWEEN y0 AND y1 GROUP BY 1) GROUP BY 1""")  # fmt: skip
def jn_21(v: Views) -> DataFrame:
    h = geo.point_in_polygon(points(v), ulbs(v), "outlet_code", "ulb", size=0.125)
    return h.groupBy("ulb").agg(F.count(F.lit(1)).alias("n"))


CTES["common"] = f"""
  SELECT p.id, d.ord, d.district, RADIANS(LEAST(p.x1, d.x1) - GREATEST(p.x0, d.x0)) * (SIN(RADIANS(LEAST(p.y1, d.y1))) - SIN(RADIANS(GREATEST(p.y0, d.y0)))) * {_R!r} * {_R!r} AS a,
    RADIANS(p.x1 - p.x0) * (SIN(RADIANS(p.y1)) - SIN(RADIANS(p.y0))) * {_R!r} * {_R!r} AS whole
  FROM {{plot}} p JOIN {{dist}} d ON p.x0 < d.x1 AND d.x0 < p.x1 AND p.y0 < d.y1 AND d.y0 < p.y1"""
CTES["overlap"] = """
  SELECT id, district, a, a >= whole * 0.999 AS fully_inside FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY ROUND(a, 0) DESC, ord) AS rn FROM {common} WHERE a > 1e-3) WHERE rn = 1"""


@query("geo_04_largest_overlap", "SELECT id, ROUND(a / 1e6, 4) AS overlap_km2, fully_inside FROM {overlap}")
def geo_04(v: Views) -> DataFrame:
    o = geo.largest_overlap(plots(v), districts(v), "id", "district")
    return rounded(o.select("id", (F.col("overlap_sqm") / 1e6).alias("overlap_km2"), "fully_inside"), 4, "overlap_km2")


@query("jn_22_overlap_join", "SELECT fully_inside, COUNT(*) AS n FROM {overlap} GROUP BY 1")
def jn_22(v: Views) -> DataFrame:
    return geo.largest_overlap(plots(v), districts(v), "id", "district").groupBy("fully_inside").agg(F.count(F.lit(1)).alias("n"))


CTES["nearest"] = """
  SELECT outlet_code, ARG_MIN(name, distance_m * 1e6 + ord / 1e6) AS name, MIN(distance_m) AS distance_m FROM {dists} WHERE distance_m <= 800 GROUP BY 1"""


def roads(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    x0, y0 = 70 + (k % 130) / 10, 10 + (k % 90) / 10
    line = F.array(geo.point(x0, y0), geo.point(x0 + 0.025, y0), geo.point(x0 + 0.05, y0))
    return v.part.select(k.alias("layer_order"), F.concat(F.lit("Road "), k.cast("string")).alias("name"), F.col("p_size").cast("double").alias("width_m"), line.alias("line"))


@query("geo_05_nearest_road", "SELECT outlet_code, ROUND(distance_m, 3) AS distance_m FROM {nearest}")
def geo_05(v: Views) -> DataFrame:
    n = geo.nearest_line(points(v), roads(v), "outlet_code", "name", "width_m", buffer_m=800.0)
    return rounded(n.select("outlet_code", "distance_m"), 3, "distance_m")


@query("jn_23_nearest_join", "SELECT COUNT(*) AS found, ROUND(AVG(distance_m), 3) AS mean_m FROM {nearest}")
def jn_23(v: Views) -> DataFrame:
    n = geo.nearest_line(points(v), roads(v), "outlet_code", "name", buffer_m=800.0)
    return rounded(n.agg(F.count(F.lit(1)).alias("found"), F.avg("distance_m").alias("mean_m")), 3, "mean_m")


CTES["ctr"] = "SELECT id, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM {plot}"


@query("geo_06_jurisdiction", """
  SELECT c.id, u.ulb, COALESCE(u.district, d.district) AS district, d.district AS village, u.ulb IS NOT NULL AS inside_ulb,
    CASE WHEN u.ulb IS NOT NULL THEN 'ulb_officer' WHEN d.district IS NOT NULL THEN 'panchayat_secretary' ELSE 'manual_verification' END AS sanctioning_authority,
    NOT COALESCE(o.fully_inside, FALSE) AS uncertain FROM {ctr} c
  LEFT JOIN (SELECT id, ARG_MIN(ulb, ord) AS ulb, ARG_MIN(district, ord) AS district FROM {ctr} JOIN {ulb} ON cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY 1) u ON c.id = u.id
  LEFT JOIN (SELECT id, ARG_MIN(district, ord) AS district FROM {ctr} JOIN {dist} ON cx BETWEEN x0 AND x1 AND cy BETWEEN y0 AND y1 GROUP BY 1) d ON c.id = d.id
  LEFT JOIN {overlap} o ON c.id = o.id""")  # fmt: skip
def geo_06(v: Views) -> DataFrame:
    d = districts(v)
    villages = d.select("layer_order", "polygons", F.col("district").alias("village"), F.lit("M").alias("mandal"), "district")
    mandals = d.select("layer_order", "polygons", F.lit("M").alias("mandal"))
    j = geo.jurisdictions(plots(v), ulbs(v), villages, mandals, d, "id")
    return j.select("id", "ulb", "district", "village", "inside_ulb", "sanctioning_authority", "uncertain")

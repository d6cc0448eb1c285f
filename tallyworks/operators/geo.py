"""Polygon measures and spatial joins without a geometry type.

A geometry is ``polygons``: array (parts) of array (rings) of array of
struct(x, y), rings closed, holes after their outer ring.  A line is an array of
struct(x, y).  Coordinates are degrees, distances metres on a sphere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.functions.numbers import col, computed_once
from tallyworks.functions.skew import HOT_ROWS, join_stats, small, spread_join
from tallyworks.operators.scrutiny import authority
from tallyworks.session import checkpointed

EARTH_M = 6371008.8
# Shapes that only touch overlap by rounding errors below this area.
SLIVER_SQM = 1e-3
# Counted bytes of geometry under which a layer may be broadcast.
BROADCAST_BYTES = 64 << 20
# A cell with over MANY points and box borders is split in four, up to LEVELS times.
MANY, LEVELS = 256, 6
POINT = "struct<x:double,y:double>"


def point(x: Column | float, y: Column | float) -> Column:
    def d(v: Column | float) -> Column:
        return (v if isinstance(v, Column) else F.lit(float(v))).cast("double")

    return F.struct(d(x).alias("x"), d(y).alias("y"))


def closed_ring(points: str | Column) -> Column:
    """Ring that ends where it starts (GEO-02)."""
    p = col(points)
    open_ = (F.size(p) > 0) & (F.get(p, F.lit(0)) != F.element_at(p, -1))
    return F.when(open_, F.concat(p, F.slice(p, 1, 1))).otherwise(p)


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """One-part geometry of an upright rectangle."""
    ring = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))
    return F.array(F.array(ring))


def _edges(ring: Column, fn) -> Column:
    """fn(start, end) for every edge of a closed ring or a line."""
    n = F.size(ring) - 1
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), fn)


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, x: s + x)


def ring_area(ring: Column) -> Column:
    """Area of a ring on the sphere in square metres, without sign."""
    terms = _edges(
        ring, lambda a, b: F.radians(b["x"] - a["x"]) * (F.sin(F.radians(a["y"])) + F.sin(F.radians(b["y"])))
    )
    return F.abs(_sum(terms)) * (EARTH_M * EARTH_M / 2)


def area(polygons: str | Column) -> Column:
    """Outer rings minus holes (GEO-01)."""

    def part(rings: Column) -> Column:
        areas = F.transform(rings, ring_area)
        return 2 * F.get(areas, F.lit(0)) - _sum(areas)

    return _sum(F.transform(col(polygons), part))


def centroid(polygons: str | Column) -> Column:
    """Mean of the ring vertices, the closing ones left out (GEO-01)."""
    rings = F.flatten(col(polygons))
    pts = F.flatten(F.transform(rings, lambda r: F.slice(r, F.lit(1), F.size(r) - 1)))
    n = F.size(pts)
    return F.struct(
        (_sum(F.transform(pts, lambda p: p["x"])) / n).alias("x"), (_sum(F.transform(pts, lambda p: p["y"])) / n).alias("y")
    )


def bbox(polygons: str | Column) -> Column:
    """struct(x0, y0, x1, y1) (GEO-01)."""
    pts = F.flatten(F.flatten(col(polygons)))
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")
    )


def contains_point(polygons: str | Column, x: Column, y: Column) -> Column:
    """Even-odd rule with holes; a point on an edge is inside (GEO-03)."""

    def crosses(a: Column, b: Column) -> Column:
        at = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return (((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < at, F.lit(False))).cast("int")

    def touches(a: Column, b: Column) -> Column:
        flat = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(
            F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    def inside(rings: Column) -> Column:
        on_edge = F.exists(rings, lambda r: F.exists(_edges(r, touches), lambda t: t))
        hits = F.aggregate(F.flatten(F.transform(rings, lambda r: _edges(r, crosses))), F.lit(0), lambda s, c: s + c)
        return on_edge | (hits % 2 == 1)

    return F.exists(col(polygons), inside)


def _cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Grid cells of a box."""

    def span(a: Column, b: Column) -> Column:
        return F.sequence(F.floor(a / size).cast("long"), F.floor(b / size).cast("long"))

    return F.flatten(F.transform(span(x0, x1), lambda i: F.transform(span(y0, y1), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def filed(boxes: DataFrame, size: float) -> DataFrame:
    """Rows (..., _b) once per grid cell of their box, with the cell as _i, _j."""
    cells = _cells(F.col("_b.x0"), F.col("_b.y0"), F.col("_b.x1"), F.col("_b.y1"), size)
    return boxes.withColumn("_cell", F.explode(cells)).withColumns({"_i": F.col("_cell.i"), "_j": F.col("_cell.j")}).drop("_cell")


def numbered(layer: DataFrame, order: str, geometry: str, *props: str) -> tuple[DataFrame, DataFrame, bool]:
    """(geometries by _id; boxes: _id, _b, order; are the geometries few bytes, counted?).

    A box is filed under many cells, its geometry stands in one row.  The written frame fixes the ids.
    """
    whole = checkpointed(layer.select(order, *dict.fromkeys(props), F.col(geometry).alias("_g")).withColumn("_id", F.monotonically_increasing_id()))
    corners = F.aggregate("_g", F.lit(0), lambda s, rings: s + F.aggregate(rings, F.lit(0), lambda t, r: t + F.size(r)))
    size, n = whole.agg(F.coalesce(F.sum(corners), F.lit(0)), F.count(F.lit(1))).first()
    return whole, whole.select("_id", order, bbox("_g").alias("_b")), 16 * size + 100 * n <= BROADCAST_BYTES


def box_hits(points: DataFrame, boxes: DataFrame, size: float, many: int = MANY, levels: int = LEVELS, hot: int = HOT_ROWS) -> DataFrame:
    """Pairs of ``points`` (_p, _x, _y) and ``boxes`` (_id, _b) that hold them.

    Boxes and points meet in grid cells.  A cell that holds many points and the borders of many boxes is split in four,
    and again, up to ``levels`` times: a quadtree that grows where the data is dense.  A cell that stays hot (all points
    at one place) is dealt over several tasks.  Each round reads only the points and boxes of cells that were split.
    """
    c = F.col
    out: DataFrame | None = None
    at = points.withColumns({"_i": F.floor(c("_x") / size).cast("long"), "_j": F.floor(c("_y") / size).cast("long")})
    in_cells = filed(boxes, size)
    inside = c("_x").between(c("_b.x0"), c("_b.x1")) & c("_y").between(c("_b.y0"), c("_b.y1"))
    for level in range(levels + 1):
        leaf_points, leaf_boxes, split = at, in_cells, None
        if level < levels:
            step = size / (1 << level)
            covers = (c("_b.x0") <= c("_i") * step) & (c("_b.y0") <= c("_j") * step) & (c("_b.x1") >= (c("_i") + 1) * step) & (c("_b.y1") >= (c("_j") + 1) * step)
            borders = in_cells.where(~covers).groupBy("_i", "_j").count().where(c("count") > many).select("_i", "_j")
            crowded = at.groupBy("_i", "_j").count().where(c("count") > many).select("_i", "_j")
            split = checkpointed(borders.join(crowded, ["_i", "_j"]))
            split = None if split.isEmpty() else small(split)
        if split is not None:
            leaf_points, leaf_boxes = at.join(split, ["_i", "_j"], "left_anti"), in_cells.join(split, ["_i", "_j"], "left_anti")
        met = spread_join(leaf_points, leaf_boxes, ["_i", "_j"], ["_p"], hot, inside).select(*points.columns, *boxes.columns)
        out = met if out is None else out.unionAll(met)
        if split is None:
            return out
        step = size / (2 << level)
        at = at.join(split, ["_i", "_j"], "left_semi").withColumns({"_i": F.floor(c("_x") / step).cast("long"), "_j": F.floor(c("_y") / step).cast("long")})
        child = F.array(*[F.struct((2 * c("_i") + i).alias("i"), (2 * c("_j") + j).alias("j")) for i in (0, 1) for j in (0, 1)])
        of = in_cells.join(split, ["_i", "_j"], "left_semi").withColumn("_cell", F.explode(child)).withColumns({"_i": c("_cell.i"), "_j": c("_cell.j")}).drop("_cell")
        in_cells = of.where(
            c("_i").between(F.floor(c("_b.x0") / step), F.floor(c("_b.x1") / step)) & c("_j").between(F.floor(c("_b.y0") / step), F.floor(c("_b.y1") / step))
        )
    return out


def placed(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    return points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("_p"), F.col(x).alias("_x"), F.col(y).alias("_y"))


def point_in_polygon(
    points: DataFrame, layer: DataFrame, key: str, *props: str, order: str = "layer_order", x: str = "lng", y: str = "lat",
    size: float = 0.25, many: int = MANY, broadcast_bytes: int | None = None, hot: int = HOT_ROWS,
) -> DataFrame:
    """First polygon of the layer around each point, as its properties (GEO-03, JN-21).

    Points meet the boxes of polygons through a quadtree; a geometry joins the pairs that are left by its id.  The
    geometries are broadcast if their counted bytes are few, otherwise a polygon of many points is dealt over tasks.
    Ids follow the layer order, so the first polygon of a point is its smallest id: pairs are hashed, never sorted, and
    a task holds one number per point, however many polygons lie around it.
    """
    whole, boxes, few = numbered(layer.orderBy(F.col(order).asc_nulls_last()), order, "polygons", *props)
    few = few if broadcast_bytes is None else few and broadcast_bytes > 0
    near = box_hits(placed(points, key, x, y), boxes.select("_id", "_b"), size, many, hot=hot).select("_p", "_x", "_y", "_id")
    shapes = whole.select("_id", "_g")
    met = near.join(F.broadcast(shapes), "_id") if few else spread_join(near, shapes, ["_id"], ["_p"], hot)
    hit = met.where(contains_point("_g", F.col("_x"), F.col("_y")))
    best = checkpointed(hit.groupBy("_p").agg(F.min("_id").alias("_id")))
    # A polygon without an order comes last and names nothing.
    named = whole.select("_id", F.when(F.col(order).isNotNull(), F.struct(*props)).alias("_s"))
    best = best.join(F.broadcast(named), "_id") if few else spread_join(best, named, ["_id"], ["_p"], hot)
    return best.select(F.col("_p").alias(key), *[F.col(f"_s.{p}").alias(p) for p in props])


# --- overlap -----------------------------------------------------------------------------


def _edge_rows(polygons: list) -> np.ndarray:
    """Edges (x at the lower end, lower y, x at the upper end, upper y) of all rings; level ones bound no slab."""
    rings = [np.array([(p["x"], p["y"]) for p in ring], float) for rings in polygons for ring in rings if len(ring) > 1]
    if not rings:
        return np.empty((0, 4))
    e = np.concatenate([np.c_[r[:-1], r[1:]] for r in rings])
    e = e[e[:, 1] != e[:, 3]]
    down = e[:, 1] > e[:, 3]
    e[down] = e[down][:, [2, 3, 0, 1]]
    return e


def _at(e: np.ndarray, y: float) -> np.ndarray:
    return e[:, 0] + (e[:, 2] - e[:, 0]) * ((y - e[:, 1]) / (e[:, 3] - e[:, 1]))


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights at which edges of a cross edges of b."""
    out = [np.empty(0)]
    for k in range(0, len(a), 512):
        e, f = a[k : k + 512, None, :], b[None, :, :]
        low, high = np.maximum(e[..., 1], f[..., 1]), np.minimum(e[..., 3], f[..., 3])
        i, j = np.nonzero((low < high) & (np.minimum(e[..., 0], e[..., 2]) <= np.maximum(f[..., 0], f[..., 2])) & (np.minimum(f[..., 0], f[..., 2]) <= np.maximum(e[..., 0], e[..., 2])))
        e, f, low, high = a[k + i], b[j], low[i, j], high[i, j]
        d0 = _rows_at(e, low) - _rows_at(f, low)
        d1 = _rows_at(e, high) - _rows_at(f, high)
        hit = d0 * d1 < 0
        out.append(low[hit] + (high - low)[hit] * (d0[hit] / (d0 - d1)[hit]))
    return np.concatenate(out)


def _rows_at(e: np.ndarray, y: np.ndarray) -> np.ndarray:
    return e[:, 0] + (e[:, 2] - e[:, 0]) * ((y - e[:, 1]) / (e[:, 3] - e[:, 1]))


def overlap_sqm(first: list, second: list) -> float:
    """Area common to two geometries, concave ones, parts and holes included.

    A sweep over heights: between two neighbouring corners or crossings no edges cross, so both geometries are strips
    between neighbouring edges there, and the common strips are trapezoids.
    """
    a, b = _edge_rows(first), _edge_rows(second)
    if not len(a) or not len(b):
        return 0.0
    low, high = max(a[:, 1].min(), b[:, 1].min()), min(a[:, 3].max(), b[:, 3].max())
    if low >= high:
        return 0.0
    a, b = (e[(e[:, 3] > low) & (e[:, 1] < high)] for e in (a, b))
    ys = np.unique(np.clip(np.concatenate([[low, high], a[:, 1], a[:, 3], b[:, 1], b[:, 3], _crossings(a, b)]), low, high))
    total = 0.0
    for y0, y1 in zip(ys[:-1].tolist(), ys[1:].tolist()):
        mid = (y0 + y1) / 2
        strips = []
        for e in (a, b):
            e = e[(e[:, 1] < mid) & (e[:, 3] > mid)]
            strips.append(e[np.argsort(_at(e, mid), kind="stable")])
        p, q = strips
        pm, qm = _at(p, mid), _at(q, mid)
        if not len(pm) or not len(qm) or pm[-1] <= qm[0] or qm[-1] <= pm[0]:
            continue
        p0, p1, q0, q1 = _at(p, y0), _at(p, y1), _at(q, y0), _at(q, y1)
        i = j = 0
        wide = 0.0
        while i + 1 < len(pm) and j + 1 < len(qm):
            l0, l1 = (p0[i], p1[i]) if pm[i] >= qm[j] else (q0[j], q1[j])
            r0, r1 = (p0[i + 1], p1[i + 1]) if pm[i + 1] <= qm[j + 1] else (q0[j + 1], q1[j + 1])
            if min(pm[i + 1], qm[j + 1]) > max(pm[i], qm[j]):
                wide += max(r0 - l0, 0.0) + max(r1 - l1, 0.0)
            if pm[i + 1] <= qm[j + 1]:
                i += 2
            else:
                j += 2
        total += math.radians(wide) * (math.sin(math.radians(y1)) - math.sin(math.radians(y0)))
    return total * EARTH_M * EARTH_M / 2


@F.pandas_udf(T.DoubleType())
def _overlaps(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([overlap_sqm(p, q) for p, q in zip(a, b)], dtype=float)


def largest_overlap(
    shapes: DataFrame, layer: DataFrame, key: str, *props: str, order: str = "layer_order", size: float = 0.25, hot: int = HOT_ROWS
) -> DataFrame:
    """Layer polygon with the largest common area, and whether the shape is inside it at 99.9 % (GEO-04, JN-22).

    Boxes that share a grid cell name the pairs, and only they are filed; the geometries join a pair by their ids.
    Each pair is swept once.
    """
    c = F.col
    s, sb, _ = numbered(shapes.withColumn("_k", c(key)), key, "polygons", "_k")
    whole, boxes, few = numbered(layer, order, "polygons", *props)
    s_cells = filed(sb.select(c("_id").alias("_sid"), "_b"), size).withColumnRenamed("_b", "_sb")
    touch = (c("_sb.x0") <= c("_b.x1")) & (c("_b.x0") <= c("_sb.x1")) & (c("_sb.y0") <= c("_b.y1")) & (c("_b.y0") <= c("_sb.y1"))
    # A pair that shares several cells is kept at the first common one only.
    first_i = F.floor(F.greatest("_sb.x0", "_b.x0") / size).cast("long")
    first_j = F.floor(F.greatest("_sb.y0", "_b.y0") / size).cast("long")
    pairs = spread_join(s_cells, filed(boxes.select("_id", "_b"), size), ["_i", "_j"], ["_sid"], hot, touch & (c("_i") == first_i) & (c("_j") == first_j))
    own = s.select(c("_id").alias("_sid"), c("_k"), c("_g").alias("_s"))
    of = whole.select("_id", order, "_g", F.struct(*props).alias("_props"))
    met = pairs.select("_sid", "_id")
    met = met.join(F.broadcast(of), "_id") if few else spread_join(met, of, ["_id"], ["_sid"], hot)
    met = spread_join(met, own, ["_sid"], ["_id"], hot)
    # A sweep costs far more than its bytes tell, so pairs are dealt by number; the filter must not sweep them again.
    cores = met.sparkSession.sparkContext.defaultParallelism
    met = met.repartition(max(int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")), cores), "_sid", "_id")
    scored = computed_once(met.select("_k", "_props", order, area("_s").alias("_area"), _overlaps("_s", "_g").alias("overlap_sqm")))
    scored = scored.where(c("overlap_sqm") > SLIVER_SQM)
    best = scored.groupBy("_k").agg(F.min_by(F.struct("_props", "overlap_sqm", "_area"), F.struct(-c("overlap_sqm"), c(order))).alias("_p"))
    return best.select(
        c("_k").alias(key), *[c(f"_p._props.{p}").alias(p) for p in props], c("_p.overlap_sqm").alias("overlap_sqm"),
        (c("_p.overlap_sqm") >= c("_p._area") * 0.999).alias("fully_inside"))


# --- nearest line -----------------------------------------------------------------------


def haversine(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    h = F.pow(F.sin(F.radians(y1 - y0) / 2), 2) + F.cos(F.radians(y0)) * F.cos(F.radians(y1)) * F.pow(
        F.sin(F.radians(x1 - x0) / 2), 2)
    return 2 * EARTH_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Metres from a point to a segment: foot of the perpendicular in degrees, then great circle."""
    vx, vy = bx - ax, by - ay
    t = ((px - ax) * vx + (py - ay) * vy) / F.nullif(vx * vx + vy * vy, F.lit(0.0))
    t = F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return haversine(px, py, ax + t * vx, ay + t * vy)


def nearest_line(
    points: DataFrame, lines: DataFrame, key: str, *props: str, buffer_m: float = 250.0, order: str = "layer_order",
    x: str = "lng", y: str = "lat", size: float | None = None, many: int = MANY, hot: int = HOT_ROWS,
) -> DataFrame:
    """Nearest line within the buffer and its distance; the earlier line wins ties (GEO-05, JN-23).

    A segment's box grown by the buffer holds every point that it may be nearest to; the quadtree of ``box_hits`` splits
    cells of many segments.  Segments are numbered in line order.  Pairs are met twice, for the least distance of a point
    and for the first segment at it: both are one number per point, so pairs are hashed, never sorted or written.
    Columns: key, props, distance_m.
    """
    deg = buffer_m / 111_000.0
    cell = size or max(4 * deg, 0.01)
    c = F.col
    parts = _edges(c("line"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    whole = lines.orderBy(c(order).asc_nulls_first()).select(F.struct(*props).alias("_s"), F.explode(parts).alias("_e"))
    whole = checkpointed(whole.withColumn("_id", F.monotonically_increasing_id()))
    # Degrees of longitude shrink towards the poles.
    grow = deg / F.greatest(F.cos(F.radians(F.greatest(F.abs("_e.a.y"), F.abs("_e.b.y")) + deg)), F.lit(0.01))
    box = F.struct(
        (F.least("_e.a.x", "_e.b.x") - grow).alias("x0"), (F.least("_e.a.y", "_e.b.y") - deg).alias("y0"),
        (F.greatest("_e.a.x", "_e.b.x") + grow).alias("x1"), (F.greatest("_e.a.y", "_e.b.y") + deg).alias("y1"))
    segs = whole.select("_id", "_e", box.alias("_b"))

    def near(pts: DataFrame) -> DataFrame:
        met = box_hits(pts, segs, cell, many, hot=hot)
        d = segment_distance(c("_x"), c("_y"), c("_e.a.x"), c("_e.a.y"), c("_e.b.x"), c("_e.b.y"))
        return computed_once(met.select(*pts.columns, "_id", d.alias("_m"))).where(c("_m") <= buffer_m)

    pts = placed(points, key, x, y)
    least = checkpointed(near(pts).groupBy("_p").agg(F.min("_m").alias("_d"), F.count(F.lit(1)).alias("_n")))
    told = join_stats(pts, least, ["_p"], "_n", ["_x", "_y"], hot).where(c("_d").isNotNull()).drop("_n")
    first = checkpointed(near(told).where(c("_m") == c("_d")).groupBy("_p").agg(F.min("_id").alias("_id"), F.min("_d").alias("_d")))
    best = spread_join(first, whole.select("_id", "_s"), ["_id"], ["_p"], hot)
    return best.select(c("_p").alias(key), *[c(f"_s.{p}").alias(p) for p in props], c("_d").alias("distance_m"))


def jurisdictions(
    plots: DataFrame, ulbs: DataFrame, villages: DataFrame, mandals: DataFrame, districts: DataFrame, key: str = "id", size: float = 0.25
) -> DataFrame:
    """Jurisdiction record of each plot by its centroid, with fallbacks (GEO-06).

    ulbs: ulb, district; villages: village, mandal, district; mandals: mandal;
    districts: district.  A plot that is not fully inside one district is uncertain.
    """
    p = plots.withColumn("_ctr", centroid("polygons"))
    pts = p.select(key, F.col("_ctr.x").alias("lng"), F.col("_ctr.y").alias("lat"))

    def hit(layer: DataFrame, **names: str) -> DataFrame:
        h = point_in_polygon(pts, layer, key, *names.values(), size=size)
        return h.select(key, *[F.col(src).alias(dst) for dst, src in names.items()])

    j = plots.select(key)
    for h in (
        hit(ulbs, ulb="ulb", _ud="district"),
        hit(villages, village="village", _vm="mandal", _vd="district"),
        hit(mandals, _mm="mandal"),
        hit(districts, _dd="district"),
        largest_overlap(plots, districts, key, "district", size=size).select(key, "fully_inside"),
    ):
        j = j.join(h, key, "left")
    inside = F.col("ulb").isNotNull()
    return j.select(
        key, F.coalesce("_ud", "_dd", "_vd").alias("district"), F.coalesce("_mm", "_vm").alias("mandal"), "village", "ulb",
        inside.alias("inside_ulb"), authority(inside, "village").alias("sanctioning_authority"),
        (~F.coalesce("fully_inside", F.lit(False))).alias("uncertain"))

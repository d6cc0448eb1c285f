import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyworks.operators import geo

POLYGONS = "array<array<array<struct<x:double,y:double>>>>"


def ring(pts):
    return [{"x": x, "y": y} for x, y in (*pts, pts[0])]


def star(rng, cx, cy, r, n):
    a = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + math.cos(t) * r * k, cy + math.sin(t) * r * k) for t, k in ((t, rng.uniform(0.4, 1)) for t in a)]


def holds(polygons, x, y):
    for rings in polygons:
        odd = False
        for r in rings:
            for a, b in zip(r, r[1:]):
                if (a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
                    odd = not odd
        if odd:
            return True
    return False


@pytest.mark.parametrize("many, hot, few_bytes", [(256, 2_000_000, None), (4, 20, 0), (10_000, 7, 0)])
def test_points_of_a_hot_cell_against_all_polygons(spark, many, hot, few_bytes):
    rng = random.Random(many)
    layer = [(i, f"n{i}", [[ring(star(rng, rng.uniform(0, 3), rng.uniform(0, 3), rng.uniform(0.02, 0.8), 9))]]) for i in range(60)]
    layer += [(60 + i, f"n{60 + i}", [[ring(star(rng, 1.1 + rng.uniform(-0.1, 0.1), 1.1, 0.03, 6))]]) for i in range(60)]
    spots = [(i, rng.uniform(0, 3), rng.uniform(0, 3)) for i in range(200)] + [(200 + i, 1.1 + rng.gauss(0, 0.02), 1.1 + rng.gauss(0, 0.02)) for i in range(100)]
    spots += [(300 + i, 1.101, 1.102) for i in range(50)] + [(900, None, 1.0)]
    want = {}
    for i, x, y in spots:
        hit = [n for o, n, p in layer if x is not None and holds(p, x, y)]
        if hit:
            want[i] = hit[0]
    pts = spark.createDataFrame(spots, "id long, lng double, lat double")
    shapes = spark.createDataFrame(layer, f"layer_order int, name string, polygons {POLYGONS}")
    got = geo.point_in_polygon(pts, shapes, "id", "name", size=1.0, many=many, hot=hot, broadcast_bytes=few_bytes)
    assert {r.id: r.name for r in got.collect()} == want


def test_cells_are_split_where_points_and_borders_are_dense(spark):
    """Nearly all pairs that cells name hold their point once the crowded cell is split."""
    rng = random.Random(2)
    pts = spark.createDataFrame([(i, 0.5 + rng.gauss(0, 0.1), 0.5 + rng.gauss(0, 0.1)) for i in range(300)], "_p long, _x double, _y double")
    rows = [(k, *(v for v in ((k % 40) / 40, (k // 40) / 40))) for k in range(1600)]
    boxes = spark.createDataFrame(rows, "_id long, x double, y double")
    boxes = boxes.select("_id", F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 0.02).alias("x1"), (F.col("y") + 0.02).alias("y1")).alias("_b"))
    got = sorted((r._p, r._id) for r in geo.box_hits(pts, boxes, 1.0, many=8, levels=4).collect())
    want = sorted((p._p, k) for p in pts.collect() for k, x, y in rows if x <= p._x <= x + 0.02 and y <= p._y <= y + 0.02)
    assert got == want


@pytest.mark.parametrize("many, hot", [(256, 2_000_000), (5, 9)])
def test_nearest_line_against_all_lines(spark, many, hot):
    rng = random.Random(many)
    lines = []
    for i in range(80):
        x, y = rng.uniform(0, 0.2), rng.uniform(0, 0.2)
        lines.append((i, f"r{i}", [{"x": x + rng.gauss(0, 0.004) * k, "y": y + rng.gauss(0, 0.004) * k} for k in range(4)]))
    lines += [(80 + i, f"r{80 + i}", lines[i][2]) for i in range(20)]
    spots = [(i, rng.uniform(0, 0.2), rng.uniform(0, 0.2)) for i in range(120)] + [(200 + i, 0.1, 0.1001) for i in range(60)]

    def metres(px, py, a, b):
        vx, vy = b["x"] - a["x"], b["y"] - a["y"]
        n = vx * vx + vy * vy
        t = min(max(((px - a["x"]) * vx + (py - a["y"]) * vy) / n, 0), 1) if n else 0
        qx, qy = a["x"] + t * vx, a["y"] + t * vy
        h = math.sin(math.radians(qy - py) / 2) ** 2 + math.cos(math.radians(py)) * math.cos(math.radians(qy)) * math.sin(math.radians(qx - px) / 2) ** 2
        return 2 * geo.EARTH_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = {}
    for i, x, y in spots:
        d, o = min((min(metres(x, y, a, b) for a, b in zip(ln, ln[1:])), o) for o, _, ln in lines)
        if d <= 800:
            want[i] = (f"r{o}", round(d, 6))
    pts = spark.createDataFrame(spots, "id long, lng double, lat double")
    roads = spark.createDataFrame(lines, "layer_order int, name string, line array<struct<x:double,y:double>>")
    got = {r.id: (r.name, round(r.distance_m, 6)) for r in geo.nearest_line(pts, roads, "id", "name", buffer_m=800.0, many=many, hot=hot).collect()}
    assert got == want


def test_an_outline_of_2000_corners_against_1000_plots_takes_seconds():
    rng = random.Random(5)
    outline = [[ring(star(rng, 0.5, 0.5, 0.45, 2000))]]
    plots = [[[ring([(x / 25, y / 40), ((x + 1) / 25, y / 40), ((x + 1) / 25, (y + 1) / 40), (x / 25, (y + 1) / 40)])]] for x in range(25) for y in range(40)]
    began = time.time()
    total = sum(geo.overlap_sqm(outline, p) for p in plots)
    assert time.time() - began < 20
    assert total == pytest.approx(geo.overlap_sqm(outline, outline), rel=1e-9)


def test_overlap_against_counted_points():
    rng = random.Random(8)
    for _ in range(6):
        a = [[ring(star(rng, 0.4, 0.4, 0.4, 12)), ring([(0.38, 0.38), (0.42, 0.38), (0.42, 0.42)])]]
        b = [[ring(star(rng, 0.6, 0.5, 0.4, 9))], [ring([(0.0, 0.0), (0.2, 0.0), (0.2, 0.2), (0.0, 0.2)])]]
        step = 0.004
        n = sum(holds(a, x * step, y * step) and holds(b, x * step, y * step) for x in range(270) for y in range(250))
        assert geo.overlap_sqm(a, b) == pytest.approx(n * (math.radians(step) * geo.EARTH_M) ** 2, rel=0.03)
        assert geo.overlap_sqm(a, b) == pytest.approx(geo.overlap_sqm(b, a), rel=1e-12)


def test_largest_overlap_of_a_hot_cell(spark):
    rng = random.Random(4)
    layer = [(i, f"d{i}", [[ring([(i * 0.5, 0.0), (i * 0.5 + 0.6, 0.0), (i * 0.5 + 0.6, 1.0), (i * 0.5, 1.0)])]]) for i in range(6)]
    shapes = [(i, [[ring(star(rng, rng.uniform(0, 3), 0.5, 0.1, 7))]]) for i in range(60)] + [(100 + i, [[ring(star(rng, 1.02, 0.5, 0.1, 7))]]) for i in range(30)]
    want = {}
    for i, p in shapes:
        best = max(((geo.overlap_sqm(p, q), -o) for o, _, q in layer))
        if best[0] > geo.SLIVER_SQM:
            want[i] = f"d{-best[1]}"
    a = spark.createDataFrame(shapes, f"id long, polygons {POLYGONS}")
    b = spark.createDataFrame(layer, f"layer_order int, name string, polygons {POLYGONS}")
    assert {r.id: r.name for r in geo.largest_overlap(a, b, "id", "name", hot=10).collect()} == want


def plans(monkeypatch, run):
    """Physical plans of all frames that ``run`` writes or returns."""
    seen, write = [], geo.checkpointed
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(geo, "checkpointed", lambda df: seen.append(plan(df)) or write(df))
    seen.append(plan(run()))
    return "\n".join(seen)


def test_segments_of_a_small_file_are_not_broadcast(spark, tmp_path, monkeypatch):
    """The file of lines tells nothing about the bytes of their segments and cells."""
    spark.range(2000).select(F.col("id").alias("layer_order")).write.parquet(str(tmp_path / "lines"))
    x = F.col("layer_order") / 100
    lines = spark.read.parquet(str(tmp_path / "lines")).select("layer_order", F.concat(F.lit("r"), "layer_order").alias("name"), F.array(geo.point(x, F.lit(0.0)), geo.point(x + 0.01, F.lit(0.0))).alias("line"))
    pts = spark.range(50).select("id", (F.col("id") / 10).alias("lng"), F.lit(0.001).alias("lat"))
    text = plans(monkeypatch, lambda: geo.nearest_line(pts, lines, "id", "name"))
    assert text.count("SortMergeJoin") >= 3 and "SortAggregate" not in text
    assert geo.nearest_line(pts, lines, "id", "name").count() == 50


def test_pairs_of_points_and_polygons_are_hashed_and_dealt(spark, monkeypatch):
    """Many polygons around every point: one number per point is kept, no pair is sorted, more than one task works."""
    layer = spark.range(40).select((39 - F.col("id")).alias("layer_order"), F.concat(F.lit("n"), "id").alias("name"),
                                   geo.rectangle(F.col("id") * 0.0, F.col("id") * 0.0, F.lit(4.0), F.lit(4.0)).alias("polygons"))
    layer = layer.unionByName(layer.where("name = 'n5'").withColumns({"layer_order": F.lit(None).cast("long"), "name": F.lit("none")}))
    pts = spark.range(200).repartition(1).select("id", (F.col("id") % 20 / 5).alias("lng"), (F.col("id") % 10 / 3).alias("lat"))
    run = lambda: geo.point_in_polygon(pts, layer, "id", "name")
    text = plans(monkeypatch, run)
    assert "SortMergeJoin" in text and "SortAggregate" not in text
    assert {(r.id, r.name) for r in run().collect()} == {(i, "n39") for i in range(200)}
    near = geo.box_hits(geo.placed(pts, "id", "lng", "lat"), layer.select("name", geo.bbox("polygons").alias("_b")), 0.25)
    assert near.select(F.spark_partition_id()).distinct().count() > 1

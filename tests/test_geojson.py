import json
import random

import pytest

from tallyworks.sources import readers


def layer(n, rng):
    out = []
    for i in range(n):
        ring = [[rng.random(), rng.random(), 5] for _ in range(rng.randint(3, 9))]
        kind, shape = ("MultiPolygon", [[ring], [ring[::-1]]]) if i % 3 == 0 else ("Polygon", [ring])
        if i % 7 == 0:
            kind, shape = "Point", [1, 2]
        out.append({"type": "Feature", "properties": {"district": f"d{i} \"}}, {{"}, "geometry": {"type": kind, "coordinates": shape}})
    return out


def dumped(features, style):
    if style == "one line":
        return json.dumps({"type": "FeatureCollection", "name": "x", "features": features}, separators=(",", ":"))
    if style == "indented":
        return json.dumps({"type": "FeatureCollection", "features": features}, indent=2)
    if style == "ids":
        return json.dumps({"type": "FeatureCollection", "features": [{"id": i, **f} for i, f in enumerate(features)]})
    if style == "sorted":  # the type comes last
        return json.dumps({"type": "FeatureCollection", "features": features}, sort_keys=True)
    features[3]["properties"]["district"] = "Feature"
    return json.dumps({"type": "FeatureCollection", "features": features})


@pytest.mark.parametrize("style", ["one line", "indented", "ids", "sorted", "named like a feature"])
def test_layers_are_read_in_byte_ranges(spark, tmp_path, style):
    rng = random.Random(3)
    want, old = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    for k in range(2):
        features = layer(150 + k, rng)
        (tmp_path / f"l{k}.json").write_text(dumped(features, style))
        for i, f in enumerate(features):
            g = f["geometry"]
            if g["type"] != "Point":
                polygons = g["coordinates"] if g["type"] == "MultiPolygon" else [g["coordinates"]]
                want.append((i, f["properties"]["district"], [[[tuple(p[:2]) for p in r] for r in rings] for rings in polygons]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = readers.read_geojson(spark, str(tmp_path), {"district": "district"}, {"district": "D"})
        got = [(r.layer_order, r.district, [[[(p.x, p.y) for p in ring] for ring in rings] for rings in r.polygons]) for r in df.collect()]
        if style in ("one line", "indented", "ids"):
            assert df.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == sorted(want)

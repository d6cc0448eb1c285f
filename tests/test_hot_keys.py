"""One key with a third of all rows, null keys: forms for huge groups against plain Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyworks.functions import skew
from tallyworks.operators import caseload as cl
from tallyworks.operators import documents as dc
from tallyworks.operators import models
from tallyworks.operators import rules as rl
from tallyworks.operators import similarity as sim


@pytest.mark.parametrize("limit", [0, 100])
def test_spread_lookup(spark, limit):
    keys = [None] * 200 + ["hot"] * 150 + ["gone"] * 120 + [f"k{i % 40}" for i in range(80)]
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, k string")
    known = {"hot": 1, "k3": None, **{f"k{i}": i for i in range(5, 30)}, "unused": 9}
    table = spark.createDataFrame(list(known.items()), "k string, v int")
    got = {r.i: (r.k, r.v) for r in skew.spread_lookup(rows, table, "k", ["i"], hot=50, limit=limit).collect()}
    assert got == {i: (k, known.get(k)) for i, k in enumerate(keys)}


def largest_task(spark, out):
    """Rows of the largest task where no join is broadcast without being asked for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return out().groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.count("v")).agg(F.max("n")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_null_hot_and_unknown_keys_are_dealt(spark):
    keys = [None] * 2000 + ["hot"] * 1500 + ["gone"] * 1500 + ["cold"] * 20
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, k string")
    table = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    assert largest_task(spark, lambda: skew.spread_lookup(rows, table, "k", ["i"], hot=50, limit=0)) < 1600
    n = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("v"))
    assert largest_task(spark, lambda: skew.join_stats(rows, n, ["k"], "n", ["i"], hot=50)) < 1600


@pytest.mark.parametrize("limit", [0, 100])
def test_officers_of_applications_without_ulb(spark, limit):
    apps = [(f"A{i}", "u1" if i % 3 == 0 else None, "v1" if i % 3 == 1 else f"v{i % 7}") for i in range(90)]
    df = spark.createDataFrame(apps, "id string, ulb string, village string").withColumns({
        "inside_ulb": F.col("ulb").isNotNull(), "is_high_rise": F.lit(False), "building_use": F.lit("residential"), "type": F.lit("building"),
        "outcome": F.lit(None).cast("string"), "status": F.lit("submitted")})
    officers = spark.createDataFrame([(0, "o1", "ulb_officer", "u1", None), (1, "o2", "panchayat_secretary", None, "v1"), (2, "o3", "panchayat_secretary", None, "v1"),
                                      (3, "o4", "dtcp_reviewer", None, None)], "ord int, officer_id string, role string, ulb string, village string")
    got = {r.id: r.assigned_officer for r in cl.route(df, officers, hot=10, limit=limit).collect()}
    assert got == {i: "o1" if u else "o2" if v == "v1" else None for i, u, v in apps}


@pytest.mark.parametrize("hot,limit", [(10, 0), (10**6, 0), (10**6, 100)])
def test_longest_robots_rule(spark, hot, limit):
    rng = random.Random(3)
    paths = ["/" + "/".join(rng.choice(["a", "b", "ab", "c"]) for _ in range(rng.randrange(5))) for _ in range(150)]
    urls = [("big" if i % 3 else rng.choice(["s1", "s2", "none"]), i, f"https://h.example.org{p}" + ("?q=1" if i % 5 == 0 else ""), i % 11 > 0, i % 2 == 0)
            for i, p in enumerate(paths)]
    rules = {(s, p, rng.random() < 0.5) for s in ("big", "s1", "s2") for p in ("/", "/a", "/a/b", "/ab", "/b/c/a", "/a?q", "/c/", "/nothing/at/all/here")}
    rules |= {("big", "/a", True), ("big", "/a", False)}
    u = spark.createDataFrame(urls, "source_id string, seq long, url string, robots_available boolean, came_from_seed boolean")
    r = spark.createDataFrame(sorted(rules), "source_id string, prefix string, allow boolean")
    got = {x.seq: x.robots_ok for x in dc.robots_allowed(u, r, ("source_id", "seq", "url"), hot, limit).collect()}

    def want(source, url, available, seed):
        if not available:
            return seed
        path = url.removeprefix("https://h.example.org") or "/"
        found = [(len(p), a) for s, p, a in rules if s == source and path.startswith(p)]
        return max(found)[1] if found else True

    assert got == {i: want(s, url, a, c) for s, i, url, a, c in urls}


@pytest.mark.parametrize("hot", [5, 10**6])
def test_paragraphs_of_texts_in_parts(spark, hot):
    rng = random.Random(5)
    bits = ["one two", "  three\t four ", "\n\n", "\n \n", "five\nsix", "", " ", "\n"]
    turns = [("hot" if i % 3 == 0 else f"c{i % 20}", i, None if i % 17 == 0 else "".join(rng.choice(bits) for _ in range(6))) for i in range(300)]
    df = spark.createDataFrame(turns, "conv string, turn int, text string").repartition(7)
    got = sorted(tuple(r) for r in sim.joined_paragraphs(df, ["conv"], ["turn"], hot=hot).collect())
    want = []
    for c in sorted({c for c, _, _ in turns}):
        whole = "\n \n".join(t for k, _, t in sorted(turns, key=lambda x: x[1]) if k == c and t is not None)
        ps = [re.sub(r"[ \t]+", " ", p.strip()) for p in re.split(r"\n\s*\n+", whole)]
        want += [(c, i, p) for i, p in enumerate([p for p in ps if p])]
    assert got == sorted(want)


def test_windows_of_a_document_with_most_pages(spark):
    pages = [("hot", i, f"p{i}") for i in range(1, 61)] + [("small", i, f"q{i}") for i in range(1, 6)]
    df = spark.createDataFrame(pages, "doc string, page_number int, text string")
    plain, split = (sorted(map(tuple, rl.page_windows(df, 4, 1, hot=h).collect())) for h in (10**6, 10))
    assert plain == split and len(plain) == 22


def test_phrases_of_long_texts(spark):
    rng = random.Random(7)
    a = [f"w{rng.randrange(60)}x" for _ in range(20_000)]
    b = [f"w{rng.randrange(60)}x" for _ in range(20_000)]
    df = spark.createDataFrame([(" ".join(a), " ".join(b))], "a string, b string").repartition(1)
    sim.compare_texts(df.limit(0), "a", "b").collect()
    start = time.time()
    got = sim.compare_texts(df, "a", "b").first()
    assert time.time() - start < 5 and len(got.repeated_phrases) == 8


def test_repeated_phrases_in_order_of_their_places(spark):
    rng = random.Random(9)
    rows = [(" ".join(rng.choice(["alpha", "bravo", "delta"]) for _ in range(40)), " ".join(rng.choice(["alpha", "bravo", "delta"]) for _ in range(12))) for _ in range(20)]
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"ta": sim.tokens(F.col("a")), "tb": sim.tokens(F.col("b"))})
    for shown in (1, 3, 8):
        for r in sim.compare_texts(df, "a", "b", shown).collect():
            grams = [[" ".join(t[i : i + 3]) for i in range(len(t) - 2)] for t in (r.ta, r.tb)]
            assert r.repeated_phrases == [g for g in grams[0] if g in set(grams[1])][:shown]


def test_trees_are_joined_with_the_asked_chance(spark):
    df = spark.range(40_000).withColumn("k", F.concat(F.lit("r"), "id"))
    for share, trees in ((0.02, 100), (0.5, 10), (1.0, 7)):
        got = df.select(F.explode(models.trees_joined("k", share, trees, 42)).alias("t")).groupBy("t").count().collect()
        assert sorted(r.t for r in got) == list(range(trees))
        spread = 5 * (40_000 * share * (1 - share)) ** 0.5
        assert all(abs(r["count"] - 40_000 * share) <= spread for r in got)
        pairs = df.select(models.trees_joined("k", share, trees, 42).alias("t"))
        assert pairs.where(F.size("t") != F.size(F.array_distinct("t"))).count() == 0
        both = pairs.where(F.array_contains("t", 0) & F.array_contains("t", 1)).count()
        assert abs(both - 40_000 * share**2) <= 5 * (40_000 * share**2) ** 0.5 * (share < 1)

import random

import numpy as np
from pyspark.sql import functions as F

from tallyworks.operators import models

COLS = ("a", "b")


def rows(spark, n, seed=1):
    rng = random.Random(seed)
    at = [(0, 0), (9, 0), (0, 9), (9, 9)]
    return spark.createDataFrame([(i, *(c + rng.gauss(0, 0.5) for c in at[i % 4])) for i in range(n)], "id long, a double, b double").repartition(3)



def segment(df, **options):
    return models.segment(df, cols=COLS, **options)


def test_every_row_is_at_its_nearest_centre_and_none_is_empty(spark):
    df = rows(spark, 400).unionAll(spark.createDataFrame([(1000 + i, 9.0, 9.0) for i in range(200)], "id long, a double, b double"))
    out, centres = segment(df, k=4, restarts=5)
    z = {r.id: (r.z_a, r.z_b) for r in models.standardised(df, COLS).collect()}
    c = {r.cluster_id: (r.a, r.b) for r in centres.collect()}
    got = {r.id: r.cluster_id for r in out.collect()}
    assert sorted(c) == [0, 1, 2, 3] == sorted(set(got.values())) and len(got) == 600
    for i, k in got.items():
        d = {j: sum((x - y) ** 2 for x, y in zip(z[i], v)) for j, v in c.items()}
        assert d[k] <= min(d.values()) + 1e-9
    groups = {}
    for i, k in got.items():
        groups.setdefault(i % 4 if i < 1000 else 3, set()).add(k)
    assert all(len(v) == 1 for v in groups.values())
    for k, v in c.items():
        mean = np.mean([z[i] for i in got if got[i] == k], axis=0)
        assert np.abs(mean - v).max() < 1e-3


def test_few_distinct_rows_and_none(spark):
    df = spark.createDataFrame([(i, float(i % 2), 1.0) for i in range(20)], "id long, a double, b double")
    out, centres = segment(df, k=6, restarts=3)
    assert centres.count() == 2 == out.select("cluster_id").distinct().count()
    out, centres = segment(df.where("false"), k=6)
    assert out.count() == 0 == centres.count()


def test_all_restarts_take_few_jobs(spark):
    df = rows(spark, 200)
    spark.sparkContext.setJobGroup("segments", "")
    segment(df, k=4)
    spark.sparkContext.setJobGroup("other", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("segments")) < 45

"""Segmentation by KMeans and anomaly scores by an isolation forest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions.numbers import half_even, kept, log_scale
from tallyworks.functions.ranking import group_quantile
from tallyworks.functions.skew import HOT_ROWS
from tallyworks.session import checkpointed

FEATURES = ("avg_daily_value", "total_sale_value", "volatility", "trend_slope", "growth_30d", "active_days")
LOGGED = ("avg_daily_value", "total_sale_value", "active_days")
ANOMALY_FEATURES = ("avg_daily_value", "volatility", "growth_30d", "trend_slope")

# Stocking advice by segment name.
STOCKING = {
    "Premium Growth Engine": "Increase allocation 10–20%; push premium pack mix.",
    "Stable High-Throughput": "Maintain current assortment; monitor weekly.",
    "Volatile — Tighter Replenishment": "Shorter replenishment cycle; reduce buffer stock.",
    "Declining — Intervention Needed": "Depot review; audit for competitor / policy impact.",
    "Low-Productivity — Rationalize": "Cut long-tail SKUs; test reduced assortment.",
    "Steady Mid-Tier": "Standard replenishment; opportunistic premium upsell.",
}
DEFAULT_STOCKING = "Standard replenishment policy."


def standardised(feats: DataFrame, cols: Sequence[str] = FEATURES, logged: Sequence[str] = LOGGED) -> DataFrame:
    """Add z_<col>: log scale where asked, then population standard score (MTH-02)."""
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    x = {c: log_scale(v) if c in logged else v for c, v in x.items()}
    df = feats.withColumns({f"_x_{c}": v for c, v in x.items()})
    st = df.agg(
        F.struct(
            *[F.avg(f"_x_{c}").alias(f"m_{c}") for c in cols], *[F.stddev_pop(f"_x_{c}").alias(f"s_{c}") for c in cols]
        )
    ).scalar()
    df = df.withColumn("_st", st)
    z = {}
    for c in cols:
        s = F.col(f"_st.s_{c}")
        z[f"z_{c}"] = (F.col(f"_x_{c}") - F.col(f"_st.m_{c}")) / F.when(s == 0, 1.0).otherwise(s)
    return df.withColumns(z).drop("_st", *[f"_x_{c}" for c in cols])


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centre, squared distance) of every row; equal distances go to the first centre."""
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)
    near = d.argmin(1)
    return near, ((x - centres[near]) ** 2).sum(1)


def _passed(rows: DataFrame, centres: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """One pass for all sets of centres: (sums, counts, total squared distance) of each; one row per centre comes back."""
    known = rows.sparkSession.sparkContext.broadcast(centres)
    dim = centres[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), dim + 2)) for c in known.value]
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, dim)
            for c, s in zip(known.value, sums):
                near, d = _nearest(x, c)
                for i, v in enumerate((*x.T, np.ones(len(x)), d)):
                    s[:, i] += np.bincount(near, v, len(c))
        for r, s in enumerate(sums):
            cells = [pa.array(np.full(len(s), r)), pa.array(np.arange(len(s))), *(pa.array(s[:, i]) for i in range(dim + 2))]
            yield pa.RecordBatch.from_arrays(cells, ["r", "c", *(f"v{i}" for i in range(dim + 2))])

    schema = "r long, c long, " + ", ".join(f"v{i} double" for i in range(dim + 2))
    found = rows.select("_v").mapInArrow(run, schema).groupBy("r", "c").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(dim + 2)])
    out = [np.zeros((len(c), dim + 2)) for c in centres]
    for row in found.collect():
        out[row[0]][row[1]] = row[2:]
    return [o[:, :dim] for o in out], [o[:, dim] for o in out], np.array([o[:, dim + 1].sum() for o in out])


def _drawn(rows: DataFrame, centres: list[np.ndarray], cost: np.ndarray, many: float, seed: int) -> list[np.ndarray]:
    """One pass: each set of centres with rows drawn in proportion to their squared distance, ``many`` on average."""
    known = rows.sparkSession.sparkContext.broadcast((centres, cost))
    dim = centres[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sets, total = known.value
        rng = np.random.default_rng((seed, TaskContext.get().partitionId()))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, dim)
            for r, c in enumerate(sets):
                hit = np.flatnonzero(rng.random(len(x)) * max(total[r], 1e-300) < many * _nearest(x, c)[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), r)), pa.array(x[hit].tolist(), pa.list_(pa.float64()))], ["r", "x"])

    got = rows.select("_v").mapInArrow(run, "r long, x array<double>").toArrow().sort_by("r")
    r = got.column("r").to_numpy()
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    return [np.unique(np.r_[c, x[r == i]], axis=0) for i, c in enumerate(centres)]


def _spread_out(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of few weighted points, each far from those before it (k-means++), then moved by a few rounds."""
    chosen = [points[rng.choice(len(points), p=weight / weight.sum())]]
    while len(chosen) < k:
        d = weight * _nearest(points, np.array(chosen))[1]
        chosen.append(points[rng.choice(len(points), p=d / d.sum())] if d.sum() > 0 else chosen[-1])
    c = np.array(chosen)
    for _ in range(10):
        near = _nearest(points, c)[0]
        n = np.bincount(near, weight, k)
        c = np.where(n[:, None] > 0, np.stack([np.bincount(near, weight * v, k) for v in points.T], 1) / np.maximum(n, 1e-300)[:, None], c)
    return c


def segment(
    feats: DataFrame, k: int = 6, restarts: int = 10, seed: int = 42, cols: Sequence[str] = FEATURES, rounds: int = 12, tol: float = 1e-4
) -> tuple[DataFrame, DataFrame]:
    """Cluster the outlets; returns (rows with cluster_id, centroids) (ML-01).

    All restarts share each pass over the rows: centres are drawn as in k-means||, then a round assigns a row to the
    centres of every restart at once and adds up one row per centre.  The restart of the least cost is kept; rows go to
    their nearest centre.  A restart that has stopped moving waits for the others.  With fewer distinct rows than ``k``
    there are as many clusters as distinct rows.
    """
    spark = feats.sparkSession
    df = checkpointed(standardised(feats, cols).withColumn("_v", F.array(*[f"z_{c}" for c in cols])).drop(*[f"z_{c}" for c in cols]))
    first = df.select("_v").orderBy(F.xxhash64("_v", F.lit(seed))).limit(restarts).collect()
    if not first:
        return df.drop("_v").withColumn("cluster_id", F.lit(0)), spark.createDataFrame([], "cluster_id int, " + ", ".join(f"{c} double" for c in cols))
    centres = [np.array([first[i % len(first)][0]]) for i in range(restarts)]
    for step in range(2):
        cost = _passed(df, centres)[2]
        centres = _drawn(df, centres, cost, 2.0 * k, seed + step)
    weight = _passed(df, centres)[1]
    rng = np.random.default_rng(seed)
    now = []
    for c, w in zip(centres, weight):
        chosen = np.unique(_spread_out(c[w > 0], w[w > 0], k, rng), axis=0)
        now.append(chosen)
    for _ in range(rounds):
        sums, n, cost = _passed(df, now)
        # A centre without rows is dropped.
        moved = [s[m > 0] / m[m > 0][:, None] for s, m in zip(sums, n)]
        still = all(len(a) == len(b) and np.abs(a - b).max() <= tol for a, b in zip(now, moved))
        now = moved
        if still:
            break
    cost = _passed(df, now)[2]
    best = now[int(np.argmin(np.where([len(c) == max(map(len, now)) for c in now], cost, np.inf)))]
    best = best[np.lexsort(best.T[::-1])]
    rows = [(i, *map(float, c)) for i, c in enumerate(best)]
    # Squared distances to k centres, on the JVM; the first of equal ones is taken.
    far = [sum((F.col("_v")[j] - F.lit(float(v))) ** 2 for j, v in enumerate(c)) for c in best]
    near = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far)]))
    centroids = spark.createDataFrame(rows, "cluster_id int, " + ", ".join(f"{c} double" for c in cols))
    return df.withColumn("cluster_id", near["i"]).drop("_v"), centroids


def name_clusters(centroids: DataFrame) -> DataFrame:
    """Names from ordered thresholds on the centroids, numbered when repeated (ML-02, WIN-12).

    There is one row per cluster.
    """
    adv, gr, vol = F.col("avg_daily_value"), F.col("growth_30d"), F.col("volatility")
    base = (
        F.when((adv > 0.6) & (gr > 0.2), "Premium Growth Engine")
        .when((adv > 0.6) & (vol < 0), "Stable High-Throughput")
        .when(vol > 0.8, "Volatile — Tighter Replenishment")
        .when(gr < -0.3, "Declining — Intervention Needed")
        .when((adv < -0.3) & (F.col("active_days") < 0), "Low-Productivity — Rationalize")
        .otherwise("Steady Mid-Tier")
    )
    n = F.row_number().over(Window.partitionBy("_base").orderBy("cluster_id"))
    name = F.when(n == 1, F.col("_base")).otherwise(F.concat("_base", F.lit(" "), n.cast("string")))
    return centroids.select("cluster_id", base.alias("_base")).withColumn("segment", name).drop("_base")


def segment_summary(feats: DataFrame, by_base_name: bool = False) -> DataFrame:
    """Size, means and stocking advice per segment (AGG-05).

    A numbered name is not in the advice table and gets the default, as in the
    source system; ``by_base_name`` looks up the name without its number.
    """
    key = F.regexp_replace("segment", r" \d+$", "") if by_base_name else F.split(F.col("segment"), r" \(")[0]
    advice = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in STOCKING.items() for x in kv]), key),
        F.lit(DEFAULT_STOCKING),
    )
    return (
        feats.groupBy("cluster_id", "segment")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.avg("avg_daily_value").alias("avg_daily_value"),
            F.avg("growth_30d").alias("growth_30d"),
            F.avg("volatility").alias("volatility"),
        )
        .withColumn("recommended_stocking", advice)
    )


# --- isolation forest ---------------------------------------------------------------


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n - 1, 1.0)
    c = 2 * (np.log(m) + np.euler_gamma) - 2 * m / np.maximum(n, 1.0)
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, split, left, right, path length at a leaf) of one tree, root first."""
    nodes: list[tuple[int, float, int, int, float]] = []
    todo = [(x, 0, -1, False)]
    while todo:
        rows, depth, parent, right = todo.pop()
        me = len(nodes)
        if parent >= 0:
            f, s, l, r, p = nodes[parent]
            nodes[parent] = (f, s, l, me, p) if right else (f, s, me, r, p)
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes.append((-1, 0.0, -1, -1, depth + float(_average_path(len(rows)))))
            continue
        f = int(rng.choice(spread))
        s = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        nodes.append((f, s, -1, -1, 0.0))
        low = rows[:, f] <= s
        todo.append((rows[~low], depth + 1, me, True))
        todo.append((rows[low], depth + 1, me, False))
    return nodes


def drawn_share(n: int, sample: int) -> float:
    """Chance that a row joins a tree: 1.25 * sample of n rows do on average, for any n."""
    return min(1.0, 1.25 * sample / max(n, 1))


def trees_joined(row_id: str, share: float, trees: int, seed: int) -> Column:
    """Numbers of the trees that a row joins, each with chance ``share``, by geometric skips.

    A hash of the row says how many trees it skips before the first one it joins, a further hash how many until the
    next.  At large n nearly all rows skip every tree, so a row costs one hash; no hash depends on where the row is read.
    """
    if share >= 1:
        return F.sequence(F.lit(0), F.lit(trees - 1))
    log_stay = float(np.log1p(-share))

    def following(step: Column) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(F.col(row_id), step, F.lit(seed)), 11) + 0.5) / float(1 << 53)
        return F.floor(F.least(F.log(unit) / F.lit(log_stay), F.lit(float(trees)))).cast("int")

    def on(joined: Column, step: Column) -> Column:
        last = F.element_at(joined, -1)
        return F.when(last >= trees, joined).otherwise(F.concat(joined, F.array(last + 1 + following(step))))

    first = following(F.lit(0))
    skips = F.aggregate(F.sequence(F.lit(1), F.lit(trees)), F.array(first), on)
    return F.when(first < trees, F.filter(skips, lambda t: t < trees)).otherwise(F.array().cast("array<int>"))


def fit_forest(
    df: DataFrame, cols: Sequence[str], row_id: str, trees: int = 100, sample: int = 256, seed: int = 42
) -> list[list[tuple[int, float, int, int, float]]]:
    """Grow the trees in parallel, each on a hashed sample of about ``sample`` rows (ML-03).

    Rows choose their trees by ``trees_joined``, so about trees*sample rows are
    shuffled in total and no tree sees more than it should.  The forest is
    bounded by trees * 2 * sample nodes and comes back to the driver.
    """
    n = df.count()
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]
    sampled = df.select(row_id, *x, F.explode(trees_joined(row_id, drawn_share(n, sample), trees, seed)).alias("tree"))
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, t])
        pdf = pdf.sort_values(row_id)
        rows = pdf[list(cols)].to_numpy(dtype=float)
        if len(rows) > sample:
            rows = rows[rng.choice(len(rows), sample, replace=False)]
        f, s, l, r, p = zip(*_grow(rows, rng, limit))
        return pd.DataFrame({"tree": [t], "f": [list(f)], "s": [list(s)], "l": [list(l)], "r": [list(r)], "p": [list(p)]})

    schema = "tree int, f array<int>, s array<double>, l array<int>, r array<int>, p array<double>"
    grown = sampled.groupBy("tree").applyInPandas(grow, schema).collect()
    if n and len(grown) < trees:
        raise ValueError(f"{trees - len(grown)} of {trees} trees got none of {n} rows")
    return [list(zip(g.f, g.s, g.l, g.r, g.p)) for g in grown]


def forest_score(forest: list, cols: Sequence[str], sample: int) -> Column:
    """Anomaly score in (0, 1] per row; high is unusual.  Arrow batches."""
    packed = [tuple(np.array(a) for a in zip(*t)) for t in forest]
    norm = float(_average_path(sample))

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.column_stack([b.to_numpy(dtype=float) for b in batch])
            depth = np.zeros(len(x))
            for f, s, l, r, p in packed:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    inner = np.flatnonzero(f[at] >= 0)
                    if len(inner) == 0:
                        break
                    i = at[inner]
                    at[inner] = np.where(x[inner, f[i]] <= s[i], l[i], r[i])
                depth += p[at]
            yield pd.Series(np.power(2.0, -depth / max(len(packed), 1) / max(norm, 1e-12)))

    return score(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])


def anomaly_reason() -> Column:
    """Reasons in fixed order, or a default text; null when not flagged (ML-04)."""
    g, v = F.col("growth_30d"), F.col("volatility")
    pct = F.format_string("%.0f", half_even(g * 100))
    parts = kept(
        F.when(g < -0.3, F.concat(F.lit("Sharp decline: last 30d revenue down "), pct, F.lit("% vs prior 30d"))),
        F.when(g > 0.5, F.concat(F.lit("Sudden spike: last 30d revenue up "), pct, F.lit("% vs prior 30d"))),
        F.when(v > 1.0, F.concat(F.lit("High volatility (CV="), F.format_string("%.2f", half_even(v, 2)), F.lit(")"))),
        F.when(F.col("dormant"), F.lit("No sales in last 30 days")),
    )
    default = "Unusual combination of volume, trend and volatility vs population"
    joined = F.when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise(default)
    return F.when(F.col("anomaly"), joined)


def anomalies(
    feats: DataFrame, contamination: float = 0.08, row_id: str = "outlet_code", trees: int = 100, sample: int = 256,
    seed: int = 42, cols: Sequence[str] = ANOMALY_FEATURES, hot: int = HOT_ROWS,
) -> DataFrame:
    """Isolation-forest score, flag for the top share, and reason text (ML-03, ML-04)."""
    n = feats.count()
    forest = fit_forest(feats, cols, row_id, trees, sample, seed)
    # Scored once: the cut-off and the flag both read the written scores.
    scored = checkpointed(feats.withColumn("anomaly_raw", forest_score(forest, cols, min(sample, max(n, 1)))))
    cut = group_quantile(scored, [], "anomaly_raw", 1 - contamination, "_cut", hot).select("_cut").scalar()
    return scored.withColumn("anomaly", F.col("anomaly_raw") > cut).withColumn("anomaly_reason", anomaly_reason())

"""Exact ranks and medians that never put a whole group into one task.

A range shuffle on (keys, order) spreads any group over many tasks.  Only
groups cut by a partition border need an offset, and there are fewer such pieces
than twice the number of partitions, so the offsets are broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions.skew import HOT_ROWS, join_stats, largest_group
from tallyworks.session import checkpointed


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def prefix_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], weight: str, out: str, hot: int = HOT_ROWS
) -> DataFrame:
    """Add ``out``: the weight of all earlier rows of the same group.

    The order must be unique inside a group.  Groups proven small use a plain
    window; otherwise the range-partitioned form is taken.  The partition number
    is fixed by a checkpoint, so a lost executor cannot move a border.
    """
    by = _order(order)
    if keys and largest_group(df, keys) <= hot:
        w = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(weight).over(w), F.lit(0)))
    # Without a fixed number, adaptive execution merges small neighbouring ranges; their order stays.
    ranged = checkpointed(
        df.repartitionByRange(*[F.col(k) for k in keys], *by).withColumn("_pid", F.spark_partition_id())
    )
    pieces = ranged.groupBy(*keys, "_pid").agg(F.sum(weight).alias("_t"))
    wk = Window.partitionBy(*keys).orderBy("_pid") if keys else Window.orderBy("_pid")
    # Without keys this window sees one row per partition; with keys, a group has
    # at most one row per partition.
    offs = pieces.withColumn("_off", F.sum("_t").over(wk.rowsBetween(Window.unboundedPreceding, -1))).where(
        F.col("_off").isNotNull()
    )
    names = [f"_k{i}" for i in range(len(keys))]
    offs = offs.select(*[F.col(k).alias(a) for k, a in zip(keys, names)], F.col("_pid").alias("_opid"), "_off")
    cond = F.col("_pid") == F.col("_opid")
    for k, a in zip(keys, names):
        cond = cond & F.col(k).eqNullSafe(F.col(a))
    inner = Window.partitionBy("_pid", *keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_in", F.coalesce(F.sum(weight).over(inner), F.lit(0)))
        .join(F.broadcast(offs), cond, "left")
        .withColumn(out, F.coalesce("_off", F.lit(0)) + F.col("_in"))
        .drop("_pid", "_opid", "_off", "_in", *names)
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], out: str = "rank", hot: int = HOT_ROWS
) -> DataFrame:
    """row_number() per group in a unique order, for groups of any size."""
    return (
        prefix_sum(df.withColumn("_one", F.lit(1)), keys, order, "_one", out, hot)
        .withColumn(out, (F.col(out) + 1).cast("long"))
        .drop("_one")
    )


def _frequencies(df: DataFrame, keys: Sequence[str], value: str, hot: int) -> DataFrame:
    """One row per (keys, value): its count and the rows of the group before it."""
    freq = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_cnt"))
    return prefix_sum(freq, keys, [F.col(value).asc_nulls_last()], "_cnt", "_before", hot)


def percent_rank_stats(
    df: DataFrame, keys: Sequence[str], value: str, out: str, hot: int = HOT_ROWS
) -> DataFrame:
    """One row per (keys, value): its average-tie percent rank and its row count ``_cnt``."""
    freq = _frequencies(df, keys, value, hot)
    if keys:
        total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
        freq = join_stats(freq, total, keys, "_total", [value], hot)
    else:
        freq = freq.withColumn("_total", df.agg(F.count(F.lit(1)).alias("n")).scalar())
    pct = (F.col("_before") + (F.col("_cnt") + 1) / 2) / F.col("_total")
    return freq.select(*keys, value, "_cnt", pct.alias(out))


def percent_rank_avg(
    df: DataFrame, keys: Sequence[str], value: str, out: str, row_id: Sequence[str], hot: int = HOT_ROWS,
    base: DataFrame | None = None,
) -> DataFrame:
    """Rank / group size, ties averaged, nulls ranked last (WIN-02, WIN-03).

    The rows meet their ranks by value, and a floating value computed twice may
    differ in its last bit, so both sides read one written frame.  With several
    ranks on one frame, pass that frame as ``base``.
    """
    if base is None:
        df = base = checkpointed(df)
    stats = percent_rank_stats(base, keys, value, out, hot)
    return join_stats(df, stats, [*keys, value], "_cnt", row_id, hot).drop("_cnt")


def percent_ranks(
    base: DataFrame, ranks: Mapping[str, tuple[Sequence[str], str]], row_id: str, hot: int = HOT_ROWS
) -> DataFrame:
    """Several ranks like ``percent_rank_avg`` in one pass: ``ranks`` maps a new column to (group keys, value).

    The values are stacked as rows (rank, group, value), counted once, summed up
    once and looked up once.  ``base`` must be a written frame with one row per ``row_id``.
    """
    names = list(ranks)
    keys = list(dict.fromkeys(k for group, _ in ranks.values() for k in group))
    kinds = dict(base.dtypes)

    def row(i: int) -> Column:
        group, value = ranks[names[i]]
        own = [(F.col(k) if k in group else F.lit(None).cast(kinds[k])).alias(f"_rk{n}") for n, k in enumerate(keys)]
        return F.struct(F.lit(i).alias("_m"), *own, F.col(value).cast("double").alias("_v"))

    g = ["_m", *[f"_rk{n}" for n in range(len(keys))]]
    long = base.select(F.col(row_id).alias("_row"), F.inline(F.array(*[row(i) for i in range(len(names))])))
    freq = _frequencies(long, g, "_v", hot)
    total = long.groupBy(*g).agg(F.count(F.lit(1)).alias("_total"))
    freq = join_stats(freq, total, g, "_total", ["_v"], hot)
    pct = (F.col("_before") + (F.col("_cnt") + 1) / 2) / F.col("_total")
    found = join_stats(long, freq.select(*g, "_v", "_cnt", pct.alias("_pct")), [*g, "_v"], "_cnt", ["_row"], hot)
    wide = found.groupBy("_row").agg(*[F.max(F.when(F.col("_m") == i, F.col("_pct"))).alias(n) for i, n in enumerate(names)])
    return base.join(wide, base[row_id].eqNullSafe(F.col("_row"))).drop("_row")


def rank_min(
    df: DataFrame, keys: Sequence[str], value: str, out: str, row_id: Sequence[str], hot: int = HOT_ROWS
) -> DataFrame:
    """1 + number of group rows with a lower value (WIN-07)."""
    df = checkpointed(df)
    freq = _frequencies(df, keys, value, hot).select(*keys, value, "_cnt", (F.col("_before") + 1).alias(out))
    return join_stats(df, freq, [*keys, value], "_cnt", row_id, hot).drop("_cnt")


def group_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, out: str = "quantile", hot: int = HOT_ROWS
) -> DataFrame:
    """Exact interpolated quantile per group, with the group's non-null count ``_n``.

    Small groups use the built-in aggregate.  It buffers distinct values, so a
    hot group instead picks its two neighbours from prefix counts.
    """
    vals = df.where(F.col(value).isNotNull()).select(*keys, value)
    if largest_group(vals, keys) <= hot:
        agg = F.median(value) if q == 0.5 else F.percentile(value, F.lit(q))
        return vals.groupBy(*keys).agg(agg.alias(out), F.count(F.lit(1)).alias("_n"))
    freq = _frequencies(vals, keys, value, hot)
    sizes = vals.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        f = join_stats(freq, sizes, keys, "_n", [value], hot)
    else:
        f = freq.withColumn("_n", sizes.scalar())
    pos = (F.col("_n") - 1) * F.lit(float(q))
    lo, hi = F.floor(pos), F.ceil(pos)

    def at(p: Column) -> Column:
        inside = (F.col("_before") <= p) & (p < F.col("_before") + F.col("_cnt"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    f = f.groupBy(*keys).agg(at(lo).alias("_lo"), at(hi).alias("_hi"), F.max("_n").alias("_n"))
    frac = pos - F.floor(pos)
    return f.select(*keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias(out), "_n")


def group_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "median", hot: int = HOT_ROWS
) -> DataFrame:
    """Exact interpolated median per group, with the group's non-null count ``_n``."""
    return group_quantile(df, keys, value, 0.5, out, hot)

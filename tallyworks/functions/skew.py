"""Joins and checks that hold when one key carries a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A group above this many rows is hot: it is never sorted or buffered in one task.
HOT_ROWS = 2_000_000
# Row limit under which a side may be broadcast.
BROADCAST_ROWS = 1_000_000


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on all keys; null keys match null keys."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; one number reaches the driver."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return n or 0


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``limit`` rows; reads no more than limit + 1."""
    return df.limit(limit + 1).count() <= limit


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its row count is proven small, else as it is."""
    return F.broadcast(df) if bounded(df, limit) else df


def _zero(never: Column) -> Column:
    """Salt 0 of the rows where ``never`` is false.

    A literal would be folded into the join condition, and the join would be dealt by the keys alone.
    """
    return never.cast("int").alias("_lsalt")


def join_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    n: str,
    spread: Sequence[str],
    hot: int = HOT_ROWS,
) -> DataFrame:
    """Left-join per-group statistics back to the rows of the groups.

    ``n`` is the group size in ``stats``.  Groups above ``hot`` rows are at most
    total/hot many, so their statistics are broadcast and their rows are spread
    over all tasks by ``spread`` (a row id); all others meet in one shuffle on
    the keys.  Both steps read the rows once.
    """
    extra = [c for c in stats.columns if c not in keys]
    hk, lk = [f"_h_{k}" for k in keys], [f"_l_{k}" for k in keys]
    heavy = stats.where(F.col(n) > hot).select(
        *[F.col(k).alias(a) for k, a in zip(keys, hk)], F.struct(*extra).alias("_hs")
    )
    light = stats.where(F.col(n) <= hot).select(
        *[F.col(k).alias(a) for k, a in zip(keys, lk)], F.struct(*extra).alias("_ls"), _zero(F.col(n) > hot)
    )
    on_heavy, on_light = F.lit(True), F.col("_salt") == F.col("_lsalt")
    for k, h, l in zip(keys, hk, lk):
        on_heavy = on_heavy & F.col(k).eqNullSafe(F.col(h))
        on_light = on_light & F.col(k).eqNullSafe(F.col(l))
    salt = F.when(F.col("_hs").isNotNull(), F.pmod(F.xxhash64(*spread), F.lit(4096)).cast("int") + 1)
    out = (
        rows.join(F.broadcast(heavy), on_heavy, "left")
        .withColumn("_salt", F.coalesce(salt, F.lit(0)))
        .join(light, on_light, "left")
        .withColumn("_s", F.coalesce("_hs", "_ls"))
    )
    return out.select(*rows.columns, *[F.col(f"_s.{c}").alias(c) for c in extra])


def spread_lookup(
    rows: DataFrame, table: DataFrame, key: str, spread: Sequence[str], hot: int = HOT_ROWS, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Left-join a table of one row per key to rows whose key is null or the same for any share of them.

    A table of at most ``limit`` (short) rows is broadcast.  Otherwise null keys, which meet nothing, and keys of over
    ``hot`` rows, known to the table or not, leave the shuffle by key: they are dealt over all tasks by a hash of
    ``spread``.  There are at most total/hot such keys, so their rows of the table are broadcast.
    """
    cols = [c for c in table.columns if c != key]
    if bounded(table, limit):
        return rows.join(F.broadcast(table), key, "left").select(*rows.columns, *cols)
    n = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    known = n.join(table, key, "left")
    found = F.struct(*cols)
    heavy = F.broadcast(known.where(F.col("_n") > hot).select(F.col(key).alias("_hk"), found.alias("_hs")))
    light = known.where(F.col("_n") <= hot).select(F.col(key).alias("_lk"), found.alias("_ls"), _zero(F.col("_n") > hot))
    apart = F.col(key).isNull() | F.col("_hk").isNotNull()
    dealt = rows.join(heavy, F.col(key) == F.col("_hk"), "left").withColumn(
        "_salt", F.when(apart, F.pmod(F.xxhash64(*spread), F.lit(4096)).cast("int") + 1).otherwise(0)
    )
    met = dealt.join(light, (F.col(key) == F.col("_lk")) & (F.col("_salt") == F.col("_lsalt")), "left")
    return met.withColumn("_s", F.coalesce("_hs", "_ls")).select(*rows.columns, *[F.col(f"_s.{c}").alias(c) for c in cols])


def spread_join(
    rows: DataFrame, other: DataFrame, keys: Sequence[str], spread: Sequence[str], hot: int = HOT_ROWS, cond: Column | None = None
) -> DataFrame:
    """Inner equi-join where a key may hold any share of ``rows``.

    A key of over ``hot`` rows is dealt over as many tasks as it takes by a hash of ``spread``, and the rows of ``other``
    are repeated for each of them.  There are at most total/hot such keys, so these are broadcast.  Null keys meet none.
    Both sides are dealt over a fixed number of tasks: neither is broadcast for the small file it was unpacked from, and
    tasks of few bytes are not put together, as a row may meet any number of rows.
    """
    n = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("_tasks")).where("_tasks > 1")
    heavy = F.broadcast(n.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], "_tasks"))

    def told(df: DataFrame) -> DataFrame:
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & (df[k] == heavy[f"_h{i}"])
        return df.join(heavy, on, "left").withColumn("_tasks", F.coalesce("_tasks", F.lit(1))).drop(*[f"_h{i}" for i in range(len(keys))])

    left = told(rows).withColumn("_deal", F.pmod(F.xxhash64(*spread), F.col("_tasks")).cast("int")).drop("_tasks")
    right = told(other).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1))).drop("_tasks")
    spark, on = rows.sparkSession, [*keys, "_deal"]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    met = left.repartition(tasks, *on).join(right.repartition(tasks, *on).hint("merge"), on)
    return (met if cond is None else met.where(cond)).drop("_deal")

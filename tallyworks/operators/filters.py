"""Row filters, searches, facets and capped lists shared by all applications."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equals(df: DataFrame, wanted: Mapping[str, object], limit: int | None = None, order: str | None = None) -> DataFrame:
    """Rows equal to all given values; None means any (FLT-04)."""
    for c, val in wanted.items():
        if val is not None:
            df = df.where(F.col(c) == val)
    if order is not None:
        df = df.orderBy(order)
    return df if limit is None else df.limit(limit)


def lookup_row(df: DataFrame, key: str, value: object, side: DataFrame) -> DataFrame:
    """One row with its optional side row (FLT-05)."""
    return df.where(F.col(key) == value).join(side, key, "left")


def search(df: DataFrame, cols: Sequence[str], text: str) -> DataFrame:
    """Rows where any column contains the text, ignoring case (FLT-06)."""
    q = text.strip().lower()
    if not q:
        return df
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(q)), F.lit(False))
    return df.where(hit)


def search_tokens(df: DataFrame, cols: Sequence[str], text: str) -> DataFrame:
    """Rows where every token is found in at least one column (FLT-07)."""
    for token in text.lower().split():
        df = search(df, cols, token)
    return df


def facet(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-empty values (SET-08)."""
    return df.select(col).where(F.col(col) != "").distinct().orderBy(col)


def case_rows(df: DataFrame, case: object | None = None, col: str = "case_id") -> DataFrame:
    """Rows of one case (FLT-17)."""
    return df if case is None else df.where(F.col(col) == case)


def global_or_case(df: DataFrame, case: object, col: str = "case_id") -> DataFrame:
    """Rows without a case or of the given one (FLT-12, GRF-01)."""
    return df.where(F.col(col).isNull() | (F.col(col) == case))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """First k rows per group (TOP-10, TOP-11).

    Spark keeps only k rows per group in each task before the shuffle (a rank
    limit below the window), so a group of any size arrives as k rows per task.
    """
    name = rank or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def without_ids(df: DataFrame, drop: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the list (SET-06)."""
    return df.join(drop.select(key), key, "left_anti")


def first_wins(frames: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Union of the frames, first row per key in frame order, then by ``order`` (SET-02, SET-03).

    min_by combines map-side.  Its structs are sorted, not hashed: with ``tasks`` given, rows are dealt over so many tasks
    by key and a salt of the order, then the firsts of the salts by key, so that a task sorts its share of the rows only.
    """
    both = None
    for i, f in enumerate(frames):
        t = f.withColumn("_frame", F.lit(i))
        both = t if both is None else both.unionByName(t, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_frame"]
    first = F.min_by(F.struct(*rest), F.struct("_frame", *order)).alias("_r")
    if tasks is not None:
        salted = both.withColumn("_salt", F.pmod(F.xxhash64("_frame", *order), F.lit(16)).cast("int")).repartition(tasks, *keys, "_salt")
        both = salted.groupBy(*keys, "_salt").agg(F.min_by(F.struct("_frame", *rest), F.struct("_frame", *order)).alias("_r"))
        both = both.select(*keys, "_r.*").repartition(tasks, *keys)
    return both.groupBy(*keys).agg(first).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])

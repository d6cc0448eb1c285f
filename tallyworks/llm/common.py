"""Helpers of the operators: tables in the shared folder, spread rows, batches of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.session import new_path

# Bytes of text that one numpy step works on; temporaries are a small multiple of it.
PIECE_BYTES = (1 << 20) - 1
# Bytes of rows that an Arrow batch takes to Python: the JVM and the worker hold several copies of each.
BATCH_BYTES = 1 << 20
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: no lineage, column pruning and statistics stay."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold about ``BATCH_BYTES``, unless it has a limit of its own; no rows change."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores is dealt over all of them; one of many splits stays as it is.

    Changes the plan only.  The deal is by a hash of the row, so that a task that runs again gets the same rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) > 1 or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *[c for c, kind in df.dtypes if kind in ("bigint", "int", "string")][:1])


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each, but a whole row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        ends = offsets(col)[1:] - offsets(col)[0]
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(ends.searchsorted(base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def offsets(col: pa.Array):
    """Byte offsets of a string column, one more than rows."""
    import numpy as np

    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


def data(col: pa.Array):
    """(bytes, offsets from 0) of a string column without copying; null rows are empty."""
    import numpy as np

    at = offsets(col)
    raw = col.buffers()[2]
    whole = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """Add each ``out: column`` of ``sums``: the column's total over all earlier rows of the group.

    A range shuffle by (keys, order) spreads a group of any size over many tasks.  The written frame fixes which
    task had which rows.  Only groups cut by a border need an offset: at most two pieces per task, so these are
    broadcast.  Rows that tie in the whole order are summed in any order.
    """
    by = [F.col(k).asc_nulls_last() for k in [*keys, *order]]
    ranged = written(df.repartitionByRange(*by).withColumn("_pid", F.spark_partition_id()), name)
    totals = [F.sum(c).alias(f"_t_{o}") for o, c in sums.items()]
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    cut = ranged.groupBy(*keys, "_pid").agg(*totals).withColumn("_from", F.lag("_pid").over(before.rowsBetween(-1, -1)))
    cut = cut.withColumns({f"_o_{o}": F.sum(f"_t_{o}").over(before) for o in sums}).where(F.col("_from").isNotNull())
    offsets_ = cut.select(
        F.struct(*keys).alias("_key") if keys else F.lit(0).alias("_key"),
        F.col("_pid").alias("_at"), *[f"_o_{o}" for o in sums],
    )
    inner = Window.partitionBy("_pid", *keys).orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    out = ranged.withColumns({f"_i_{o}": F.coalesce(F.sum(c).over(inner), zero) for o, c in sums.items()})
    key = F.struct(*keys) if keys else F.lit(0)
    out = out.join(F.broadcast(offsets_), (F.col("_pid") == F.col("_at")) & key.eqNullSafe(F.col("_key")), "left")
    return out.select(*df.columns, *[(F.col(f"_i_{o}") + F.coalesce(f"_o_{o}", zero)).alias(o) for o in sums])

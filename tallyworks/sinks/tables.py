"""Table writers, export cells, and merges by key (SNK-01 to SNK-12)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.numbers import finite_or_null


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, replaced; with partition columns only their folders are (SNK-01)."""
    w = df.write.mode("overwrite")
    if by:
        w = w.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    w.parquet(path)


def clean_floats(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column (SNK-02)."""
    return df.withColumns({c: finite_or_null(c) for c, t in df.dtypes if t in ("double", "float")})


def write_json(df: DataFrame, path: str) -> None:
    """Nested JSON lines without NaN (SNK-02, SNK-04)."""
    clean_floats(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv_cells(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fixed fields as text: nested values as JSON, times ISO, null empty (SNK-03)."""
    kinds = dict(df.dtypes)

    def cell(c: str) -> Column:
        t = kinds[c]
        if t.startswith(("array", "map", "struct")):
            v = F.to_json(c)
        elif t.startswith("timestamp"):
            v = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        else:
            v = F.col(c).cast("string")
        return F.coalesce(v, F.lit("")).alias(c)

    return df.select(*[cell(c) if c in kinds else F.lit("").alias(c) for c in fields])


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    csv_cells(df, fields).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", "\"").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append-only log (SNK-09)."""
    df.write.mode("append").parquet(path)


def export_run(frames: Mapping[str, DataFrame], root: str, run_id: str, csv_fields: Mapping[str, Sequence[str]]) -> str:
    """All files of one run under root/run_id, or none; CSV where fields are given, else JSON lines (SNK-05).

    Files are written to a folder of their own beside the runs, which is renamed when all are whole.  If one fails, the
    folder goes and a run of that name stays as it was.  Returns the folder of the run.
    """
    spark = next(iter(frames.values())).sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    staged, final = path_of(f"{root}/_staged-{run_id}-{uuid.uuid4().hex}"), path_of(f"{root}/{run_id}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        for name, df in frames.items():
            path = f"{staged}/{name}"
            if name in csv_fields:
                write_csv(df, path, csv_fields[name])
            else:
                write_json(df, path)
        if fs.exists(final):
            fs.delete(final, True)
        if not fs.rename(staged, final):
            raise OSError(f"could not rename {staged} to {final}")
    except BaseException:
        fs.delete(staged, True)
        raise
    return str(final)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key; inside a batch the last by ``order`` wins (SNK-06, SNK-10).

    max_by combines map-side, so repeated keys never gather in one task.
    """
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    last = F.max_by(F.struct(*rest), F.struct("_batch", *order)).alias("_r")
    return both.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert_columns(old: DataFrame, new: DataFrame, keys: Sequence[str], live: Sequence[str]) -> DataFrame:
    """Known keys keep all columns but the live ones; new keys are added whole (SNK-07).

    Both sides hold one row per key.
    """
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    j = o.join(n, on, "full")
    cols = []
    for c in old.columns:
        first, second = ("n", "o") if c in live else ("o", "n")
        cols.append(F.coalesce(f"{first}.{c}", f"{second}.{c}").alias(c))
    return j.select(*cols)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Add the rows whose key is not there yet (SNK-08)."""
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def finish_run(runs: DataFrame, run_id: str, exit_status: int, counts: Mapping[str, int]) -> DataFrame:
    """Close one run with its status and counts (SNK-08)."""
    this = F.col("run_id") == run_id
    text = json.dumps(dict(counts), separators=(",", ":"))
    return runs.withColumns(
        {
            "exit_status": F.when(this, F.lit(exit_status)).otherwise(F.col("exit_status")),
            "counts": F.when(this, F.lit(text)).otherwise(F.col("counts")),
        }
    )


def index_manifest(chunks: DataFrame) -> DataFrame:
    """Chunk and document counts of an index (SNK-11)."""
    return chunks.agg(F.count(F.lit(1)).alias("chunk_count"), F.countDistinct("document_id").alias("doc_count"))

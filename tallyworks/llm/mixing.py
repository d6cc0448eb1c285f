"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its shuffled documents, as often as it may be
repeated.  A document's virtual finish time is the number of source words up to
its end over the source's target.  All queues are merged in the order of finish
times by a global range sort and cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import documents, n_words, running_sums, written
from tallyworks.llm.registry import query

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS
) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size), one per source.

    Sources by code point, null last, take the weights in turn.  The level that all open sources share is found
    where the sources, by the level at which they are full, first fit; at most ``repeats`` times its size goes to one.
    """
    ranked = running_sums(sizes.withColumn("one", F.lit(1).cast("long")), [], ["source"], {"rank": "one"}, "sources")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * repeats).alias("cap"))
    filled = filled.withColumn("full", F.col("cap") / F.col("weight"))
    filled = running_sums(filled, [], ["full", "source"], {"caps": "cap", "weights": "weight"}, "levels")
    total = filled.agg(F.sum("source_size").alias("t"), F.sum("weight").alias("w")).first()
    level = (F.lit(share) * (total["t"] or 0) - F.col("caps")) / (F.lit(total["w"] or 1) - F.col("weights"))
    fits = filled.where(level <= F.col("full")).agg(F.min_by(level, F.struct("full", "weights")).alias("level")).first()[0]
    capped = F.col("cap").cast("double")
    target = capped if fits is None else F.least(capped, F.lit(fits) * F.col("weight"))
    return filled.select("source", "source_size", target.alias("target"))


def weighted_mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
) -> DataFrame:
    """Rows (row, doc_id, th, size, source_size, target, copy, before, taken): every copy that a source may send.

    ``th`` is the hash of the text and ``row`` numbers the input rows, so repeated rows stay apart.  ``before`` is the
    number of words ahead of the copy in the mix, ``taken`` tells whether the copy lies within the budget.  Null texts
    have no words; a null source is a source.  The order depends on ids and texts only, so that reruns agree.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(source).cast("string").alias("source"),
        n_words(F.col(text)).alias("size"), F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, share, repeats), "targets")
    deal = F.md5(F.concat_ws(":", F.col("copy").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    copies = rows.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(repeats)]))).withColumn("deal", deal)
    queued = running_sums(copies, ["source"], ["copy", "deal", "th", "row"], {"queued": "size"}, "queues")
    # The source's target is looked up per row; targets are one row per source, and the join is split where a source is hot.
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    timed = queued.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    finish = F.when(F.col("target") > 0, (F.col("queued") + F.col("size")) / F.col("target")).otherwise(0.0)
    timed = timed.withColumn("finish", finish)
    merged = running_sums(timed, [], ["finish", "source", "copy", "deal", "th", "row"], {"before": "size"}, "mix")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    # Sums of doubles may differ in the last bit, words are whole: half a word settles it.
    return merged.select(
        "row", "doc_id", "th", "source", "size", "source_size", "target", "copy", "before",
        (F.col("before") + F.col("size") <= F.lit(budget) + 0.5).alias("taken"),
    )


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, CAST(list_extract([3, 1, 2], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS BIGINT) AS weight FROM s
), f AS (
  SELECT *, 2 * source_size AS cap, CAST(2 * source_size AS DOUBLE) / weight AS f FROM r
), l AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM s)
             - coalesce(sum(cap) OVER (ORDER BY f, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER (ORDER BY f DESC, source DESC NULLS FIRST ROWS UNBOUNDED PRECEDING)) AS level
  FROM f
), t AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), weight * (SELECT level FROM l WHERE level <= f ORDER BY f, source NULLS LAST LIMIT 1)) AS target
  FROM f
), c AS (
  SELECT d.*, source_size, target, copy, md5(copy || ':' || doc_id) AS deal
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source CROSS JOIN (VALUES (0), (1)) v(copy)
), q AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY copy, deal ROWS UNBOUNDED PRECEDING) AS DOUBLE) / target AS finish FROM c
), m AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, copy, deal ROWS UNBOUNDED PRECEDING) AS total FROM q
)
SELECT doc_id, size, source_size, target,
       CAST(sum(CASE WHEN total <= (SELECT sum(target) FROM t) + 0.5 THEN size ELSE 0 END) AS BIGINT) AS taken
FROM m GROUP BY ALL
"""


@query("op5_weighted_mix", SQL)
def op5_weighted_mix(spark: SparkSession, folder: str) -> DataFrame:
    mix = weighted_mix(documents(spark, folder))
    taken = F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken")
    return mix.groupBy("row", "doc_id", "size", "source_size", "target").agg(taken).drop("row")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents as often as the mix takes them, with ``mix_position``: the words ahead of the copy.

    Rows equal in id and text are one document here.
    """
    once = docs.withColumn("_mix_th", F.xxhash64(text)).dropDuplicates([doc_id, "_mix_th"])
    taken = weighted_mix(once, doc_id, text, source).where("taken").select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("before").alias("mix_position")
    )
    met = once.join(taken, (once["_mix_th"] == taken["_th"]) & once[doc_id].cast("long").eqNullSafe(taken["_id"]))
    return met.select(*docs.columns, "mix_position")

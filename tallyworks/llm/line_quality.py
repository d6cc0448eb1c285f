"""Quality rules: per-document measures, and lines that too many documents of a source share.

Normalised lines are hashed; for every (source, line) the distinct documents are
counted, exact copies once.  Lines above the limit are taken out, and documents
that lose most of their words or end up too short are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions.skew import small
from tallyworks.llm.common import data, documents, pieces, written
from tallyworks.llm.registry import query
from tallyworks.llm.words import mix, spaces, window_hashes, window_starts, word_hashes, words

MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
# A line is frequent in a source if so many of its distinct documents hold it, and this share of them.
LINE_DOCS = 20
LINE_SHARE = 0.01
# A document is depleted if less than this share of its words stays, or too few words for a document and less than half.
DEPLETED = 0.2

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,words:long>>"
)


def _per_document(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[0, np.cumsum(values, dtype=np.int64)][ends])


def _repeat_words(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Per document: words covered by a window of k words that its text holds twice or more."""
    inside = window_starts(first, k)
    covered = np.zeros(int(first[-1]) + 1, np.int32)
    if inside.any():
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(inside)]
        own = window_hashes(h, k)[inside] ^ mix(doc[inside].astype(np.uint64) + np.uint64(1))
        ordered = np.sort(own)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            at = np.flatnonzero(inside)[np.isin(own, twice)]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + k, -1)
    return _per_document(np.cumsum(covered[:-1]) > 0, first)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by MEASURES: base measures of whole texts, and each distinct line with its words.

    A null text has no words and no lines.  Lines are compared in lower case (A-Z) with single spaces.
    """
    kept = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        symbol = np.zeros(256, bool)
        symbol[list(SYMBOLS)] = True
        for piece in pieces(batches, text):
            raw, ends = data(piece.column(len(kept)))
            start, end, first = words(raw, ends)
            points = _per_document(~spaces(raw) & ((raw & 0xC0) != 0x80), ends)
            symbols = _per_document(symbol[raw], ends)
            repeats = _repeat_words(word_hashes(raw, start, end), first, REPEAT_WINDOW)
            blob, dup, lines = raw.tobytes(), [], []
            for i in range(piece.num_rows):
                seen, again, own = set(), 0, {}
                for line in blob[ends[i] : ends[i + 1]].split(b"\n"):
                    found = line.lower().split()
                    if found:
                        again += line in seen
                        seen.add(line)
                        k = xxh64_intdigest(b" ".join(found))
                        k -= (k >> 63) << 64
                        own[k] = own.get(k, 0) + len(found)
                dup.append(again)
                lines.append([{"h": k, "words": v} for k, v in own.items()])
            kind = pa.list_(pa.struct([("h", pa.int64()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:-1], pa.array(np.diff(first)), pa.array(points), pa.array(symbols), pa.array(dup, pa.int64()), pa.array(repeats), pa.array(lines, kind)],
                [*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    return docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(text)).mapInArrow(run, schema + MEASURES)


def frequent_lines(lines: DataFrame, min_docs: int = LINE_DOCS, share: float = LINE_SHARE) -> DataFrame:
    """Rows (host, h) of lines above both limits, from rows (host, th, h); th tells distinct documents apart."""
    n_docs = small(lines.groupBy("host").agg(F.count_distinct("th").alias("docs")))
    counts = lines.distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    return counts.join(n_docs, "host").where(F.col("n") >= F.col("docs") * share).select("host", "h")


def line_report(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    min_docs: int = LINE_DOCS, share: float = LINE_SHARE, depleted: float = DEPLETED,
) -> DataFrame:
    """One row per document: its measures, base_failed, removed_words, removed (hashes of lines) and kept.

    A null source is the source named by the empty text.  Repeated rows are judged alike.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("host"), F.xxhash64(text).alias("th"), F.col(text).alias("text"),
    )
    # Python reads the text once; what stays is narrow, and written, so that row numbers hold.
    rows = written(measures(rows), "measures")
    lines = rows.select("row", "host", "th", F.explode("lines").alias("l")).select("row", "host", "th", "l.h", "l.words")
    often = small(written(frequent_lines(lines.select("host", "th", "h"), min_docs, share), "frequent"))
    removed = lines.join(often, ["host", "h"]).groupBy("row").agg(
        F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("h")).alias("removed")
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    spent = (F.col("removed_words") > 0) & ((left < F.col("n_words") * depleted) | (left < MIN_WORDS) & (2 * left < F.col("n_words")))
    return (
        rows.join(removed, "row", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~base_failed & ~spent)
        .drop("lines", "host", "row")
    )


def cleaned(docs: DataFrame, report: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Kept documents without their frequent lines: ``docs`` with ``text`` shortened."""
    found = report.where("kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("removed").alias("_removed"))
    found = found.dropDuplicates(["_id", "_th"])
    met = docs.join(found, docs[doc_id].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text]) == F.col("_th")))
    kind = met.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            at = batch.schema.get_field_index(text)
            out = []
            for t, gone in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if t is not None and gone:
                    names = {k & 0xFFFFFFFFFFFFFFFF for k in gone}
                    lines = t.split("\n")
                    t = "\n".join(x for x in lines if xxh64_intdigest(b" ".join(x.encode().lower().split())) not in names)
                out.append(t)
            yield batch.set_column(at, text, pa.array(out, batch.schema.field(at).type))

    return met.mapInArrow(run, kind).select(*docs.columns)


SQL = """
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), b AS (
  SELECT doc_id, host, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM t
), u AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t
), g AS (
  SELECT doc_id, i, count(*) OVER f AS n, string_agg(word, ' ') OVER f AS k
  FROM u WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), c AS (
  SELECT doc_id, i, CASE WHEN n = 8 AND count(*) OVER (PARTITION BY doc_id, n, k) > 1 THEN 1 ELSE 0 END AS twice FROM g
), r AS (
  SELECT doc_id, sum(hit) AS n_repeat_words FROM (
    SELECT doc_id, max(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit FROM c
  ) GROUP BY 1
), l AS (
  SELECT doc_id, host, md5(text) AS th, unnest(string_split(text, chr(10))) AS line FROM t
), v AS (
  SELECT doc_id, host, th, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM l
), x AS (
  SELECT doc_id, host, th, line, array_to_string(w, ' ') AS h, len(w) AS words FROM v WHERE len(w) > 0
), y AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM x GROUP BY 1
), d AS (
  SELECT host, count(DISTINCT th) AS docs FROM x GROUP BY 1
), o AS (
  SELECT host, h FROM x JOIN d USING (host) GROUP BY host, h, docs HAVING count(DISTINCT th) >= 20 AND count(DISTINCT th) >= docs * 0.01
), z AS (
  SELECT doc_id, sum(words) AS gone FROM x JOIN o USING (host, h) GROUP BY 1
), a AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(gone, 0) AS gone, n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed
  FROM b LEFT JOIN r USING (doc_id) LEFT JOIN y USING (doc_id) LEFT JOIN z USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (gone > 0 AND (n_words - gone < n_words * 0.2 OR n_words - gone < 20 AND 2 * (n_words - gone) < n_words)) AS kept
FROM a
"""


@query("op3_line_quality", SQL)
def op3_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

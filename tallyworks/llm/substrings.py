"""Substring dedup: words of windows that occur earlier in the corpus are removed.

A window is ``width`` consecutive words.  Its key is the smallest hash of the
``gram``-word runs inside it, so equal windows have equal keys, and a key occurs
at least as often as any window that holds it.  Tasks count keys in partition
sketches (one row of counters per slice of the hash range); merged, they
overestimate the count of every window.  A second pass hashes only windows whose
estimate is two or more, keeps the first of equal ones inside each batch, and
one shuffle by the 96-bit window hash finds the first of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.llm.common import data, documents, pieces, written
from tallyworks.llm.registry import query
from tallyworks.llm.words import word_digests, window_hashes, window_starts, words

WIDTH = 20
GRAM = 6
# Text bytes behind one slice of the sketch; the number of slices follows the corpus.
SLICE_BYTES = 1 << 29
# Repeated counters that one pass may broadcast: 8 bytes each.  More of them take more passes.
PASS_CELLS = 1 << 23


def _sliding(a: np.ndarray, k: int, fn) -> np.ndarray:
    """fn over every k neighbours, by doubling."""
    n, size = len(a) - k + 1, 1
    while size * 2 <= k:
        a = fn(a[:-size], a[size:])
        size *= 2
    return fn(a[:n], a[k - size : k - size + n])


def _keys(h: np.ndarray, first: np.ndarray, width: int, gram: int):
    """(whether a window of one document starts at a word, key of each window, hashes of the runs that are keys)."""
    inside = window_starts(first, width)
    if not inside.any():
        return inside, np.empty(0, np.uint64), np.empty(0, np.uint64)
    runs = window_hashes(h, gram)
    span = width - gram + 1
    key = _sliding(runs, span, np.minimum)
    # A run counts once at its place if it is the key of any window of one document over it.
    held = np.where(inside, key, np.uint64(0))
    padded = np.zeros(len(runs) + span - 1, np.uint64)
    padded[span - 1 : span - 1 + len(held)] = held
    taken = _sliding(padded, span, np.maximum) == runs
    return inside, key, runs[taken]


def partition_sketches(df: DataFrame, text: str, width: int, gram: int, bits: int) -> DataFrame:
    """Rows (slice, once, more): counters of one batch, those at one and those above, 2^32 to a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def send(found: list[np.ndarray]) -> pa.RecordBatch:
            cell = np.sort(np.concatenate(found)) >> np.uint64(32 - bits)
            cell, n = np.unique(cell, return_counts=True)
            part = (cell >> np.uint64(32)).astype(np.int64)
            ids, at = np.unique(part, return_index=True)
            rest, at = (cell & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.r_[at, len(cell)]
            cut = [(rest[a:b], n[a:b] > 1) for a, b in zip(at, at[1:])]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([r[~m].tobytes() for r, m in cut]), pa.array([r[m].tobytes() for r, m in cut])],
                ["slice", "once", "more"],
            )

        found: list[np.ndarray] = []
        held = 0
        for piece in pieces(batches, text):
            raw, ends = data(piece.column(0))
            start, end, first = words(raw, ends)
            found.append(_keys(word_digests(raw, start, end), first, width, gram)[2])
            held += len(found[-1])
            if held > 2_000_000:
                yield send(found)
                found, held = [], 0
        if held:
            yield send(found)

    return df.select(text).mapInArrow(run, "slice long, once binary, more binary")


def repeated_cells(sketches: DataFrame) -> DataFrame:
    """Counters of two or more after adding all partition sketches, one row each.

    A slice's counters are added in one task; slices are sized by SLICE_BYTES.
    """

    def merge(group: pa.Table) -> pa.Table:
        part = group.column("slice")[0].as_py()
        once = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("once")]))
        more = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("more")])
        cell = np.union1d(once[1:][once[1:] == once[:-1]], more)
        # A counter that one batch holds once and another more often is in ``more`` already.
        return pa.table({"cell": (np.int64(part) << np.int64(32)) + cell.astype(np.int64)})

    return sketches.groupBy("slice").applyInArrow(merge, "cell long")


def _candidates(df: DataFrame, width: int, gram: int, bits: int, cells) -> DataFrame:
    """Windows whose key is among the broadcast counters, first of equal ones in a batch; later ones as sure runs.

    Rows: h1, h2 (window hash, null for runs that are repeated for sure), id, text hash, first word, windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cells.value
        for piece in pieces(batches, "text"):
            raw, ends = data(piece.column(2))
            start, end, first = words(raw, ends)
            h = word_digests(raw, start, end)
            inside, key, _ = _keys(h, first, width, gram)
            if not len(key):
                continue
            cell = (key >> np.uint64(32 - bits)).astype(np.int64)
            # Neighbouring windows mostly share their key: look up each run of equal keys once.
            head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            at = np.searchsorted(known, cell[head])
            hit = known[np.minimum(at, len(known) - 1)] == cell[head]
            flagged = np.repeat(hit, np.diff(np.r_[head, len(cell)])) & inside
            w = np.flatnonzero(flagged)
            if not len(w):
                continue
            a = window_hashes(h, width)[w]
            b = (window_hashes(h, width, 1)[w] >> np.uint64(32)).astype(np.uint32)
            doc = np.searchsorted(first, w, side="right") - 1
            ids = piece.column(0).to_numpy(zero_copy_only=False)
            th = piece.column(1).to_numpy(zero_copy_only=False)
            # Equal windows side by side: order by hash, then document, then place.
            order = np.lexsort((w, th[doc], ids[doc], b, a))
            same = np.zeros(len(w), bool)
            o1, o2 = order[1:], order[:-1]
            same[o1] = (a[o1] == a[o2]) & (b[o1] == b[o2])
            # Rows of the same id and text are one document: equal places are not earlier ones.
            lead = order[np.maximum.accumulate(np.where(same[order], 0, np.arange(len(order))))]
            own = np.empty(len(w), np.int64)
            own[order] = lead
            twin = same & (ids[doc] == ids[doc[own]]) & (th[doc] == th[doc[own]]) & (w - first[doc] == w[own] - first[doc[own]])
            place = (w - first[doc]).astype(np.int32)
            lone = ~same
            sure = np.flatnonzero(same & ~twin)
            cut = np.flatnonzero(np.r_[True, (np.diff(w[sure]) != 1) | (np.diff(doc[sure]) != 0)]) if len(sure) else sure
            runs, long = sure[cut], np.diff(np.r_[cut, len(sure)])
            n, m = int(lone.sum()), len(runs)
            pick = np.r_[np.flatnonzero(lone), runs].astype(np.int64)
            mask = np.r_[np.zeros(n, bool), np.ones(m, bool)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(a[pick].view(np.int64), mask=mask),
                    pa.array(b[pick].view(np.int32), mask=mask),
                    pa.array(ids[doc[pick]]),
                    pa.array(th[doc[pick]]),
                    pa.array(place[pick]),
                    pa.array(np.r_[np.ones(n, np.int32), long.astype(np.int32)]),
                ],
                ["h1", "h2", "id", "th", "at", "n"],
            )

    return df.mapInArrow(run, "h1 long, h2 int, id long, th long, at int, n int")


def repeated_windows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM,
    slice_bytes: int = SLICE_BYTES, pass_cells: int = PASS_CELLS,
) -> DataFrame:
    """Runs of windows that start earlier too: id, th (hash of the text), at (first word), n (windows).

    A null id sorts last; rows of one id are told apart by the hash of their
    text; rows equal in both are one document.
    """
    spark = docs.sparkSession
    # The largest id stands for null; texts without a word, or null, have no window.
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    bits = max(6, (size // slice_bytes).bit_length())
    cells = written(repeated_cells(partition_sketches(rows.select("text"), "text", width, gram, bits)), "cells")
    total = cells.count()
    passes = -(-total // pass_cells)
    parts = []
    for i in range(passes):
        # A pass takes an equal share of the hash range, by the low bits of the counter; its size is known.
        mine = cells.where(F.pmod("cell", F.lit(passes)) == i).toArrow().column("cell").to_numpy()
        parts.append(_candidates(rows, width, gram, bits, spark.sparkContext.broadcast(np.sort(mine))))
    if not parts:
        return spark.createDataFrame([], "id long, th long, at int, n int")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    return _later(found)


def _later(found: DataFrame) -> DataFrame:
    """Sure runs, and the windows that are not the first of their hash."""
    # Runs without a hash get one of their own, so that they are spread.
    key = [F.coalesce("h1", F.xxhash64("id", "th", "at")).alias("h1"), F.coalesce("h2", F.lit(0)).alias("h2")]
    w = Window.partitionBy("h1", "h2").orderBy("id", "th", "at")
    lead = F.first(F.struct("id", "th", "at")).over(w)
    rows = found.select(*key, F.col("h1").isNull().alias("sure"), "id", "th", "at", "n")
    return rows.withColumn("later", F.col("sure") | (lead != F.struct("id", "th", "at"))).where("later").select("id", "th", "at", "n")


def remove_repeated(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM,
    slice_bytes: int = SLICE_BYTES, pass_cells: int = PASS_CELLS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space).

    Null and empty texts have no words and keep an empty text.  Other columns are not read.
    """
    later = repeated_windows(docs, doc_id, text, width, gram, slice_bytes, pass_cells)
    # One document's runs are bounded by its words; the two numbers of a run are packed for sorting.
    packed = F.col("at").cast("long") * (1 << 32) + F.col("n")
    spans = later.groupBy("id", "th").agg(F.array_sort(F.collect_list(packed)).alias("spans"))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("id"),
        F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    joined = rows.join(spans, ["id", "th"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            col = piece.column(1)
            raw, ends = data(col)
            start, end, first = words(raw, ends)
            gone = np.zeros(len(start) + 1, np.int32)
            for i, s in enumerate(piece.column(2)):
                if s.is_valid:
                    v = s.values.to_numpy()
                    at = first[i] + (v >> 32)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + (v & 0xFFFFFFFF) + width - 1, -1)
            out = np.cumsum(gone[:-1]) > 0
            removed = np.diff(np.r_[0, np.cumsum(out)][first])
            texts = []
            blob = raw.tobytes()
            for i in range(len(col)):
                a, b = first[i], first[i + 1]
                if removed[i]:
                    keep = np.flatnonzero(~out[a:b]) + a
                    texts.append(b" ".join([blob[s:e] for s, e in zip(start[keep].tolist(), end[keep].tolist())]))
                else:
                    texts.append(b" ".join(blob[ends[i] : ends[i + 1]].split()))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(np.diff(first)), pa.array(removed.astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


SQL = """
WITH w AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word,
         generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS i
  FROM documents
), win AS (
  SELECT doc_id, i, word, count(*) OVER f AS n, md5(string_agg(word, ' ') OVER f) AS k
  FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), late AS (
  SELECT doc_id, i, word,
         CASE WHEN n = 20 AND row_number() OVER (PARTITION BY k, n ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS late
  FROM win
), gone AS (
  SELECT doc_id, i, word, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM late
), kept AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept
  FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""


@query("op4_substring_dedup", SQL)
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = remove_repeated(documents(spark, folder))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

"""Periodic runs: stretches of words that repeat a shorter stretch, and texts with each run cut to its first period.

A run of period q and length n holds n - q places where words q apart agree, so a k-gram that lies at a known stride
inside it recurs exactly q words on.  Lags are taken in octaves: an octave's k is the longest gram that any of its runs
must hold at a place divisible by the stride.  Repeated k-grams are indexed per document, and pairs of occurrences
whose lag is in the octave are seeds of a diagonal.  A seed has at most as many partners as its octave has lags, and
there is one seed per stride, so there are never more pairs than twice the words, whatever the text.  Seeds of one lag
are walked in order; those that the furthest place covered so far already holds are not extended again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import WORD, data, documents, pieces
from tallyworks.llm.registry import query

# Words of the shortest run.
LEAST = 12
# Words that one step of an extension compares, and diagonals that are extended together.
STEP, LANES = 32, 1 << 13


def _extend(ids: np.ndarray, at: np.ndarray, lag: np.ndarray, way: int) -> np.ndarray:
    """How many words agree with those ``lag`` later, from ``at`` on (way 1) or before ``at`` (way -1)."""
    out = np.zeros(len(at), np.int64)
    step = np.arange(STEP) if way > 0 else -1 - np.arange(STEP)
    for some in range(0, len(at), LANES):
        active = np.arange(some, min(some + LANES, len(at)))
        while len(active):
            p = (at[active] + way * out[active])[:, None] + step
            q = p + lag[active][:, None]
            inside = (p >= 0) & (q < len(ids))
            same = inside & (ids[np.where(inside, p, 0)] == ids[np.where(inside, q, 0)])
            n = np.where(same.all(axis=1), STEP, same.argmin(axis=1))
            out[active] += n
            active = active[n == STEP]
    return out


def _diagonals(ids: np.ndarray, seed: np.ndarray, lag: np.ndarray, gram: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, lag) of the maximal stretches through the seeds; a stretch holds every word and the one ``lag`` on.

    Seeds one stride apart on a diagonal overlap or touch, as a gram is no shorter than the stride: the first one's
    stretch covers the others, which are skipped.
    """
    order = np.lexsort((seed, lag))
    seed, lag = seed[order], lag[order]
    covered = np.r_[False, (lag[1:] == lag[:-1]) & (seed[1:] == seed[:-1] + stride)]
    head = np.flatnonzero(~covered)
    last = np.r_[head[1:], len(seed)] - 1
    lag = lag[head]
    left = seed[head] - _extend(ids, seed[head], lag, -1)
    far = seed[last] + gram
    return left, far + _extend(ids, far, lag, 1) + lag, lag


def runs(ids: np.ndarray, longest: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of all runs, by start, then period.

    ``ids`` are words as numbers of many documents, one after another; documents share no number, so no run crosses a
    border.  ``longest`` is the number of words of the longest document.
    """
    none = np.empty(0, np.int64)
    found = none, none, none
    m = len(ids)
    # First all lags below a power of two: their runs agree in max(least - lag, lag) places or more.
    least = max(least, 2)
    low, high = 1, 1 << (least.bit_length() - 1)
    overlap = min(max(least - q, q) for q in range(low, high))
    gram, stride = overlap // 2 + 1, overlap - overlap // 2
    at, rank = _grams(ids, gram)
    while len(at) and low <= longest // 2:
        place = rank * np.int64(m) + at
        order = np.argsort(place, kind="stable")
        index, where = place[order], at[order]
        seed = np.flatnonzero(at % stride == 0)
        first = np.searchsorted(index, place[seed] + low)
        n = np.searchsorted(index, np.minimum(place[seed] + high, (rank[seed] + 1) * np.int64(m))) - first
        n = np.maximum(n, 0)
        mate = where[np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        i = np.repeat(at[seed], n)
        fresh = _unknown(found, i, mate - i, m)
        if fresh.any():
            found = _runs_only(found, _diagonals(ids, i[fresh], (mate - i)[fresh], gram, stride), least)
        # The next octave: runs of a lag from ``low`` on agree in at least ``low`` places.
        low, high = high, 2 * high
        while gram < low // 2 and len(at):
            step = min(gram, low // 2 - gram)
            at, rank = _longer(at, rank, step, m)
            gram += step
        stride = min(low - gram + 1, gram)
    start, end, lag = found
    order = np.lexsort((lag, start))
    return start[order], (end - start)[order], lag[order]


def _runs_only(known: tuple, more: tuple, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known runs and the stretches long enough for their lag; a multiple of a period spans the same words as it."""
    ok = more[1] - more[0] >= np.maximum(least, 2 * more[2])
    start, end, lag = (np.r_[a, b[ok]] for a, b in zip(known, more))
    order = np.lexsort((lag, end, start))
    start, end, lag = start[order], end[order], lag[order]
    ok = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])] if len(start) else np.empty(0, bool)
    return start[ok], end[ok], lag[ok]


def _unknown(known: tuple, seed: np.ndarray, lag: np.ndarray, m: int) -> np.ndarray:
    """Which seeds may lie on a new run: not those whose first ``lag`` words lie in a run with a period that divides it.

    All of such a seed's stretch has that period.  Of the runs that began before a place, the furthest one is asked.
    """
    start, end, period = known
    if not len(start) or not len(seed):
        return np.ones(len(seed), bool)
    furthest = np.zeros(m, np.int64)
    np.maximum.at(furthest, start, end * len(start) + np.arange(len(start)))
    run = np.maximum.accumulate(furthest)[seed]
    far, which = run // len(start), run % len(start)
    return ~((seed + lag <= far) & (lag % period[which] == 0))


def _repeated(at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = np.bincount(rank)[rank] > 1 if len(rank) else np.empty(0, bool)
    return at[keep], rank[keep]


def _grams(ids: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, number) of every gram that occurs twice or more; equal grams have equal numbers."""
    (at, rank), size = _repeated(np.arange(len(ids)), ids), 1
    while size < gram and len(at):
        step = min(size, gram - size)
        at, rank = _longer(at, rank, step, len(ids))
        size += step
    return at, rank


def _longer(at: np.ndarray, rank: np.ndarray, step: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams ``step`` words longer, from the gram at a place and the one ``step`` later."""
    number = np.full(m + step, -1, np.int64)
    number[at] = rank
    then = number[at + step]
    ok = then >= 0
    at = at[ok]
    rank = pd.factorize(rank[ok] * np.int64(m) + then[ok])[0].astype(np.int64)
    return _repeated(at, rank)


def _collapsed(words: list[bytes], start: list[int], length: list[int], period: list[int]) -> list[bytes]:
    """The words that lie in no run after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for s, n, q in zip(start, length, period):
        change[s + q] += 1
        change[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (array of start, length, period by start, then period), kept.

    A run is a stretch of words of smallest period q and at least max(least, 2 q) words that no neighbour extends.
    ``kept`` is the text, words joined by one space, without words that a run holds after its first q.  A null or empty
    text has no runs and an empty ``kept``; null ids, repeated rows and ids that are no numbers are rows like any other.
    Other columns are not read.  A text of any length is worked on whole, in one task.
    """
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            raw, ends = data(piece.column(1))
            blob, ends = raw.tobytes(), ends.tolist()
            found, numbers, first = [], [], [0]
            for a, b in zip(ends, ends[1:]):
                words = blob[a:b].split()
                known: dict[bytes, int] = {}
                numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + first[-1])
                found.append(words)
                first.append(first[-1] + len(words))
            longest = max(map(len, found))
            start, length, period = runs(np.concatenate(numbers), longest, least)
            border = np.searchsorted(start, first)
            start = start - np.repeat(first[:-1], np.diff(border))
            kept = []
            for k, words in enumerate(found):
                a, b = border[k], border[k + 1]
                words = _collapsed(words, start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()) if b > a else words
                kept.append(b" ".join(words).decode())
            values = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(struct))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(border, pa.int32()), values), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "runs", "kept"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by crc32 of the id, the words from some place on repeat a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(cycle, F.lit(1), n - a)), " ")
    hit = (h % 10 == 0) & F.col("text").rlike(WORD)
    return docs.select("doc_id", F.when(hit, planted).otherwise(F.col("text")).alias("text"))


def digest(runs_: Column) -> Column:
    lines = F.transform(runs_, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return F.sha2(F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), "").cast("binary"), 256)


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    out = periodic_runs(with_planted_runs(documents(spark, folder)))
    # The longest run: of the greatest (length, -start, -period).
    most = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), most.alias("m"), digest(F.col("runs")).alias("runs_sha256"),
                     F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"))
    length, start, period = F.col("m.length"), -F.col("m.col2"), -F.col("m.col3")
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                      F.floor(length * 1000 / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits in lower case, so punctuation does not hide
a copy.  A first pass counts in how many documents each n-gram of the benchmark
occurs; an item's seeds are its n-grams that are rare beside its others.  A second pass
aligns an item with every passage that shares a seed, many at once, and
keeps alignments that reach a share of the item's own score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import data, documents, pieces, table
from tallyworks.llm.registry import query
from tallyworks.llm.words import lowered, window_hashes, window_starts, word_hashes, words

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
# Share of the item's own score that an alignment must reach.
LEAST_SCORE = 0.5
# A seed occurs in at most this many times the documents of the item's middle n-gram, or in a few.
RARE_FACTOR, RARE_DOCS = 2, 10
# Bytes of benchmark text that one pass over the documents broadcasts; more of it takes more passes.
BLOCK_BYTES = 1 << 24
# Alignments computed together.
LANES = 256

_INSIDE = np.zeros(256, bool)
_INSIDE[128:] = _INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[65:91] = True


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of every text)."""
    raw, ends = data(col)
    raw = np.where(_INSIDE[raw], lowered(raw), np.uint8(32))
    start, end, first = words(raw, ends)
    return word_hashes(raw, start, end), first


@dataclass
class Block:
    """Items of one block: ids, word hashes, first words; distinct n-grams with where they occur."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    grams: np.ndarray  # sorted and distinct
    place: np.ndarray  # first of each gram's places, one more than grams
    item: np.ndarray
    at: np.ndarray
    maybe: np.ndarray  # by the top 20 bits of a hash: is there such a gram?

    @staticmethod
    def of(ids, h, first, gram: int, keep=None) -> Block:
        inside = np.flatnonzero(window_starts(first, gram))
        item = np.searchsorted(first, inside, side="right") - 1
        g, at = window_hashes(h, gram)[inside], inside - first[item]
        if keep is not None:
            g, item, at = g[keep], item[keep], at[keep]
        order = np.argsort(g, kind="stable")
        g, item, at = g[order], item[order], at[order]
        grams, place = np.unique(g, return_index=True)
        maybe = np.zeros(1 << 20, bool)
        maybe[(grams >> np.uint64(44)).astype(np.int64)] = True
        return Block(ids, h, first, grams, np.r_[place, len(g)], item, at, maybe)

    def find(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in g that hold a gram, which gram)."""
        near = np.flatnonzero(self.maybe[(g >> np.uint64(44)).astype(np.int64)])
        which = np.searchsorted(self.grams, g[near])
        hit = self.grams[np.minimum(which, len(self.grams) - 1)] == g[near] if len(self.grams) else np.zeros(len(near), bool)
        return near[hit], which[hit]


def align(items: np.ndarray, sizes: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman of items (lanes x words) with passages (lanes x words), all lanes together.

    Returns the best score of each lane and the passage word it ends at.  Inside a row, gaps along the passage
    are a running maximum.  Word 0 matches nothing.
    """
    lanes, width = passages.shape
    ramp = np.arange(width, dtype=np.int32) * -GAP
    row = np.zeros((lanes, width + 1), np.int32)
    best, end = np.zeros(lanes, np.int32), np.zeros(lanes, np.int64)
    for i in range(items.shape[1]):
        word = items[:, i : i + 1]
        step = np.where((passages == word) & (word != 0), MATCH, MISMATCH).astype(np.int32)
        now = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        row[:, 1:] = np.where((i < sizes)[:, None], now, 0)
        top = row[:, 1:].max(axis=1)
        better = top > best
        best = np.where(better, top, best)
        end = np.where(better, row[:, 1:].argmax(axis=1), end)
    return best, end


def _load(benchmark: DataFrame, item_id: str, text: str, gram: int, block_bytes: int) -> Iterator[Block]:
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes)
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).where("item_id IS NOT NULL").orderBy("item_id", "text").toArrow()
        if part.num_rows:
            h, first = _words(part.column("text").combine_chunks())
            yield Block.of(part.column("item_id").to_numpy(), h, first, gram)


def _document_counts(docs: DataFrame, block, gram: int) -> dict[int, int]:
    """In how many documents each gram of the block occurs; one row per gram of the block reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = block.value
        n = np.zeros(len(known.grams), np.int64)
        for piece in pieces(batches, "text"):
            h, first = _words(piece.column(0))
            g = window_hashes(h, gram)
            at, which = known.find(g)
            doc = np.searchsorted(first, at, side="right") - 1
            ok = at + gram <= first[doc + 1]
            pair = np.unique(doc[ok] * len(known.grams) + which[ok])
            n += np.bincount(pair % len(known.grams), minlength=len(n)) if len(n) else 0
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], ["gram", "n"])

    found = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"]: r["n"] for r in found.collect()}


def _rare(block: Block, n: dict[int, int], gram: int) -> Block:
    """The block with seeds only: grams that are rare beside the other grams of their item."""
    count = np.repeat([n.get(i, 0) for i in range(len(block.grams))], np.diff(block.place))
    order = np.lexsort((block.at, block.item))
    item, count = block.item[order], np.asarray(count)[order]
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.empty(0, int)
    keep = np.zeros(len(item), bool)
    for a, b in zip(starts, np.r_[starts[1:], len(item)]):
        keep[a:b] = count[a:b] <= max(RARE_FACTOR * np.median(count[a:b]), RARE_DOCS)
    return Block.of(block.ids, block.words, block.first, gram, keep)


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", gram: int = GRAM, least: float = LEAST_SCORE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (doc_id, th, item_id, score, begin, end): the best alignment of each item found in each document.

    ``th`` is the hash of the text, ``begin`` and ``end`` are words of it.  Null and empty texts hold nothing; items of
    fewer words than a gram, and items without an id, are found nowhere.  Repeated rows are found alike.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "doc_id long, th long, item_id long, score double, begin int, end int"
    out = spark.createDataFrame([], schema)
    for loaded in _load(benchmark, item_id, item_text, gram, block_bytes):
        n = _document_counts(rows, spark.sparkContext.broadcast(loaded), gram)
        seeds = spark.sparkContext.broadcast(_rare(loaded, n, gram))

        def run(batches: Iterator[pa.RecordBatch], seeds=seeds) -> Iterator[pa.RecordBatch]:
            known = seeds.value
            for piece in pieces(batches, "text"):
                h, first = _words(piece.column(2))
                found = _aligned(known, h, first, gram, least)
                doc = found[0]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(pa.array(doc)), piece.column(1).take(pa.array(doc)), *map(pa.array, found[1:])],
                    ["doc_id", "th", "item_id", "score", "begin", "end"],
                )

        out = out.unionAll(rows.mapInArrow(run, schema))
    return out


def _aligned(known: Block, h: np.ndarray, first: np.ndarray, gram: int, least: float):
    """(document, item id, score, first word, last word) of the best alignments in one piece."""
    at, which = known.find(window_hashes(h, gram))
    doc = np.searchsorted(first, at, side="right") - 1
    ok = at + gram <= first[doc + 1]
    at, which, doc = at[ok], which[ok], doc[ok]
    many = known.place[which + 1] - known.place[which]
    place = np.repeat(known.place[which] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    at, doc, item = np.repeat(at, many), np.repeat(doc, many), known.item[place]
    size = known.first[item + 1] - known.first[item]
    slack = np.maximum(8, size // 2)
    # Seeds of one item that would begin it near one place share a passage.
    begin = at - known.at[place]
    task = np.unique(np.stack([doc, item, begin // slack]), axis=1)
    doc, item, cell = task
    size = known.first[item + 1] - known.first[item]
    slack = np.maximum(8, size // 2)
    left = np.maximum(cell * slack - slack, first[doc])
    right = np.minimum(cell * slack + 2 * slack + size, first[doc + 1])
    score, ends, starts = np.zeros(len(doc)), np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
    order = np.argsort(size, kind="stable")
    for k in range(0, len(order), LANES):
        mine = order[k : k + LANES]
        items = _rows(known.words, known.first[item[mine]], size[mine])
        texts = _rows(h, left[mine], right[mine] - left[mine])
        best, end = align(items, size[mine], texts)
        score[mine] = best / (MATCH * size[mine])
        ends[mine] = left[mine] + end
        hit = np.flatnonzero(score[mine] >= least)
        if len(hit):  # the way back from its end tells where an alignment begins
            mine = mine[hit]
            items = _rows(known.words, known.first[item[mine]], size[mine], back=True)
            texts = _rows(h, left[mine], ends[mine] + 1 - left[mine], back=True)
            starts[mine] = ends[mine] - align(items, size[mine], texts)[1]
    keep = np.flatnonzero(score >= least)
    keep = keep[np.lexsort((starts[keep], -score[keep], item[keep], doc[keep]))]
    one = np.r_[True, (np.diff(doc[keep]) != 0) | (np.diff(item[keep]) != 0)] if len(keep) else np.empty(0, bool)
    keep = keep[one]
    d = doc[keep]
    return d, known.ids[item[keep]], score[keep], (starts[keep] - first[d]).astype(np.int32), (ends[keep] - first[d]).astype(np.int32)


def _rows(values: np.ndarray, start: np.ndarray, size: np.ndarray, back: bool = False) -> np.ndarray:
    """Stretches of ``values`` as rows filled up with 0; read from their ends with ``back``."""
    step = np.arange(int(size.max()))
    at = start[:, None] + (size[:, None] - 1 - step if back else step)
    inside = step < size[:, None]
    return np.where(inside, values[np.where(inside, at, 0)], np.uint64(0))


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks(documents(spark, folder), table(spark, folder, "benchmark"))
    return found.select("doc_id", "item_id", "score", "begin", "end").distinct()

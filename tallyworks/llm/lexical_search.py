"""Ranked lexical search by pipelined term partitioning.

Items are queries.  A pass over the documents leaves, per block of documents, the postings of the items' terms.  Terms
are dealt to owners, the rarest first.  A bundle of items visits the owners one after another: at each, a cogroup by
(bundle, block) meets the bundle's sparse accumulators with the owner's postings of that block, and adds integer
contributions.  After a stage, a document is let go if not even the greatest contributions of the owners to come could
lift it to the tenth score that its block holds already, so no result is lost.  At the end each block gives its ten
best documents of each item, and the best of all blocks are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.llm.common import data, documents, lower_ascii, pieces, table, written
from tallyworks.llm.registry import query

TOP = 10
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Bytes of item text whose terms one pass over the documents looks for; more items take more passes.
PASS_BYTES = 1 << 22
# Items of a bundle, owners of terms.  A block has at most BLOCK documents, and about PIECE_BYTES of text.
BUNDLE, OWNERS, BLOCK = 128, 4, 1 << 14
BLOCK_BYTES = 1 << 24

_INSIDE = np.zeros(256, bool)
_INSIDE[128:] = _INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[65:91] = True
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if _INSIDE[c] else 32 for c in range(256))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


@dataclass
class Stage:
    """What the owners know: weight and owner of each term, the terms of each bundle's items, totals of the corpus."""

    weight: np.ndarray
    owner: np.ndarray
    bundles: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # item ids; first place of each item; its terms
    n: int
    tokens: int

    def bound(self, terms: np.ndarray, owner: int) -> int:
        """No document gains more than this from the terms of owners after ``owner``."""
        return int(self.weight[terms[self.owner[terms] > owner]].sum()) * 1_000_000


def postings(docs: DataFrame, vocabulary: list[bytes], doc_id: str, text: str, limit: int = BLOCK) -> DataFrame:
    """A row per block: block (unique), ids and sizes of its documents, and (term, place of the document, tf) by term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(known.value)}
        ids, sizes, term, doc, tf, held = [], [], [], [], [], 0

        def block() -> pa.RecordBatch:
            t, d, f = (np.concatenate(x).astype(np.int32) for x in (term, doc, tf))
            order = np.argsort(t, kind="stable")
            cells = [np.concatenate(sizes).astype(np.int64), t[order], d[order], f[order]]
            found = np.unique(t, return_counts=True)
            row = [pa.array([ids], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in cells)]
            row += [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in found]
            row += [pa.array([int((cells[0] > 0).sum())]), pa.array([int(cells[0].sum())])]
            return pa.RecordBatch.from_arrays(row, ["ids", "sizes", "term", "doc", "tf", "seen", "df", "n", "tokens"])

        for piece in pieces(batches, "text"):
            raw, ends = data(piece.column(1))
            blob, ends = raw.tobytes().translate(_FOLD), ends.tolist()
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                found = blob[a:b].split()
                have = [x for x in map(number.get, found) if x is not None]
                t, n = np.unique(np.array(have, np.int64), return_counts=True)
                term.append(t), tf.append(n), doc.append(np.full(len(t), len(ids)))
                sizes.append(np.array([len(found)]))
                ids.append(piece.column(0)[i].as_py())
                held += b - a
                if len(ids) == limit or held >= BLOCK_BYTES:
                    yield block()
                    ids, sizes, term, doc, tf, held = [], [], [], [], [], 0
        if ids:
            yield block()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "ids array<long>, sizes binary, term binary, doc binary, tf binary, seen binary, df binary, n long, tokens long"
    return rows.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id())


def _document_frequencies(blocks: DataFrame, terms: int) -> np.ndarray:
    """Documents of each term of the vocabulary: one row per term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for seen, df in zip(batch.column(0), batch.column(1)):
                total[np.frombuffer(seen.as_buffer(), np.int32)] += np.frombuffer(df.as_buffer(), np.int32)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["term", "df"])

    found = blocks.select("seen", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(terms, np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _gains(tf: np.ndarray, size: np.ndarray, n: int, tokens: int) -> np.ndarray:
    """A term's contribution over its weight; whole numbers, division rounds down."""
    if len(size) and 90 * int(size.max()) * n >= 1 << 63:
        size = size.astype(object)
    m = (10 + (90 * size * n) // max(tokens, 1)).astype(np.int64)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _owned(blocks: DataFrame, stage, bundle: int, owner: int) -> DataFrame:
    """The owner's postings of each block that the bundle needs: (bundle, block, term, doc, gain)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = stage.value
        for batch in batches:
            rows: list[tuple] = []
            for block, sizes, term, doc, tf in zip(*batch.columns):
                sizes = np.frombuffer(sizes.as_buffer(), np.int64)
                term, doc, tf = (np.frombuffer(x.as_buffer(), np.int32) for x in (term, doc, tf))
                for b in range(len(s.bundles)):
                    need = np.zeros(len(s.owner), bool)
                    need[s.bundles[b][2]] = True
                    ok = (need & (s.owner == owner))[term]
                    if ok.any():
                        gain = _gains(tf[ok], sizes[doc[ok]], s.n, s.tokens)
                        rows.append((b, block.as_py(), term[ok].tobytes(), doc[ok].tobytes(), gain.tobytes()))
            names = ["bundle", "block", "term", "doc", "gain"]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    cells = blocks.select("block", "sizes", "term", "doc", "tf")
    return cells.mapInArrow(run, "bundle int, block long, term binary, doc binary, gain binary")


def _visited(stage, owner: int, top: int):
    """The cogroup of one stage: (bundle, block) accumulators and postings to new accumulators."""

    def add(held: pa.Table, owned: pa.Table) -> pa.Table:
        s = stage.value
        key = held if held.num_rows else owned
        bundle, block = key.column("bundle")[0].as_py(), key.column("block")[0].as_py()
        items, first, terms = s.bundles[bundle]
        have = [np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64)]
        if held.num_rows:
            have = [np.frombuffer(held.column(c)[0].as_buffer(), k) for c, k in (("item", np.int32), ("doc", np.int32), ("score", np.int64))]
        lists = {}
        if owned.num_rows:
            term, doc, gain = (np.frombuffer(owned.column(c)[0].as_buffer(), k) for c, k in (("term", np.int32), ("doc", np.int32), ("gain", np.int64)))
            cut = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
            lists = {int(term[a]): (doc[a:b], gain[a:b]) for a, b in zip(cut, np.r_[cut[1:], len(term)])}
        size = 1 + max([int(x[1].max()) for x in ((0, have[1]), *((0, d) for d, _ in lists.values())) if len(x[1])], default=0)
        held_from = np.searchsorted(have[0], np.arange(len(items) + 1))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(len(items)):
            mine = terms[first[i] : first[i + 1]]
            total = np.zeros(size, np.int64)
            a, b = held_from[i], held_from[i + 1]
            total[have[1][a:b]] = have[2][a:b]
            for t in mine[s.owner[mine] == owner].tolist():
                if t in lists:
                    d, g = lists[t]
                    total[d] += s.weight[t] * g
            doc = np.flatnonzero(total)
            score = total[doc]
            if len(doc) > top:  # the tenth score so far is a floor of the block's tenth score
                least = np.partition(score, len(score) - top)[len(score) - top] - s.bound(mine, owner)
                doc, score = doc[score >= least], score[score >= least]
            out.append((np.full(len(doc), i), doc, score))
        item, doc, score = (np.concatenate(x) for x in zip(*out))
        cells = [x.astype(k).tobytes() for x, k in ((item, np.int32), (doc, np.int32), (score, np.int64))]
        return pa.table({"bundle": pa.array([bundle], pa.int32()), "block": pa.array([block], pa.int64()), **{c: pa.array([x], pa.binary()) for c, x in zip(("item", "doc", "score"), cells)}})

    return add


def _best(held: DataFrame, blocks: DataFrame, stage, top: int) -> DataFrame:
    """(item_id, doc_id, block, doc, score): the ``top`` best of each block and item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = stage.value
        for batch in batches:
            for bundle, block, item, doc, score, ids in zip(*batch.columns):
                names = s.bundles[bundle.as_py()][0]
                item, doc = (np.frombuffer(x.as_buffer(), np.int32) for x in (item, doc))
                score = np.frombuffer(score.as_buffer(), np.int64)
                ids = ids.values.take(pa.array(doc))
                known = ids.fill_null(0).to_numpy(zero_copy_only=False)
                order = np.lexsort((doc, known, ids.is_null().to_numpy(zero_copy_only=False), -score, item))
                place = np.arange(len(order)) - np.searchsorted(item, item)[order]
                order = order[place < top]
                cells = [pa.array(names[item[order]]), ids.take(pa.array(order)), pa.array(np.full(len(order), block.as_py())), pa.array(doc[order]), pa.array(score[order])]
                yield pa.RecordBatch.from_arrays(cells, ["item_id", "doc_id", "block", "doc", "score"])

    met = held.join(blocks.select("block", "ids"), "block").select("bundle", "block", "item", "doc", "score", "ids")
    return met.mapInArrow(run, "item_id long, doc_id long, block long, doc int, score long")


def _passes(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[pa.Table]:
    """(item_id, term) rows, every pair once, of items with about ``limit`` bytes of text at a time."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where(F.col("item_id").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // limit)
    terms = rows.select("item_id", F.explode(_terms(F.col("text"))).alias("term")).distinct()
    for k in range(n):
        part = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "term").toArrow()
        if part.num_rows:
            yield part


def ranked(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    top: int = TOP, owners: int = OWNERS, bundle: int = BUNDLE, pass_bytes: int = PASS_BYTES,
    block: int = BLOCK,
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's ``top`` documents of the highest score above 0.

    Equal scores go by ascending doc_id, null ids last, then by the order in which rows were read.  Repeated rows are
    documents of their own.  Items of one id are one item of all their terms; items without an id or a term, and
    documents without a term, appear nowhere.  Other columns are not read.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for part in _passes(items, item_id, item_text, pass_bytes):
        words = part.column("term").combine_chunks().dictionary_encode()
        term = words.indices.to_numpy().astype(np.int64)
        blocks = written(postings(docs, [t.encode() for t in words.dictionary.to_pylist()], doc_id, text, block), "postings")
        n, tokens = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        df = _document_frequencies(blocks, len(words.dictionary))
        ids, first = np.unique(part.column("item_id").to_numpy(), return_index=True)
        first = np.r_[first, len(term)]
        bundles = [(ids[a : a + bundle], first[a : a + bundle + 1] - first[a], term[first[a] : first[min(a + bundle, len(ids))]]) for a in range(0, len(ids), bundle)]
        # Owners hold about as many postings each: rare terms first, so that common ones find few documents left.
        order = np.argsort(df, kind="stable")
        share = np.cumsum(df[order]) * owners // max(int(df.sum()) + 1, 1)
        owner = np.empty(len(df), np.int64)
        owner[order] = share
        stage = spark.sparkContext.broadcast(Stage(weights(n, df), owner, bundles, n, tokens))
        held = spark.createDataFrame([], "bundle int, block long, item binary, doc binary, score binary")
        for k in range(owners):
            owned = _owned(blocks, stage, bundle, k)
            both = held.groupBy("bundle", "block").cogroup(owned.groupBy("bundle", "block"))
            held = both.applyInArrow(_visited(stage, k, top), held.schema)
        by = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "doc")
        best = _best(held, blocks, stage, top).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
        out = out.unionAll(best.select("item_id", "rank", "doc_id", "score"))
    return out


_SQL = r"""
  WITH d AS (SELECT doc_id, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
  i AS (SELECT DISTINCT item_id, UNNEST(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  size AS (SELECT doc_id, COUNT(*) AS n FROM d GROUP BY 1),
  tot AS (SELECT COUNT(*) AS nn, SUM(n)::BIGINT AS l FROM size),
  m AS (SELECT doc_id, 10 + (90 * n * nn) // l AS m FROM size, tot),
  p AS (SELECT term, doc_id, COUNT(*) AS tf FROM d SEMI JOIN i USING (term) GROUP BY 1, 2),
  w AS (SELECT term, FLOOR(1000 * LN((2 * nn + 2)::DOUBLE / (2 * COUNT(*) + 1)::DOUBLE))::BIGINT AS w FROM p, tot GROUP BY term, nn),
  s AS (SELECT item_id, doc_id, SUM(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
  r AS (SELECT item_id, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
  SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""


@query("op12_lexical_search", _SQL)
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(documents(spark, folder), table(spark, folder, "benchmark"))

"""Best-fit packing in bulk-synchronous rounds.

Documents become pieces of at most ``cap`` tokens.  Pieces are placed by classes of sizes, the largest first.  In a
round, free gaps of sequences and the pieces of the class are range-sorted together, from large to small.  A sweep
hands every piece the tightest gap not yet taken before it, as closing brackets meet opening ones: each task sweeps its
range, and what is left of a range (pieces that found no gap, then gaps that found no piece) meets across ranges by
rank, from counts of two numbers per task.  A gap that could hold several pieces of the class stands in the sweep as
several slots.  Then gaps are updated, and rounds repeat until the class is placed or no gap can hold any of the rest,
which opens new sequences.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyworks.llm.common import documents, pieces, running_sums, written
from tallyworks.llm.registry import query

CAP = 2048
# Classes below this many tokens are one class.
LEAST_CLASS = 16
# Words whose ids a worker keeps, and the longest of them.
KNOWN_WORDS, LONGEST = 300_000, 48

_ids: dict[str, bytes] = {}
# A space after white space does not begin a word of its own.
_UNEVEN = re.compile(r"\s |[\x1c-\x1f]")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(path: str):
    """The vocabulary of byte_bpe_50k.json, read as ranks: the same ids, several times faster."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_bytes(text: str, path: str) -> bytes:
    """Little-endian unsigned 32-bit ids of a text.

    A space that follows another character than white space begins a word, and no token crosses it, so words are
    encoded apart; those met before are looked up.  Words are kept with the space before them, but for the first.
    """
    encode = encoder(path).encode_ordinary
    if _UNEVEN.search(text):
        return np.array(encode(text), "<u4").tobytes()
    words = text.split(" ")
    out = list(map(_ids.get, words))
    out[0] = np.array(encode(words[0]), "<u4").tobytes()
    if None in out:
        for i, word in enumerate(words):
            if out[i] is None:
                out[i] = np.array(encode(" " + word), "<u4").tobytes()
                if len(_ids) < KNOWN_WORDS and len(word) <= LONGEST:
                    _ids[word] = out[i]
    return b"".join(out)


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cap: int = CAP, path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32; a document is its ids and one 0 at the end.

    Only documents of over ``cap`` tokens are cut; all their pieces but the first are full.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            row, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(part.column(1).to_pylist()):
                ids = token_bytes(t, path) + bytes(4)
                n = len(ids) // 4
                head = n % cap or cap
                at = [0, *range(head, n, cap)]
                for k, (a, b) in enumerate(zip(at, [*at[1:], n])):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[4 * a : 4 * b]))
            cells = [part.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cells, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, from large to small, slots before pieces of their size: matches, and what is left with its rank.

    kind 2: piece ``id`` goes to sequence ``seq``; kind 1: a piece without a slot; kind 0: a slot without a piece.
    """
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    free: list[int] = []
    alone = 0

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [("task", pa.int32()), ("kind", pa.int32()), ("rank", pa.int64()), ("id", pa.int64()), ("size", pa.int64()), ("seq", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])

    for part in batches:
        out = []
        for size, kind, name in zip(*(part.column(i).to_pylist() for i in range(3))):
            if not kind:
                free.append(name)
            elif free:
                out.append((task, 2, None, name, size, free.pop()))
            else:
                out.append((task, 1, alone, name, size, None))
                alone += 1
        yield batch(out)
    for a in range(0, len(free), 1 << 16):
        yield batch([(task, 0, a + i, None, None, s) for i, s in enumerate(free[a : a + (1 << 16)])])


def _bridges(left: dict[int, dict[int, int]]) -> list[tuple]:
    """Which ranks of pieces of a task meet which ranks of slots of an earlier one: (task, from, to, other task, last slot)."""
    out, stack = [], []
    for task in sorted(left):
        at, n = 0, left[task].get(1, 0)
        while at < n and stack:
            other, free = stack.pop()
            take = min(free, n - at)
            out.append((task, at, at + take, other, free - 1))
            at += take
            if free > take:
                stack.append((other, free - take))
        if left[task].get(0):
            stack.append((task, left[task][0]))
    return out


def _round(some: DataFrame, gaps: DataFrame, high: int) -> tuple[DataFrame, DataFrame]:
    """(placed: id, size, seq; pieces that found no gap: id, size) of one sweep."""
    spark = some.sparkSession
    n = some.count()
    most = max(1, -(-n // max(gaps.count(), 1)))
    # A gap stands as several slots if each of them can hold any piece of the class.
    k = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / high), F.lit(most))).cast("int")
    slots = gaps.select(F.floor(F.col("gap") / k).alias("size"), F.lit(0).alias("kind"), F.explode(F.array_repeat("seq", k)).alias("name"))
    both = slots.unionAll(some.select("size", F.lit(1).alias("kind"), F.col("id").alias("name")))
    order = [F.desc("size"), F.asc("kind"), F.asc("name")]
    met = both.repartitionByRange(*order).sortWithinPartitions(*order)
    met = written(met.mapInArrow(_sweep, "task int, kind int, rank long, id long, size long, seq long"), "sweep")
    left: dict[int, dict[int, int]] = {}
    for r in met.where("kind < 2").groupBy("task", "kind").agg(F.count(F.lit(1)).alias("n")).collect():
        left.setdefault(r["task"], {})[r["kind"]] = r["n"]
    placed, rest = met.where("kind = 2").select("id", "size", "seq"), met.where("kind = 1").select("task", "rank", "id", "size")
    bridges = _bridges(left)
    if bridges:  # two per task at most
        b = F.broadcast(spark.createDataFrame(bridges, "b_task int, lo long, hi long, other int, last long"))
        rest = rest.join(b, (F.col("task") == F.col("b_task")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
        rest = rest.select("id", "size", F.col("other"), (F.col("last") - F.col("rank") + F.col("lo")).alias("slot"))
        free = met.where("kind = 0").select(F.col("task").alias("other"), F.col("rank").alias("slot"), "seq")
        placed = placed.unionAll(rest.where("other IS NOT NULL").join(free, ["other", "slot"]).select("id", "size", "seq"))
        rest = rest.where("other IS NULL")
    return written(placed, "placed"), written(rest.select("id", "size"), "rest")


def _opened(rest: DataFrame, cap: int) -> DataFrame:
    """(id, size, seq): new sequences for pieces, as many of about one size in each as it holds; named by a piece."""
    per = rest.withColumns({"k": F.floor(F.lit(cap) / F.col("size")), "one": F.lit(1).cast("long"), "down": -F.col("size")})
    alone = per.where("k = 1").select("id", "size", F.col("id").alias("seq"))
    ranked = running_sums(per.where("k > 1"), ["k"], ["down", "id"], {"rank": "one"}, "opened")
    seq = F.min("id").over(Window.partitionBy("k", F.floor(F.col("rank") / F.col("k"))))
    return alone.unionAll(ranked.select("id", "size", seq.alias("seq")))


def assigned(items: DataFrame, cap: int = CAP) -> DataFrame:
    """(id, size, seq, round) for every row of ``items`` (id, size): no sequence holds over ``cap``.

    Ids are distinct, sizes from 1 to ``cap``.
    """
    spark = items.sparkSession
    # Classes: (cap / 2, cap], (cap / 4, cap / 2], ...; at most log2(cap) numbers reach the driver.
    bits = F.floor(F.log2((F.lit(cap) / F.col("size")))).cast("int")
    last = max(cap // LEAST_CLASS, 1).bit_length() - 1
    sized = items.select("id", "size", F.least(bits, F.lit(last)).alias("class"))
    classes = sorted(r[0] for r in sized.select("class").distinct().collect())
    gaps = spark.createDataFrame([], "seq long, gap long")
    done: list[DataFrame] = []
    for c in classes:
        rest = sized.where(F.col("class") == c).select("id", "size")
        low, high = rest.agg(F.min("size"), F.max("size")).first()
        while low is not None:
            now = gaps.where(F.col("gap") >= low)
            fits = now.agg(F.max("gap")).first()[0]
            if fits is None:
                placed = written(_opened(rest, cap), "new")
                low = None
            else:
                placed, rest = _round(rest, now, high)
                low, high = rest.agg(F.min("size"), F.max("size")).first()
            done.append(placed.withColumn("round", F.lit(len(done))))
            used = placed.groupBy("seq").agg(F.sum("size").alias("used"))
            if fits is None:
                gaps = gaps.unionAll(used.select("seq", (F.lit(cap) - F.col("used")).alias("gap")))
            else:
                used = used.withColumnRenamed("seq", "s")
                gaps = gaps.join(used, F.col("seq") == F.col("s"), "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"))
            gaps = written(gaps.where("gap > 0"), "gaps")
    out = done[0] if done else items.select("id", "size", F.col("id").alias("seq"), F.lit(0).alias("round"))
    for more in done[1:]:
        out = out.unionAll(more)
    return out


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cap: int = CAP, path: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one token.  Every row of ``docs`` is packed, repeated rows too; null ids and ids that are no
    numbers stay as they are.  Offsets of a sequence leave no gap.  Equal sizes are placed in the order of rows as read.
    Other columns are not read.  A document is encoded whole, in one task.
    """
    rows = written(cut(docs, doc_id, text, cap, path).withColumn("id", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == cap
    placed = assigned(rows.where(~whole).select("id", F.col("length").alias("size")), cap).select(F.col("id").alias("p"), "seq", "round")
    met = rows.where(~whole).join(placed, F.col("id") == F.col("p"))
    before = Window.partitionBy("seq").orderBy("round", "id").rowsBetween(Window.unboundedPreceding, -1)
    out = met.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset"]
    return out.select(*names).unionAll(rows.where(whole).withColumns({"seq": F.col("id"), "offset": F.lit(0).cast("long")}).select(*names))


@query("op11_best_fit_packing")
def op11_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(documents(spark, folder))

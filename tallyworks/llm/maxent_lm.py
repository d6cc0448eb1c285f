"""A hashed maximum-entropy language model with a class-factored softmax.

A word's probability is that of its class in its context times its share of the
class.  Classes of the ``VOCAB`` most frequent words are clusters of words with like
neighbours; all other words, known or not, share one class, and the end of a text has
its own.  The class is a softmax over hashed features of the context: the word
before, the one before that (a skip), and both together.  Tasks take gradient
steps over their share of the training texts; their weights are averaged after
each of a few rounds, which see disjoint parts and together every text once.

Counts of all words stay in a table.  The ones of at most ``KNOWN`` words are broadcast;
other words meet the table in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import data, documents, pieces, written
from tallyworks.llm.language import held_out
from tallyworks.llm.registry import query
from tallyworks.llm.words import lowered, mix, word_hashes, words

VOCAB, KNOWN = 1 << 16, 1 << 20
CLASSES = 32  # the last two are the end of a text and all words outside of the vocabulary
END, OTHER = CLASSES - 2, CLASSES - 1
MARKS = 64  # most frequent words, whose company tells words apart
SLOTS = 1 << 15
ROUNDS, BATCH, RATE = 3, 4096, 0.15
SLICES = 32
# Distinct words that a task counts before it sends them on.
HELD = 1 << 19
END_HASH = np.uint64(0x1D)


@dataclass
class Lexicon:
    """Hashes (sorted) and counts of the broadcast words, and each one's vocabulary number or VOCAB."""

    hashes: np.ndarray
    counts: np.ndarray
    number: np.ndarray
    first: np.ndarray  # where each value of a hash's top bits begins

    @staticmethod
    def of(hashes: np.ndarray, counts: np.ndarray) -> Lexicon:
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        number = np.full(len(hashes), VOCAB, np.int64)
        best = np.lexsort((hashes, -counts))[:VOCAB]
        number[best] = np.arange(len(best))
        return Lexicon(hashes, counts, number, np.searchsorted(hashes >> np.uint64(44), np.arange((1 << 20) + 1).astype(np.uint64)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        top = (h >> np.uint64(44)).astype(np.int64)
        at, end = self.first[top], self.first[top + 1]
        out = np.full(len(h), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            same = self.hashes[at[open_]] == h[open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


def tokens(piece: pa.RecordBatch, col: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words, each text's end behind them; first token of every text)."""
    raw, ends = data(piece.column(col))
    raw = lowered(raw)
    start, end, first = words(raw, ends)
    h = np.insert(word_hashes(raw, start, end), first[1:], END_HASH)
    return h, first + np.arange(len(first))


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (h, c): how often each word occurs, the end of a text too; added up in tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return h, np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)

        def row(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "c"])

        for piece in pieces(batches, "text"):
            held.append(np.unique(tokens(piece, 0)[0], return_counts=True))
            if sum(len(x) for x, _ in held) > 2 * HELD:
                held = [merged()]
                if len(held[0][0]) > HELD:
                    yield row(*held.pop())
        if held:
            yield row(*merged())

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def lexicon(counts: DataFrame) -> tuple[Lexicon, int]:
    """(words for the broadcast, the count from which a word is among them): KNOWN at most, by steps of an eighth of a power of two."""
    step = F.floor(F.log2("c") * 8)
    sizes = sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for s, n in sizes:
        if total + n > KNOWN:
            break
        total, least = total + n, s
    # Should even the highest step be too large, no word is broadcast, and all of them meet the table.
    known = counts.where(step >= (least if least is not None else 1 << 20)).toArrow()
    lex = Lexicon.of(known.column("h").to_numpy().view(np.uint64), known.column("c").to_numpy())
    return lex, int(least) if least is not None else 1 << 20


def _contexts(numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the word before each token and of the one before that; VOCAB + 1 stands before a text."""
    one = np.r_[VOCAB + 1, numbers[:-1]]
    one[first[:-1]] = VOCAB + 1
    two = np.r_[VOCAB + 1, one[:-1]]
    two[first[:-1]] = VOCAB + 1
    return one, two


SUMS = "part long, slice long, n double, values binary"


def _send(values: np.ndarray, n: float) -> pa.RecordBatch:
    """An array in slices, with its weight."""
    from pyspark import TaskContext

    rows = [x.tobytes() for x in np.array_split(values.ravel(), SLICES)]
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays(
        [pa.array([part] * SLICES), pa.array(np.arange(SLICES)), pa.array([float(n)] * SLICES), pa.array(rows, pa.binary())], ["part", "slice", "n", "values"]
    )


def _weighted_sum(parts: DataFrame, dtype, tasks: int) -> tuple[np.ndarray, float]:
    """(sum of n times the array over all tasks, sum of n), added in groups of tasks first.

    The array reaches the driver; its size is fixed by the parameters.
    """

    def add(kind):
        def run(group: pa.Table) -> pa.Table:
            total, n = np.float64(0), 0.0
            for v, w in zip(group.column("values"), group.column("n").to_pylist()):
                x = np.frombuffer(v.as_buffer(), kind).astype(np.float64)
                total, n = total + (x * w if kind == dtype else x), n + w
            return pa.table({"part": [0], "slice": [group.column("slice")[0].as_py()], "n": [n], "values": [total.astype(np.float32).tobytes()]})

        return run

    groups = F.pmod("part", F.lit(max(2, math.isqrt(tasks))))
    first = parts.groupBy("slice", groups.alias("g")).applyInArrow(add(dtype), SUMS)
    got = sorted(first.groupBy("slice").applyInArrow(add(np.float32), SUMS).collect(), key=lambda r: r["slice"])
    if not got:
        return np.empty(0, np.float32), 0.0
    return np.concatenate([np.frombuffer(bytes(r["values"]), np.float32) for r in got]), got[0]["n"]


def word_classes(texts: DataFrame, lex) -> np.ndarray:
    """Class of each vocabulary number (and of VOCAB, which is OTHER), clustered by neighbours among the MARKS."""
    width = 2 * (MARKS + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = lex.value, None
        for piece in pieces(batches, "text"):
            h, first = tokens(piece, 0)
            at = known.find(h)
            number = np.where(at >= 0, known.number[at], VOCAB)
            mark = np.minimum(number, MARKS)
            total = np.zeros((VOCAB, width), np.int32) if total is None else total
            flat = total.reshape(-1)
            inner = np.ones(len(number), bool)
            inner[first[:-1]] = False
            i = np.flatnonzero(inner)
            for a, b, shift in ((i, i - 1, 0), (i - 1, i, MARKS + 1)):
                a, b = a[number[a] < VOCAB], b[number[a] < VOCAB]
                key, n = np.unique(number[a] * width + shift + mark[b], return_counts=True)
                flat[key] += n.astype(np.int32)
        if total is not None:
            yield _send(total, 1)

    found, n = _weighted_sum(texts.mapInArrow(run, SUMS), np.int32, texts.rdd.getNumPartitions())
    out = np.full(VOCAB + 2, OTHER, np.int64)
    if not n:
        return out
    x = np.sqrt(found.reshape(VOCAB, width))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    seen = lex.value.number[lex.value.number < VOCAB]
    start = [0]
    heavy = x[: min(2048, max(len(seen), 1))]
    while len(start) < min(END, len(heavy)):
        start.append(int(np.argmin((heavy @ heavy[start].T).max(axis=1))))
    c = heavy[start]
    for _ in range(10):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, total, c)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    out[seen] = np.argmax(x @ c.T, axis=1)[seen]
    ends = np.flatnonzero(lex.value.hashes == END_HASH)
    if len(ends) and lex.value.number[ends[0]] < VOCAB:
        out[lex.value.number[ends[0]]] = END
    return out


def features(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Slots of the word before, the skip, both, and nothing."""
    a, b = one.astype(np.uint64), two.astype(np.uint64)
    key = np.stack([mix(a * np.uint64(4)), mix(b * np.uint64(4) + np.uint64(1)), mix((a << np.uint64(24)) + b * np.uint64(4) + np.uint64(2))], axis=1)
    slot = (key % np.uint64(SLOTS - 1)).astype(np.int32) + 1
    return np.concatenate([slot, np.zeros((len(a), 1), np.int32)], axis=1)


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def train(texts: DataFrame, lex, classes: np.ndarray, prior: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (SLOTS x CLASSES) after ``rounds`` of local gradient steps and averaging by tokens.

    They start from the shares of the classes, so that the model starts as one of single words.
    """
    sc = texts.sparkSession.sparkContext
    weights = np.zeros((SLOTS, CLASSES), np.float32)
    weights[0] = np.log(np.maximum(prior, 0.5) / max(prior.sum(), 1))
    part = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(rounds))
    for r in range(rounds):
        now = sc.broadcast((weights, classes))

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            known, (w, cls) = lex.value, now.value
            w, memory, seen = w.copy(), np.full((SLOTS, CLASSES), 1e-2, np.float32), 0
            for piece in pieces(batches, "text"):
                h, first = tokens(piece, 0)
                at = known.find(h)
                number = np.where(at >= 0, known.number[at], VOCAB)
                slots, goal = features(*_contexts(number, first)), cls[number]
                for k in range(0, len(goal), BATCH):
                    _step(w, memory, slots[k : k + BATCH], goal[k : k + BATCH])
                seen += len(goal)
            if seen:
                # Only what changed travels, in half precision.
                yield _send((w - now.value[0]).astype(np.float16), seen)

        found, n = _weighted_sum(texts.where(part == r).mapInArrow(run, SUMS), np.float16, texts.rdd.getNumPartitions())
        if n:
            weights = weights + (found / n).reshape(SLOTS, CLASSES).astype(np.float32)
    return weights


def _step(w: np.ndarray, memory: np.ndarray, slots: np.ndarray, goal: np.ndarray) -> None:
    """One adaptive gradient step on the mean loss of a batch."""
    p = np.exp(log_softmax(w[slots].sum(axis=1)))
    p[np.arange(len(goal)), goal] -= 1
    flat = slots.ravel()
    order = np.argsort(flat, kind="stable")
    ids, start = np.unique(flat[order], return_index=True)
    g = np.add.reduceat(p[order // slots.shape[1]], start, axis=0) / np.float32(np.sqrt(len(goal)))
    memory[ids] += g * g
    w[ids] -= RATE * g / np.sqrt(memory[ids])


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int = 7, which: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32 of the id leaves another remainder than ``which``; those without an id teach
    nothing.  A null text is empty, one token.  With nothing learnt both scores are 0.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), held_out(doc_id, parts, which).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    train_texts = rows.where(F.col("doc_id").isNotNull() & ~F.col("held_out")).select("text")
    counts = written(word_counts(train_texts), "word_counts")
    sums = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum(F.col("c") + 1)).first()
    n, v, mass = (x or 0 for x in sums)
    found, least = lexicon(counts)
    lex = spark.sparkContext.broadcast(found)
    classes = word_classes(train_texts, lex)
    # Shares of a class: counts plus one; the last class also has room for one unknown word.
    of = classes[found.number] if len(found.number) else np.empty(0, np.int64)
    total = np.bincount(of, found.counts + 1, CLASSES)
    total[OTHER] = mass - (total.sum() - total[OTHER]) + 1
    weights = train(train_texts, lex, classes, total)
    model = spark.sparkContext.broadcast((weights, classes, np.log10(np.maximum(total, 1)), np.log10(found.counts + 1.0)))
    schema = "doc_id {}, held_out boolean, n_tokens long, n_known long, known double, model double, outside array<struct<h:long,n:int>>"
    kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon_, (w, cls, mass_, logs) = lex.value, model.value
        for piece in pieces(batches, "text"):
            h, first = tokens(piece, 2)
            at = lexicon_.find(h)
            hit = at >= 0
            number = np.where(hit, lexicon_.number[at], VOCAB) if len(logs) else np.full(len(h), VOCAB)
            goal, slots = cls[number], features(*_contexts(number, first))
            share = np.where(hit, logs[at], 0.0) if len(logs) else np.zeros(len(h))
            value = share - mass_[goal]
            for k in range(0, len(h), BATCH):
                lp = log_softmax(w[slots[k : k + BATCH]].sum(axis=1))
                value[k : k + BATCH] += lp[np.arange(len(lp)), goal[k : k + BATCH]] / np.log(10)
            per = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  a text has one token at least
            lists = []
            for a, b in zip(first[:-1], first[1:]):
                ids, m = np.unique(h[a:b][~hit[a:b]], return_counts=True)
                lists.append([{"h": i, "n": c} for i, c in zip(ids.view(np.int64).tolist(), m.tolist())])
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(np.diff(first)), pa.array(per(hit.astype(np.int64))), pa.array(per(share)), pa.array(per(value)), pa.array(lists, kind)],
                ["doc_id", "held_out", "n_tokens", "n_known", "known", "model", "outside"],
            )

    kept = rows.mapInArrow(run, schema.format(rows.schema["doc_id"].dataType.simpleString()))
    kept = written(kept.withColumn("row", F.monotonically_increasing_id()), "scored")
    outside = kept.select("row", F.explode("outside").alias("o")).select("row", "o.h", "o.n")
    few = counts.where(F.floor(F.log2("c") * 8) < least)
    more = outside.join(few, "h").groupBy("row").agg(F.sum("n").alias("more_n"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    out = kept.drop("outside").join(more, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    base = F.col("known") + more - F.col("n_tokens") * float(np.log10(n + v + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_n", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("model") + more if n else base).alias("score"),
    )


@query("op9_maxent_lm")
def op9_maxent_lm(spark: SparkSession, folder: str) -> DataFrame:
    return scores(documents(spark, folder))

"""Language ID by nearest centroid over TF-IDF vectors of byte n-grams.

Texts become hashed counts of byte n-grams, damped by a logarithm, weighted by
inverse document frequency and normalised.  Each language has several centroids
from spherical k-means over a bounded sample of its labelled texts; a text goes to
the language of the centroid with the largest cosine, and is rejected if it is
much farther from it than nearly all sampled texts of the language are from theirs.
Sampled texts that few others are like get no centroid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.llm.common import data, documents, pieces, written
from tallyworks.llm.registry import query

ORDERS = (1, 2, 3)
DIM = 8192
CENTROIDS = 4
# Distinct texts per language that the centroids are fitted on, on average: each is drawn by its hash.
SAMPLE = 1000
ROUNDS = 8
# A text is rejected below this share of a low quantile of its language's sampled cosines.
MARGIN, LOW = 0.4, 0.01
# A centroid holds so large a share of its language's sampled texts at least.
HOLDS = 0.02
# Texts of one numpy step, and bytes whose n-grams are counted together: with DIM they bound a task's memory, however long a text is.
ROWS = 64
BLOCK_BYTES = 1 << 16
LETTER = regex.compile(r"\p{L}")

# Letters in lower case and bytes of other alphabets stay, all else is a space.
_CLASS = np.full(256, 32, np.int64)
_CLASS[128:] = np.arange(128, 256)
_CLASS[97:123] = _CLASS[65:91] = np.arange(97, 123)


@dataclass
class Model:
    """Centroids (rows), their languages, idf, and the least cosine accepted for each centroid's language."""

    langs: list[str]
    of: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray


def counts(raw: np.ndarray, ends: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Documents x dim: how often each hashed n-gram occurs; n-grams never cross documents."""
    n = len(ends) - 1
    out = np.zeros(n * dim, np.float32)
    for at in range(0, len(raw), BLOCK_BYTES):
        _count(out, raw, ends, at, min(at + BLOCK_BYTES, len(raw)), dim)
    return out.reshape(n, dim)


def _count(out: np.ndarray, raw: np.ndarray, ends: np.ndarray, at: int, to: int, dim: int) -> None:
    """Adds the n-grams that begin at the bytes from ``at`` up to ``to``; they may end behind ``to``."""
    low, high = np.searchsorted(ends, [at, to - 1], side="right") - 1
    inside = np.diff(np.clip(ends[low : high + 2], at, to))
    doc, last = np.repeat(np.arange(high + 1 - low) * dim, inside), np.repeat(ends[low + 1 : high + 2] - at, inside)
    b = _CLASS[raw[at : to + max(ORDERS) - 1]]
    gram = np.zeros(len(b), np.int64)
    mine = out[low * dim : (high + 1) * dim]
    for order in range(1, max(ORDERS) + 1):
        gram = gram[: len(b) - order + 1] * 257 + b[order - 1 :]
        size = min(to - at, len(gram))
        if size <= 0:
            break
        if order in ORDERS:
            slot = ((gram[:size] + order) * 0x9E3779B1 >> 15) % dim + doc[:size]
            blank = b[:size] == 32 if order == 1 else np.zeros(size, bool)
            ok = (np.arange(size) + order <= last[:size]) & ~blank
            mine += np.bincount(slot[ok], minlength=len(mine))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weigh(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Counts become unit vectors in place, a few rows at a time."""
    for at in range(0, len(found), ROWS):
        found[at : at + ROWS] = _unit(np.log1p(found[at : at + ROWS]) * idf)
    return found


def _steps(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, text):
        for at in range(0, piece.num_rows, ROWS):
            yield piece.slice(at, ROWS)


def _mean(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mean of some rows, added one by one: no copy of them is made."""
    total = np.zeros(x.shape[1], x.dtype)
    for i in np.flatnonzero(rows):
        total += x[i]
    return total / x.dtype.type(rows.sum())


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from the text nearest to the mean, then from the farthest ones."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(start) < min(k, len(x)):
        start.append(int(np.argmin((x @ x[start].T).max(axis=1))))
    c = x[start]
    for _ in range(ROUNDS):
        near = np.argmax(x @ c.T, axis=1)
        c = _unit(np.stack([_mean(x, near == i) if (near == i).any() else c[i] for i in range(len(c))]))
    return c


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """(centroids, low quantile of all texts' cosines); a centroid that holds too few texts goes.

    Its texts are set aside and the others start anew, as long as few are set aside in all.
    """
    few = HOLDS * len(x)
    rest = x
    while True:
        c = _kmeans(rest, k)
        near = np.argmax(rest @ c.T, axis=1)
        held = np.bincount(near, minlength=len(c))
        stays = held[near] >= few
        if stays.all() or stays.sum() < len(x) - few:
            break
        rest = rest[stays]
    if (held >= few).any():
        c = c[held >= few]
    return c, float(np.quantile((x @ c.T).max(axis=1), LOW))


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Centroids from rows with a language; rows without a language, or without a letter in the text, are not read.

    Languages are few: one row for each reaches the driver, and its centroids do.
    """
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = F.xxhash64("text", F.lit(7))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count_distinct(hashed).alias("n")).collect()}
    if not n:
        return Model([], np.empty(0, int), np.empty((0, DIM), np.float32), np.zeros(DIM, np.float32), np.empty(0))
    rate = F.create_map(*[F.lit(x) for name, c in n.items() for x in (name, min(1.0, sample / c))])
    draw = F.pmod(hashed, F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * (1 << 30)
    # A text that many rows repeat is drawn once.
    once = rows.where(draw).groupBy("lang", hashed.alias("h")).agg(F.first("text").alias("text")).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _steps(batches, "text"):
            raw, ends = data(step.column(1))
            found = counts(raw, ends)
            rows_, cols = np.nonzero(found)
            cut = np.searchsorted(rows_, np.arange(len(found) + 1))
            values = [(cols[a:b].astype(np.int32).tobytes(), found[i, cols[a:b]].tobytes()) for i, (a, b) in enumerate(zip(cut, cut[1:]))]
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array([v[0] for v in values]), pa.array([v[1] for v in values])], ["lang", "at", "n"])

    drawn = written(once.mapInArrow(vectors, "lang string, at binary, n binary"), "language_sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, texts = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for at in batch.column(0):
                df[np.frombuffer(at.as_buffer(), np.int32)] += 1
            texts += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(DIM), -1]), pa.array(np.r_[df, texts])], ["slot", "n"])

    found = drawn.select("at").mapInArrow(frequencies, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = {r["slot"]: r["n"] for r in found}
    idf = np.log((1 + df[-1]) / (1 + np.array([df[i] for i in range(DIM)]))).astype(np.float32) + np.float32(0.1)

    def cluster(group: pa.Table) -> pa.Table:
        x = np.zeros((group.num_rows, DIM), np.float32)

        def fill(order: np.ndarray) -> None:
            places = np.empty(len(order), int)
            places[order] = np.arange(len(order))
            for i, at, v in zip(places, group.column("at"), group.column("n")):
                x[i, np.frombuffer(at.as_buffer(), np.int32)] = np.frombuffer(v.as_buffer(), np.float32)
            _weigh(x, idf)

        fill(np.arange(len(x)))
        order = np.lexsort(x[:, :4].T)
        # Filled again in order, so that no second array of this size is made.
        x[:] = 0
        fill(order)
        c, least = _clusters(x, k)
        return pa.table({"lang": [group.column("lang")[0].as_py()] * len(c), "least": [least] * len(c), "c": [v.astype(np.float32).tobytes() for v in c]})

    # A group holds the sample of one language, which SAMPLE bounds.
    got = drawn.groupBy("lang").applyInArrow(cluster, "lang string, least double, c binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["c"])))
    langs = sorted({r["lang"] for r in got})
    return Model(
        langs, np.array([langs.index(r["lang"]) for r in got]), np.stack([np.frombuffer(r["c"], np.float32) for r in got]),
        idf, MARGIN * np.array([r["least"] for r in got]),
    )


def _judged(col: pa.Array, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the language, cosine, rejected?) of each text; len(m.langs) stands for ``und``."""
    raw, ends = data(col)
    ascii_ = np.cumsum(np.r_[0, (raw | 32) - 97 < 26])
    letter = ascii_[ends[1:]] > ascii_[ends[:-1]]
    for i in np.flatnonzero(~letter):
        letter[i] = LETTER.search(col[i].as_py() or "") is not None
    pred, score, least = np.full(len(col), len(m.langs)), np.zeros(len(col)), np.zeros(len(col))
    if len(m.of):
        cos = _weigh(counts(raw, ends), m.idf) @ m.centroids.T
        near = np.argmax(cos, axis=1)
        pred, least = np.where(letter, m.of[near], len(m.langs)), m.least[near]
        score = np.where(letter, np.clip(cos.max(axis=1), 0, 1), 0.0).astype(np.float64)
    return pred, score, (score < least) | (pred == len(m.langs))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` and with lang_pred, score (cosine, 0 to 1) and rejected.

    A null text, or one without a letter, is ``und`` with score 0 and rejected; so is every text if nothing was learnt.
    """
    kept = [c for c in docs.columns if c != text]
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*known.value.langs, "und"], object)
        for step in _steps(batches, text):
            pred, score, rejected = _judged(step.column(len(kept)), known.value)
            yield pa.RecordBatch.from_arrays(
                [*step.columns[: len(kept)], pa.array(names[pred], pa.string()), pa.array(score), pa.array(rejected)],
                [*kept, "lang_pred", "score", "rejected"],
            )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    return docs.select(*kept, text).mapInArrow(run, schema + "lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``predict`` does not reject, as they are."""
    at = docs.columns.index(text)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in _steps(batches, text):
            yield step.filter(pa.array(~_judged(step.column(at), known.value)[2]))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str, parts: int, which: int):
    """Whether crc32 of the id as text leaves ``which``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == which, F.lit(False))


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.where(F.col(doc_id).isNotNull() & ~held_out(doc_id, 3, 1))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit(training_rows(docs))
    return predict(docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text"), model)

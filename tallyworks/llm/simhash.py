"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a Hamming radius.

Fingerprints are filed under every pair of four 16-bit bands, so two of them
within two bits share a file.  A file above ``LIMIT`` is filed again by
quarters of its two other bands, and again: after that 56 bits are equal and a
file has 256 entries at most, whatever the data.  Inside a file, bit planes are stored
vertically: one word holds the same bit of 64 fingerprints, and a carry-save
counter updates 64 distances with a few bitwise operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions.skew import join_stats
from tallyworks.llm.common import data, documents, pieces, written
from tallyworks.llm.registry import query

SHINGLE = 3
RADIUS = 2
SEED = 42
# Fingerprints of one file that are compared directly.
LIMIT = 2048
# Fingerprints that one task compares.
SLICE_ROWS = 100_000
HOT_ROWS = 50_000


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, th, fp): a bit is set if it is in over half of the shingles' XXH64; th is a hash of the text.

    A-Z are read in lower case.  Fewer words than a shingle count as one; a text without words, or null, has
    fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for piece in pieces(batches, "text"):
            raw, ends = data(piece.column(2))
            blob = raw.tobytes()
            counts = np.zeros(piece.num_rows, np.int64)
            parts = []
            for i in range(piece.num_rows):
                found = blob[ends[i] : ends[i + 1]].lower().split()
                if not found:
                    continue
                size = np.fromiter(map(len, found), np.int64, len(found)) + 1
                end = np.cumsum(size) - 1
                k = min(shingle, len(found))
                joined = b" ".join(found)
                at, to = (end - size + 1)[: len(found) - k + 1].tolist(), end[k - 1 :].tolist()
                counts[i] = len(at)
                grams = map(joined.__getitem__, map(slice, at, to))
                parts.append(np.fromiter(map(xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(at)))
            fp = np.zeros(piece.num_rows, np.uint64)
            if parts:
                has = np.flatnonzero(counts)
                bits = np.unpackbits(np.concatenate(parts).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                starts = np.r_[0, np.cumsum(counts[has])[:-1]]
                ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
                fp[has] = np.packbits(2 * ones > counts[has, None], axis=1, bitorder="little").view(np.uint64).ravel()
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, th long, fp long")


def close_pairs(file: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of one file whose fingerprints differ in ``radius`` bits or fewer, distance in rows by distance.

    Rows of a file stand side by side, larger files first.
    """
    n = len(fp)
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, file[1:] != file[:-1]]), n]) if n else np.empty(0, np.int64)
    words = n // 64 + 2
    planes = np.zeros((64, 2 * words), np.uint64)
    for b in range(64):
        packed = np.packbits(((fp >> np.uint64(b)) & np.uint64(1)).astype(bool), bitorder="little")
        planes[b].view(np.uint8)[: len(packed)] = packed
    digits = (radius + 1).bit_length()
    for k in range(1, int(size.max()) if n else 0):
        reach = int(size[size > k].sum())
        used = -(-reach // 64)
        q, r = divmod(k, 64)
        active = np.zeros(used * 64, bool)
        active[: reach - k] = file[: reach - k] == file[k:reach]
        active = np.packbits(active, bitorder="little").view(np.uint64)
        where = np.flatnonzero(active)
        active = active[where]
        over = np.zeros(len(where), np.uint64)
        count = np.zeros((digits, len(where)), np.uint64)
        for block in range(0, 64, 8):
            mine = planes[block : block + 8]
            moved = mine[:, where + q] >> np.uint64(r)
            if r:
                moved |= mine[:, where + q + 1] << np.uint64(64 - r)
            for carry in mine[:, where] ^ moved:
                for d in range(digits):
                    count[d], carry = count[d] ^ carry, count[d] & carry
                over |= carry
            live = (active & ~over) != 0
            if not live.all():  # all 64 lanes of a block are beyond the radius: abandon it
                where, active, over, count = where[live], active[live], over[live], count[:, live]
            if not len(where):
                break
        if len(where):
            hits = active & ~over & _at_most(count, radius)
            lanes = np.flatnonzero(np.unpackbits(hits.view(np.uint8), bitorder="little"))
            i = where[lanes // 64] * 64 + lanes % 64
            if len(i):
                yield i, i + k


def _at_most(count: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter is at most ``radius``, from the highest digit down."""
    less, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for d in range(len(count) - 1, -1, -1):
        if radius >> d & 1:
            less |= same & ~count[d]
            same &= count[d]
        else:
            same &= ~count[d]
    return less | same


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """One link from every linked node to the smallest node of its class."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        if (root == before).all() and (root[i] == root[j]).all():
            nodes = np.flatnonzero(root != np.arange(n))
            return nodes, root[nodes]


def _filed(fp: Column, fields: list[tuple[int, int]]) -> list[tuple[Column, list[tuple[int, int]]]]:
    """Every pair of four fields as (key, the other two fields); a field is (first bit, bits)."""
    out = []
    for a, b in combinations(range(4), 2):
        part = [F.shiftrightunsigned(fp, fields[x][0]).bitwiseAND(F.lit((1 << fields[x][1]) - 1)) for x in (a, b)]
        key = F.shiftleft(part[0], fields[b][1]).bitwiseOR(part[1])
        out.append((key, [fields[x] for x in range(4) if x not in (a, b)]))
    return out


def filed(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows (file, fp) over distinct fingerprints; every pair within two bits shares a file, none is large."""
    # The fields still open are the same for all rows of a table, so a table is named by the fields taken so far.
    open_fields = {"": [(16 * i, 16) for i in range(4)]}
    rows = fps.select(F.lit("").alias("name"), F.lit(0).cast("long").alias("file"), "fp")
    done = None
    for level in range(3):
        made, following = None, {}
        for name, fields in open_fields.items():
            options = []
            for n, (key, rest) in enumerate(_filed(F.col("fp"), fields)):
                new = f"{name}{n}"
                options.append(F.struct(F.lit(new).alias("name"), F.xxhash64("file", F.lit(new), key).alias("file")))
                following[new] = [(s + i * w // 2, w // 2) for s, w in rest for i in range(2)]
            part = rows.where(F.col("name") == name) if level else rows
            part = part.select("fp", F.explode(F.array(*options)).alias("o")).select("o.name", "o.file", "fp")
            made = part if made is None else made.unionAll(part)
        made = written(made.distinct() if level else made, "filed")
        if level == 2:
            return done.unionAll(made.select("file", "fp"))
        large = made.groupBy("file").count().where(F.col("count") > limit).select("file")
        large = written(large, "large")
        small = made.join(large, "file", "left_anti").select("file", "fp")
        done = small if done is None else done.unionAll(small)
        if large.isEmpty():
            return done
        rows, open_fields = made.join(large, "file", "left_semi"), following
    return done


def links(fps: DataFrame, radius: int = RADIUS, limit: int = LIMIT, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Links (u, v) between distinct fingerprints that join the same classes as all links within the radius do."""
    if radius > 2:
        raise ValueError("four bands taken in pairs find a radius of 2 at most")
    rows = filed(fps, limit)
    slices = max(64, 6 * fps.count() // slice_rows)

    def compare(group: pa.Table) -> pa.Table:
        file, fp = group.column("file").to_numpy(), group.column("fp").to_numpy()
        _, back, count = np.unique(file, return_inverse=True, return_counts=True)
        busy = count[back] > 1
        file, fp, size = file[busy], fp[busy].view(np.uint64), count[back][busy]
        order = np.lexsort((fp, file, -size))
        file, fp = file[order], fp[order]
        i, j = np.empty(0, np.int64), np.empty(0, np.int64)
        for a, b in close_pairs(file, fp, radius):
            i, j = np.r_[i, a], np.r_[j, b]
            if len(i) > 1_000_000:  # keep a spanning forest only
                i, j = _spanning(i, j, len(fp))
        i, j = _spanning(i, j, len(fp))
        return pa.table({"u": fp[i].view(np.int64), "v": fp[j].view(np.int64)})

    by = F.pmod(F.xxhash64("file", F.lit(1)), F.lit(slices))
    return rows.groupBy(by.alias("slice")).applyInArrow(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of an edge (u, v): the smallest node of its component.

    Alternates two steps: every node hands its larger neighbours, then its smaller ones, to its least neighbour.
    All in aggregates and joins; each round is written, and rounds grow with the logarithm of the diameter.
    """
    edges = _down(edges)
    state = None
    while True:
        edges = written(edges, "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        edges = written(_down(edges.join(least, "v").select("u", F.col("m").alias("v"))), "edges")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        met = edges.join(least, "u")
        edges = _down(met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))))


def _down(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
    limit: int = LIMIT, hot: int = HOT_ROWS,
) -> DataFrame:
    """One row per document: doc_id, th, fp, root (the class), component_id (smallest doc_id of the class).

    Null ids are least of no class, so a class of null ids only has a null component_id.  Repeated rows are rows of
    one class.  Other columns are not read.
    """
    rows = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    found = components(links(distinct.select("fp"), radius, limit))
    named = distinct.join(found, distinct.fp == found.node, "left")
    named = written(named.select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("k"))
    classes = join_stats(named, least, ["root"], "k", ["fp"], hot).select("fp", "n", "root", "component_id")
    out = join_stats(rows, written(classes, "classes"), ["fp"], "n", ["doc_id"], hot)
    return out.select("doc_id", "th", "fp", "root", "component_id")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


@query("op2_simhash")
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    out = near_duplicates(documents(spark, folder))
    return out.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")

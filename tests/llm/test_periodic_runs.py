import hashlib
import random
import zlib

import numpy as np
import pytest

from tallyworks.llm import QUERIES
from tallyworks.llm import periodic_runs as P


def brute(words, least=12):
    """All (start, length, period): every lag, every maximal stretch, smallest lag of equal stretches."""
    known = {}
    w, best = np.array([known.setdefault(x, len(known)) for x in words], np.int64), {}
    for q in range(1, len(w) // 2 + 1):
        edge = np.diff(np.r_[0, (w[:-q] == w[q:]).astype(np.int8), 0])
        for i, j in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            if j + q - i >= max(least, 2 * q):
                best.setdefault((i, j + q - i), q)
    return sorted((s, n_, q) for (s, n_), q in best.items())


def kept(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def texts(rng):
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 300, ["a", "b"] * 40, (["a"] * 30 + ["b"]) * 9, (["a", "b"] * 12 + ["a"]) * 5]
    fib = [["a"], ["a", "b"]]
    for _ in range(9):
        fib.append(fib[-1] + fib[-2])
    thue = [bin(i).count("1") % 2 for i in range(300)]
    out += [fib[-1], [str(x) for x in thue]]
    for size in (1, 2, 3, 50):
        for _ in range(40):
            w = [rng.randrange(size) for _ in range(rng.randint(0, 60))]
            for _ in range(rng.randint(0, 4)):
                a = rng.randint(0, len(w))
                p = rng.randint(1, 40)
                unit = [rng.randrange(size + 1) for _ in range(p)]
                w[a:a] = (unit * 8)[: rng.randint(p, 4 * p)]
            out.append([str(x) for x in w])
    return out


@pytest.mark.parametrize("least", [2, 3, 7, 9, 12, 15, 16, 33])
def test_numbers_against_all_lags(least):
    all_ = texts(random.Random(least))
    found = [brute(w, least) for w in all_]
    ids, first = [], [0]
    for w in all_:
        base = len(ids)
        known = {}
        ids += [base + known.setdefault(x, len(known)) for x in w]
        first.append(len(ids))
    start, length, period = P.runs(np.array(ids, np.int64), max(map(len, all_)), least)
    got = [[] for _ in all_]
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()):
        d = int(np.searchsorted(first, s, side="right")) - 1
        got[d].append((s - first[d], n, q))
    assert got == found


def test_rows_against_all_lags(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(" \n\t") + "  ".join(w), "x", 1) for i, w in enumerate(texts(rng))]
    rows += [(None, "a " * 20, "x", 1), (7, "é ß " * 9, "x", 1), (7, "é ß " * 9, "x", 1), (900, None, "x", 1), (901, "  " * 13, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, kept int").repartition(3)
    want = []
    for i, t, *_ in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        f = brute(w)
        want.append((i or -1, len(w), f, " ".join(kept(w, f))))
    got = [(r.doc_id or -1, r.n_words, [tuple(x) for x in r.runs], r.kept) for r in P.periodic_runs(docs).collect()]
    assert sorted(got) == sorted(want)
    assert P.periodic_runs(docs.where("false")).count() == 0


def test_text_of_one_word_takes_no_quadratic_time(spark):
    docs = spark.createDataFrame([("a", "so " * 300_000), ("b", "so " * 1000 + "it " + "so " * 1000)], "doc_id string, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.kept) for r in P.periodic_runs(docs).collect()}
    assert got["a"] == ([(0, 300_000, 1)], "so")
    assert got["b"][0] == [(0, 1000, 1), (1001, 1000, 1)]


def test_query_against_all_lags(spark):
    """Every document of the smallest table, planted runs included."""
    folder = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        w = [x.decode() for x in (r.text or "").encode().split()]
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        f = brute(w)
        top = min(f, key=lambda x: (-x[1], x[0], x[2])) if f else (None, None, None)
        milli = 1000 * top[1] // top[2] if f else None
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{m},{q}\n" for s, m, q in f), " ".join(kept(w, f)))]
        want[r.doc_id] = (len(f), *top, milli, *sha)
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
    assert got == want

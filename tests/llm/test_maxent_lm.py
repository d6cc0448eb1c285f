import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tallyworks.llm import maxent_lm as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


def corpus():
    """Chains of words: the next word mostly follows from the one before; with odd rows."""
    rng = random.Random(2)
    rows = []
    for i in range(400):
        at, out = rng.randrange(60), []
        for _ in range(rng.randint(5, 120)):
            at = (at * 7 + 3 + (rng.random() < 0.1) * rng.randrange(60)) % 60
            out.append(f"w{at}")
        rows.append((i, " ".join(out)))
    rows += [(500, None), (501, ""), (502, "É é W1 w1\tW1"), (503, "never seen " * 3), (None, "w1 w2"), (3, rows[3][1]), (504, "q" * 50_000), (505, "w1 " * 30_000)]
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, 0.5) for i, t in corpus()], "doc_id long, text string, h int, row int, score double")
    return M.scores(docs).collect()


def check(out):
    rows = corpus()
    c = Counter()
    for i, t in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        base = sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w)
        want[i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(c[x] > 0 for x in w), n, round(base, 5)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out) == want


def test_base_equals_brute_force(scored):
    check(scored)
    assert all(r.score <= 1e-6 for r in scored)


def test_held_out_texts_are_likelier_than_by_single_words(scored):
    out = [r for r in scored if r.held_out and r.doc_id < 400]
    n = sum(r.n_tokens for r in out)
    assert sum(r.score for r in out) / n > sum(r.base_score for r in out) / n + 0.3


def test_words_beyond_the_broadcast_meet_the_table(spark, scored, monkeypatch):
    monkeypatch.setattr(M, "KNOWN", 40)
    out = M.scores(spark.createDataFrame(corpus(), "doc_id long, text string")).collect()
    check(out)
    assert all(r.score <= 1e-6 for r in out)


def test_probabilities_of_all_words_add_up_to_one():
    x = np.random.default_rng(1).standard_normal((4, M.CLASSES))
    assert np.allclose(np.exp(M.log_softmax(x)).sum(axis=1), 1)
    lex = M.Lexicon.of(np.array([5, 9, 1 << 63], np.uint64), np.array([3, 8, 1]))
    assert lex.find(np.array([9, 4, 1 << 63, 5], np.uint64)).tolist() == [1, -1, 2, 0]
    assert lex.number.tolist() == [1, 0, 2]


def test_gradient_steps_learn():
    rng = np.random.default_rng(0)
    w, memory = np.zeros((M.SLOTS, M.CLASSES), np.float32), np.full((M.SLOTS, M.CLASSES), 1e-2, np.float32)
    one = rng.integers(0, M.CLASSES, 20_000)
    slots = M.features(one, np.zeros_like(one))
    for k in [*range(0, 20_000, 1000)] * 10:
        M._step(w, memory, slots[k : k + 1000], one[k : k + 1000])
    p = np.exp(M.log_softmax(w[slots[:500]].sum(axis=1)))
    assert p[np.arange(500), one[:500]].mean() > 0.9


def test_empty_table(spark):
    assert M.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nothing_to_learn_from(spark):
    out = M.scores(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score, r.base_score) for r in out] == [(3, 0, 0, 0.0, 0.0)]

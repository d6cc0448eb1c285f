import random
import re

import numpy as np
import pytest

from tallyworks.llm import pii_tagger as P
from tallyworks.llm.bilstm_crf import Tagger

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def brute(text):
    out = []
    checks = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), P._is_card, P._is_phone]
    for k, (pattern, check) in enumerate(zip((EMAIL, IP, P.CARD, P.PHONE), checks)):
        out += [(m.start(), m.end(), k) for m in pattern.finditer(text) if check(m[0])]
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_patterns_equal_plain_search():
    rng = random.Random(9)
    pieces = ["a", "Z9", "@", ".", "..", "-", "+", "+1", " ", "(", ")", "1.2.3.4", "256", "300.1.1.1", "4539 1488 0343 6467", "@b.c", "x@y.z", "%", "é", "00", "7", "\n"]
    for _ in range(3000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert P.base_spans(t)[0] == brute(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 200_000 + "@", "1" * 200_000, "a@" * 50_000, "+1(" * 50_000, "1." * 100_000):
        P.base_spans(t)


def test_gradient():
    m = Tagger(9, 5).start()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 9, (3, 6)), rng.integers(0, 5, (3, 6))
    _, g = m.gradient(x, y)
    for k, v in m.p.items():
        at = tuple(rng.integers(0, s) for s in v.shape)
        old, e = v[at], 1e-3
        v[at] = old + e
        up = m.gradient(x, y)[0]
        v[at] = old - e
        down = m.gradient(x, y)[0]
        v[at] = old
        assert abs((up - down) / 2 / e - g[k][at]) < 1e-3


def test_viterbi_and_marginals_equal_enumeration():
    from itertools import product

    m = Tagger(3, 3).start()
    rng = np.random.default_rng(1)
    m.p["A"] = rng.standard_normal((3, 3)).astype(np.float32)
    em = rng.standard_normal((2, 4, 3)).astype(np.float32)
    best = m.viterbi(em, np.array([4, 4]))
    prob = m.marginals(em, np.array([4, 4]))
    for i in range(2):
        paths = list(product(range(3), repeat=4))
        score = np.array([sum(em[i, t, p[t]] for t in range(4)) + sum(m.p["A"][a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert tuple(best[i]) == paths[int(score.argmax())]
        w = np.exp(score - score.max())
        w /= w.sum()
        want = np.zeros((4, 3))
        for p, x in zip(paths, w):
            want[np.arange(4), list(p)] += x
        assert np.abs(prob[i] - want).max() < 1e-4


def person(rng):
    card = [4, *[rng.randint(0, 9) for _ in range(14)]]
    check = next(d for d in range(10) if P.luhn("".join(map(str, [*card, d]))))
    return rng.choice([
        f"{rng.choice('abcdef')}{rng.randint(1, 99)}.x@mail{rng.randint(0, 9)}.example.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "".join(map(str, [*card, check])), f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
    ])


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 4)))
    return [(i, " ".join([*(word() for _ in range(rng.randint(5, 40))), *([person(rng)] if i % 2 else ["version", "2.0"]), word(), word()])) for i in range(300)]


@pytest.fixture(scope="module")
def model(spark, corpus):
    return P.fit(spark.createDataFrame(corpus, "doc_id long, text string"))


def test_model_finds_held_out_and_altered_spans(model):
    rng = random.Random(8)
    texts = [f"there and {person(rng)} other thing" for _ in range(60)]
    raw = P.tagged(texts, model)
    assert sum(bool(set(P.base_spans(t)[0]) & set(r)) for t, r in zip(texts, raw)) >= 45
    added = P.find_spans(["ther onan a7.x [at] mail3.example.com here", "heth (415) 555-2671 thon", "on 2024-05-06 10:20:30 there", "version 10.2.1 of", "card 4539148803436468 fails"], model)
    found = [[("ther onan a7.x [at] mail3.example.com here", "heth (415) 555-2671 thon")[i][a:b] for a, b, _ in s[1]] for i, s in enumerate(added[:2])]
    assert found[1] == ["(415) 555-2671"] or "mail3.example.com" in "".join(found[0])
    assert [s[1] for s in added[2:]] == [[], [], []]


def test_spans_across_windows_are_found_once(model):
    t = "there " * 3 + "1234 " * 30 + "+1 (415) 555-2671 " + "there 77 " * 20
    spans = P.find_spans([t], model)[0]
    assert [s for s in spans[1] if s[2] == 3 and s in spans[0]] == spans[0]


def test_tag_and_redact(spark, model):
    rows = [(1, None), (2, ""), (3, "mail é a.b@c.de now"), (3, "mail é a.b@c.de now"), (4, "nothing"), (5, "a@b.c" + " w" * 50_000 + " 10.0.0.1"), (None, "+49 (30) 1234567")]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, spans string, start int")
    out = P.redact(docs, model)
    assert out.schema == docs.schema
    got = [r.text for r in out.collect()]
    assert got[:5] == [None, "", "mail é [EMAIL] now", "mail é [EMAIL] now", "nothing"]
    assert got[5].startswith("[EMAIL] w") and got[5].endswith(" [IP]") and got[6] == "[PHONE]"
    tagged = P.tag(docs.select("doc_id", "start", "text"), model).collect()
    assert [(s.start, s.end, s.kind) for s in tagged[2].base] == [(7, 15, 0)]
    assert [len(r.spans) for r in tagged] == [0, 0, 1, 1, 0, 2, 1]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.fit(docs) is None
    assert P.tag(docs, None).count() == 0 and P.redact(docs, None).count() == 0


LONG = "christopher.montgomery.smith [at] department.longcompanyname.example.com"


@pytest.mark.parametrize("address", [LONG, LONG.upper(), LONG.replace("[at]", "( At )"), "jo dot doe [AT] mail [DOT] example [dot] com", "mary.jones at mail dot example dot com"])
def test_spelled_addresses_go_whole(spark, model, address):
    docs = spark.createDataFrame([(1, f"please write {address} before noon", 5), (2, "they sat [here] at home, look at the dot in it", 6)], "doc_id long, text string, n int")
    assert [r.text for r in P.redact(docs, model).collect()] == ["please write [EMAIL] before noon", "they sat [here] at home, look at the dot in it"]


def test_plain_spelled_addresses_are_read_and_go_whole(spark, model):
    t = "ther onan mary.jones at longcompanyname dot example dot company here"
    assert P.stretches(t) and P.stretches("they sat at home") == []
    docs = spark.createDataFrame([(1, t), (2, "at home and there"), (3, "the dot stays"), (4, t.upper())], "doc_id long, text string")
    seen = [len(texts) for _, _, texts, _ in P._found(iter(docs.toArrow().combine_chunks().to_batches()), 1, "text", None)]
    assert seen == [2]
    batch = docs.toArrow().combine_chunks().to_batches()[0]
    assert [len(texts) for _, _, texts, _ in P._found(iter([batch, batch]), 1, "text", None)] == [2, 2]

    class Sure:
        """Finds the middle of the address only."""

        def emissions(self, x):
            return np.zeros((*x.shape, 9), np.float32)

        def viterbi(self, em, size):
            out = np.zeros(em.shape[:2], int)
            a, b = t.index("at long"), t.index(" example")
            out[:, a:b] = 2
            out[:, a] = 1
            return out

        def marginals(self, em, size):
            return np.ones(em.shape, np.float32)

    assert P.find_spans([t], Sure())[0][1] == [(t.index("mary"), t.index(" here"), 0)]


def test_stretches_end_with_their_tokens_and_take_linear_time():
    for t in ("a" * 200_000 + "1", "1 " * 50_000, "1" + "a" * 100 * 1000, ("1" + "a" * 99) * 1000, "x at y dot " * 20_000, "x[at]" * 20_000):
        got = P.stretches(t)
        assert all(a == 0 or t[a - 1].isspace() or t[a].isspace() for a, _ in got) and all(a[1] < b[0] for a, b in zip(got, got[1:]))


def test_numbers_of_any_length_are_read():
    assert P._is_ip("0" * 5000 + "1.1.1.1") and not P._is_ip("9" * 5000 + ".1.1.1") and P._is_ip("000.0.0.255")

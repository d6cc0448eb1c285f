import random
import re

import pytest

from tallyworks.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """{(id, text): (n_words, n_removed, kept)}; rows of one id and text are one document."""
    docs = sorted({(i is None, i, t or "") for i, t in rows}, key=lambda r: (r[0], r[1] or 0, r[2]))
    seen, out = set(), {}
    for none, i, t in docs:
        w = WORD.findall(t)
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            k = tuple(w[a : a + width])
            if k in seen:
                gone[a : a + width] = [True] * width
            seen.add(k)
        out[i, t] = len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)
    return out


def check(spark, rows, **options):
    schema = "id string, doc_id long, text string, th string, at int, spans string"
    docs = spark.createDataFrame([("x", i, t, "y", 1, "z") for i, t in rows], schema)
    out = substrings.remove_repeated(docs, **options).collect()
    want = brute(rows, options.get("width", 20))
    by_id = {}
    for (i, _), v in want.items():
        by_id.setdefault(i, set()).add(v)
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.n_removed, r.kept) in by_id[r.doc_id]
    assert {(r.doc_id, r.kept) for r in out} == {(i, v[2]) for (i, _), v in want.items()}


def test_edge_cases(spark):
    p = " ".join(f"w{i}" for i in range(30))
    check(spark, [(1, None), (2, ""), (3, " \n "), (4, p), (4, p), (5, p), (6, "é " + p.replace(" ", "\t\n") + " ß"), (None, p + " tail"), (7, "one two"), (8, "a " * 50), (9, "x" * 10_000)])


def test_one_id_with_two_texts_is_two_documents(spark):
    p = " ".join(f"w{i}" for i in range(25))
    out = {(r.doc_id, r.n_words, r.n_removed) for r in substrings.remove_repeated(spark.createDataFrame([(1, p), (1, p + " more")], "doc_id long, text string")).collect()}
    assert {(n, r > 0) for _, n, r in out} in ({(25, False), (26, True)}, {(25, True), (26, False)})


def test_empty_table(spark):
    assert substrings.remove_repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("pass_cells", [1 << 23, 50])
def test_random_passages_against_brute_force(spark, pass_cells):
    """A hot passage in a third of the documents, shared stretches, loops; also with many passes."""
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(60)]
    passages = [[rng.choice(vocab) for _ in range(rng.randint(5, 40))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = passages[0] if i % 3 == 0 else rng.choice(passages)
        rows.append((rng.randint(0, 1000) * 100 + i, " ".join(words)))
    check(spark, rows, width=7, gram=3, pass_cells=pass_cells)


def test_estimates_never_miss_a_repeat(spark):
    """The key counts of the sketches are at least the counts of the windows that hold them."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 23}" for j in range(80))) for i in range(12)]
    found = substrings.repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), width=6, gram=2)
    covered = {(r.id, r.at + k) for r in found.collect() for k in range(r.n)}
    seen, want = set(), set()
    for i, t in rows:
        w = t.split()
        for a in range(len(w) - 5):
            k = tuple(w[a : a + 6])
            if k in seen:
                want.add((i, a))
            seen.add(k)
    assert covered == want


def test_long_words_that_polynomials_confuse_are_told_apart(spark):
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    w = " ".join(f"w{i}" for i in range(19))
    out = {r.doc_id: r.n_removed for r in substrings.remove_repeated(spark.createDataFrame([(1, f"{w} {thue}"), (2, f"{w} {other}")], "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 0}

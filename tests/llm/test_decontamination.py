import random

import numpy as np

from tallyworks.llm import decontamination as D


def brute_align(a, b):
    rows = [[0] * (len(b) + 1)]
    best, end = 0, 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, rows[-1][j] + (D.MATCH if x == y else D.MISMATCH), rows[-1][j + 1] + D.GAP, row[j] + D.GAP))
            if row[-1] > best:
                best, end = row[-1], j
        rows.append(row)
    return best, end


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 12, 50)
    items = [rng.integers(1, 6, n) for n in sizes]
    texts = [rng.integers(1, 6, rng.integers(1, 20)) for _ in sizes]

    def block(rows):
        out = np.zeros((len(rows), max(map(len, rows))), np.uint64)
        for r, v in zip(out, rows):
            r[: len(v)] = v
        return out

    best, end = D.align(block(items), sizes, block(texts))
    for i, (a, b) in enumerate(zip(items, texts)):
        assert best[i] == brute_align(a, b)[0]


def make(rng, vocab, n):
    return [rng.choice(vocab) for _ in range(n)]


def test_copies_edits_and_clean_documents(spark):
    rng = random.Random(11)
    vocab = [f"v{i}x" for i in range(4000)]
    common = ["the", "of", "and", "to"]
    filler = lambda n: [rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab) for _ in range(n)]
    items = {i: filler(rng.randint(12, 60)) for i in range(30)}
    docs, want = [], set()
    for i, words in items.items():
        for kind in range(4):
            w = list(words)
            if kind == 1:  # words replaced
                for j in rng.sample(range(len(w)), len(w) // 8):
                    w[j] = rng.choice(vocab)
            elif kind == 2:  # words dropped and put in
                del w[len(w) // 2]
                w.insert(len(w) // 3, "extra")
            elif kind == 3:
                w = [x.upper() + rng.choice([",", ".", "!"]) for x in w]
            want.add((100 * i + kind, i))
            docs.append((100 * i + kind, " ".join(filler(rng.randint(0, 400)) + w + filler(rng.randint(0, 200)))))
    clean = [(10_000 + i, " ".join(filler(rng.randint(1, 600)))) for i in range(150)]
    # One item is in a third of all documents.
    hot = [(20_000 + i, " ".join(filler(20) + items[3] + filler(5))) for i in range(130)]
    odd = [(30_000, None), (30_001, ""), (30_002, "..."), (30_003, "word " * 20_000), (hot[0][0], hot[0][1]), (None, " ".join(items[5]))]
    table = spark.createDataFrame([(a, b, 1, "x") for a, b in docs + clean + hot + odd], "doc_id long, text string, item_id int, score string")
    bench = [(i, " ".join(w)) for i, w in items.items()] + [(90, None), (91, ""), (92, "the of"), (None, "a b c d e"), (3, " ".join(items[3]))]
    bench = spark.createDataFrame([(a, b, 2) for a, b in bench], "item_id long, text string, doc_id int")
    for block_bytes in (D.BLOCK_BYTES, 1500):
        got = {(r.doc_id, r.item_id): r for r in D.leaks(table, bench, block_bytes=block_bytes).collect()}
        assert set(got) == want | {(i, 3) for i, _ in hot} | {(None, 5)}
    r = got[100 * 7, 7]
    text = dict(docs)[700].split()
    assert r.score == 1 and text[r.begin : r.end + 1] == items[7]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert D.leaks(docs, bench).count() == 0
    assert D.leaks(docs, full).count() == 0
    assert D.leaks(full.withColumnRenamed("item_id", "doc_id"), bench).count() == 0

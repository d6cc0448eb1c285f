import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyworks.llm import simhash


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, radius=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


TEXTS = [
    None, "", "  \n\t", "One", "one", "ONE two", "one two three", "One  two\nthree", "Éa b c d", "a b c d e f g h", "a b c d e f g h",
    "a b c d e f g x", "x" * 5000, " ".join(f"w{i % 97}" for i in range(3000)), " ".join(f"w{i % 97}" for i in range(3001)),
]


def test_fingerprints_and_classes(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(3, "One", "repeated"), (None, "one", "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    want = {(i, brute_fingerprint(t)) for i, t, _ in rows}
    got = {(r.doc_id, r.fp & 0xFFFFFFFFFFFFFFFF) for r in out}
    assert got == want
    classes = brute_classes({f for _, f in want})
    least = {}
    for i, f in want:
        if i is not None:
            least[classes[f]] = min(i, least.get(classes[f], i))
    assert all(r.component_id == least[classes[r.fp & 0xFFFFFFFFFFFFFFFF]] for r in out)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0


@pytest.mark.parametrize("limit", [2048, 8])
def test_links_join_what_brute_force_joins(spark, limit):
    """A dense cloud of near fingerprints, chains, and noise; a small limit files them three times."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:3]:
        for _ in range(150):
            fps.add(b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    chain = base[5]
    for _ in range(20):
        chain ^= 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        fps.add(chain)
    signed = [f - ((f >> 63) << 64) for f in fps]
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), limit=limit)).collect()
    root = {r.node & 0xFFFFFFFFFFFFFFFF: r.root & 0xFFFFFFFFFFFFFFFF for r in found}
    want = brute_classes(fps)
    same = {}
    for f in fps:
        same.setdefault(want[f], set()).add(root.get(f, f))
    assert all(len(v) == 1 for v in same.values())
    assert len({next(iter(v)) for v in same.values()}) == len(same)


def test_close_pairs_counts_distances():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 10, 300).astype(np.uint64)
    file = np.sort(rng.integers(0, 3, 300))
    file = file[np.argsort(-np.bincount(file)[file], kind="stable")]
    got = {(int(a), int(b)) for i, j in simhash.close_pairs(file, fp) for a, b in zip(i, j)}
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if file[a] == file[b] and (int(fp[a]) ^ int(fp[b])).bit_count() <= 2}
    assert got == want


def test_component_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(i, 0) for i in range(1, 201)}

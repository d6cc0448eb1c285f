import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pytest

from tallyworks.llm import packing as P


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def best_fit(sizes, cap):
    """Sequences of sequential best-fit decreasing."""
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        i = bisect_left(gaps, s)
        gap = gaps.pop(i) if i < len(gaps) else cap
        n += gap == cap and True
        if gap - s:
            insort(gaps, gap - s)
    return n


def check(rows, cap):
    """Sequences are gapless and hold no more than cap; returns how many there are."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= cap
    return len(by)


def test_word_by_word_ids_are_the_tokenizers():
    t, path = tokenizer(), P.vocabulary_path()
    rng = random.Random(3)
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b\n\n c ", "a  b  c", "don't 'll x's", "é ñ 你好 你", "<|endoftext|> a", "a\x1c b \x85 c", "1234 5,6"]
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "'s", "12", ",", "你", " ", "　", "<|endoftext|>", "\x1d", "​", "-"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    for x in texts + texts:  # the second time from what is kept
        assert P.token_bytes(x, path) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_pieces_against_the_tokenizer(spark):
    t = tokenizer()
    long = " ".join(f"w{i}" for i in range(900))
    rows = [(1, "a b"), (2, None), (3, ""), (None, "x y z"), (1, "a b"), (4, long), (5, "in " * 31), (6, "in " * 63)]
    docs = spark.createDataFrame([("q", *r, 1) for r in rows], "id string, doc_id long, text string, round int")
    got = P.packed(docs, cap=32).collect()
    check(got, 32)
    want = []
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 32 or 32
        at = [0, *range(head, len(ids), 32)]
        for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)])):
            want.append((i or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert P.packed(docs.where("false")).count() == 0


SHAPES = {
    "uniform": lambda r: r.randint(1, 2048),
    "small": lambda r: r.randint(1, 40),
    "one size in a third": lambda r: 700 if r.random() < 0.34 else r.randint(1, 2047),
    "halves": lambda r: r.choice((1024, 1024, 1023, 1025)),
    "large and tiny": lambda r: r.randint(1100, 1500) if r.random() < 0.3 else r.randint(5, 30),
    "skewed": lambda r: min(2047, int(r.paretovariate(0.8) * 20)),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_nearly_as_few_sequences_as_sequential_best_fit(spark, shape):
    rng = random.Random(1)
    sizes = [SHAPES[shape](rng) for _ in range(4000)]
    items = spark.createDataFrame(list(enumerate(sizes)), "id long, size long").repartition(4)
    out = P.assigned(items).collect()
    assert sorted((r.id, r.size) for r in out) == list(enumerate(sizes))
    fill = {}
    for r in out:
        fill[r.seq] = fill.get(r.seq, 0) + r.size
    assert max(fill.values()) <= 2048
    print(shape, len(fill), best_fit(sizes, 2048), -(-sum(sizes) // 2048), max(r.round for r in out) + 1)
    assert len(fill) <= 1.01 * best_fit(sizes, 2048) + 2


def test_brackets_meet_across_ranges():
    assert P._bridges({0: {0: 3}, 1: {1: 2, 0: 1}, 2: {1: 5}}) == [(1, 0, 2, 0, 2), (2, 0, 1, 1, 0), (2, 1, 2, 0, 0)]

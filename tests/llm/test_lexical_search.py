import math
import random
import re
from collections import Counter

import pytest

from tallyworks.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=10):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, tokens = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    want = {}
    for i, t in items:
        if i is not None:
            want.setdefault(i, set()).update(TERM.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in want.items():
        scores = []
        for place, (i, c) in enumerate(counts):
            m = 10 + 90 * sum(c.values()) * n // tokens
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, place))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i, _) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def prose(rng, n):
    return " ".join(rng.choice((f"w{int(rng.paretovariate(0.7))}", "The", "THE,", "é-Ä", "x_y", "7")) for _ in range(n))


@pytest.mark.parametrize("owners, bundle, pass_bytes, block", [(4, 128, 1 << 22, 1 << 14), (1, 1, 100, 3), (7, 5, 400, 16)])
def test_scores_against_all_documents(spark, owners, bundle, pass_bytes, block):
    rng = random.Random(owners)
    docs = [(i, prose(rng, rng.randint(0, 80))) for i in range(150)]
    docs += [(1000, None), (1001, " ,.! "), (None, "the w1 w2"), (3, "w1 w2 the"), (3, "w1 w2 the"), (1002, "w5 " * 3000)]
    docs += [(2000 + i, "hot words of a template w1") for i in range(60)]
    items = [(i, prose(rng, rng.randint(1, 12))) for i in range(14)]
    items += [(50, None), (51, "--"), (None, "w1"), (52, "w1"), (52, "W2 w2"), (53, "nowhere"), (54, "template w1 the")]
    rows = spark.createDataFrame([("x", *r, 1) for r in docs], "term string, doc_id long, text string, block int").coalesce(1)
    asked = spark.createDataFrame([(*r, 2) for r in items], "item_id int, text string, rank int")
    out = S.ranked(rows, asked, owners=owners, bundle=bundle, pass_bytes=pass_bytes, block=block).collect()
    assert sorted(map(tuple, out), key=repr) == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert S.ranked(docs, items).count() == 0
    assert S.ranked(spark.createDataFrame([(1, "a b")], docs.schema), items.where("false")).count() == 0
    only = [tuple(r) for r in S.ranked(spark.createDataFrame([(1, "a b")], docs.schema), items).collect()]
    assert only == brute([(1, "a b")], [(1, "a b")])

from collections import defaultdict

from tallyworks.llm import mixing


def fill(sizes, weights=(3, 1, 2), share=1.5, repeats=2):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, open_ = share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        now = {s: target[s] + left * weight[s] / total for s in open_}
        left = 0.0
        for s, t in now.items():
            target[s] = min(t, repeats * sizes[s])
            left += t - target[s]
        open_ = {s for s in open_ if target[s] < repeats * sizes[s] - 1e-9}
    return target


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id long, text string, source string, size int, row int")
    return mixing.weighted_mix(docs)


def test_targets_and_takes(spark):
    rows = [(i, "w " * (i % 17), f"s{i % 5}") for i in range(300)] + [(1000 + i, "hot word " * 20, "hot") for i in range(150)]
    rows += [(2000, None, "empty"), (2001, "", "empty"), (2002, "a b", None), (2002, "a b", None), (None, "c d e", "\U0001f600"), (None, "c d e", "￿")]
    out = run(spark, rows).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = fill(sizes)
    took, per_row = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        took[r.source] += r.taken * r.size
        per_row[r.row] += r.taken * r.size
        assert per_row[r.row] <= 2 * r.size
    assert len(per_row) == len(rows)
    for s, t in want.items():
        assert abs(took[s] - t) <= 2 * 40 + 1, (s, took[s], t)
    again = {(r.doc_id, r.copy, r.before, r.taken) for r in run(spark, rows[::-1]).collect()}
    assert again == {(r.doc_id, r.copy, r.before, r.taken) for r in out}


def test_queues_advance_together(spark):
    """At any point of the mix each open source has had its share of what was sent."""
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(600)]
    out = sorted((r for r in run(spark, rows).collect() if r.taken), key=lambda r: r.before)
    half = out[: len(out) // 2]
    for s in "abc":
        whole = sum(r.size for r in out if r.source == s)
        assert abs(sum(r.size for r in half if r.source == s) - whole / 2) <= 20


def test_empty_and_wordless_tables(spark):
    assert run(spark, []).count() == 0
    assert [r.taken * r.size for r in run(spark, [(1, None, "a")]).collect()] == [0, 0]


def test_mixed_documents_keep_columns(spark):
    rows = [(i, f"text number {i}", "en", "ab"[i % 2], 9) for i in range(40)] + [(3, "text number 3", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixed_documents(docs)
    assert out.columns == [*docs.columns, "mix_position"]
    got = out.collect()
    assert 55 <= len(got) <= 60 and len({r.mix_position for r in got}) == len(got)


def test_a_column_named_th_stays(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "mine"), (2, "c d", "s", "yours")], "doc_id long, text string, source string, th string")
    out = mixing.mixed_documents(docs)
    assert out.columns == ["doc_id", "text", "source", "th", "mix_position"]
    assert {(r.doc_id, r.th) for r in out.collect()} <= {(1, "mine"), (2, "yours")} and out.count() == 3

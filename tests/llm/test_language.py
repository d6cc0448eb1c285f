import random

import pytest

from tallyworks.llm import language as L

SYLLABLES = {"aa": "tha ing en ed wh sh", "bb": "que ção ñez lla ado", "cc": "sch ung über ein keit", "dd": "привет мир как дела"}


def text(lang, rng, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(text(lang, rng, rng.randint(2, 200)), lang) for lang in SYLLABLES for _ in range(60)]
    rows += [(None, "aa"), ("no label", None), ("", "bb")]
    return L.fit(spark.createDataFrame(rows, "text string, lang string"))


def predict(spark, model, texts):
    docs = spark.createDataFrame([(i, t, "zz", 0.5, True) for i, t in enumerate(texts)], "doc_id int, text string, lang_ string, score_ double, at boolean")
    return {r.doc_id: r for r in L.predict(docs, model).collect()}


def test_held_out_accuracy(spark, model):
    rng = random.Random(2)
    langs = [lang for lang in SYLLABLES for _ in range(50)]
    out = predict(spark, model, [text(lang, rng, rng.randint(3, 60)) for lang in langs])
    assert sum(out[i].lang_pred == lang for i, lang in enumerate(langs)) >= 195
    assert all(0 <= r.score <= 1 and r.lang_ == "zz" for r in out.values())
    assert not any(r.rejected for r in out.values())


def test_edge_texts(spark, model):
    out = predict(spark, model, [None, "", "123 !!! \n", "é", "ну", "tha" * 30_000, "\x00\x01", "x1"])
    assert [out[i].lang_pred == "und" for i in range(8)] == [True, True, True, False, False, False, True, False]
    assert all(out[i].rejected and out[i].score == 0 for i in (0, 1, 2, 6))
    assert out[5].lang_pred == "aa" and out[4].lang_pred == "dd"


def test_far_texts_are_rejected(spark, model):
    out = predict(spark, model, ["的一是不了人我在有他这中大来上国" * 5, "ελληνικά κείμενα"])
    assert all(r.rejected and r.lang_pred != "und" for r in out.values())


def test_accepted_keeps_rows_as_they_are(spark, model):
    docs = spark.createDataFrame([(1, "thaing enwh", None), (2, None, "x"), (2, "77", "x"), (1, "thaing enwh", None)], "doc_id long, text string, lang string")
    assert L.accepted(docs, model).collect() == [(1, "thaing enwh", None)] * 2


def test_counts_equal_brute_force():
    import numpy as np

    texts = ["Ab c", "", "é!b"]
    raw = "".join(texts).encode()
    ends = np.cumsum([0, *[len(t.encode()) for t in texts]])
    got = L.counts(np.frombuffer(raw, np.uint8), ends)
    for i, t in enumerate(texts):
        b = [c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in t.encode()]
        assert got[i].sum() == sum(c != 32 for c in b) + sum(max(0, len(b) - k + 1) for k in (2, 3))


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = L.fit(empty)
    assert predict(spark, model, ["words here"])[0].lang_pred == "und"
    assert L.predict(empty.select("doc_id", "text"), model).count() == 0


def garbage(rng, n):
    return ["".join(rng.choice("0123456789abcdef") for _ in range(400)) for _ in range(n)]


def test_labelled_garbage_gets_no_centroid_and_does_not_move_the_limit(spark):
    rng = random.Random(3)
    rows = [(text(lang, rng, rng.randint(2, 200)), lang) for lang in SYLLABLES for _ in range(300)]
    junk = [(t, "bb") for t in garbage(rng, 2)] + [("zxqj", "aa"), ("的一是不了人我在", "aa"), ("kkkk", "cc")]
    fitted = [L.fit(spark.createDataFrame(rows + more, "text string, lang string")) for more in ([], junk)]
    for m in fitted:
        out = predict(spark, m, garbage(rng, 20) + [text(lang, rng, 20) for lang in SYLLABLES for _ in range(20)])
        assert [out[i].rejected for i in range(100)] == [True] * 20 + [False] * 80
    clean, dirty = ({lang: m.least[m.of == i].min() for i, lang in enumerate(m.langs)} for m in fitted)
    assert all(dirty[lang] > 0.5 * clean[lang] for lang in SYLLABLES)


def test_a_text_without_a_letter_is_undetermined(spark, model):
    docs = spark.createDataFrame([(1, "½ ② ³ 12"), (2, "²ª")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in L.predict(docs, model).collect()}
    assert got[1] == "und" and got[2] != "und"


def test_a_hot_text_is_drawn_once(spark):
    rows = [("a", "hot words here " * 5)] * 3000 + [("a", f"text number {i} of it") for i in range(300)] + [("b", f"otro texto {i} aqui") for i in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert set(L.fit(docs, sample=400).langs) == {"a", "b"}


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_counts_do_not_depend_on_blocks(monkeypatch, block):
    import numpy as np

    rng = random.Random(3)
    texts = ["", *["".join(rng.choice("aB é!ж1 ") for _ in range(rng.randint(0, 40))) for _ in range(20)], "", ""]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([0, *[len(t.encode()) for t in texts]])
    want = L.counts(raw, ends)
    monkeypatch.setattr(L, "BLOCK_BYTES", block)
    assert (L.counts(raw, ends) == want).all() and want.sum() > 0


def _peak_mb(work):
    import tracemalloc

    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_follows_neither_long_texts_nor_many(model):
    import numpy as np
    import pyarrow as pa

    long = np.frombuffer(text("aa", random.Random(4), 2000).encode() * 400, np.uint8)
    assert len(long) > 4_000_000
    assert _peak_mb(lambda: L.counts(long, np.array([0, len(long)]))) < 20
    batch = pa.RecordBatch.from_arrays([pa.array(["thaing enwh " * 80] * 2000)], ["text"])
    # A batch of 2 MB, in steps: counts, their bins and their weights of one step at a time.
    assert _peak_mb(lambda: [L._judged(step.column(0), model) for step in L._steps(iter([batch]), "text")]) < 20


def test_sample_of_a_language_is_held_once():
    import numpy as np

    rng = np.random.default_rng(5)
    x = (rng.random((600, L.DIM)) < 0.05).astype(np.float32)
    idf = np.ones(L.DIM, np.float32)
    want = L._unit(np.log1p(x) * idf)
    near = rng.random(len(x)) < 0.7
    mean = want[near].mean(axis=0)
    size = x.nbytes / 1e6
    assert _peak_mb(lambda: L._weigh(x, idf)) < size / 2 and (x == want).all()
    assert _peak_mb(lambda: L._mean(x, near)) < size / 2 and (L._mean(x, near) == mean).all()

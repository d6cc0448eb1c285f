import pytest
from pyspark.sql import functions as F

from tallyworks.functions import ids
from tallyworks.functions import vectors as vec
from tallyworks.operators import documents as dc
from tallyworks.operators import pages as pg
from tallyworks.operators import similarity as sim
from tallyworks.sinks import tables as snk
from tallyworks.sources import readers, schemas, views

# (file name, link text, hint, expected type)
TYPES = [
    ("quay-wall_scope-of-work_v3.pdf", "What the contractor delivers", "Scope_of_Work", "Scope_of_Work"),
    ("lot7_instructions to tenderers.pdf", "Read me first", "ITT", "ITT"),
    ("annex-b.pdf", "Tender Data Sheet for lot 7", "TDS", "TDS"),
    ("annex-c.pdf", "evaluation and qualification criteria, second edition", "Evaluation_Qualification_Criteria", "Evaluation_Qualification_Criteria"),
    ("2031-02-corrigendum.pdf", "Changed closing date", "Corrigendum", "Corrigendum"),
    ("lot7-boq.xlsx", "Priced bill of quantities", "BOQ", "BOQ"),
    ("award_of_contract_lot7.pdf", "Who won", "Award_of_Contract", "Award_of_Contract"),
    ("pumps.pdf", "Technical specifications of the pumps", "Technical_Specifications", "Technical_Specifications"),
    ("lot7-gcc.pdf", "General conditions of contract, lot 7", "GCC", "GCC"),
    ("lot7-scc.pdf", "Special conditions of contract, lot 7", "SCC", "SCC"),
    ("holiday-photos.zip", "summer outing", None, "Unknown"),
]


def test_document_types(spark):
    df = spark.createDataFrame(TYPES, "f string, a string, h string, want string")
    got = dc.with_class(df, "f", "a", hint="h").collect()
    assert all(r.classified_type == r.want and 0 <= r.classification_confidence <= 0.99 for r in got)
    assert [r.classification_confidence for r in got if r.h is None] == [0.0]


@pytest.mark.parametrize("hot", [0, 10**9])
def test_duplicates(spark, hot):
    rows = [("a", "h1", "REF-1", "Tender_Document", 100000, "s1"), ("b", "h2", "REF-1", "Tender_Document", 102000, "s1"),
            ("b2", "h2", "REF-1", "Tender_Document", 200000, "s2"), ("c", "h3", None, "Tender_Document", 100000, "s1"),
            ("d", "h1", "REF-1", "BOQ", 100000, "s2"), ("e", "h4", "REF-1", "Tender_Document", 95001, "s2")]
    df = spark.createDataFrame(rows, "document_id string, sha256 string, reference_number string, classified_type string, file_size_bytes long, source_id string")
    exact = {r.document_id: r.duplicate_of for r in dc.exact_duplicates(df, hot=hot).collect()}
    assert exact == {"a": "d", "d": "a", "b": "b2", "b2": "b"}
    for other in (False, True):
        want = {}
        for d, _, ref, kind, size, src in rows:
            fits = [x[0] for x in rows if ref and x[0] != d and x[2] == ref and x[3] == kind and size * 0.95 <= x[4] <= size * 1.05
                    and (not other or x[5] != src)]
            want[d] = min(fits) if fits else None
        got = {r.document_id: r.near_duplicate_of for r in dc.near_duplicates(df, other_source=other, hot=hot).collect()}
        assert got == want


def test_near_duplicates_by_brute_force(spark):
    rows = [(i, "r", "k", 1 + (i * i * 37) % 4000, f"s{i % 3}") for i in range(150)]
    df = spark.createDataFrame(rows, "document_id int, reference_number string, classified_type string, file_size_bytes long, source_id string")
    got = {r.document_id: r.near_duplicate_of for r in dc.near_duplicates(df).collect()}
    for i, _, _, n, _ in rows:
        fits = [j for j, _, _, m, _ in rows if j != i and n * 0.95 <= m <= n * 1.05]
        assert got[i] == (min(fits) if fits else None)


def inputs():
    c = {k: F.col(k) for k in ("tender_category", "product_category", "country", "source_type", "status", "classified_type", "has_base",
                               "has_corrigendum", "has_award", "page_count", "language", "size", "near_duplicate")}
    return c


def test_relevance(spark):
    strong = ("Evaluation criteria: similar work and qualification. Scope of work and technical specification follow. Bid capacity formula included. "
              "GCC and SCC.")  # fmt: skip
    base = ("Works", None, "IN", "official_portal")
    rows = [
        (strong, *base, "ok", "Tender_Document", True, True, True, 12, "en", 500_000, False),
        ("NIT only.", *base, "ok", "NIT", False, False, False, 12, "en", 15_000, False),
        ("", *base, "failed", "Tender_Document", True, False, False, None, "en", 500_000, False),
        (None, *base, None, "Tender_Document", True, False, False, None, None, 500_000, True),
    ]
    df = spark.createDataFrame(rows, "text string, tender_category string, product_category string, country string, source_type string, status string, "
                                     "classified_type string, has_base boolean, has_corrigendum boolean, has_award boolean, page_count int, language string, "
                                     "size long, near_duplicate boolean")  # fmt: skip
    a, b, c, d = dc.score_relevance(dc.with_facts(df), inputs()).collect()
    assert a.relevance_score >= 60 and a.recommended_for_training and a.recommended_for_demo
    assert b.relevance_score < 30 and not b.recommended_for_training and "only_nit(-15)" in b.relevance_reasons
    assert "extraction_failed(-20)" in c.relevance_reasons and not c.recommended_for_training
    assert d.relevance_score == 15 and d.relevance_reasons[-1] == "near_duplicate(-15)" and not d.recommended_for_training


PAGE = """<html><head><title>Lot 7: Harbour lights</title></head><body>
<table id="facts"><tr><th>Tender Reference No.<td>HL/2031/0007<tr class="odd"><td>Title</td><td>Renewal of <em>harbour</em> lights
<tr><td>Tender Value in Rs.</td><td>2,50,000</td><td>EMD Amount in Rs.</td><td>5,000</td></tr>
<tr><td>Published Date<td>17-Aug-2031 09:30<tr><td>alone</tr></table>
<table><tr><td>x<table><tr><td>Title</td><td></td></tr></table></td></tr></table>
<p><a href="/lots/7/itt.pdf">Instructions to Tenderers</a> <a href='/lots/7/sheet.pdf'>The <b>tender data sheet</b></a>
<a href=/lots/7/corrigendum-2.pdf>Corrigendum 2, new lamps</a> <a href="/account/login.pdf">Login and nit</a></p></body></html>"""
LISTING = """<ul><li><a href="/lots/7">View tender: lights</a><li><a href="/lots/8">view tender: buoys</a><li><a href="/lots/7">View tender once more</a></ul>
<a href="/lots?start=20">next page</a> <a href="/about">About</a>"""


def test_pages(spark):
    url = "https://harbour.example/lots/7"
    df = spark.createDataFrame([(1, url, "src", "cppp_parser", PAGE)], "page_id int, url string, source_id string, parser_name string, html string")
    r = pg.records(df).first()
    assert r.reference_number == "HL/2031/0007" and r.title == "Renewal of harbour lights"
    assert r.tender_value_inr == 250000 and r.emd_inr == 5000 and (r.published_date.year, r.published_date.month) == (2031, 8)
    links = {x.link: x.suggested_type for x in pg.document_links(df).collect()}
    assert links == {"https://harbour.example/lots/7/itt.pdf": "ITT", "https://harbour.example/lots/7/sheet.pdf": "TDS",
                     "https://harbour.example/lots/7/corrigendum-2.pdf": "Corrigendum"}
    flags = pg.page_flags(pg.document_links(df)).first()
    assert flags.has_corrigendum and not flags.has_award
    lst = spark.createDataFrame([(1, url, LISTING)], "page_id int, url string, html string")
    assert {r.link for r in pg.record_links(lst).collect()} == {"https://harbour.example/lots/7", "https://harbour.example/lots/8"}
    assert [r.next_page_url for r in pg.next_page(lst).collect()] == ["https://harbour.example/lots?start=20"]


def test_no_join_carries_texts_or_pages(spark):
    """Exchanges hold no text and no page source, but for the deal of test files that are one split."""
    from tallyworks.plans import QUERIES

    def plan(name):
        return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()

    for name in ("rul_02_relevance", "win_08_base_so_far", "jn_26_base_document", "jn_07_demo_manifest"):
        assert "text#" not in plan(name)  # the text was read and written as facts before
    for name in ("txt_07_label_values", "txt_08_records"):
        assert not any(w in plan(name) for w in ("Join", "Aggregate", "Window"))


def test_records_of_pages_without_tables(spark):
    rows = [(1, "https://a.example/1", "s", "cppp_parser", "<p>no table"), (2, None, "s", "cppp_parser", None), (3, "https://a.example/3", "s", "epublish_parser", "<title>T &eacute;</title>Notice No: AB-9")]
    df = spark.createDataFrame(rows, "page_id int, url string, source_id string, parser_name string, html string")
    got = {r.page_id: (r.title, r.reference_number) for r in pg.records(df).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: ("T é", "AB-9")}


def test_sitemap_cap_is_per_source(spark):
    page = lambda *u: "".join(f"<url><loc> {x} </loc></url>" for x in u)
    pages = spark.createDataFrame([("a", 2, page("/3", "/4")), ("a", 1, page("/1")), ("b", 3, page("/1")), ("a", 4, page("/5"))], "source_id string, page_id int, html string")
    sources = spark.createDataFrame([("a", "https://a.example/", 2), ("b", "https://b.example/", 9)], "source_id string, base_url string, max_pages_per_run int")
    got = sorted(tuple(r) for r in readers.sitemap_urls(pages, sources, "page_id").collect())
    assert got == [("a", 0, "https://a.example/1"), ("a", 1, "https://a.example/3"), ("b", 0, "https://b.example/1")]


def test_urls(spark):
    rows = [("HTTPS://Portal.Example:443/a?b=2&a=1&c#frag", "https://portal.example/a?a=1&b=2&c="), ("http://h.example", "http://h.example/"),
            ("http://u:p@h.example:8080/x?q=a%20b+c", "http://h.example:8080/x?q=a+b+c")]
    df = spark.createDataFrame(rows, "u string, want string").withColumn("got", ids.canonical_url("u"))
    assert [r.got for r in df.collect()] == [r[1] for r in rows]
    j = spark.createDataFrame([("https://h.example/a/b/c.html", x) for x in ("../d", "e.pdf", "/f", "//o.example/g", "https://z.example/", "?p=1")], "b string, h string")
    got = [r.x for r in j.select(ids.absolute_url("b", "h", dotted=True).alias("x")).collect()]
    assert got == ["https://h.example/a/d", "https://h.example/a/b/e.pdf", "https://h.example/f", "https://o.example/g", "https://z.example/",
                   "https://h.example/a/b/c.html?p=1"]


def chunk(spark, text, **kw):
    df = spark.createDataFrame([("d", text)], "document_id string, text string")
    return sorted(sim.chunks(df, **kw).collect(), key=lambda r: r.ordinal)


def test_chunks(spark):
    assert [c.text for c in chunk(spark, "Hello world.")] == ["Hello world."]
    assert [c.text for c in chunk(spark, "Para one.\n\nPara two.\n\nPara three.")] == ["Para one.", "Para two.", "Para three."]
    assert chunk(spark, "") == [] and chunk(spark, " \n\n ") == []
    long = " ".join(f"Sentence number {i} has a few plain words." for i in range(40))
    got = chunk(spark, long, target=400)
    assert len(got) > 1 and all(c.char_length <= 600 for c in got) and [c.ordinal for c in got] == list(range(len(got)))
    assert " ".join(c.text for c in got) == long and all(long[c.char_offset :].startswith(c.text[:40]) for c in got)
    assert [len(c.text) for c in chunk(spark, "x" * 1000, target=400)] == [400, 400, 200]
    assert [c.text for c in chunk(spark, "A long enough one.\n\nTiny.", least=10)] == ["A long enough one. Tiny."]


def test_hash_embedding_and_index(spark):
    texts = [(1, "repaint the old lighthouse tower white"), (2, "lighthouse tower repaint white"), (3, "school lunch delivery by bicycle"), (4, "")]
    df = spark.createDataFrame(texts, "chunk_id int, text string")
    emb = {r.chunk_id: r.e for r in df.select("chunk_id", vec.hash_embed("text", 128).alias("e")).collect()}
    assert len(emb[1]) == 128 and abs(sum(x * x for x in emb[1]) - 1) < 1e-5 and sum(emb[4]) == 0
    dot = lambda a, b: sum(x * y for x, y in zip(emb[a], emb[b]))
    assert dot(1, 2) > dot(1, 3)
    idx = df.where("chunk_id < 4").select("chunk_id", (F.col("chunk_id") % 2).alias("tender_id"), F.lit("s").alias("source_id"), vec.hash_embed("text").alias("embedding"))
    assert sim.top_k(idx, emb[2], 1).first().chunk_id == 2
    assert sim.top_k(idx, emb[2], 5, filters={"tender_id": 1}).first().chunk_id == 1
    assert [r.tender_id for r in sim.group_match(idx, 1).collect()] == [0]
    assert snk.upsert(idx, idx, ["chunk_id"], ["source_id"]).count() == 3
    every = {(r.query_group, r.tender_id) for r in sim.group_match_all(idx, idx, limit=1).collect()}
    assert every == {(0, 1), (1, 0)}


def test_group_match_sends_few_rows(spark):
    """A hot group, batches cut inside groups: the best rows per (query, group) leave a task, whatever the chunks."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(5)
    group = np.sort(np.r_[np.zeros(900, int), rng.integers(1, 12, 600)])
    pdf = pd.DataFrame({"g": group, "c": np.arange(1500), "v": list(rng.standard_normal((1500, 8)))})
    names = np.array([0, 3, 7])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    matrix = unit(rng.standard_normal((3, 8))).T
    run = sim._best_of_groups(names, matrix, "g", "c", "v", 3, 100)
    out = pd.concat(run(iter([pdf[:333], pdf[333:1000], pdf[1000:]])))
    assert len(out) == 3 * (3 * 12) - 9
    scores = unit(np.stack(pdf.v)) @ matrix
    for q, name in enumerate(names):
        for g in range(12):
            if g != name:
                want = set(pdf.c[group == g].iloc[np.argsort(-scores[group == g, q])[:3]])
                assert set(out.c[(out.query_group == name) & (out.g == g)]) == want
    df = spark.createDataFrame([(int(a), int(b), [float(x) for x in v]) for a, b, v in zip(pdf.g, pdf.c, pdf.v)], "tender_id int, chunk_id int, embedding array<double>")
    one = sim.group_match_all(df, df.where("tender_id = 3")).collect()
    assert [(r.tender_id, round(r.score, 9)) for r in sorted(one, key=lambda r: r.rank)] == [(r.tender_id, round(r.score, 9)) for r in sim.group_match(df, 3).collect()]


def test_readers(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.txt").write_text("first\nsecond")
    m = spark.createDataFrame([("a", "x/a.txt"), ("b", "x/b.txt")], "document_id string, extracted_text_path string")
    got = readers.attach_texts(spark, m, str(tmp_path / "texts")).collect()
    assert [(r.document_id, r.text) for r in got] == [("a", "first\nsecond")]
    geo = tmp_path / "l.json"
    geo.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"NEW_DISTRI":"ALLURI RAJU"},"geometry":{"type":"Polygon",'
                   '"coordinates":[[[0,0,5],[1,0,5],[1,1,5],[0,0,5]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}]}')  # fmt: skip
    r = readers.read_geojson(spark, str(geo), {"district": "district"}, {"district": "NEW_DISTRI"}).collect()
    assert len(r) == 1 and r[0].district == "Alluri Raju" and r[0].polygons[0][0][1].x == 1.0
    assert "document_type" in schemas.TRAINING_MANIFEST


def test_a_run_is_exported_whole_or_not_at_all(spark, tmp_path):
    from pyspark.sql import functions as F

    from tallyworks.sinks import tables as snk

    good = spark.createDataFrame([(1, "a,\"b\"\nc", None), (2, None, 2.5)], "id int, note string, x double")
    fail = F.udf(lambda x: 1 // 0, "int")
    root = str(tmp_path)
    with pytest.raises(Exception):
        snk.export_run({"a": good, "b": good.select(fail("id").alias("id"))}, root, "R-9", {"a": ["id", "note", "gone"]})
    assert list(tmp_path.iterdir()) == []
    for _ in range(2):  # a later export of the same run replaces it
        folder = snk.export_run({"a": good, "b": good}, root, "R-9", {"a": ["id", "note", "gone"]})
    assert [p.name for p in tmp_path.iterdir()] == ["R-9"]
    assert sorted(p.name for p in (tmp_path / "R-9").iterdir()) == ["a", "b"]
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/a").collect()
    assert sorted((r.id, r.gone) for r in back) == [("1", None), ("2", None)]


def test_chunks_leave_before_a_batch_of_long_texts_ends(spark, monkeypatch):
    """Texts are not made one frame of Python strings; what leaves early is the same."""
    texts = [(i, f"Part {i}. " + " ".join(f"Sentence {j} of text {i} is plain." for j in range(i % 50))) for i in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(texts, "document_id long, text string").coalesce(1)
    read = lambda: sorted(tuple(r) for r in sim.chunks(df, target=200).collect())
    want = read()
    monkeypatch.setattr(sim, "OUT_CHARS", 500)
    assert read() == want and {r[0] for r in want} == set(range(300))
    assert "MapInArrow" in sim.chunks(df)._jdf.queryExecution().executedPlan().toString()


def test_a_larger_table_is_dealt_over_more_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(views, "TASK_ROWS", 90)
    v = views.Views(spark, str(tmp_path)).spread("documents")
    assert v.documents.rdd.getNumPartitions() == 12 and v.documents.count() == 1000

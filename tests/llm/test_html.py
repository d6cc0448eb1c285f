from tallyworks.llm import html_tree as H
from tallyworks.llm import html_wrappers as W


def text(page):
    nodes, marked, _ = W._tree(page)
    return H.blocks(nodes, marked)


def test_blocks():
    assert text("<p>a &amp; b&nbsp;c<br>d<p>e &lt;x&gt; &#233;&#x20ac;") == ["a & b c d", "e <x> é€"]
    assert text('<article><h1>T</h1><p><b>one<br><p>two</p><ul><li>x<li>y</ul><table><tr><td>1<td>2<tr><td>3</table></article>') == ["T", "one", "two", "x", "y", "1", "2", "3"]
    assert text('<script>var a="<p>no</p>";</script><style>p{}</style><!-- <p>no</p> --><p title="a>b">yes</p><textarea>no') == ["yes"]
    assert text("") == text(None) == text("<p></p><div> \n</div>") == []
    assert text("a < b and <1 but <em>c</em>d") == ["a < b and <1 but cd"]
    assert text("<div>" * 3000 + "deep<p>er") == ["deep", "er"]
    assert text("<p>cut <a href='x") == ["cut"]
    assert len(text("<p>" + "long word " * 50_000)[0]) == 499_999


def test_only_the_article_stays():
    page = """<html><head><title>no</title></head><body class="has-sidebar"><header><h1>Site</h1><nav>menu</nav></header>
    <div id="cookie-notice">cookies</div><main><article><header><h1>Title</h1><p>by</p></header><p>First.</p>
    <form>mail <input></form><div class="ad-box">buy</div><div role="alert">note</div><p hidden>h</p><p>Last.</p><section class="comments"><p>c</p></section></article>
    <section id="related"><article>other</article></section></main><aside>side</aside><div class="sidebar-left">s</div><footer>f</footer></body></html>"""
    assert text(page) == ["Title", "First.", "Last."]
    assert text('<body><div class="content"><p>Body text</p></div><ul class="x"><li><a href=1>Home</a></li></ul></body>') == ["Body text"]


def test_nothing_else_is_dropped():
    long, short = "long " * 60, "short one"
    assert text(f"<article><p>{long}</p></article><article><p>{short}</p></article>") == [long.strip(), short]  # unequal marked parts
    assert text("<body><p>Main <a href=x>link text</a> end</p><p>more</p></body>") == ["Main link text end", "more"]
    assert text("<body><h2><a href=x>Title</a></h2><p><a href=y>See the report</a></p><p><a href=1>One</a> | <a href=2>Two</a></p><p>own</p></body>") == [
        "Title", "See the report", "own"]
    assert text(f"<body><article>teaser</article><div><p>{long}</p></div></body>") == ["teaser", long.strip()]  # a small marked part
    assert text(f"<body><article>the article of some length</article><div>{short}</div></body>") == ["the article of some length"]


def test_matching_is_largest():
    """Score of the alignment against all ways to match trees top down in order."""
    import itertools
    import random
    from functools import cache

    def tree(rng, depth):
        return (rng.choice("ab"), rng.choice((1, 2)), tuple(tree(rng, depth - 1) for _ in range(rng.randrange(4))) if depth else ())

    def best(a, b):  # all order-preserving pairings of the children
        base = 1.5 if a[1] == b[1] else 1.0
        return base + brute(a[2], b[2])

    @cache
    def brute(xs, ys):
        top = 0.0
        for k in range(1, min(len(xs), len(ys)) + 1):
            for i in itertools.combinations(range(len(xs)), k):
                for j in itertools.combinations(range(len(ys)), k):
                    if all(xs[p][0] == ys[q][0] for p, q in zip(i, j)):
                        top = max(top, sum(best(xs[p], ys[q]) for p, q in zip(i, j)))
        return top

    def numbered(t, at, labels, parents, parent=None):
        n = next(at)
        labels[n], parents[n] = t, parent
        return [t[0], t[1], n, [numbered(k, at, labels, parents, n) for k in t[2]]]

    for seed in range(60):
        rng = random.Random(seed)
        xs, ys = (tuple(tree(rng, 2) for _ in range(rng.randrange(1, 4))) for _ in range(2))
        la, pa, lb, pb = {}, {}, {}, {}
        at, bt = itertools.count(), itertools.count()
        pairs = H.matched([numbered(t, at, la, pa) for t in xs], [numbered(t, bt, lb, pb) for t in ys])
        met = dict(pairs)
        assert len(met) == len(pairs) == len(set(met.values()))
        assert all(la[a][0] == lb[b][0] and (pa[a] is None) == (pb[b] is None) and (pa[a] is None or met[pa[a]] == pb[b]) for a, b in pairs)
        assert sum(1.5 if la[a][1] == lb[b][1] else 1.0 for a, b in pairs) == brute(xs, ys)


def test_matching_prefers_constant_nodes():
    left, right = (H.skeleton(*[W._tree(f"<article><p>{a}</p><p>same</p></article>")[0]], W._hash) for a in ("x", "y</p><p>z"))
    pairs = dict(H.matched(left, right))
    assert pairs[0] == 0 and pairs[2] == 3


def site(i, body, extra="Follow us for more"):
    return f"<body><div class=x><p>Daily paper</p></div><article><h1>Title {i}</h1>{body}<p>{extra}</p></article></body>"


def test_templates_of_a_host(spark):
    def story(i, n=3):
        return "".join(f"<p>{' '.join(f'w{i}x{j}y{k}' for k in range(15))}</p>" for j in range(n))

    rows = [(i, f"https://a.com/{i}", site(i, story(i))) for i in range(12)]
    # A host of exact and near copies of one article: its paragraphs are no template.
    base = "".join(f"<p>{' '.join(f'c{j}y{k}' for k in range(40))}</p>" for j in range(6))
    rows += [(100 + i, f"http://copies.com:80/{i}", f"<article><h1>T</h1>{base}<p>edit {'x' * (i % 3)}</p></article>") for i in range(20)]
    rows += [(200, "https://lone.com/", site(1, story(50))), (201, None, site(2, story(51))), (202, "not a url", None), (203, "https://a.com/n", None), (203, "https://a.com/n", None)]
    pages = spark.createDataFrame([(*r, "t", 5, 6) for r in rows], "page_id long, url string, html string, text string, host int, th int")
    out = W.main_text(pages).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text.split("\n") for r in out}
    for i in range(12):
        assert got[i][0] == f"Title {i}" and got[i][-1].startswith(f"w{i}x2") and len(got[i]) == 4
    assert all(len(got[100 + i]) == 8 for i in range(20))
    assert got[200][-1] == got[201][-1] == "Follow us for more"
    assert got[202] == got[203] == [""]


def test_host_names(spark):
    urls = ["https://User:p@Www.X.com:8080/a?b", "http://x.com", "ftp://y/z", "x.com/a", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(W.host(df.url)).collect()] == ["www.x.com", "x.com", "y", "", "", ""]


def test_empty_table(spark):
    assert W.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

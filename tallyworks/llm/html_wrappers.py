"""HTML extraction by wrapper induction over the pages of one host.

One page of each host is its pattern.  Every page's tree is aligned with the
pattern's by simple tree matching, in the task that has the page; a node of the
pattern that keeps its text on most of the host's unlike pages is template, all
other slots are content.  Elements that say what they are (menus, forms,
comments and the like) never reach the alignment, so pages alone on their host
lose them too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions.skew import small
from tallyworks.llm import html_tree
from tallyworks.llm.common import pieces, spread, table, written
from tallyworks.llm.registry import query

# Pages of a host before it has a template, and the share of them that a template node is on.
LEAST_PAGES, SHARE = 3, 0.5
# So large a share of the pages with a node must differ in content, or they are copies of one article.
UNLIKE = 0.5
# A pattern has the most tags up to this; aligning costs tags of the pattern times tags of the page.
PATTERN_TAGS = 256
# Blocks of so few words don't tell articles apart.
SHORT = 12


def host(url: Column) -> Column:
    """Host of a URL in lower case without port; empty if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    k = xxh64_intdigest(text.encode("utf-8", "replace"))
    return k - ((k >> 63) << 64)


def _tree(page: str | None):
    nodes, marked = html_tree.article(html_tree.parse(page or ""))
    return nodes, marked, html_tree.numbered(nodes)


def _pattern(page: str | None) -> str:
    nodes, _, all_ = _tree(page)
    text = {n.number: html_tree.own_text(n) for n in all_}
    return json.dumps([html_tree.skeleton(nodes, _hash), {n: _hash(t) for n, t in text.items() if t}])


def _article_key(texts: list[str]) -> int:
    """Least hash of the five-word runs of long blocks; near copies of an article mostly share it."""
    best = None
    for t in texts:
        w = t.split()
        if len(w) < SHORT and len(texts) > 1:
            continue
        for i in range(max(1, len(w) - 4)):
            k = hash_words(w[i : i + 5])
            best = k if best is None or k < best else best
    return best if best is not None else _hash("\n".join(texts))


def hash_words(w: list[str]) -> int:
    return _hash(" ".join(w))


def patterns(pages: DataFrame) -> DataFrame:
    """Rows (host, pages, pattern) of hosts with LEAST_PAGES pages or more, from rows (id, th, host, html).

    The pattern is the page with the most tags up to PATTERN_TAGS, or else the one with the fewest.
    """
    tags = F.length("html") - F.length(F.replace("html", F.lit("<"), F.lit("")))
    rank = F.when(tags <= PATTERN_TAGS, PATTERN_TAGS - tags).otherwise(tags)
    chosen = (
        pages.where("host <> '' AND html IS NOT NULL").groupBy("host")
        .agg(F.count(F.lit(1)).alias("pages"), F.min(F.struct(rank.alias("rank"), "id", "th")).alias("p"))
        .where(F.col("pages") >= LEAST_PAGES).select(F.col("host").alias("of"), "pages", F.col("p.id").alias("pid"), F.col("p.th").alias("pth"))
    )
    chosen = small(written(chosen, "hosts"))
    texts = pages.join(chosen, (F.col("host") == F.col("of")) & F.col("id").eqNullSafe(F.col("pid")) & (F.col("th") == F.col("pth")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            made = [_pattern(h) for h in piece.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*piece.columns[:2], pa.array(made, pa.string())], ["host", "pages", "pattern"])

    made = texts.select("host", "pages", "html").mapInArrow(run, "host string, pages long, pattern string")
    return made.dropDuplicates(["host"])  # repeated rows


def templates(pages: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (host, pattern, template): the numbers of the pattern's constant nodes, of hosts that have any."""
    met = pages.where("html IS NOT NULL").join(found.select("host", "pattern"), "host").select("host", "html", "pattern")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            out: tuple[list, list, list] = [], [], []
            known: dict[str, list] = {}
            for name, page, pattern in zip(*(c.to_pylist() for c in piece.columns)):
                if pattern not in known:
                    if len(known) > 64:
                        known.clear()
                    known[pattern] = json.loads(pattern)
                skeleton, texts = known[pattern]
                nodes, marked, all_ = _tree(page)
                own = {n.number: _hash(t) for n in all_ if (t := html_tree.own_text(n))}
                pairs = html_tree.matched(skeleton, html_tree.skeleton(nodes, _hash))
                same = [a for a, b in pairs if b in own and texts.get(str(a)) == own[b]]
                if same:
                    key = _article_key(html_tree.blocks(nodes, marked))
                    for a in same:
                        out[0].append(name), out[1].append(a), out[2].append(key)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["host", "node", "article"])

    same = met.mapInArrow(run, "host string, node long, article long")
    # Copies of an article are added up first, so that many of them are one row.
    each = same.groupBy("host", "node", "article").agg(F.count(F.lit(1)).alias("n"))
    each = each.groupBy("host", "node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("unlike"))
    each = each.where(F.col("unlike") >= F.greatest(F.lit(2.0), F.col("n") * UNLIKE)).join(found, "host")
    each = each.where(F.col("n") >= F.greatest(F.lit(float(LEAST_PAGES)), F.col("pages") * SHARE))
    # Nodes of one pattern: a few hundred at most.
    return each.groupBy("host").agg(F.first("pattern").alias("pattern"), F.sort_array(F.collect_list("node")).alias("template"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by a newline, empty if none), template_nodes (left out).

    A null page is empty; a null URL has no host and so no template.  Repeated rows come out alike.
    """
    rows = pages.select(
        F.col(page_id).alias("id"), F.xxhash64(html).alias("th"), host(F.col(url)).alias("host"), F.col(url).alias("url"), F.col(html).alias("html")
    )
    found = small(written(patterns(rows), "patterns"))
    known = small(written(templates(rows, found), "templates"))
    met = rows.join(known, "host", "left").select("id", "url", F.coalesce("html", F.lit("")).alias("html"), "pattern", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "html"):
            texts, gone = [], []
            for page, pattern, template in zip(*(c.to_pylist() for c in piece.columns[2:])):
                nodes, marked, all_ = _tree(page)
                drop: set[int] = set()
                if template:
                    skeleton, own = json.loads(pattern)
                    constant = set(template)
                    by = {n.number: n for n in all_}
                    for a, b in html_tree.matched(skeleton, html_tree.skeleton(nodes, _hash)):
                        if a in constant and own.get(str(a)) == _hash(html_tree.own_text(by[b])):
                            drop.add(b)
                texts.append("\n".join(html_tree.blocks(nodes, marked, drop)))
                gone.append(len(drop))
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:2], pa.array(texts, pa.string()), pa.array(gone, pa.int64())], ["page_id", "url", "text", "template_nodes"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    return met.mapInArrow(run, f"page_id {kind}, url string, text string, template_nodes long")


@query("op1_html_wrappers")
def op1_html_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    out = main_text(spread(table(spark, folder, "pages")))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

"""Stored HTML pages to records and links, with JVM regular expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions import ids
from tallyworks.functions.dates import PAGE_FORMATS, parse_date
from tallyworks.functions.numbers import col, computed_once
from tallyworks.functions.text import clean_name, contains_any, label_key, money

# Label spellings and the record field of each.
LABELS: Mapping[str, str] = {
    "tender reference no": "reference_number",
    "tender id": "reference_number",
    "title": "title",
    "title of work": "title",
    "name of work": "title",
    "organisation chain": "organisation",
    "organisation name": "organisation",
    "department": "department",
    "state name": "state",
    "location": "location",
    "tender category": "tender_category",
    "product category": "product_category",
    "form of contract": "form_of_contract",
    "tender type": "tender_type",
    "tender value in rs": "tender_value_inr",
    "tender value": "tender_value_inr",
    "emd amount in rs": "emd_inr",
    "emd amount": "emd_inr",
    "published date": "published_date",
    "bid submission closing date": "closing_date",
    "bid opening date": "bid_opening_date",
}
TEXT_FIELDS = (
    "reference_number", "title", "organisation", "department", "state", "location", "tender_category",
    "product_category", "form_of_contract", "tender_type",
)
MONEY_FIELDS = ("tender_value_inr", "emd_inr")
DATE_FIELDS = ("published_date", "closing_date", "bid_opening_date")
# Substrings that make a link a document link, or rule it out.
INCLUDE = (
    "tender document", "nit", "rfp", "bid document", "corrigendum", "boq", "technical specification", "scope of work",
    "gcc", "scc", "contract form", "award of contract", "aoc", "instructions to tenderers", "itt", "tender data sheet",
    "tds", "evaluation", "qualification",
)
EXCLUDE = (
    "login", "register", "submit", "pay", "dashboard", "my-bids", "digital signature", "dsc", "encrypted",
)
# Link type by the first matching group of substrings.
ANCHOR_TYPES: tuple[tuple[tuple[str, ...], str], ...] = (
    (("corrigendum",), "Corrigendum"),
    (("award of contract", "aoc"), "Award_of_Contract"),
    (("boq",), "BOQ"),
    (("tender document", "rfp", "bid document"), "Tender_Document"),
    (("scope of work",), "Scope_of_Work"),
    (("technical specification",), "Technical_Specifications"),
    (("gcc",), "GCC"),
    (("scc",), "SCC"),
    (("instructions to tenderers", "itt"), "ITT"),
    (("tender data sheet", "tds"), "TDS"),
    (("evaluation", "qualification"), "Evaluation_Qualification_Criteria"),
    (("nit",), "NIT"),
)
# Texts of record links and of the next-page link.
RECORD_LINKS = ("view tender", "tender details", "tender reference")
CATALOGUE_LINKS = ("tender", "package")
NEXT_LINKS = ("next", "next page", ">>", "›")
REFERENCE = r"(?i)(?:tender|reference|nit|notice)\s*(?:no\.?|number)\s*[:\-]?\s*([A-Z0-9/_\-]+)"


def anchor_type(text: str | Column) -> Column:
    """Type of a document link from its text (RUL-04)."""
    t = F.lower(col(text))
    out = None
    for needles, label in ANCHOR_TYPES:
        hit = contains_any(t, needles)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("Unknown")


def visible(html: str | Column) -> Column:
    """Page source without comments, scripts and styles."""
    return F.regexp_replace(col(html), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")


def plain(fragment: str | Column) -> Column:
    """Text of an HTML fragment: tags become blanks, entities are decoded."""
    return clean_name(F.regexp_replace(col(fragment), r"(?s)<[^>]*>", " "))


def _with_pairs(pages: DataFrame, html: str, *kept: str) -> DataFrame:
    """``kept`` and ``_pairs``: (position, field, value) of a page's label/value rows, an array in page order.

    A row ends at the next row or table tag and a cell at the next cell, row or
    table tag, so end tags may be missing.  Cells 1 and 2, 3 and 4, ... of a row are
    pairs.  Each step is computed once for the steps that read it.
    """
    rows = computed_once(pages.select(*kept, F.split(visible(html), r"(?i)<tr\b[^>]*>", -1).alias("_rows")))
    inside = lambda row: F.regexp_extract(row, r"(?is)^(.*?)(?:</?table\b|</tr\b|\z)", 1)
    cells = F.transform(F.slice("_rows", F.lit(2), F.greatest(F.size("_rows") - 1, F.lit(0))), lambda r: F.split(inside(r), r"(?i)<t[dh]\b[^>]*>", -1))
    cells = computed_once(rows.select(*kept, cells.alias("_cells")))

    def pairs(c: Column, r: Column) -> Column:
        # The first piece stands before the first cell.
        starts = F.sequence(F.lit(1), F.greatest(F.size(c) - 2, F.lit(1)), F.lit(2))
        return F.transform(starts, lambda i: F.struct(r.alias("_r"), i.alias("_i"), F.get(c, i).alias("label"), F.get(c, i + 1).alias("value")))

    raw = F.filter(F.flatten(F.transform("_cells", pairs)), lambda p: p["value"].isNotNull())
    raw = computed_once(cells.select(*kept, raw.alias("_raw")))
    field = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    cell = lambda c: plain(F.regexp_replace(c, r"(?is)</t[dh]\b.*\z", ""))
    named = F.transform("_raw", lambda p: F.struct(
        F.struct(p["_r"], p["_i"]).alias("position"), F.try_element_at(field, label_key(cell(p["label"]))).alias("field"), cell(p["value"]).alias("value")))
    named = F.filter(F.coalesce(named, F.array()), lambda p: p["field"].isNotNull() & (p["value"] != ""))
    return computed_once(raw.select(*kept, named.alias("_pairs")))


def label_values(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(page, position, field, value) of label/value table rows (TXT-07)."""
    return _with_pairs(pages, html, key).select(key, F.inline("_pairs"))


def records(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page with typed record fields; the last value of a field wins (TXT-08, DAT-01, STR-07).

    All fields come from the page's own row: nothing is joined or shuffled.

    ``parser_name`` 'epublish_parser' reads the title tag and a reference number
    in the running text; all other parsers read label/value tables.
    ``source_id`` and ``url`` give the record id.
    """
    fields = (*TEXT_FIELDS, *MONEY_FIELDS, *DATE_FIELDS)
    base = _with_pairs(pages, html, key, "source_id", "url", "parser_name", html)
    base = base.withColumn("_pairs", F.when(F.col("parser_name") != "epublish_parser", F.col("_pairs")))

    def last(f: str) -> Column:
        return F.try_element_at(F.filter("_pairs", lambda p: p["field"] == f), F.lit(-1))["value"]

    j = base.withColumns({f: last(f) for f in fields})
    running = plain(visible(html))
    listed = F.col("parser_name") == "epublish_parser"
    title = F.nullif(plain(F.regexp_extract(F.col(html), r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit(""))
    ref = F.nullif(F.regexp_extract(running, REFERENCE, 1), F.lit(""))
    out = j.withColumns(
        {
            "title": F.when(listed, title).otherwise(F.col("title")),
            "reference_number": F.when(listed, ref).otherwise(F.col("reference_number")),
            **{f: money(f) for f in MONEY_FIELDS},
            **{f: parse_date(f, PAGE_FORMATS) for f in DATE_FIELDS},
        }
    )
    return out.withColumn("tender_id", ids.record_key("source_id", "reference_number", "url")).select(
        key, "tender_id", "source_id", "url", *fields
    )


def anchors(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, url, position, href, text) of all anchors with a link."""
    found = F.regexp_extract_all(visible(html), F.lit(r"(?is)(<a\b[^>]*>.*?)</a>"), 1)
    a = pages.select(key, url, F.posexplode(found).alias("position", "_a"))
    quoted = F.regexp_extract("_a", r"""(?is)^<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""", 1)
    bare = F.regexp_extract("_a", r"""(?is)^<a\b[^>]*?\bhref\s*=\s*([^\s"'>]+)""", 1)
    href = F.trim(F.when(quoted != "", quoted).otherwise(bare))
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    out = computed_once(a.select(key, url, "position", href.alias("href"), plain("_a").alias("text")))
    return out.where(F.col("href") != "")


def distinct_links(links: DataFrame, key: str, link: str, *rest: str) -> DataFrame:
    """First occurrence of each link on a page, in page order (SET-04)."""
    first = F.min_by(F.struct("position", *rest), F.col("position")).alias("_f")
    return links.groupBy(key, link).agg(first).select(key, link, *[F.col(f"_f.{c}").alias(c) for c in ("position", *rest)])


def document_links(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", include: Sequence[str] = INCLUDE,
    exclude: Sequence[str] = EXCLUDE, dotted: bool = False,
) -> DataFrame:
    """Document links of each page with their type (TXT-09, STR-14, RUL-04)."""
    a = anchors(pages, key, url, html)
    a = computed_once(a.withColumn("_both", F.lower(F.concat("text", F.lit(" "), "href"))))
    both = F.col("_both")
    a = a.where(~contains_any(both, exclude) & contains_any(both, include))
    a = a.withColumns(
        {
            "link": ids.absolute_url(url, "href", dotted),
            "suggested_type": anchor_type(F.when(F.col("text") != "", F.col("text")).otherwise(F.col("href"))),
        }
    )
    return distinct_links(a, key, "link", "text", "suggested_type")


def page_flags(links: DataFrame, key: str = "page_id") -> DataFrame:
    """Corrigendum and award flags of a page from its links (TXT-08)."""
    return links.groupBy(key).agg(
        F.bool_or(F.col("suggested_type") == "Corrigendum").alias("has_corrigendum"),
        F.bool_or(F.col("suggested_type") == "Award_of_Contract").alias("has_award"),
    )


def record_links(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", catalogue: bool = False) -> DataFrame:
    """Record links of listing pages (TXT-10)."""
    a = anchors(pages, key, url, html)
    t = F.lower("text")
    hit = contains_any(t, CATALOGUE_LINKS) | t.endswith(".html") | t.endswith(".htm") if catalogue else contains_any(t, RECORD_LINKS)
    a = a.where(hit).withColumn("link", ids.absolute_url(url, "href"))
    return distinct_links(a, key, "link")


def next_page(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Next-page link of each listing page, the first one found (TXT-10)."""
    a = anchors(pages, key, url, html).where(F.lower("text").isin(*NEXT_LINKS))
    return a.groupBy(key).agg(F.min_by(ids.absolute_url(url, "href"), "position").alias("next_page_url"))

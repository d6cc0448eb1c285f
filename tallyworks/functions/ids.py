"""Deterministic ids, canonical URLs, file extensions."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyworks.functions.numbers import col

_URL = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(c: str | Column, part: str) -> Column:
    """scheme, authority, path or query of a URL; '' where absent."""
    group = {"scheme": 1, "authority": 2, "path": 3, "query": 4}[part]
    return F.regexp_extract(F.trim(col(c)), _URL, group)


def url_host(c: str | Column) -> Column:
    auth = F.regexp_replace(url_part(c, "authority"), "^.*@", "")
    return F.lower(F.regexp_replace(auth, r":\d*$", ""))


def canonical_url(c: str | Column) -> Column:
    """Lower scheme and host, no default port, sorted query, no fragment (STR-10)."""
    scheme = F.lower(url_part(c, "scheme"))
    port = F.regexp_extract(url_part(c, "authority"), r":(\d+)$", 1)
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    netloc = F.when((port == "") | default, url_host(c)).otherwise(F.concat(url_host(c), F.lit(":"), port))
    path = url_part(c, "path")
    path = F.when(path == "", "/").otherwise(path)

    def decoded(pair: Column) -> Column:
        at = F.instr(pair, "=")
        key = F.when(at > 0, F.substring(pair, F.lit(1), at - 1)).otherwise(pair)
        val = F.when(at > 0, F.substring(pair, at + 1, F.length(pair))).otherwise(F.lit(""))
        return F.struct(
            F.coalesce(F.try_url_decode(key), key).alias("k"), F.coalesce(F.try_url_decode(val), val).alias("v")
        )

    def encoded(x: Column) -> Column:
        return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    pairs = F.filter(F.split(url_part(c, "query"), "&"), lambda p: p != "")
    query = F.array_join(
        F.transform(
            F.array_sort(F.transform(pairs, decoded)),
            lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"])),
        ),
        "&",
    )
    base = F.concat(scheme, F.lit("://"), netloc, path)
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def hash16(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts joined by '|' (STR-11)."""
    return F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 16)


def page_key(source: str | Column, url: str | Column) -> Column:
    return hash16(col(source), canonical_url(url))


def record_key(source: str | Column, reference: str | Column, url: str | Column) -> Column:
    """Reference number when there is one, else the canonical URL."""
    ref = F.nullif(col(reference), F.lit(""))
    return hash16(col(source), F.coalesce(F.trim(ref), canonical_url(url)))


def content_key(content: str | Column) -> Column:
    """Id of a document: first 16 hex digits of its content hash (PRJ-09)."""
    return F.substring(F.sha2(col(content).cast("binary"), 256), 1, 16)


def run_key(started: str | Column, suffix: str | Column) -> Column:
    """Run id: UTC time stamp and six hex digits."""
    return F.concat(F.date_format(col(started), "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(col(suffix), 1, 6))


def extension(url: str | Column) -> Column:
    """Lower-case extension of the last path segment, else null (STR-12)."""
    return F.nullif(F.lower(F.regexp_extract(url_part(url, "path"), r"\.([^./]*)$", 1)), F.lit(""))


def looks_like_file(url: str | Column) -> Column:
    e = extension(url)
    return e.isNotNull() & (F.length(e) <= 5)


@F.pandas_udf(T.StringType())
def _urljoin(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b, h) if b and h else None for b, h in zip(bases, hrefs)])


def absolute_url(base: str | Column, href: str | Column, dotted: bool = False) -> Column:
    """Resolve a link against its page (STR-14).

    Absolute, scheme-relative, root-relative and plain relative links stay on
    the JVM; ``dotted`` sends links with '../' through an Arrow batch function.
    """
    b, h = col(base), F.trim(col(href))
    origin = F.concat(url_part(b, "scheme"), F.lit("://"), url_part(b, "authority"))
    folder = F.regexp_replace(url_part(b, "path"), "[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    out = (
        F.when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(url_part(b, "scheme"), F.lit(":"), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("#"), F.concat(F.regexp_replace(b, "#.*$", ""), h))
        .when(h.startswith("?"), F.concat(origin, url_part(b, "path"), h))
        .otherwise(F.concat(origin, folder, h))
    )
    return F.when(F.contains(h, F.lit("./")), _urljoin(b, h)).otherwise(out) if dotted else out

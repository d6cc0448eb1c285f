"""Text clean-up and small text scans."""

from __future__ import annotations

import html.entities
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyworks.functions.numbers import col

# Phrases that mark a blocked page.
TRIPWIRES = (
    "captcha",
    "access denied",
    "unauthorized",
    "forbidden",
    "login required",
    "session expired",
    "too many requests",
    "payment required",
    "please verify you are human",
    "cloudflare ray id",
)

_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?"
_COMMON = (("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))
# Characters by entity name, and by number where a page means one of the Windows set.
_NAMED = json.dumps(html.entities.html5)
_WINDOWS = {n: bytes([n]).decode("cp1252", "ignore") for n in range(0x80, 0xA0)}


def unescape(c: str | Column) -> Column:
    """Decode named, decimal and hexadecimal HTML entities; unknown names stay.

    The text is cut at its entities, each is decoded, and the pieces are joined.
    A name without a semicolon counts where HTML allows that.
    """
    v = col(c)
    named = F.from_json(F.lit(_NAMED), "map<string,string>")
    windows = F.from_json(F.lit(json.dumps({str(n): ch for n, ch in _WINDOWS.items() if ch})), "map<string,string>")

    def decoded(e: Column) -> Column:
        body = F.regexp_replace(e, "^&#?[xX]?|;$", "")
        number = F.when(F.rlike(e, F.lit("^&#[xX]")), F.conv(body, 16, 10)).otherwise(body).try_cast("long")
        odd = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        char = F.coalesce(F.try_element_at(windows, number.cast("string")), F.when(odd, "\ufffd").otherwise(char))
        name = F.substring_index(e, "&", -1)
        out = F.when(F.startswith(e, F.lit("&#")), char).otherwise(F.coalesce(F.try_element_at(named, name), e))
        for entity, ch in _COMMON:  # looked up without a search
            out = F.when(e == entity, ch).otherwise(out)
        return out

    parts = F.split(v, _ENTITY, -1)
    found = F.transform(F.regexp_extract_all(v, F.lit(f"({_ENTITY})"), 1), decoded)
    joined = F.array_join(F.zip_with(parts, F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return F.when(F.contains(v, F.lit("&")), joined).otherwise(v)


def clean_name(c: str | Column) -> Column:
    """Unescape HTML, squeeze white space, trim; null becomes '' (STR-01)."""
    v = unescape(F.coalesce(col(c).cast("string"), F.lit("")))
    v = F.replace(v, F.lit("&amp;"), F.lit("&"))
    return F.trim(F.regexp_replace(v, r"(?U)\s+", " "))


def leading_code(c: str | Column) -> Column:
    """Leading number of 5 to 8 digits, else null (STR-02)."""
    return F.nullif(F.regexp_extract(col(c), r"^\s*(\d{5,8})\b", 1), F.lit(""))


def depot_code(c: str | Column) -> Column:
    """Leading 2 to 4 digits, padded to three; four digits stay (STR-03)."""
    d = F.nullif(F.regexp_extract(col(c), r"^\s*(\d{2,4})\b", 1), F.lit(""))
    return F.when(F.length(d) < 3, F.lpad(d, 3, "0")).otherwise(d)


def strip_depot(c: str | Column) -> Column:
    """Depot name without its code prefix, cleaned (STR-04)."""
    return clean_name(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\s*\d{2,4}-\s*", ""))


def first_int(c: str | Column, leading: bool = False) -> Column:
    """First run of digits as a number; ``leading`` accepts only a leading one (STR-05)."""
    pat = r"^\s*([+-]?\d+)" if leading else r"(\d+)"
    return F.regexp_extract(col(c).cast("string"), pat, 1).try_cast("long")


def money(c: str | Column, drop_point: bool = False) -> Column:
    """Money text to decimal(20,2) (STR-07).

    ``drop_point`` keeps the source system's habit of deleting the decimal
    point along with the currency marks, so that 12.50 becomes 1250.
    """
    if drop_point:
        v = F.translate(F.trim(col(c)), ",₹ rs.()", "")
    else:
        v = F.regexp_replace(F.trim(col(c)), r"(?i)(₹|\brs\.?|[,()\s])", "")
    return F.nullif(v, F.lit("")).try_cast("decimal(20,2)")


def label_key(c: str | Column) -> Column:
    """Label without trailing colon or period, one space between words, lower (STR-08)."""
    v = F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))
    return F.lower(F.regexp_replace(v, r"[:. ]+$", ""))


def title_case(c: str | Column, split_marks: bool = False) -> Column:
    """Each word with a capital; '_' and '-' become spaces on request (STR-09)."""
    v = F.regexp_replace(col(c), "[_-]", " ") if split_marks else col(c)
    return F.trim(F.initcap(F.lower(v)))


def squeeze_blanks(c: str | Column) -> Column:
    """Runs of blanks and tabs become one blank; ends trimmed (STR-16)."""
    return F.trim(F.regexp_replace(col(c), r"[ \t]+", " "))


def safe_file_name(c: str | Column, longest: int = 180) -> Column:
    """Safe file name that keeps its extension when cut (STR-13)."""
    v = F.regexp_replace(F.regexp_replace(col(c), "[^A-Za-z0-9._-]", "_"), "^[._]+|[._]+$", "")
    v = F.when(v == "", "file").otherwise(v)
    ext = F.regexp_extract(v, r"\.([^.]*)$", 1)
    stem = F.regexp_extract(v, r"^(.*)\.[^.]*$", 1)
    short = F.concat(F.substring(stem, F.lit(1), F.lit(longest - 1) - F.length(ext)), F.lit("."), ext)
    return (
        F.when(F.length(v) <= longest, v)
        .when(F.instr(v, ".") > 0, short)
        .otherwise(F.substring(v, 1, longest))
    )


def guess_language(c: str | Column) -> Column:
    """'te' above 5 % Telugu letters, 'en' above 60 % printable ASCII, else 'mixed' (STR-15)."""
    t = col(c)
    n = F.nullif(F.length(t), F.lit(0)).cast("double")
    telugu = F.length(F.regexp_replace(t, r"[^\x{0C00}-\x{0C7F}]", "")) / n
    latin = F.length(F.regexp_replace(t, "[^ -~]", "")) / n
    return (
        F.when(F.trim(t) == "", None)
        .when(telugu > 0.05, "te")
        .when(latin > 0.6, "en")
        .when(t.isNotNull(), "mixed")
    )


def excerpt(c: str | Column, size: int, mark: str = "…") -> Column:
    """First ``size`` characters, with a mark when the text was cut (STR-17)."""
    t = col(c)
    return F.when(F.length(t) > size, F.concat(F.substring(t, 1, size), F.lit(mark))).otherwise(t)


def strip_fences(c: str | Column) -> Column:
    """The JSON object inside a fenced block, or the trimmed text itself (STR-19)."""
    t = F.trim(col(c))
    inner = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    return F.coalesce(F.nullif(inner, F.lit("")), t)


def first_phrase(c: str | Column, phrases: Sequence[str] = TRIPWIRES) -> Column:
    """First phrase of the list that the lower-cased text contains, else null (STR-20)."""
    t = F.lower(col(c))
    return F.coalesce(*[F.when(F.contains(t, F.lit(p)), F.lit(p)) for p in phrases])


def is_blank(c: str | Column) -> Column:
    """Null or white space only (FLT-18)."""
    return F.coalesce(F.length(F.regexp_replace(col(c), r"\s+", "")), F.lit(0)) == 0


def tokens(c: str | Column) -> Column:
    """Lower-case tokens of letters and digits, in order (TXT-04)."""
    v = F.regexp_replace(F.lower(col(c)), "[^a-z0-9 ]", " ")
    return F.filter(F.split(v, r"\s+"), lambda w: w != "")


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(c, F.lit(n))
    return hit


def said(template: str | None, values: Mapping[str, Column]) -> Column:
    """Text with the values in place of {names}."""
    if template is None:
        return F.lit(None).cast("string")
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p or len(parts) == 1])

"""Rule strings as columns, verification reports, rule packs from rules.

A rule reads ``REQUIRE cond`` or ``IF cond: REQUIRE cond`` with comparisons
joined by AND, OR and NOT.  Rule lists are authored and small; each rule becomes
one expression, so applications meet all rules inside one row and nothing is
joined.  The condition text itself is read by Python's own ``ast`` module.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyworks.functions.numbers import computed_once, kept
from tallyworks.functions.skew import HOT_ROWS, join_stats

_RULE = re.compile(r"^\s*(?:IF\b(?P<cond>[^:]*):\s*)?REQUIRE\b(?P<req>[^:]*)$", re.I | re.S)
# Words, numbers, comparison signs and parentheses; everything else is refused.
_TOKENS = re.compile(r"[A-Za-z_]\w*|\d+(?:\.\d+)?|>=|<=|==|!=|>|<|\(|\)")
_KEYWORDS = re.compile(r"\b(and|or|not|if|require)\b", re.I)
_SIGNS = {
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}


class Unreadable(ValueError):
    """The rule text is outside the small language."""


@dataclass
class Truth:
    """A condition: its value, and the first input it lacked (null when none)."""

    value: Column
    missing: Column


def _read(text: str) -> ast.expr:
    if _TOKENS.sub("", text).strip():
        raise Unreadable("unexpected character")
    words = _KEYWORDS.sub(lambda m: m.group(1).lower(), text)
    try:
        return ast.parse(" ".join(words.split()), mode="eval").body
    except SyntaxError as e:
        raise Unreadable("not a condition") from e


def _value(node: ast.expr, inputs: Mapping[str, Column]) -> Truth:
    none = F.lit(None).cast("string")
    if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float)):
        return Truth(F.lit(float(node.value)), none)
    if isinstance(node, ast.Name):
        if node.id not in inputs:
            return Truth(F.lit(None).cast("double"), F.lit(node.id))
        c = inputs[node.id].cast("double")
        return Truth(c, F.when(c.isNull(), F.lit(node.id)))
    raise Unreadable("value expected")


def _truth(node: ast.expr, inputs: Mapping[str, Column]) -> Truth:
    """Left to right, and no further than needed: a later input may be missing unnoticed."""
    if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _SIGNS:
        a, b = _value(node.left, inputs), _value(node.comparators[0], inputs)
        return Truth(_SIGNS[type(node.ops[0])](a.value, b.value), F.coalesce(a.missing, b.missing))
    if isinstance(node, ast.BoolOp):
        parts = [_truth(n, inputs) for n in node.values]
        stop = isinstance(node.op, ast.Or)  # the value that ends the evaluation
        out = parts[-1]
        for p in reversed(parts[:-1]):
            ends = p.value if stop else ~p.value
            out = Truth(
                F.when(p.missing.isNotNull(), F.lit(None).cast("boolean")).when(ends, F.lit(stop)).otherwise(out.value),
                F.when(p.missing.isNotNull(), p.missing).when(ends, F.lit(None).cast("string")).otherwise(out.missing),
            )
        return out
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        t = _truth(node.operand, inputs)
        return Truth(~t.value, t.missing)
    raise Unreadable("condition expected")


def verdict(logic: str, inputs: Mapping[str, Column]) -> Column:
    """struct(status, reason) of one rule: pass, fail or manual_review (RUL-08).

    A false precondition passes; a missing input or unreadable text asks for
    manual review.
    """

    def out(status: str, reason: str | Column) -> Column:
        r = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(status).alias("status"), r.alias("reason"))

    m = _RULE.match(logic)
    try:
        if m is None:
            raise Unreadable("expected REQUIRE, or IF ... : REQUIRE")
        req = _truth(_read(m["req"]), inputs)
        cond = _truth(_read(m["cond"]), inputs) if m["cond"] is not None else None
    except Unreadable as e:
        return out("manual_review", f"unparseable rule: {e}")

    def lacks(t: Truth) -> Column:
        return out("manual_review", F.concat(F.lit("missing input: "), t.missing))

    end = (
        F.when(req.missing.isNotNull(), lacks(req))
        .when(req.value, out("pass", "check satisfied"))
        .otherwise(out("fail", "required condition not met"))
    )
    if cond is None:
        return end
    return (
        F.when(cond.missing.isNotNull(), lacks(cond))
        .when(~cond.value, out("pass", "precondition not applicable"))
        .otherwise(end)
    )


def checks(df: DataFrame, rules: Sequence[Mapping], inputs: Mapping[str, Column]) -> DataFrame:
    """Add ``checks``: one struct per rule (RUL-09, JN-17)."""
    rows = [
        F.struct(
            F.lit(r["rule_id"]).alias("rule_id"),
            F.lit(r.get("description")).alias("description"),
            verdict(r["python_logic"], inputs).alias("verdict"),
        )
        for r in rules
    ]
    return computed_once(df.withColumn("checks", F.array(*rows)))


def report(df: DataFrame, key: str) -> DataFrame:
    """One row per application and rule (RUL-09)."""
    rows = df.select(key, F.inline("checks"))
    return rows.select(key, "rule_id", "description", "verdict.status", "verdict.reason")


def _count(status: str) -> Column:
    return F.size(F.filter("checks", lambda c: c["verdict"]["status"] == status))


def outcome(df: DataFrame, key: str) -> DataFrame:
    """Pass, fail and manual counts and the outcome of each application (AGG-56)."""
    n = {s: _count(s) for s in ("pass", "fail", "manual_review")}
    what = (
        F.when(n["fail"] > 0, "needs_correction")
        .when(n["manual_review"] > 0, "manual_verification_required")
        .otherwise("auto_pass_eligible")
    )
    return df.select(key, *[c.alias(f"{s}_count") for s, c in n.items()], what.alias("outcome"))


# --- rule packs -----------------------------------------------------------------------

# Category patterns, first match wins.
CATEGORY_PATTERNS = (
    (r"(?i)high[- ]rise|high\s*rise", "residential_high_rise"),
    (r"(?i)mid[- ]rise|mid\s*rise", "residential_mid_rise"),
    (r"(?i)\bcommercial\b", "commercial"),
    (r"(?i)\bindustrial\b", "industrial"),
    (r"(?i)\binstitutional\b", "institutional"),
    (r"(?i)mixed\s*use", "mixed_use"),
    (r"(?i)\bresidential\b|\blow[- ]rise\b", "residential_low_rise"),
)
# Input-name patterns and the pack key of each, first match wins.
THRESHOLD_PATTERNS = (
    (r"(?i)front_setback", "minFrontSetbackM"),
    (r"(?i)rear_setback", "minRearSetbackM"),
    (r"(?i)side_setback|left_setback|right_setback", "minSideSetbackM"),
    (r"(?i)\bheight", "maxHeightM"),
    (r"(?i)road_width", "minRoadWidthM"),
    (r"(?i)\bfar\b", "maxFAR"),
    (r"(?i)ground_coverage", "maxGroundCoveragePercent"),
    (r"(?i)parking", "parkingPerDwellingUnit"),
)


def first_pattern(c: Column, table: Sequence[tuple[str, str]]) -> Column:
    out = None
    for pat, name in table:
        hit = c.rlike(pat)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def rule_category(description: str, verbatim: str) -> Column:
    """Category of a rule by ordered patterns; null when none fits (RUL-06)."""
    return first_pattern(F.concat_ws(" ", description, verbatim), CATEGORY_PATTERNS)


def threshold(logic: str) -> Column:
    """struct(key, value) of the first comparison of a known input with a number (RUL-07).

    The required part is searched before the precondition.
    """
    sign = r"(?:>=|<=|==|!=|>|<)"
    name, num = r"([A-Za-z_]\w*)", r"(\d+(?:\.\d+)?)"
    both = F.concat(
        F.regexp_extract(logic, r"(?is)\bREQUIRE\b(.*)$", 1), F.lit(" ; "), F.regexp_extract(logic, r"(?is)^\s*IF\b([^:]*):", 1)
    )
    # A number on the left is turned round first.
    turned = F.regexp_replace(both, rf"(?<![\w.]){num}\s*({sign})\s*{name}", "$3 $2 $1")
    found = F.regexp_extract_all(turned, F.lit(rf"{name}\s*{sign}\s*{num}(?![\w.])"), 0)

    def entry(cmp: Column) -> Column:
        return F.struct(
            first_pattern(F.regexp_extract(cmp, name, 1), THRESHOLD_PATTERNS).alias("key"),
            F.regexp_extract(cmp, rf"{sign}\s*{num}", 1).cast("double").alias("value"),
        )

    return F.get(F.filter(F.transform(found, entry), lambda s: s["key"].isNotNull()), F.lit(0))


def derive_packs(rules: DataFrame) -> DataFrame:
    """Strictest value per category and key (AGG-55)."""
    d = rules.select(
        rule_category("description", "verbatim_chunk").alias("category"), threshold("python_logic").alias("_t")
    ).where(F.col("category").isNotNull() & F.col("_t").isNotNull())
    lower = F.col("key").startswith("min") | (F.col("key") == "parkingPerDwellingUnit")
    return (
        d.select("category", "_t.key", "_t.value")
        .groupBy("category", "key")
        .agg(F.max("value").alias("_hi"), F.min("value").alias("_lo"))
        .select("category", "key", F.when(lower, F.col("_hi")).otherwise(F.col("_lo")).alias("value"))
    )


def packs_wide(packs: DataFrame) -> DataFrame:
    """One row per category with a column per key (AGG-55)."""
    return packs.groupBy("category").pivot("key", [k for _, k in THRESHOLD_PATTERNS]).agg(F.max("value"))


def unmappable(rules: DataFrame) -> DataFrame:
    """Rules without a category or a threshold."""
    cat, thr = rule_category("description", "verbatim_chunk"), threshold("python_logic")
    return rules.where(cat.isNull() | thr.isNull()).select("rule_id", cat.alias("category"), thr["key"].alias("key"))


# --- extraction windows ------------------------------------------------------------------


def page_windows(pages: DataFrame, size: int, overlap: int = 0, doc: str = "doc", page: str = "page_number",
                 text: str = "text", hot: int = HOT_ROWS) -> DataFrame:
    """Overlapping windows of consecutive pages with their joined text (WIN-14).

    Pages are numbered from 1 without gaps.  A page knows its windows by
    arithmetic, so no range join is needed; a window holds ``size`` pages.  The
    pages of a document above ``hot`` of them learn its last page by broadcast
    and are never gathered.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("need size >= 1 and 0 <= overlap < size")
    step = size - overlap
    last = pages.groupBy(doc).agg(F.max(page).alias("_last"), F.count(F.lit(1)).alias("_pages"))
    i = F.col(page) - 1
    low = F.greatest(F.ceil((i - size + 1) / step), F.lit(0)).cast("long")
    # Windows start at multiples of the step until one reaches the last page.
    final = F.greatest(F.ceil((F.col("_last") - size) / step), F.lit(0)).cast("long")
    high = F.least(F.floor(i / step).cast("long"), final)
    w = F.when(low <= high, F.sequence(low, high))
    body = F.concat(F.lit("[Page "), F.col(page).cast("string"), F.lit("]\n"), F.col(text))
    return (
        join_stats(pages, last, [doc], "_pages", [page], hot)
        .select(doc, F.col(page).alias("_p"), body.alias("_b"), F.explode(w).alias("window_no"))
        .groupBy(doc, "window_no")
        .agg(
            F.min("_p").alias("start_page"),
            F.max("_p").alias("end_page"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_b"))), lambda s: s["_b"]), "\n\n").alias("text"),
        )
    )


def parse_extractions(raw: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Parsed window outputs; an unreadable body gives null and ``malformed`` (JSN-01, STR-19)."""
    from tallyworks.functions.text import strip_fences

    parsed = F.from_json(strip_fences(body), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return raw.withColumn("parsed", parsed).withColumn("malformed", F.col("parsed").isNull() | F.col("parsed._bad").isNotNull())


def cross_reference_warnings(rules: DataFrame, processes: DataFrame, assets: DataFrame) -> DataFrame:
    """References to rules and assets that do not exist (JN-16)."""
    p = processes.select("process_name", F.explode("associated_rules").alias("rule_id"))
    a = rules.select("rule_id", F.explode("associated_assets").alias("asset_id"))
    w1 = p.join(rules.select("rule_id"), "rule_id", "left_anti").select(
        F.concat(F.lit("process '"), "process_name", F.lit("' references unknown rule "), "rule_id").alias("warning"))
    w2 = a.join(assets.select("asset_id"), "asset_id", "left_anti").select(
        F.concat(F.lit("rule "), "rule_id", F.lit(" references unknown asset "), "asset_id").alias("warning"))
    return w1.unionByName(w2)


def token_totals(windows: DataFrame) -> DataFrame:
    """Input and output tokens over all windows (AGG-57)."""
    return windows.agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
    )


ID_PATTERN = r"^[A-Z][A-Z0-9_]+$"
ASSET_TYPES = ("Table", "Diagram", "Image")


def schema_problems(df: DataFrame, body: str, allowed: Sequence[str], id_field: str = "asset_id") -> DataFrame:
    """Problems of raw JSON records: extra keys, id form, page number, type (JSN-02)."""
    m = F.from_json(body, "map<string,string>")
    d = df.withColumn("_m", m)
    known = F.array(*[F.lit(a) for a in allowed])
    extra = F.size(F.array_except(F.map_keys("_m"), known)) > 0

    def field(n: str) -> Column:
        return F.trim(F.try_element_at("_m", F.lit(n)))

    problems = kept(
        F.when(F.col("_m").isNull(), F.lit("not_json")),
        F.when(extra, F.lit("extra_keys")),
        F.when(~F.coalesce(field(id_field).rlike(ID_PATTERN), F.lit(False)), F.lit("bad_id")),
        F.when(~F.coalesce(field("page_number").try_cast("int") >= 1, F.lit(False)), F.lit("bad_page_number")),
        F.when(~F.coalesce(field("asset_type").isin(*ASSET_TYPES), F.lit(False)), F.lit("bad_type")),
    )
    return d.withColumn("problems", problems).drop("_m")

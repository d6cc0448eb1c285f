"""Document corpus: duplicates, types, relevance, manifests, collection policy, run counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyworks.functions import ids
from tallyworks.functions.numbers import clamp, col, computed_once, half_even, kept, lookup
from tallyworks.functions.skew import BROADCAST_ROWS, HOT_ROWS, bounded, join_stats, small, spread_join, spread_lookup
from tallyworks.functions.text import contains_any
from tallyworks.session import checkpointed

# Document classes in order; an earlier class wins ties.
CLASSES = (
    "NIT", "RFP", "Tender_Document", "ITT", "TDS", "Evaluation_Qualification_Criteria", "Tender_Forms",
    "Schedule_of_Payments", "Scope_of_Work", "Technical_Specifications", "Design_Criteria", "GCC", "SCC",
    "Contract_Forms", "Corrigendum", "BOQ", "Award_of_Contract", "Evaluation_Statement", "Unknown",
)
# Substrings, class and weight of the type rules.
TYPE_RULES: tuple[tuple[tuple[str, ...], str, int], ...] = (
    (("corrigendum",), "Corrigendum", 8),
    (("award of contract", "letter of award", "loa", "aoc"), "Award_of_Contract", 8),
    (("boq", "bill of quantities"), "BOQ", 8),
    (("schedule of payments", "milestone schedule", "payment schedule"), "Schedule_of_Payments", 6),
    (("scope of work", "scope_of_work", "sow"), "Scope_of_Work", 6),
    (("technical specification", "tech_spec", "techspec"), "Technical_Specifications", 6),
    (("design criteria", "design_criteria"), "Design_Criteria", 6),
    (("instructions to tenderers", "itt", "instructions to bidders", "itb"), "ITT", 6),
    (("tender data sheet", "tds", "bid data sheet", "bds"), "TDS", 6),
    (("evaluation and qualification criteria", "qualification criteria", "evaluation criteria"),
     "Evaluation_Qualification_Criteria", 7),
    (("evaluation statement",), "Evaluation_Statement", 6),
    (("tender forms", "tender_forms", "form fin", "form-fin"), "Tender_Forms", 5),
    (("general conditions of contract", "gcc"), "GCC", 6),
    (("special conditions of contract", "scc"), "SCC", 6),
    (("contract forms", "contract_forms"), "Contract_Forms", 5),
    (("nit", "notice inviting tender", "tender notice"), "NIT", 5),
    (("rfp", "request for proposal"), "RFP", 5),
    (("tender document", "bid document", "tender_document"), "Tender_Document", 4),
)
HINT_WEIGHT = 3
BASE_CLASSES = ("Tender_Document", "RFP")
# Categories of the works family.
WORKS = (
    "Works", "Civil", "EPC", "Roads", "Bridges", "Buildings", "Water", "Irrigation", "Ports", "IT System",
    "Consultancy",
)
# Suggested use of each document type.
SUGGESTED_USE = {
    "Scope_of_Work": "tender_structure_learning",
    "Technical_Specifications": "clause_extraction",
    "Design_Criteria": "clause_extraction",
    "Evaluation_Qualification_Criteria": "criteria_extraction",
    "Tender_Forms": "tender_structure_learning",
    "Schedule_of_Payments": "tender_structure_learning",
    "GCC": "rulebook_learning",
    "SCC": "rulebook_learning",
    "Contract_Forms": "rulebook_learning",
    "Corrigendum": "rulebook_learning",
    "BOQ": "demo_only",
    "Award_of_Contract": "demo_only",
    "Evaluation_Statement": "criteria_extraction",
    "ITT": "rulebook_learning",
    "TDS": "rulebook_learning",
    "NIT": "demo_only",
    "RFP": "tender_structure_learning",
    "Tender_Document": "tender_structure_learning",
    "Unknown": "manual_review",
}


# --- types and scores ---------------------------------------------------------------


def best_class(blob: Column, hint: Column | None = None) -> Column:
    """Winning struct(s score, o order, label, top) of lower-cased text, by substring rules and a soft hint."""
    best_possible: dict[str, int] = {}
    scores: dict[str, Column] = {c: F.lit(0) for c in CLASSES}
    for needles, label, weight in TYPE_RULES:
        scores[label] = scores[label] + F.when(contains_any(blob, needles), weight).otherwise(0)
        best_possible[label] = best_possible.get(label, 0) + weight
    rows = []
    for i, c in enumerate(CLASSES):
        s = scores[c]
        if hint is not None:
            s = s + F.when(hint == c, HINT_WEIGHT).otherwise(0)
        top = best_possible.get(c, 1) + HINT_WEIGHT
        rows.append(F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(c).alias("label"), F.lit(float(top)).alias("top")))
    return F.array_max(F.array(*rows))


def type_blob(*parts: str | Column) -> Column:
    """Lower-cased non-empty parts joined by blanks."""
    return F.lower(F.concat_ws(" ", *[F.nullif(col(p), F.lit("")) for p in parts]))


def with_class(df: DataFrame, *parts: str, hint: str | None = None) -> DataFrame:
    """Add classified_type and classification_confidence from the whole texts (RUL-03)."""
    df = computed_once(df.withColumn("_blob", type_blob(*parts, *([hint] if hint else []))))
    df = computed_once(df.withColumn("_b", best_class(F.col("_blob"), F.col(hint) if hint else None)).drop("_blob"))
    none = F.col("_b.s") == 0
    conf = half_even(F.least(F.lit(0.99), F.col("_b.s") / F.col("_b.top")), 3)
    return df.withColumns(
        {
            "classified_type": F.when(none, "Unknown").otherwise(F.col("_b.label")),
            "classification_confidence": F.when(none, 0.0).otherwise(conf),
        }
    ).drop("_b")


# The phrases that text rules look for.
PHRASES = (
    "evaluation", "criteria", "qualification", "similar work", "experience", "scope of work", "technical specification", "financial capacity",
    "bid capacity", "general conditions of contract", "gcc", "special conditions of contract", "scc",
)


def with_facts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text: ``facts`` tells which phrases it holds, so that whole texts are in no later join."""
    low = computed_once(df.withColumn("_low", F.lower(F.coalesce(text, F.lit("")))).drop(text))
    return computed_once(low.withColumn("facts", F.array(*[F.contains("_low", F.lit(w)) for w in PHRASES])).drop("_low"))


def relevance_rules(p: Mapping[str, Column], facts: Column) -> list[tuple[str, int, Column]]:
    """Weighted predicates over named inputs and the facts of the text; no extraction gives '' and null."""

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.get(facts, PHRASES.index(w))
        return out

    works = F.coalesce(p["tender_category"].isin(*WORKS), F.lit(False)) | F.coalesce(
        p["product_category"].isin(*WORKS), F.lit(False)
    )
    status, kind, base = p["status"], p["classified_type"], p["has_base"]
    # Rule names and weights.
    return [
        ("country_in", 10, F.upper(F.coalesce(p["country"], F.lit(""))) == "IN"),
        ("source_official", 10, p["source_type"] == "official_portal"),
        ("category_works_family", 10, works),
        ("evaluation_criteria_text", 8, has("evaluation") & has("criteria")),
        ("qualification_similar_or_experience", 8, has("qualification") & has("similar work", "experience")),
        ("scope_of_work_text", 6, has("scope of work")),
        ("technical_spec_text", 6, has("technical specification")),
        ("financial_capacity_text", 6, has("financial capacity", "bid capacity")),
        ("gcc_text", 5, has("general conditions of contract", "gcc")),
        ("scc_text", 5, has("special conditions of contract", "scc")),
        ("corrigendum_with_base", 5, p["has_corrigendum"] & base),
        ("award_present", 5, p["has_award"]),
        ("page_count_ge_10", 3, p["page_count"] >= 10),
        ("language_en_or_te", 3, (status == "ok") & p["language"].isin("en", "te")),
        ("very_small_doc", -10, p["size"] < 20 * 1024),
        ("only_nit", -15, (kind == "NIT") & ~base),
        ("corrigendum_without_base", -10, p["has_corrigendum"] & ~base & (kind == "Corrigendum")),
        ("extraction_failed", -20, status != "ok"),
        ("near_duplicate", -15, p["near_duplicate"]),
    ]


def score_relevance(df: DataFrame, p: Mapping[str, Column]) -> DataFrame:
    """Relevance score 0..100, reasons and two recommendations, for rows of ``with_facts`` (RUL-02, ARR-02)."""
    rules = relevance_rules(p, F.col("facts"))
    hits = F.array(*[F.coalesce(c, F.lit(False)) for _, _, c in rules])
    df = computed_once(df.withColumn("_hits", hits).drop("facts"))
    total = F.lit(0)
    for i, (_, w, _) in enumerate(rules):
        total = total + F.when(F.col("_hits")[i], w).otherwise(0)
    reasons = kept(*[F.when(F.col("_hits")[i], F.lit(f"{n}({w:+d})")) for i, (n, w, _) in enumerate(rules)])
    out = df.withColumns({"relevance_score": clamp(total, 0, 100), "relevance_reasons": reasons}).drop("_hits")
    ok = F.coalesce(p["status"] == "ok", F.lit(False))
    return out.withColumns(
        {
            "recommended_for_training": (F.col("relevance_score") >= 60) & ok,
            "recommended_for_demo": (F.col("relevance_score") >= 40) & (p["size"] < 25 * 1024 * 1024),
        }
    )


def suggested_use(kind: str | Column) -> Column:
    """Use of a document type; unknown types go to manual review (PRJ-05)."""
    return lookup(F.coalesce(col(kind), F.lit("Unknown")), SUGGESTED_USE, "manual_review")


def base_flags(df: DataFrame, tender: str = "tender_id", order: Sequence[str] = ("downloaded_at", "document_id"),
               hot: int = HOT_ROWS) -> DataFrame:
    """has_base of the whole tender, and has_base_so_far in download order (JN-26, WIN-08).

    ``df`` is read twice and joined by tender: hand in written rows without texts.  A document has a base so far when it is not before the tender's first base
    document: one minimum per tender replaces a running window.
    """
    at = F.struct(*order)
    base = F.col("classified_type").isin(*BASE_CLASSES)
    first = df.groupBy(tender).agg(F.min(F.when(base, at)).alias("_first"), F.count(F.lit(1)).alias("_n"))
    j = join_stats(df, first, [tender], "_n", [order[-1]], hot)
    return j.withColumns(
        {
            "has_base": F.col("_first").isNotNull(),
            "has_base_so_far": F.coalesce(at >= F.col("_first"), F.lit(False)),
        }
    ).drop("_first", "_n")


# --- duplicates -----------------------------------------------------------------------


def two_smallest(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group the smallest (id, tag) ``m1`` and the smallest with another tag ``m2``, and the size ``n``.

    One row per (group, tag) is left before the rank, and the rank limit lets two
    rows per group and task through, so groups of any size reduce map-side.
    """
    tags = df.groupBy(*keys, "tag").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("id", "tag"))
    low = tags.withColumn("_r", rank).where("_r <= 2")
    item = F.struct("id", "tag")
    names = [F.col(k).alias(f"_{k}") for k in keys]
    found = low.groupBy(*names).agg(*[F.max(F.when(F.col("_r") == i, item)).alias(f"m{i}") for i in (1, 2)])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return tags.groupBy(*keys).agg(F.sum("n").alias("n")).join(found, on).select(*keys, "m1", "m2", "n")


def _other(tag: Column) -> Column:
    """The smallest id whose tag is not the given one."""
    return F.when(F.col("m1.tag") != tag, F.col("m1.id")).otherwise(F.col("m2.id"))


def exact_duplicates(df: DataFrame, key: str = "document_id", sha: str = "sha256", hot: int = HOT_ROWS) -> DataFrame:
    """First other document with the same content hash (JN-12)."""
    # Ids and hashes are written once; contents are read for that only.
    d = checkpointed(df.select(F.col(sha).alias("sha"), F.col(key).alias("id"), F.col(key).alias("tag")))
    low = two_smallest(d, ["sha"]).where("n > 1")
    j = join_stats(d, low, ["sha"], "n", ["id"], hot).where(F.col("n").isNotNull())
    return j.select(F.col("id").alias(key), F.col("sha").alias(sha), _other(F.col("id")).alias("duplicate_of"))


def near_duplicates(
    df: DataFrame, pct: float = 0.05, other_source: bool = False, key: str = "document_id",
    ref: str = "reference_number", kind: str = "classified_type", size: str = "file_size_bytes",
    source: str = "source_id", hot: int = HOT_ROWS,
) -> DataFrame:
    """Smallest id of another document with equal reference and type and size within pct (JN-13, JN-14).

    Every distinct size joins the power-of-two blocks it lies in, and each block
    keeps its two smallest ids.  The size range of a document is a union of at
    most two such blocks per level, so the answer is a minimum over few blocks:
    exact, without comparing documents pairwise, however many share a reference.
    ``other_source`` accepts only documents of another source.
    """
    g = ["r", "k"]
    tag = F.coalesce(F.col(source).cast("string"), F.lit("")) if other_source else F.col(key).cast("string")
    d = df.where(F.col(ref).isNotNull() & (F.col(ref) != "")).select(
        F.col(ref).alias("r"), F.col(kind).alias("k"), F.col(size).cast("long").alias("sz"), F.col(key).alias("id"),
        tag.alias("tag"))
    d = checkpointed(d)
    per_size = checkpointed(two_smallest(d, [*g, "sz"]))
    widest = per_size.agg(F.max("sz")).first()[0] or 1
    levels = F.sequence(F.lit(0), F.lit(int(2 * pct * widest + 2).bit_length()))

    def block(x: Column, level: Column) -> Column:
        return x.cast("double") / F.pow(F.lit(2.0), level)

    items = F.explode(kept(F.col("m1"), F.col("m2")))
    points = (
        per_size.select(*g, "sz", items.alias("i"))
        .select(*g, "sz", "i.id", "i.tag", F.explode(levels).alias("lv"))
        .select(*g, "lv", F.floor(block(F.col("sz"), F.col("lv"))).alias("b"), "id", "tag")
    )
    blocks = two_smallest(points, [*g, "lv", "b"])
    lo = F.ceil(F.col("sz") * F.lit(1 - pct))
    end = F.floor(F.col("sz") * F.lit(1 + pct)) + 1

    def pieces(level: Column) -> Column:
        first, last = F.ceil(block(lo, level)), F.floor(block(end, level))
        inside = first < last
        return kept(
            F.when(inside & (first % 2 == 1), F.struct(level.alias("lv"), first.alias("b"))),
            F.when(inside & (last % 2 == 1), F.struct(level.alias("lv"), (last - 1).alias("b"))),
        )

    probes = per_size.select(*g, "sz", F.inline(F.flatten(F.transform(levels, pieces))))
    cand = probes.join(blocks, [*g, "lv", "b"]).select(*g, "sz", items.alias("i")).select(*g, "sz", "i.id", "i.tag")
    best = two_smallest(cand, [*g, "sz"]).drop("n")
    best = best.join(per_size.select(*g, "sz", "n"), [*g, "sz"])
    found = join_stats(d, best, [*g, "sz"], "n", ["id"], hot)
    out = found.select(F.col("id").alias(key), _other(F.col("tag")).alias("near_duplicate_of"))
    return df.select(key).join(out, key, "left")


# --- manifests and summaries --------------------------------------------------------


def training_manifest(docs: DataFrame, scores: DataFrame, tenders: DataFrame, texts: DataFrame, note: str, run_id: str) -> DataFrame:
    """Recommended documents with tender and text attributes (JN-06)."""
    wanted = scores.where("recommended_for_training").select("document_id", "relevance_score")
    t = tenders.select("tender_id", "department", F.col("tender_category").alias("category"), F.col("form_of_contract").alias("contract_type"))
    x = texts.select("document_id", "extracted_text_path", F.col("language_guess").alias("language"), "page_count")
    return (
        docs.select("document_id", "tender_id", "source_id", F.col("classified_type").alias("document_type"), "file_path")
        .join(wanted, "document_id")
        .join(t, "tender_id", "left")
        .join(x, "document_id", "left")
        .withColumns({"rights_note": F.lit(note), "run_id": F.lit(run_id)})
    )


def demo_manifest(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """Documents recommended for the demo (JN-07)."""
    wanted = scores.where("recommended_for_demo").select("document_id", "relevance_score")
    return docs.select("document_id", "tender_id", "source_id", "classified_type").join(wanted, "document_id")


def relevance_summary(docs: DataFrame, scores: DataFrame) -> DataFrame:
    """All documents, with defaults where there is no score (JN-08)."""
    s = scores.select("document_id", "relevance_score", "recommended_for_training", "recommended_for_demo", "relevance_reasons")
    no = F.lit(False)
    return docs.select("document_id", "classified_type").join(s, "document_id", "left").select(
        "document_id",
        "classified_type",
        F.coalesce("relevance_score", F.lit(0)).alias("relevance_score"),
        F.coalesce("recommended_for_training", no).alias("recommended_for_training"),
        F.coalesce("recommended_for_demo", no).alias("recommended_for_demo"),
        F.coalesce("relevance_reasons", F.array().cast("array<string>")).alias("reasons"),
    )


def text_index(texts: DataFrame) -> DataFrame:
    """Text rows without the preview, with its length (JN-09)."""
    n = F.length(F.coalesce("text_preview", F.lit("")))
    return texts.withColumn("text_preview_length", n).drop("text_preview")


def failed(df: DataFrame, status: str = "status") -> DataFrame:
    """Rows that did not end well (FLT-13)."""
    return df.where(F.col(status) != "ok")


# Files of a run that are CSV, with their columns: fixed values.
RUN_CSV = {
    "tender_metadata": ("tender_id", "source_id", "source_tender_url", "title", "reference_number", "organisation", "department", "state", "location",
                        "tender_category", "product_category", "form_of_contract", "tender_type", "tender_value_inr", "emd_inr", "published_date",
                        "closing_date", "bid_opening_date", "has_corrigendum", "has_award", "discovered_at", "updated_at", "status"),
    "document_metadata": ("document_id", "tender_id", "source_id", "source_url", "final_url", "anchor_text", "file_name", "file_path", "content_type",
                          "file_extension", "file_size_bytes", "sha256", "downloaded_at", "status", "skip_reason", "error_message",
                          "classified_type", "classification_confidence", "near_duplicate_of"),
    "compliance_report": ("timestamp", "run_id", "source_id", "url", "decision", "rule_triggered", "reason"),
    "failed_downloads": ("document_id", "tender_id", "source_id", "source_url", "file_name", "status", "skip_reason", "error_message", "downloaded_at"),
    "relevance_summary": ("document_id", "classified_type", "relevance_score", "recommended_for_training", "recommended_for_demo", "reasons"),
}


def run_frames(
    run_id: str, tenders: DataFrame, docs: DataFrame, texts: DataFrame, scores: DataFrame, log: DataFrame, sources: DataFrame, note: str
) -> dict[str, DataFrame]:
    """The nine files of a run, for ``export_run`` with ``RUN_CSV`` (SNK-05).

    Manifests are JSON lines, a row per document, as one JSON value for all would have to be built in one task.  The run
    manifest has one line with the counts of the run, then one per source.
    """
    for c in ("source_url", "downloaded_at"):
        docs = docs if c in docs.columns else docs.withColumn(c, F.lit(None).cast("string"))
    times = docs.select("document_id", "source_url", "downloaded_at")
    demo = demo_manifest(docs, scores).join(docs.select("document_id", "file_path"), "document_id").withColumn("run_id", F.lit(run_id))
    counts = docs.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "ok").alias("documents_ok"), F.countDistinct("tender_id").alias("tenders")
    )
    run = counts.select(F.lit("run").alias("kind"), F.lit(run_id).alias("run_id"), F.lit(None).cast("string").alias("source_id"), F.struct("*").alias("counts"))
    used = sources.select(F.lit("source").alias("kind"), F.lit(run_id).alias("run_id"), F.col("source_id").cast("string"))
    return {
        "tender_metadata": tenders,
        "document_metadata": docs,
        "extracted_text_index": text_index(texts),
        "training_manifest": training_manifest(docs, scores, tenders, texts, note, run_id).join(times, "document_id"),
        "demo_dataset_manifest": demo,
        "compliance_report": log,
        "failed_downloads": failed(docs),
        "relevance_summary": relevance_summary(docs, scores),
        "run_manifest": run.unionByName(used, allowMissingColumns=True),
    }


def run_counters(log: DataFrame, docs: DataFrame, texts: DataFrame, run: str = "run_id") -> DataFrame:
    """Counters per run from log, documents and texts (AGG-59).

    Each table is reduced to one row per run before the join.
    """
    a = log.groupBy(run).agg(
        F.count_if(F.col("kind") == "page").alias("pages_fetched"),
        F.count_if(F.col("decision") == "SKIP").alias("compliance_violations"),
        F.count_if(F.coalesce(F.col("rule_triggered").startswith("tripwire"), F.lit(False))).alias("tripwires_hit"),
    )
    b = docs.groupBy(run).agg(
        F.count_if(F.col("status") == "ok").alias("documents_downloaded"),
        F.count_if(F.col("status") != "ok").alias("documents_skipped"),
    )
    c = texts.groupBy(run).agg(F.count_if(F.col("extraction_status") == "ok").alias("extractions_ok"))
    names = [x for d in (a, b, c) for x in d.columns if x != run]
    return a.join(b, run, "full").join(c, run, "full").fillna(0, names)


# --- collection policy ----------------------------------------------------------------


def source_gate(sources: DataFrame) -> DataFrame:
    """Approval of each source with the reason of a refusal (RUL-21)."""
    missing = F.lit(False)
    for c in ("tos_summary", "reviewed_by", "reviewed_on"):
        missing = missing | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    why = F.when(~F.coalesce("approved", F.lit(False)), "not_approved").when(missing, "missing_review_metadata")
    return sources.withColumns({"allowed": why.isNull(), "refusal": why})


def robots_allowed(
    urls: DataFrame, rules: DataFrame, row: Sequence[str] = ("source_id", "url"), hot: int = HOT_ROWS, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Longest matching robots rule per URL (RUL-20).

    rules: source_id, prefix, allow.  The prefixes of a source are filed by
    length; each URL probes its own path once per length that occurs in its
    source, never against all rules.  Sources and prefixes that most URLs share
    are dealt over all tasks (``spread_lookup``, ``spread_join``).  ``row`` names the
    columns that tell URLs apart.  An absent rule allows; an unreachable file
    (``robots_available`` false) allows seeds only.
    """
    # Allow wins between rules of equal length.  Written once, as both the lengths and the probes read it.
    r = checkpointed(rules.groupBy("source_id", "prefix").agg(F.max("allow").alias("_rule")))
    lengths = r.groupBy("source_id").agg(F.array_sort(F.collect_set(F.length("prefix"))).alias("_lens"))
    path = F.concat(ids.url_part("url", "path"), F.when(ids.url_part("url", "query") != "", F.concat(F.lit("?"), ids.url_part("url", "query"))).otherwise(""))
    keyed = urls.select(*dict.fromkeys([*row, "source_id"]), F.when(path == "", "/").otherwise(path).alias("_path"))
    u = spread_lookup(keyed, lengths, "source_id", row, hot, limit)
    cuts = F.filter("_lens", lambda n: n <= F.length("_path"))
    probe = u.select(*dict.fromkeys([*row, "source_id"]), F.explode(F.transform(cuts, lambda n: F.substring("_path", F.lit(1), n))).alias("prefix"))
    if bounded(r, limit):
        met = probe.join(F.broadcast(r), ["source_id", "prefix"])
    else:
        met = spread_join(probe, r, ["source_id", "prefix"], row, hot)
    hit = met.groupBy(*row).agg(F.max_by("_rule", F.length("prefix")).alias("_allow"))
    out = urls.join(hit, list(row), "left")
    by_rule = F.coalesce("_allow", F.lit(True))
    return out.withColumn(
        "robots_ok", F.when(F.col("robots_available"), by_rule).otherwise(F.col("came_from_seed"))
    ).drop("_allow")


def policy_decisions(frontier: DataFrame, sources: DataFrame, blocked: Sequence[str]) -> DataFrame:
    """First failing check per URL, or allowed (RUL-19, TOP-11).

    frontier: source_id, url, seq, came_from_seed, robots_loaded, robots_ok,
    breaker_open.  Page and document caps count the URLs of the source that
    passed all earlier checks, in ``seq`` order.
    """
    s = sources.select("source_id", "approved", "base_url", "allowed_paths", "allowed_file_extensions",
                       "robots_required", "max_pages_per_run", "max_documents_per_run")
    j = frontier.join(small(s), "source_id")
    scheme, base_scheme = F.lower(ids.url_part("url", "scheme")), F.lower(ids.url_part("base_url", "scheme"))
    path = ids.url_part("url", "path")
    path = F.when(path == "", "/").otherwise(path)
    bad_word = F.lit(False)
    for b in blocked:
        bad_word = bad_word | F.contains(F.lower(path), F.lit(b.lower()))
    ext = ids.extension("url")
    is_file = F.coalesce(ids.looks_like_file("url"), F.lit(False))
    under = F.exists("allowed_paths", lambda p: path.startswith(p))
    rule = (
        F.when(~F.col("approved"), "source_not_approved")
        .when(~scheme.isin("http", "https"), "non_http_scheme")
        .when((scheme == "http") & (base_scheme != "http"), "downgraded_to_http")
        .when(ids.url_host("url") != ids.url_host("base_url"), "host_mismatch")
        .when(~under, "path_not_allowlisted")
        .when(bad_word, "blocked_path")
        .when(is_file & ~F.array_contains("allowed_file_extensions", ext), "extension_not_allowed")
        .when(F.col("robots_required") & ~F.col("robots_loaded"), "robots_not_loaded")
        .when(F.col("robots_required") & ~F.col("robots_ok"), "robots_disallow")
    )
    # Written once, as the caps and the result both read it.
    j = checkpointed(j.select("source_id", "seq", "url", "breaker_open", "max_pages_per_run", "max_documents_per_run",
                              is_file.alias("is_file"), rule.alias("_rule")))
    # The caps are small per-run limits: a rank limit keeps cap+1 rows per source and kind.
    ok = j.where(F.col("_rule").isNull())
    cap = F.when(F.col("is_file"), F.col("max_documents_per_run")).otherwise(F.col("max_pages_per_run"))
    w = Window.partitionBy("source_id", "is_file").orderBy("seq")
    most = sources.agg(F.max(F.greatest("max_pages_per_run", "max_documents_per_run"))).first()[0] or 0
    within = (
        ok.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= int(most)).where(F.col("_rn") <= cap)
        .select("source_id", "seq", F.lit(True).alias("_within"))
    )
    j = j.join(within, ["source_id", "seq"], "left")
    capped = F.when(F.col("is_file"), "max_documents_reached").otherwise("max_pages_reached")
    final = (
        F.when(F.col("_rule").isNotNull(), F.col("_rule"))
        .when(F.col("_within").isNull(), capped)
        .when(F.col("breaker_open"), "circuit_open")
    )
    return j.select("source_id", "seq", "url", "is_file", final.alias("rule_triggered"), final.isNull().alias("allow"))

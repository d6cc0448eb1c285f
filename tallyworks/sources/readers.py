"""File readers (SRC-01 to SRC-10)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworks.functions.ids import absolute_url
from tallyworks.functions.ranking import prefix_sum
from tallyworks.functions.text import title_case
from tallyworks.sources import schemas


def read_table(spark: SparkSession, path: str, schema: str | None = None, date: str | None = None) -> DataFrame:
    """Parquet table with a declared schema; ``date`` is normalised to a date (SRC-01)."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.withColumn(date, F.to_date(date)) if date else df


def read_sheet(spark: SparkSession, path: str, schema: str, renames: Mapping[str, str]) -> DataFrame:
    """CSV export of a sheet, headed columns renamed to canonical names (SRC-02)."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)
    return df.withColumnsRenamed(dict(renames))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines manifest with defaults for absent fields (SRC-03)."""
    df = spark.read.schema(schemas.TRAINING_MANIFEST).json(path)
    return df.withColumns(
        {
            "document_type": F.coalesce("document_type", F.lit("Unknown")),
            "relevance_score": F.coalesce("relevance_score", F.lit(0)),
        }
    )


def latest_run(df: DataFrame, run: str = "run_id", wanted: str | None = None) -> DataFrame:
    """Rows of the wanted run, or of the largest run id (SRC-04)."""
    if wanted is not None:
        return df.where(F.col(run) == wanted)
    return df.where(F.col(run) == df.agg(F.max(run)).scalar())


def manifest_or_metadata(manifest: DataFrame, metadata: DataFrame, text_folder: str) -> DataFrame:
    """The manifest, or when it is empty the 'ok' rows of the metadata (SRC-05)."""
    spare = (
        metadata.where(F.col("status") == "ok")
        .where(manifest.agg(F.count(F.lit(1))).scalar() == 0)
        .select(
            "document_id",
            F.coalesce("tender_id", F.lit("")).alias("tender_id"),
            F.coalesce("source_id", F.lit("")).alias("source_id"),
            F.coalesce(F.nullif(F.col("classified_type"), F.lit("")), F.lit("Unknown")).alias("document_type"),
            F.coalesce("file_path", F.lit("")).alias("file_path"),
            F.concat(F.lit(text_folder + "/"), "document_id", F.lit(".txt")).alias("extracted_text_path"),
            F.lit(0).alias("relevance_score"),
            F.lit(None).cast("string").alias("language"),
            F.lit(None).cast("int").alias("page_count"),
        )
    )
    return manifest.select(spare.columns).unionByName(spare)


def attach_texts(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Text bodies of the manifest rows; rows without a file are dropped (SRC-06)."""
    bodies = spark.read.text(folder, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("_file"), F.col("value").alias("text")
    )
    named = manifest.withColumn("_file", F.regexp_extract("extracted_text_path", r"([^/]+)$", 1))
    return named.join(bodies, "_file").drop("_file")


def seed_urls(lines: DataFrame, sources: DataFrame, raw: str = "value") -> DataFrame:
    """Seed rows 'source_id,url' without comments, header, short or unknown rows (SRC-07)."""
    cells = F.split(F.col(raw), ",", 3)
    df = lines.select(
        F.trim(cells[0]).alias("source_id"), F.when(F.size(cells) >= 2, F.trim(F.get(cells, F.lit(1)))).alias("url")
    )
    sid = F.col("source_id")
    df = df.where(~sid.startswith("#") & (F.lower(sid) != "source_id") & (sid != "") & (F.col("url") != ""))
    return df.join(sources.select("source_id"), "source_id", "left_semi").withColumn("came_from_seed", F.lit(True))


def flatten_sources(raw: DataFrame) -> DataFrame:
    """Nested source registry to flat rows with defaults (SRC-08)."""
    blank = F.lit("")
    return raw.select(
        "source_id", "source_name", "base_url", "country", "source_type", "allowed_paths", "parser_name",
        "allowed_file_extensions", "robots_required",
        F.coalesce("review.approved", F.lit(False)).alias("approved"),
        F.nullif(F.col("review.tos_url"), blank).alias("tos_url"),
        F.coalesce("review.tos_summary", blank).alias("tos_summary"),
        F.coalesce("review.reviewed_by", blank).alias("reviewed_by"),
        F.nullif(F.col("review.reviewed_on"), blank).try_cast("date").alias("reviewed_on"),
        F.col("limits.rate_limit_seconds").alias("rate_limit_seconds"),
        F.col("limits.max_pages_per_run").alias("max_pages_per_run"),
        F.col("limits.max_documents_per_run").alias("max_documents_per_run"),
        F.coalesce("discovery.mode", F.lit("manual_seed")).alias("discovery_mode"),
        F.nullif(F.col("discovery.sitemap_url"), blank).alias("sitemap_url"),
        F.coalesce("discovery.search_pages", F.array().cast("array<string>")).alias("search_pages"),
    )


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their count (SRC-08)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# How GeoJSON names a feature, and what stands between two of them if its type comes first (an id may come before it).
_FEATURE = '"Feature"'
_BETWEEN = r'\}\s*,\s*\{\s*("id"\s*:\s*("[^"]*"|[0-9.]+)\s*,\s*)?"type"\s*:\s*$'
_HEAD = r'\[\s*\{\s*("id"\s*:\s*("[^"]*"|[0-9.]+)\s*,\s*)?"type"\s*:\s*$'


def _features(spark: SparkSession, path: str) -> DataFrame:
    """Rows (layer_order, f) of a layer: its features in order, from byte ranges of its files.

    A record ends where a feature is named, so Spark splits a file at feature borders and no row holds a layer.  Places
    come from counts per byte range.  A layer that is written another way (the type behind other members, or its name
    in a property) is told by its records and read as one document.
    """
    m = F.col("_metadata")
    cut = spark.read.option("lineSep", _FEATURE).text(path).select(
        "value", m["file_path"].alias("file"), m["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("at")
    )
    value = F.col("value")
    plain = value.rlike(r"^\s*,") & value.contains('"geometry"')
    ends = value.rlike(_BETWEEN)
    # The last record of a file ends otherwise, the first holds no feature.
    seen = cut.groupBy("file", "start").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.count_if(~plain).alias("odd"), F.count_if(~ends).alias("open"), F.count_if(value.rlike(_HEAD)).alias("heads")
    ).toPandas()  # a row per byte range
    per_file = seen.groupby("file")[["odd", "open", "heads"]].sum()
    # One record without a feature, the head; two that do not end between features: the head and the last.
    if ((per_file.odd != 1) | (per_file.open != 2) | (per_file.heads != 1)).any():
        whole = spark.read.option("multiLine", True).schema(schemas.GEOJSON).json(path)
        return whole.select(F.posexplode("features").alias("layer_order", "f"))
    seen = seen.sort_values(["file", "start"])
    seen["before"] = seen.groupby("file").n.cumsum() - seen.n - 1
    places = [(f, int(s), int(a), int(b)) for f, s, a, b in seen[["file", "start", "first", "before"]].itertuples(index=False)]
    places = F.broadcast(spark.createDataFrame(places, "file string, start long, first long, before long"))
    found = cut.join(places, ["file", "start"]).where(plain)
    return found.select((F.col("at") - F.col("first") + F.col("before")).cast("int").alias("layer_order"), F.from_json(F.concat(F.lit('{"type":"Feature"'), value), schemas.FEATURE).alias("f"))


def read_geojson(spark: SparkSession, path: str, names: Mapping[str, str], raw_names: Mapping[str, str]) -> DataFrame:
    """Polygons and multipolygons of a layer with tidy names (SRC-09).

    ``names`` maps output columns to properties of a clean layer and
    ``raw_names`` to those of a raw one; a feature that carries the first clean
    property counts as clean.  Coordinates keep x and y only.
    """
    feats = _features(spark, path).where(F.col("f.geometry.type").isin("Polygon", "MultiPolygon"))
    is_clean = F.col("f.properties")[next(iter(names.values()))].isNotNull()
    cols: list[Column] = [
        F.when(is_clean, F.col("f.properties")[names[k]])
        .otherwise(title_case(F.coalesce(F.col("f.properties")[raw_names[k]], F.lit(""))))
        .alias(k)
        for k in names
    ]
    text = F.col("f.geometry.coordinates")
    multi = F.from_json(
        F.when(F.col("f.geometry.type") == "Polygon", F.concat(F.lit("["), text, F.lit("]"))).otherwise(text),
        "array<array<array<array<double>>>>",
    )
    flat = F.transform(multi, lambda poly: F.transform(poly, lambda ring: F.transform(
        ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))
    return feats.select("layer_order", *cols, flat.alias("polygons"))


def sitemap_urls(pages: DataFrame, sources: DataFrame, order: str, body: str = "html") -> DataFrame:
    """URLs of the stored sitemap pages in the order of pages, at most max_pages_per_run per source (SRC-10).

    The cap is the feature.  A page holds no more URLs than its source may have,
    and a running count over the pages of a source tells how many are left for it.
    """
    locs = F.regexp_extract_all(F.col(body), F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), 1)
    limits = sources.select("source_id", "base_url", "max_pages_per_run")
    found = pages.join(limits, "source_id").select(
        "source_id", "base_url", "max_pages_per_run", F.col(order).alias("_page"), F.slice(locs, F.lit(1), F.col("max_pages_per_run")).alias("_locs")
    )
    counted = prefix_sum(found.withColumn("_n", F.size("_locs")), ["source_id"], ["_page"], "_n", "_before")
    left = F.greatest(F.col("max_pages_per_run") - F.col("_before"), F.lit(0)).cast("int")
    kept = counted.where(F.col("_before") < F.col("max_pages_per_run"))
    kept = kept.select("source_id", "base_url", "_before", F.posexplode(F.slice("_locs", F.lit(1), left)))
    return kept.select("source_id", (F.col("_before") + F.col("pos")).alias("pos"), absolute_url("base_url", "col").alias("url"))

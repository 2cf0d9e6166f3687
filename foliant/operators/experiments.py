"""Samples, their coverage, and runs of samples by variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import values as V

# Requirements and patterns.
COVERAGE = (("normal", 10), ("table-heavy", 10), ("formula-heavy", 5), ("multi-column", 5), ("scanned", 5), ("annotation-entity-heavy", 5))
FIGURE_WORDS = r"(?iU)\bfig(?:ure)?\.?\s*\d+|图\s*\d+"
TABLE_WORDS = r"(?iU)\b(?:table|tab\.)\s*\d+|表\s*\d+"
FORMULA_MARKS = r"[=±×÷≤≥≈∑∫√∞αβγδθλμσπΩΔ]"
FORMULA_LABELS = r"(?:^|\s)\(\d{1,3}\)(?:\s|$)"
ROW_NUMBERS = r"(?<![A-Za-z])[-+]?\d+(?:\.\d+)?%?"
ANNOTATION_WORDS = r"(?iU)\b(?:corresponding author|author contributions?|conflicts? of interest|supplementary|present address|equal contribution|footnotes?|e-?mail|affiliations?)\b"
ANNOTATION_LINE = r"(?iU)^\s*(?:\d{1,2}|[*†‡])[).]?\s+(?:Department|School|College|University|Institute|Laborator|Corresponding|Email|E-mail|These authors|Present address|Author contributions?|Conflict|Supplementary|Note\b|p\s*[<=>])"
FIRST_PAGES, LOW_TEXT, NUMBERS_IN_ROW = 20, 80, 3


def sample_metrics(pages: DataFrame) -> DataFrame:
    """Counts over the first pages of each document. pages: doc_id, page_no (from 1), text, image_count, left_blocks, right_blocks."""
    rows = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.regexp_count(x, F.lit(ROW_NUMBERS)) >= NUMBERS_IN_ROW)
    notes = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(ANNOTATION_LINE))
    count = lambda p: F.regexp_count(F.coalesce("text", F.lit("")), F.lit(p))
    first = pages.where(F.col("page_no") <= FIRST_PAGES)
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    entity = first.select("doc_id", F.explode(T.entities("text")).alias("e")).groupBy("doc_id").agg(F.countDistinct("e.type", F.lower("e.text")).alias("entity_candidate_count"), *(F.countDistinct(F.when(F.col("e.type") == k, F.lower("e.text"))).alias(f"{c}_candidate_count") for k, c in (("organization", "organization"), ("person", "person"), ("model_or_dataset", "model_dataset"))))
    totals = pages.groupBy("doc_id").agg(F.countDistinct("page_no").alias("page_count"))
    sums = first.groupBy("doc_id").agg(
        F.sum(n).alias("text_char_count"), F.count(F.when(n < LOW_TEXT, 1)).alias("low_text_page_count"), F.count(F.when(F.col("image_count") > 0, 1)).alias("image_page_count"),
        F.sum(count(TABLE_WORDS)).alias("table_keyword_count"), F.sum(F.size(rows)).alias("table_like_row_count"), F.sum(count(FORMULA_MARKS) + count(FORMULA_LABELS)).alias("formula_marker_count"),
        F.count(F.when((F.col("left_blocks") >= 2) & (F.col("right_blocks") >= 2), 1)).alias("multi_column_page_count"), F.sum(count(ANNOTATION_WORDS) + F.size(notes)).alias("annotation_marker_count"), F.sum(count(FIGURE_WORDS)).alias("figure_caption_count"),
    )
    return totals.join(sums, "doc_id", "left").join(entity, "doc_id", "left").fillna(0)


def sample_tags(metrics: DataFrame) -> DataFrame:
    """metrics with tags and type."""
    p = F.greatest(F.col("page_count"), F.lit(1))
    c = F.col
    named = c("organization_candidate_count") + c("person_candidate_count") + c("model_dataset_candidate_count")
    on = lambda x, name: F.when(x, F.lit(name))
    tags = F.array_compact(F.array(
        on((c("text_char_count") < p * 80) & ((c("image_page_count") > 0) | (c("low_text_page_count") >= p)), "scanned"),
        on((c("table_keyword_count") >= 2) | (c("table_like_row_count") >= F.greatest(F.lit(3), p * 2)), "table"),
        on(c("formula_marker_count") >= F.greatest(F.lit(8), p * 4), "formula"),
        on(c("multi_column_page_count") >= F.greatest(F.lit(1), F.bround(p * 0.4)), "multi-column"),
        on((c("annotation_marker_count") >= F.greatest(F.lit(2), p)) | (c("figure_caption_count") >= F.greatest(F.lit(3), p * 2)), "annotation"),
        on((c("entity_candidate_count") >= F.greatest(F.lit(6), p * 3)) | (named >= F.greatest(F.lit(3), p * 2)), "entity"),
        on(c("image_page_count") > 0, "image"),
    ))
    out = metrics.withColumn("tags", F.when(F.size(tags) == 0, F.array(F.lit("normal"))).otherwise(tags))
    has = lambda t: F.array_contains("tags", t)
    return out.withColumn("type", F.when(has("scanned"), "scanned").when(has("table"), "table-heavy").when(has("formula"), "formula-heavy").when(has("multi-column"), "multi-column").when(has("annotation") | has("entity"), "annotation-entity-heavy").otherwise("normal"))


def coverage(samples: DataFrame) -> DataFrame:
    """How many samples (type, tags) there are of each category against the least wanted."""
    spark: SparkSession = samples.sparkSession
    has = lambda t: F.array_contains("tags", t)
    fits = {"normal": F.col("type") == "normal", "table-heavy": (F.col("type") == "table-heavy") | has("table"), "formula-heavy": (F.col("type") == "formula-heavy") | has("formula"), "multi-column": (F.col("type") == "multi-column") | has("multi-column"), "scanned": (F.col("type") == "scanned") | has("scanned"), "annotation-entity-heavy": (F.col("type") == "annotation-entity-heavy") | has("annotation") | has("entity")}
    counts = samples.select(F.explode(F.array_compact(F.array(*(F.when(x, F.lit(k)) for k, x in fits.items())))).alias("category")).groupBy("category").agg(F.count("*").alias("count"))
    wanted = spark.createDataFrame(list(COVERAGE), "category string, minimum long")
    j = wanted.join(counts, "category", "left").fillna(0, ["count"])
    missing = F.greatest(F.lit(0), F.col("minimum") - F.col("count"))
    return j.withColumns({"missing": missing, "status": F.when(missing == 0, "met").otherwise("missing")})


def sample_metadata(rows: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Metadata rows under one set of names: each is the first alias that has a value."""
    return rows.select(*(F.coalesce(*(F.nullif(F.trim(F.col(a).cast("string")), F.lit("")) for a in names if a in rows.columns), F.lit(None).cast("string")).alias(name) for name, names in aliases.items()))


def match_metadata(samples: DataFrame, metadata: DataFrame) -> DataFrame:
    """Each sample with the metadata that fits best: by path, file name, stem, then sample_id, else by position. samples: sample_id, path, ordinal; metadata: key, ordinal, ..."""
    name = F.element_at(F.split("path", "/"), -1)
    keys = F.array(F.col("path"), name, F.regexp_replace(name, r"\.[^.]*$", ""), F.col("sample_id"))
    by_key = samples.select("sample_id", F.posexplode(F.transform(keys, F.lower)).alias("_rank", "key")).join(metadata.withColumn("key", F.lower("key")), "key").groupBy("sample_id").agg(F.min_by(F.struct(*metadata.columns), F.struct("_rank", "ordinal")).alias("by_key"))
    by_place = metadata.select("ordinal", F.struct(*metadata.columns).alias("by_place"))
    return samples.join(by_key, "sample_id", "left").join(by_place, "ordinal", "left").withColumn("metadata", F.coalesce("by_key", "by_place")).drop("by_key", "by_place")


def plan_runs(samples: DataFrame, variants: DataFrame) -> DataFrame:
    """Every sample with every variant: both are short lists that people write."""
    return samples.crossJoin(variants)


def unpivot_metrics(records: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """records (sample_id, variant, status, metrics MAP<STRING,MAP<STRING,DOUBLE>>) as rows of metric_group, field and value; a metric that is missing is 0."""
    items = F.array(*(F.struct(F.lit(g).alias("metric_group"), F.lit(f).alias("field"), F.coalesce(F.col("metrics")[g][f], F.lit(0.0)).alias("value")) for g, f in fields))
    return records.select("sample_id", "variant", "status", F.explode(items).alias("m")).select("sample_id", "variant", "status", "m.*")


def variant_means(long: DataFrame) -> DataFrame:
    """Mean of each metric by variant over successful runs."""
    return long.where(F.col("status") == "succeeded").groupBy("variant", "metric_group", "field").agg(F.avg("value").alias("mean"), F.count("value").alias("runs"))


def variant_runs(records: DataFrame) -> DataFrame:
    ok = F.count(F.when(F.col("status") == "succeeded", 1))
    return records.groupBy("variant").agg(F.count("*").alias("runs"), ok.alias("succeeded"), (F.count("*") - ok).alias("failed"))


def baseline_deltas(long: DataFrame, baseline: str) -> DataFrame:
    """Each successful run's metrics against its sample's baseline run."""
    ok = long.where((F.col("status") == "succeeded") & F.col("value").isNotNull())
    base = ok.where(F.col("variant") == baseline).groupBy("sample_id", "metric_group", "field").agg(F.first("value").alias("_base"))
    j = ok.where(F.col("variant") != baseline).join(base, ["sample_id", "metric_group", "field"])
    return j.withColumn("delta", F.col("value") - F.col("_base")).drop("_base", "status")


def merge_counters(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Counts in a map column added up by key, as long rows."""
    return rows.select(*keys, F.explode(column).alias("key", "value")).groupBy(*keys, "key").agg(F.sum("value").alias("value"))


def review_groups(rows: DataFrame, by: str, scores: list[str], decisions: list[str], counters: list[str]) -> DataFrame:
    """Review rows by a column (`unknown` where empty): mean and number of numeric scores, yes and no decisions, and counters as long rows (group, measure, key, value)."""
    group = F.coalesce(F.nullif(F.trim(F.col(by).cast("string")), F.lit("")), F.lit("unknown")).alias("group")
    parts = []
    for s in scores:
        x = F.col(s).try_cast("double")
        parts.append(rows.groupBy(group).agg(F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), F.count(x).cast("double").alias("count")).selectExpr("`group`", f"'{s}' AS measure", "stack(2, 'mean', mean, 'count', count) AS (key, value)"))
    for d in decisions:
        b = V.review_bool(d)
        parts.append(rows.groupBy(group).agg(F.count(F.when(b, 1)).cast("double").alias("yes"), F.count(F.when(~b, 1)).cast("double").alias("no")).selectExpr("`group`", f"'{d}' AS measure", "stack(2, 'yes', yes, 'no', no) AS (key, value)"))
    for c in counters:
        parts.append(rows.select(group, F.explode(V.review_counts(c)).alias("x")).groupBy("group", F.lit(c).alias("measure"), F.col("x.key").alias("key")).agg(F.sum("x.value").cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def join_reviews(reviews: DataFrame, runs: DataFrame) -> DataFrame:
    """Review rows with their run: by sample, variant and run id, else the last run of sample and variant. runs: sample_id, variant, run_id, ordinal, ..."""
    exact = runs.select("sample_id", "variant", "run_id", F.struct(*runs.columns).alias("_exact")).dropDuplicates(["sample_id", "variant", "run_id"])
    last = runs.groupBy("sample_id", "variant").agg(F.max_by(F.struct(*runs.columns), "ordinal").alias("_last"))
    return reviews.join(exact, ["sample_id", "variant", "run_id"], "left").join(last, ["sample_id", "variant"], "left").withColumn("run", F.coalesce("_exact", "_last")).drop("_exact", "_last")


def metric_rates(summary: DataFrame, rates: dict[str, tuple[str, str]]) -> DataFrame:
    """summary with a quotient of two of its columns for each name; 0 where the denominator is 0 or null."""
    return summary.withColumns({name: V.rate(F.coalesce(F.col(a), F.lit(0)), F.coalesce(F.col(b), F.lit(0))) for name, (a, b) in rates.items()})


def join_reports(reports: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """One row for each document with all reports' columns, named report_column; a report that a document lacks counts 0."""
    out: DataFrame | None = None
    for name, df in reports.items():
        part = df.select(key, *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key))
        out = part if out is None else out.join(part, key, "full_outer")
    return out.fillna(0)


def ranked(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)

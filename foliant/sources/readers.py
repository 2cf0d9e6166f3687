"""Tables from JSON, CSV, HTML and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import schemas

LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""
MOST_LINKS = 20


def line_blocks(docs: DataFrame) -> DataFrame:
    """A block for each line of documents (doc_id, text): block_id, ord, text; empty lines keep their place."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text")).select("doc_id", F.format_string("p1-b%04d", "ord").alias("block_id"), "ord", "text")


def html_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of raw pages (page_id, html) by their tags, in order: kind, ord, text without tags."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(h[1-6]|p|li|td|th|pre|figcaption)\b[^>]*>(.*?)</\1>"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("ord", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<(\w+)", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
    return rows.select("page_id", "ord", F.when(tag.rlike("^h[1-6]$"), "heading").when(tag.isin("td", "th"), "table").when(tag == "figcaption", "caption").otherwise("paragraph").alias("type"), text.alias("text"))


def page_links(pages: DataFrame) -> DataFrame:
    """Links and images of each page: counts, and the first links."""
    links = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    return pages.select("page_id", F.size(links).alias("link_count"), F.size(F.regexp_extract_all("html", F.lit(r"(?i)<img\b"), F.lit(0))).alias("image_count"), F.slice(links, 1, MOST_LINKS).alias("links"))


def page_rows(blocks: DataFrame) -> DataFrame:
    """Pages from blocks (doc_id, page_no, ord, text): their text in order."""
    item = F.sort_array(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text"))))
    return blocks.groupBy("doc_id", "page_no").agg(F.array_join(F.transform(item, lambda x: x["text"]), "\n").alias("text"), F.count("*").alias("blocks"))


def document_json(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of documents kept as JSON (doc_id, pages of blocks). What can't be read is null or 0; unknown keys of a block's meta stay in meta_json."""
    schema = f"doc_id string, pages array<struct<page_no:int,text:string,blocks:array<struct<block_id:string,type:string,text:string,bbox:array<double>,order:int,parent_id:string,meta:string>>>>"
    docs = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(path)
    pages = docs.select("doc_id", F.explode("pages").alias("p"))
    b = pages.select("doc_id", F.col("p.page_no").alias("page_no"), F.explode("p.blocks").alias("b"))
    box = F.struct(*(F.coalesce(F.get("b.bbox", F.lit(i)), F.lit(0.0)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))
    return b.select("doc_id", "b.block_id", F.coalesce("page_no", F.lit(0)).alias("page_no"), F.coalesce("b.type", F.lit("paragraph")).alias("type"), F.coalesce("b.text", F.lit("")).alias("text"), box.alias("bbox"), F.coalesce("b.order", F.lit(0)).alias("ord"), "b.parent_id", F.col("b.meta").alias("meta_json"))


def review_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A review sheet; a byte-order mark before its first header is dropped."""
    rows = spark.read.option("header", True).option("sep", sep).csv(path)
    return rows.toDF(*(c.removeprefix("﻿").strip() for c in rows.columns))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """Sample metadata: CSV, TSV, or JSON with a list of rows or with one under `samples` or `items`."""
    if path.endswith((".csv", ".tsv")):
        return review_csv(spark, path, "\t" if path.endswith(".tsv") else ",")
    rows = spark.read.option("multiLine", True).json(path)
    for name in ("samples", "items"):
        if name in rows.columns:
            return rows.select(F.explode(name).alias("r")).select("r.*")
    return rows


def results_json(spark: SparkSession, path: str) -> DataFrame:
    """Results of reading tasks: a list, or one under `results`."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.explode("results").alias("r")).select("r.*") if "results" in rows.columns else rows


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """A run log in JSON lines."""
    return spark.read.schema(schemas.RUN_EVENT).json(path)


def job_states(spark: SparkSession, path: str) -> DataFrame:
    """Status files of job directories: job_id from the directory, its own, and whether it could be read and agrees."""
    rows = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").schema("job_id string, status string, _corrupt_record string").json(path)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.select(folder.alias("job_dir"), "job_id", "status", F.col("_corrupt_record").isNull().alias("readable"), folder.eqNullSafe(F.col("job_id")).alias("matches"))


def hydrate_counts(states: DataFrame) -> DataFrame:
    return states.agg(F.count("*").alias("found"), F.count(F.when(~F.col("readable"), 1)).alias("bad"), F.count(F.when(F.col("readable") & F.col("job_id").isNull(), 1)).alias("missing"), F.count(F.when(F.col("readable") & F.col("job_id").isNotNull() & ~F.col("matches"), 1)).alias("mismatched"))


def files(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """Files to work on, and whether each begins as a PDF does."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(path)
    return rows.select("path", "length", "modificationTime", (F.substring("content", 1, 5) == F.lit(b"%PDF-")).alias("is_pdf"))


def prices(spark: SparkSession, profile: dict | None) -> DataFrame:
    """Prices (schemas.PRICE) from a profile {currency, backends: {key: {...}}}; keys lower-cased, what can't be read is 0."""
    found = []
    for key, p in ((profile or {}).get("backends") or {}).items():
        number = lambda n, p=p: float(p.get(n) or 0) if str(p.get(n) or 0).replace(".", "", 1).isdigit() else 0.0
        found.append((key.lower().strip(), str(p.get("currency") or (profile or {}).get("currency") or "USD").upper(), *(number(n) for n in ("input_per_1m_tokens", "output_per_1m_tokens", "input_per_1m_chars", "output_per_1m_chars", "per_request"))))
    return spark.createDataFrame(found, schemas.PRICE)


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """Terms from a glossary file, in the file's order."""
    terms = spark.read.option("multiLine", True).schema("terms array<struct<en:string,zh:string,first_page:string,source:string,status:string,confidence:double,section_scope:string>>").json(path)
    rows = terms.select(F.posexplode("terms").alias("ordinal", "t")).select(F.col("ordinal").cast("long").alias("ordinal"), "t.*")
    return rows.withColumn("first_page", F.col("first_page").try_cast("int"))


def pending_items(spark: SparkSession, path: str) -> DataFrame:
    """Items that wait for review."""
    rows = spark.read.option("multiLine", True).schema("items array<struct<type:string,status:string,en:string,existing_zh:array<string>,candidate_zh:string,first_page:int,source:string>>").json(path)
    return rows.select(F.posexplode("items").alias("ordinal", "i")).select(F.col("ordinal").cast("long").alias("ordinal"), "i.*")


def accepted_uploads(found: DataFrame, most_bytes: int = 120 << 20) -> DataFrame:
    """files() with why an upload is refused; null where it isn't."""
    return found.withColumn("refused", F.when(~F.col("is_pdf"), "not_a_pdf").when(F.col("length") > most_bytes, "too_large"))

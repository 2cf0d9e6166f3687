"""Reports, merged texts and sheets as files, by Spark's own commit protocol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T


def merged_documents(chunks: DataFrame, text: str = "target") -> DataFrame:
    """Each document's chunks in order as one text: front matter off, markers resolved. A document's own chunks are gathered, no more."""
    parts = F.sort_array(F.collect_list(F.struct("ord", T.without_front_matter(text).alias("text"))))
    joined = F.array_join(F.filter(F.transform(parts, lambda x: x["text"]), lambda x: x != ""), "\n\n")
    return chunks.groupBy("doc_id").agg(joined.alias("_t")).select("doc_id", T.resolve_markers("_t").alias("text"))


def link_rows(pages: DataFrame) -> DataFrame:
    """page_id, link_count and a sample of links in one cell, for pages with links."""
    return pages.where("link_count > 0").select("page_id", "link_count", F.array_join("links", " | ").alias("sample"))


def markdown_lines(report: DataFrame, columns: list[str]) -> DataFrame:
    """A report's rows as lines of a Markdown table, numbered: header and rule are lines 0 and 1."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[|\n]", " ")
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in columns)), F.lit(" |"))
    head = report.sparkSession.createDataFrame([("| " + " | ".join(columns) + " |",), ("|" + "---|" * len(columns),)], "line string")
    return head.unionByName(report.orderBy(*columns).select(line.alias("line")))


def write_sheet(rows: DataFrame, path: str) -> None:
    """A CSV sheet with a header; arrays and maps as JSON."""
    flat: list[Column] = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in rows.schema]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_report(summary: DataFrame, detail: DataFrame, path: str) -> None:
    """A report as two JSON tables."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    detail.write.mode("overwrite").json(f"{path}/detail")


def with_hash(rows: DataFrame, text: str) -> DataFrame:
    """rows with the SHA-256 by which a later overwrite or rollback knows them."""
    return rows.withColumn("sha256", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def bundle_names(files: DataFrame, renames: DataFrame) -> DataFrame:
    """Files that may go into a bundle, with their names there. files: path, is_link; renames: path, name. Links, absolute paths and paths that leave the folder are left out."""
    safe = ~F.col("is_link") & ~F.col("path").startswith("/") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    return files.where(safe).join(renames, "path", "left").withColumn("name", F.coalesce("name", "path"))


def bilingual_rows(chunks: DataFrame, issues: DataFrame, repairs: DataFrame) -> DataFrame:
    """For each chunk its source, target, issues and merged repair, for rendering side by side."""
    found = issues.groupBy("doc_id", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("severity", "issue_type"))).alias("issues"))
    fixed = repairs.where("merged").select("doc_id", "chunk_id", F.col("candidate").alias("repaired"))
    return chunks.join(found, ["doc_id", "chunk_id"], "left").join(fixed, ["doc_id", "chunk_id"], "left").withColumn("shown", F.coalesce("repaired", "target"))

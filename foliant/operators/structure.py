"""Blocks: their kinds, tables and parents, section headings, and text that goes on over a page's end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import values as V

# Fixed values.
TRANSLATABLE = ("paragraph", "heading", "table", "caption", "footnote", "formula", "reference")
CONTINUABLE = ("paragraph", "caption", "footnote", "formula")
FOOTNOTE_PARENTS = ("paragraph", "table", "formula")
DEFAULT_SIZE = 11.0


def looks_like_table(lines: Column) -> Column:
    """lines: structs of text and spans (with x). Wide lines with three spans or more, lines with many numbers or gaps, or a row of numbers beside a short heading row."""
    xs = lambda line: F.transform(line["spans"], lambda s: s["x"])
    wide = F.size(F.filter(lines, lambda line: (F.size(xs(line)) >= 3) & (F.array_max(xs(line)) - F.array_min(xs(line)) > 120)))
    many = lambda line: F.regexp_count(line["text"], F.lit(T.CELL_NUMBER)) >= 3
    gap = lambda line: line["text"].rlike(r"\t|\S\s{3,}\S")
    words = lambda line: F.size(F.filter(F.split(line["text"], r"\s+"), lambda w: w != ""))
    dense = F.size(F.filter(lines, many)) + F.size(F.filter(lines, gap))
    heading_like = F.exists(lines, lambda line: words(line).between(2, 8) & ~F.rtrim(line["text"]).endswith("."))
    return (F.size(lines) > 0) & ((wide >= 2) | (dense >= 2) | (F.exists(lines, many) & heading_like))


def line_cells(line: Column) -> Column:
    """A line's cells: its spans by x, else parts between tabs or wide gaps, else words of short or numeric lines, else the whole."""
    spans = F.transform(F.array_sort(F.transform(F.filter(line["spans"], lambda s: (F.trim(s["text"]) != "") & s["x"].isNotNull()), lambda s: F.struct(s["x"].alias("x"), F.trim(s["text"]).alias("t"))), lambda a, b: F.when(a["x"] < b["x"], -1).when(a["x"] > b["x"], 1).otherwise(0)), lambda s: s["t"])
    body = F.trim(line["text"])
    parts = F.filter(F.transform(F.split(body, r"\t+|\s{2,}"), lambda p: F.trim(p)), lambda p: p != "")
    words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    return F.when(F.size(spans) >= 2, spans).when(body == "", F.array().cast("array<string>")).when(F.size(parts) >= 2, parts).when(F.size(words).between(2, 16) & (body.rlike(T.CELL_NUMBER) | (F.size(words) <= 6)), words).otherwise(F.array(body))


def table_structure(lines: Column) -> Column:
    """A struct of padded rows, counts, header (the first row, where it has no number), numbers, warnings and confidence; null without rows."""
    rows = F.filter(F.transform(lines, line_cells), lambda r: F.size(r) > 0)
    width = F.array_max(F.transform(rows, F.size))
    tokens = F.array_distinct(F.flatten(F.transform(F.flatten(rows), lambda c: F.regexp_extract_all(c, F.lit(T.CELL_NUMBER), F.lit(0)))))
    warnings = F.array_compact(F.array(F.when(F.array_min(F.transform(rows, F.size)) != width, "ragged_table_rows"), F.when(width < 2, "low_confidence_table_columns"), F.when(F.size(tokens) >= 3, "numeric_dense_table")))
    first = F.try_element_at(rows, F.lit(1))
    header = F.when(F.exists(first, lambda c: c.rlike(T.CELL_NUMBER)), F.array().cast("array<string>")).otherwise(first)
    confidence = F.when((width >= 2) & (F.size(rows) >= 2), "medium").otherwise("low")
    return F.when(F.size(rows) > 0, F.struct(T.pad_rows(rows).alias("rows"), F.size(rows).alias("row_count"), width.alias("column_count"), header.alias("header"), F.slice(tokens, 1, 200).alias("numeric_tokens"), warnings.alias("warnings"), confidence.alias("confidence")))


def classify_blocks(raw: DataFrame) -> DataFrame:
    """raw (schemas.RAW_BLOCK) with block_id, text and type; the first rule that holds decides. Empty blocks are paragraphs."""
    sizes = F.flatten(F.transform("lines", lambda line: F.transform(line["spans"], lambda s: s["size"])))
    sizes = F.filter(sizes, lambda s: s.isNotNull())
    blocks = raw.withColumns({"text": F.trim(F.array_join(F.transform("lines", lambda line: line["text"]), "\n")), "_size": F.when(F.size(sizes) > 0, F.aggregate(sizes, F.lit(0.0), lambda a, x: a + x) / F.size(sizes)).otherwise(DEFAULT_SIZE)})
    text, size, height = F.col("text"), F.col("_size"), F.col("page_height")
    y0, y1, n = F.col("bbox.y0"), F.col("bbox.y1"), F.length("text")
    one_line = F.size(F.filter("lines", lambda line: F.trim(line["text"]) != "")) <= 1
    kind = (
        F.when(text == "", "paragraph")
        .when(((y1 < height * 0.08) | (y0 > height * 0.94)) & (n < 140), "header_footer")
        .when(text.rlike(T.REFERENCE_HEADING), "reference")
        .when(text.rlike(T.CAPTION) & (F.size("lines") <= 1), "caption")
        .when(text.rlike(T.FOOTNOTE) & ((y0 > height * 0.70) | (size <= 9.5)), "footnote")
        .when((y0 > height * 0.78) & (size <= 8.8) & (n < 500), "footnote")
        .when(looks_like_table(F.col("lines")), "table")
        .when(text.rlike(T.FORMULA) & (n < 400), "formula")
        .when((text.rlike(T.HEADING) | (one_line & (n <= 90) & (size >= 12.5))) & ~text.endswith("."), "heading")
        .otherwise("paragraph")
    )
    return blocks.withColumns({"type": kind, "block_id": F.format_string("p%d-b%04d", "page_no", "ord")}).drop("_size")


def assign_parents(blocks: DataFrame) -> DataFrame:
    """Captions and footnotes with parent_id, relation, page_gap, cross_page and warning (schemas.EDGE).

    The nearest candidate on the same page, in the order that the kind prefers: for table captions the next table, else the one before; for figure captions the image before, else the next; for footnotes the paragraph, table or formula before. Where a page has none, the adjoining page's in the same order. As-of: last and first non-null values over each page, and an equi-join with the pages' ends."""
    position = F.struct("ord", "block_id", "type")
    marks = {"table": F.col("type") == "table", "image": F.col("type") == "image", "foot": F.col("type").isin(*FOOTNOTE_PARENTS)}
    page = Window.partitionBy("doc_id", "page_no").orderBy("ord", "block_id")
    before, after = page.rowsBetween(Window.unboundedPreceding, -1), page.rowsBetween(1, Window.unboundedFollowing)
    near = blocks
    for name, mark in marks.items():
        near = near.withColumns({f"{name}_prev": F.last(F.when(mark, position), ignorenulls=True).over(before), f"{name}_next": F.first(F.when(mark, position), ignorenulls=True).over(after)})
    near = near.where(F.col("type").isin("caption", "footnote")).withColumn("kind", F.when(F.col("type") == "caption", T.caption_kind("text")))
    ends = blocks.groupBy("doc_id", "page_no").agg(*(e for name, mark in marks.items() for e in (F.max(F.when(mark, position)).alias(f"{name}_last"), F.min(F.when(mark, position)).alias(f"{name}_first"))))
    for side, step in (("a", -1), ("b", 1)):
        there = ends.select("doc_id", (F.col("page_no") - step).alias("page_no"), *(F.col(f"{name}_{end}").alias(f"{side}_{name}_{end}") for name in marks for end in ("last", "first")))
        near = near.join(there, ["doc_id", "page_no"], "left")

    def pick(*ways: tuple[str, int]) -> Column:
        return F.coalesce(*(F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.block_id").alias("id"), F.col(f"{c}.type").alias("type"), F.lit(gap).alias("gap"))) for c, gap in ways))

    parent = F.when(F.col("kind") == "table", pick(("table_next", 0), ("table_prev", 0), ("b_table_first", 1), ("a_table_last", 1))).when(F.col("kind") == "figure", pick(("image_prev", 0), ("image_next", 0), ("a_image_last", 1), ("b_image_first", 1))).when(F.col("type") == "footnote", pick(("foot_prev", 0), ("a_foot_last", 1)))
    relation = F.when(F.col("type") == "caption", F.concat(F.lit("caption_for_"), "kind")).when(F.col("_p.type") == "table", "footnote_for_table").otherwise("footnote_for_block")
    return near.withColumn("_p", parent).select("doc_id", F.col("block_id").alias("child_id"), F.col("_p.id").alias("parent_id"), F.when(F.col("_p").isNotNull(), relation).alias("relation"), F.col("_p.gap").alias("page_gap"), (F.col("_p.gap") > 0).alias("cross_page"), F.when(F.col("_p").isNull(), F.concat(F.lit("orphan_"), "type")).alias("warning"))


def section_headings(blocks: DataFrame) -> DataFrame:
    """blocks with section: the last heading at or before each, in document order."""
    order = Window.partitionBy("doc_id").orderBy("page_no", "ord", "block_id").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.last(F.when(F.col("type") == "heading", F.col("text")), ignorenulls=True).over(order))


def page_boundaries(blocks: DataFrame, word_end: str = T.WORD_END) -> DataFrame:
    """A row for each pair of adjoining pages whose last and first content blocks seem to belong together: severity, kind, stitch action, joiner and all reasons. word_end: as in starts_continuing()."""
    block = F.when(F.col("type").isin(*TRANSLATABLE) & (F.trim("text") != "") & F.col("page_no").isNotNull(), F.struct("ord", "block_id", "type", "text"))
    pages = blocks.groupBy("doc_id", "page_no").agg(F.min(block).alias("first"), F.max(block).alias("last"))
    # Compact texts are columns below the window, so that no predicate makes them again.
    pages = pages.select("doc_id", "page_no", *(F.when(F.col(x).isNotNull(), F.struct(f"{x}.block_id", f"{x}.type", T.compact(f"{x}.text").alias("text"))).alias(x) for x in ("first", "last")))
    follow = Window.partitionBy("doc_id").orderBy("page_no")
    pairs = pages.withColumns({"next_page": F.lead("page_no").over(follow), "b": F.lead("first").over(follow)}).withColumnRenamed("last", "a").where("a IS NOT NULL AND b IS NOT NULL")
    a, b = F.col("a.text"), F.col("b.text")
    same = F.col("a.type") == F.col("b.type")
    pairs = pairs.withColumns({"unfinished": T.ends_open(a, done=True), "continues": T.starts_continuing(b, word_end, done=True), "joiner_": T.hyphen_joiner(a, b, done=True), "same_kind": same & F.col("a.type").isin(*CONTINUABLE), "tables": same & (F.col("a.type") == "table"), "formulas": same & (F.col("a.type") == "formula"), "op_end": T.matches(a, T.OPERATOR_END), "op_start": T.matches(b, T.OPERATOR_START) | T.starts_continuing(b, word_end, done=True), "title": same & (F.col("a.type") == "paragraph") & T.is_title_break(a, b, done=True)})
    pairs = pairs.withColumns({
        "hyphen": F.col("same_kind") & F.col("joiner_").isNotNull(),
        "abbreviation": same & F.col("a.type").isin(*CONTINUABLE, "reference") & a.endswith(".") & T.matches(a, T.ABBREVIATION_END) & T.starts_after_abbreviation(b, word_end, done=True),
        "formula": F.col("formulas") & (F.col("op_end") | F.col("op_start") | F.col("unfinished")),
    })
    strong = F.col("tables") | F.col("hyphen") | F.col("abbreviation") | F.col("formula")
    general = F.col("unfinished") & (F.col("continues") | F.col("same_kind")) & ~F.col("title")
    on = lambda *c: F.when(c[0], F.lit(c[1]))
    reasons = F.array_compact(F.array(
        on(F.col("unfinished"), "previous_page_ends_without_terminal_punctuation"),
        on(F.col("continues"), "next_page_starts_like_continuation"),
        on(F.col("hyphen"), "hyphenated_word_break_across_page"),
        on(F.col("hyphen") & (F.col("joiner_") == "hyphen_preserve"), "preserve_hyphenated_compound"),
        on(F.col("hyphen") & (F.col("joiner_") == "hyphen_elision"), "elide_soft_line_break_hyphen"),
        on(F.col("abbreviation"), "academic_abbreviation_at_page_end"),
        on(F.col("abbreviation"), "next_page_starts_like_abbreviation_continuation"),
        on(F.col("formula"), "formula_continuation_across_page"),
        on(F.col("formula") & F.col("op_end"), "previous_formula_ends_with_operator"),
        on(F.col("formula") & F.col("op_start"), "next_formula_starts_with_math_continuation"),
        on(F.col("same_kind"), "same_continuable_block_type_across_boundary"),
        on(F.col("tables"), "possible_table_continuation"),
    ))
    kind = F.when(F.col("hyphen"), "hyphenated_word_continuation").when(F.col("abbreviation"), "academic_abbreviation_continuation").when(F.col("formula"), "formula_continuation").when(F.col("tables"), "table_continuation").when(F.col("same_kind"), F.concat("a.type", F.lit("_continuation"))).otherwise("text_continuation")
    joiner = F.when(F.col("tables"), "preserve_table_rows").when(F.col("hyphen"), F.col("joiner_")).when(F.col("formula") & ~F.col("abbreviation"), "newline").otherwise("space")
    action = F.when(F.col("tables"), "preserve_table_segments_together").when(F.col("hyphen") & (F.col("joiner_") == "hyphen_preserve"), "preserve_hyphenated_compound_across_page_boundary").when(F.col("hyphen"), "join_hyphenated_word_across_page_boundary").when(F.col("abbreviation"), "preserve_academic_abbreviation_context_across_page").when(F.col("formula"), "preserve_formula_derivation_across_page_boundary").otherwise("translate_as_continuous_cross_page_text")
    pairs = pairs.where(strong | general).withColumn("joiner", joiner)
    left = F.when(F.col("joiner") == "hyphen_elision", F.regexp_replace(a, r"[-‐-―]\s*$", "")).otherwise(a)
    glue = F.when(F.col("joiner").isin("hyphen_elision", "hyphen_preserve"), "").when(F.col("joiner") == "newline", "\n").otherwise(" ")
    return pairs.select(
        "doc_id",
        F.format_string("p%d-p%d", "page_no", "next_page").alias("boundary_id"),
        F.col("page_no").alias("prev_page"),
        "next_page",
        F.when(strong | (F.col("unfinished") & F.col("continues")), "high").otherwise("medium").alias("severity"),
        kind.alias("continuation_kind"),
        action.alias("stitch_action"),
        "joiner",
        reasons.alias("reasons"),
        F.col("a.block_id").alias("previous_block_id"),
        F.col("b.block_id").alias("next_block_id"),
        F.right(a, F.lit(160)).alias("previous_tail"),
        F.substring(b, 1, 160).alias("next_head"),
        F.substring(F.concat(left, glue, b), 1, 260).alias("merged_preview"),
    )


def structure_report(blocks: DataFrame, edges: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Long counts (doc_id, group, key, value): blocks by type, entities by type, boundaries by kind and action, linked and orphaned captions and footnotes, and the pages and fragments of the fragment rate."""
    long = lambda df, group, key: df.groupBy("doc_id", key.alias("key")).agg(F.count("*").alias("value")).select("doc_id", F.lit(group).alias("group"), "key", "value")
    found = blocks.select("doc_id", F.explode(T.entities("text")).alias("e"))
    state = F.when(F.col("parent_id").isNull(), "orphan").when(F.col("cross_page"), "cross_page").otherwise("same_page")
    fragments = boundaries.groupBy("doc_id").agg(F.count("*").alias("value")).select("doc_id", F.lit("summary").alias("group"), F.lit("fragments").alias("key"), "value")
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page_no").alias("value")).select("doc_id", F.lit("summary").alias("group"), F.lit("pages").alias("key"), "value")
    distinct = found.groupBy("doc_id").agg(F.countDistinct(F.struct("e.type", F.lower("e.text"))).alias("value")).select("doc_id", F.lit("summary").alias("group"), F.lit("distinct_entities").alias("key"), "value")
    parts = [long(blocks, "block_type", F.col("type")), long(found, "entity_type", F.col("e.type")), long(boundaries, "continuation_kind", F.col("continuation_kind")), long(boundaries, "stitch_action", F.col("stitch_action")), long(edges, "relation", F.coalesce("relation", "warning")), long(edges, "parent_page", state), fragments, pages, distinct]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reference_split(pages: DataFrame, tail_share: float | None = None) -> DataFrame:
    """For each document where its references begin (the last page with such a heading among its first 40 lines; null where that is the first page or none), and its main and tail pages. pages: doc_id, page_no from 0, text."""
    head = F.exists(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, 40), lambda x: x.rlike(T.REFERENCE_HEADING))
    docs = pages.groupBy("doc_id").agg((F.max("page_no") + 1).alias("page_count"), F.max(F.when(head, F.col("page_no"))).alias("found"))
    start = F.when(F.col("found") > 0, F.col("found"))
    if tail_share is not None:
        start = F.coalesce(start, F.when(F.col("page_count") > 2, F.col("page_count") - F.greatest(F.lit(1), F.floor(F.col("page_count") * tail_share).cast("int"))))
    docs = docs.withColumn("reference_start", start)
    upto = F.coalesce("reference_start", "page_count")
    return docs.select("doc_id", "page_count", "reference_start", F.when(upto > 0, F.sequence(F.lit(0), upto - 1)).otherwise(F.array().cast("array<int>")).alias("main_pages"), F.when(upto < F.col("page_count"), F.sequence(upto, F.col("page_count") - 1)).otherwise(F.array().cast("array<int>")).alias("tail_pages"))


def number_blocks(items: DataFrame, order: list, prefix: str, width: int = 4, name: str = "id", partition: list[str] | None = None, start: int = 0) -> DataFrame:
    """Row numbers in a documented order as ids like c0001, within each document."""
    w = Window.partitionBy(*(partition or ["doc_id"])).orderBy(*order)
    return items.withColumn(name, F.format_string(f"{prefix}%0{width}d", F.row_number().over(w) - 1 + start))


def coverage_ratio(boxes: DataFrame, keys: list[str], width: str, height: str, box: str = "bbox") -> DataFrame:
    """The share of a page that its boxes cover, at most 1."""
    page = F.first(F.col(width) * F.col(height))
    return boxes.groupBy(*keys).agg(F.least(F.lit(1.0), V.rate(F.sum(V.box_area(F.col(box))), page)).alias("area_ratio"))

"""Which pages need reading by eye, tasks for it, and what becomes of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

# Fixed values.
LOW_TEXT_WARNINGS = ("low_text_image_heavy_page", "low_text_area_page", "image_area_heavy_page", "image_caption_page")
HIGH, MEDIUM = 0.65, 0.35
MIN_CONFIDENCE, REVIEW_CONFIDENCE, MIN_TEXT, MIN_USEFUL = 0.5, 0.75, 3, 0.45
SUCCESS = ("succeeded", "success", "ok", "completed", "done")


def _flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in pairs)))


def route_pages(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """pages (schemas.PAGE) with reasons, risk_score, risk_level and action. Each reason adds its share to the score, at most 1."""
    n = lambda kind: F.count(F.when(F.col("type") == kind, 1))
    counts = blocks.groupBy("doc_id", "page_no").agg(*(n(k).alias(f"_{k}") for k in ("image", "caption", "table", "formula")))
    p = pages.join(counts, ["doc_id", "page_no"], "left").fillna(0, [f"_{k}" for k in ("image", "caption", "table", "formula")])
    chars = F.coalesce(F.nullif("text_char_count", F.lit(0)), F.length(F.trim(F.coalesce("text", F.lit("")))))
    image, area = F.coalesce("image_area_ratio", F.lit(0.0)), F.coalesce("text_area_ratio", F.lit(0.0))
    images = F.coalesce("image_count", F.lit(0))
    warned = F.coalesce("warnings", F.array().cast("array<string>"))
    rules = [
        (chars < 40, "very_low_text", 0.35),
        ((chars >= 40) & (chars < 120), "low_text", 0.20),
        ((area < 0.03) & (chars < 300), "low_text_area", 0.20),
        (image > 0.45, "image_area_heavy", 0.30),
        ((image > 0.25) & (image <= 0.45), "image_area_present", 0.18),
        ((images >= 2) | (F.col("_image") >= 2), "multiple_images", 0.12),
        ((F.col("_caption") > 0) & ((images > 0) | (F.col("_image") > 0)), "image_caption_context", 0.15),
        ((F.col("_table") > 0) & ((images > 0) | (image > 0.2)), "possible_image_table", 0.12),
        ((F.col("_formula") > 0) & (chars < 300), "formula_dense_low_text", 0.10),
        *((F.array_contains(warned, w), w, 0.08) for w in LOW_TEXT_WARNINGS),
    ]
    score = sum((F.when(c, F.lit(x)).otherwise(0.0) for c, _, x in rules), F.lit(0.0))
    p = p.withColumns({"reasons": _flags(*((c, name) for c, name, _ in rules)), "risk_score": F.least(F.lit(1.0), F.round(score, 3)), "_chars": chars, "_image_seen": (images > 0) | (image > 0.05)})
    has = lambda name: F.array_contains("reasons", name)
    seen = F.col("_image_seen")
    action = F.when((F.col("_chars") < 30) & ~seen, "skip_blank").when(seen & (has("very_low_text") | has("low_text_image_heavy_page") | (F.col("risk_score") >= HIGH)), "local_ocr").when(seen & (has("image_caption_context") | has("possible_image_table")), "vlm_review").otherwise("text_only")
    return p.withColumns({"risk_level": F.when(F.col("risk_score") >= HIGH, "high").when(F.col("risk_score") >= MEDIUM, "medium").otherwise("low"), "action": action}).drop("_chars", "_image_seen", *(f"_{k}" for k in ("image", "caption", "table", "formula")))


def crops(blocks: DataFrame, most: int = 12) -> DataFrame:
    """Up to `most` regions a page to look at: images, tables and formulas, by order and then the largest."""
    area = F.greatest(F.col("bbox.x1") - F.col("bbox.x0"), F.lit(0.0)) * F.greatest(F.col("bbox.y1") - F.col("bbox.y0"), F.lit(0.0))
    w = Window.partitionBy("doc_id", "page_no").orderBy("ord", F.desc("area"), "block_id")
    return blocks.where(F.col("type").isin("image", "table", "formula")).withColumn("area", area).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def reading_tasks(routes: DataFrame, regions: DataFrame) -> DataFrame:
    """A task for each region of pages that go to reading, or for the page where it has none; priority by action and risk."""
    wanted = routes.where(F.col("action").isin("local_ocr", "vlm_review")).select("doc_id", "page_no", "action", "risk_level", "reasons")
    tasks = wanted.join(regions.select("doc_id", "page_no", "block_id", F.col("type").alias("block_type"), "rank"), ["doc_id", "page_no"], "left")
    w = Window.partitionBy("doc_id").orderBy("page_no", F.col("rank").asc_nulls_first())
    return tasks.withColumns({"scope": F.when(F.col("block_id").isNull(), "page").otherwise("region"), "status": F.lit("pending_engine"), "priority": F.when((F.col("action") == "local_ocr") & (F.col("risk_level") == "high"), "P0").when(F.col("action") == "local_ocr", "P1").otherwise("P2"), "task_id": F.format_string("t%04d", F.row_number().over(w))}).drop("rank")


def judge_results(results: DataFrame, tasks: DataFrame, blocks: DataFrame, pages: DataFrame, least: float = MIN_CONFIDENCE) -> DataFrame:
    """results (doc_id, task_id, status, text, confidence) with reason (null where accepted) and target (block or page). The first reason that holds is given; a missing status counts as succeeded."""
    known = tasks.select("doc_id", "task_id", F.col("status").alias("task_status"), "page_no", "block_id", F.lit(True).alias("_task"))
    at_block = blocks.select("doc_id", "block_id", F.lit(True).alias("_block")).distinct()
    at_page = pages.select("doc_id", "page_no", F.lit(True).alias("_page")).distinct()
    j = results.join(known, ["doc_id", "task_id"], "left").join(at_block, ["doc_id", "block_id"], "left").join(at_page, ["doc_id", "page_no"], "left")
    reason = (
        F.when(F.col("_task").isNull(), "unknown_task")
        .when(~F.coalesce(F.col("task_status") == "pending_engine", F.lit(False)), "task_not_ready_for_writeback")
        .when(~F.coalesce("status", F.lit("succeeded")).isin(*SUCCESS), "result_not_succeeded")
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_text")
        .when(F.coalesce("confidence", F.lit(0.0)) < least, "low_confidence")
        .when(F.col("_block").isNull() & F.col("_page").isNull(), "writeback_target_missing")
    )
    return j.withColumns({"reason": reason, "target": F.when(F.col("_block"), "block").when(F.col("_page"), "page")}).drop("_task", "_block", "_page", "task_status")


def pending_tasks(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks without any result, whatever became of it."""
    return tasks.where(F.col("status") == "pending_engine").join(results.select("doc_id", "task_id").distinct(), ["doc_id", "task_id"], "left_anti")


def upsert_results(base: DataFrame, override: DataFrame) -> DataFrame:
    """base with the first row of each task replaced by the override's, and the others' overrides appended. Both: ordinal, task_id, ..."""
    first = base.withColumn("_n", F.row_number().over(Window.partitionBy("task_id").orderBy("ordinal")))
    latest = override.withColumn("_n", F.row_number().over(Window.partitionBy("task_id").orderBy(F.desc("ordinal")))).where("_n = 1").drop("_n")
    places = first.where("_n = 1").select("task_id", F.col("ordinal").alias("_at"))
    # new tasks come behind the last ordinal there is
    end, begin = base.agg(F.max("ordinal")).first()[0], override.agg(F.min("ordinal")).first()[0]
    shift = 0 if end is None or begin is None else end + 1 - begin
    replaced = latest.join(places, "task_id", "left").withColumn("ordinal", F.coalesce("_at", F.col("ordinal") + shift)).drop("_at")
    gone = latest.select("task_id", F.lit(1).alias("_n"))
    return first.join(gone, ["task_id", "_n"], "left_anti").drop("_n").unionByName(replaced.select(*base.columns))


def assess_candidates(items: DataFrame, review: float = REVIEW_CONFIDENCE) -> DataFrame:
    """items (text, confidence, block_type, target_text, warnings, cells, expected_rows, expected_columns, locked_tokens, latex, formula_tokens, equation_labels) with blockers, reasons, table_gate, formula_gate and status: blocked, needs_review or candidate.

    cells: structs of row, column and text, null where there are none given."""
    text = F.trim(F.coalesce("text", F.lit("")))
    locked = F.coalesce("locked_tokens", F.array().cast("array<string>"))
    cells, none = F.col("cells"), F.array().cast("array<string>")
    rows, columns = F.array_max(F.transform(cells, lambda c: c["row"])) + 1, F.array_max(F.transform(cells, lambda c: c["column"])) + 1
    malformed = F.exists(cells, lambda c: c["row"].isNull() | c["column"].isNull())
    spoken = F.array_join(F.transform(cells, lambda c: F.coalesce(c["text"], F.lit(""))), " ")
    is_table, is_formula = F.col("block_type") == "table", F.col("block_type") == "formula"
    table_blocks = F.when(cells.isNull(), none).otherwise(_flags((F.size(cells) == 0, "structured_table_empty_cells"), (malformed, "structured_table_malformed_cells"), (rows.isNull(), "structured_table_missing_cell_coordinates")))
    table_issues = F.when(cells.isNull(), F.array(F.lit("missing_structured_cells"))).otherwise(
        _flags((F.coalesce("expected_rows", F.lit(0)).cast("boolean") & (rows != F.col("expected_rows")), "structured_table_row_count_mismatch"), (F.coalesce("expected_columns", F.lit(0)).cast("boolean") & (columns != F.col("expected_columns")), "structured_table_column_count_mismatch"), (F.size(T.missing_tokens(locked, F.when(spoken == "", text).otherwise(spoken))) > 0, "structured_table_missing_locked_tokens"))
    )
    hay = F.concat_ws(" ", text, "latex", F.array_join(F.coalesce("formula_tokens", none), " "), F.array_join(F.coalesce("equation_labels", none), " "))
    no_latex = F.trim(F.coalesce("latex", F.lit(""))) == ""
    formula_blocks = _flags(((text == "") & no_latex, "structured_formula_empty_text"))
    formula_issues = _flags((no_latex, "structured_formula_missing_latex"), (F.size(F.coalesce("formula_tokens", none)) == 0, "structured_formula_missing_tokens"), (F.size(T.missing_tokens(F.filter(locked, lambda x: x.rlike(r"^\(.*\)$")), hay)) > 0, "structured_formula_missing_equation_labels"), (F.size(T.missing_tokens(locked, hay)) > 0, "structured_formula_missing_locked_tokens"))
    gate = lambda on, blocks, issues: F.when(~F.coalesce(on, F.lit(False)), "not_applicable").when(F.size(blocks) > 0, "blocked").when(F.size(issues) > 0, "needs_review").otherwise("passed")
    out = items.withColumns({"_tb": table_blocks, "_ti": table_issues, "_fb": formula_blocks, "_fi": formula_issues})
    out = out.withColumns({"table_gate": gate(is_table, F.col("_tb"), F.col("_ti")), "formula_gate": gate(is_formula, F.col("_fb"), F.col("_fi"))})
    table_on, formula_on = F.col("table_gate") != "not_applicable", F.col("formula_gate") != "not_applicable"
    blockers = F.concat(_flags((F.length(text) < MIN_TEXT, "too_short"), (T.useful_ratio("text") < MIN_USEFUL, "low_useful_char_ratio")), F.when(table_on, F.col("_tb")).otherwise(none), F.when(formula_on, F.col("_fb")).otherwise(none))
    reasons = F.concat(
        _flags((T.texts_overlap("text", "target_text"), "duplicate_source_text"), (F.coalesce("confidence", F.lit(0.0)) < review, "needs_confidence_review")),
        F.when(table_on, F.col("_ti")).otherwise(none),
        _flags(((F.col("table_gate") == "needs_review") & cells.isNull(), "needs_table_structure_review"), ((F.col("table_gate") == "needs_review") & cells.isNotNull(), "needs_structured_table_review")),
        F.when(formula_on, F.col("_fi")).otherwise(none),
        _flags((F.col("formula_gate") == "needs_review", "needs_structured_formula_review"), (F.size(F.coalesce("warnings", none)) > 0, "engine_warnings_present")),
    )
    return out.withColumns({"blockers": blockers, "reasons": reasons}).withColumn("status", F.when(F.size("blockers") > 0, "blocked").when(F.size("reasons") > 0, "needs_review").otherwise("candidate")).drop("_tb", "_ti", "_fb", "_fi")


def fallback_tasks(pending: DataFrame, rejected: DataFrame, gated: DataFrame) -> DataFrame:
    """One row for each task that reading by engine has not settled, with all reasons; P0 where one is a failure. Each: doc_id, task_id and, but for pending ones, reason."""
    parts = [pending.select("doc_id", "task_id", F.lit("ocr_result_pending").alias("reason"), F.lit(False).alias("failed")), rejected.select("doc_id", "task_id", "reason", F.lit(True).alias("failed")), gated.select("doc_id", "task_id", "reason", F.lit(False).alias("failed"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("doc_id", "task_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.when(F.bool_or("failed"), "P0").otherwise("P1").alias("priority"))


def map_to_chunks(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each item's chunk by its block, else by its page, else unmapped. items: doc_id, task_id, block_id, page_no; chunks: doc_id, chunk_id, block_ids, pages."""
    by_block = chunks.select("doc_id", F.explode("block_ids").alias("block_id"), "chunk_id").groupBy("doc_id", "block_id").agg(F.min("chunk_id").alias("_b"))
    by_page = chunks.select("doc_id", F.explode("pages").alias("page_no"), "chunk_id").groupBy("doc_id", "page_no").agg(F.min("chunk_id").alias("_p"))
    j = items.join(by_block, ["doc_id", "block_id"], "left").join(by_page, ["doc_id", "page_no"], "left")
    return j.withColumns({"chunk_id": F.coalesce("_b", "_p"), "mapped_by": F.when(F.col("_b").isNotNull(), "block_id").when(F.col("_p").isNotNull(), "page").otherwise("unmapped")}).drop("_b", "_p")

"""What a translated chunk must keep of its source, the issues where it doesn't, and their repair.

A chunk pair has doc_id, chunk_id, source and target; a null target is a missing translation. Issues are rows (doc_id, chunk_id, issue_type, severity, tokens).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import values as V
from foliant.operators.matching import texts_with

# Severities, repair rules and limits.
SEVERE_FORMULA_KINDS = ("equation_label", "variable", "statistic")
MEDIUM_ENTITIES = ("model_or_dataset", "acronym")
RESIDUAL_LIMIT, TOKENS_CAP = 0.45, 80
RULES = (
    ("missing_translation", "translate_missing_chunk", "chunk", "translation_backend"),
    ("missing_numbers", "rewrite_with_locked_tokens", "chunk", "translation_backend"),
    ("missing_references", "rewrite_with_locked_tokens", "chunk", "translation_backend"),
    ("missing_table_figure_tokens", "rewrite_with_locked_tokens", "chunk", "translation_backend"),
    ("missing_math_symbols", "rewrite_formula_context", "paragraph", "translation_backend"),
    ("formula_mismatch", "rewrite_formula_context", "paragraph", "translation_backend"),
    ("missing_glossary_terms", "rewrite_with_glossary_terms", "chunk", "translation_backend"),
    ("missing_entity_tokens", "rewrite_with_entity_tokens", "chunk", "translation_backend"),
    ("glossary_translation_conflict", "review_glossary_conflict", "glossary", "human_review"),
    ("table_shape_mismatch", "repair_table_shape", "table", "translation_backend"),
    ("table_cell_token_mismatch", "repair_table_cell_tokens", "table_cell", "translation_backend"),
    ("table_footnote_binding_mismatch", "repair_table_footnote_binding", "table_cell", "translation_backend"),
    ("caption_or_footnote_relation_mismatch", "rewrite_with_structure_relations", "chunk", "translation_backend"),
    ("duplicate_paragraphs", "deduplicate_overlap", "paragraph", "local_rule"),
    ("high_english_residual", "review_english_residual", "chunk", "human_or_translation_backend"),
)
FIRST_PRIORITY = ("missing_translation", "table_shape_mismatch", "table_cell_token_mismatch", "table_footnote_binding_mismatch")


def invariants(pairs: DataFrame) -> DataFrame:
    """pairs with the source's tokens and those that the target lacks, by kind, and the target's repeated paragraphs and residual ratio."""
    body = pairs.withColumn("_s", T.source_lines("source"))
    lacking = lambda c: F.filter(F.col(c), lambda x: ~F.contains(F.coalesce("target", F.lit("")), x))
    body = body.withColumns({"numbers": T.numbers("_s"), "references": T.references("_s"), "symbols": T.math_symbols("_s"), "table_figures": T.table_figure_tokens("_s"), "formulas": T.formula_tokens("_s"), "entities": T.entities("_s"), "source_shapes": T.table_shapes("_s"), "target_shapes": T.table_shapes("target")})
    return body.withColumns({
        "missing_numbers": lacking("numbers"),
        "missing_references": lacking("references"),
        "missing_symbols": lacking("symbols"),
        "missing_table_figures": F.filter("table_figures", lambda x: ~T.has_table_figure("target", x)),
        "missing_formulas": F.filter("formulas", lambda x: ~T.has_formula_token("target", x)),
        "missing_entities": F.filter("entities", lambda x: ~F.contains(F.lower(F.coalesce("target", F.lit(""))), F.lower(x["text"]))),
        "shape_errors": F.filter(F.transform("source_shapes", lambda s, i: F.struct(i.alias("table"), s.alias("source"), F.try_element_at("target_shapes", i + 1).alias("target"))), lambda x: ~x["source"].eqNullSafe(x["target"])),
        "repeated": T.repeated_paragraphs("target"),
        "residual": T.residual_ratio("target"),
    }).drop("_s")


def issues(checked: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """The issues of invariants(), and those of `more` (doc_id, chunk_id, issue_type, severity, tokens) for chunks that have a translation."""
    def issue(on: Column, kind: str, severity: Column | str, tokens: Column) -> Column:
        return F.when(on, F.struct(F.lit(kind).alias("issue_type"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.slice(tokens, 1, TOKENS_CAP).alias("tokens")))

    none = F.array().cast("array<string>")
    some = lambda c: F.size(c) > 0
    strings = lambda c, f: F.transform(c, lambda x: x[f])
    shapes = F.transform("shape_errors", lambda x: F.to_json(x))
    severe = F.when(F.exists("missing_formulas", lambda x: x["kind"].isin(*SEVERE_FORMULA_KINDS)), "high").otherwise("medium")
    named = F.when(F.exists("missing_entities", lambda x: x["type"].isin(*MEDIUM_ENTITIES)), "medium").otherwise("low")
    found = F.array_compact(F.array(
        issue(some("missing_numbers"), "missing_numbers", "high", F.col("missing_numbers")),
        issue(some("missing_references"), "missing_references", "high", F.col("missing_references")),
        issue(some("missing_table_figures"), "missing_table_figure_tokens", "medium", strings("missing_table_figures", "token")),
        issue(some("missing_symbols"), "missing_math_symbols", "medium", F.col("missing_symbols")),
        issue(some("missing_formulas"), "formula_mismatch", severe, strings("missing_formulas", "token")),
        issue(some("shape_errors"), "table_shape_mismatch", "high", shapes),
        issue(some("repeated"), "duplicate_paragraphs", "medium", F.slice("repeated", 1, 5)),
        issue(F.col("residual") >= RESIDUAL_LIMIT, "high_english_residual", "low", none),
        issue(some("missing_entities"), "missing_entity_tokens", named, strings("missing_entities", "text")),
    ))
    absent = F.array(F.struct(F.lit("missing_translation").alias("issue_type"), F.lit("high").alias("severity"), none.alias("tokens")))
    rows = checked.select("doc_id", "chunk_id", F.explode(F.when(F.col("target").isNull(), absent).otherwise(found)).alias("i")).select("doc_id", "chunk_id", "i.*")
    if more is not None:
        there = checked.where("target IS NOT NULL").select("doc_id", "chunk_id").distinct()
        rows = rows.unionByName(more.select("doc_id", "chunk_id", "issue_type", "severity", "tokens").join(there, ["doc_id", "chunk_id"], "left_semi"))
    return rows


def glossary_issues(pairs: DataFrame, glossary: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Issues of terms: conflicting ones in a source, and others whose translation the target lacks. glossary: en, zh, status; conflicts: en (lower case).

    The source is searched for the term anywhere, without regard to case."""
    terms = glossary.where((F.coalesce("status", F.lit("")) != "rejected") & (F.trim("en") != "") & (F.trim("zh") != "")).select(F.lower(F.trim("en")).alias("_en"), F.trim("zh").alias("_zh")).distinct()
    clash = conflicts.select(F.lower("en").alias("_en")).distinct().withColumn("_clash", F.lit(True))
    known = terms.join(clash, "_en", "full_outer")
    j = texts_with(pairs.where("target IS NOT NULL").withColumn("_source", F.lower("source")), known, "_source", "_en")
    bad = j.where("_clash").select("doc_id", "chunk_id", F.lit("glossary_translation_conflict").alias("issue_type"), F.lit("_en").alias("_x"), "_en")
    lost = j.where(F.col("_clash").isNull() & ~F.contains("target", F.col("_zh"))).select("doc_id", "chunk_id", F.lit("missing_glossary_terms").alias("issue_type"), F.lit("_en").alias("_x"), "_en")
    return bad.unionByName(lost).groupBy("doc_id", "chunk_id", "issue_type").agg(F.lit("medium").alias("severity"), F.array_sort(F.collect_set("_en")).alias("tokens"))


def cell_issues(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells whose locked tokens the target's cell at the same table, row and column lacks; a missing cell lacks all, a missing table none (its shape says so). Both: doc_id, chunk_id, table_index, row_index, column_index, text; cells also locked_tokens."""
    keys = ["doc_id", "chunk_id", "table_index"]
    there = targets.select(*keys).distinct()
    j = cells.join(there, keys, "left_semi").join(targets.select(*keys, "row_index", "column_index", F.col("text").alias("_t")), [*keys, "row_index", "column_index"], "left")
    return j.withColumn("missing", T.missing_tokens(F.col("locked_tokens"), F.coalesce("_t", F.lit("")))).where(F.size("missing") > 0).drop("_t")


def relation_issues(relations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Relations in a chunk (by its child or parent) with the anchors that the target lacks. relations: doc_id, child_id, parent_id, relation, anchors; chunks: doc_id, chunk_id, block_ids, target."""
    at = chunks.select("doc_id", "chunk_id", "target", F.explode("block_ids").alias("block_id"))
    ends = relations.select("*", F.explode(F.array_distinct(F.array("child_id", "parent_id"))).alias("block_id"))
    j = ends.join(at, ["doc_id", "block_id"]).dropDuplicates(["doc_id", "chunk_id", "child_id", "parent_id", "relation"])
    return j.withColumn("missing", T.missing_tokens(F.col("anchors"), F.coalesce("target", F.lit("")))).where(F.size("missing") > 0).drop("block_id")


def issue_report(found: DataFrame) -> DataFrame:
    """Counts by issue type and severity, and of both alone, as long rows (by, issue_type, severity, chunks, issues)."""
    sets = found.groupingSets([["issue_type", "severity"], ["issue_type"], ["severity"], []], "issue_type", "severity")
    return sets.agg(F.grouping_id().alias("by"), F.countDistinct("doc_id", "chunk_id").alias("chunks"), F.count("*").alias("issues"))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "issue_type string, action string, scope string, executor string")


def repair_plan(found: DataFrame) -> DataFrame:
    """found with repair_id (in order of document, chunk and issue), priority, action, scope and executor."""
    priority = F.when(F.col("issue_type").isin(*FIRST_PRIORITY) | (F.col("severity") == "high"), "P0").when(F.col("severity") == "medium", "P1").otherwise("P2")
    w = Window.partitionBy("doc_id").orderBy("chunk_id", "issue_type", "severity")
    plan = found.join(F.broadcast(rules(found.sparkSession)), "issue_type", "left")  # fifteen rows
    return plan.withColumns({"priority": priority, "repair_id": F.format_string("r%04d", F.row_number().over(w)), "action": F.coalesce("action", F.lit("manual_review")), "scope": F.coalesce("scope", F.lit("chunk")), "executor": F.coalesce("executor", F.lit("human_review"))})


def repair_requests(plan: DataFrame, pairs: DataFrame) -> DataFrame:
    """One request for each planned repair with its chunk's texts and status by executor."""
    w = Window.partitionBy("doc_id").orderBy("repair_id")
    status = F.when(F.col("executor") == "translation_backend", "ready_for_translation_backend").when(F.col("executor") == "local_rule", "ready_for_local_rule").otherwise("needs_human_review")
    return plan.join(pairs, ["doc_id", "chunk_id"], "left").withColumns({"request_id": F.format_string("rq%04d", F.row_number().over(w)), "status": status})


def validate_repairs(results: DataFrame) -> DataFrame:
    """results (candidate, locked_tokens, shapes) with missing tokens and status: failed, passed, or unchecked where there is nothing to check."""
    missing = F.filter(F.coalesce("locked_tokens", F.array().cast("array<string>")), lambda x: ~F.contains(F.coalesce("candidate", F.lit("")), x))
    out = results.withColumns({"missing": missing, "candidate_shapes": T.table_shapes("candidate")})
    nothing = (F.size(F.coalesce("locked_tokens", F.array().cast("array<string>"))) == 0) & (F.size("shapes") <= 0)
    wrong_shape = (F.size("shapes") > 0) & ~F.to_json("shapes").eqNullSafe(F.to_json("candidate_shapes"))
    return out.withColumn("validation", F.when(F.trim(F.coalesce("candidate", F.lit(""))) == "", "failed").when((F.size("missing") > 0) | wrong_shape, "failed").when(nothing, "unchecked").otherwise("passed"))


def repair_ladder(requests: DataFrame, results: DataFrame, chunks: DataFrame) -> DataFrame:
    """requests with how far each came: its validation, and whether its text goes into the chunk. requests: doc_id, request_id, chunk_id, locked_tokens, shapes, mergeable; results: doc_id, request_id, ordinal, status, candidate, of which a request's last counts; chunks: doc_id, chunk_id.

    A chunk takes one text: the first, by request_id, that passed, has a chunk and can be merged. After it the others of the chunk are in conflict, before it those that can't be merged wait for a person."""
    last = results.groupBy("doc_id", "request_id").agg(F.max_by(F.struct("status", "candidate"), "ordinal").alias("_r"))
    known = chunks.select("doc_id", "chunk_id").distinct().withColumn("_known", F.lit(True))
    j = requests.join(last, ["doc_id", "request_id"], "left").join(known, ["doc_id", "chunk_id"], "left").withColumn("candidate", F.col("_r.candidate"))
    made = F.when(F.col("_r").isNull(), "skipped_missing_result").when(~F.col("_r.status").eqNullSafe(F.lit("succeeded")), "skipped_not_succeeded")
    j = validate_repairs(j).withColumn("validation", F.coalesce(made, "validation"))
    open_ = (F.col("validation") == "passed") & F.col("_known").isNotNull()
    before = Window.partitionBy("doc_id", "chunk_id").orderBy("request_id").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.bool_or(open_ & F.col("mergeable")).over(before), F.lit(False))
    # fixed values: the steps' names
    merge = F.when(F.col("validation") != "passed", "skipped_validation_not_passed").when(F.col("_known").isNull(), "skipped_missing_chunk").when(taken, "skipped_chunk_conflict").when(~F.col("mergeable"), "skipped_manual_merge_required").otherwise("applied")
    return j.withColumn("merge", merge).drop("_r", "_known")


def merge_repairs(validated: DataFrame) -> DataFrame:
    """Which results go into their chunk: the first that passed, by request; the others' reasons to be left out."""
    w = Window.partitionBy("doc_id", "chunk_id").orderBy(F.col("_open"), "request_id")
    ranked = validated.withColumn("_open", F.when(F.col("validation") == "passed", 0).otherwise(1)).withColumn("_n", F.row_number().over(w))
    return ranked.withColumns({"merged": (F.col("_open") == 0) & (F.col("_n") == 1), "skip_reason": F.when(F.col("_open") == 1, F.concat(F.lit("validation_"), "validation")).when(F.col("_n") > 1, "chunk_already_patched")}).drop("_open", "_n")


def review_patches(merged: DataFrame, decisions: DataFrame) -> DataFrame:
    """Patches with their effective decision: the latest human one, else by validation; what isn't approved blocks publishing. decisions: doc_id, request_id, ordinal, decision."""
    latest = decisions.groupBy("doc_id", "request_id").agg(F.max_by("decision", "ordinal").alias("human"))
    out = merged.join(latest, ["doc_id", "request_id"], "left")
    default = F.when(F.col("merged"), "approve").when(F.col("validation") == "failed", "reject").otherwise("needs_review")
    return out.withColumn("effective", F.coalesce("human", default)).withColumn("publish_blocking", F.col("effective") != "approve")


def publish_gate(patches: DataFrame) -> DataFrame:
    """For each document whether its patches may be published."""
    blocking = F.count(F.when(F.col("publish_blocking"), 1))
    return patches.groupBy("doc_id").agg(F.count("*").alias("patches"), blocking.alias("blocking")).withColumn("status", F.when(F.col("patches") == 0, "nothing_to_publish").when(F.col("blocking") > 0, "blocked").otherwise("ready"))


def same_content(a: Column | str, b: Column | str) -> Column:
    """Whether two texts have the same SHA-256, as rollbacks ask before they overwrite."""
    return F.sha2(a, 256) == F.sha2(b, 256)


def change_status(before: Column, after: Column) -> Column:
    return F.when((before > 0) & (after == 0), "resolved").when((before == 0) & (after > 0), "regressed").when(after < before, "improved").when(after > before, "worsened").when(after > 0, "persisted").otherwise("clean")


def effectiveness(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Issues before and after a repair by keys: counts, delta, rate of reduction and status; keys on either side only count 0 on the other."""
    n = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    j = n(before, "before_count").join(n(after, "after_count"), keys, "full_outer").fillna(0, ["before_count", "after_count"])
    return j.withColumns({"delta": F.col("before_count") - F.col("after_count"), "reduction_rate": V.rate(F.col("before_count") - F.col("after_count"), "before_count"), "status": change_status(F.col("before_count"), F.col("after_count"))})


def overall_effect(by_type: DataFrame, by_chunk: DataFrame) -> DataFrame:
    """One row: issues before and after, new issues, chunks that got worse, and the verdict."""
    a = by_type.agg(F.coalesce(F.sum("before_count"), F.lit(0)).alias("before_count"), F.coalesce(F.sum("after_count"), F.lit(0)).alias("after_count"), F.coalesce(F.sum(F.when(F.col("status") == "regressed", F.col("after_count"))), F.lit(0)).alias("new_issues"))
    b = by_chunk.agg(F.count(F.when(F.col("status").isin("regressed", "worsened"), 1)).alias("regressed_chunks"))
    delta = F.col("before_count") - F.col("after_count")
    bad = (F.col("new_issues") > 0) | (F.col("regressed_chunks") > 0)
    verdict = F.when(bad, F.when(delta > 0, "improved_with_regressions").otherwise("regressed")).when(delta > 0, "improved").when((delta == 0) & (F.col("before_count") > 0), "unchanged").when(F.col("after_count") == 0, "clean").otherwise("needs_review")
    return a.join(F.broadcast(b), how="left").withColumns({"delta": delta, "verdict": verdict})

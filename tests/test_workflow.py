"""Reviews, promotion and publishing on hand-built rows."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import workflow
from foliant.sources import readers


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "text,columns,expected",
    [
        ("| a | b |\n|---|---|\n| 1 |", 2, [["a", "b"], ["1", ""]]),
        ("a  b\n1  2", 2, [["a", "b"], ["1", "2"]]),
        ("a b\n1 2", 2, [["a", "b"], ["1", "2"]]),
        ("a\tb\n1\t2", 2, [["a", "b"], ["1", "2"]]),
        ("a b\n1 2 3", 2, None),
        ("a b", 2, None),
        (None, 2, None),
        ("| a | b |\n| 1 | 2 |", 3, [["a", "b", ""], ["1", "2", ""]]),
    ],
)
def test_table_rows_from_text(spark, text, columns, expected):
    assert spark.createDataFrame([(text, columns)], "t string, n int").select(workflow.table_rows_from_text("t", "n").alias("x")).first().x == expected


def test_column_sides(spark):
    b = spark.createDataFrame([("d", 1, 100.0, {"x0": 0.0, "x1": 40.0}, "x" * 40), ("d", 1, 100.0, {"x0": 60.0, "x1": 90.0}, "x" * 40), ("d", 1, 100.0, {"x0": 0.0, "x1": 10.0}, "x")], "doc_id string, page_no int, width double, bbox struct<x0:double,x1:double>, text string")
    assert rows(workflow.column_sides(b), "left_blocks", "right_blocks") == [(1, 1)]


def test_diff(spark):
    d = spark.createDataFrame([("a\nb", "a\nc"), ("a", "a "), (None, None)], "x string, y string")
    assert [r.diff for r in workflow.with_diff(d, "x", "y").collect()] == ["--- current\n+++ repaired\n@@ -1,2 +1,2 @@\n a\n-b\n+c", "", ""]


def test_promotion(spark):
    c = spark.createDataFrame([("d", "b1", 1, 0, "t1", "one"), ("d", "b1", 1, 1, "t2", "two"), ("d", None, 2, 0, "t3", " ")], "doc_id string, block_id string, page_no int, index int, task_id string, text string")
    a = spark.createDataFrame([(0, "d", "t2", "b1", 1, 1, "candidate", "two"), (1, "d", "t1", "b1", 1, 1, "candidate", "one"), (2, "d", "t1", "b1", 1, 0, "blocked", "one"), (3, "d", "t9", "b1", 1, 5, "candidate", "x"), (4, "d", "t3", None, 2, 0, "candidate", ""), (5, "d", "t3", "zz", 2, 0, "candidate", "")], "item_id int, doc_id string, task_id string, block_id string, page_no int, target_index int, status string, preview string")
    assert rows(workflow.promote(a, c), "item_id", "promoted_text", "skip_reason") == [(0, "two", None), (1, "one", None), (2, None, "status_blocked"), (3, None, "source_candidate_missing"), (4, None, "empty_text"), (5, None, "source_candidate_missing")]


def test_decisions(spark):
    r = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "review_id string")
    d = spark.createDataFrame([("r1", 1, "reject", None), ("r1", 2, "Accept_Result", " yes "), ("r2", 1, "accept_result", ""), ("r3", 1, "reject", None), ("r3", 2, "", None)], "review_id string, ordinal int, decision string, text string")
    assert rows(workflow.latest_decisions(r, d), "review_id", "decision", "review_text") == [("r1", "accept_result", "yes"), ("r2", None, None), ("r3", None, None)]
    b = spark.createDataFrame([("b1", 1, "reject", ["r1", "r2"]), ("b2", 2, "reject", ["r1", "zz"]), ("b3", 3, "accept_result", ["r1"])], "batch_id string, ordinal int, decision string, review_ids array<string>")
    assert rows(workflow.batch_decisions(b, r), "review_id", "decision") == [("r1", "reject"), ("r2", "reject")]


def test_execution(spark):
    q = spark.createDataFrame([("d", "c0", "rq1", "ready_for_translation_backend", "a"), ("d", "c1", "rq2", "ready_for_translation_backend", "b"), ("d", "c2", "rq3", "needs_human_review", "c")], "doc_id string, chunk_id string, request_id string, status string, text string")
    assert rows(workflow.execute_requests(q, lambda: str.upper, 1), "request_id", "result", "candidate") == [("rq1", "succeeded", "A"), ("rq2", "skipped_by_limit", None), ("rq3", "skipped_not_ready", None)]


def test_publishing(spark):
    p = spark.createDataFrame([(False, True, True, 1, 0, 0, 0), (True, False, True, 1, 0, 0, 0), (True, True, True, 0, 0, 0, 0), (True, True, True, 1, 2, 0, 0), (True, True, True, 1, 0, 1, 0), (True, True, True, 1, 0, 0, 0)], "confirm boolean, source_present boolean, target_given boolean, applied int, review_blocking int, manual_required int, conflicts int")
    assert [r.publish_status for r in workflow.publish_status(p).collect()] == ["pending_confirmation", "blocked_missing_repaired_full", "blocked_no_applied_repairs", "blocked_patch_review", "published_with_warnings", "published"]
    b = spark.createDataFrame([(False, True, True, True, True), (False, False, True, True, True), (True, True, False, True, True), (True, True, True, True, True)], "confirm boolean, published boolean, original_present boolean, published_present boolean, target_given boolean")
    assert [r.rollback_status for r in workflow.rollback_status(b).collect()] == ["pending_confirmation", "not_ready", "blocked_missing_original", "rolled_back"]
    s = spark.createDataFrame([(True, True, "a", "a", "b"), (True, True, "b", "a", "b"), (True, True, "x", "a", "b")], "confirm boolean, published boolean, current string, expected string, replacement string")
    assert [r.replace_status for r in workflow.replace_status(s).collect()] == ["replaced", "already_replaced", "blocked_content_changed"]


def test_tables(spark):
    r = spark.createDataFrame([("d", "t1", False), ("d", "t2", True), ("d", "t3", False)], "doc_id string, table_id string, publish_blocking boolean")
    c = spark.createDataFrame([("d", "t1", True), ("d", "t2", True)], "doc_id string, table_id string, confirm boolean")
    status = workflow.table_publish(r, c)
    assert rows(status, "table_id", "status") == [("t1", "published"), ("t2", "blocked_review_required"), ("t3", "pending_confirmation")]
    cells = spark.createDataFrame([("d", "t1", "old"), ("d", "t2", "old")], "doc_id string, table_id string, text string")
    assert rows(workflow.effective_cells(cells, cells.withColumn("text", F.lit("new")), status), "table_id", "text") == [("t1", "new"), ("t2", "old")]


def test_retranslation(spark):
    s = spark.createDataFrame([("d", "c0", ["x"]), ("d", "c1", ["x"]), ("d", "c9", ["x"])], "doc_id string, chunk_id string, terms array<string>")
    c = spark.createDataFrame([("d", "c0", "text"), ("d", "c1", " ")], "doc_id string, chunk_id string, source string")
    assert rows(workflow.retranslation_plan(s, c), "chunk_id", "status") == [("c0", "planned"), ("c1", "source_text_missing"), ("c9", "chunk_not_found_in_manifest")]
    assert rows(workflow.retranslation_plan(s, c, most=1), "chunk_id", "status")[1:] == [("c1", "skipped_by_limit"), ("c9", "skipped_by_limit")]
    assert rows(workflow.retranslation_plan(s, c, "selected", ["c1", "c7"]), "chunk_id", "status") == [("c1", "source_text_missing"), ("c7", "chunk_not_found_in_manifest")]
    with pytest.raises(ValueError):
        workflow.retranslation_plan(s, c, "selected")


def test_counts(spark):
    ch = spark.createDataFrame([("d", "c0", ["b1", "b2"])], "doc_id string, chunk_id string, block_ids array<string>")
    cells = spark.createDataFrame([("d", "b1", i, 0) for i in range(30)], "doc_id string, table_id string, row_index int, column_index int")
    rel = spark.createDataFrame([("d", "b2")] * 9, "doc_id string, block_id string")
    assert rows(workflow.structure_hints(rel, cells, rel.limit(0), ch), "tables", "cells", "relations", "entities") == [(1, 18, 6, 0)]
    st = spark.createDataFrame([("d", "ok", ["x", "y"]), ("d", "ok", ["x"]), ("d", None, [])], "doc_id string, status string, reasons array<string>")
    assert rows(workflow.status_counts(st, ["status", "reasons"], ["doc_id"]), "group", "key", "value") == [("reasons", "x", 2), ("reasons", "y", 1), ("status", "ok", 2)]
    f = spark.createDataFrame([("j1", "a.md", 5), ("j1", "z", 9)], "job_id string, name string, n_bytes long")
    assert rows(workflow.artifact_status(spark.createDataFrame([("j1",), ("j2",)], "job_id string"), f, ["a.md", "b.md"]), "job_id", "present", "absent") == [("j1", ["a.md"], ["b.md"]), ("j2", [], ["a.md", "b.md"])]
    g = spark.createDataFrame([(0, "glossary_conflict", "Net ", "网"), (1, "glossary_conflict", "net", "网")], "ordinal int, type string, en string, candidate_zh string")
    assert rows(workflow.glossary_key(g), "ordinal", "dedupe_key") == [(0, "glossary_conflict:net:网")]


def test_files(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"terms": [{"en": "net", "zh": "网", "first_page": "3"}, {"en": "a", "first_page": "x"}]}')
    assert rows(readers.glossary(spark, str(tmp_path / "g.json")), "ordinal", "en", "first_page") == [(0, "net", 3), (1, "a", None)]
    (tmp_path / "p.json").write_text('{"items": [{"type": "glossary_conflict", "en": "net"}]}')
    assert rows(readers.pending_items(spark, str(tmp_path / "p.json")), "type", "en") == [("glossary_conflict", "net")]
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 and more")
    assert rows(readers.accepted_uploads(readers.files(spark, str(tmp_path)), 5), "refused") == [("too_large",)]

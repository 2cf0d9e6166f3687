"""Operators on hand-built rows with expected results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import values as V
from foliant.operators import chunking, experiments, jobs, matching, memory, metrics, quality, schemas, structure, tables, translate, vision
from foliant.sources import readers, writers

BOX = lambda x0, y0, x1, y1: {"x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# text


@pytest.mark.parametrize(
    "function,text,expected",
    [
        (T.numbers, "91.2% of 12,5 and 7 and 7 in a1", ["91.2", "12,5", "7"]),
        (T.numbers, None, []),
        (T.references, "As in [1, 2-3] and (Smith et al., 2024a) and [1, 2-3]", ["[1, 2-3]", "(Smith et al., 2024a)"]),
        (T.math_symbols, "a ≤ b = c ≤ d", ["≤", "="]),
        (T.caption_kind, "Table 2: Ablation results.", "table"),
        (T.caption_kind, "Fig. 1 Overview.", "figure"),
        (T.caption_kind, "图 3：结构", "figure"),
        (T.caption_kind, "A table of sorts", None),
        (T.without_dot_leaders, "Intro\n" + "." * 30 + "\n ... \nend", "Intro\n ... \nend"),
        (T.residual_ratio, "abc 中文 `code`", 0.6),
        (T.residual_ratio, "", 0.0),
        (T.tail, "first\n\n  last one  ", "last one"),
        (T.tail, "", ""),
        (T.without_front_matter, "---\na: 1\n---\n\nbody", "body"),
        (T.without_front_matter, "no matter ", "no matter"),
        (T.resolve_markers, f"a{T.PARAGRAPH_MARK}b{T.SENTENCE_MARK}c", "a\n\nbc\n"),
        (T.term_key, "  Deep   Learning ", "deep learning"),
        (T.fenced_json, 'so: ```json\n{"a": 1}\n``` ok', '{"a": 1}'),
        (T.fenced_json, 'so {"a": {"b": 2}} ok', '{"a": {"b": 2}}'),
        (T.ends_open, "The proposed method improves", True),
        (T.ends_open, "It ends here.)", False),
        (T.ends_open, "as follows:", True),
        (T.starts_continuing, "accuracy under shift", True),
        (T.starts_continuing, "However the rest", True),
        (T.starts_continuing, "New start", False),
        (T.useful_ratio, "ab--", 0.5),
        (T.source_lines, "[第 1 页]\ntext", "text"),
    ],
)
def test_text_functions(spark, function, text, expected):
    assert one(spark, function("t"), text) == expected


@pytest.mark.parametrize("text,by_letters,by_ascii", [("IN DAS", True, True), ("INÄTZ", False, True), ("Toé", False, True), ("FORT", False, False), ("OF_X", False, False), ("BY9", False, False), ("To\u0301", True, True), ("IN", True, True)])
def test_word_ends(spark, text, by_letters, by_ascii):
    assert one(spark, T.starts_continuing("t"), text) == by_letters
    assert one(spark, T.starts_continuing("t", T.ASCII_WORD_END), text) == by_ascii


def test_token_estimate(spark):
    assert [r.x for r in spark.createDataFrame([(0,), (1,), (4,), (5,), (80,), (None,), (-3,)], "n long").select(T.token_estimate("n").alias("x")).collect()] == [0, 1, 1, 2, 20, 0, 0]


def test_entities(spark):
    found = one(spark, T.entities("t"), "Smith et al. (2024) evaluated BERT and ImageNet at Stanford University with CNN baselines and the API.")
    assert {(e.text, e.type) for e in found} == {("Smith", "person"), ("BERT", "model_or_dataset"), ("ImageNet", "model_or_dataset"), ("Stanford University", "organization"), ("CNN", "acronym")}


def test_formula_tokens(spark):
    found = one(spark, T.formula_tokens("t"), "x_i = 3 ( 2 ) F1-score and f1-score, p < 0.05")
    assert [(f.kind, f.token) for f in found] == [("symbol", "="), ("equation_label", "(2)"), ("variable", "x_i"), ("metric", "F1-score"), ("statistic", "p < 0.05")]
    kept = spark.createDataFrame([("x_i ＝ 3（2）f1-SCORE p<0.05",)], "t string").select(F.transform(F.lit(None).cast("array<int>"), lambda x: x), "t")
    df = kept.select("t").withColumn("f", T.formula_tokens(F.lit("x_i = 3 ( 2 ) F1-score, p < 0.05")))
    assert df.select(F.forall("f", lambda x: T.has_formula_token("t", x)).alias("x")).first().x


def test_table_figure_tokens(spark):
    df = spark.createDataFrame([("See Table 2, Figure 3a and table 2.", "见表 2 和图3a")], "s string, t string").withColumn("f", T.table_figure_tokens("s"))
    assert [(f.kind, f.num) for f in df.first().f] == [("table", "2"), ("figure", "3a")]
    assert df.select(F.forall("f", lambda x: T.has_table_figure("t", x)).alias("x")).first().x
    assert not df.select(F.exists("f", lambda x: T.has_table_figure(F.lit("表 23"), x)).alias("x")).first().x


def test_markdown_tables(spark):
    text = "| a | b |\n|---|---|\n| 1 |\nprose\n| x | y | z |"
    assert one(spark, T.markdown_tables("t"), text) == [[["a", "b"], ["1", ""]], [["x", "y", "z"]]]
    assert [tuple(s) for s in one(spark, T.table_shapes("t"), text)] == [(2, 2), (1, 3)]
    assert one(spark, T.table_shapes("t"), "none") == []


def test_terms(spark):
    df = spark.createDataFrame([("The deep\n learning of nets", "Deep Learning"), ("a deep learnings", "deep learning"), ("x", "")], "t string, w string")
    assert [r.x for r in df.select(T.holds_term("t", "w").alias("x")).collect()] == [True, False, False]


def test_split_deferred(spark):
    got = one(spark, T.split_deferred("t"), f"zh {T.SENTENCE_MARK} mid {T.PARAGRAPH_MARK}\nthe tail")
    assert (got.body, got.deferred) == (f"zh {T.SENTENCE_MARK} mid {T.PARAGRAPH_MARK}", "the tail")
    assert tuple(one(spark, T.split_deferred("t"), " plain ")) == ("plain", "")


def test_repeated_paragraphs(spark):
    p = "word " * 20
    assert one(spark, T.repeated_paragraphs("t"), f"{p}\n\nother\n \n{p}") == [p.strip()]


def test_hyphens(spark):
    df = spark.createDataFrame([("a long trans-", "formation of"), ("the multi-", "modal one"), ("ends", "next"), ("Deep-", "Learning Basics")], "a string, b string")
    assert [r.x for r in df.select(T.hyphen_joiner("a", "b").alias("x")).collect()] == ["hyphen_elision", "hyphen_preserve", None, None]


def test_values(spark):
    df = spark.createDataFrame([("3.7", "是"), ("x", "maybe"), (None, "No"), ("nan", None)], "n string, b string")
    assert [(r.i, r.f, r.b) for r in df.select(V.as_int("n").alias("i"), V.as_float("n").alias("f"), V.review_bool("b").alias("b")).collect()] == [(3, 3.7, True), (0, 0.0, None), (0, 0.0, False), (0, 0.0, None)]
    assert [tuple(x) for x in one(spark, V.review_counts("t"), "a:b:2; c : x;d:3")] == [("a:b", 2), ("c", 0), ("d", 3)]
    assert spark.range(1).select(V.rate(F.lit(1), F.lit(0)).alias("x")).first().x == 0.0
    assert [tuple(r.x) for r in spark.createDataFrame([(429,), (401,), (500,), (404,), (None,)], "s int").select(V.http_error("s").alias("x")).collect()] == [("HTTP_RATE_LIMIT", True), ("HTTP_AUTH_ERROR", False), ("HTTP_SERVER_ERROR", True), ("HTTP_CLIENT_ERROR", False), ("HTTP_NETWORK_ERROR", True)]


# structure


def raw(spark, *items):
    return spark.createDataFrame([("d", 1, 800.0, i, BOX(40, y0, 520, y1), [{"text": t, "spans": [{"text": t, "x": 40.0, "size": size}]} for t in texts]) for i, (texts, y0, y1, size) in enumerate(items)], schemas.RAW_BLOCK)


def test_classify(spark):
    got = structure.classify_blocks(raw(
        spark,
        (["Model Acc F1 N", "A 91.2 88.1 120", "B 92.4 89.0 130"], 100, 180, 10.0),
        (["Table 2: Ablation results."], 200, 220, 10.0),
        (["1 Additional implementation details are available online."], 690, 700, 8.5),
        (["References"], 300, 320, 14.0),
        (["E = mc and more"], 300, 320, 11.0),
        (["2 Methods"], 330, 340, 11.0),
        (["A big title"], 340, 350, 16.0),
        (["Plain words that go on and on."], 350, 360, 11.0),
        (["page 3"], 790, 799, 9.0),
        ([""], 400, 410, 9.0),
    ))
    assert [r.type for r in got.orderBy("ord").collect()] == ["table", "caption", "footnote", "reference", "formula", "heading", "heading", "paragraph", "header_footer", "paragraph"]
    assert got.orderBy("ord").first().block_id == "p1-b0000"


def test_table_structure(spark):
    lines = [{"text": "Metric Acc", "spans": [{"text": "Metric", "x": 1.0, "size": 9.0}, {"text": "Acc", "x": 9.0, "size": 9.0}]}, {"text": "A 91.2", "spans": [{"text": "91.2", "x": 9.0, "size": 9.0}, {"text": "A", "x": 1.0, "size": 9.0}]}]
    df = spark.createDataFrame([("d", 1, 800.0, 0, BOX(0, 0, 1, 1), lines)], schemas.RAW_BLOCK)
    t = df.select(structure.table_structure(F.col("lines")).alias("t")).first().t
    assert (t.rows, t.header, t.numeric_tokens, t.row_count, t.column_count, t.confidence) == ([["Metric", "Acc"], ["A", "91.2"]], ["Metric", "Acc"], ["91.2"], 2, 2, "medium")


def blocks(spark, *items):
    return spark.createDataFrame([("d", f"p{p}-b{i:04d}", p, kind, text, BOX(0, 0, 1, 1), i, None, None) for p, i, kind, text in items], schemas.BLOCK)


def test_parents(spark):
    b = blocks(spark, (1, 0, "image", ""), (1, 1, "caption", "Figure 1: one"), (1, 2, "caption", "Table 1: two"), (1, 3, "table", "t"), (1, 4, "footnote", "1 a"), (1, 5, "paragraph", "p"), (1, 6, "footnote", "2 b"), (2, 0, "table", "t2"), (2, 1, "paragraph", "q"), (3, 0, "caption", "Table 2: after"), (5, 0, "caption", "Figure 9: alone"))
    got = {r.child_id: (r.parent_id, r.relation, r.page_gap, r.warning) for r in structure.assign_parents(b).collect()}
    assert got == {
        "p1-b0001": ("p1-b0000", "caption_for_figure", 0, None),
        "p1-b0002": ("p1-b0003", "caption_for_table", 0, None),
        "p1-b0004": ("p1-b0003", "footnote_for_table", 0, None),
        "p1-b0006": ("p1-b0005", "footnote_for_block", 0, None),
        "p3-b0000": ("p2-b0000", "caption_for_table", 1, None),
        "p5-b0000": (None, None, None, "orphan_caption"),
    }
    report = structure.structure_report(b, structure.assign_parents(b), structure.page_boundaries(b))
    assert ("relation", "orphan_caption", 1) in rows(report, "group", "key", "value")


def test_sections(spark):
    b = blocks(spark, (1, 0, "paragraph", "a"), (1, 1, "heading", "2 Methods"), (2, 0, "paragraph", "b"), (2, 1, "heading", "3 Results"), (2, 2, "paragraph", "c"))
    assert [r.section for r in structure.section_headings(b).orderBy("page_no", "ord").collect()] == [None, "2 Methods", "2 Methods", "3 Results", "3 Results"]


def test_boundaries(spark):
    b = blocks(spark, (1, 0, "paragraph", "The proposed method improves"), (2, 0, "paragraph", "accuracy under domain shift."), (3, 0, "table", "a"), (4, 0, "table", "b"), (5, 0, "paragraph", "as shown by Smith et al."), (6, 0, "paragraph", "(2020) and others."), (7, 0, "formula", "x ="), (8, 0, "formula", "y + 1"), (9, 0, "paragraph", "trans-"), (10, 0, "paragraph", "former nets."))
    got = {r.boundary_id: (r.severity, r.continuation_kind, r.joiner) for r in structure.page_boundaries(b).collect()}
    assert got == {
        "p1-p2": ("high", "paragraph_continuation", "space"),
        "p3-p4": ("high", "table_continuation", "preserve_table_rows"),
        "p5-p6": ("high", "academic_abbreviation_continuation", "space"),
        "p7-p8": ("high", "formula_continuation", "newline"),
        "p9-p10": ("high", "hyphenated_word_continuation", "hyphen_elision"),
    }
    preview = {r.boundary_id: r.merged_preview for r in structure.page_boundaries(b).collect()}
    assert preview["p9-p10"] == "transformer nets."


def test_boundaries_of_accented_words(spark):
    b = blocks(spark, (1, 0, "paragraph", "as shown by Smith et al."), (2, 0, "paragraph", "INÄTZ UND"), (3, 0, "paragraph", "Toé with three more"), (4, 0, "paragraph", "ASÓ MI"))
    got = lambda *end: {r.boundary_id: (r.severity, r.continuation_kind) for r in structure.page_boundaries(b, *end).collect()}
    assert got() == {"p3-p4": ("medium", "paragraph_continuation")}
    assert got(T.ASCII_WORD_END) == {"p1-p2": ("high", "academic_abbreviation_continuation"), "p3-p4": ("high", "paragraph_continuation")}


def test_boundary_predicates_against_loops(spark):
    """Random pairs of compact texts: each predicate, with and without compacting, against plain Python."""
    pick = random.Random(5)
    parts = ("Word", "word", "WORD", "a", "B2", "é", "Éa", "中文", "-", "–", "—", " ", " ", ".", ")", "!", ",", "et al.", "7", "_", "\u0301", "\u00b2", "𝒜")
    pairs = [(i, *(" ".join("".join(pick.choice(parts) for _ in range(pick.randint(0, 9))).split()) for _ in "ab")) for i in range(1500)]
    words = lambda t: re.findall("[A-Za-z0-9]+", t)
    titled = lambda w: (w.isupper() and True) or (w[0].isupper() and w[1:].islower()) or w in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def open_(t):
        t = t.rstrip("\"'”’）)]}」』")
        return bool(t) and t[-1] not in ".!?。！？" and (t[-1] in ",，;；:：-–—" or (len(re.findall("[A-Za-z0-9一-鿿]+", t)) >= 4 and t[-1].isalnum()))

    def title(a, b):
        a, b = words(re.sub("[-‐-―]$", "", a)), words(b)
        return 1 <= len(a) <= 2 and 1 <= len(b) <= 4 and all(map(titled, a + b))

    def joiner(a, b):
        prefix, fragment = re.search("([A-Za-z0-9]{2,})[-‐-―]$", a), re.match("[A-Za-z][A-Za-z0-9-]*", b)
        if not prefix or not fragment or title(a, b):
            return None
        prefix = prefix[1]
        return "hyphen_preserve" if len(re.findall("[A-Z]", prefix)) >= 2 or re.search("[0-9]", prefix) or "-" in fragment[0] or prefix.lower() in T.KEEPS_HYPHEN else "hyphen_elision"

    want = [(i, open_(a), title(a, b), joiner(a, b)) for i, a, b in pairs]
    assert all(len({w[k] for w in want}) > 1 for k in (1, 2, 3))
    df = spark.createDataFrame(pairs, "i int, a string, b string")
    for done in (False, True):
        got = df.select("i", T.ends_open("a", done=done).alias("o"), T.is_title_break("a", "b", done=done).alias("t"), T.hyphen_joiner("a", "b", done=done).alias("j")).orderBy("i").collect()
        assert [g for g in map(tuple, got) if g != want[g[0]]] == []


def test_reference_split(spark):
    p = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y"), ("a", 2, "References\n[1]"), ("b", 0, "References"), ("b", 1, "x"), ("b", 2, "x")], "doc_id string, page_no int, text string")
    assert rows(structure.reference_split(p), "doc_id", "reference_start", "main_pages", "tail_pages") == [("a", 2, [0, 1], [2]), ("b", None, [0, 1, 2], [])]
    assert rows(structure.reference_split(p, 0.15), "doc_id", "reference_start") == [("a", 2), ("b", 2)]


# chunks


def slow_windows(n, p, o):
    found, start = [], 0
    while start < n:
        found.append(list(range(start, min(start + p, n))))
        if start + p >= n:
            break
        start += p - o
    return found


@pytest.mark.parametrize("p,o", [(p, o) for p in (1, 2, 3) for o in range(p)])
def test_windows(spark, p, o):
    pages = spark.createDataFrame([(f"d{n}", i) for n in range(1, 12) for i in range(n)], "doc_id string, page_no int")
    got = {}
    for r in chunking.window_chunks(pages, p, o).collect():
        got.setdefault((r.doc_id, r.chunk), []).append(r.ord)
    assert {k: sorted(v) for k, v in got.items()} == {(f"d{n}", k): w for n in range(1, 12) for k, w in enumerate(slow_windows(n, p, o))}


def facts(spark, n):
    return spark.createDataFrame([("d", i, 1, 1, ["w"]) for i in range(1, n + 1)], "doc_id string, page_no int, link_count int, image_count int, warnings array<string>")


def test_structure_chunks(spark):
    b = blocks(spark, (1, 0, "table", "t"), (2, 0, "caption", "Table 1: x"), (3, 0, "paragraph", "Alone here."))
    e = structure.assign_parents(b)
    b = b.drop("parent_id", "relation").join(e.select("doc_id", F.col("child_id").alias("block_id"), "parent_id", "relation"), ["doc_id", "block_id"], "left")
    got = chunking.structure_chunks(b, facts(spark, 3), structure.page_boundaries(b), most_pages=1).orderBy("ord").collect()
    assert [(r.chunk_id, r.block_ids, r.relation_ids, r.split_reason) for r in got] == [("c0000", ["p1-b0000", "p2-b0000"], ["p1-b0000->p2-b0000:caption_for_table"], "page_limit"), ("c0001", ["p3-b0000"], [], "end_of_document")]
    assert got[0].block_types == {"table": 1, "caption": 1} and got[0].link_count == 2 and got[1].link_count == 1


def test_chunk_budget(spark):
    b = blocks(spark, (1, 0, "paragraph", "Alpha method " * 85), (2, 0, "paragraph", "A short page."))
    got = chunking.structure_chunks(b, facts(spark, 2), structure.page_boundaries(b).limit(0), target=1000, most=2000).orderBy("ord").collect()
    assert [r.split_reason for r in got] == ["target_chars", "end_of_document"] and got[0].budget_pressure == "over_target"


def test_boundary_status_and_strategies(spark):
    b = blocks(spark, (1, 0, "paragraph", "The proposed method improves"), (2, 0, "paragraph", "accuracy under domain shift."))
    found = structure.page_boundaries(b)
    by_block = chunking.structure_chunks(b, facts(spark, 2), found, most_pages=1)
    by_page = chunking.window_chunk_texts(spark.createDataFrame([("d", 1, "x", 0, 0), ("d", 2, "y", 0, 0)], "doc_id string, page_no int, text string, link_count int, image_count int"), 1, 0).withColumn("boundary_ids", F.array().cast("array<string>"))
    status = chunking.boundary_status(found, by_page).withColumn("strategy", F.lit("page")).unionByName(chunking.boundary_status(found, by_block).withColumn("strategy", F.lit("structure")))
    report = chunking.boundary_report(status, ["strategy"]).withColumn("ordinal", F.when(F.col("strategy") == "page", 0).otherwise(1))
    got = {r.strategy: (r.split_count, r.protected_count, r.split_rate, r.high_risk_split_count, r.split_reduction, r.is_best) for r in chunking.compare_strategies(report, "page").collect()}
    assert got == {"page": (1, 0, 1.0, 1, 0, False), "structure": (0, 1, 0.0, 0, 1, True)}


def test_prior_context(spark):
    c = spark.createDataFrame([("d", i, f"t{i}") for i in range(5)], "doc_id string, ord int, text string")
    assert [(r.previous, r.recent) for r in chunking.prior_context(c).orderBy("ord").collect()][-1] == ("t3", ["t1", "t2", "t3"])


# vision


def test_routing(spark):
    p = spark.createDataFrame([("d", 1, 600.0, 800.0, "abcdef", 0, 1, [], None, 0.01, 0.52), ("d", 2, 600.0, 800.0, "x" * 500, 0, 0, [], None, 0.5, 0.0), ("d", 3, 600.0, 800.0, "", 0, 0, [], None, 0.0, 0.0)], schemas.PAGE)
    got = {r.page_no: r for r in vision.route_pages(p, blocks(spark, (1, 0, "image", ""), (1, 1, "caption", "c"))).collect()}
    assert got[1].action == "local_ocr" and {"very_low_text", "image_caption_context"} <= set(got[1].reasons) and got[1].risk_level == "high"
    assert got[2].action == "text_only" and got[3].action == "skip_blank"
    tasks = vision.reading_tasks(vision.route_pages(p, blocks(spark, (1, 0, "image", ""))), vision.crops(blocks(spark, (1, 0, "image", ""))))
    assert rows(tasks, "task_id", "page_no", "scope", "priority") == [("t0001", 1, "region", "P0")]


def test_results(spark):
    tasks = spark.createDataFrame([("d", "t1", "pending_engine", 1, "p1-b0000"), ("d", "t2", "done", 1, None), ("d", "t3", "pending_engine", 9, None), ("d", "t4", "pending_engine", 1, None)], "doc_id string, task_id string, status string, page_no int, block_id string")
    results = spark.createDataFrame([("d", "t1", None, "hello", 0.9), ("d", "t1", "failed", "x", 0.9), ("d", "t1", "ok", " ", 0.9), ("d", "t1", "ok", "x", 0.2), ("d", "t2", "ok", "x", 0.9), ("d", "t3", "ok", "x", 0.9), ("d", "t9", "ok", "x", 0.9)], "doc_id string, task_id string, status string, text string, confidence double")
    pages = spark.createDataFrame([("d", 1)], "doc_id string, page_no int")
    got = vision.judge_results(results, tasks, blocks(spark, (1, 0, "image", "")), pages)
    assert sorted((r.reason or "") for r in got.collect()) == sorted(["", "result_not_succeeded", "empty_text", "low_confidence", "task_not_ready_for_writeback", "writeback_target_missing", "unknown_task"])
    assert rows(vision.pending_tasks(tasks, results), "task_id") == [("t4",)]
    chunks = spark.createDataFrame([("d", "c0", ["p1-b0000"], [1]), ("d", "c1", ["x"], [2])], "doc_id string, chunk_id string, block_ids array<string>, pages array<int>")
    assert rows(vision.map_to_chunks(tasks, chunks), "task_id", "mapped_by") == [("t1", "block_id"), ("t2", "page"), ("t3", "unmapped"), ("t4", "page")]


def test_upsert(spark):
    a = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3)], "ordinal long, task_id string, v int")
    b = spark.createDataFrame([(0, "a", 9), (1, "z", 8)], "ordinal long, task_id string, v int")
    assert [(r.task_id, r.v) for r in vision.upsert_results(a, b).orderBy("ordinal").collect()] == [("a", 9), ("b", 2), ("a", 3), ("z", 8)]


def test_assessment(spark):
    schema = "text string, confidence double, block_type string, target_text string, warnings array<string>, cells array<struct<row:int,column:int,text:string>>, expected_rows int, expected_columns int, locked_tokens array<string>, latex string, formula_tokens array<string>, equation_labels array<string>"
    df = spark.createDataFrame([
        ("a fine paragraph", 0.9, "paragraph", "", [], None, None, None, None, None, None, None),
        ("x", 0.9, "paragraph", "", [], None, None, None, None, None, None, None),
        ("a table 1 2", 0.9, "table", "", [], [(0, 0, "1"), (0, 1, "2")], 1, 2, ["1"], None, None, None),
        ("a table 1 2", 0.9, "table", "", [], None, 1, 2, ["1"], None, None, None),
        ("a table 1 2", 0.9, "table", "", [], [], 1, 2, ["1"], None, None, None),
        ("E = mc", 0.5, "formula", "", [], None, None, None, ["(1)"], "E=mc", ["E"], []),
    ], schema)
    got = vision.assess_candidates(df).collect()
    assert [(r.status, r.table_gate, r.formula_gate) for r in got] == [("candidate", "not_applicable", "not_applicable"), ("blocked", "not_applicable", "not_applicable"), ("candidate", "passed", "not_applicable"), ("needs_review", "needs_review", "not_applicable"), ("blocked", "blocked", "not_applicable"), ("needs_review", "not_applicable", "needs_review")]
    assert "needs_table_structure_review" in got[3].reasons and "structured_formula_missing_equation_labels" in got[5].reasons


# quality


def pairs(spark, *items):
    return spark.createDataFrame([("d", f"c{i}", s, t) for i, (s, t) in enumerate(items)], "doc_id string, chunk_id string, source string, target string")


def test_issues(spark):
    found = quality.issues(quality.invariants(pairs(spark, ("It is 42 by [1] in Table 2 with BERT", "它"), ("| a | b |\n| 1 | 2 |", "| a |\n| 1 |\n| 2 |"), ("x", None), ("fine", "好"))))
    got = {(r.chunk_id, r.issue_type): r.severity for r in found.collect()}
    assert got == {("c0", "missing_numbers"): "high", ("c0", "missing_references"): "high", ("c0", "missing_table_figure_tokens"): "medium", ("c0", "missing_entity_tokens"): "medium", ("c1", "table_shape_mismatch"): "high", ("c1", "high_english_residual"): "low", ("c2", "missing_translation"): "high"}
    plan = {r.issue_type: (r.priority, r.action) for r in quality.repair_plan(found).collect()}
    assert plan["missing_translation"] == ("P0", "translate_missing_chunk") and plan["missing_entity_tokens"][0] == "P1"
    assert quality.issue_report(found).where("by = 3").first().issues == 7


def test_glossary_issues(spark):
    g = spark.createDataFrame([("Neural net", "神经网络", "confirmed"), ("loss", "损失", "rejected"), ("bias", "偏差", None)], "en string, zh string, status string")
    c = spark.createDataFrame([("bias",)], "en string")
    found = quality.glossary_issues(pairs(spark, ("a NEURAL NET with bias and loss", "网络"), ("a neural net", "神经网络")), g, c)
    assert rows(found, "chunk_id", "issue_type", "tokens") == [("c0", "glossary_translation_conflict", ["bias"]), ("c0", "missing_glossary_terms", ["neural net"])]


def test_repairs(spark):
    r = spark.createDataFrame([("d", "c0", "rq1", "has 42", ["42"], []), ("d", "c0", "rq2", "has 42", ["42"], []), ("d", "c1", "rq3", "none", ["42"], []), ("d", "c2", "rq4", "text", [], [])], "doc_id string, chunk_id string, request_id string, candidate string, locked_tokens array<string>, shapes array<struct<row_count:int,column_count:int>>")
    merged = quality.merge_repairs(quality.validate_repairs(r))
    assert rows(merged, "request_id", "merged", "validation") == [("rq1", True, "passed"), ("rq2", False, "passed"), ("rq3", False, "failed"), ("rq4", False, "unchecked")]
    d = spark.createDataFrame([("d", "rq3", 1, "reject"), ("d", "rq3", 2, "approve")], "doc_id string, request_id string, ordinal int, decision string")
    patches = quality.review_patches(merged, d)
    assert rows(patches, "request_id", "effective") == [("rq1", "approve"), ("rq2", "needs_review"), ("rq3", "approve"), ("rq4", "needs_review")]
    assert quality.publish_gate(patches).first().status == "blocked"


def test_effectiveness(spark):
    schema = "chunk_id string, issue_type string"
    a = spark.createDataFrame([("c0", "x"), ("c0", "x"), ("c1", "y")], schema)
    b = spark.createDataFrame([("c0", "x"), ("c2", "z")], schema)
    kinds = quality.effectiveness(a, b, ["issue_type"])
    assert rows(kinds, "issue_type", "before_count", "after_count", "status") == [("x", 2, 1, "improved"), ("y", 1, 0, "resolved"), ("z", 0, 1, "regressed")]
    assert quality.overall_effect(kinds, quality.effectiveness(a, b, ["chunk_id"])).first().verdict == "improved_with_regressions"
    # fewer issues in all, of no new kind, but more of them in one chunk
    a = spark.createDataFrame([("c0", "x")] * 5 + [("c1", "x")], schema)
    b = spark.createDataFrame([("c1", "x")] * 3, schema)
    worse = quality.overall_effect(quality.effectiveness(a, b, ["issue_type"]), quality.effectiveness(a, b, ["chunk_id"])).first()
    assert (worse.regressed_chunks, worse.new_issues, worse.verdict) == (1, 0, "improved_with_regressions")


def test_cell_and_relation_issues(spark):
    schema = "doc_id string, chunk_id string, table_index int, row_index int, column_index int, text string"
    c = spark.createDataFrame([("d", "c0", 0, 0, 0, "42"), ("d", "c0", 0, 1, 0, "7"), ("d", "c0", 1, 0, 0, "1")], schema).withColumn("locked_tokens", F.array("text"))
    t = spark.createDataFrame([("d", "c0", 0, 0, 0, "有 42")], schema)
    assert rows(quality.cell_issues(c, t), "row_index", "missing") == [(1, ["7"])]
    rel = spark.createDataFrame([("d", "a", "b", "caption_for_table", ["Table 1"])], "doc_id string, child_id string, parent_id string, relation string, anchors array<string>")
    ch = spark.createDataFrame([("d", "c0", "表", ["a", "b"]), ("d", "c1", "Table 1", ["b"])], "doc_id string, chunk_id string, target string, block_ids array<string>")
    assert rows(quality.relation_issues(rel, ch), "chunk_id", "missing") == [("c0", ["Table 1"])]


# tables


TABLE = "doc_id string, table_id string, page_no int, rows array<array<string>>, column_count int, row_count int, header array<string>, warnings array<string>"


def test_chains(spark):
    t = spark.createDataFrame([("d", "t1", 1, [["M", "Acc"], ["A", "1"], ["B", "2"]], 2, 3, ["M", "Acc"], []), ("d", "t2", 2, [["M", "Acc"], ["C", "3"], ["D", "4"]], 2, 3, ["M", "Acc"], []), ("d", "t3", 3, [["x", "y", "z", "w"], ["1", "2", "3", "4"]], 4, 2, ["x", "y", "z", "w"], []), ("d", "t4", 4, [["x", "y"], ["1", "2"]], 2, 2, ["x", "y"], [])], TABLE)
    links = spark.createDataFrame([("d", "t1", "t2"), ("d", "t3", "t4")], "doc_id string, previous_id string, next_id string")
    got = {r.chain: r for r in tables.merge_chains(tables.chains(t, links), t).collect()}
    assert (got["t1"].merge_status, got["t1"].chain_confidence, len(got["t1"].rows), got["t1"].skipped_headers) == ("merged", "high", 5, 1)
    assert got["t3"].merge_status == "rejected" and "column_count_drift" in got["t3"].reject_reasons and got["t3"].rows is None


def test_a_long_chain_and_a_ring(spark):
    links = [("d", f"t{i:04d}", f"t{i + 1:04d}") for i in range(500)] + [("e", "a", "b"), ("e", "b", "a")]
    t = spark.createDataFrame([(d, x) for d, x in {(d, x) for d, *xs in links for x in xs}], "doc_id string, table_id string")
    got = tables.chains(t, spark.createDataFrame(links, "doc_id string, previous_id string, next_id string")).orderBy("place").collect()
    assert [(r.doc_id, r.chain, r.table_id, r.place) for r in got] == [("d", "t0000", f"t{i:04d}", i) for i in range(501)]


def test_texts_with_terms_by_either_way(spark):
    texts = ["a neural net", "abc", "", None, "ab", "the nets net it", "日本の網"]
    terms = ["net", "neural", "abc", "a", "", "ab", "網", "neural net", "nets net", "zzz"]
    left = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    right = spark.createDataFrame([(x,) for x in terms], "term string")
    want = sorted((i, x) for i, t in enumerate(texts) for x in terms if t and x and x in t)
    for most in (100, 0):
        assert rows(matching.texts_with(left, right, "text", "term", most), "i", "term") == want


def test_repeated_paragraphs_of_a_long_document(spark):
    lines_ = [f"line number {i % 15_000} of a long document" for i in range(20_000)]
    df = spark.createDataFrame([("\n".join(lines_),), ("once in a text here\n  once  in a text here",), (None,)], "text string")
    got = [r[0] for r in df.select(T.repeated_paragraphs("text", least=10, parted="\n")).collect()]
    assert got == [lines_[:5000], ["once in a text here"], []]


def test_spans(spark):
    t = spark.createDataFrame([("d", "t1", 1, [["Group"], ["a", "", "c"], ["b", "x", ""], ["", "y", "z"]], 3, 4, [], [])], TABLE)
    found = tables.span_candidates(t)
    assert rows(found, "span_type", "row_index", "column_index", "reason") == [("colspan", 0, 0, "single_cell_ragged_row"), ("colspan", 1, 0, "empty_cell_right_of_nonempty_anchor"), ("colspan", 2, 1, "empty_cell_right_of_nonempty_anchor"), ("rowspan", 1, 2, "empty_cell_below_nonempty_anchor"), ("rowspan", 2, 0, "empty_cell_below_nonempty_anchor")]
    cells = tables.cells(t)
    assert cells.count() == 10
    patched = tables.apply_patches(cells, tables.widest_spans(found).withColumn("ordinal", F.lit(1)))
    assert patched.where("covered").count() == 3
    assert tables.table_report(cells, found).first().empty_cells == 3


def test_footnotes(spark):
    cells = tables.cells(spark.createDataFrame([("d", "t1", 1, [["Model", "12 ms"], ["A [1]", "p < 0.05"], ["B*", "10"]], 2, 3, ["Model", "12 ms"], [])], TABLE))
    assert rows(cells.where("row_index = 0 AND column_index = 1"), "role", "units") == [("header", ["ms"])]
    notes = spark.createDataFrame([("d", "t1", "n1", "1) trained twice"), ("d", "t1", "n2", "* best")], "doc_id string, table_id string, note_id string, text string")
    bound = tables.bind_footnotes(notes, cells)
    assert rows(bound, "note_id", "row_index", "column_index") == [("n1", 1, 0), ("n2", 2, 0)]
    target = spark.createDataFrame([("d", "t1", 1, 0, "A [1]"), ("d", "t1", 2, 0, "B")], "doc_id string, table_id string, row_index int, column_index int, text string")
    assert rows(tables.footnote_binding_issues(bound, target), "note_id") == [("n2",)]


# memory


def test_glossary(spark):
    have = spark.createDataFrame([(0, "Net", "网", 1, "s", "confirmed")], "ordinal long, en string, zh string, first_page int, source string, status string")
    new = spark.createDataFrame([(0, "net", "网络", 2, "survey", None), (1, "Loss", "损失", 2, "survey", None), (2, "cost", "损失", 3, "survey", None), (3, "loss", "损失", 3, "survey", None), (4, "", "x", 1, "s", None)], "ordinal long, en string, zh string, first_page int, source string, status string")
    kept, pending = memory.merge_arrivals(have, new)
    assert rows(kept, "en", "zh") == [("Loss", "损失"), ("Net", "网"), ("cost", "损失")]
    assert rows(pending, "type", "en", "candidate_zh", "existing") == [("glossary_conflict", "net", "网络", ["网"]), ("shared_translation_review", "cost", "损失", ["Loss"])]
    assert rows(memory.conflicting_terms(kept, pending), "en", "translations") == [("net", ["网", "网络"])]
    d = spark.createDataFrame([(1, "NET", "网")], "ordinal long, en string, zh string")
    assert rows(memory.confirm_terms(kept, d).where("en = 'Net'"), "status") == [("confirmed",)]


def test_terms_for_pages(spark):
    g = spark.createDataFrame([(i, f"e{i}", "z", p, "s", st, None, None) for i, (p, st) in enumerate([(1, None), (9, None), (None, None), (2, "rejected"), (2, None)])], schemas.GLOSSARY)
    c = spark.createDataFrame([("d", "c0", 1, 3)], "doc_id string, chunk_id string, first int, last int")
    picked = memory.terms_for_pages(g, c)
    assert [r.en for r in picked.orderBy("rank").collect()] == ["e0", "e4", "e2"]
    assert [r.en for r in memory.terms_for_pages(g, c, 1).collect()] == ["e0"]
    assert memory.term_snippets(picked).first().snippet == "- e0 → z\n- e4 → z\n- e2 → z"


def test_scopes(spark):
    df = spark.createDataFrame([(None, ["x"], [], []), ("section: Methods", ["2 methods"], [], []), ("structure:公式", [], ["formula"], []), ("block:p1-b1", [], [], ["p2-b1"]), ("type:table", ["a"], [], [])], "s string, a array<string>, b array<string>, c array<string>")
    assert [r.x for r in df.select(memory.scope_matches(F.col("s"), F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()] == [True, True, True, False, True]


def test_stale_chunks(spark):
    t = spark.createDataFrame([("neural net", "神经网络", ["神网"], None)], "en string, zh string, rejected_zh array<string>, section_scope string")
    c = spark.createDataFrame([("d", "c0", "a neural net", "神网", [], [], []), ("d", "c1", "a neural net", "神经网络", [], [], []), ("d", "c2", "a neural  net", None, [], [], []), ("d", "c3", "neural nets", "x", [], [], [])], "doc_id string, chunk_id string, source string, target string, sections array<string>, types array<string>, block_ids array<string>")
    assert rows(memory.stale_chunks(t, c), "chunk_id", "reasons") == [("c0", ["rejected_translation_present"]), ("c2", ["missing_translation"])]


def test_translate_in_order(spark):
    c = spark.createDataFrame([("d", i, f"t{i}") for i in range(3)] + [("e", 0, "u")], "doc_id string, ord int, text string")
    got = memory.translate_in_order(c, lambda text, carried: (f"{carried}{text.upper()}", text[-1]))
    assert rows(got, "doc_id", "ord", "target", "deferred") == [("d", 0, "T0", "0"), ("d", 1, "0T1", "1"), ("d", 2, "1T2", "2"), ("e", 0, "U", "u")]


# metrics, experiments


def test_run_metrics_and_cost(spark):
    retry = [("retryable_error", True, "HTTP_TIMEOUT", "http"), ("success", False, None, None)]
    base = lambda **k: tuple({"run_id": "r", **k}.get(f) for f in spark.createDataFrame([], schemas.RUN_EVENT).columns)
    log = spark.createDataFrame([base(event_type="stage", phase="extract", elapsed_ms=10), base(event_type="stage_error", phase="extract", elapsed_ms=5), base(event_type="chunk_translation", translator="echo", elapsed_ms=50, source_char_count=80, context_char_count=40, request_char_count=120, translated_char_count=64, estimated_request_token_count=30, estimated_translated_token_count=16, http_retry_events=retry), base(event_type="chunk_skipped", reason="done")], schemas.RUN_EVENT)
    m = metrics.run_metrics(log, ["run_id"]).first()
    assert (m.source_tokens, m.total_tokens, m.http_attempts, m.http_retries, m.http_failed, m.skipped, m.chars_per_second) == (20, 46, 2, 1, 1, 1, 2400.0)
    assert rows(metrics.stage_metrics(log, ["run_id"]), "phase", "elapsed_ms", "stages", "failed") == [("extract", 15, 2, 1)]
    usage = spark.createDataFrame([("openai", "m", 250, 150, 0, 0, 1, 2), ("none", "", 1, 1, 0, 0, 1, 0)], "backend string, model string, request_tokens long, translated_tokens long, request_chars long, translated_chars long, requests long, http_attempts long")
    prices = readers.prices(spark, {"backends": {"openai": {"input_per_1m_tokens": 9}, "OpenAI:m": {"input_per_1m_tokens": 1.0, "output_per_1m_tokens": 2.0, "per_request": 0.01}}})
    got = {r.backend: r for r in metrics.estimate_cost(usage, prices).collect()}
    assert got["openai"].profile_key == "openai:m" and abs(got["openai"].total_cost - 0.02055) < 1e-12
    assert not got["none"].configured and got["none"].total_cost == 0


def test_samples(spark):
    p = spark.createDataFrame([("t", 1, "Table 1 and Table 2\n1 2 3\nlong text " + "x" * 90, 0, 0, 0), ("s", 1, "", 1, 0, 0), ("n", 1, "plain words " * 20, 0, 0, 0), ("a", 1, "Corresponding author and e-mail of the affiliations " + "y" * 90, 0, 0, 0), ("m", 1, "z" * 100, 0, 2, 2)], "doc_id string, page_no int, text string, image_count int, left_blocks int, right_blocks int")
    tagged = experiments.sample_tags(experiments.sample_metrics(p))
    assert rows(tagged, "doc_id", "type") == [("a", "annotation-entity-heavy"), ("m", "multi-column"), ("n", "normal"), ("s", "scanned"), ("t", "table-heavy")]
    cover = {r.category: (r["count"], r.missing, r.status) for r in experiments.coverage(tagged).collect()}
    assert cover["normal"] == (1, 9, "missing") and cover["formula-heavy"] == (0, 5, "missing")


def test_experiments(spark):
    rec = spark.createDataFrame([("s1", "a", "succeeded", {"q": {"x": 1.0}}), ("s1", "b", "succeeded", {"q": {"x": 3.0}}), ("s2", "a", "failed", None), ("s2", "b", "succeeded", {})], "sample_id string, variant string, status string, metrics map<string,map<string,double>>")
    long = experiments.unpivot_metrics(rec, [("q", "x")])
    assert rows(experiments.variant_means(long), "variant", "mean") == [("a", 1.0), ("b", 1.5)]
    assert rows(experiments.baseline_deltas(long, "a"), "sample_id", "variant", "delta") == [("s1", "b", 2.0)]
    assert rows(experiments.variant_runs(rec), "variant", "runs", "failed") == [("a", 2, 1), ("b", 2, 0)]
    assert experiments.plan_runs(rec.select("sample_id").distinct(), rec.select("variant").distinct()).count() == 4
    rv = spark.createDataFrame([("a", "4", "是", "k:2;j:1"), ("a", "x", "no", "k:1"), ("", "2", "", None)], "v string, s string, d string, c string")
    got = {(r.group, r.measure, r.key): r.value for r in experiments.review_groups(rv, "v", ["s"], ["d"], ["c"]).collect()}
    assert got == {("a", "s", "mean"): 4.0, ("a", "s", "count"): 1.0, ("unknown", "s", "mean"): 2.0, ("unknown", "s", "count"): 1.0, ("a", "d", "yes"): 1.0, ("a", "d", "no"): 1.0, ("unknown", "d", "yes"): 0.0, ("unknown", "d", "no"): 0.0, ("a", "c", "k"): 3.0, ("a", "c", "j"): 1.0}


def test_metadata_and_reviews(spark):
    m = spark.createDataFrame([("paper", "1", 0), ("other", "2", 1)], "key string, note string, ordinal int")
    s = spark.createDataFrame([("s1", "/x/Paper.pdf", 1), ("s2", "/x/none.pdf", 1)], "sample_id string, path string, ordinal int")
    assert {r.sample_id: r.metadata.note for r in experiments.match_metadata(s, m).collect()} == {"s1": "1", "s2": "2"}
    runs = spark.createDataFrame([("s1", "a", "r1", 0), ("s1", "a", "r2", 1)], "sample_id string, variant string, run_id string, ordinal int")
    rv = spark.createDataFrame([("s1", "a", "r1"), ("s1", "a", "zz")], "sample_id string, variant string, run_id string")
    assert sorted(r.run.run_id for r in experiments.join_reviews(rv, runs).collect()) == ["r1", "r2"]


# jobs


def test_jobs(spark):
    j = spark.createDataFrame([("j1", 1, "2024-01-01"), ("j2", 1, "2024-01-03"), ("j3", 2, "bad")], "job_id string, user_id int, created_at string")
    f = spark.createDataFrame([(1, "j1", "2024-02-01")], "user_id int, job_id string, favorited_at string")
    assert [r.job_id for r in jobs.favorites(j, f, 1).collect()] == ["j1"] and [r.job_id for r in jobs.not_favorites(j, f, 1).collect()] == ["j2"]
    assert rows(jobs.stale_jobs(j, f, F.lit("2024-01-05").cast("timestamp")), "job_id") == [("j2",)]
    assert rows(jobs.drift(j, spark.createDataFrame([("j1",), ("j9",)], "job_id string")), "job_id", "drift") == [("j2", "missing_on_disk"), ("j3", "missing_on_disk"), ("j9", "missing_in_index")]


def test_progress(spark):
    j = spark.createDataFrame([("a", "done", False, "valid"), ("b", "running", True, "valid"), ("c", "done", False, "valid"), ("d", "queued", False, "missing")], "job_id string, status string, recovered boolean, state_file string")
    ch = spark.createDataFrame([(k, f"c{i}") for k in "abc" for i in range(2)], "job_id string, chunk_id string")
    done = spark.createDataFrame([("a", "c0"), ("a", "c1"), ("b", "c0")], "job_id string, chunk_id string")
    got = {r.job_id: (r.state, r.recovery, r.warnings) for r in jobs.progress(j, ch, done).collect()}
    assert got == {"a": ("complete", "complete", []), "b": ("partial", "needs_manual_resume_or_cancel", ["recovered_active_without_worker"]), "c": ("empty", "not_started", ["runtime_done_pipeline_incomplete"]), "d": ("missing", "not_ready", [])}


def test_requeue_and_audit(spark):
    j = spark.createDataFrame([("running", True, True, False, False, "echo", 3, 1), ("running", True, False, False, False, "", 4, 4), ("done", False, True, False, False, "echo", 3, 1)], "status string, recovered boolean, input_present boolean, cancel_requested boolean, custom_api boolean, backend string, pages_per_chunk int, overlap_pages int")
    assert [(r.action, len(r.blockers)) for r in jobs.requeue(j).collect()] == [("requeueable", 0), ("manual_required", 4), ("not_applicable", 2)]
    e = spark.createDataFrame([(1, "2024", "bob", "job_submit", '{"filename":"a.pdf"}', None), (2, "2025", None, "login_success", "{}", None)], "id int, created_at string, username string, action string, detail_json string, job_id string")
    assert [r.summary for r in jobs.audit_page(e, 1).collect()] == ["someone logged in"] and [r.summary for r in jobs.audit_page(e, 5, 1).collect()] == ["bob submitted a.pdf"]


# translators, sources, sinks


def test_translate(spark):
    c = spark.createDataFrame([("d", "c0", "fine"), ("d", "c1", "flaky")], "doc_id string, chunk_id string, text string")

    def backend():
        seen = []

        def call(text):
            seen.append(text)
            if text == "flaky":
                raise translate.RetryableError("HTTP_TIMEOUT")
            return text.upper()

        return call

    got = {r.chunk_id: r for r in translate.translate(c, backend, attempts=1).collect()}
    assert got["c0"].target == "FINE" and got["c1"].target is None and got["c1"].http_retry_events[0].status == "retryable_error"
    waited = []
    tries = iter([translate.RetryableError("x"), translate.RetryableError("y"), None])

    def third(text):
        e = next(tries)
        if e:
            raise e
        return "ok"

    assert translate.with_retries(third, "t", 4, waited.append)[0] == "ok" and len(waited) == 2
    assert one(spark, translate.echo("t"), "a\nb") == "[ECHO 未翻译预览] a b..."
    assert [r.resolved_backend for r in translate.resolve_backend(spark.createDataFrame([("DRY",), ("zz",)], "backend string")).orderBy("backend").collect()] == ["echo", None]
    assert spark.range(1).select(translate.prompt(("H", F.lit("x")), ("I", F.lit(" "))).alias("x")).first().x == "H\nx"


def test_sources(spark, tmp_path):
    html = "<h1>Title</h1><p>One <b>two</b></p><a href='u1'>x</a><A HREF=\"u2\">y</A><img src=z><ul><li>it</li></ul>"
    p = spark.createDataFrame([(1, html)], "page_id int, html string")
    assert rows(readers.page_links(p), "link_count", "image_count", "links") == [(2, 1, ["u1", "u2"])]
    assert rows(readers.html_blocks(p), "ord", "type", "text") == [(0, "heading", "Title"), (1, "paragraph", "One two"), (2, "paragraph", "it")]
    (tmp_path / "r.csv").write_text("﻿sample_id,score\ns1,4\n", encoding="utf-8")
    assert rows(readers.metadata(spark, str(tmp_path / "r.csv")), "sample_id", "score") == [("s1", "4")]
    (tmp_path / "m.json").write_text('{"samples": [{"sample_id": "s1"}]}')
    assert rows(readers.metadata(spark, str(tmp_path / "m.json")), "sample_id") == [("s1",)]
    (tmp_path / "d.json").write_text('{"doc_id": "d", "pages": [{"page_no": 1, "blocks": [{"block_id": "b", "type": "paragraph", "text": "x", "bbox": [1, 2, 3], "order": 0, "meta": {"k": 1}}]}]}')
    got = readers.document_json(spark, str(tmp_path / "d.json")).first()
    assert (got.block_id, got.bbox.x1, got.bbox.y1, got.meta_json) == ("b", 3.0, 0.0, '{"k": 1}')
    for name, body in (("j1", '{"job_id": "j1", "status": "done"}'), ("j2", '{"job_id": "zz"}'), ("j3", "{broken"), ("j4", "{}")):
        (tmp_path / "jobs" / name).mkdir(parents=True)
        (tmp_path / "jobs" / name / "web_status.json").write_text(body)
    assert tuple(readers.hydrate_counts(readers.job_states(spark, str(tmp_path / "jobs"))).first()) == (4, 1, 1, 1)
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"none")
    assert sorted((r.path[-5:], r.is_pdf) for r in readers.files(spark, str(tmp_path)).collect()) == [("a.pdf", True), ("b.pdf", False)]


def test_sinks(spark, tmp_path):
    c = spark.createDataFrame([("d", 1, "second"), ("d", 0, f"---\na: 1\n---\nfirst {T.SENTENCE_MARK}")], "doc_id string, ord int, target string")
    assert writers.merged_documents(c).first().text == "first \n\nsecond\n"
    f = spark.createDataFrame([("a.txt", False), ("../b", False), ("/c", False), ("l", True)], "path string, is_link boolean")
    n = spark.createDataFrame([("a.txt", "A.txt")], "path string, name string")
    assert rows(writers.bundle_names(f, n), "path", "name") == [("a.txt", "A.txt")]
    writers.write_sheet(c.withColumn("x", F.array("doc_id")), f"file://{tmp_path}/s")
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/s").count() == 2
    assert writers.markdown_lines(c, ["doc_id", "ord"]).count() == 4


def test_stream(spark, tmp_path):
    from foliant.streaming import run_log

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"ts":"2024-01-01T00:00:00Z","phase":"x","event_type":"stage","elapsed_ms":5,"id":1}\n{"ts":"2024-01-01T00:01:00Z","phase":"x","event_type":"stage_error","elapsed_ms":7,"id":2}\n{"ts":"2024-01-01T00:01:00Z","phase":"x","event_type":"stage_error","elapsed_ms":7,"id":2}\n{"ts":"2024-01-01T02:00:00Z","phase":"x","event_type":"stage","elapsed_ms":1,"id":3}\n')
    s = run_log.once_per_event(run_log.events(spark, str(tmp_path / "in"), "ts timestamp, phase string, event_type string, elapsed_ms long, id long"), "id")
    q = s.groupBy("phase").agg(F.count("*").alias("n"), F.sum("elapsed_ms").alias("ms")).writeStream.outputMode("complete").format("memory").queryName("dedup").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("dedup"), "phase", "n", "ms") == [("x", 3, 13)]
    w = run_log.stage_windows(run_log.events(spark, str(tmp_path / "in"), "ts timestamp, phase string, event_type string, elapsed_ms long, id long")).writeStream.outputMode("append").format("memory").queryName("windows").start()
    w.processAllAvailable()
    w.stop()
    assert rows(spark.table("windows"), "phase", "events", "failed", "elapsed_ms") == [("x", 3, 2, 19)]

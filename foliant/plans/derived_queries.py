"""Queries that give operators rows derived from the driver's tables: texts with citations, formulas, tables and markers set in, and tables, boxes and repairs made of the relational ones.

Patterns with Unicode word classes read texts whose other letters are an `x`, as the SQL engine has ASCII word classes only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import values as V
from foliant.operators import chunking, quality, tables


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _probe() -> Column:
    """A whole text in ASCII, with tokens that depend on doc_id behind it."""
    part = lambda x: x if isinstance(x, Column) else F.lit(x)
    n = lambda m, plus=0: (F.pmod("doc_id", F.lit(m)) + plus).cast("string")
    pieces = (F.regexp_replace("text", r"[^\x00-\x7F]", "x"), "\nTable ", n(12), " and Fig. ", n(5), "a [", n(30), ", ", n(4), "] by (Smith et al., ", n(30, 1990), ") with p < 0.0", n(9), " and x_{", n(3), "} gave F1-score ", n(100), ".5% in ( ", n(7), " ) of table ", n(12), "; Turing, ", n(9, 1950), " at Lund University and BERT, GPT-", n(5), ", NLP-", n(3), " on URL.")
    return F.concat(*(part(x) for x in pieces))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", _probe().alias("body"))


def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.explode(T.numbers("body")).alias("token"))


def reference_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.explode(T.references("body")).alias("token"))


def table_figure_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.explode(T.table_figure_tokens("body")).alias("t")).select("doc_id", "t.kind", "t.num")


def formula_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.explode(T.formula_tokens("body")).alias("t")).select("doc_id", "t.kind", F.when(F.col("t.kind").isin("metric", "statistic"), F.lower("t.token")).otherwise(F.col("t.token")).alias("token"))


def locked_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.size(T.locked_tokens("body")).cast("long").alias("n"), F.element_at(T.locked_tokens("body"), 1).alias("first"))


def entity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", F.explode(T.entities("body")).alias("e")).select("doc_id", "e.type", F.lower("e.text").alias("name"))


def useful_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", T.useful_ratio("body").alias("ratio"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines behind the beginnings of captions, and of some that are none, by what they caption."""
    begin = F.element_at(F.array(*(F.lit(x) for x in ("Table 3. ", "  Fig. 2: ", "Tables 4. ", "图 四、", "FIGURE IV ", "表 7：", "See Table 3. "))), (F.pmod("ord", F.lit(7)) + 1).cast("int"))
    kind = F.coalesce(T.caption_kind(F.concat(begin, "line")), F.lit("none"))
    return _lines(spark, sf_dir).select("doc_id", kind.alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


def without_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of texts with lines of dots set in, once without those that are long enough to be leaders."""
    dots = F.concat(F.lit("\n"), F.repeat(F.lit(". "), F.pmod("doc_id", F.lit(20)).cast("int") + 1), F.lit("\n"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(T.without_dot_leaders(F.concat("text", dots, "text"))).cast("long").alias("n"))


def without_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.pmod("doc_id", F.lit(3)) == 0, "---\ntitle: x\n---\n\n").when(F.pmod("doc_id", F.lit(3)) == 1, "--- \n---\n").otherwise("--\nno\n--\n")
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(T.without_front_matter(F.concat(head, F.lit("b"), "text", F.lit("e")))).cast("long").alias("n"))


def deferred_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before and behind the last marker of a text between two."""
    split = T.split_deferred(F.concat(F.lit("a"), F.lit(T.PARAGRAPH_MARK), F.lit("b"), "text", F.when(F.pmod("doc_id", F.lit(2)) == 0, T.SENTENCE_MARK).otherwise(""), F.lit(" rest")))
    resolved = T.resolve_markers(F.concat(F.lit("a"), F.lit(T.PARAGRAPH_MARK), F.lit("b"), F.lit(T.SENTENCE_MARK), F.lit("c")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(split["body"]).cast("long").alias("body"), split["deferred"].alias("deferred"), resolved.alias("resolved"))


def drawn_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of tables drawn with bars behind each text."""
    wide = F.pmod("doc_id", F.lit(3)).cast("int") + 1
    row = lambda x: F.concat(F.lit("|"), F.repeat(F.lit(f" {x} |"), wide), F.lit("\n"))
    drawn = F.concat(F.replace("text", F.lit("|"), F.lit("x")), F.lit("\n\n"), row("a"), row("---"), F.repeat(row("7"), F.pmod("doc_id", F.lit(4)).cast("int")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode(T.table_shapes(drawn)).alias("s")).select("doc_id", "s.row_count", "s.column_count")


def held_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that hold a line's first word as a whole, and a term that is none."""
    first = F.regexp_extract("text", "^([A-Za-z]+)", 1)
    turns = _table(spark, sf_dir, "conversations").where(first != "").select("conv_id", "turn", "text", first.alias("word"))
    shorter = F.substring(F.col("word"), F.lit(1), F.length("word") - 1)
    return turns.select("conv_id", "turn", T.holds_term("text", F.upper("word")).alias("whole"), T.holds_term("text", shorter).alias("cut"))


def box_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = lambda x, y, w, h: F.struct(x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + w).cast("double").alias("x1"), (y + h).cast("double").alias("y1"))
    m = lambda k: F.pmod("p_partkey", F.lit(k))
    a, b = box(m(7), m(11), m(5), F.col("p_size")), box(m(13), m(3), F.col("p_size"), m(17))
    return _table(spark, sf_dir, "part").select("p_partkey", V.box_area(a).alias("area"), V.box_overlap(a, b).alias("overlap"), V.box_area(V.box_union(a, b)).alias("union_area"), V.box_coverage(a, b).alias("coverage"))


def read_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How people write yes, no, numbers and lists."""
    words = F.array(*(F.lit(x) for x in (" Yes", "是", "PASS", "0", "否", "maybe", "", "未发布", "1", "n")))
    word = F.element_at(words, (F.pmod("c_custkey", F.lit(10)) + 1).cast("int"))
    n = F.col("c_custkey").cast("string")
    counts = V.review_counts(F.concat(F.lit("a:b:"), n, F.lit("; c: 2.9;bad; d:x")))
    return _table(spark, sf_dir, "customer").select("c_custkey", V.review_bool(word).alias("answer"), V.included(word).alias("included"), F.array_join(V.tags(F.concat(F.lit(" x ,"), n, F.lit("；|z "))), "/").alias("tags"), F.array_join(F.transform(counts, lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), "/").alias("counts"), V.as_int(F.concat(n, F.lit(".7"))).alias("whole"), V.as_float(F.concat(F.lit("x"), n)).alias("wrong"))


def http_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = V.http_error((F.pmod("event_id", F.lit(330)) + 200).cast("int"))
    return _table(spark, sf_dir, "events").select(error["code"].alias("code"), error["retryable"].alias("retryable")).groupBy("code", "retryable").agg(F.count("*").alias("n"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and translations that lose the digit 7, every fifth of them whole."""
    target = F.when(F.pmod("doc_id", F.lit(5)) > 0, F.replace("body", F.lit("7"), F.lit("~")))
    return _texts(spark, sf_dir).select("doc_id", F.lit("c0").alias("chunk_id"), F.col("body").alias("source"), target.alias("target"))


def lost_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.issues(quality.invariants(_pairs(spark, sf_dir)))
    return found.where(F.col("issue_type").isin("missing_numbers", "missing_references", "missing_translation")).select("doc_id", "issue_type", "severity", F.size("tokens").cast("long").alias("n"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each customer of four columns and 1 to 5 rows; some cells are empty, some have marks."""
    k = F.col("c_custkey")
    cell = lambda r, c: F.when(F.pmod(k + r * 7 + c * 3, F.lit(4)) == 0, "").when(F.pmod(k + r + c, F.lit(5)) == 0, F.concat(F.lit("v "), (k + r).cast("string"), F.lit(" [2]"))).otherwise(F.concat(F.lit("v "), (k + r).cast("string"), F.lit(".5 ms")))
    rows = F.transform(F.sequence(F.lit(0), F.pmod(k, F.lit(5)).cast("int")), lambda r: F.array(*(cell(r, c) for c in range(4))))
    header = F.when(F.pmod(k, F.lit(2)) == 0, F.array(*(F.lit(x) for x in "ABCD"))).otherwise(F.array().cast("array<string>"))
    return _table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.lit("t1").alias("table_id"), rows.alias("rows"), F.lit(4).alias("column_count"), F.size(rows).alias("row_count"), header.alias("header"), F.array().cast("array<string>").alias("warnings"))


def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.cells(_grid(spark, sf_dir))
    return found.select("doc_id", "row_index", "column_index", "role", "column_header", "row_header", "empty", F.array_join("numbers", "/").alias("numbers"), F.array_join("units", "/").alias("units"), F.size("locked_tokens").cast("long").alias("locked"))


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _grid(spark, sf_dir)
    return tables.table_report(tables.cells(grid), tables.span_candidates(grid)).drop("table_id")


def table_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells above or left of empty ones."""
    return tables.span_candidates(_grid(spark, sf_dir)).select("doc_id", "span_type", "row_index", "column_index", "reason", "confidence")


def patched_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that spans cover, the later span where two do."""
    grid = _grid(spark, sf_dir)
    spans = tables.span_candidates(grid).withColumn("ordinal", F.when(F.col("span_type") == "rowspan", 0).otherwise(1) * 1000 + F.col("row_index") * 10 + F.col("column_index"))
    found = tables.apply_patches(tables.cells(grid).select("doc_id", "table_id", "row_index", "column_index", "text"), spans)
    return found.select("doc_id", "row_index", "column_index", "anchor_row", "anchor_column", "covered")


def bound_footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that the footnote [2] is about, and those whose translation has lost the mark."""
    grid = _grid(spark, sf_dir)
    notes = grid.select("doc_id", "table_id", F.lit("n1").alias("note_id"), F.lit("[2] measured twice").alias("text"))
    own = tables.cells(grid)
    bound = tables.bind_footnotes(notes, own)
    targets = own.where(F.col("row_index") != 1).select("doc_id", "table_id", "row_index", "column_index", F.when(F.col("column_index") == 2, "w").otherwise(F.col("text")).alias("text"))
    lost = tables.footnote_binding_issues(bound, targets).select("doc_id", "row_index", "column_index", F.lit(True).alias("lost"))
    return bound.where("marker = '2'").join(lost.distinct(), ["doc_id", "row_index", "column_index"], "left").select("doc_id", "row_index", "column_index", F.coalesce("lost", F.lit(False)).alias("lost"))


def lost_cell_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose tokens the translated cell lacks: a column is left out, another loses its units."""
    own = tables.cells(_grid(spark, sf_dir)).select("doc_id", F.lit("c0").alias("chunk_id"), F.lit(0).alias("table_index"), "row_index", "column_index", "text", "locked_tokens")
    targets = own.where("column_index <> 1 AND doc_id % 7 > 0").withColumn("text", F.when(F.col("column_index") == 2, F.replace("text", F.lit("ms"), F.lit("?"))).otherwise(F.col("text"))).drop("locked_tokens")
    return quality.cell_issues(own, targets).select("doc_id", "row_index", "column_index", F.size("missing").cast("long").alias("n"))


def order_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as tables, one for a page, that go on while the status stays."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("table_id"), "o_orderstatus")
    after = orders.alias("a").join(orders.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.table_id") < F.col("b.table_id"))).groupBy(F.col("a.doc_id").alias("doc_id"), F.col("a.table_id").alias("previous_id"), F.col("a.o_orderstatus").alias("s")).agg(F.min(F.struct(F.col("b.table_id").alias("id"), F.col("b.o_orderstatus").alias("s"))).alias("n"))
    return tables.chains(orders, after.where("s = n.s").select("doc_id", "previous_id", F.col("n.id").alias("next_id")))


def split_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries between a text's pages of four lines, by chunks of one, two and three pages: which are split, and which way is the best."""
    pages = chunking.pages_of_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), 4).select("doc_id", "page_no").distinct()
    after = pages.select("doc_id", (F.col("page_no") - 1).alias("page_no"))
    ends = pages.join(after, ["doc_id", "page_no"]).select("doc_id", F.col("page_no").alias("prev_page"), (F.col("page_no") + 1).alias("next_page"), F.format_string("p%d", "page_no").alias("boundary_id"), F.when(F.pmod("page_no", F.lit(3)) == 0, "high").otherwise("medium").alias("severity"))
    reports = []
    for n in (1, 2, 3):
        rows = chunking.window_chunks(pages, n, 0).groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list("page_no")).alias("pages")).withColumn("boundary_ids", F.array().cast("array<string>"))
        reports.append(chunking.boundary_report(chunking.boundary_status(ends, rows), []).withColumns({"strategy": F.lit(f"pages{n}"), "ordinal": F.lit(n)}))
    return chunking.compare_strategies(reports[0].unionByName(reports[1]).unionByName(reports[2]), "pages1").select("strategy", "boundaries", "split_count", "co_located_count", "high_risk_split_count", "split_rate", "split_reduction", "is_best")


def merged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's table that goes on in another with one row less, of the same header or of another width: what becomes of the chain."""
    two, links = _two_tables(spark, sf_dir)
    found = tables.merge_chains(tables.chains(two, links), two)
    return found.select("doc_id", "merge_status", "chain_confidence", F.array_join("reject_reasons", "/").alias("reject_reasons"), F.size("rows").cast("long").alias("n_rows"), "skipped_headers")


def _two_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    grid = _grid(spark, sf_dir).where("row_count >= 3")
    wider = F.pmod("doc_id", F.lit(3)) == 0
    second = grid.select("doc_id", F.lit("t2").alias("table_id"), F.when(wider, F.transform(F.slice("rows", F.lit(1), F.col("row_count") - 1), lambda r: F.concat(r, r))).otherwise(F.slice("rows", F.lit(1), F.col("row_count") - 1)).alias("rows"), F.when(wider, 8).otherwise(4).alias("column_count"), (F.col("row_count") - 1).alias("row_count"), "header", "warnings")
    return grid.unionByName(second), grid.select("doc_id", F.lit("t1").alias("previous_id"), F.lit("t2").alias("next_id"))


def table_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counts of two tables, their chain and a footnote, by document."""
    two, links = _two_tables(spark, sf_dir)
    own = tables.cells(two)
    notes = two.select("doc_id", "table_id", F.lit("n1").alias("note_id"), F.lit("[2] measured twice").alias("text"))
    found = tables.table_summary(two, own, tables.span_candidates(two), tables.merge_chains(tables.chains(two, links), two), notes, tables.bind_footnotes(notes, own))
    return found.where(F.col("measure").isin("tables", "reconstructable_tables", "cells", "empty_cells", "chains", "chain_tables", "merged_chains", "rejected_chains", "merged_rows", "row_gain", "footnotes", "reject_reasons")).select("doc_id", "measure", "key", "value")


def checked_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that keep a line's locked tokens, lose them, are empty, or have none to keep."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("f"), F.array(F.col("l_quantity").cast("int").cast("string")).alias("tokens"))
    candidate = F.when(F.col("f") == "A", F.concat(F.lit("has "), F.col("tokens")[0])).when(F.col("f") == "N", F.lit("has none")).otherwise(" ")
    rows = lines.withColumns({"candidate": F.when(F.col("l_linenumber") == 7, "some").otherwise(candidate), "locked_tokens": F.when(F.col("l_linenumber") == 7, F.array().cast("array<string>")).otherwise(F.col("tokens")), "shapes": F.array().cast("array<struct<row_count:int,column_count:int>>")})
    return quality.validate_repairs(rows).groupBy("f", "validation").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (number_tokens, reference_tokens, table_figure_tokens, formula_tokens, locked_tokens, entity_tokens, useful_shares, caption_lines, without_leaders, without_matter, deferred_parts, drawn_tables, held_terms, box_shares, read_values, http_codes, lost_numbers, table_cells, table_counts, table_spans, patched_cells, bound_footnotes, lost_cell_tokens, order_chains, merged_tables, table_measures, split_boundaries, checked_repairs)}

_BODY = r"""SELECT doc_id, concat(regexp_replace(text, '[^\x00-\x7F]', 'x', 'g'), chr(10), 'Table ', doc_id % 12, ' and Fig. ', doc_id % 5, 'a [', doc_id % 30, ', ', doc_id % 4, '] by (Smith et al., ', doc_id % 30 + 1990, ') with p < 0.0', doc_id % 9, ' and x_{', doc_id % 3, '} gave F1-score ', doc_id % 100, '.5% in ( ', doc_id % 7, ' ) of table ', doc_id % 12, '; Turing, ', doc_id % 9 + 1950, ' at Lund University and BERT, GPT-', doc_id % 5, ', NLP-', doc_id % 3, ' on URL.') AS body FROM documents"""
_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents"
_CELLS = """SELECT c_custkey AS doc_id, r, c, CASE WHEN (c_custkey + r * 7 + c * 3) % 4 = 0 THEN '' WHEN (c_custkey + r + c) % 5 = 0 THEN concat('v ', c_custkey + r, ' [2]') ELSE concat('v ', c_custkey + r, '.5 ms') END AS text
    FROM (SELECT c_custkey, unnest(range(0, c_custkey % 5 + 1)) AS r FROM customer), (SELECT unnest(range(0, 4)) AS c)"""
_TOKENS = r"list_distinct(list_concat(list_concat(regexp_extract_all(text, '\b\d+(?:\.\d+)?%?\b'), regexp_extract_all(text, '(?i)(?:\b\d+(?:[.,]\d+)?\s*)(%|(?:ms|s)\b)', 1)), CAST([] AS VARCHAR[])))"
_SPANS = f"""SELECT doc_id, 'rowspan' AS span_type, r - 1 AS row_index, c AS column_index, 'empty_cell_below_nonempty_anchor' AS reason, CASE WHEN c = 0 THEN 'medium' ELSE 'low' END AS confidence, r - 1 AS ar, c AS ac
      FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id, c ORDER BY r) AS before FROM ({_CELLS})) WHERE text = '' AND before <> ''
    UNION ALL SELECT doc_id, 'colspan', r, c - 1, 'empty_cell_right_of_nonempty_anchor', 'low', r, c - 1
      FROM (SELECT *, lag(text) OVER (PARTITION BY doc_id, r ORDER BY c) AS before FROM ({_CELLS})) WHERE text = '' AND before <> ''"""

SQL = {
    "number_tokens": rf"SELECT doc_id, unnest(list_distinct(regexp_extract_all(body, '\b\d+(?:[.,]\d+)?%?\b'))) AS token FROM ({_BODY})",
    "reference_tokens": rf"SELECT doc_id, unnest(list_distinct(list_concat(regexp_extract_all(body, '\[[0-9,\-\s;]+\]'), regexp_extract_all(body, '\([A-Z][A-Za-z\-]+(?:\s+et\s+al\.)?,\s*\d{{4}}[a-z]?\)')))) AS token FROM ({_BODY})",
    "table_figure_tokens": rf"""
        SELECT DISTINCT doc_id, CASE WHEN lower(label) LIKE 'table%' THEN 'table' ELSE 'figure' END AS kind, num FROM (
            SELECT doc_id, unnest(regexp_extract_all(body, '(?i)\b(Table|Fig(?:ure)?\.?)\s*(\d+[A-Za-z]?)\b', 1)) AS label, unnest(regexp_extract_all(body, '(?i)\b(Table|Fig(?:ure)?\.?)\s*(\d+[A-Za-z]?)\b', 2)) AS num FROM ({_BODY}))""",
    "formula_tokens": rf"""
        SELECT DISTINCT doc_id, kind, CASE WHEN kind IN ('metric', 'statistic') THEN lower(token) WHEN kind = 'equation_label' THEN regexp_replace(token, '\s+', '', 'g') ELSE token END AS token FROM (
            SELECT doc_id, 'symbol' AS kind, unnest(regexp_extract_all(body, '[≤≥≠±≈=∑∫√→αβγδλμσ]')) AS token FROM ({_BODY})
            UNION ALL SELECT doc_id, 'equation_label', unnest(regexp_extract_all(body, '(?:^|[^A-Za-z0-9_])(\(\s*\d{{1,3}}[A-Za-z]?\s*\))', 1)) FROM ({_BODY})
            UNION ALL SELECT doc_id, 'variable', unnest(regexp_extract_all(body, '\b[A-Za-z](?:_\{{?[A-Za-z0-9,+\-]+\}}?|\^\{{?[A-Za-z0-9,+\-]+\}}?)(?:_\{{?[A-Za-z0-9,+\-]+\}}?|\^\{{?[A-Za-z0-9,+\-]+\}}?)*\b')) FROM ({_BODY})
            UNION ALL SELECT doc_id, 'metric', unnest(regexp_extract_all(body, '(?i)\b(?:F1(?:-score)?|p-value|ROC-AUC|AUC|BLEU|ROUGE(?:-[L12])?)\b')) FROM ({_BODY})
            UNION ALL SELECT doc_id, 'statistic', unnest(regexp_extract_all(body, '(?i)\bp\s*(?:<|<=|=|>|>=|≤|≥)\s*0?\.\d+\b')) FROM ({_BODY}))""",
    "locked_tokens": rf"""
        SELECT doc_id, least(80, len(list_distinct(t)))::BIGINT AS n, t[1] AS first FROM (
            SELECT doc_id, list_filter(list_transform(regexp_extract_all(body, '\[[0-9,\-\s]+\]|\([A-Z][A-Za-z]+,\s*\d{{4}}\)|Table\s+\d+|Fig(?:ure)?\.?\s+\d+|\b\d+(?:\.\d+)?%?\b|[A-Za-z]\d\b|[A-Z]{{2,}}(?:-[A-Z0-9]+)*'), lambda x: trim(x)), lambda x: x <> '') AS t FROM ({_BODY}))""",
    "entity_tokens": rf"""
        WITH b AS ({_BODY}),
        f AS (SELECT doc_id, 1 AS pass, 'organization' AS type, regexp_extract_all(body, '\b([A-Z][A-Za-z&.-]+(?:\s+(?:of|and|for|the|[A-Z][A-Za-z&.-]+)){{0,6}}\s+(?:University|Institute|Laborator(?:y|ies)|Labs|College|School|Corporation|Corp\.?|Inc\.?|Ltd\.?|LLC|Center|Centre|Department))\b', 1) AS x FROM b
            UNION ALL SELECT doc_id, 2, 'model_or_dataset', regexp_extract_all(body, '\b(BERT|RoBERTa|GPT(?:-\d+(?:\.\d+)?)?|ResNet-\d+|ImageNet|COCO|GLUE|MNIST|CIFAR-\d+|SQuAD|WikiText-\d+|Transformer|LLaMA(?:-\d+)?|CLIP|ViT(?:-[A-Z0-9/]+)?|[A-Z][A-Za-z]+Net(?:-\d+)?)\b', 1) FROM b
            UNION ALL SELECT doc_id, 3, 'person', regexp_extract_all(body, '\b([A-Z][A-Za-z''-]+)(?:\s+et\s+al\.)?(?:,\s*|\s+\()(?:19|20)\d{{2}}\)?', 1) FROM b
            UNION ALL SELECT doc_id, 4, 'acronym', regexp_extract_all(body, '\b([A-Z]{{2,}}(?:-[A-Z0-9]+)*)\b', 1) FROM b),
        u AS (SELECT doc_id, pass, type, unnest(x) AS name, generate_subscripts(x, 1) AS pos FROM f),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY pass, pos) AS n FROM u WHERE length(name) >= 2 AND name NOT IN ('API', 'CPU', 'DOI', 'HTTP', 'PDF', 'QA', 'URL'))
        SELECT doc_id, type, lower(name) AS name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pass, pos) AS place FROM k WHERE n = 1) WHERE place <= 80""",
    "useful_shares": rf"SELECT doc_id, len(regexp_extract_all(s, '[\p{{L}}\p{{N}}]')) / length(s) AS ratio FROM (SELECT doc_id, regexp_replace(body, '\s+', '', 'g') AS s FROM ({_BODY}))",
    "caption_lines": rf"""
        SELECT doc_id, kind, count(*) AS n FROM (
            SELECT doc_id, CASE WHEN label IN ('table', '表') THEN 'table' WHEN label LIKE 'fig%' OR label = '图' THEN 'figure' ELSE 'none' END AS kind FROM (
                SELECT doc_id, lower(regexp_extract(trim(concat((['Table 3. ', '  Fig. 2: ', 'Tables 4. ', '图 四、', 'FIGURE IV ', '表 7：', 'See Table 3. '])[ord % 7 + 1], line)), '(?i)^\s*(fig(?:ure)?|table|图|表)\.?\s*[\dIVX一二三四五六七八九十]+[.:：、\s]', 1)) AS label FROM ({_LINES})))
        GROUP BY doc_id, kind""",
    "without_leaders": """
        SELECT doc_id, (sum(length(line)) + count(*) - 1)::BIGINT AS n FROM (SELECT doc_id, unnest(string_split(concat(text, chr(10), repeat('. ', (doc_id % 20)::INTEGER + 1), chr(10), text), chr(10))) AS line FROM documents)
        WHERE NOT (length(trim(line)) >= 24 AND regexp_matches(line, '^[.·…\\s　]+$')) GROUP BY doc_id""",
    "without_matter": "SELECT doc_id, (length(text) + 2 + CASE WHEN doc_id % 3 = 2 THEN 9 ELSE 0 END)::BIGINT AS n FROM documents",
    "deferred_parts": """
        SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 2 + 11 + length(text) + 9 ELSE 1 + 11 END)::BIGINT AS body, CASE WHEN doc_id % 2 = 0 THEN 'rest' ELSE concat('b', text, ' rest') END AS deferred, concat('a', chr(10), chr(10), 'bc', chr(10)) AS resolved FROM documents""",
    "drawn_tables": "SELECT doc_id, (doc_id % 4 + 1)::INTEGER AS row_count, (doc_id % 3 + 1)::INTEGER AS column_count FROM documents",
    "held_terms": r"""
        SELECT conv_id, turn, true AS whole, regexp_matches(text, '(?i)(?:^|[^A-Za-z0-9])' || cut || '(?:[^A-Za-z0-9]|$)') AND cut <> '' AS cut FROM (
            SELECT conv_id, turn, text, substring(word, 1, length(word) - 1) AS cut FROM (SELECT *, regexp_extract(text, '^([A-Za-z]+)', 1) AS word FROM conversations) WHERE word <> '')""",
    "box_shares": """
        WITH b AS (SELECT p_partkey, p_partkey % 7 AS ax, p_partkey % 11 AS ay, p_partkey % 5 AS aw, p_size AS ah, p_partkey % 13 AS bx, p_partkey % 3 AS by_, p_size AS bw, p_partkey % 17 AS bh FROM part),
        o AS (SELECT *, (aw * ah)::DOUBLE AS area, (greatest(least(ax + aw, bx + bw) - greatest(ax, bx), 0) * greatest(least(ay + ah, by_ + bh) - greatest(ay, by_), 0))::DOUBLE AS overlap FROM b)
        SELECT p_partkey, area, overlap, ((greatest(ax + aw, bx + bw) - least(ax, bx)) * (greatest(ay + ah, by_ + bh) - least(ay, by_)))::DOUBLE AS union_area, CASE WHEN area = 0 THEN 0.0 ELSE overlap / area END::DOUBLE AS coverage FROM o""",
    "read_values": """
        SELECT c_custkey, ([true, true, true, false, false, NULL, NULL, false, true, false])[k] AS answer, ([true, true, true, false, false, false, false, false, true, false])[k] AS included,
               concat('x/', c_custkey, '/z') AS tags, concat('a:b=', c_custkey, '/c=2/d=0') AS counts, c_custkey AS whole, 0.0::DOUBLE AS wrong FROM (SELECT c_custkey, c_custkey % 10 + 1 AS k FROM customer)""",
    "http_codes": """
        SELECT code, code NOT IN ('HTTP_AUTH_ERROR', 'HTTP_CLIENT_ERROR') AS retryable, count(*) AS n FROM (
            SELECT CASE WHEN s = 429 THEN 'HTTP_RATE_LIMIT' WHEN s IN (401, 403) THEN 'HTTP_AUTH_ERROR' WHEN s = 408 THEN 'HTTP_TIMEOUT' WHEN s >= 500 THEN 'HTTP_SERVER_ERROR' WHEN s >= 400 THEN 'HTTP_CLIENT_ERROR' ELSE 'HTTP_NETWORK_ERROR' END AS code
            FROM (SELECT event_id % 330 + 200 AS s FROM events)) GROUP BY code""",
    "lost_numbers": rf"""
        WITH p AS (SELECT doc_id, body, CASE WHEN doc_id % 5 > 0 THEN replace(body, '7', '~') END AS target FROM ({_BODY})),
        t AS (SELECT doc_id, 'missing_numbers' AS issue_type, target, list_distinct(regexp_extract_all(body, '\b\d+(?:[.,]\d+)?%?\b')) AS tokens FROM p
            UNION ALL SELECT doc_id, 'missing_references', target, list_distinct(list_concat(regexp_extract_all(body, '\[[0-9,\-\s;]+\]'), regexp_extract_all(body, '\([A-Z][A-Za-z\-]+(?:\s+et\s+al\.)?,\s*\d{{4}}[a-z]?\)'))) FROM p)
        SELECT doc_id, issue_type, 'high' AS severity, least(80, n)::BIGINT AS n FROM (SELECT doc_id, issue_type, len(list_filter(tokens, lambda x: NOT contains(target, x))) AS n FROM t WHERE target IS NOT NULL) WHERE n > 0
        UNION ALL SELECT doc_id, 'missing_translation', 'high', 0 FROM p WHERE target IS NULL""",
    "table_cells": rf"""
        SELECT doc_id, r::INTEGER AS row_index, c::INTEGER AS column_index, CASE WHEN r = 0 AND doc_id % 2 = 0 THEN 'header' WHEN c = 0 THEN 'row_header' ELSE 'data' END AS role,
               CASE WHEN doc_id % 2 = 0 THEN (['A', 'B', 'C', 'D'])[c + 1] END AS column_header, first_value(text) OVER (PARTITION BY doc_id, r ORDER BY c) AS row_header, text = '' AS empty,
               array_to_string(list_distinct(regexp_extract_all(text, '\d+(?:\.\d+)?')), '/') AS numbers, CASE WHEN contains(text, 'ms') THEN 'ms' ELSE '' END AS units,
               (CASE WHEN text = '' THEN 0 WHEN contains(text, 'ms') THEN 2 WHEN doc_id + r = 2 THEN 1 ELSE 2 END)::BIGINT AS locked FROM ({_CELLS})""".replace("array_to_string(list_distinct(regexp_extract_all(text, '\\d+(?:\\.\\d+)?')), '/')", "CASE WHEN text = '' THEN '' WHEN contains(text, 'ms') THEN concat(doc_id + r, '.5') WHEN doc_id + r = 2 THEN '2' ELSE concat(doc_id + r, '/2') END"),
    "table_counts": f"""
        WITH c AS ({_CELLS}), s AS ({_SPANS}),
        a AS (SELECT doc_id, count(*) AS cells, count(*) FILTER (text = '') AS empty_cells, sum(CASE WHEN text = '' THEN 0 WHEN contains(text, 'ms') THEN 2 WHEN doc_id + r = 2 THEN 1 ELSE 2 END)::BIGINT AS locked_tokens, count(*) FILTER (r = 0 AND doc_id % 2 = 0) AS header_cells FROM c GROUP BY doc_id),
        b AS (SELECT doc_id, count(*) AS span_candidates, count(*) FILTER (span_type = 'rowspan') AS rowspans FROM s GROUP BY doc_id)
        SELECT a.*, coalesce(span_candidates, 0) AS span_candidates, coalesce(rowspans, 0) AS rowspans FROM a LEFT JOIN b USING (doc_id)""",
    "table_spans": f"SELECT doc_id, span_type, row_index::INTEGER AS row_index, column_index::INTEGER AS column_index, reason, confidence FROM ({_SPANS})",
    "patched_cells": f"""
        WITH s AS ({_SPANS}),
        w AS (SELECT doc_id, ar, ac, ar AS r, ac AS c, CASE span_type WHEN 'rowspan' THEN 0 ELSE 1000 END + ar * 10 + ac AS o FROM s
            UNION ALL SELECT doc_id, ar, ac, ar + CASE span_type WHEN 'rowspan' THEN 1 ELSE 0 END, ac + CASE span_type WHEN 'rowspan' THEN 0 ELSE 1 END, CASE span_type WHEN 'rowspan' THEN 0 ELSE 1000 END + ar * 10 + ac FROM s),
        l AS (SELECT doc_id, r, c, arg_max(ar, o) AS ar, arg_max(ac, o) AS ac FROM w GROUP BY doc_id, r, c)
        SELECT x.doc_id, x.r::INTEGER AS row_index, x.c::INTEGER AS column_index, l.ar::INTEGER AS anchor_row, l.ac::INTEGER AS anchor_column, coalesce(NOT (l.ar = x.r AND l.ac = x.c), false) AS covered
        FROM ({_CELLS}) x LEFT JOIN l ON x.doc_id = l.doc_id AND x.r = l.r AND x.c = l.c""",
    "bound_footnotes": f"SELECT doc_id, r::INTEGER AS row_index, c::INTEGER AS column_index, r = 1 OR c = 2 AS lost FROM ({_CELLS}) WHERE contains(text, '[2]')",
    "lost_cell_tokens": f"""
        SELECT doc_id, r::INTEGER AS row_index, c::INTEGER AS column_index, (CASE WHEN c = 1 THEN CASE WHEN contains(text, 'ms') THEN 2 WHEN doc_id + r = 2 THEN 1 ELSE 2 END ELSE 1 END)::BIGINT AS n
        FROM ({_CELLS}) WHERE doc_id % 7 > 0 AND text <> '' AND (c = 1 OR (c = 2 AND contains(text, 'ms')))""",
    "order_chains": """
        WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS table_id, o_orderstatus AS s, lag(o_orderstatus) OVER w AS before, lead(o_orderstatus) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
        i AS (SELECT *, sum(CASE WHEN s IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY table_id) AS island FROM o)
        SELECT doc_id, first_value(table_id) OVER w AS chain, table_id, (row_number() OVER w - 1)::INTEGER AS place FROM i WHERE s IS NOT DISTINCT FROM before OR s IS NOT DISTINCT FROM after WINDOW w AS (PARTITION BY doc_id, island ORDER BY table_id)""",
    "merged_tables": """
        WITH t AS (SELECT c_custkey AS doc_id, c_custkey % 5 + 1 AS n, c_custkey % 3 = 0 AS wider, c_custkey % 2 = 0 AS headed FROM customer WHERE c_custkey % 5 >= 2)
        SELECT doc_id, CASE WHEN wider THEN 'rejected' ELSE 'merged' END AS merge_status, CASE WHEN wider THEN 'low' WHEN headed THEN 'high' ELSE 'medium' END AS chain_confidence,
               CASE WHEN wider THEN 'column_count_drift' ELSE '' END AS reject_reasons, CASE WHEN NOT wider THEN n + n - 1 - CASE WHEN headed THEN 1 ELSE 0 END END::BIGINT AS n_rows, CASE WHEN headed THEN 1 ELSE 0 END AS skipped_headers FROM t""",
    "table_measures": f"""
        WITH t AS (SELECT c_custkey AS doc_id, c_custkey % 5 + 1 AS n, c_custkey % 3 = 0 AS wider, c_custkey % 2 = 0 AS headed FROM customer WHERE c_custkey % 5 >= 2),
        e AS (SELECT t.doc_id, sum(CASE WHEN text = '' THEN 1 + CASE WHEN r < n - 1 THEN CASE WHEN wider THEN 2 ELSE 1 END ELSE 0 END ELSE 0 END) AS empty_cells FROM ({_CELLS}) c JOIN t ON t.doc_id = c.doc_id GROUP BY t.doc_id),
        m AS (SELECT t.*, empty_cells, n + n - 1 - CASE WHEN headed THEN 1 ELSE 0 END AS merged_rows FROM t JOIN e USING (doc_id)),
        l AS (SELECT doc_id, unnest([{{'m': 'tables', 'k': '', 'v': 2}}, {{'m': 'reconstructable_tables', 'k': '', 'v': 2}}, {{'m': 'cells', 'k': '', 'v': 4 * n + CASE WHEN wider THEN 8 ELSE 4 END * (n - 1)}}, {{'m': 'empty_cells', 'k': '', 'v': empty_cells}}, {{'m': 'chains', 'k': '', 'v': 1}}, {{'m': 'chain_tables', 'k': '', 'v': 2}},
              {{'m': 'merged_chains', 'k': '', 'v': CASE WHEN wider THEN 0 ELSE 1 END}}, {{'m': 'rejected_chains', 'k': '', 'v': CASE WHEN wider THEN 1 ELSE 0 END}}, {{'m': 'merged_rows', 'k': '', 'v': CASE WHEN wider THEN 0 ELSE merged_rows END}}, {{'m': 'row_gain', 'k': '', 'v': CASE WHEN wider THEN 0 ELSE merged_rows - n END}},
              {{'m': 'footnotes', 'k': '', 'v': 2}}, {{'m': 'reject_reasons', 'k': 'column_count_drift', 'v': CASE WHEN wider THEN 1 ELSE 0 END}}]) AS x FROM m)
        SELECT doc_id, x.m AS measure, x.k AS key, x.v::DOUBLE AS value FROM l WHERE x.v > 0""",
    "split_boundaries": f"""
        WITH p AS (SELECT DISTINCT doc_id, ord // 4 AS k FROM ({_LINES})), e AS (SELECT a.doc_id, a.k FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.k = a.k + 1),
        r AS (SELECT n, count(*) AS boundaries, count(*) FILTER ((k + 1) % n = 0) AS split_count, count(*) FILTER ((k + 1) % n > 0) AS co_located_count, count(*) FILTER ((k + 1) % n = 0 AND k % 3 = 0) AS high_risk_split_count FROM e, (SELECT unnest([1, 2, 3]) AS n) GROUP BY n)
        SELECT concat('pages', n) AS strategy, boundaries, split_count, co_located_count, high_risk_split_count, split_count / boundaries AS split_rate, (SELECT split_count FROM r WHERE n = 1) - split_count AS split_reduction, n = 3 AS is_best FROM r""",
    "checked_repairs": """
        SELECT f, validation, count(*) AS n FROM (SELECT l_returnflag AS f, CASE WHEN l_linenumber = 7 THEN 'unchecked' WHEN l_returnflag = 'A' THEN 'passed' ELSE 'failed' END AS validation FROM lineitem) GROUP BY f, validation""",
}

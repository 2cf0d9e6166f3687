"""Tables: cells, spans, footnotes, and tables that go on over pages.

A table has doc_id, table_id, page_no, rows (ragged), column_count, row_count, header, warnings.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import values as V

# Fixed values.
UNIT = r"(?iU)(?:\b\d+(?:[.,]\d+)?\s*)(%|(?:ms|s|sec|seconds?|m|cm|mm|nm|um|µm|kg|g|mg|kb|mb|gb|hz|khz|mhz|ghz)\b)"
SIGNIFICANCE = r"(?i)(?:\*{1,3}|†|‡|§|p\s*[<=>]\s*0?\.\d+)"
MARKER = r"\*{1,3}|[A-Za-z]|\d{1,3}|[†‡§¶#]"
FULL_COVER = 0.85


def cells(tables: DataFrame) -> DataFrame:
    """A row for each cell, padded ones left out: role, headers, numbers, units, significance marks and their union as locked tokens."""
    rows = tables.select("doc_id", "table_id", "header", F.posexplode("rows").alias("row_index", "row"))
    one = rows.select("doc_id", "table_id", "header", "row_index", "row", F.posexplode("row").alias("column_index", "text"))
    tokens = {"numbers": T.distinct_found("text", T.CELL_NUMBER), "units": F.array_distinct(T.found("text", UNIT, 1)), "significance": T.distinct_found("text", SIGNIFICANCE)}
    one = one.withColumns(tokens)
    has_header = F.size(F.coalesce("header", F.array().cast("array<string>"))) > 0
    return one.select(
        "doc_id", "table_id", "row_index", "column_index",
        F.when((F.col("row_index") == 0) & has_header, "header").when(F.col("column_index") == 0, "row_header").otherwise("data").alias("role"),
        F.try_element_at("header", F.col("column_index") + 1).alias("column_header"),
        F.try_element_at("row", F.lit(1)).alias("row_header"),
        "text", (F.trim("text") == "").alias("empty"), "numbers", "units", "significance",
        F.array_distinct(F.concat("numbers", "units", "significance")).alias("locked_tokens"),
    )


def span_candidates(tables: DataFrame) -> DataFrame:
    """Cells that may span others: a short row's only or last filled cell, a cell above an empty one, a cell left of an empty one. Cells that only padding adds are not empty ones."""
    rows = tables.where("column_count >= 2").select("doc_id", "table_id", "column_count", F.posexplode("rows").alias("row_index", "row"))
    filled = F.filter(F.transform("row", lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    short = rows.withColumn("filled", filled).where((F.size("row") < F.col("column_count")) & (F.size("filled") > 0))
    short = short.withColumn("anchor", F.array_max("filled")).where((F.size("filled") == 1) | (F.col("anchor") < F.col("column_count") - 1))
    single = F.size("filled") == 1
    text = F.get("row", F.col("anchor"))
    ragged = short.select("doc_id", "table_id", F.lit("colspan").alias("span_type"), "row_index", F.col("anchor").alias("column_index"), F.lit(1).alias("row_span"), F.greatest(F.lit(1), F.col("column_count") - F.col("anchor")).alias("column_span"), text.alias("text"), F.when(single, "single_cell_ragged_row").otherwise("ragged_row_trailing_span").alias("reason"), F.when(single & (F.col("row_index") == 0) & ~text.rlike(T.CELL_NUMBER), "medium").otherwise("low").alias("confidence"))
    flat = rows.select("doc_id", "table_id", "row_index", F.posexplode("row").alias("column_index", "text"))
    above = Window.partitionBy("doc_id", "table_id", "column_index").orderBy("row_index")
    left = Window.partitionBy("doc_id", "table_id", "row_index").orderBy("column_index")
    near = flat.withColumns({"_above": F.when(F.lag("row_index").over(above) == F.col("row_index") - 1, F.lag("text").over(above)), "_left": F.lag("text").over(left)}).where(F.trim("text") == "")
    down = near.where(F.trim("_above") != "").select("doc_id", "table_id", F.lit("rowspan").alias("span_type"), (F.col("row_index") - 1).alias("row_index"), "column_index", F.lit(2).alias("row_span"), F.lit(1).alias("column_span"), F.col("_above").alias("text"), F.lit("empty_cell_below_nonempty_anchor").alias("reason"), F.when(F.col("column_index") == 0, "medium").otherwise("low").alias("confidence"))
    right = near.where(F.trim("_left") != "").select("doc_id", "table_id", F.lit("colspan").alias("span_type"), "row_index", (F.col("column_index") - 1).alias("column_index"), F.lit(1).alias("row_span"), F.lit(2).alias("column_span"), F.col("_left").alias("text"), F.lit("empty_cell_right_of_nonempty_anchor").alias("reason"), F.lit("low").alias("confidence"))
    return ragged.unionByName(down).unionByName(right)


def widest_spans(candidates: DataFrame) -> DataFrame:
    """Of candidates with one anchor and type the one that covers most: what a wider one covers needs no other. Ties go to the smaller ordinal (source order), then the reason."""
    w = Window.partitionBy("doc_id", "table_id", "span_type", "row_index", "column_index").orderBy(F.desc(F.col("row_span") * F.col("column_span")), *(["ordinal"] if "ordinal" in candidates.columns else []), "reason")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def covered_cells(spans: DataFrame) -> DataFrame:
    """A row for each cell in a span, with the span's anchor and whether the cell is it."""
    wide = spans.withColumn("r", F.explode(F.sequence(F.col("row_index"), F.col("row_index") + F.col("row_span") - 1))).withColumn("c", F.explode(F.sequence(F.col("column_index"), F.col("column_index") + F.col("column_span") - 1)))
    return wide.select("doc_id", "table_id", F.col("row_index").alias("anchor_row"), F.col("column_index").alias("anchor_column"), F.col("r").alias("row_index"), F.col("c").alias("column_index"), ((F.col("r") == F.col("row_index")) & (F.col("c") == F.col("column_index"))).alias("is_anchor"), *(["ordinal"] if "ordinal" in spans.columns else []))


def apply_patches(cell_rows: DataFrame, patches: DataFrame) -> DataFrame:
    """cells with the anchor that covers them and whether they are it; of several patches (with ordinal) the latest counts."""
    flat = covered_cells(patches)
    w = Window.partitionBy("doc_id", "table_id", "row_index", "column_index").orderBy(F.desc("ordinal"))
    last = flat.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "ordinal")
    return cell_rows.join(last, ["doc_id", "table_id", "row_index", "column_index"], "left").withColumn("covered", F.coalesce(~F.col("is_anchor"), F.lit(False)))


def box_evidence(spans: DataFrame, boxes: DataFrame) -> DataFrame:
    """spans with how much of the boxes of their cells the anchor's own box covers: confirmed, partial or none. boxes: doc_id, table_id, row_index, column_index, bbox."""
    each = covered_cells(spans).join(boxes, ["doc_id", "table_id", "row_index", "column_index"], "left")
    anchor = boxes.select("doc_id", "table_id", F.col("row_index").alias("anchor_row"), F.col("column_index").alias("anchor_column"), F.col("bbox").alias("anchor_box"))
    j = each.where("NOT is_anchor").join(anchor, ["doc_id", "table_id", "anchor_row", "anchor_column"], "left")
    cover = j.groupBy("doc_id", "table_id", "anchor_row", "anchor_column").agg(F.avg(V.box_coverage(F.col("bbox"), F.col("anchor_box"))).alias("coverage"))
    out = spans.join(cover, (spans["doc_id"] == cover["doc_id"]) & (spans["table_id"] == cover["table_id"]) & (spans["row_index"] == cover["anchor_row"]) & (spans["column_index"] == cover["anchor_column"]), "left").select(spans["*"], "coverage")
    return out.withColumn("evidence", F.when(F.col("coverage").isNull(), "no_boxes").when(F.col("coverage") >= FULL_COVER, "confirmed").when(F.col("coverage") > 0, "partial").otherwise("none"))


def footnote_markers(text: Column | str) -> Column:
    """Markers that a footnote may go by: its own, explicit ones, symbols and significance marks."""
    own = T.found(text, rf"(?i)^\s*(?:note\s*[:：]?\s*)?[\[(]?({MARKER})[\])]?(?=$|[\s.):：、])", 1)
    explicit = F.flatten(F.array(*(T.found(text, rf"(?i){a}({MARKER}){b}(?!\w)", 1) for a, b in ((r"\[", r"\]"), (r"\(", r"\)"), (r"\^", "")))))
    return F.array_distinct(F.concat(own, explicit, T.found(text, r"\*{1,3}|[†‡§¶#]"), T.found(text, SIGNIFICANCE)))


def bind_footnotes(notes: DataFrame, cell_rows: DataFrame) -> DataFrame:
    """Which cells each footnote's markers stand in. notes: doc_id, table_id, note_id, text. Numbers and single letters only count as [1], (1) or ^1."""
    marks = notes.select("doc_id", "table_id", "note_id", F.explode(footnote_markers("text")).alias("marker"))
    m, text = F.col("marker"), F.col("text")
    plain = m.rlike(r"^(\d{1,3}|[A-Za-z])$")
    quoted = F.concat(F.lit(r"(?i)(?:\[\Q"), m, F.lit(r"\E\]|\(\Q"), m, F.lit(r"\E\)|\^\Q"), m, F.lit(r"\E)(?!\w)"))
    hit = F.when(plain, F.regexp(text, quoted)).otherwise(F.contains(F.lower(F.regexp_replace(text, r"\s+", "")), F.lower(F.regexp_replace(m, r"\s+", ""))))
    return marks.join(cell_rows.select("doc_id", "table_id", "row_index", "column_index", "text"), ["doc_id", "table_id"]).where(hit).select("doc_id", "table_id", "note_id", "marker", "row_index", "column_index")


def footnote_binding_issues(bindings: DataFrame, targets: DataFrame) -> DataFrame:
    """Bound cells whose marker the target's cell lacks; a missing table or cell lacks it. targets: doc_id, table_id, row_index, column_index, text."""
    j = bindings.join(targets.withColumnRenamed("text", "_t"), ["doc_id", "table_id", "row_index", "column_index"], "left")
    return j.where(~F.contains(F.coalesce("_t", F.lit("")), F.col("marker"))).drop("_t")


def chains(tables: DataFrame, continuations: DataFrame) -> DataFrame:
    """Tables that go on as chains: doc_id, chain (its first table), table_id, place. continuations: doc_id, previous_id, next_id, each page's last and first table, so a table has one follower at most. A ring has no head and gives no chain. A document's links are walked in one task, a step for each link."""
    known = tables.select("doc_id", "table_id")
    links = continuations.join(known.withColumnRenamed("table_id", "previous_id"), ["doc_id", "previous_id"], "left_semi").join(known.withColumnRenamed("table_id", "next_id"), ["doc_id", "next_id"], "left_semi").select("doc_id", "previous_id", "next_id").distinct()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        follower = dict(zip(pdf["previous_id"], pdf["next_id"], strict=True))
        found = []
        for head in sorted(set(follower) - set(follower.values())):
            place, at = 0, head
            while at is not None:
                found.append((pdf["doc_id"].iloc[0], head, at, place))
                place, at = place + 1, follower.get(at)
        return pd.DataFrame(found, columns=["doc_id", "chain", "table_id", "place"])

    kinds = {c: links.schema[c].dataType.simpleString() for c in ("doc_id", "previous_id")}
    return links.groupBy("doc_id").applyInPandas(walk, f"doc_id {kinds['doc_id']}, chain {kinds['previous_id']}, table_id {kinds['previous_id']}, place int")


def merge_chains(walks: DataFrame, tables: DataFrame) -> DataFrame:
    """One row for each chain: whether its tables can be one, how sure that is, why not, and their rows without repeated headers."""
    signature = lambda h: F.array_distinct(F.filter(F.transform(h, lambda c: F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))), lambda c: c != ""))
    part = F.struct("place", "table_id", "rows", "row_count", "column_count", signature(F.coalesce("header", F.array().cast("array<string>"))).alias("head"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))
    g = walks.join(tables, ["doc_id", "table_id"]).groupBy("doc_id", "chain").agg(F.sort_array(F.collect_list(part)).alias("p"))
    g = g.withColumn("header", F.coalesce(F.try_element_at(F.filter(F.transform("p", lambda x: x["head"]), lambda h: F.size(h) > 0), F.lit(1)), F.array().cast("array<string>")))
    columns = F.transform("p", lambda x: x["column_count"])
    rest = F.slice("p", 2, F.size("p"))
    like = lambda h: F.when((F.size("header") == 0) | (F.size(h) == 0), F.lit(None).cast("double")).otherwise(F.size(F.array_intersect("header", h)) / F.size(F.array_union("header", h)))
    g = g.withColumn("similarities", F.transform(rest, lambda x: like(x["head"])))
    on = lambda c, name: F.when(c, F.lit(name))
    rejects = F.array_compact(F.concat(F.array(on(F.exists(columns, lambda c: c <= 0), "missing_column_count"), on(~F.exists(columns, lambda c: c <= 0) & (F.array_max(columns) - F.array_min(columns) >= 2), "column_count_drift"), on(F.exists("p", lambda x: (x["row_count"] < 2) | (x["column_count"] < 2)), "not_reconstructable_segment")), F.transform("similarities", lambda s, i: F.when(s < 0.5, F.concat(F.lit("header_mismatch_segment_"), (i + 1).cast("string"))))))
    warns = F.array_compact(F.concat(F.transform("similarities", lambda s, i: F.when(s.isNull(), F.concat(F.lit("missing_header_for_segment_"), (i + 1).cast("string")))), F.array(on(F.exists("p", lambda x: F.array_contains(x["warnings"], "ragged_table_rows")), "ragged_table_rows_in_chain"), on(F.exists("p", lambda x: F.array_contains(x["warnings"], "low_confidence_table_structure")), "low_confidence_table_structure_in_chain"))))
    g = g.withColumns({"reject_reasons": rejects, "warnings": warns})
    repeats = F.transform("p", lambda x, i: (i > 0) & (F.size(x["head"]) > 0) & (x["head"] == F.col("header")))
    merged = F.flatten(F.transform("p", lambda x, i: F.when(F.get(repeats, i), F.slice(x["rows"], 2, F.greatest(F.size(x["rows"]) - 1, F.lit(0)))).otherwise(x["rows"])))
    rejected = F.size("reject_reasons") > 0
    return g.select("doc_id", "chain", F.transform("p", lambda x: x["table_id"]).alias("table_ids"), F.when(rejected, "rejected").otherwise("merged").alias("merge_status"), F.when(rejected, "low").when((F.size("warnings") > 0) | F.exists("similarities", lambda s: s < 0.8), "medium").otherwise("high").alias("chain_confidence"), "reject_reasons", "warnings", "similarities", F.when(~rejected, merged).alias("rows"), F.size(F.filter(repeats, lambda r: r)).alias("skipped_headers"))


def table_report(cell_rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Counts of each table's cells and span candidates."""
    a = cell_rows.groupBy("doc_id", "table_id").agg(F.count("*").alias("cells"), F.count(F.when(F.col("empty"), 1)).alias("empty_cells"), F.sum(F.size("locked_tokens")).alias("locked_tokens"), F.count(F.when(F.col("role") == "header", 1)).alias("header_cells"))
    b = spans.groupBy("doc_id", "table_id").agg(F.count("*").alias("span_candidates"), F.count(F.when(F.col("span_type") == "rowspan", 1)).alias("rowspans"))
    return a.join(b, ["doc_id", "table_id"], "left").fillna(0, ["span_candidates", "rowspans"])


def review_spans(spans: DataFrame, decisions: DataFrame) -> DataFrame:
    """spans with the latest decision on each and whether it keeps the table from being published. decisions: doc_id, table_id, span_type, row_index, column_index, ordinal, decision."""
    key = ["doc_id", "table_id", "span_type", "row_index", "column_index"]
    latest = decisions.groupBy(*key).agg(F.max_by("decision", "ordinal").alias("decision"))
    out = spans.join(latest, key, "left")
    return out.withColumn("publish_blocking", ~F.coalesce("decision", F.lit("pending")).isin("confirm", "reject"))


def table_summary(tables: DataFrame, cell_rows: DataFrame, spans: DataFrame, merged: DataFrame, notes: DataFrame, bindings: DataFrame) -> DataFrame:
    """Counts of a document's tables as long rows (doc_id, measure, key, value); measures that come to nothing have no row. merged: as merge_chains() gives it; notes: doc_id, table_id, note_id; bindings: as bind_footnotes() gives them."""
    on = lambda c: F.count_if(c)
    usable = (F.col("row_count") >= 2) & (F.col("column_count") >= 2)
    ragged_rows = F.size(F.filter("rows", lambda r: F.size(r) < F.col("column_count")))
    has_ragged = (ragged_rows > 0) | F.array_contains(F.coalesce("warnings", F.array().cast("array<string>")), "ragged_table_rows")
    bound = bindings.select("doc_id", "table_id", "note_id", "row_index", "column_index").distinct()
    by_note = notes.select("doc_id", "table_id", "note_id").distinct().join(bound.groupBy("doc_id", "table_id", "note_id").agg(F.count("*").alias("n")), ["doc_id", "table_id", "note_id"], "left")
    went_on = merged.where("merge_status = 'merged'").join(tables.select("doc_id", F.col("table_id").alias("chain"), F.col("row_count").alias("_first")), ["doc_id", "chain"], "left")
    wide = (
        (tables, {"tables": F.count("*"), "reconstructable_tables": on(usable), "ragged_tables": on(has_ragged), "ragged_rows": F.sum(ragged_rows), "ready_rate": on(usable) / F.count("*")}),
        (cell_rows, {"cells": F.count("*"), "empty_cells": on("empty"), "filled_cells": on(~F.col("empty")), "numeric_cells": on(F.size("numbers") > 0), "numbers": F.sum(F.size("numbers")), "units": F.sum(F.size("units")), "significance_marks": F.sum(F.size("significance"))}),
        (spans, {"span_candidates": F.count("*")}),
        (merged, {"chains": F.count("*"), "chain_tables": F.sum(F.size("table_ids")), "merged_chains": on(F.col("merge_status") == "merged"), "rejected_chains": on(F.col("merge_status") == "rejected"), "chain_warnings": F.sum(F.size("warnings"))}),
        (went_on, {"merged_rows": F.sum(F.size("rows")), "row_gain": F.sum(F.greatest(F.lit(0), F.size("rows") - F.coalesce("_first", F.lit(0))))}),
        (by_note, {"footnotes": F.count("*"), "bound_footnotes": on(F.col("n") > 0), "bound_cells": F.sum("n"), "unbound_footnotes": on(F.col("n").isNull())}),
    )
    long = None
    for df, measures in wide:
        items = F.array(*(F.struct(F.lit(name).alias("measure"), F.col(name).cast("double").alias("value")) for name in measures))
        part = df.groupBy("doc_id").agg(*(c.alias(name) for name, c in measures.items())).select("doc_id", F.explode(items).alias("x")).select("doc_id", "x.measure", F.lit("").alias("key"), "x.value")
        long = part if long is None else long.unionByName(part)
    kinds = lambda df, name, key: df.groupBy("doc_id", F.lit(name).alias("measure"), F.col(key).alias("key")).agg(F.count("*").cast("double").alias("value"))
    reasons = merged.select("doc_id", F.explode("reject_reasons").alias("reason"))
    warned = merged.select("doc_id", F.explode("warnings").alias("reason"))
    for part in (kinds(spans, "span_types", "span_type"), kinds(spans, "span_reasons", "reason"), kinds(spans, "span_confidence", "confidence"), kinds(reasons, "reject_reasons", "reason"), kinds(warned, "warning_reasons", "reason")):
        long = long.unionByName(part)
    return long.where("value > 0")

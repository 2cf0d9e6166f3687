"""The glossary: terms by page and scope, arrivals and conflicts, reviews, and chunks that decisions leave behind.

A term has ordinal, en, zh, first_page, source, status and section_scope (values parted by commas or semicolons, perhaps `section:`, `structure:` or `block:` before them; none means everywhere).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.matching import texts_with

MOST_TERMS = 40
# Prefixes of scopes.
SECTION, STRUCTURE, BLOCK = ("section", "sec", "chapter", "heading", "章节", "小节", "标题"), ("structure", "type", "block_type", "layout", "结构", "类型", "版式"), ("block", "block_id", "id", "块")
KINDS = {"body": "paragraph", "text": "paragraph", "正文": "paragraph", "段落": "paragraph", "title": "heading", "section": "heading", "标题": "heading", "章节": "heading", "tabular": "table", "表格": "table", "表": "table", "figure caption": "caption", "table caption": "caption", "图注": "caption", "表注": "caption", "图表注": "caption", "note": "footnote", "annotation": "footnote", "脚注": "footnote", "注释": "footnote", "equation": "formula", "math": "formula", "公式": "formula", "方程": "formula", "references": "reference", "bibliography": "reference", "参考文献": "reference", "figure": "image", "picture": "image", "图像": "image", "图片": "image", "图": "image"}


def scope_matches(scope: Column, sections: Column, types: Column, blocks: Column) -> Column:
    """Whether a term's scope fits a context (arrays of section headings, block types and block ids). No scope fits all, and so does an empty context."""
    tokens = F.filter(F.transform(F.split(F.coalesce(scope, F.lit("")), "[,，;；、|/\n]+"), lambda x: T.term_key(x)), lambda x: x != "")
    low = lambda a: F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: T.term_key(x))
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    kind = lambda v: F.coalesce(F.try_element_at(kinds, v), v)
    s, t, b = low(sections), F.transform(low(types), kind), low(blocks)
    near = lambda v: F.exists(s, lambda c: (c == v) | (F.size(F.array_except(F.split(v, " "), F.split(c, " "))) == 0) | ((F.length(v) >= 4) & F.contains(c, v)))

    def fits(token: Column) -> Column:
        marked = token.rlike("[:：=]")
        prefix = F.when(marked, F.trim(F.regexp_extract(token, "^([^:：=]*)[:：=]", 1))).otherwise("")
        value = F.when(marked, F.trim(F.regexp_extract(token, "^[^:：=]*[:：=](.*)$", 1))).otherwise(token)
        free = F.array_contains(b, value) | F.array_contains(t, kind(value)) | near(value)
        return (value != "") & F.when(prefix.isin(*BLOCK), (F.size(b) == 0) | F.array_contains(b, value)).when(prefix.isin(*STRUCTURE), (F.size(t) == 0) | F.array_contains(t, kind(value))).when(prefix.isin(*SECTION), (F.size(s) == 0) | near(value)).otherwise(free)

    return (F.size(tokens) == 0) | ((F.size(s) == 0) & (F.size(t) == 0) & (F.size(b) == 0)) | F.exists(tokens, fits)


def terms_for_pages(glossary: DataFrame, chunks: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """Up to `most` terms for each chunk (doc_id, chunk_id, first, last: pages from 1): those whose first page is in range, then those without a page, by ordinal."""
    usable = glossary.where(F.lower(F.trim(F.coalesce("status", F.lit("")))) != "rejected")
    paged = usable.where("first_page IS NOT NULL").join(chunks.withColumn("first_page", F.explode(F.sequence("first", "last"))), "first_page")
    anywhere = usable.where("first_page IS NULL").orderBy("ordinal").limit(most)  # no chunk takes more of them
    j = chunks.join(F.broadcast(anywhere), F.lit(True))
    j = j.unionByName(paged.select(*j.columns))
    w = Window.partitionBy("doc_id", "chunk_id").orderBy(F.col("first_page").isNull(), "ordinal")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def term_snippets(picked: DataFrame) -> DataFrame:
    """The picked terms of each chunk as lines for a prompt."""
    lines = F.sort_array(F.collect_list(F.when((F.col("en") != "") & (F.col("zh") != ""), F.struct("rank", F.concat(F.lit("- "), "en", F.lit(" → "), "zh").alias("line")))))
    return picked.groupBy("doc_id", "chunk_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("snippet"))


def merge_arrivals(existing: DataFrame, arrivals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The glossary with new terms, and what is to be reviewed: another translation of a known term, or a translation that another term has already. Both: ordinal, en, zh, first_page, source, status; the first arrival of a term counts.

    Terms that share neither key nor translation don't matter to each other, so conflicts and shared translations are two grouped folds in order of arrival and no fold sees the whole glossary."""
    have = existing.withColumn("_old", F.lit(True)).select("ordinal", "en", "zh", "first_page", "source", "status", "_old")
    new = arrivals.where((F.trim("en") != "") & (F.trim("zh") != "")).select("ordinal", F.trim("en").alias("en"), F.trim("zh").alias("zh"), "first_page", "source", F.lit("candidate").alias("status"), F.lit(False).alias("_old"))
    both = have.unionByName(new).withColumn("_key", T.term_key("en"))
    ranked = both.withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_old").orderBy("ordinal"))).withColumn("_known", F.bool_or(F.col("_old")).over(Window.partitionBy("_key")))
    added = ranked.where(~F.col("_old") & ~F.col("_known") & (F.col("_n") == 1))
    kept = ranked.where("_old").unionByName(added)
    values = kept.groupBy("_key").agg(F.array_sort(F.collect_set(F.trim("zh"))).alias("existing_zh"))
    late = ranked.where(~F.col("_old")).join(added.select("_key", F.col("ordinal").alias("_a")), "_key", "left").where(F.col("_a").isNull() | (F.col("ordinal") != F.col("_a")))
    conflicts = late.join(values, "_key").where(~F.array_contains("existing_zh", F.col("zh"))).select(F.lit("glossary_conflict").alias("type"), "en", F.col("zh").alias("candidate_zh"), F.col("existing_zh").alias("existing"), "first_page", "source", "ordinal")
    # a translation's terms in order of arrival, gathered once; each is reviewed beside those before it
    users = kept.groupBy(F.trim("zh")).agg(F.sort_array(F.collect_list(F.struct((~F.col("_old")).alias("new"), "ordinal", "en", "zh", "first_page", "source"))).alias("_all")).where(F.size("_all") > 1)
    late_users = users.select("_all", F.posexplode("_all").alias("_at", "x")).where("_at > 0 AND x.new").select("x.*", F.transform(F.slice("_all", F.lit(1), F.col("_at")), lambda x: x["en"]).alias("_before"))
    shared = late_users.select(F.lit("shared_translation_review").alias("type"), "en", F.col("zh").alias("candidate_zh"), F.col("_before").alias("existing"), "first_page", "source", "ordinal")
    return kept.select("ordinal", "en", "zh", "first_page", "source", "status"), conflicts.unionByName(shared).dropDuplicates(["type", "en", "candidate_zh"])


def conflicting_terms(glossary: DataFrame, pending: DataFrame) -> DataFrame:
    """Terms with more than one translation, in the glossary or waiting for review: en (lower case) and all translations."""
    inside = glossary.where(F.coalesce("status", F.lit("")) != "rejected").select(T.term_key("en").alias("en"), F.trim("zh").alias("zh"))
    waiting = pending.where(F.col("type") == "glossary_conflict").select(T.term_key("en").alias("en"), F.explode(F.array_union("existing", F.array("candidate_zh"))).alias("zh"))
    return inside.unionByName(waiting).where("zh <> ''").groupBy("en").agg(F.array_sort(F.collect_set("zh")).alias("translations")).where(F.size("translations") > 1)


def confirm_terms(glossary: DataFrame, decisions: DataFrame) -> DataFrame:
    """glossary after decisions (en, zh, ordinal): the first term that a decision names is confirmed, the other translations of it rejected."""
    last = decisions.groupBy(T.term_key("en").alias("_key")).agg(F.max_by("zh", "ordinal").alias("_zh"))
    g = glossary.withColumn("_key", T.term_key("en")).join(last, "_key", "left")
    g = g.withColumn("_hit", F.trim("zh") == F.trim("_zh")).withColumn("_n", F.row_number().over(Window.partitionBy("_key", "_hit").orderBy("ordinal")))
    decided = F.col("_zh").isNotNull()
    return g.withColumn("status", F.when(decided & F.col("_hit") & (F.col("_n") == 1), "confirmed").when(decided, "rejected").otherwise(F.col("status"))).select(*glossary.columns)


def review_counts(glossary: DataFrame, pending: DataFrame) -> DataFrame:
    """Terms by status and pending items by type, as long rows."""
    a = glossary.groupBy(F.coalesce("status", F.lit("candidate")).alias("key")).agg(F.count("*").alias("value")).select(F.lit("term_status").alias("group"), "key", "value")
    return a.unionByName(pending.groupBy(F.col("type").alias("key")).agg(F.count("*").alias("value")).select(F.lit("pending_type").alias("group"), "key", "value"))


def stale_chunks(confirmed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that confirmed terms make stale, with the terms and reasons: the translation is missing, lacks the confirmed one, or has a rejected one. confirmed: en, zh, rejected_zh, section_scope; chunks: doc_id, chunk_id, source, target, sections, types, block_ids."""
    j = texts_with(chunks.withColumn("_source", T.term_key("source")), confirmed.withColumn("_en", T.term_key("en")).where("_en <> ''"), "_source", "_en").drop("_source", "_en")
    j = j.where(T.holds_term("source", "en") & scope_matches(F.col("section_scope"), F.col("sections"), F.col("types"), F.col("block_ids")))
    old = F.exists(F.coalesce("rejected_zh", F.array().cast("array<string>")), lambda x: (x != "") & T.holds_translation("target", x))
    reason = F.when(F.col("target").isNull(), "missing_translation").when(~T.holds_translation("target", "zh") & old, "rejected_translation_present").when(~T.holds_translation("target", "zh"), "confirmed_translation_missing")
    rows = j.withColumn("reason", reason).where("reason IS NOT NULL")
    return rows.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_set("en")).alias("terms"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def translate_in_order(chunks: DataFrame, translate) -> DataFrame:
    """Chunks of each document translated in order, each with the source that the one before put off: translate(source, deferred) gives the translation and what it puts off. Sequential within a document, parallel over documents."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, carried, out = pdf.sort_values("ord", kind="stable"), "", []
        for row in pdf.to_dict("records"):
            target, carried = translate(row["text"] or "", carried)
            out.append({"doc_id": row["doc_id"], "ord": row["ord"], "target": target, "deferred": carried})
        return pd.DataFrame(out, columns=["doc_id", "ord", "target", "deferred"])

    kind = chunks.schema["doc_id"].dataType.simpleString()
    return chunks.select("doc_id", "ord", "text").groupBy("doc_id").applyInPandas(fold, f"doc_id {kind}, ord int, target string, deferred string")

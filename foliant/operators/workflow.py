"""Review, promotion and publishing: decisions as rows, states as ladders of conditions."""

from __future__ import annotations

import difflib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foliant.functions import text as T
from foliant.operators import translate

# Fixed values.
REVIEW_DECISIONS = ("accept_result", "reject", "needs_revision")
DIFF_LIMIT = 1800


def table_rows_from_text(text: Column | str, columns: Column | str) -> Column:
    """Rows of a table in running text, padded to `columns` at least: lines with bars, else lines that all have just that many parts; fewer than two rows are no table (null)."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    n = F.coalesce(F.col(columns) if isinstance(columns, str) else columns, F.lit(0))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    parts = lambda x, sep: F.transform(F.split(x, sep), lambda c: F.trim(c))
    full = lambda a: F.filter(a, lambda c: c != "")
    barred = F.transform(F.filter(lines, lambda x: F.contains(x, F.lit("|"))), lambda x: parts(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"))
    barred = F.filter(barred, lambda r: ~F.forall(r, lambda c: c.rlike("^[-: ]+$")))

    def spaced_row(x: Column) -> Column:
        wide = full(parts(x, r"\s{2,}"))
        return F.when(F.contains(x, F.lit("\t")), full(parts(x, "\t"))).when(F.size(wide) < n, full(parts(x, r"\s+"))).otherwise(wide)

    spaced = F.transform(lines, spaced_row)
    usable = (n >= 2) & (F.size(spaced) >= 2) & F.forall(spaced, lambda r: F.size(r) == n)
    rows = F.when(F.size(barred) >= 2, barred).when(usable, spaced)
    width = F.greatest(n, F.array_max(F.transform(rows, F.size)))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def column_sides(blocks: DataFrame, width: str = "width", least: int = 30) -> DataFrame:
    """For each page how many blocks of `least` characters or more have their centre left of 45 % and right of 55 % of its width."""
    centre = (F.col("bbox.x0") + F.col("bbox.x1")) / 2
    long = F.length(F.trim("text")) >= least
    return blocks.groupBy("doc_id", "page_no").agg(F.count(F.when(long & (centre < F.col(width) * 0.45), 1)).alias("left_blocks"), F.count(F.when(long & (centre > F.col(width) * 0.55), 1)).alias("right_blocks"))


@F.pandas_udf(StringType())
def _diff(before: pd.Series, after: pd.Series) -> pd.Series:
    def one(a: str | None, b: str | None) -> str:
        a, b = (a or "").strip(), (b or "").strip()
        return "" if a == b else "\n".join(difflib.unified_diff(a.splitlines(), b.splitlines(), "current", "repaired", lineterm=""))[:DIFF_LIMIT]

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)])


def with_diff(rows: DataFrame, before: str, after: str) -> DataFrame:
    """rows with the beginning of a unified diff of two texts."""
    return rows.withColumn("diff", _diff(before, after))


def promote(assessed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Assessed items with the candidate that they stand for and why they are left out (skip_reason, null where promoted).

    assessed: doc_id, task_id, block_id, page_no, target_index, status, preview; candidates: doc_id, block_id, page_no, index, task_id, text. The candidate at the target's index counts where its task or text agrees, else the first of the same task. Only status `candidate` is promoted."""
    own = candidates.select(F.col("doc_id").alias("_d"), F.col("block_id").alias("_b"), F.col("page_no").alias("_p"), "index", F.col("task_id").alias("_task"), F.col("text").alias("_text"))
    items = assessed.distinct()  # rows alike in all columns have the same candidate
    target = F.when(F.coalesce("block_id", F.lit("")) != "", F.col("block_id").eqNullSafe(F.col("_b"))).otherwise(F.col("_b").isNull() & (F.col("page_no") == F.col("_p")))
    j = items.join(own, (F.col("doc_id") == F.col("_d")) & target, "left")
    agrees = (F.col("index") == F.col("target_index")) & ((F.col("_task") == F.col("task_id")) | (F.trim("_text") == F.trim("preview")))
    rank = F.when(agrees, 0).when(F.col("_task") == F.col("task_id"), 1)
    best = j.groupBy(*assessed.columns).agg(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("r"), "index", "_text"))).alias("_best"))
    names = {c: f"_{i}_{c}" for i, c in enumerate(assessed.columns)}
    alike = [F.col(c).eqNullSafe(F.col(x)) for c, x in names.items()]
    out = assessed.join(best.withColumnsRenamed(names), alike).drop(*names.values())
    reason = F.when(F.col("status") != "candidate", F.concat(F.lit("status_"), "status")).when(F.col("_best").isNull(), "source_candidate_missing").when(F.trim("_best._text") == "", "empty_text")
    return out.withColumns({"promoted_text": F.when(reason.isNull(), F.col("_best._text")), "skip_reason": reason}).drop("_best")


def latest_decisions(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """reviews (review_id, ...) with their latest decision that counts: accepting needs a text, unknown decisions are none; a later empty decision takes an earlier one back. decisions: review_id, ordinal, decision, text."""
    d = F.lower(F.trim(F.coalesce("decision", F.lit(""))))
    valid = decisions.withColumn("decision", d).where((F.col("decision") == "") | (F.col("decision").isin(*REVIEW_DECISIONS) & ((F.col("decision") != "accept_result") | (F.trim(F.coalesce("text", F.lit(""))) != ""))))
    last = valid.groupBy("review_id").agg(F.max_by(F.struct("decision", "text"), "ordinal").alias("_l"))
    return reviews.join(last, "review_id", "left").withColumns({"decision": F.nullif("_l.decision", F.lit("")), "review_text": F.when(F.col("_l.decision") == "accept_result", F.trim("_l.text"))}).drop("_l")


def batch_decisions(batches: DataFrame, reviews: DataFrame) -> DataFrame:
    """Decisions of batches, each whole or not at all: one that accepts, or names an unknown review, gives none. batches: batch_id, ordinal, decision, review_ids."""
    each = batches.select("batch_id", "ordinal", "decision", F.explode(F.array_distinct("review_ids")).alias("review_id"))
    known = each.join(reviews.select("review_id", F.lit(True).alias("_known")).distinct(), "review_id", "left")
    sound = known.groupBy("batch_id").agg(F.bool_and(F.coalesce("_known", F.lit(False)) & (F.col("decision") != "accept_result")).alias("_ok"))
    return known.join(sound.where("_ok"), "batch_id", "left_semi").select("review_id", "ordinal", "decision", F.lit(None).cast("string").alias("text"))


def execute_requests(requests: DataFrame, backend: Callable[[], Callable[[str], str]], most: int | None = None) -> DataFrame:
    """Sends the requests that are ready to a backend, the first `most` by id where given; others get status skipped. requests: doc_id, chunk_id, request_id, status, text."""
    ready = requests.where(F.col("status") == "ready_for_translation_backend")
    if most is not None:
        w = Window.partitionBy("doc_id").orderBy("request_id")
        ready = ready.withColumn("_n", F.row_number().over(w))
        over = ready.where(F.col("_n") > most).drop("_n").withColumn("result", F.lit("skipped_by_limit"))
        ready = ready.where(F.col("_n") <= most).drop("_n")
    else:
        over = ready.limit(0).withColumn("result", F.lit(""))
    done = translate.translate(ready, backend).withColumnRenamed("target", "candidate")
    done = done.withColumn("result", F.when(F.col("candidate").isNull(), "failed").otherwise("succeeded"))
    rest = requests.where(F.col("status") != "ready_for_translation_backend").withColumn("result", F.lit("skipped_not_ready"))
    return done.unionByName(over, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)


def publish_status(rows: DataFrame) -> DataFrame:
    """rows (confirm, source_present, target_given, applied, review_blocking, manual_required, conflicts) with the status of publishing; the first hindrance counts."""
    c = F.col
    status = F.when(~c("confirm"), "pending_confirmation").when(~c("source_present"), "blocked_missing_repaired_full").when(~c("target_given"), "blocked_missing_publish_target").when(c("applied") <= 0, "blocked_no_applied_repairs").when(c("review_blocking") > 0, "blocked_patch_review").when(c("manual_required") + c("conflicts") > 0, "published_with_warnings").otherwise("published")
    return rows.withColumn("publish_status", status).withColumn("published", F.col("publish_status").startswith("published"))


def rollback_status(rows: DataFrame) -> DataFrame:
    """rows (confirm, published, original_present, published_present, target_given) with the status of a rollback."""
    c = F.col
    ready = c("published") & c("original_present") & c("published_present")
    status = F.when(~c("confirm"), F.when(ready, "pending_confirmation").otherwise("not_ready")).when(~c("published"), "blocked_unpublished").when(~c("original_present"), "blocked_missing_original").when(~c("published_present"), "blocked_missing_published").when(~c("target_given"), "blocked_missing_rollback_target").otherwise("rolled_back")
    return rows.withColumn("rollback_status", status)


def replace_status(rows: DataFrame) -> DataFrame:
    """rows (confirm, published, current, expected, replacement: texts) with whether a formal copy may be replaced: only where it still is what was reviewed."""
    same = F.sha2(F.coalesce("current", F.lit("")), 256) == F.sha2(F.coalesce("expected", F.lit("")), 256)
    done = F.sha2(F.coalesce("current", F.lit("")), 256) == F.sha2(F.coalesce("replacement", F.lit("")), 256)
    return rows.withColumn("replace_status", F.when(~F.col("confirm"), "pending_confirmation").when(~F.col("published"), "blocked_unpublished").when(F.col("replacement").isNull(), "blocked_missing_replacement").when(done, "already_replaced").when(~same, "blocked_content_changed").otherwise("replaced"))


def table_publish(reviewed: DataFrame, confirmed: DataFrame) -> DataFrame:
    """For each table whether its reviewed structure is published: only where that was confirmed and no review blocks it. reviewed: doc_id, table_id, publish_blocking; confirmed: doc_id, table_id, confirm."""
    n = reviewed.groupBy("doc_id", "table_id").agg(F.count("*").alias("reviews"), F.count(F.when(F.col("publish_blocking"), 1)).alias("blocking"))
    j = n.join(confirmed, ["doc_id", "table_id"], "left").withColumn("confirm", F.coalesce("confirm", F.lit(False)))
    return j.withColumn("status", F.when(F.col("confirm") & (F.col("blocking") == 0), "published").when(F.col("confirm"), "blocked_review_required").otherwise("pending_confirmation"))


def effective_cells(original: DataFrame, published: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells as they count: the published structure's for tables that are published, else the original ones."""
    out = tables.where(F.col("status") == "published").select("doc_id", "table_id")
    key = ["doc_id", "table_id"]
    return published.join(out, key, "left_semi").unionByName(original.join(out, key, "left_anti"), allowMissingColumns=True)


def retranslation_plan(stale: DataFrame, chunks: DataFrame, mode: str = "stale_only", selected: list[str] | None = None, most: int | None = None) -> DataFrame:
    """The chunks to translate anew, by chunk id, with why any can't be or isn't: chunks beyond `most` of a document, without a source, or unknown. stale: doc_id, chunk_id, terms; chunks: doc_id, chunk_id, source."""
    if mode not in ("stale_only", "selected") or (mode == "selected" and not selected):
        raise ValueError("mode is stale_only, or selected with chunk ids")
    if mode == "selected":
        spark = stale.sparkSession
        wanted = spark.createDataFrame([(c,) for c in dict.fromkeys(selected)], "chunk_id string").join(stale.select("doc_id").unionByName(chunks.select("doc_id")).distinct(), how="cross").join(stale, ["doc_id", "chunk_id"], "left")
    else:
        wanted = stale
    j = wanted.join(chunks.select("doc_id", "chunk_id", "source", F.lit(True).alias("_there")), ["doc_id", "chunk_id"], "left")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id"))
    j = j.withColumn("_n", n)
    limit = F.lit(False) if not most else F.col("_n") > most
    return j.withColumn("status", F.when(limit, "skipped_by_limit").when(F.col("_there").isNull(), "chunk_not_found_in_manifest").when(F.trim(F.coalesce("source", F.lit(""))) == "", "source_text_missing").otherwise("planned")).drop("_n", "_there")


def structure_hints(relations: DataFrame, cells: DataFrame, entities: DataFrame, chunks: DataFrame, tables: int = 3, most_cells: int = 18, most_relations: int = 6, most_entities: int = 12) -> DataFrame:
    """For each chunk how many tables, cells, relations and entities its prompt gets, within the caps. relations and entities: doc_id, block_id, ...; cells: doc_id, table_id, row_index, column_index; chunks: doc_id, chunk_id, block_ids."""
    at = chunks.select("doc_id", "chunk_id", F.explode("block_ids").alias("block_id"))

    def capped(df: DataFrame, key: str, most: int, name: str) -> DataFrame:
        return at.join(df.withColumnRenamed(key, "block_id"), ["doc_id", "block_id"]).groupBy("doc_id", "chunk_id").agg(F.least(F.count("*"), F.lit(most)).alias(name))

    per_table = cells.groupBy("doc_id", "table_id").agg(F.least(F.count("*"), F.lit(most_cells)).alias("_cells"))
    w = Window.partitionBy("doc_id", "chunk_id").orderBy("block_id")
    own = at.join(per_table.withColumnRenamed("table_id", "block_id"), ["doc_id", "block_id"]).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= tables).groupBy("doc_id", "chunk_id").agg(F.count("*").alias("tables"), F.sum("_cells").alias("cells"))
    out = chunks.select("doc_id", "chunk_id").join(own, ["doc_id", "chunk_id"], "left")
    for df, key, most, name in ((relations, "block_id", most_relations, "relations"), (entities, "block_id", most_entities, "entities")):
        out = out.join(capped(df, key, most, name), ["doc_id", "chunk_id"], "left")
    return out.fillna(0)


def status_counts(rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """How often each value of several columns occurs, arrays by their items, as long rows."""
    parts = []
    for c in columns:
        value = F.explode(c) if rows.schema[c].dataType.typeName() == "array" else F.col(c)
        parts.append(rows.select(*keys, value.cast("string").alias("key") if rows.schema[c].dataType.typeName() != "array" else value.alias("key")).where("key IS NOT NULL").groupBy(*keys, F.lit(c).alias("group"), "key").agg(F.count("*").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def artifact_status(jobs: DataFrame, found: DataFrame, wanted: list[str]) -> DataFrame:
    """For each job which artifacts it has and lacks. found: job_id, name, n_bytes."""
    names = F.array(*(F.lit(w) for w in wanted))
    have = found.where(F.col("name").isin(*wanted)).groupBy("job_id").agg(F.array_sort(F.collect_set("name")).alias("present"), F.sum("n_bytes").alias("n_bytes"))
    return jobs.join(have, "job_id", "left").withColumn("present", F.coalesce("present", F.array().cast("array<string>"))).withColumn("absent", F.array_except(names, F.col("present"))).fillna(0, ["n_bytes"])


def glossary_key(rows: DataFrame) -> DataFrame:
    """Items for review once each: by kind, term and translation."""
    key = F.concat_ws(":", "type", T.term_key("en"), F.trim("candidate_zh"))
    w = Window.partitionBy("_k").orderBy("ordinal")
    return rows.withColumn("_k", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumnRenamed("_k", "dedupe_key").drop("_n")

"""Jobs: favourites, stale ones, what is on disk and what is known, how far runs came, and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MOST_FAVORITES, STALE_HOURS = 3, 24


def favorites(jobs: DataFrame, marks: DataFrame, user_id, limit: int = 100) -> DataFrame:
    """A user's favourite jobs, the latest favourite first."""
    own = marks.where(F.col("user_id") == user_id)
    return jobs.join(own, ["job_id", "user_id"]).orderBy(F.desc("favorited_at"), "job_id").limit(limit)


def not_favorites(jobs: DataFrame, marks: DataFrame, user_id, limit: int = 100) -> DataFrame:
    """A user's other jobs, the latest first."""
    return jobs.where(F.col("user_id") == user_id).join(marks.where(F.col("user_id") == user_id).select("job_id"), "job_id", "left_anti").orderBy(F.desc("created_at"), "job_id").limit(limit)


def favorite_counts(marks: DataFrame) -> DataFrame:
    return marks.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("full", F.col("n") >= MOST_FAVORITES)


def stale_jobs(jobs: DataFrame, marks: DataFrame, now: Column, hours: int = STALE_HOURS) -> DataFrame:
    """Jobs older than the cutoff that their user has not marked; a time that can't be read is not stale."""
    old = jobs.where(F.col("created_at").try_cast("timestamp") < now - F.make_interval(hours=F.lit(hours)))
    return old.join(marks, ["user_id", "job_id"], "left_anti")


def drift(index: DataFrame, found: DataFrame, key: str = "job_id") -> DataFrame:
    """Keys on one side only: indexed without a directory, or a directory without an entry."""
    a, b = index.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("drift", F.lit("missing_on_disk")).unionByName(b.join(a, key, "left_anti").withColumn("drift", F.lit("missing_in_index")))


def with_status(jobs: DataFrame, runtime: DataFrame) -> DataFrame:
    """jobs with their status at run time, `unknown` where there is none."""
    return jobs.join(runtime.select("job_id", "status"), "job_id", "left").fillna("unknown", ["status"])


def progress(jobs: DataFrame, chunks: DataFrame, completed: DataFrame) -> DataFrame:
    """How far each job's run came, what it warns of, and whether it can go on. jobs: job_id, status, recovered, state_file (valid, invalid or missing); chunks: job_id, chunk_id; completed: job_id, chunk_id."""
    done = completed.select("job_id", "chunk_id").distinct()
    total = chunks.groupBy("job_id").agg(F.countDistinct("chunk_id").alias("total"))
    count = done.groupBy("job_id").agg(F.count("*").alias("completed"))
    left = chunks.select("job_id", "chunk_id").distinct().join(done, ["job_id", "chunk_id"], "left_anti").groupBy("job_id").agg(F.count("*").alias("pending"), F.array_sort(F.collect_list("chunk_id")).alias("pending_ids"))
    j = jobs.join(total, "job_id", "left").join(count, "job_id", "left").join(left, "job_id", "left").fillna(0, ["completed", "pending"])
    n, t = F.col("completed"), F.col("total")
    state = F.when(F.col("state_file") == "missing", "missing").when(F.col("state_file") == "invalid", "invalid").when(t.isNotNull(), F.when(n >= t, "complete").when(n > 0, "partial").otherwise("empty")).otherwise(F.when(n > 0, "partial_unknown_total").otherwise("empty_unknown_total"))
    j = j.withColumn("state", state)
    active = F.col("status").isin("queued", "running")
    on = lambda c, name: F.when(c, F.lit(name))
    j = j.withColumn("warnings", F.array_compact(F.array(on((F.col("status") == "done") & ~F.col("state").isin("complete", "partial_unknown_total"), "runtime_done_pipeline_incomplete"), on(active & F.col("recovered"), "recovered_active_without_worker"), on(active & (F.col("state") == "complete"), "runtime_active_pipeline_complete"))))
    ready = (n > 0) & ~F.col("state").isin("complete", "invalid")
    recovery = F.when(F.array_contains("warnings", "recovered_active_without_worker"), "needs_manual_resume_or_cancel").when(ready, "resume_available").when(F.col("state") == "complete", "complete").when(F.col("state").isin("missing", "invalid"), "not_ready").otherwise("not_started")
    return j.withColumns({"ratio": F.when(t > 0, F.least(n, t) / t), "resume_ready": ready, "recovery": recovery})


def requeue(jobs: DataFrame) -> DataFrame:
    """jobs with what keeps each from being queued again, and the action. jobs: status, recovered, input_present, cancel_requested, custom_api, backend, pages_per_chunk, overlap_pages."""
    on = lambda c, name: F.when(c, F.lit(name))
    blockers = F.array_compact(F.array(
        on(~F.col("recovered"), "not_recovered_from_disk"),
        on(~F.col("status").isin("queued", "running"), "not_active_status"),
        on(~F.col("input_present"), "input_pdf_missing"),
        on(F.col("cancel_requested"), "cancel_requested"),
        on(F.col("custom_api"), "custom_api_not_resumable"),
        on(F.trim(F.coalesce("backend", F.lit(""))) == "", "backend_missing"),
        on(~F.col("pages_per_chunk").between(1, 3), "pages_per_chunk_invalid"),
        on((F.col("overlap_pages") < 0) | (F.col("overlap_pages") >= F.col("pages_per_chunk")), "overlap_pages_invalid"),
    ))
    active = F.col("recovered") & F.col("status").isin("queued", "running")
    return jobs.withColumn("blockers", blockers).withColumn("action", F.when(active & (F.size("blockers") == 0), "requeueable").when(active, "manual_required").otherwise("not_applicable"))


def audit_page(events: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the trail, the latest first, with a sentence on each event. events: id, created_at, username, action, detail_json, job_id."""
    name = F.coalesce(F.nullif(F.trim("username"), F.lit("")), F.lit("someone"))
    file = F.coalesce(F.nullif(F.get_json_object("detail_json", "$.filename"), F.lit("")), F.get_json_object("detail_json", "$.name"), F.lit("a document"))
    says = F.when(F.col("action") == "login_success", F.concat(name, F.lit(" logged in"))).when(F.col("action") == "login_fail", F.concat(name, F.lit(" failed to log in"))).when(F.col("action") == "register", F.concat(name, F.lit(" registered"))).when(F.col("action") == "job_submit", F.concat(name, F.lit(" submitted "), file)).when(F.col("action") == "job_done", F.concat(F.lit("job "), F.coalesce("job_id", F.lit("")), F.lit(" is done"))).otherwise(F.concat(name, F.lit(": "), "action"))
    return events.withColumn("summary", says).orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def completed_span(chunks: DataFrame, completed: DataFrame) -> DataFrame:
    """First and last ordinal of each document's completed chunks, for names of downloads."""
    return chunks.join(completed.select("doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"], "left_semi").groupBy("doc_id").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count("*").alias("chunks"))


def upsert(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """rows after changes (the same columns and ordinal) by keys: the last change of a key replaces its row or adds one."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "ordinal").alias("_row")).select("_row.*")
    return rows.join(last.select(*keys), keys, "left_anti").unionByName(last)


def without_jobs(jobs: DataFrame, marks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """jobs and their favourites without the jobs in gone (job_id)."""
    ids = gone.select("job_id").distinct()
    return jobs.join(ids, "job_id", "left_anti"), marks.join(ids, "job_id", "left_anti")


def unmark(jobs: DataFrame, marks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """jobs and favourites after favourites in gone (user_id, job_id, at) were given up: such a job of the user counts as made at that time, so that it isn't stale at once."""
    keys = ["user_id", "job_id"]
    last = gone.groupBy(*keys).agg(F.max("at").alias("_at"))
    kept = jobs.join(last, keys, "left").withColumn("created_at", F.coalesce("_at", "created_at")).drop("_at")
    return kept.select(*jobs.columns), marks.join(last, keys, "left_anti")


def mark(marks: DataFrame, wanted: DataFrame, most: int = MOST_FAVORITES) -> DataFrame:
    """marks with those wanted (the same columns), in order of time, as long as their user has fewer than `most`; one that is there already changes nothing."""
    keys = ["user_id", "job_id"]
    new = wanted.groupBy(*keys).agg(F.min("favorited_at").alias("favorited_at")).join(marks.select(*keys), keys, "left_anti")
    held = marks.groupBy("user_id").agg(F.count("*").alias("_held"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("favorited_at", "job_id"))
    fits = new.join(held, "user_id", "left").withColumn("_place", place).where(F.col("_place") + F.coalesce("_held", F.lit(0)) <= most)
    return marks.select(*keys, "favorited_at").unionByName(fits.select(*keys, "favorited_at"))

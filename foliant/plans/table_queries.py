"""Queries on the relational tables, in the parts of jobs, reviews, terms, runs and experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import experiments, jobs, memory, metrics, quality, vision
from foliant.sources import readers

USER = 7
PRICES = {"currency": "usd", "backends": {"R:F": {"input_per_1m_tokens": 3.0, "per_request": 0.25}, "A": {"input_per_1m_tokens": 2.0, "output_per_1m_tokens": 4.0}, "O": {"output_per_1m_chars": 8.0}, "default": {"per_request": 0.5}}}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _jobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _table(spark, sf_dir, "orders")
    all_jobs = orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"))
    marks = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("favorited_at"))
    return all_jobs, marks


def favorite_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.favorites(*_jobs(spark, sf_dir), USER).select("job_id", "user_id")


def other_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.not_favorites(*_jobs(spark, sf_dir), USER).select("job_id", "user_id")


def favorite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.favorite_counts(_jobs(spark, sf_dir)[1])


def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_jobs, marks = _jobs(spark, sf_dir)
    return jobs.stale_jobs(all_jobs, marks, F.lit("1996-01-01").cast("timestamp")).groupBy("user_id").agg(F.count("*").alias("n"))


def job_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as the index, every other number up to twice the last part as directories."""
    return jobs.drift(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")), _table(spark, sf_dir, "part").select((F.col("p_partkey") * 2).alias("job_id")))


def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.col("user_id").cast("string").alias("username"), F.col("event_type").alias("action"), F.col("props").alias("detail_json"), F.lit(None).cast("string").alias("job_id"))
    return jobs.audit_page(events, 50, 10).select("id", "summary")


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs and their lines as chunks, those that are billed (F) as completed."""
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("string").alias("chunk_id"), "l_linestatus")
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("recovered"), F.lit("valid").alias("state_file"))
    got = jobs.progress(orders, lines, lines.where("l_linestatus = 'F'"))
    return got.select("job_id", "completed", "pending", "state", "recovery", F.array_join("warnings", ",").alias("warnings"))


def stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select(F.to_date("ts").cast("string").alias("run_id"), F.col("event_type").alias("phase"), F.when(F.col("value") < 0, "stage_error").otherwise("stage").alias("event_type"), F.get_json_object("props", "$.k").alias("elapsed_ms"))
    return metrics.stage_metrics(events, ["run_id"])


def run_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as usage, priced by flag and status, the closest price first."""
    lines = _table(spark, sf_dir, "lineitem")
    usage = lines.groupBy(F.col("l_returnflag").alias("backend"), F.col("l_linestatus").alias("model")).agg(F.sum("l_quantity").cast("long").alias("request_tokens"), F.count("*").alias("translated_tokens"), F.sum("l_linenumber").alias("request_chars"), F.max("l_orderkey").alias("translated_chars"), F.count("*").alias("requests"), F.sum(F.when(F.col("l_linenumber") == 1, 1).otherwise(0)).alias("http_attempts"))
    got = metrics.estimate_cost(usage, readers.prices(spark, PRICES))
    return got.select("backend", "model", "profile_key", "billable_requests", "input_token_cost", "output_token_cost", "request_cost")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as samples, kinds of events as variants, users' numbers as a metric."""
    events = _table(spark, sf_dir, "events")
    day = events.groupBy(F.to_date("ts").cast("string").alias("sample_id"), F.col("event_type").alias("variant")).agg(F.count("*").cast("double").alias("n"), F.countDistinct("user_id").cast("double").alias("users"))
    runs = day.select("sample_id", "variant", F.lit("succeeded").alias("status"), F.create_map(F.lit("events"), F.create_map(F.lit("n"), F.col("n"), F.lit("users"), F.col("users"))).alias("metrics"))
    return experiments.unpivot_metrics(runs, [("events", "n"), ("events", "users"), ("events", "absent")])


def variant_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.variant_means(_long(spark, sf_dir))


def baseline_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.baseline_deltas(_long(spark, sf_dir), "click").drop("value")


def merged_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", F.create_map(F.col("event_type"), F.get_json_object("props", "$.k").cast("long")).alias("counts"))
    return experiments.merge_counters(events, ["user_id"], "counts")


def review_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return experiments.review_groups(rows, "source", ["quality"], ["toxic"], [])


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return experiments.ranked(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).drop("o_totalprice")


def terms_for_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as terms with their size as first page, nations as chunks of six pages."""
    terms = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("en"), F.col("p_type").alias("zh"), F.when(F.col("p_size") % 10 == 0, None).otherwise(F.col("p_size")).alias("first_page"), F.when(F.col("p_partkey") % 7 == 0, "rejected").otherwise("candidate").alias("status"))
    chunks = _table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("chunk_id"), F.col("n_nationkey").alias("first"), (F.col("n_nationkey") + 5).alias("last"))
    return memory.terms_for_pages(terms, chunks).select("chunk_id", "ordinal", "rank")


def glossary_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as terms and types as translations, in order of arrival: the first of each stays."""
    arrivals = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("en"), F.col("p_type").alias("zh"), F.col("p_size").alias("first_page"), F.lit("survey").alias("source"), F.lit(None).cast("string").alias("status"))
    return memory.merge_arrivals(arrivals.limit(0), arrivals)[0].select("ordinal", "en", "zh", "status")


def conflicting_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("en"), F.col("p_type").alias("zh"), F.lit("candidate").alias("status"))
    none = spark.createDataFrame([], "type string, en string, candidate_zh string, existing array<string>")
    return memory.conflicting_terms(terms, none).select("en", F.size("translations").cast("long").alias("n"), F.array_join("translations", "|").alias("translations"))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_nationkey").alias("task_id"), F.col("c_name").alias("v"))
    override = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ordinal"), (F.col("s_nationkey") * 2).alias("task_id"), F.col("s_name").alias("v"))
    return vision.upsert_results(base, override).select("task_id", "v")


def repair_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of odd and even days as issues before and after, by user."""
    events = _table(spark, sf_dir, "events").select(F.col("user_id"), (F.dayofmonth("ts") % 2).alias("odd"))
    return quality.effectiveness(events.where("odd = 1"), events.where("odd = 0"), ["user_id"])


def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as issues, by source and verdict, with all sums."""
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    found = rows.select("doc_id", F.lit("c").alias("chunk_id"), F.col("source").alias("issue_type"), F.col("quality").cast("string").alias("severity"))
    return quality.issue_report(found).withColumn("by", F.col("by").cast("long"))


def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels")
    found = rows.select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.when(F.col("toxic") == 1, "missing_numbers").when(F.col("quality") == 0, "duplicate_paragraphs").otherwise("unheard_of").alias("issue_type"), F.when(F.col("quality") == 0, "medium").otherwise("low").alias("severity"))
    return quality.repair_plan(found).select("doc_id", "repair_id", "priority", "action", "executor")


QUERIES = {f.__name__: f for f in (favorite_jobs, other_jobs, favorite_counts, stale_jobs, job_drift, audit_page, job_progress, stage_metrics, run_costs, variant_means, baseline_deltas, merged_counters, review_rollup, top_orders, terms_for_pages, glossary_arrivals, conflicting_terms, upserted, repair_effect, issue_report, repair_plan)}

_DAYS = "SELECT strftime(ts, '%Y-%m-%d') AS sample_id, event_type AS variant, count(*)::DOUBLE AS n, count(DISTINCT user_id)::DOUBLE AS users FROM events GROUP BY ALL"
_METRICS = f"SELECT sample_id, variant, 'events' AS metric_group, field, value FROM (SELECT *, 0.0::DOUBLE AS absent FROM ({_DAYS})) UNPIVOT (value FOR field IN (n, users, absent))"

SQL = {
    "favorite_jobs": f"SELECT o_orderkey AS job_id, o_custkey AS user_id FROM orders WHERE o_custkey = {USER} AND o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "other_jobs": f"SELECT o_orderkey AS job_id, o_custkey AS user_id FROM orders WHERE o_custkey = {USER} AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey = {USER} AND o_orderpriority = '1-URGENT') ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "favorite_counts": "SELECT o_custkey AS user_id, count(*) AS n, count(*) >= 3 AS full FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey",
    "stale_jobs": "SELECT o_custkey AS user_id, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderdate < TIMESTAMP '1996-01-01' - INTERVAL 24 HOUR GROUP BY o_custkey",
    "job_drift": "SELECT c_custkey AS job_id, 'missing_on_disk' AS drift FROM customer WHERE c_custkey NOT IN (SELECT p_partkey * 2 FROM part) UNION ALL SELECT p_partkey * 2, 'missing_in_index' FROM part WHERE p_partkey * 2 NOT IN (SELECT c_custkey FROM customer)",
    "audit_page": "SELECT event_id AS id, user_id || ': ' || event_type AS summary FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 10",
    "job_progress": """
        WITH c AS (SELECT l_orderkey AS job_id, count(DISTINCT l_linenumber) AS total, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS completed,
                          count(DISTINCT l_linenumber) - count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_linenumber END) AS pending FROM lineitem GROUP BY 1),
        j AS (SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'running' END AS status, o_orderpriority = '1-URGENT' AS recovered, total, coalesce(completed, 0) AS completed, coalesce(pending, 0) AS pending FROM orders LEFT JOIN c ON job_id = o_orderkey),
        s AS (SELECT *, CASE WHEN total IS NOT NULL THEN CASE WHEN completed >= total THEN 'complete' WHEN completed > 0 THEN 'partial' ELSE 'empty' END WHEN completed > 0 THEN 'partial_unknown_total' ELSE 'empty_unknown_total' END AS state FROM j)
        SELECT job_id, completed, pending, state,
               CASE WHEN status IN ('queued', 'running') AND recovered THEN 'needs_manual_resume_or_cancel' WHEN completed > 0 AND state <> 'complete' THEN 'resume_available' WHEN state = 'complete' THEN 'complete' ELSE 'not_started' END AS recovery,
               array_to_string(list_filter([CASE WHEN status = 'done' AND state NOT IN ('complete', 'partial_unknown_total') THEN 'runtime_done_pipeline_incomplete' END, CASE WHEN status IN ('queued', 'running') AND recovered THEN 'recovered_active_without_worker' END, CASE WHEN status IN ('queued', 'running') AND state = 'complete' THEN 'runtime_active_pipeline_complete' END], lambda x: x IS NOT NULL), ',') AS warnings
        FROM s""",
    "stage_metrics": "SELECT strftime(ts, '%Y-%m-%d') AS run_id, event_type AS phase, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS elapsed_ms, count(*) AS stages, count(CASE WHEN value < 0 THEN 1 END) AS failed FROM events GROUP BY ALL",
    "run_costs": """
        WITH u AS (SELECT l_returnflag AS backend, l_linestatus AS model, sum(l_quantity)::BIGINT AS request_tokens, count(*) AS requests, sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)::BIGINT AS http_attempts FROM lineitem GROUP BY ALL),
        k AS (SELECT *, CASE WHEN lower(backend) = 'r' AND lower(model) = 'f' THEN 'r:f' WHEN lower(model) = 'o' THEN 'o' WHEN lower(model) = 'a' THEN 'a' WHEN lower(backend) = 'a' THEN 'a' WHEN lower(backend) = 'o' THEN 'o' ELSE 'default' END AS profile_key FROM u),
        b AS (SELECT *, CASE WHEN http_attempts > 0 THEN http_attempts ELSE requests END AS billable_requests FROM k)
        SELECT backend, model, profile_key, billable_requests,
               request_tokens / 1000000 * (CASE profile_key WHEN 'r:f' THEN 3.0 WHEN 'a' THEN 2.0 ELSE 0.0 END)::DOUBLE AS input_token_cost,
               requests / 1000000 * (CASE profile_key WHEN 'a' THEN 4.0 ELSE 0.0 END)::DOUBLE AS output_token_cost,
               billable_requests * (CASE profile_key WHEN 'r:f' THEN 0.25 WHEN 'default' THEN 0.5 ELSE 0.0 END)::DOUBLE AS request_cost FROM b""",
    "variant_means": f"SELECT variant, metric_group, field, avg(value) AS mean, count(value) AS runs FROM ({_METRICS}) GROUP BY ALL",
    "baseline_deltas": f"SELECT a.sample_id, a.variant, a.metric_group, a.field, a.value - b.value AS delta FROM ({_METRICS}) a JOIN ({_METRICS}) b ON a.sample_id = b.sample_id AND a.field = b.field AND b.variant = 'click' WHERE a.variant <> 'click'",
    "merged_counters": "SELECT user_id, event_type AS key, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS value FROM events GROUP BY ALL",
    "review_rollup": """
        WITH r AS (SELECT source, avg(quality::DOUBLE) AS mean, count(quality)::DOUBLE AS n, count(CASE WHEN toxic = 1 THEN 1 END)::DOUBLE AS yes, count(CASE WHEN toxic = 0 THEN 1 END)::DOUBLE AS no FROM labels JOIN documents USING (doc_id) GROUP BY source)
        SELECT source AS "group", 'quality' AS measure, 'mean' AS key, mean AS value FROM r UNION ALL SELECT source, 'quality', 'count', n FROM r UNION ALL SELECT source, 'toxic', 'yes', yes FROM r UNION ALL SELECT source, 'toxic', 'no', no FROM r""",
    "top_orders": "SELECT o_custkey, o_orderkey, rank::INTEGER AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "terms_for_pages": """
        SELECT chunk_id, ordinal, rank::INTEGER AS rank FROM (
            SELECT n_nationkey AS chunk_id, p_partkey AS ordinal, row_number() OVER (PARTITION BY n_nationkey ORDER BY p_size % 10 = 0, p_partkey) AS rank
            FROM nation JOIN part ON p_partkey % 7 <> 0 AND (p_size % 10 = 0 OR p_size BETWEEN n_nationkey AND n_nationkey + 5)) WHERE rank <= 40""",
    "glossary_arrivals": "SELECT p_partkey AS ordinal, trim(p_brand) AS en, trim(p_type) AS zh, 'candidate' AS status FROM (SELECT *, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) AS n FROM part) WHERE n = 1",
    "conflicting_terms": "SELECT lower(p_brand) AS en, count(DISTINCT p_type) AS n, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS translations FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1",
    "upserted": """
        WITH o AS (SELECT task_id, v FROM (SELECT s_nationkey * 2 AS task_id, s_name AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) AS n FROM supplier) WHERE n = 1),
        b AS (SELECT c_nationkey AS task_id, c_name AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer)
        SELECT task_id, v FROM b WHERE NOT (n = 1 AND task_id IN (SELECT task_id FROM o)) UNION ALL SELECT task_id, v FROM o""",
    "repair_effect": """
        WITH a AS (SELECT user_id, count(CASE WHEN day(ts) % 2 = 1 THEN 1 END) AS before_count, count(CASE WHEN day(ts) % 2 = 0 THEN 1 END) AS after_count FROM events GROUP BY user_id)
        SELECT user_id, before_count, after_count, before_count - after_count AS delta, CASE WHEN before_count = 0 THEN 0.0::DOUBLE ELSE (before_count - after_count) / before_count END AS reduction_rate,
               CASE WHEN before_count > 0 AND after_count = 0 THEN 'resolved' WHEN before_count = 0 AND after_count > 0 THEN 'regressed' WHEN after_count < before_count THEN 'improved' WHEN after_count > before_count THEN 'worsened' WHEN after_count > 0 THEN 'persisted' ELSE 'clean' END AS status FROM a""",
    "issue_report": "SELECT source AS issue_type, quality::VARCHAR AS severity, grouping(source, quality)::BIGINT AS by, count(DISTINCT doc_id) AS chunks, count(*) AS issues FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((source, quality), (source), (quality), ())",
    "repair_plan": """
        SELECT doc_id, 'r0001' AS repair_id, CASE WHEN severity = 'medium' THEN 'P1' ELSE 'P2' END AS priority,
               CASE kind WHEN 'missing_numbers' THEN 'rewrite_with_locked_tokens' WHEN 'duplicate_paragraphs' THEN 'deduplicate_overlap' ELSE 'manual_review' END AS action,
               CASE kind WHEN 'missing_numbers' THEN 'translation_backend' WHEN 'duplicate_paragraphs' THEN 'local_rule' ELSE 'human_review' END AS executor
        FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'missing_numbers' WHEN quality = 0 THEN 'duplicate_paragraphs' ELSE 'unheard_of' END AS kind, CASE WHEN quality = 0 THEN 'medium' ELSE 'low' END AS severity FROM labels)""",
}

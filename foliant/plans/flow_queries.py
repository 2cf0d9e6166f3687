"""Queries on repairs, reviews, glossary decisions, jobs and samples, made of the driver's relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import experiments, jobs, memory, quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as results of repairs: chunks are suppliers, flags their validation."""
    lines = _table(spark, sf_dir, "lineitem")
    validation = F.when(F.col("l_returnflag") == "N", "passed").when(F.col("l_returnflag") == "A", "failed").otherwise("unchecked")
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.pmod("l_suppkey", F.lit(3)).cast("string").alias("chunk_id"), F.format_string("rq%04d", "l_linenumber").alias("request_id"), validation.alias("validation"), "l_quantity")


def merged_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.merge_repairs(_results(spark, sf_dir)).select("doc_id", "request_id", "merged", "skip_reason")


def reviewed_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether their patches may be published, after two rounds of decisions on some."""
    merged = quality.merge_repairs(_results(spark, sf_dir))
    first = merged.where("l_quantity > 30").select("doc_id", "request_id", F.lit(1).alias("ordinal"), F.lit("reject").alias("decision"))
    second = merged.where("l_quantity > 20").select("doc_id", "request_id", F.lit(2).alias("ordinal"), F.lit("approve").alias("decision"))
    return quality.publish_gate(quality.review_patches(merged, first.unionByName(second)))


def repaired_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requests for the texts of their sizes, with results of which the later counts, and chunks of the sizes up to 40."""
    part, m = _table(spark, sf_dir, "part"), lambda k: F.pmod("p_partkey", F.lit(k))
    shapes = F.array().cast("array<struct<row_count:int,column_count:int>>")
    requests = part.select(F.col("p_brand").alias("doc_id"), F.format_string("rq%08d", "p_partkey").alias("request_id"), F.col("p_size").cast("string").alias("chunk_id"), F.when(m(5) == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("p_size").cast("string"))).alias("locked_tokens"), shapes.alias("shapes"), (m(3) > 0).alias("mergeable"))
    one = lambda keep, ordinal, status, text: part.where(keep).select(F.col("p_brand").alias("doc_id"), F.format_string("rq%08d", "p_partkey").alias("request_id"), F.lit(ordinal).alias("ordinal"), F.lit(status).alias("status"), text.alias("candidate"))
    results = one(m(7) > 0, 1, "failed", F.lit(None).cast("string")).unionByName(one(m(11) > 2, 2, "succeeded", F.when(m(13) == 0, "none").otherwise(F.concat(F.lit("has "), F.col("p_size").cast("string")))))
    found = quality.repair_ladder(requests, results, part.where("p_size <= 40").select(F.col("p_brand").alias("doc_id"), F.col("p_size").cast("string").alias("chunk_id")))
    return found.select("request_id", "validation", "merge")


def repair_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for the repairs of labelled documents' issues."""
    rows = _table(spark, sf_dir, "labels")
    found = rows.select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.explode(F.array_compact(F.array(F.when(F.col("toxic") == 1, "missing_numbers"), F.when(F.col("quality") == 0, "duplicate_paragraphs"), F.lit("unheard_of")))).alias("issue_type"), F.lit("medium").alias("severity"), F.array().cast("array<string>").alias("tokens"))
    pairs = _table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("source"))
    return quality.repair_requests(quality.repair_plan(found), pairs).select("doc_id", "request_id", "issue_type", "status", F.length("source").cast("long").alias("n"))


def verdict_of_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of odd and even days as issues before and after: the verdict in all."""
    events = _table(spark, sf_dir, "events").select("event_type", F.pmod("user_id", F.lit(50)).alias("chunk"), (F.dayofmonth("ts") % 2).alias("odd"))
    before, after = events.where("odd = 1"), events.where("odd = 0")
    return quality.overall_effect(quality.effectiveness(before, after, ["event_type"]), quality.effectiveness(before, after, ["chunk"]))


def lost_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as blocks, regions as chunks: the anchors that a chunk's translation has lost."""
    nations = _table(spark, sf_dir, "nation")
    chunks = nations.groupBy(F.col("n_regionkey").cast("string").alias("chunk_id")).agg(F.collect_list("n_name").alias("block_ids"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")))), " ").alias("target")).withColumn("doc_id", F.lit("d"))
    after = nations.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("n_name").alias("parent_id"))
    relations = nations.join(after, "n_nationkey").select(F.lit("d").alias("doc_id"), F.col("n_name").alias("child_id"), "parent_id", F.lit("caption_for_table").alias("relation"), F.array(F.lower("n_name"), F.col("parent_id")).alias("anchors"))
    return quality.relation_issues(relations, chunks).select("chunk_id", "child_id", F.array_join("missing", "/").alias("missing"))


def lost_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' words as a glossary for the names of others: what a translation, the type, lacks."""
    part = _table(spark, sf_dir, "part")
    words = part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("en"))
    glossary = words.groupBy("en").agg(F.min("p_partkey").alias("k")).select("en", F.concat(F.lit("t"), F.pmod("k", F.lit(7)).cast("string")).alias("zh"), F.when(F.pmod("k", F.lit(5)) == 0, "rejected").alias("status"))
    conflicts = glossary.where("zh = 't3' AND status IS NULL").select(F.upper("en").alias("en"))
    pairs = part.select(F.lit("d").alias("doc_id"), F.col("p_partkey").cast("string").alias("chunk_id"), F.upper("p_name").alias("source"), F.when(F.pmod("p_partkey", F.lit(11)) > 0, F.concat(F.lit("x t1 t2 "), "p_type")).alias("target"))
    return quality.glossary_issues(pairs, glossary, conflicts).select("chunk_id", "issue_type", F.size("tokens").cast("long").alias("n"))


def decided_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as terms with sizes as translations: the last decision on each stands."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_brand").alias("en"), F.col("p_size").cast("string").alias("zh"), F.lit("candidate").alias("status"))
    return memory.confirm_terms(part, part.where("ordinal % 10 = 0 AND zh < '3'").select(F.upper("en").alias("en"), "zh", "ordinal")).select("ordinal", "status")


def stale_by_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' segments as confirmed terms: chunks whose translation lacks them or has the rejected one."""
    customer = _table(spark, sf_dir, "customer")
    chunks = customer.select(F.lit("d").alias("doc_id"), F.col("c_custkey").cast("string").alias("chunk_id"), F.concat(F.lit("the "), F.lower("c_mktsegment"), F.lit(" trade")).alias("source"), F.when(F.pmod("c_custkey", F.lit(4)) == 0, None).when(F.pmod("c_custkey", F.lit(4)) == 1, F.concat(F.lit("new"), "c_mktsegment")).when(F.pmod("c_custkey", F.lit(4)) == 2, F.lit("old")).otherwise("none").alias("target"), *(F.array().cast("array<string>").alias(c) for c in ("sections", "types", "block_ids")))
    terms = customer.select(F.col("c_mktsegment").alias("en")).distinct().select("en", F.concat(F.lit("new"), "en").alias("zh"), F.array(F.lit("old")).alias("rejected_zh"), F.lit(None).cast("string").alias("section_scope"))
    return memory.stale_chunks(terms, chunks).select("chunk_id", F.array_join("terms", "/").alias("terms"), F.array_join("reasons", "/").alias("reasons"))


def glossary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return memory.review_counts(part.select(F.nullif(F.split("p_type", " ")[0], F.lit("STANDARD")).alias("status")), part.select(F.col("p_brand").alias("type")))


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs with a status for some."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), "o_orderstatus")
    running = orders.where("o_orderstatus <> 'P'").select("job_id", F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("status"))
    return jobs.with_status(orders.select("job_id"), running).groupBy("status").agg(F.count("*").alias("n"))


def requeued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lambda k: F.pmod("o_orderkey", F.lit(k))
    rows = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("running").alias("status"), (m(7) > 0).alias("recovered"), (m(5) > 0).alias("input_present"), (m(11) == 0).alias("cancel_requested"), (m(13) == 0).alias("custom_api"), F.when(m(3) == 0, " ").otherwise("echo").alias("backend"), (m(4) + 1).alias("pages_per_chunk"), m(2).alias("overlap_pages"))
    return jobs.requeue(rows).select("job_id", "action", F.array_join("blockers", "/").alias("blockers"))


def finished_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("chunk_id"), F.col("l_linenumber").alias("ord"), "l_linestatus")
    return jobs.completed_span(lines, lines.where("l_linestatus = 'F'"))


def tagged_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' numbers as counts of samples, with the tags and types that follow."""
    m = lambda k: F.pmod("p_partkey", F.lit(k))
    counts = {"page_count": m(4), "text_char_count": m(500), "image_page_count": m(2), "low_text_page_count": m(3), "table_keyword_count": m(5), "table_like_row_count": m(9), "formula_marker_count": m(17), "multi_column_page_count": m(3), "annotation_marker_count": m(6), "figure_caption_count": m(7), "entity_candidate_count": m(10), "organization_candidate_count": m(3), "person_candidate_count": m(2), "model_dataset_candidate_count": m(4)}
    rows = _table(spark, sf_dir, "part").select("p_partkey", *(c.alias(n) for n, c in counts.items()))
    return experiments.sample_tags(rows).select("p_partkey", F.array_join("tags", "/").alias("tags"), "type")


def joined_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs and some of them, with other run ids, as reviews: the very run, else the last of sample and variant."""
    runs = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sample_id"), F.col("o_orderpriority").alias("variant"), F.col("o_orderkey").alias("run_id"), F.col("o_orderkey").alias("ordinal"))
    reviews = runs.select("sample_id", "variant", F.when(F.pmod("run_id", F.lit(2)) == 0, -1).otherwise(F.col("run_id")).alias("run_id"), F.col("run_id").alias("review"))
    return experiments.join_reviews(reviews, runs).select("review", F.col("run.run_id").alias("run_id"))


def joined_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of orders and of favourites by customer, with rates of their counts."""
    orders = _table(spark, sf_dir, "orders")
    a = orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("done"))
    b = _table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").cast("long").alias("nation"))
    return experiments.metric_rates(experiments.join_reports({"orders": a, "people": b}), {"done_rate": ("orders_done", "orders_n"), "per_nation": ("orders_n", "people_nation")})


def planned_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiments.plan_runs(_table(spark, sf_dir, "region").select("r_regionkey"), _table(spark, sf_dir, "nation").select("n_nationkey"))


def changed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stored values, events as changes to them in order."""
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("value"))
    changes = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.concat("event_type", F.lit("-"), F.col("event_id").cast("string")).alias("value"), F.col("event_id").alias("ordinal"))
    return jobs.upsert(rows, changes, ["key"])


def marked_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites of urgent orders after more were wanted, some given up and some jobs deleted, by user."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"), "o_orderpriority")
    mark = orders.select("user_id", "job_id", F.col("created_at").alias("favorited_at"), "o_orderpriority")
    marks = jobs.mark(mark.where("o_orderpriority = '1-URGENT'").drop("o_orderpriority"), mark.where("o_orderpriority <= '2-HIGH'").drop("o_orderpriority"))
    kept, marks = jobs.unmark(orders.drop("o_orderpriority"), marks, orders.where("job_id % 3 = 0").select("user_id", "job_id", F.lit("2101-01-01").cast("timestamp").alias("at")))
    kept, marks = jobs.without_jobs(kept, marks, orders.where("job_id % 5 = 0"))
    recent = kept.where("created_at >= '2101-01-01'").groupBy("user_id").agg(F.count("*").alias("given_up"))
    return kept.groupBy("user_id").agg(F.count("*").alias("jobs")).join(marks.groupBy("user_id").agg(F.count("*").alias("favorites")), "user_id", "left").join(recent, "user_id", "left").fillna(0, ["favorites", "given_up"])


QUERIES = {f.__name__: f for f in (merged_repairs, repaired_chunks, reviewed_patches, repair_orders, verdict_of_repairs, lost_relations, lost_terms, decided_terms, stale_by_terms, glossary_counts, job_states, requeued_jobs, finished_spans, tagged_samples, joined_reviews, joined_reports, planned_runs, changed_values, marked_jobs)}

_RESULTS = "SELECT l_orderkey AS doc_id, l_suppkey % 3 AS chunk, l_linenumber AS k, l_returnflag AS f, l_quantity AS q FROM lineitem"
_MERGED = f"SELECT *, f = 'N' AND row_number() OVER (PARTITION BY doc_id, chunk ORDER BY CASE f WHEN 'N' THEN 0 ELSE 1 END, k) = 1 AS merged FROM ({_RESULTS})"

SQL = {
    "merged_repairs": f"""
        SELECT doc_id, format('rq{{:04d}}', k) AS request_id, merged, CASE WHEN merged THEN NULL WHEN f = 'A' THEN 'validation_failed' WHEN f = 'R' THEN 'validation_unchecked' ELSE 'chunk_already_patched' END AS skip_reason FROM ({_MERGED})""",
    "repaired_chunks": """
        WITH r AS (SELECT p_partkey AS k, p_brand AS d, p_size AS c, p_partkey % 3 > 0 AS mergeable,
              CASE WHEN p_partkey % 11 > 2 THEN CASE WHEN p_partkey % 5 = 0 THEN 'unchecked' WHEN p_partkey % 13 = 0 THEN 'failed' ELSE 'passed' END WHEN p_partkey % 7 > 0 THEN 'skipped_not_succeeded' ELSE 'skipped_missing_result' END AS validation FROM part),
        o AS (SELECT *, coalesce(sum(CASE WHEN validation = 'passed' AND c <= 40 AND mergeable THEN 1 ELSE 0 END) OVER (PARTITION BY d, c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS taken FROM r)
        SELECT format('rq{:08d}', k) AS request_id, validation, CASE WHEN validation <> 'passed' THEN 'skipped_validation_not_passed' WHEN c > 40 THEN 'skipped_missing_chunk' WHEN taken THEN 'skipped_chunk_conflict' WHEN NOT mergeable THEN 'skipped_manual_merge_required' ELSE 'applied' END AS merge FROM o""",
    "reviewed_patches": f"""
        SELECT doc_id, patches, blocking, CASE WHEN blocking > 0 THEN 'blocked' ELSE 'ready' END AS status FROM (
            SELECT doc_id, count(*) AS patches, count(*) FILTER (NOT (most > 20 OR merged)) AS blocking FROM (SELECT *, max(q) OVER (PARTITION BY doc_id, k) AS most FROM ({_MERGED})) GROUP BY doc_id)""",
    "repair_orders": """
        WITH f AS (SELECT doc_id, unnest(list_filter([CASE WHEN toxic = 1 THEN 'missing_numbers' END, CASE WHEN quality = 0 THEN 'duplicate_paragraphs' END, 'unheard_of'], lambda x: x IS NOT NULL)) AS issue_type FROM labels)
        SELECT f.doc_id, format('rq{:04d}', row_number() OVER (PARTITION BY f.doc_id ORDER BY issue_type)) AS request_id, issue_type,
               CASE issue_type WHEN 'missing_numbers' THEN 'ready_for_translation_backend' WHEN 'duplicate_paragraphs' THEN 'ready_for_local_rule' ELSE 'needs_human_review' END AS status, length(text) AS n
        FROM f LEFT JOIN documents d ON d.doc_id = f.doc_id""",
    "verdict_of_repairs": """
        WITH e AS (SELECT event_type, user_id % 50 AS chunk, day(ts) % 2 AS odd FROM events),
        t AS (SELECT event_type, count(*) FILTER (odd = 1) AS b, count(*) FILTER (odd = 0) AS a FROM e GROUP BY 1), c AS (SELECT chunk, count(*) FILTER (odd = 1) AS b, count(*) FILTER (odd = 0) AS a FROM e GROUP BY 1),
        s AS (SELECT sum(b)::BIGINT AS before_count, sum(a)::BIGINT AS after_count, coalesce(sum(a) FILTER (b = 0 AND a > 0), 0)::BIGINT AS new_issues, (SELECT count(*) FILTER (a > b) FROM c) AS regressed_chunks FROM t)
        SELECT *, before_count - after_count AS delta, CASE WHEN new_issues > 0 OR regressed_chunks > 0 THEN CASE WHEN before_count > after_count THEN 'improved_with_regressions' ELSE 'regressed' END WHEN before_count > after_count THEN 'improved' WHEN before_count = after_count AND before_count > 0 THEN 'unchanged' WHEN after_count = 0 THEN 'clean' ELSE 'needs_review' END AS verdict FROM s""",
    "lost_relations": """
        WITH c AS (SELECT n_regionkey, n_name FROM nation), t AS (SELECT n_regionkey, string_agg(n_name, ' ' ORDER BY n_name) FILTER (n_nationkey % 2 = 0) AS target FROM nation GROUP BY 1),
        r AS (SELECT a.n_name AS child, b.n_name AS parent, a.n_regionkey AS ra, b.n_regionkey AS rb FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1),
        e AS (SELECT child, parent, ra AS region FROM r UNION SELECT child, parent, rb FROM r),
        m AS (SELECT region, child, list_filter([lower(child), parent], lambda x: NOT contains(lower(coalesce(target, '')), lower(x))) AS missing FROM e JOIN t ON t.n_regionkey = region)
        SELECT region::VARCHAR AS chunk_id, child AS child_id, array_to_string(missing, '/') AS missing FROM m WHERE len(missing) > 0""",
    "lost_terms": """
        WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS en, p_partkey FROM part), g AS (SELECT en, 't' || (min(p_partkey) % 7) AS zh, min(p_partkey) % 5 = 0 AS rejected FROM w GROUP BY en),
        p AS (SELECT p_partkey, lower(p_name) AS source, 'x t1 t2 ' || p_type AS target FROM part WHERE p_partkey % 11 > 0),
        j AS (SELECT p_partkey, en, zh = 't3' AS clash, contains(target, zh) AS kept FROM p JOIN (SELECT DISTINCT lower(trim(en)) AS en, zh FROM g WHERE NOT rejected AND trim(en) <> '') ON contains(source, en))
        SELECT p_partkey::VARCHAR AS chunk_id, CASE WHEN clash THEN 'glossary_translation_conflict' ELSE 'missing_glossary_terms' END AS issue_type, count(DISTINCT en) AS n FROM j WHERE clash OR NOT kept GROUP BY ALL""",
    "decided_terms": """
        WITH d AS (SELECT p_brand, arg_max(p_size, p_partkey) AS zh FROM part WHERE p_partkey % 10 = 0 AND p_size::VARCHAR < '3' GROUP BY p_brand),
        n AS (SELECT p_partkey, d.zh, p_size = d.zh AS hit, row_number() OVER (PARTITION BY p.p_brand, p_size = d.zh ORDER BY p_partkey) AS n FROM part p LEFT JOIN d USING (p_brand))
        SELECT p_partkey AS ordinal, CASE WHEN zh IS NULL THEN 'candidate' WHEN hit AND n = 1 THEN 'confirmed' ELSE 'rejected' END AS status FROM n""",
    "stale_by_terms": """
        SELECT c_custkey::VARCHAR AS chunk_id, c_mktsegment AS terms, (['missing_translation', NULL, 'rejected_translation_present', 'confirmed_translation_missing'])[c_custkey % 4 + 1] AS reasons FROM customer WHERE c_custkey % 4 <> 1""",
    "glossary_counts": """
        SELECT 'term_status' AS "group", CASE WHEN s = 'STANDARD' THEN 'candidate' ELSE s END AS key, count(*) AS value FROM (SELECT split_part(p_type, ' ', 1) AS s FROM part) GROUP BY ALL
        UNION ALL SELECT 'pending_type', p_brand, count(*) FROM part GROUP BY p_brand""",
    "job_states": "SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'unknown' ELSE 'queued' END AS status, count(*) AS n FROM orders GROUP BY 1",
    "requeued_jobs": """
        WITH j AS (SELECT o_orderkey AS k, o_orderstatus <> 'F' AS active, o_orderkey % 7 > 0 AS recovered FROM orders),
        b AS (SELECT *, array_to_string(list_filter([CASE WHEN NOT recovered THEN 'not_recovered_from_disk' END, CASE WHEN NOT active THEN 'not_active_status' END, CASE WHEN k % 5 = 0 THEN 'input_pdf_missing' END, CASE WHEN k % 11 = 0 THEN 'cancel_requested' END, CASE WHEN k % 13 = 0 THEN 'custom_api_not_resumable' END,
              CASE WHEN k % 3 = 0 THEN 'backend_missing' END, CASE WHEN k % 4 = 3 THEN 'pages_per_chunk_invalid' END, CASE WHEN k % 2 >= k % 4 + 1 THEN 'overlap_pages_invalid' END], lambda x: x IS NOT NULL), '/') AS blockers FROM j)
        SELECT k AS job_id, CASE WHEN active AND recovered THEN CASE WHEN blockers = '' THEN 'requeueable' ELSE 'manual_required' END ELSE 'not_applicable' END AS action, blockers FROM b""",
    "finished_spans": "SELECT l_orderkey AS doc_id, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS chunks FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1",
    "tagged_samples": """
        WITH m AS (SELECT p_partkey AS k, greatest(p_partkey % 4, 1) AS p FROM part),
        t AS (SELECT k, list_filter([CASE WHEN k % 500 < p * 80 AND (k % 2 > 0 OR k % 3 >= p) THEN 'scanned' END, CASE WHEN k % 5 >= 2 OR k % 9 >= greatest(3, p * 2) THEN 'table' END, CASE WHEN k % 17 >= greatest(8, p * 4) THEN 'formula' END, CASE WHEN k % 3 >= greatest(1, round_even(p * 0.4, 0)) THEN 'multi-column' END,
              CASE WHEN k % 6 >= greatest(2, p) OR k % 7 >= greatest(3, p * 2) THEN 'annotation' END, CASE WHEN k % 10 >= greatest(6, p * 3) OR k % 3 + k % 2 + k % 4 >= greatest(3, p * 2) THEN 'entity' END, CASE WHEN k % 2 > 0 THEN 'image' END], lambda x: x IS NOT NULL) AS t FROM m),
        n AS (SELECT k, CASE WHEN len(t) = 0 THEN ['normal'] ELSE t END AS t FROM t)
        SELECT k AS p_partkey, array_to_string(t, '/') AS tags, CASE WHEN list_contains(t, 'scanned') THEN 'scanned' WHEN list_contains(t, 'table') THEN 'table-heavy' WHEN list_contains(t, 'formula') THEN 'formula-heavy' WHEN list_contains(t, 'multi-column') THEN 'multi-column' WHEN list_contains(t, 'annotation') OR list_contains(t, 'entity') THEN 'annotation-entity-heavy' ELSE 'normal' END AS type FROM n""",
    "joined_reviews": "SELECT o_orderkey AS review, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey ELSE max(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) END AS run_id FROM orders",
    "joined_reports": """
        WITH a AS (SELECT o_custkey AS doc_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1), b AS (SELECT c_custkey AS doc_id, c_nationkey::BIGINT AS nation FROM customer WHERE c_custkey % 2 = 0),
        j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(n, 0) AS orders_n, coalesce(done, 0) AS orders_done, coalesce(nation, 0) AS people_nation FROM a FULL JOIN b ON a.doc_id = b.doc_id)
        SELECT *, CASE WHEN orders_n = 0 THEN 0.0 ELSE orders_done::DOUBLE / orders_n END AS done_rate, CASE WHEN people_nation = 0 THEN 0.0 ELSE orders_n::DOUBLE / people_nation END AS per_nation FROM j""",
    "planned_runs": "SELECT r_regionkey, n_nationkey FROM region, nation",
    "changed_values": """
        WITH l AS (SELECT user_id::VARCHAR AS key, event_type || '-' || event_id AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
        SELECT s_suppkey::VARCHAR AS key, s_name AS value FROM supplier WHERE s_suppkey::VARCHAR NOT IN (SELECT key FROM l) UNION ALL SELECT * FROM l""",
    "marked_jobs": """
        WITH o AS (SELECT o_orderkey AS k, o_custkey AS u, o_orderdate AS made, o_orderpriority AS p FROM orders), h AS (SELECT u, count(*) AS held FROM o WHERE p = '1-URGENT' GROUP BY u),
        n AS (SELECT o.u, k, row_number() OVER (PARTITION BY o.u ORDER BY made, k) + coalesce(held, 0) AS place FROM o LEFT JOIN h ON h.u = o.u WHERE p = '2-HIGH'),
        m AS (SELECT u, k FROM o WHERE p = '1-URGENT' UNION ALL SELECT u, k FROM n WHERE place <= 3)
        SELECT o.u AS user_id, count(*) AS jobs, count(m.k) FILTER (o.k % 3 <> 0) AS favorites, count(*) FILTER (o.k % 3 = 0) AS given_up FROM o LEFT JOIN m ON m.k = o.k WHERE o.k % 5 <> 0 GROUP BY o.u""",
}

"""Run logs as metrics, and what runs cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions import values as V


def stage_metrics(events: DataFrame, keys: list[str]) -> DataFrame:
    """Time and number of stages by phase; failed ones count, too."""
    stages = events.where(F.col("event_type").isin("stage", "stage_error"))
    return stages.groupBy(*keys, F.coalesce("phase", F.lit("unknown")).alias("phase")).agg(F.sum(V.as_int("elapsed_ms")).alias("elapsed_ms"), F.count("*").alias("stages"), F.count(F.when(F.col("event_type") == "stage_error", 1)).alias("failed"))


def run_metrics(events: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each run (schemas.RUN_EVENT): chunks, retries, characters, tokens and speed. Tokens of sources and contexts are estimated from summed characters, those of requests and translations are summed."""
    chunk, retries = F.col("event_type") == "chunk_translation", F.when(F.col("event_type") == "chunk_translation", F.coalesce("http_retry_events", F.expr("array()").cast(events.schema["http_retry_events"].dataType)))
    total = lambda c: F.coalesce(F.sum(F.when(chunk, V.as_int(c))), F.lit(0))
    tries = lambda f: F.coalesce(F.sum(F.size(F.filter(retries, f))), F.lit(0))
    n = lambda c: F.count(F.when(c, 1))
    status = lambda x: F.coalesce(x["status"], F.lit(""))
    m = events.groupBy(*keys).agg(
        n(chunk).alias("requests"), n(F.col("event_type") == "chunk_skipped").alias("skipped"), n(F.col("event_type") == "stage_error").alias("failed_events"),
        total("elapsed_ms").alias("translation_ms"), F.coalesce(F.max(F.when(chunk, V.as_int("elapsed_ms"))), F.lit(0)).alias("max_chunk_ms"),
        *(total(f"{c}_char_count").alias(f"{c}_chars") for c in ("source", "context", "request", "translated")),
        total("estimated_request_token_count").alias("request_tokens"), total("estimated_translated_token_count").alias("translated_tokens"),
        tries(lambda x: F.lit(True)).alias("http_attempts"), tries(lambda x: F.coalesce(x["will_retry"], F.lit(False))).alias("http_retries"), tries(lambda x: status(x) != "success").alias("http_failed"),
        tries(lambda x: status(x) == "retryable_error").alias("http_retryable"), tries(lambda x: status(x) == "fatal_error").alias("http_fatal"),
    )
    return m.withColumns({"source_tokens": T.token_estimate("source_chars"), "context_tokens": T.token_estimate("context_chars"), "total_tokens": F.col("request_tokens") + F.col("translated_tokens"), "avg_chunk_ms": V.rate("translation_ms", "requests"), "chars_per_second": V.rate(F.col("request_chars") * 1000, "translation_ms")})


def counter(events: DataFrame, keys: list[str], column: str) -> DataFrame:
    """How often each value of a column occurs, empty ones left out, as long rows."""
    return events.where(F.coalesce(column, F.lit("")) != "").groupBy(*keys, F.lit(column).alias("group"), F.col(column).alias("key")).agg(F.count("*").alias("value"))


def estimate_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (backend, model, request_tokens, translated_tokens, request_chars, translated_chars, requests, http_attempts) with the price that fits best (backend:model, backend/model, model, backend, default) and what it comes to. Without a price: not configured, all costs 0. Attempts are billed where there are any, else requests."""
    b, m = F.lower(F.trim(F.coalesce("backend", F.lit("")))), F.lower(F.trim(F.coalesce("model", F.lit(""))))
    both = (b != "") & (m != "")
    ways = F.array_compact(F.array(F.when(both, F.concat(b, F.lit(":"), m)), F.when(both, F.concat(b, F.lit("/"), m)), F.nullif(m, F.lit("")), F.nullif(b, F.lit("")), F.lit("default")))
    kinds = usage.select(b.alias("_b"), m.alias("_m")).distinct()
    keyed = kinds.withColumns({"backend": F.col("_b"), "model": F.col("_m")}).select("_b", "_m", F.posexplode(ways).alias("_rank", "key"))
    best = keyed.join(prices.withColumn("key", F.lower("key")), "key").groupBy("_b", "_m").agg(F.min_by(F.struct(*prices.columns), "_rank").alias("_p"))
    j = usage.withColumns({"_b": b, "_m": m}).join(best, ["_b", "_m"], "left").drop("_b", "_m")
    million = lambda c, price: F.col(c) / 1_000_000 * F.coalesce(F.col(f"_p.{price}"), F.lit(0.0))
    j = j.withColumns({
        "configured": F.col("_p").isNotNull(),
        "profile_key": F.coalesce("_p.key", F.lit("")),
        "currency": F.upper(F.coalesce("_p.currency", F.lit("USD"))),
        "billable_requests": F.when(F.col("http_attempts") > 0, F.col("http_attempts")).otherwise(F.col("requests")),
        "input_token_cost": million("request_tokens", "input_per_1m_tokens"),
        "output_token_cost": million("translated_tokens", "output_per_1m_tokens"),
        "input_char_cost": million("request_chars", "input_per_1m_chars"),
        "output_char_cost": million("translated_chars", "output_per_1m_chars"),
    })
    j = j.withColumn("request_cost", F.col("billable_requests") * F.coalesce("_p.per_request", F.lit(0.0)))
    return j.withColumn("total_cost", sum((F.col(c) for c in ("output_token_cost", "input_char_cost", "output_char_cost", "request_cost")), F.col("input_token_cost"))).drop("_p")

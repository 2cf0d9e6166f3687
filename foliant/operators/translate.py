"""Translators as a pluggable step over chunks, with retries that are told as rows."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Known backends (id, names, needs a key) and limits of retries.
BACKENDS = (("echo", ("echo", "dry", "noop"), False), ("deepseek", ("deepseek",), True), ("openai", ("openai",), True), ("ollama", ("ollama",), False), ("deepl", ("deepl",), True), ("hybrid", ("hybrid",), True))
ATTEMPTS, MOST_ATTEMPTS, LONGEST_WAIT = 4, 12, 90.0
ECHO = "[ECHO 未翻译预览] "


class RetryableError(Exception):
    """A failure that another attempt may mend."""


def echo(text: Column | str, prefix: str = ECHO) -> Column:
    """The first 200 characters on one line: a translator without a backend."""
    return F.concat(F.lit(prefix), F.left(F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "\n", " "), F.lit(200)), F.lit("..."))


def prompt(*sections: tuple[str, Column]) -> Column:
    """Headed sections; empty ones are left out."""
    return F.concat_ws("\n\n", *(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"{head}\n"), c)) for head, c in sections))


def backends(spark: SparkSession) -> DataFrame:
    """alias, backend and needs_key."""
    return spark.createDataFrame([(a, b, k) for b, aliases, k in BACKENDS for a in aliases], "alias string, backend string, needs_key boolean")


def resolve_backend(rows: DataFrame, column: str = "backend") -> DataFrame:
    """rows with the backend that a name stands for, null for unknown names."""
    known = backends(rows.sparkSession).select("alias", F.col("backend").alias("resolved_backend"), "needs_key")
    return rows.withColumn("alias", F.lower(F.trim(F.col(column)))).join(F.broadcast(known), "alias", "left").drop("alias")  # a dozen rows


def waits(attempt: int, jitter: float) -> float:
    return min(LONGEST_WAIT, 2.0**attempt + jitter)


def with_retries(call: Callable[[str], str], text: str, attempts: int, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, list[dict]]:
    """call's answer and what became of each attempt."""
    events = []
    for i in range(max(1, min(MOST_ATTEMPTS, attempts))):
        last = i + 1 >= max(1, min(MOST_ATTEMPTS, attempts))
        try:
            answer = call(text)
            events.append({"status": "success", "will_retry": False, "error_code": None})
            return answer, events
        except RetryableError as e:
            events.append({"status": "retryable_error", "will_retry": not last, "error_code": str(e)})
            if not last:
                sleep(waits(i, random.random()))
        except Exception as e:
            events.append({"status": "fatal_error", "will_retry": False, "error_code": type(e).__name__})
            return None, events
    return None, events


def translate(chunks: DataFrame, backend: Callable[[], Callable[[str], str]], attempts: int = ATTEMPTS) -> DataFrame:
    """chunks (doc_id, chunk_id, text) with target and http_retry_events. backend is called once in each task and gives the function that is called for each chunk; as a lost task is run again, it may be asked twice for one chunk."""
    events = pa.list_(pa.struct([("status", pa.string()), ("will_retry", pa.bool_()), ("error_code", pa.string())]))
    place = chunks.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = backend()
        for batch in batches:
            got = [with_retries(call, t or "", attempts) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in got], pa.string()), pa.array([e for _, e in got], events)], names=[*batch.schema.names, "target", "http_retry_events"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(run, f"{schema}, target string, http_retry_events array<struct<status: string, will_retry: boolean, error_code: string>>")


def resume(chunks: DataFrame, completed: DataFrame) -> DataFrame:
    """The chunks that a run has still to do."""
    return chunks.join(completed.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_anti")

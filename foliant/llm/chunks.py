"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's UTF-8 bytes: each byte shifts the hash by one bit and adds a number from a fixed table, so its 16 bits depend on the last 16 bytes alone. A chunk ends behind a byte where the hash's top bits are zero, at least LEAST bytes from its begin, or at the latest MOST bytes from it; never inside a character. Ends depend on the bytes near them, so after an insertion the next ends fall where they did before. Chunks are joined by 128-bit digests; a chunk whose digest occurs earlier, by (doc_id, text hash, place), in another document or its own, is a repeat, and repeats in a row make up a run.

Texts are chunked twice: one 64-bit half of the digest finds the digests that occur twice, then chunks with such a half go on, by their whole digest. (A table of all chunks, written once, would take more than the texts themselves.) A digest that a third of all documents have is counted before the shuffle, and its rows meet its first place in a join that Spark can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import SPACE, documents, forget, id_type, small_batches, string_parts, unused, word_spans, written

LEAST, MOST, TOP_BITS = 16, 96, 4
#: The least length of a repeat, in words of whole chunks: shorter ones are phrases that any two texts may share. A chunk at either end of a repeated passage may differ, so this is less than the passages of 50 words that are to be found.
RUN_WORDS = 20


def _gear() -> np.ndarray:
    """256 numbers by the splitmix64 rule."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(48)).astype(np.uint16)


GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR[byte j back] << j over the last 16 bytes, in 16 bits."""
    h = GEAR[data]
    for step in (1, 2, 4, 8):
        more = h.copy()
        more[step:] += h[:-step] << np.uint16(step)
        h = more
    return h


def chunk_ends(data: np.ndarray, starts: np.ndarray, least: int = LEAST, most: int = MOST, top_bits: int = TOP_BITS) -> list[list[int]]:
    """The ends of each text's chunks, as places in data. least is at least 16."""
    first_bytes = np.append((data & 0xC0) != 0x80, True)  # places where a character begins, or the end
    cut = np.flatnonzero((gear_hashes(data) >> np.uint16(16 - top_bits) == 0) & first_bytes[1:]) + 1
    bounds = np.searchsorted(cut, starts, "right")
    cut, found = cut.tolist(), []
    for a, b, i, k in zip(starts[:-1].tolist(), starts[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        ends, last = [], a
        for at in cut[i:k]:
            if at - last < least:
                continue
            while at - last > most:
                last += most
                while not first_bytes[last]:
                    last -= 1
                ends.append(last)
            if at - last >= least:
                ends.append(at)
                last = at
        while b - last > most:
            last += most
            while not first_bytes[last]:
                last -= 1
            ends.append(last)
        if b > last:
            ends.append(b)
        found.append(ends)
    return found


def chunks(docs: DataFrame) -> DataFrame:
    """A row for each chunk: doc_id, t (hash of the text), ord, start and end (code points), words (that begin in it), d1 and d2 (its digest)."""

    def make(batches):
        digest = xxhash.xxh3_128_digest
        for batch in small_batches(batches):
            data, starts = string_parts(batch.column(1))
            each = chunk_ends(data, starts)
            whole = data.tobytes()
            n = np.array([len(x) for x in each], np.int64)
            row = np.repeat(np.arange(len(each)), n)
            end = np.array([e for x in each for e in x], np.int64)
            begin = np.array([b for x, a in zip(each, starts[:-1].tolist(), strict=True) if x for b in [a, *x[:-1]]], np.int64)
            digests = np.frombuffer(b"".join([digest(whole[b:e]) for b, e in zip(begin.tolist(), end.tolist(), strict=True)]), ">i8").astype(np.int64).reshape(-1, 2)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            word, _, _ = word_spans(data, starts, SPACE)
            words = np.searchsorted(word, end) - np.searchsorted(word, begin)
            base = chars[starts[:-1]][row]
            order = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), *(pa.array(x.astype(np.int32)) for x in (order, chars[begin] - base, chars[end] - base, words)), pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=["doc_id", "t", "ord", "start", "end", "words", "d1", "d2"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(make, f"doc_id {id_type(docs)}, t long, ord int, start int, end int, words int, d1 long, d2 long")


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS, within: bool = True) -> DataFrame:
    """A row for each run of repeated chunks with at least run_words words: doc_id, t, start and end (code points), words, first_doc_id (where most of the run's chunks occur first).

    Without `within`, chunks that occur earlier in their own document only are no repeats. Null and empty texts have no chunks; rows alike in doc_id and text are one document; a null doc_id comes before all others; an empty table gives no rows. doc_id may have any type that can be ordered; other columns are ignored."""
    all_chunks = chunks(docs)
    twice = written(all_chunks.groupBy("d1").agg(F.count("*").alias("n")).where("n > 1").select("d1"), "digests")
    shared = written(all_chunks.join(twice, "d1", "left_semi"), "chunks")
    forget(twice)
    here = F.struct("doc_id", "t", "ord")
    first = written(shared.groupBy("d1", "d2").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("NOT (first <=> last)").select("d1", "d2", "first"), "first")  # a table, so that Spark can split a large key's rows in the join
    later = shared.join(first, ["d1", "d2"]).where(~here.eqNullSafe(F.col("first")))
    if not within:
        later = later.where("NOT (first.doc_id <=> doc_id)")
    each = later.groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end", "words", F.col("first.doc_id").alias("first")))).alias("c"))
    kind = id_type(docs)

    def merge(batches):
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("at", "start", "end", "words", "first")}
            for i, found in enumerate(batch.column(2).to_pylist()):
                run: list[dict] = []
                last = None
                for c in [*found, None]:
                    if c is not None and run and c["ord"] == last:  # the same document twice
                        continue
                    if c is not None and (not run or c["ord"] == last + 1):
                        run.append(c)
                    else:
                        if run and sum(x["words"] for x in run) >= run_words:
                            firsts = [x["first"] for x in run]
                            for k, v in zip(rows, (i, run[0]["start"], run[-1]["end"], sum(x["words"] for x in run), max(dict.fromkeys(firsts), key=firsts.count)), strict=True):
                                rows[k].append(v)
                        run = [c] if c is not None else []
                    last = c["ord"] if c is not None else None
            at = pa.array(rows["at"], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(rows[k], pa.int32()) for k in ("start", "end", "words")), pa.array(rows["first"], batch.schema.field(0).type)], names=["doc_id", "t", "start", "end", "words", "first_doc_id"])

    return each.mapInArrow(merge, f"doc_id {kind}, t long, start int, end int, words int, first_doc_id {kind}")


def remove_repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS, within: bool = True) -> DataFrame:
    """docs with the runs of repeated_runs() cut out of its texts; its columns stay as they are, whatever their names."""
    own_id, own_key, runs, key = unused(docs, "own_id", "own_key", "runs", "key")
    found = repeated_runs(docs, run_words, within).groupBy("doc_id", "t").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(runs)).withColumnsRenamed({"doc_id": own_id, "t": own_key})
    keyed = docs.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(found.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key)), "left")
    pieces = F.expr(f"concat(array_join(transform({runs}, (r, i) -> substring(text, coalesce(get({runs}, i - 1).end, 0) + 1, r.start - coalesce(get({runs}, i - 1).end, 0))), ''), substring(text, element_at({runs}, -1).end + 1))")
    return joined.withColumn("text", F.when(F.col(runs).isNull(), F.col("text")).otherwise(pieces)).select(*docs.columns)


def op2_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_runs(documents(spark, sf_dir)).drop("t")


QUERIES = {"op2_gear_chunks": op2_gear_chunks}
SQL: dict[str, str] = {}

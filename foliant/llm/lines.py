"""Removes runs of lines that an earlier document or place has already, by winnowing.

Lines with a word are hashed (ASCII white space at the ends left off; 128 bits); the others stand outside and stay. Of every `run` lines in a row the one with the least hash (the first of equal ones) is selected as a guaranteed fingerprint: equal runs select the same line wherever they stand. A line of LONG words or more is selected for itself, too. Only selected lines make rows, each with the stretches that it was selected for, as digests.

Fingerprints that occur at one place only drop out at once. The positions of the others are joined: from a selected line a match reaches left and right over the stretches that it was selected for, as far as their digests occur earlier, by (doc_id, text hash, place); matches from neighbouring fingerprints that overlap make up the longest one, and its lines go. So every run of at least `run` lines with an earlier copy is deleted, and every single line of LONG words or more with one, and nothing else is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import documents, forget, id_type, small_batches, unused, written

#: Lines in a row that count as a run, and words of a line that counts on its own: a repeated passage of over 50 words may well be one line.
RUN, LONG = 2, 50


def _lines(text: str | None) -> tuple[list[str], list[int], list[bytes]]:
    """All lines, the places of those with a word, and these without white space at their ends."""
    lines = (text or "").split("\n")
    plain = [x.encode().strip() for x in lines]
    own = [i for i, x in enumerate(plain) if x]
    return lines, own, [plain[i] for i in own]


def selected(hashes: list[bytes], long: list[int], run: int) -> dict[int, list[tuple[int, int]]]:
    """The selected lines, each with the stretches (begin, size) that it was selected for."""
    found: dict[int, list[tuple[int, int]]] = {}
    least = -1
    for k in range(len(hashes) - run + 1):
        if least < k:
            some = hashes[k : k + run]
            least = k + some.index(min(some))
        elif hashes[k + run - 1] < hashes[least]:
            least = k + run - 1
        found.setdefault(least, []).append((k, run))
    for k in long:
        found.setdefault(k, []).append((k, 1))
    return found


def fingerprints(docs: DataFrame, run: int = RUN) -> DataFrame:
    """A row for each selected line: doc_id, t (hash of the text), at (its place among lines with a word), fp, and stretches (begin, size and digest of each)."""
    stretch = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])

    def make(batches):
        digest = xxhash.xxh3_128_digest
        for batch in small_batches(batches):
            row, at, fp, upto, start, size, w = [], [], [], [0], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                own = _lines(text)[2]
                hashes = [digest(x) for x in own]
                long = [k for k, x in enumerate(own) if len(x) >= 2 * LONG - 1 and len(x.split()) >= LONG]
                for k, stretches in selected(hashes, long, run).items():
                    row.append(i), at.append(k), fp.append(hashes[k][:8])
                    for a, n in stretches:
                        start.append(a), size.append(n), w.append(digest(b"".join(hashes[a : a + n])))
                    upto.append(len(start))
            halves = np.frombuffer(b"".join(w), ">i8").astype(np.int64).reshape(-1, 2)
            each = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], fields=list(stretch))
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(fp), ">i8").astype(np.int64)), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), each)], names=["doc_id", "t", "at", "fp", "stretches"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(make, f"doc_id {id_type(docs)}, t long, at int, fp long, stretches array<struct<start: int, size: int, w1: long, w2: long>>")


def repeats(found: DataFrame) -> DataFrame:
    """doc_id, t and gone: the stretches of each document that occur earlier. found: a written table of fingerprints(), which is deleted."""
    place = F.struct("doc_id", "t", "at")
    # tables on one side, so that Spark can split a large key's rows in the joins
    shared = written(found.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("NOT (a <=> b)").select("fp"), "fps")
    seeds = written(found.join(shared, "fp", "left_semi").select("doc_id", "t", F.explode("stretches").alias("s")).select("doc_id", "t", "s.*"), "seeds")
    forget(found, shared)
    here = F.struct("doc_id", "t", "start")
    first = written(seeds.groupBy("w1", "w2", "size").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("NOT (first <=> last)").drop("last"), "first")
    later = seeds.join(first, ["w1", "w2", "size"]).where(~here.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "t").agg(F.collect_set(F.struct("start", "size")).alias("gone"))


def remove_repeated_lines(docs: DataFrame, run: int = RUN) -> DataFrame:
    """docs with shorter texts, n_lines (with a word) and n_removed besides its columns (its own columns of these names are replaced). doc_id may have any type that can be ordered.

    Null texts and texts without words stay as they are, with no lines. Rows alike in doc_id and text are one document: what one of them loses, all lose; a null doc_id comes before all others. An empty table gives no rows."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    docs = docs.select(*kept)
    key, own_id, own_key, gone = unused(docs, "key", "own_id", "own_key", "gone")
    cut = repeats(written(fingerprints(docs, run), "fingerprints")).withColumnsRenamed({"doc_id": own_id, "t": own_key, "gone": gone})
    keyed = docs.withColumn(key, F.xxhash64("text"))
    joined = keyed.join(cut.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own_key)), "left").select(*kept, gone)

    place = kept.index("text")

    def rewrite(batches):
        for batch in small_batches(batches, place):
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            repeated = columns.pop(gone).to_pylist()
            texts, n, removed = columns["text"].to_pylist(), [], []
            for i, text in enumerate(texts):
                lines, own, _ = _lines(text)
                n.append(len(own))
                drop = {own[x["start"] + j] for x in repeated[i] or () for j in range(x["size"])}
                removed.append(len(drop))
                if drop:
                    texts[i] = "\n".join(x for k, x in enumerate(lines) if k not in drop)
            columns |= {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n, pa.int32()), "n_removed": pa.array(removed, pa.int32())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(rewrite, f"{schema}, n_lines int, n_removed int")


def op5_winnowed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))


QUERIES = {"op5_winnowed_lines": op5_winnowed_lines}
SQL = {
    "op5_winnowed_lines": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        s AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS s FROM l),
        k AS (SELECT *, CASE WHEN s <> '' THEN row_number() OVER (PARTITION BY doc_id, s <> '' ORDER BY i) END AS k FROM s),
        p AS (SELECT doc_id, k, s, lead(s) OVER (PARTITION BY doc_id ORDER BY k) AS s2 FROM k WHERE k IS NOT NULL),
        r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY s, s2 ORDER BY doc_id, k) AS n FROM p WHERE s2 IS NOT NULL),
        one AS (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS n FROM p WHERE len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) >= 50),
        cut AS (SELECT doc_id, k FROM r WHERE n > 1 UNION SELECT doc_id, k + 1 FROM r WHERE n > 1 UNION SELECT doc_id, k FROM one WHERE n > 1)
        SELECT k.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE cut.k IS NULL), '') AS text, count(k.k)::INTEGER AS n_lines, count(cut.k)::INTEGER AS n_removed
        FROM k LEFT JOIN cut ON k.doc_id = cut.doc_id AND k.k = cut.k GROUP BY k.doc_id""",
}

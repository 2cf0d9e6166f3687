"""Packs token sequences of given lengths into as few sequences of a fixed capacity as it can.

Pieces of one length are alike, so the plan works on counts by length: at most `capacity` of them, whatever the number of documents. First Martello and Toth's reduction fixes sets that dominate every other way to place their largest piece, as often as their counts allow:
- a piece with which not even the smallest other fits, alone;
- a piece with its exact complement;
- a piece with the largest that fits, where no two others fit beside it;
- a piece with the largest that fits, where no three others fit beside it and that largest is no smaller than any two that fit.
What remains is packed best-fit, longest first. Each step gives a run of alike sequences a run of alike pieces; pieces find their run by their rank among those of their length, and ranks are dealt out by salted groups, so no length is gathered in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import documents, small, small_batches, written
from foliant.llm.tokens import END_ID, default_tokenizer, documents_ids, encoder

CAPACITY = 4096
#: Rows of one length that one task ranks.
RANK_GROUP = 1000


class Plan:
    """Runs: n pieces of one length with ranks from rank on go to the sequences first .. first + wide - 1 in turn, at offset, offset + length, ..."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences, self.runs, self.taken, self.fixed = capacity, 0, [], {}, 0

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, n: int, first: int, wide: int, offset: int) -> None:
        if n:
            rank = self.taken.get(length, 0)
            self.taken[length] = rank + n
            self.runs.append((length, rank, n, first, wide, offset))

    def arrays(self) -> np.ndarray:
        return np.array(sorted(self.runs), np.int64).reshape(-1, 6)


def reduce_instance(counts: dict[int, int], capacity: int, plan: Plan) -> dict[int, int]:
    """Fixes dominating sets in the plan and returns what remains."""
    left = {k: v for k, v in counts.items() if v > 0}

    def take(n: int, *lengths: int) -> None:
        first, offset = plan.open(n), 0
        plan.fixed += n
        for length in lengths:
            plan.put(length, n, first, n, offset)
            offset += length
            left[length] -= n
            if not left[length]:
                del left[length]

    changed = True
    while changed and left:
        changed = False
        sizes = np.array(sorted(left), np.int64)
        for j in sizes[::-1].tolist():
            while left.get(j):
                sizes = sizes[np.fromiter((s in left for s in sizes.tolist()), bool, len(sizes))] if any(s not in left for s in (int(sizes[0]), int(sizes[-1]))) else sizes
                others = _smallest(left, sizes, j, 3)
                room = capacity - j
                if not others or others[0] > room:
                    take(left[j], j)
                    changed = True
                    break
                k = _largest(left, sizes, j, room)
                n = left[j] // 2 if k == j else min(left[j], left[k])
                if not n:
                    break
                if k == room or len(others) < 2 or others[0] + others[1] > room or ((len(others) < 3 or sum(others) > room) and k >= _best_pair(left, sizes, j, room)):
                    take(n, j, k)
                    changed = True
                else:
                    break
    return left


def _smallest(left: dict[int, int], sizes: np.ndarray, j: int, n: int) -> list[int]:
    """The n smallest pieces beside one of length j."""
    found: list[int] = []
    for s in sizes.tolist():
        found += [s] * min(n, left.get(s, 0) - (s == j))
        if len(found) >= n:
            break
    return found[:n]


def _largest(left: dict[int, int], sizes: np.ndarray, j: int, room: int) -> int:
    """The largest piece beside one of length j that is at most room; there is one."""
    at = int(np.searchsorted(sizes, room, "right")) - 1
    while at >= 0:
        s = int(sizes[at])
        if left.get(s, 0) - (s == j) > 0:
            return s
        at -= 1
    raise ValueError("no piece fits")


def _best_pair(left: dict[int, int], sizes: np.ndarray, j: int, room: int) -> int:
    """The largest sum of two pieces, beside one of length j, that is at most room; where in doubt more."""
    small = sizes[: int(np.searchsorted(sizes, room, "right"))]
    if not len(small):
        return 0
    at = np.searchsorted(small, room - small, "right") - 1
    sums = np.where(at >= 0, small + small[np.maximum(at, 0)], 0)
    return int(sums.max())


def best_fit(counts: dict[int, int], capacity: int, plan: Plan) -> None:
    """Best-fit decreasing on counts: a run of open sequences with one remaining room takes a run of pieces at a time."""
    rooms: list[int] = []  # sorted
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, how many)

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, wide = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, each = capacity, capacity // length
                wide = -(-n // each)
                first = plan.open(wide)
            each = room // length
            whole = min(wide, n // each)
            plan.put(length, whole * each, first, whole, capacity - room)
            leave(room - each * length, first, whole)
            n -= whole * each
            if n and whole < wide:  # the last sequence gets fewer
                plan.put(length, n, first + whole, 1, capacity - room)
                leave(room - n * length, first + whole, 1)
                whole, n = whole + 1, 0
            leave(room, first + whole, wide - whole)


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("every length must be between 1 and the capacity")
    plan = Plan(capacity)
    best_fit(reduce_instance(counts, capacity, plan), capacity, plan)
    return plan


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document (doc_id, text): its ids and the end id, cut into pieces of `capacity` where longer. A null text has the end id alone."""
    tokenizer = tokenizer or default_tokenizer()

    def cut(batches):
        encode = encoder(tokenizer)
        for batch in small_batches(batches, most=4 << 20):
            rows: dict[str, list] = {"at": [], "piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for i, ids in enumerate(documents_ids(encode, batch.column(1), end_id)):
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for k, v in zip(rows, (i, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), part if with_ids else None), strict=True):
                        rows[k].append(v)
            at = pa.array(rows.pop("at"), pa.int64())
            columns = [batch.column(0).take(at), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32"))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array([x.astype(np.int32) for x in rows["ids"]], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with doc_id, piece, length and ids_crc32, from a written table) with sequence_id and offset. Rows that are alike in these may swap places. An empty table stays empty."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = make_plan(counts, capacity).arrays()
    salts = spark.createDataFrame([(k, -(-n // RANK_GROUP)) for k, n in counts.items()], "length long, _salts long")  # a row for each length
    names = pieces.columns
    salted = pieces.join(F.broadcast(salts), "length").select(*names, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts")).alias("_salt"))
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(small(written(before, "before"), 200_000), ["length", "_salt"]).select(*names, (F.col("_rank") + F.col("_before")).alias("_rank"))
    sent = spark.sparkContext.broadcast(runs)  # its size is bounded by the capacity, not by the rows

    def find(batches):
        length, rank, _, first, wide, offset = sent.value.T
        key = (length << 44) + rank
        for batch in batches:
            own, r = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("length", "_rank"))
            at = np.searchsorted(key, (own.astype(np.int64) << 44) + r, "right") - 1
            j = r - rank[at]
            columns = [batch.column(i) for i, k in enumerate(batch.schema.names) if k != "_rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[at] + j % wide[at]), pa.array(offset[at] + j // wide[at] * own)], names=[*(k for k in batch.schema.names if k != "_rank"), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(find, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Packs whole documents (doc_id, text): a row for each piece with its sequence and its place there. Null texts count as empty, repeated rows are packed each, an empty table gives no rows, other columns are ignored. doc_id is a whole number."""
    return place(written(pieces_of(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
SQL: dict[str, str] = {}

"""Token ids as length-delimited binary records with a separate offset index.

A record file holds, for each document: the payload's length (8 bytes, little-endian), that length's masked checksum (4 bytes), the payload, and the payload's masked checksum (4 bytes). The payload is the document's ids, 2 bytes each where the vocabulary has at most 65,536 ids, else 4. The checksum is CRC-32 (zlib's, as no fast Castagnoli code is at hand), masked by a rotation and an addition so that checksums of data that holds checksums stay sound.
The index file beside it has 24 bytes for each record: doc_id (8), offset of the record (8), ids (4), flags (4, 1: doc_id is null), so that a reader can take records in any order.
manifest.parquet in the dataset's folder names the files in order, with the number of ids before each. Files that a lost task left are not named there.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import documents, fresh_path, parts_of, small_batches
from foliant.llm.tokens import END_ID, default_tokenizer, documents_ids, encoder

INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u4"), ("flags", "<u4")])
_HEAD = struct.Struct("<QI")
_TAIL = struct.Struct("<I")
#: Bytes of the table of documents, as Spark knows it, for each file: a larger table gets more files than there are shuffle partitions.
FILE_BYTES = 256 << 20
MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_bytes long"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + _TAIL.pack(masked(zlib.crc32(head))) + payload + _TAIL.pack(masked(zlib.crc32(payload)))


def unframe(data: memoryview, offset: int) -> tuple[memoryview, int]:
    """The payload at offset, and where the next record begins. Raises ValueError where a checksum or the length is wrong."""
    if offset + 12 > len(data):
        raise ValueError(f"record at {offset} is cut off")
    length, check = _HEAD.unpack_from(data, offset)
    if masked(zlib.crc32(data[offset : offset + 8])) != check:
        raise ValueError(f"wrong checksum of the length at {offset}")
    end = offset + 12 + length
    if end + 4 > len(data):
        raise ValueError(f"record at {offset} is cut off")
    payload = data[offset + 12 : end]
    if masked(zlib.crc32(payload)) != _TAIL.unpack_from(data, end)[0]:
        raise ValueError(f"wrong checksum of the payload at {offset}")
    return payload, end + 4


def _store(uri: str):
    """The file system of a URI as executors open it, and the path there."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes documents (doc_id, text) in ascending doc_id order, nulls first and ties by a hash of the text, and returns the manifest, with the ids before each file.

    A task writes to a name of its own and renames it when whole, so a task that is run again does no harm. A null text has the end id alone; an empty table gives an empty manifest. Other columns are ignored. doc_id is a whole number."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()

    def write(batches):
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        kind = "<u2" if encode.vocabulary <= 1 << 16 else "<u4"
        store, base = _store(folder)
        shard = TaskContext.get().partitionId()
        name = f"{base}/part-{shard:06d}-{uuid.uuid4().hex}"
        out, index, offset, tokens = None, [], 0, 0
        for batch in small_batches(batches, most=4 << 20):
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(name + ".rec.tmp")
            ids_of, nulls = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), batch.column(0).is_null().to_numpy(zero_copy_only=False)
            rows = np.zeros(batch.num_rows, INDEX)
            rows["doc_id"], rows["flags"] = ids_of, nulls
            framed = []
            for i, ids in enumerate(documents_ids(encode, batch.column(1), end_id)):
                record = frame(ids.astype(kind).tobytes())
                rows["offset"][i], rows["n"][i] = offset, len(ids)
                offset += len(record)
                tokens += len(ids)
                framed.append(record)
            out.write(b"".join(framed))
            index.append(rows)
        if out is None:
            return
        out.close()
        with store.open_output_stream(name + ".idx") as f:
            f.write(np.concatenate(index).tobytes())
        store.move(name + ".rec.tmp", name + ".rec")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": [sum(map(len, index))], "n_tokens": [tokens], "n_bytes": [offset]})

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = F.xxhash64("text")
    order = (F.col("doc_id").asc_nulls_first(), tie)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = -(-size // FILE_BYTES)  # beyond any real count where Spark does not know the size
    ranged = placed.repartitionByRange(wanted, *order) if parts_of(spark) < wanted < 1 << 20 else placed.repartitionByRange(*order)
    made = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie).mapInArrow(write, MANIFEST)
    files = sorted(made.collect(), key=lambda r: r["shard"])  # a row for each file
    before = np.concatenate([[0], np.cumsum([r["n_tokens"] for r in files])]).astype(int)
    rows = [(*r, int(b)) for r, b in zip(files, before[:-1], strict=True)]
    manifest = spark.createDataFrame(rows, MANIFEST + ", tokens_before long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest.parquet")
    return spark.read.parquet(f"{folder}/manifest.parquet")


def read_records(manifest: DataFrame, wide: bool = False, with_ids: bool = True) -> DataFrame:
    """Every record of the files in a manifest: doc_id, start (ids before it in the dataset), n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit), and the ids. wide: the payload has 4 bytes an id.

    Checks every checksum and that index and records agree."""
    kind = "<u4" if wide else "<u2"
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def read(batches):
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("tokens_before").to_pylist(), strict=True):
                store, name = _store(path)
                with store.open_input_stream(name + ".idx") as f:
                    index = np.frombuffer(f.read(), INDEX)
                # record files are read a stretch at a time; a stretch ends between records
                with store.open_input_stream(name + ".rec") as f:
                    at = 0
                    while at < len(index):
                        base = int(index["offset"][at])
                        upto = max(at + 1, int(np.searchsorted(index["offset"], base + (32 << 20))))
                        end = int(index["offset"][upto]) if upto < len(index) else None
                        data, rows = memoryview(f.read(end - base) if end is not None else f.read()), {"doc_id": [], "start": [], "n": [], "crc": [], "ids": []}
                        for doc, offset, n, flags in index[at:upto].tolist():
                            payload, _ = unframe(data, offset - base)
                            ids = np.frombuffer(payload, kind).astype("<u4")
                            if len(ids) != n:
                                raise ValueError(f"the index has {n} ids, the record {len(ids)}")
                            for k, v in zip(rows, (None if flags & 1 else doc, before, n, zlib.crc32(ids.tobytes()), ids if with_ids else None), strict=True):
                                rows[k].append(v)
                            before += n
                        columns = [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["start"], pa.int64()), pa.array(rows["n"], pa.int64()), pa.array(rows["crc"], pa.int64())]
                        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns, names = [*columns, pa.array([x.astype(np.int32) for x in rows["ids"]], pa.list_(pa.int32()))], [*names, "ids"]
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        at = upto

    files = manifest.select("path", "tokens_before")
    return files.repartition(max(1, manifest.count()), "path").mapInArrow(read, schema)


def read_record(path: str, row: int, wide: bool = False) -> tuple[int | None, np.ndarray]:
    """One record by its place in the index: a shuffled read."""
    store, name = _store(path)
    with store.open_input_file(name + ".idx") as f:
        f.seek(row * INDEX.itemsize)
        doc, offset, n, flags = np.frombuffer(f.read(INDEX.itemsize), INDEX)[0].tolist()
    with store.open_input_file(name + ".rec") as f:
        f.seek(offset)
        payload, _ = unframe(memoryview(f.read(16 + n * (4 if wide else 2))), 0)
    return None if flags & 1 else doc, np.frombuffer(payload, "<u4" if wide else "<u2").astype(np.uint32)


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes all documents into record files in the shared folder and reads them back."""
    tokenizer = default_tokenizer()
    manifest = write_records(documents(spark, sf_dir), fresh_path(spark, "records"), tokenizer)
    return read_records(manifest, wide=encoder(tokenizer).vocabulary > 1 << 16, with_ids=False)


QUERIES = {"op6_token_records": op6_token_records}
SQL: dict[str, str] = {}

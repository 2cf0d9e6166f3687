"""What the operators share: the shared folder, written tables, and splitting text in numpy."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a full URI: spark.checkpoint.dir, else the context's checkpoint folder. Where neither is set and Spark runs on this machine alone, a temporary folder is chosen, kept for the session and deleted with it; a cluster without a shared folder is refused."""
    found = spark.conf.get("foliant.shared.dir", None)
    if found:
        return found
    context = spark.sparkContext
    ours = context._jsc.sc().getCheckpointDir()
    found = context.getConf().get("spark.checkpoint.dir") or (ours.get() if ours.isDefined() else None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="foliant-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
    path = context._jvm.org.apache.hadoop.fs.Path(found)
    found = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not ours.isDefined():
        context.setCheckpointDir(found)
    spark.conf.set("foliant.shared.dir", found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/foliant/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and its lineage ends there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._foliant_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table._foliant_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    taken, head = {c.lower() for c in df.columns}, "_"
    while any(f"{head}{n}".lower() in taken for n in names):
        head += "_"
    return [f"{head}{n}" for n in names]


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """df, a written table, to be broadcast where it has at most `most` rows; a larger one is joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def shorter_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Sends texts to Python by fewer rows at a time than Spark's default of 10,000, which at some kilobytes a row are tens of megabytes on both sides. A session with a setting of its own keeps it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; the session sends its texts in shorter batches from then on."""
    shorter_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    return df.schema[name].dataType.simpleString()


def text_key(text: str = "text"):
    """Two longs that stand for a text; null and the empty text have the same ones."""
    hexed = F.md5(F.coalesce(F.col(text), F.lit("")))
    half = lambda at: F.conv(F.substring(hexed, at, 15), 16, 10).cast("long")
    return half(1), half(17)


def string_parts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all values in one array, and where each value begins; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    starts = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def release() -> None:
    """Gives back memory that Arrow's and the C library's pools hold on to: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(batches, column: int = 1, most: int = 2 << 20):
    """The batches in parts of at most `most` bytes of the text column (or one row), which bounds what a worker holds beside them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(sizes, (int(sizes[at - 1]) if at else 0) + most, "right")))
            yield batch.slice(at, upto - at)
            at = upto
    release()


def byte_set(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


#: The white space that ends a word in the queries' definitions: \x20 and \x09-\x0D.
SPACE = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
#: ASCII characters that are neither letters nor digits; bytes of other characters count as letters.
NOT_WORD = byte_set(bytes(b for b in range(128) if not chr(b).isalnum()))


def word_spans(data: np.ndarray, starts: np.ndarray, ends_word: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in data, and for each text the number of words before it (one more entry than texts). No word crosses texts."""
    inside = ~ends_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
    cut = starts[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    cut = cut[inside[cut] & inside[cut - 1]]  # a word would cross from one text to the next
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    begin, end = at[::2], at[1::2]
    return begin, end, np.searchsorted(begin, starts)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n + 1:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        for name, base in (("up", _ODD), ("down", _BACK)):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            _POWERS[name] = np.multiply.accumulate(powers)
    return _POWERS["up"][: n + 1], _POWERS["down"][: n + 1]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of bytes, mixed; equal bytes have equal hashes wherever they stand."""
    found = np.empty(len(begin), np.uint64)
    step = 1 << 20  # bytes at a time: the powers stay small
    i = 0
    while i < len(begin):
        base = int(begin[i])
        k = max(i + 1, int(np.searchsorted(end, base + step, "right")))
        part = data[base : int(end[k - 1])]
        up, down = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        b, e = begin[i:k] - base, end[i:k] - base
        found[i:k] = (sums[e] - sums[b]) * down[b]
        i = k
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xD6E8FEB86659FD93)
    found ^= found >> np.uint64(29)
    return found


class Vocabulary:
    """Looks up words by their hashes in a table that is addressed by the hash's high bits."""

    def __init__(self, words: list[str]):
        self.words = words
        coded = [w.encode() for w in words]
        data = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum([len(w) for w in coded]).astype(np.int64) if coded else np.zeros(0, np.int64)
        self.hashes = span_hashes(data, ends - np.array([len(w) for w in coded], np.int64), ends) if coded else np.zeros(0, np.uint64)
        bits = 16
        while len(words) and len(np.unique(self.hashes >> np.uint64(64 - bits))) < len(np.unique(self.hashes)) and bits < 24:
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.table = np.full(1 << bits, -1, np.int32)
        order = np.argsort(self.hashes, kind="stable")
        self.sorted, self.order = self.hashes[order], order.astype(np.int32)
        self.table[(self.hashes >> self.shift).astype(np.int64)] = np.arange(len(words), dtype=np.int32)
        self.clash = len(words) > 0 and len(np.unique(self.hashes >> self.shift)) < len(np.unique(self.hashes))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word in the list, -1 for others."""
        if not len(self.words):
            return np.full(len(hashes), -1, np.int32)
        if self.clash:
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            return np.where(self.sorted[at] == hashes, self.order[at], -1).astype(np.int32)
        at = self.table[(hashes >> self.shift).astype(np.int64)]
        return np.where((at >= 0) & (self.hashes[at] == hashes), at, -1).astype(np.int32)


def lowered_words(array: pa.Array, ends_word: np.ndarray = NOT_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word begins, word ends, and words before each text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    data, starts = string_parts(pc.utf8_lower(pc.fill_null(array.cast(pa.large_string()), "")))
    return data, *word_spans(data, starts, ends_word)


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the edges u-v."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        open_ = label[u] != label[v]
        u, v = u[open_], v[open_]
    return label

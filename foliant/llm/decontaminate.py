"""Benchmark decontamination by latent semantic retrieval, longest common subsequences and answer checks.

Words are lower-cased runs of letters and digits; a text is cut into stretches of STRIDE words. The benchmark is taken in blocks of at most ITEMS items in expectation, and GROUP blocks share one reading of the texts:
1. All texts are read once into a compact table: which words of the group's items they have, and where. Stretch frequencies of all these words come from it; no word is left out, common ones weigh little.
2. For each block a randomised SVD of all stretches' TF-IDF vectors (each at length one) and the items' own, which together count as much as all stretches: with a random matrix W, the columns of A'(A W) span the range; Q is their orthonormal form, and the eigenvectors of (A Q)'(A Q) give the latent axes. Both products are sums over stretches that tasks make and that are added up in a tree, by slices of terms. The rank is the block's items and EXTRA, so every item has room for an axis of its own.
3. Passages are windows of 2, 3, 5, 9, ... stretches, one from every stretch on: an item is looked for in the least windows that hold any passage of its length. Every passage is folded into the latent space and compared with every item by cosine. An item's threshold is NEAR of the cosine that it would have with a window that holds it beside words of the usual frequencies.
4. Pairs that are near enough are checked by the longest common subsequence of the item's words with those of the window and as many to either side as the item has. A pair is a leak where that has VERBATIM of the item's words, or PARAPHRASE of them and ANSWER of the words of the item's answer, in order (its last sentence, unless the benchmark has an `answer`).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Vocabulary, documents, forget, id_type, lowered_words, small_batches, span_hashes, unused, written

ITEMS, GROUP, EXTRA, STRIDE = 256, 16, 64, 32
NEAR, VERBATIM, PARAPHRASE, ANSWER = 0.4, 0.8, 0.6, 0.8
#: Rows of a matrix that are added up together, and how many tasks' sums one task adds.
_SLICE, _FAN = 256, 32
#: Words that a task looks at at a time.
_MOST = 1 << 15
#: Stretches whose vectors are in memory at a time.
_STRETCHES = 2048
#: The most frequent terms, whose part of a product is a dense one.
_DENSE = 256


def words_of(text: str | None) -> list[str]:
    data, begin, end, _ = lowered_words(pa.array([text or ""]))
    whole = data.tobytes()
    return [whole[a:b].decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def common_words(item: dict, size: int, words: list) -> int:
    """Length of the longest common subsequence, by Hyyrö's bit-parallel rule. item: for each word, the places it has, as bits."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = item.get(w)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return size - v.bit_count()


def place_bits(words: list) -> dict:
    found: dict = {}
    for i, w in enumerate(words):
        found[w] = found.get(w, 0) | 1 << i
    return found


def last_sentence(text: str) -> str:
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n", text) if words_of(p)]
    return parts[-1] if parts else ""


class Block:
    """Some items of the benchmark: ids, words and answers' words."""

    def __init__(self, rows: list):
        rows = [(r["item_id"], words_of(r["text"]), words_of(r["answer"]) or words_of(last_sentence(r["text"] or ""))) for r in rows]
        rows = [r for r in rows if r[1]]
        self.ids, self.words, self.answers = ([r[i] for r in rows] for i in range(3))
        self.terms = sorted({w for x in (*self.words, *self.answers) for w in x})

    def weigh(self, frequency: dict[str, int], total: int) -> None:
        """frequency: in how many of `total` stretches each term occurs. Puts the most frequent terms first."""
        self.terms = sorted(self.terms, key=lambda w: (-frequency.get(w, 0), w))
        at = {w: i for i, w in enumerate(self.terms)}
        df = np.array([frequency.get(w, 0) for w in self.terms], float)
        self.idf = (np.log((1 + total) / (1 + df)) + 1e-6).astype(np.float32)
        own = np.zeros((len(self.ids), len(self.terms)), np.float32)
        for i, words in enumerate(self.words):
            for w in words:
                own[i, at[w]] += self.idf[at[w]]
        size = np.linalg.norm(own, axis=1)
        self.vectors = own / size[:, None]
        self.window = np.array([1 + (1 << max(0, int(np.ceil(np.log2(len(x) / STRIDE))))) for x in self.words])
        usual = self.window * float((df / max(1, total) * self.idf**2).sum())
        self.near = NEAR * size / np.sqrt(size**2 + usual)
        self.places = [place_bits([at[w] for w in x]) for x in self.words]
        self.answer_places = [place_bits([at[w] for w in x]) for x in self.answers]


def term_table(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, t (hash of the text), n_words, terms (places in `words`) and gaps (words from one term to the next) of each text with a word."""
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(words))  # words of GROUP * ITEMS items

    def find(batches):
        for batch in small_batches(batches):
            data, begin, end, before = lowered_words(batch.column(1))
            term = sent.value.find(span_hashes(data, begin, end))
            hit = np.flatnonzero(term >= 0)
            upto = np.searchsorted(hit, before)
            gaps = np.diff(hit, prepend=0)
            first = upto[:-1][np.diff(upto) > 0]
            gaps[first] = hit[first] - before[:-1][np.diff(upto) > 0]
            full = pa.array(np.flatnonzero(np.diff(before)))
            lists = [pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(x.astype(np.int32))).take(full) for x in (term[hit], gaps)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(full), batch.column(2).take(full), pa.array(np.diff(before).astype(np.int32)).take(full), *lists], names=["doc_id", "t", "n_words", "terms", "gaps"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("t")).mapInArrow(find, f"doc_id {id_type(docs)}, t long, n_words int, terms array<int>, gaps array<int>")


class Part:
    """Some rows of term_table(), with the block's own numbers of terms: row, place and term of each word, the rows' first stretches, and each stretch's counts (cell: stretch and term)."""

    def __init__(self, batch: pa.RecordBatch, local: np.ndarray):
        lists = [batch.column(batch.schema.get_field_index(x)) for x in ("terms", "gaps")]
        n = np.diff(lists[0].offsets.to_numpy())
        term, gap = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        row = np.repeat(np.arange(len(n)), n)
        place = np.cumsum(gap)
        start = np.cumsum(n) - n
        place -= np.repeat(np.where(n > 0, np.append(place, 0)[start] - np.append(gap, 0)[start], 0), n)
        own = local[term]
        keep = own >= 0
        self.batch, self.row, self.place, self.term = batch, row[keep], place[keep], own[keep]
        self.first = np.concatenate([[0], np.cumsum(-(-batch.column(batch.schema.get_field_index("n_words")).to_numpy().astype(np.int64) // STRIDE))])
        self.stretches = int(self.first[-1])
        self.stretch = self.first[self.row] + self.place // STRIDE

    def counts(self, at: np.ndarray, term: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell, n = np.unique(at * terms + term, return_counts=True)
        return cell // terms, cell % terms, n


def parts(batches, local: np.ndarray):
    """The rows by parts of at most _MOST terms (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.diff(batch.column(batch.schema.get_field_index("terms")).offsets.to_numpy()))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(sizes, (int(sizes[at - 1]) if at else 0) + _MOST, "right")))
            yield Part(batch.slice(at, upto - at), local)
            at = upto


def stretch_frequency(table: DataFrame, words: list[str]) -> tuple[dict[str, int], int]:
    """In how many stretches each word occurs, and how many stretches there are."""
    size = max(1, len(words))

    def count(batches):
        total, stretches = np.zeros(size, np.int64), 0
        for part in parts(batches, np.arange(size)):
            total += np.bincount(part.counts(part.stretch, part.term, size)[1], minlength=size)
            stretches += part.stretches
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"w": pa.array(np.append(at, -1), pa.int64()), "n": pa.array(np.append(total[at], stretches), pa.int64())})

    rows = table.select("n_words", "terms", "gaps").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()  # a row for each of the group's words
    found = dict(zip(rows["w"].to_pylist(), rows["n"].to_pylist(), strict=True))
    total = found.pop(-1, 0)
    return {words[i]: n for i, n in found.items()}, total


def _dense(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, terms: int) -> np.ndarray:
    """The first _DENSE columns of a sparse matrix of n rows."""
    out = np.zeros((n, min(_DENSE, terms)), np.float32)
    own = term < _DENSE
    out[row[own], term[own]] = value[own]
    return out


def _sums(key: np.ndarray, place: np.ndarray, value: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (given in order), and for each the sum of value * matrix[place]; keys with equally many entries are taken together."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    out = np.empty((len(first), matrix.shape[1]), np.float32)
    for k in np.unique(count).tolist():
        some = np.flatnonzero(count == k)
        for own in np.array_split(some, max(1, len(some) * k >> 14)):
            at = first[own][:, None] + np.arange(k)
            out[own] = np.matmul(value[at][:, None, :], matrix[place[at]])[:, 0]
    return key[first], out


def _products(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sparse matrix (row, term, value; rows in order) times matrix, and its first columns."""
    dense = _dense(row, term, value, n, len(matrix))
    out = dense @ matrix[: dense.shape[1]]
    rare = term >= _DENSE
    rows, more = _sums(row[rare], term[rare], value[rare], matrix)
    out[rows] += more
    return out, dense


def _units(part: Part, idf: np.ndarray):
    """The part's stretches at length one, some at a time: row, term, weight and number of rows."""
    at, term, n = part.counts(part.stretch, part.term, len(idf))
    weight = n * idf[term]
    size = np.sqrt(np.bincount(at, weight * weight, minlength=part.stretches))
    weight = (weight / size[at]).astype(np.float32)
    for low in range(0, part.stretches, _STRETCHES):
        a, b = np.searchsorted(at, [low, low + _STRETCHES]).tolist()
        if b > a:
            yield at[a:b] - low, term[a:b], weight[a:b], min(_STRETCHES, part.stretches - low)


def add_up(table: DataFrame, partial, local: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """The sum of partial(part, total) over all parts: tasks' sums meet _FAN at a time."""

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf["sum"].iloc[0]).copy()
        for x in pdf["sum"].iloc[1:]:
            total += np.frombuffer(x)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "task": pdf["task"].iloc[:1], "sum": [total.tobytes()]})

    def emit(batches):
        from pyspark import TaskContext

        total = np.zeros((rows, columns))
        for part in parts(batches, local):
            partial(part, total)
        slices = [(i, total[a : a + _SLICE]) for i, a in enumerate(range(0, rows, _SLICE))]
        slices = [(i, x) for i, x in slices if x.any()]
        yield pa.RecordBatch.from_pydict({"part": pa.array([i for i, _ in slices], pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * len(slices), pa.int32()), "sum": pa.array([np.ascontiguousarray(x).tobytes() for _, x in slices], pa.binary())})

    schema = "part int, task int, sum binary"
    source = table.select("n_words", "terms", "gaps")
    found, tasks = source.mapInArrow(emit, schema), source.rdd.getNumPartitions()
    while tasks > 1:
        found = found.withColumn("task", (F.col("task") / _FAN).cast("int")).groupBy("part", "task").applyInPandas(sums, schema)
        tasks = -(-tasks // _FAN)
    total = np.zeros((rows, columns))
    for r in found.collect():  # rows by columns numbers
        x = np.frombuffer(r["sum"]).reshape(-1, columns)
        total[r["part"] * _SLICE : r["part"] * _SLICE + len(x)] = x
    return total


def latent_axes(table: DataFrame, block: Block, local: np.ndarray, total: int, seed: int = 17) -> np.ndarray:
    """The latent axes (terms by rank) of the stretches' and items' vectors, by a randomised SVD. local: the block's number of each of the table's terms, or -1; total: of stretches."""
    size, idf = len(block.terms), block.idf
    rank = min(size, len(block.ids) + EXTRA)
    start = np.random.default_rng(seed).standard_normal((size, rank)).astype(np.float32)
    share = max(1, total) / len(block.ids)  # the items count as much as all stretches

    def power(part, sums):
        for row, term, weight, n in _units(part, idf):
            y, dense = _products(row, term, weight, n, start)
            sums[: dense.shape[1]] += dense.T @ y
            rare = np.flatnonzero(term >= _DENSE)
            rare = rare[np.argsort(term[rare], kind="stable")]
            terms, more = _sums(term[rare], row[rare], weight[rare], y)
            sums[terms] += more

    q, _ = np.linalg.qr(add_up(table, power, local, size, rank) + share * (block.vectors.T @ (block.vectors @ start)))
    q = q.astype(np.float32)

    def gram(part, sums):
        for row, term, weight, n in _units(part, idf):
            y, _ = _products(row, term, weight, n, q)
            sums += y.T @ y

    own = block.vectors @ q
    values, axes = np.linalg.eigh(add_up(table, gram, local, rank, rank) + share * (own.T @ own).astype(float))
    kept = values > values.max() * 1e-9
    return (q @ axes[:, kept]).astype(np.float32)


def near_passages(part: Part, block: Block, axes: np.ndarray, items: np.ndarray):
    """(row, first stretch in the row, item, cosine) of the part's passages that are near an item."""
    size = len(block.idf)
    all_at, all_term, all_n = part.counts(part.stretch, part.term, size)
    row_of = np.repeat(np.arange(len(part.first) - 1), np.diff(part.first))
    widths = np.unique(block.window).tolist()
    for low in range(0, part.stretches, _STRETCHES):
        high = min(part.stretches, low + _STRETCHES + widths[-1])
        a, b = np.searchsorted(all_at, [low, high]).tolist()
        at, term, n = all_at[a:b] - low, all_term[a:b], all_n[a:b]
        y, dense = _products(at, term, (n * block.idf[term]).astype(np.float32), high - low, axes)
        folded, common = (np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=float)]) for x in (y, dense))
        rare = term >= _DENSE
        at, term, n = at[rare], term[rare], n[rare]
        for width in widths:
            own = np.flatnonzero(block.window == width)
            begin = np.arange(low, min(part.stretches, low + _STRETCHES))
            first, last = part.first[:-1][row_of[begin]], part.first[1:][row_of[begin]]
            kept = (begin + width <= last) | (begin == first)
            begin, stop = begin[kept] - low, np.minimum(begin + width, last)[kept] - low
            if not len(begin):
                continue
            # the passages' lengths, from their counts; each stretch's rare terms go to the passages that hold it
            squares = np.square(common[stop] - common[begin]).sum(axis=1)
            number = np.full(high - low, -1)
            number[begin] = np.arange(len(begin))
            from_ = np.concatenate([at - k for k in range(width)])
            passage = np.where(from_ >= 0, number[np.maximum(from_, 0)], -1)
            held = (passage >= 0) & (np.tile(at, width) < stop[passage])
            cell, place = np.unique(passage[held] * size + np.tile(term, width)[held], return_inverse=True)
            weight = np.bincount(place, np.tile(n, width)[held], minlength=len(cell)) * block.idf[cell % size]
            length = np.sqrt(squares + np.bincount(cell // size, weight * weight, minlength=len(begin)))
            y = (folded[stop] - folded[begin]).astype(np.float32)
            cosine = y @ items[own].T / np.maximum(1e-9, length)[:, None].astype(np.float32)
            i, j = np.nonzero((cosine >= block.near[own][None, :].astype(np.float32)) & (length > 1e-9)[:, None])
            row = row_of[begin[i] + low]
            yield from zip(row.tolist(), (begin[i] + low - part.first[row]).tolist(), own[j].tolist(), cosine[i, j].tolist(), strict=True)


def search(table: DataFrame, block: Block, axes: np.ndarray, local: np.ndarray) -> DataFrame:
    """doc_id, t, item (its number in the block), cosine, common and answer of each passage that leaks."""
    items = block.vectors @ axes
    sent = table.sparkSession.sparkContext.broadcast((block, axes, items, local))  # bounded by the block's items

    def check(batches):
        block, axes, items, local = sent.value
        for part in parts(batches, local):
            rows: dict[str, list] = {k: [] for k in ("row", "item", "cosine", "common", "answer")}
            bounds = np.searchsorted(part.row, np.arange(part.batch.num_rows + 1))
            for row, stretch, item, cosine in near_passages(part, block, axes, items):
                size = len(block.words[item])
                place = part.place[bounds[row] : bounds[row + 1]]
                a, b = np.searchsorted(place, [stretch * STRIDE - size, (stretch + int(block.window[item])) * STRIDE + size]).tolist()
                own = part.term[bounds[row] + a : bounds[row] + b].tolist()
                common = common_words(block.places[item], size, own) / size
                if common >= PARAPHRASE:
                    answer = common_words(block.answer_places[item], len(block.answers[item]), own) / max(1, len(block.answers[item]))
                    if common >= VERBATIM or answer >= ANSWER:
                        for k, v in zip(rows, (row, item, float(cosine), common, answer), strict=True):
                            rows[k].append(v)
            at = pa.array(rows["row"], pa.int64())
            yield pa.RecordBatch.from_arrays([part.batch.column(0).take(at), part.batch.column(1).take(at), pa.array(rows["item"], pa.int32()), *(pa.array(rows[k], pa.float64()) for k in ("cosine", "common", "answer"))], names=["doc_id", "t", "item", "cosine", "common", "answer"])

    return table.mapInArrow(check, f"doc_id {id_type(table)}, t long, item int, cosine double, common double, answer double")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that leaks into it: doc_id, t (hash of the text), item_id, cosine, common (share of the item's words in the longest common subsequence), answer (the same for the answer's words).

    Null and empty texts and items without a word have no leaks; rows alike in doc_id and text are one document; rows alike in item_id count as one item by their best leak; an empty table on either side gives no rows. Other columns are ignored but for the benchmark's `answer`. Ids may have any type."""
    spark = docs.sparkSession
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    kind = id_type(benchmark, "item_id")
    result = spark.createDataFrame([], f"doc_id {id_type(docs)}, t long, item_id {kind}, cosine double, common double, answer double")
    items = benchmark.select("item_id", "text", answer.alias("answer")).distinct()
    blocks = max(1, -(-items.count() // ITEMS))
    for g in range(0, blocks, GROUP):
        number = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
        own = range(g, min(g + GROUP, blocks))
        rows = items.withColumn("b", number).where(F.col("b").between(own[0], own[-1])).orderBy("item_id", "text", "answer").collect()
        group = [b for b in (Block([r for r in rows if r["b"] == k]) for k in own) if b.ids]
        if not group:
            continue
        words = sorted({w for b in group for w in b.terms})
        at = {w: i for i, w in enumerate(words)}
        table = written(term_table(docs, words), "terms")
        frequency, total = stretch_frequency(table, words)
        for block in group:
            block.weigh(frequency, total)
            local = np.full(len(words), -1, np.int64)
            local[[at[w] for w in block.terms]] = np.arange(len(block.terms))
            hits = search(table, block, latent_axes(table, block, local, total), local)
            names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
            best = hits.join(F.broadcast(names), "item").groupBy("doc_id", "t", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "common", "answer")))
            result = result.unionByName(written(best, "leaks"))
        forget(table)
    return result.groupBy("doc_id", "t", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "common", "answer"))) if blocks > 1 else result


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak."""
    own_id, own_key = unused(docs, "own_id", "own_key")
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias(own_id), F.col("t").alias(own_key)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col("text")) == F.col(own_key)), "left_anti")


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("t")


QUERIES = {"op1_latent_decontamination": op1_latent_decontamination}
SQL: dict[str, str] = {}

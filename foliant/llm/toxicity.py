"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are at most SAMPLE labelled rows in expectation, half of them toxic where there are so many, drawn by a hash of doc_id. A vector holds all lower-cased words of a text, by (1 + ln tf) * ln(N / df) * (1 + z), at length one. Document frequencies come from all documents. z is how far a word goes with toxic examples, by standard deviations: the signed root of chi-squared of the word's presence and the label over the examples, 0 where it is negative. No word is left out: words that no example has count for a text's length; their document frequencies are counted in OTHERS slots by hash, and words that share a slot count as one.

The index holds the HEADS most frequent terms, which most postings belong to, as rows over all examples: texts are multiplied with them many at a time. For each other term it holds postings by blocks of BLOCK examples, and each block's largest weight. A query bounds a block's scores by the best of its sums over those rows and its other terms' largest weights, visits blocks from the highest bound down, some at a time, and stops where the bound falls below its k-th best score, at first that of the rows' sums. What comes near is added again in 64 bits: the K nearest are exact, ties going to the smaller doc_id. Votes are weighted by 1 / (FAR + 1 - cosine). Votes that each example gets from the others, weighted by its label's share of all labelled rows, are made into calibrated scores by isotonic regression. A text that shares no word with any example gets the share of toxic rows among such examples, or among all where there are none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import documents, id_type, lowered_words, small, small_batches, span_hashes, written

#: Labelled rows that are examples, in expectation.
SAMPLE = 4000
K, FAR, BLOCK = 15, 0.05, 128
#: Terms that the index holds as rows over all examples, texts that are multiplied with those at a time, and more than two such sums of 32-bit floats can be off.
HEADS, TOGETHER, SLACK = 512, 256, 1e-4
#: Slots for the words that no example has.
OTHERS = 1 << 18
TOXIC = 0.7


class Terms:
    """All words of the examples (hashes, sorted), then slots for other words."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.known = hashes, len(hashes)
        self.total = self.known + OTHERS

    def counts(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and count of each term in each text."""
        data, begin, end, before = lowered_words(array)
        text = np.searchsorted(before, np.arange(len(begin)), "right") - 1
        own = span_hashes(data, begin, end)
        at = np.searchsorted(self.hashes, own)
        found = self.hashes[np.minimum(at, len(self.hashes) - 1)] == own if len(self.hashes) else np.zeros(len(own), bool)
        pairs, counts = np.unique(text * self.total + np.where(found, at, self.known + (own % np.uint64(OTHERS)).astype(np.int64)), return_counts=True)
        return pairs // self.total, pairs % self.total, counts


def example_words(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """doc_id, label, and the distinct words' hashes and counts of each row (doc_id, text, toxic): tasks count the words, so whole texts don't come to the driver."""

    def run(batches):
        for batch in small_batches(batches):
            data, begin, end, before = lowered_words(batch.column(1))
            own = span_hashes(data, begin, end)
            each = [np.unique(own[a:b], return_counts=True) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([h.view(np.int64) for h, _ in each], pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in each], pa.list_(pa.int32()))], names=["doc_id", "toxic", "h", "n"])

    found = rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, h array<long>, n array<int>").toArrow()
    hashes = [np.array(x.values.to_numpy()).view(np.uint64) for x in found["h"]]
    counts = [x.values.to_numpy().astype(np.int64) for x in found["n"]]
    ids, toxic = found["doc_id"].to_numpy(), found["toxic"].to_numpy()
    order = sorted(range(found.num_rows), key=lambda i: (int(ids[i]), hashes[i].tobytes(), counts[i].tobytes()))
    order = np.array(order, np.int64)
    return ids[order], toxic[order], [hashes[i] for i in order], [counts[i] for i in order]


def leaning(text: np.ndarray, term: np.ndarray, toxic: np.ndarray, total: int) -> np.ndarray:
    """How many standard deviations each term goes with toxic texts, at least 0. text and term: which term each text has, each pair once."""
    n1, n0 = float(toxic.sum()), float(len(toxic) - toxic.sum())
    a = np.bincount(term[toxic[text] == 1], minlength=total).astype(float)
    c = np.bincount(term[toxic[text] == 0], minlength=total).astype(float)
    z = (a * (n0 - c) - c * (n1 - a)) * np.sqrt((n1 + n0) / np.maximum(1e-9, n1 * n0 * (a + c) * (n1 + n0 - a - c)))
    return np.where((a + c > 0) & (a + c < n1 + n0), np.maximum(0, z), 0)


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), then the same of the others."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Index:
    """Examples' vectors by term: the `heads` most frequent terms as rows over all examples, the others as postings by block. vectors: (terms, weights) of each, of length one and by ascending terms; ids break ties. Terms from `terms` on are in neither."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, ids: np.ndarray, terms: int, block: int = BLOCK, heads: int = HEADS):
        lead = [int(t[np.argmax(w)]) for t, w in vectors]
        order = sorted(range(len(vectors)), key=lambda i: (lead[i], -float(vectors[i][1].max()), int(ids[i])))  # alike examples share blocks: tight bounds
        self.labels, self.ids, self.block = labels[order], ids[order], block
        self.size, self.terms = len(order), terms
        self.blocks = -(-self.size // block)
        term, weight = np.concatenate([vectors[i][0] for i in order]).astype(np.int64), np.concatenate([vectors[i][1] for i in order])
        place = np.repeat(np.arange(self.size), [len(vectors[i][0]) for i in order])
        frequency = np.bincount(term, minlength=terms)
        head = np.argsort(-frequency, kind="stable")[: min(heads, np.count_nonzero(frequency))]
        self.slot = np.full(terms, -1)
        self.slot[head] = np.arange(len(head))
        slot = self.slot[term]
        self.head = np.zeros((len(head), self.size))
        self.head[slot[slot >= 0], place[slot >= 0]] = weight[slot >= 0]
        self.rough = self.head.astype(np.float32)
        term, self.place, self.weight = term[slot < 0], place[slot < 0], weight[slot < 0]
        by_term = np.argsort(term, kind="stable")  # places stay in order
        term, self.place, self.weight = term[by_term], self.place[by_term], self.weight[by_term]
        # a cell: the postings of one term in one block
        cell = term * self.blocks + self.place // block
        start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
        self.cell_start = np.append(start, len(cell))
        self.cell_block = self.place[start] // block
        self.max = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.first = np.searchsorted(term[start], np.arange(terms + 1))  # each term's first cell
        self.order = order
        self.visited = 0

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a positive cosine, the nearest first; without: a place to leave out."""
        return next(self.each_nearest([(terms, weights)], k, [without]))

    def each_nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None):
        """What nearest() gives for each of the vectors, whose most frequent terms are multiplied TOGETHER."""
        for first in range(0, len(vectors), TOGETHER):
            some = [(t[t < self.terms], w[t < self.terms]) for t, w in vectors[first : first + TOGETHER]]
            rows = [self.slot.take(t) for t, _ in some]
            rough = np.zeros((len(some), len(self.head)), np.float32)
            for i, (_, w) in enumerate(some):
                rough[i, rows[i][rows[i] >= 0]] = w[rows[i] >= 0]
            rough = rough @ self.rough
            if without is not None:
                for i, place in enumerate(without[first : first + TOGETHER]):
                    if place >= 0:
                        rough[i, place] = -np.inf
            top = np.maximum.reduceat(rough, np.arange(0, self.size, self.block), axis=1)
            for i, (t, w) in enumerate(some):
                in_head = rows[i] >= 0
                places, scores = self._candidates(t[~in_head], w[~in_head], k, rough[i], top[i])
                # exact, and the same whatever texts are beside: added term by term
                scores = scores + (self.head.take(rows[i][in_head][:, None] * self.size + places) * w[in_head][:, None]).sum(0)
                best = np.lexsort((self.ids[places], -np.round(scores, 12)))[:k]
                yield places[best], scores[best]

    def _candidates(self, terms: np.ndarray, weights: np.ndarray, k: int, rough: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all examples with a positive cosine that are among the k nearest, or within SLACK, and their cosines by these terms alone. rough: each example's cosine by the terms in rows, top: the largest in each block."""
        first, end = self.first.take(terms), self.first.take(terms + 1)
        cells, w = _spread(first, end - first), np.repeat(weights, end - first)
        block = self.cell_block.take(cells)
        bound = top + np.bincount(block, w * self.max.take(cells), self.blocks)
        order = np.argsort(-bound, kind="stable")
        line = max(0.0, float(np.partition(rough, -k)[-k])) if self.size >= k else 0.0  # no weight is negative: other terms can only add
        places, own, scores = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        at, step = 0, 4
        while at < self.blocks:
            some = order[at:]
            some = some[(bound[some] > 0) & (bound[some] >= line - SLACK)]
            if not len(some):
                break
            chosen = np.zeros(self.blocks, bool)
            if 2 * len(some) > self.blocks:  # postings of most blocks are read term by term, across blocks
                chosen[some] = True
                start, stop, by = self.cell_start.take(first), self.cell_start.take(end), weights
            else:
                some, step = some[:step], 4 * step
                chosen[some] = True
                on = np.flatnonzero(chosen.take(block))
                start, stop, by = self.cell_start.take(cells.take(on)), self.cell_start.take(cells.take(on) + 1), w.take(on)
            at += len(some)
            self.visited += len(some)
            post = _spread(start, stop - start)
            add = np.bincount(self.place.take(post), np.repeat(by, stop - start) * self.weight.take(post), self.size)
            got = rough + add
            hit = np.flatnonzero((got > 0) & (got >= line - SLACK))
            hit = hit[chosen.take(hit // self.block)]
            places, own, scores = np.concatenate([places, hit]), np.concatenate([own, add.take(hit)]), np.concatenate([scores, got.take(hit)])
            if len(places) > k:
                line = max(line, float(np.partition(scores, -k)[-k]))
                near = scores >= line - SLACK
                places, own, scores = places[near], own[near], scores[near]
        return places, own


def vote(cosines: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    w = weight / (FAR + 1 - np.minimum(1.0, cosines))
    return float((w * labels).sum() / w.sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising step function nearest to y at x by weighted squares: both ends of each step, and its value there. Scores between steps lie on straight lines."""
    at, place = np.unique(x, return_inverse=True)
    total, weight = np.bincount(place, w * y), np.bincount(place, w)
    blocks: list[list[float]] = []
    for one in zip(at.tolist(), at.tolist(), total.tolist(), weight.tolist(), strict=True):
        blocks.append(list(one))
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            last = blocks.pop()
            blocks[-1][1] = last[1]
            blocks[-1][2] += last[2]
            blocks[-1][3] += last[3]
    return np.array([b[i] for b in blocks for i in ((0, 1) if b[1] > b[0] else (0,))]), np.array([b[2] / b[3] for b in blocks for _ in range(1 + (b[1] > b[0]))])


class Model:
    def __init__(self, terms: Terms):
        self.terms = terms
        self.idf = np.ones(terms.total)  # times 1 + leaning
        self.index: Index | None = None
        self.steps, self.values = np.zeros(0), np.zeros(0)
        self.weight = np.ones(2)
        self.base = 0.0

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        return terms, w / max(1e-12, float(np.sqrt(w @ w)))

    def raw(self, texts: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None):
        """For each of the texts (terms and counts) the examples' vote, None where no example has a word of it, and the nearest ones' places and cosines."""
        found = iter(() if self.index is None else self.index.each_nearest([self.vector(*x) for x in texts], K, without))
        for _ in texts:
            places, cosines = next(found, (np.zeros(0, np.int64), np.zeros(0)))
            labels = self.index.labels[places] if len(places) else places
            yield vote(cosines, labels, self.weight[labels]) if len(places) else None, places, cosines

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]):
        """For each of the texts (terms and counts) the calibrated score, and the nearest examples' doc_ids and cosines as evidence."""
        for v, places, cosines in self.raw(texts):
            if v is None or not len(self.steps):
                yield self.base, [], []
            else:
                yield min(1.0, max(0.0, float(np.interp(v, self.steps, self.values)))), self.index.ids[places].tolist(), cosines.tolist()


def document_frequencies(docs: DataFrame, terms: Terms) -> tuple[np.ndarray, int]:
    """The number of rows of docs that have each term, and that of all rows."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by the examples' words

    def run(batches):
        total, rows = np.zeros(sent.value.total, np.int64), 0
        for batch in small_batches(batches, 0):
            rows += batch.num_rows
            total += np.bincount(sent.value.counts(batch.column(0))[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"t": pa.array(np.append(at, -1), pa.int64()), "n": pa.array(np.append(total[at], rows), pa.int64())})

    found = docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each term
    t, n = (found.column(i).to_numpy() for i in (0, 1))
    df = np.zeros(terms.total, np.int64)
    df[t[t >= 0]] = n[t >= 0]
    return df, int(n[t < 0].sum())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model. labels: doc_id and toxic (0 or 1); rows with a remainder of 1 by 3 or without a label are not learnt from. doc_id is a whole number."""
    usable = labels.where((F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic")), F.lit(1_000_000))
    rate = lambda label: F.lit(1e6 * sample / 2 / max(1, sizes.get(label, 0)))
    drawn = small(written(usable.where(draw < F.when(F.col("toxic") == 1, rate(1)).otherwise(rate(0))), "examples"))  # `sample` rows in expectation
    ids, toxic, hashes, counts = example_words(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(drawn, "doc_id"))
    model = Model(Terms(np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)))
    if not len(ids):
        return model
    own = [(np.searchsorted(model.terms.hashes, h), n) for h, n in zip(hashes, counts, strict=True)]
    df, total = document_frequencies(docs, model.terms)
    text = np.repeat(np.arange(len(own)), [len(t) for t, _ in own])
    model.idf = (np.log((1 + total) / (1 + df)) + 1e-6) * (1 + leaning(text, np.concatenate([t for t, _ in own]), toxic, model.terms.total))
    share = np.array([sizes.get(i, 0) / max(1, int((toxic == i).sum())) for i in (0, 1)])
    model.weight = share
    full = [i for i, (t, _) in enumerate(own) if len(t)]
    bare = [i for i, (t, _) in enumerate(own) if not len(t)]
    w = share[toxic]
    model.base = float((w[bare] * toxic[bare]).sum() / w[bare].sum()) if bare else float((w * toxic).sum() / w.sum())
    if full:
        model.index = Index([model.vector(*own[i]) for i in full], toxic[full], ids[full], model.terms.known)
        votes, truth = [], []
        for j, (v, _, _) in zip(model.index.order, model.raw([own[full[j]] for j in model.index.order], list(range(model.index.size))), strict=True):
            if v is not None:
                votes.append(v)
                truth.append(full[j])
        if votes:
            model.steps, model.values = isotonic(np.array(votes), toxic[truth].astype(float), w[truth])
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, score, predicted, evidence (doc_ids of the nearest examples) and cosines.

    Null and empty texts, and texts that share no word with an example, have the score of examples without a word, or that of all where there are none. Repeated rows are scored each; an empty table gives no rows; without labels every score is 0; other columns are ignored. doc_id is a whole number in both tables."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))  # bounded by SAMPLE

    def run(batches):
        model = sent.value
        for batch in small_batches(batches):
            text, term, n = model.terms.counts(batch.column(1))
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1)).tolist()
            found = list(model.scores([(term[a:b], n[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]))
            scores = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(x >= TOXIC) for x in scores], pa.int32()), pa.array([x[1] for x in found], pa.list_(pa.int64())), pa.array([x[2] for x in found], pa.list_(pa.float64()))], names=["doc_id", "score", "predicted", "evidence", "cosines"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, score double, predicted int, evidence array<bigint>, cosines array<double>")


def op8_blockmax_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", "predicted", F.slice("evidence", 1, 3).alias("evidence"))


QUERIES = {"op8_blockmax_toxicity": op8_blockmax_toxicity}
SQL: dict[str, str] = {}

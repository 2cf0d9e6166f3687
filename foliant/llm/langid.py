"""Language of a text: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters of the lower-cased text (runs of white space count as one space) are hashed into BUCKETS; a text's vector is (1 + ln tf) * idf, at length one. idf comes from all rows that may be learnt from. Weights are fitted by follow-the-regularised-leader with elastic-net penalties on at most SAMPLE rows in expectation, drawn by a hash of doc_id, at most equally many a language; every fifth of them is left out of the fit and sets the temperature that makes the scores calibrated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import documents, small_batches

BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
SAMPLE = 6000
#: FTRL: step, its offset, elastic net, and passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.1, 3
UNKNOWN = "und"

_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def ngram_counts(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams and how often each occurs."""
    chars = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    parts, h = [], np.zeros(len(chars), np.uint32)
    for n, mix in zip(ORDERS, _MIX, strict=True):
        if len(chars) < n:
            break
        h = h[: len(chars) - n + 1] * np.uint32(31) + (chars[n - 1 :] + np.uint32(1)) * mix
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
        parts.append(mixed >> shift)
    counts = np.bincount(np.concatenate(parts), minlength=buckets)
    at = np.flatnonzero(counts)
    return at, counts[at]


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float):
        self.languages, self.weights, self.bias, self.idf, self.temperature = languages, weights, bias, idf, temperature

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return tfidf(*ngram_counts(text, len(self.idf)), self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; UNKNOWN and 0 for a null text or one without a letter."""
        if text is None or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, x = self.vector(text)
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def tfidf(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (1 + np.log(n)) * idf[at]
    return at, x / max(1e-12, float(np.sqrt(x @ x)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, buckets: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal, a row at a time in a fixed shuffled order; L1 keeps weights of rare n-grams at zero."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, buckets), np.append(x, 1.0)  # the last row is the bias
            w = weights(at)
            g = softmax(x @ w)
            g[labels[i]] -= 1
            grad = x[:, None] * g
            sq = grad * grad
            z[at] += grad - (np.sqrt(n[at] + sq) - np.sqrt(n[at])) / ALPHA * w
            n[at] += sq
    w = weights(np.arange(buckets + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        return -np.log(np.maximum(1e-12, softmax(logits / np.exp(t))[np.arange(len(labels)), labels])).mean()

    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def learnable():
    """Rows that may be learnt from: crc32 of doc_id as text leaves a remainder other than 2 by 4, and the language is known."""
    return (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2) & F.col("lang").isNotNull()


def document_frequency(texts: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many texts there are. A task counts its own texts first; the driver gets a row for each bucket."""

    def count(batches):
        total, seen = np.zeros(buckets, np.int64), 0
        for batch in small_batches(batches, 0):
            for text in batch.column(0).to_pylist():
                if text is not None:
                    total[ngram_counts(text, buckets)[0]] += 1
                    seen += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"b": pa.array(np.append(at, -1), pa.int64()), "n": pa.array(np.append(total[at], seen), pa.int64())})

    rows = texts.mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(buckets, np.int64)
    for r in rows:
        if r["b"] >= 0:
            found[r["b"]] = r["n"]
    return found, next((r["n"] for r in rows if r["b"] == -1), 0)


def train(docs: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> Model:
    """Fits on docs (doc_id, text, lang). A table with no row to learn from gives a model that knows no language."""
    known = docs.select("doc_id", "text", "lang").where(learnable() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((buckets, 0)), np.zeros(0), np.ones(buckets), 1.0)
    found, total = document_frequency(known.select("text"), buckets)
    idf = np.log((1 + total) / (1 + found)) + 1
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1_000_000))
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(1e6 * sample / len(languages) / sizes[lang])).otherwise(share)
    rows = known.where(draw < share).select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "text", "lang").collect()
    rows = sorted((r for r in rows if has_letter(r["text"])), key=lambda r: (r["h"], r["text"]))
    vectors = [tfidf(*ngram_counts(r["text"], buckets), idf) for r in rows]
    labels = np.array([languages.index(r["lang"]) for r in rows], int)
    fit = [i for i in range(len(rows)) if i % 5]
    w, b = fit_ftrl([vectors[i] for i in fit], labels[fit], len(languages), buckets)
    rest = [i for i in range(len(rows)) if i % 5 == 0]
    logits = np.array([vectors[i][1] @ w[vectors[i][0]] + b for i in rest]).reshape(len(rest), len(languages))
    return Model(languages, w, b, idf, fit_temperature(logits, labels[rest]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (its columns of these names are replaced). Only the text is looked at. Null and letterless texts get `und` and 0; an empty table gives no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets times languages
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = kept.index("text")

    def run(batches):
        model = sent.value
        for batch in small_batches(batches, place):
            found = [model.predict(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    return docs.select(*kept).mapInArrow(run, f"{schema}, lang_pred string, score double")


def op4_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), train(docs))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_ftrl_language": op4_ftrl_language}
SQL: dict[str, str] = {}

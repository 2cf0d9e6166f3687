"""From documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept: documents without a known language go; runs of lines that an earlier document has already are cut out, and documents that consisted of such runs alone go; of each group of near copies the document with the least id stays; documents that hold a benchmark item go; what is left is packed into sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import decontaminate, langid, lines, packing, simhash
from foliant.llm.common import documents, shorter_batches, unused, written

#: The rows come from models and searches that SQL has no form for.
ORACLE_SQL = None
#: A language has to have at least this calibrated probability.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the learnt languages."""
    shorter_batches(spark)
    own = dict(zip(("lang_pred", "score"), unused(docs, "lang_pred", "score"), strict=True))  # the documents' own columns of these names stay
    found = langid.identify(docs.withColumnsRenamed(own), langid.train(docs))
    known = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return known.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated runs of lines; n_chars follows the text."""
    shorter_batches(spark)
    own = dict(zip(("n_lines", "n_removed"), unused(docs, "n_lines", "n_removed"), strict=True))
    cut = lines.remove_repeated_lines(docs.withColumnsRenamed(own))
    cut = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return cut.drop("n_lines", "n_removed").withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    shorter_batches(spark)
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    shorter_batches(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, each with its sequence and place."""
    shorter_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("language_id", known_language), ("line_dedup", dedup_lines), ("simhash_near_dedup", near_dedup), ("decontamination", without_benchmark), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over a written table of what its predecessor kept."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else written(docs, "stage"), sf_dir)
    return docs

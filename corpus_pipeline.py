"""Pipeline over documents: quality, exact and near duplicates, benchmark passages, packing.

Every stage but the last keeps the columns of documents and drops rows. Rows are told apart by doc_id and a hash of the
text; of rows that repeat both, the exact-dedup stage leaves one. Null and empty texts are texts without words: the
classifier scores them, exact dedup keeps one of all texts without a character but white space, and a packed one has the
end id alone. A null doc_id is an id of its own, after all others. Texts of any length are read whole. Further columns, of
any name, are kept; an empty table gives an empty one. SQL can't express the stages; tests/llm holds them against plain
versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import saved, small_batches, unused
from driftloom.llm.lsa_decontam import found_items
from driftloom.llm.near_copies import near_components
from driftloom.llm.pattern_packing import pack_documents
from driftloom.llm.polynomial_dedup import polynomial_dedup
from driftloom.llm.quality_mil import THRESHOLD, fit, score_column

ORACLE_SQL = None


def _only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of docs that chosen (doc_id, h) names, each once."""
    own = unused(docs, "h")
    chosen = chosen.select("doc_id", "h").distinct()
    rows = docs.withColumn(own, F.xxhash64("text"))
    same: Column = rows["doc_id"].cast("long").eqNullSafe(chosen["doc_id"]) & (rows[own] == chosen["h"])
    return rows.join(chosen, same, "left_semi").drop(own)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    small_batches(spark)
    return docs.where(score_column(fit(docs, labels), F.col("text")) >= THRESHOLD)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the longest before white space is taken out, then that with the smallest doc_id."""
    kept = polynomial_dedup(docs).where("kept")
    own = unused(docs, "own")
    rows = _only(docs.withColumn(own, F.xxhash64("text")), kept)
    return rows.dropDuplicates(["doc_id", own]).drop(own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (3 bits of 64, or 5-word Jaccard of 0.8), the row with the smallest doc_id."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least")
    return _only(docs, near_components(docs).groupBy("root").agg(least).select("least.doc_id", "least.h"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item."""
    return docs.where(F.size(found_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))) == 0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every row, in sequences of 2,048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

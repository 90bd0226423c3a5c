"""Findings as JSON, one document an article."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FAULT = "_fault"


def read_findings(spark: SparkSession, path: str, schema: str, whole_files: bool = True) -> tuple[DataFrame, DataFrame]:
    """(findings, faults) of the JSON files that path (a glob) names: documents with an article, with their path; and the
    paths of those that can't be read, or name none, with a reason. schema: DDL with article."""
    reader = spark.read.schema(f"{schema}, {FAULT} string").option("multiLine", whole_files).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", FAULT)
    rows = reader.json(path).withColumn("path", F.input_file_name())
    reason = F.when(F.col(FAULT).isNotNull(), "invalid_artifact").when(F.trim(F.coalesce("article", F.lit(""))) == "", "article_missing")
    rows = rows.withColumn("_reason", reason)
    return rows.where("_reason is null").drop("_reason", FAULT), rows.where("_reason is not null").select("path", F.col("_reason").alias("reason"))


def prefer_shards(legacy: DataFrame, shards: DataFrame) -> DataFrame:
    """One document an article: a shard's wins over a legacy one, and the last path among equals."""
    rows = legacy.withColumn("_rank", F.lit(0)).unionByName(shards.withColumn("_rank", F.lit(1)), allowMissingColumns=True)
    place = Window.partitionBy("article").orderBy(F.desc("_rank"), F.desc("path"))
    return rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n", "_rank")


def write_findings(findings: DataFrame, path: str) -> None:
    """Replace the findings at path. The job's committer shows them only when all are written."""
    findings.write.mode("overwrite").json(path)

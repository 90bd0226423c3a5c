"""The revision log as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "article string, rev_id long, ts timestamp, user string, size long"


def follow_revisions(spark: SparkSession, path: str, late: str = "30 days", schema: str = SCHEMA) -> DataFrame:
    """New JSON lines below path, each revision once. State is kept for revisions that come up to `late` after newer ones."""
    rows = spark.readStream.schema(schema).json(path).withColumn("user", F.coalesce("user", F.lit("<hidden>")))
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["article", "rev_id"])


def store_revisions(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take all that is there now into the table at path and stop; a later call goes on from the checkpoint."""
    return stream.writeStream.format("parquet").partitionBy("article").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def activity(stream: DataFrame, days: int = 180) -> DataFrame:
    """Revisions and users (estimated) of each article in windows of days. Expects a stream with a watermark on ts."""
    return stream.groupBy("article", F.window("ts", f"{days} days")).agg(F.count(F.lit(1)).alias("revisions"), F.approx_count_distinct("user").alias("users")).select("article", F.col("window.start").alias("start"), "revisions", "users")

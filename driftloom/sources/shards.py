"""A table as shards of an article each, verified against its source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import slug


def slug_collisions(articles: DataFrame) -> DataFrame:
    """Slugs that more than one article would share, with these articles."""
    rows = articles.where("article is not null").groupBy(slug(F.col("article")).alias("slug")).agg(F.array_sort(F.collect_set("article")).alias("articles"))
    return rows.where(F.size("articles") > 1)


def export_shards(table: DataFrame, path: str, owner: str = "article") -> None:
    """Write the rows with an owner below path, in a folder for each slug."""
    table.where(F.col(owner).isNotNull()).withColumn("slug", slug(F.col(owner))).write.mode("overwrite").partitionBy("slug").parquet(path)


def shard_faults(table: DataFrame, path: str, owner: str = "article") -> DataFrame:
    """Owners whose rows at path aren't as many as in the source: owner, expected, found. Empty if the export is whole."""
    count = lambda df, name: df.where(F.col(owner).isNotNull()).groupBy(F.col(owner).alias("owner")).agg(F.count(F.lit(1)).alias(name))
    rows = count(table, "expected").join(count(table.sparkSession.read.parquet(path), "found"), "owner", "full").na.fill(0, ["expected", "found"])
    return rows.where("expected <> found")


def digest_faults(spark: SparkSession, source: str, copy: str, pattern: str = "*") -> DataFrame:
    """Files below source whose copy is missing or differs (SHA-256), by path relative to the two folders."""

    def digests(folder: str, name: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
        own = F.regexp_replace("path", r"^file:/+", "/")
        return files.select(F.substring_index(own, folder.rstrip("/") + "/", -1).alias("file"), F.sha2("content", 256).alias(name))

    rows = digests(source, "digest").join(digests(copy, "copied"), "file", "left")
    return rows.where(~F.col("digest").eqNullSafe(F.col("copied"))).select("file", F.col("copied").isNull().alias("missing"))

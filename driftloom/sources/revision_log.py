"""Growing revision tables: append what is new, replace an article's rows whole, and record the source's state."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["article", "rev_id"]


def new_revisions(page: DataFrame, known: DataFrame | None) -> DataFrame:
    """Rows of page that the table lacks, each revision once. A hidden or missing user becomes <hidden>."""
    rows = page.withColumn("user", F.coalesce("user", F.lit("<hidden>"))).dropDuplicates(KEY)
    return rows if known is None else rows.join(known.select(*KEY), KEY, "left_anti")


def append_revisions(page: DataFrame, path: str) -> None:
    """Append a page to the table at path (Parquet, parted by article). Doing it again adds nothing."""
    new_revisions(page, _table(page, path)).write.mode("append").partitionBy("article").parquet(path)


def _table(like: DataFrame, path: str) -> DataFrame | None:
    """The table at path, if there is one, with the columns of like (so that an article's name stays a text)."""
    try:
        return like.sparkSession.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def replace_articles(rows: DataFrame, path: str) -> None:
    """Replace the rows of the articles that rows holds, and of no others: an article without new rows stays as it is."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("article").parquet(path)


def source_receipts(revisions: DataFrame, checked_at: Column, failures: DataFrame | None = None) -> DataFrame:
    """State of each article's source after a load. failures: article, reason (the load of that article failed)."""
    rows = revisions.groupBy("article").agg(F.max("rev_id").alias("source_latest_revid"))
    rows = rows.withColumn("reason", F.lit(None).cast("string")) if failures is None else rows.join(failures.select("article", "reason"), "article", "full")
    status = F.when(F.col("reason").isNull(), "history_complete").otherwise("unavailable")
    return rows.select("article", status.alias("source_status"), checked_at.alias("source_checked_at"), "source_latest_revid", "reason")

"""History exports: which of them were written to their end, and their revisions as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What closes an export, and within how many bytes of its end.
FOOTER, TAIL = "</mediawiki>", 256
#: Bytes in which the title is looked for.
HEAD = 65_536
FAULT = "_fault"
#: Elements of a revision that are read.
REVISION = (
    "id long, parentid long, timestamp string, contributor struct<username:string,ip:string,_deleted:string>, comment struct<_VALUE:string,_deleted:string>, "
    f"minor string, sha1 string, text struct<_VALUE:string,_deleted:string>, {FAULT} string"
)


def _title(value: Column) -> Column:
    return F.from_xml(F.concat(F.lit("<r>"), F.regexp_extract(value, "(<title>[^<]*</title>)", 1), F.lit("</r>")), "title string")["title"]


def export_files(spark: SparkSession, path: str, ranged: bool = True) -> DataFrame:
    """file, bytes, complete, article (the first page's title) for each file of path. An empty file has no row, like a missing one.

    ranged: tasks open the files and read their first HEAD and last TAIL bytes alone; a file is complete if the latter hold the
    closing tag. The store must be one that pyarrow knows (local, HDFS, S3, GCS). Else Spark reads all lines in splits and looks
    for the tag and the title, which escaped text can't hold; no file is held whole.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)  # contents aren't read
    files = listed.select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"))
    if not ranged:
        lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
        closed = lines.where(F.contains("value", F.lit(FOOTER))).select("file").distinct().withColumn("closed", F.lit(True))
        titles = lines.where(F.contains("value", F.lit("<title>"))).groupBy("file").agg(F.min(_title(F.col("value"))).alias("article"))
        return files.join(closed, "file", "left").join(titles, "file", "left").select("file", "bytes", F.coalesce("closed", F.lit(False)).alias("complete"), "article")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, complete = [], []
            for uri, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, name = pa.fs.FileSystem.from_uri(uri)
                with store.open_input_file(name) as f:
                    heads.append(f.read(HEAD).decode("utf-8", "replace"))
                    f.seek(max(0, size - TAIL))
                    complete.append(FOOTER.encode() in f.read(TAIL))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(complete, pa.bool_()), pa.array(heads, pa.string())], ["file", "bytes", "complete", "value"])

    found = files.mapInArrow(ends, "file string, bytes long, complete boolean, value string")
    return found.select("file", "bytes", "complete", _title(F.col("value")).alias("article"))


def read_history(spark: SparkSession, path: str, ranged: bool = True) -> tuple[DataFrame, DataFrame]:
    """(revisions, faults) of the exports below path, one article a file.

    revisions: file, article, rev_id, parent_id, ts, user, anonymous, user_hidden, comment, minor, sha1, text, size (bytes of the
    text in UTF-8). Revisions whose text is hidden are left out; a hidden user is null. Files are read record by record, so
    that no history is held whole.

    faults: file, reason, n. A file without its end is `truncated` and gives no revision, a record that can't be read, or has no
    id, is a `corrupt_record` of its file, and a file without a title is `untitled` and gives no revision either.
    """
    states = export_files(spark, path, ranged)
    reader = spark.read.format("xml").option("rowTag", "revision").option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", FAULT).option("ignoreSurroundingSpaces", False)
    records = reader.schema(REVISION).load(path).withColumn("file", F.col("_metadata.file_path"))
    whole = records.join(states.where("complete").select("file", "article"), "file")
    broken = F.col(FAULT).isNotNull() | F.col("id").isNull()
    shown = whole.where(~broken & F.col("text._deleted").isNull() & F.col("article").isNotNull())
    text = F.coalesce("text._VALUE", F.lit(""))
    user = F.coalesce("contributor.username", "contributor.ip")
    revisions = shown.select(
        "file", "article", F.col("id").alias("rev_id"), F.col("parentid").alias("parent_id"), F.try_to_timestamp("timestamp").alias("ts"), user.alias("user"),
        (F.col("contributor.username").isNull() & F.col("contributor.ip").isNotNull()).alias("anonymous"), user.isNull().alias("user_hidden"),
        F.col("comment._VALUE").alias("comment"), F.col("minor").isNotNull().alias("minor"), "sha1", text.alias("text"), F.octet_length(text).cast("long").alias("size"),
    )
    one = F.lit(1).cast("long")
    faults = states.where("not complete").select("file", F.lit("truncated").alias("reason"), one.alias("n"))
    faults = faults.unionByName(whole.where(broken).groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", F.lit("corrupt_record").alias("reason"), "n"))
    return revisions, faults.unionByName(states.where("complete and article is null").select("file", F.lit("untitled").alias("reason"), one.alias("n")))


def history_tables(revisions: DataFrame) -> dict[str, DataFrame]:
    """The corpus tables of what read_history() gives: revisions, rev_size, revision_metadata, texts; each revision once."""
    once = revisions.dropDuplicates(["article", "rev_id"])
    return {
        "revisions": once.select("article", "rev_id", "ts", F.coalesce("user", F.lit("<hidden>")).alias("user")),
        "rev_size": once.select("article", "rev_id", "size"),
        "revision_metadata": once.select("article", "rev_id", "parent_id", "sha1", "comment", F.array().cast("array<string>").alias("tags"), "minor", "user_hidden"),
        "texts": once.select("article", "rev_id", "ts", "comment", "text"),
    }

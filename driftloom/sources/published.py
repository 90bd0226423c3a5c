"""Tables that are replaced together, or not at all, article by article.

Each load writes its rows of all tables below a folder of its own, then a manifest that names, for every article, the load that
holds it. The file CURRENT names the manifest; replacing this one small file is what makes a load visible. Readers join the rows
with the manifest, so they see the old state of an article's tables or the new one, never a mixture, and a load that fails
leaves only a folder that nothing names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "article string, load string"


class Published:
    """Tables by name below a folder that the driver and all executors see. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, name: str):  # noqa: ANN202
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """The manifest's name; None before the first load."""
        at, store = self._hadoop("CURRENT")
        if not store.exists(at):
            return None
        return self.spark.read.text(f"{self.path}/CURRENT").first()[0]

    def manifest(self) -> DataFrame:
        name = self.current()
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{name}") if name else self.spark.createDataFrame([], MANIFEST)

    def read(self, table: str, schema: str) -> DataFrame:
        """The visible rows of a table; schema: DDL with article."""
        if self.current() is None:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, load string").parquet(f"{self.path}/tables/{table}")
        return rows.join(self.manifest(), ["article", "load"], "left_semi").select(*StructType.fromDDL(schema).fieldNames())

    def replace(self, articles: DataFrame, tables: dict[str, DataFrame], check: Callable[[dict[str, DataFrame]], None] | None = None) -> str:
        """Replace all rows of the articles (article) in all tables. check gets the written rows and raises an error to call the load off.

        An article without rows has none afterwards. An error leaves readers with the old state and takes the load's rows away.
        """
        load, named = uuid.uuid4().hex, articles.select("article").distinct()
        try:
            written = {}
            for name, rows in tables.items():
                at = f"{self.path}/tables/{name}/load={load}"
                rows.join(named, "article", "left_semi").write.parquet(at)
                written[name] = self.spark.read.schema(rows.schema).parquet(at)
            if check:
                check(written)
            new = self.manifest().join(named, "article", "left_anti").unionByName(named.withColumn("load", F.lit(load)))
            new.write.parquet(f"{self.path}/manifest-{load}")
            self._show(f"manifest-{load}")
        except BaseException:
            for name in (*(f"tables/{t}/load={load}" for t in tables), f"manifest-{load}"):
                at, store = self._hadoop(name)
                store.delete(at, True)
            raise
        return load

    def _show(self, manifest: str) -> None:
        """Name the manifest in CURRENT, by a rename that replaces it."""
        jvm = self.spark.sparkContext._jvm
        at, store = self._hadoop("CURRENT")
        part, _ = self._hadoop(f"CURRENT.{uuid.uuid4().hex}")
        out = store.create(part, True)
        out.write(bytearray(f"{manifest}\n".encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(part, at, how)

    def unused_loads(self) -> list[str]:
        """Folders of loads that no article's state rests on any more; they may go once no reader of an older manifest runs."""
        held = {r["load"] for r in self.manifest().select("load").distinct().collect()}
        at, store = self._hadoop("tables")
        if not store.exists(at):
            return []
        found = [f.getPath() for t in store.listStatus(at) for f in store.listStatus(t.getPath())]
        return sorted(str(p) for p in found if p.getName().startswith("load=") and p.getName()[5:] not in held)


def build_snapshots(published: Published, articles: DataFrame, rsnap: DataFrame, expected: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> None:
    """Snapshot rows, their integrity receipts and the articles' source states, visible together or not at all.

    expected: article, snap_rev of the snapshots that were picked; judge gives integrity receipts (article, snap_rev, status) for
    the rows. An article is current_complete if all expected snapshots have rows and none is quarantined, else partial.
    """
    integrity = judge(rsnap).checkpoint()
    want = expected.groupBy("article").agg(F.countDistinct("snap_rev").alias("expected_snapshots"))
    have = rsnap.join(expected.select("article", "snap_rev").distinct(), ["article", "snap_rev"], "left_semi").groupBy("article").agg(F.countDistinct("snap_rev").alias("loaded_snapshots"))
    bad = integrity.where("status = 'quarantined'").groupBy("article").agg(F.count(F.lit(1)).alias("bad"))
    rows = articles.select("article").distinct().join(want, "article", "left").join(have, "article", "left").join(bad, "article", "left").na.fill(0, ["expected_snapshots", "loaded_snapshots", "bad"])
    short = F.format_string("loaded_%d_of_%d", "loaded_snapshots", "expected_snapshots")
    reason = F.when(F.col("bad") > 0, F.format_string("quarantined_%d", "bad")).when((F.col("expected_snapshots") == 0) | (F.col("loaded_snapshots") < F.col("expected_snapshots")), short)
    states = rows.select("article", F.when(reason.isNull(), "current_complete").otherwise("partial").alias("source_status"), "expected_snapshots", "loaded_snapshots", reason.alias("reason"))
    published.replace(articles, {"rsnap": rsnap, "snapshot_integrity": integrity, "article_source_state": states})

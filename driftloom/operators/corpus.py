"""Corpus reads: usable snapshots, latest and as-of snapshots, revision evidence, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAP = ["article", "snap_date", "snap_rev"]


def usable_snapshots(rsnap: DataFrame, integrity: DataFrame | None) -> DataFrame:
    """Rows of snapshots that no receipt quarantines; without receipts all are usable."""
    if integrity is None:
        return rsnap
    return rsnap.join(integrity.where("status = 'quarantined'").select("article", "snap_rev").distinct(), ["article", "snap_rev"], "left_anti")


def snapshots_distinct(rsnap: DataFrame) -> DataFrame:
    """SNAP with k, the place in the article's order (from 0)."""
    order = Window.partitionBy("article").orderBy("snap_date", "snap_rev")
    return rsnap.select(*SNAP).distinct().withColumn("k", F.row_number().over(order) - 1)


def snapshot_as_of(rsnap: DataFrame, targets: DataFrame) -> DataFrame:
    """For each (article, as_of) the latest snapshot of that day or before; null if there is none."""
    snaps = rsnap.select(*SNAP).distinct()
    found = targets.join(snaps, "article", "left").groupBy("article", "as_of").agg(F.max(F.when(F.col("snap_date") <= F.col("as_of"), F.struct("snap_date", "snap_rev"))).alias("s"))
    return found.select("article", "as_of", "s.snap_date", "s.snap_rev")


def latest_snapshot(rsnap: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """The endpoint receipt's snapshot where there is a receipt (none if it is unstable), else the last one."""
    last = rsnap.groupBy("article").agg(F.max(F.struct("snap_date", "snap_rev")).alias("s"))
    if endpoints is None:
        return last.select("article", "s.snap_date", "s.snap_rev")
    chosen = endpoints.select("article", F.col("status").alias("_status"), F.struct(F.col("selected_snapshot_date").alias("snap_date"), F.col("selected_revid").alias("snap_rev")).alias("e"))
    pick = F.when(F.col("_status").isNull(), F.col("s")).when(F.col("_status") == "stable", F.col("e"))
    return last.join(chosen, "article", "left").withColumn("p", pick).select("article", "p.snap_date", "p.snap_rev")


def snapshot_count(rsnap: DataFrame) -> DataFrame:
    return rsnap.groupBy("article").agg(F.countDistinct("snap_rev").alias("snapshots"))


def articles_with_snapshots(rsnap: DataFrame, least: int) -> DataFrame:
    return snapshot_count(rsnap).where(F.col("snapshots") >= least)


def size_series(revisions: DataFrame, rev_size: DataFrame) -> DataFrame:
    return revisions.join(rev_size, ["article", "rev_id"]).select("article", "rev_id", "ts", "size", "user")


def revision_stats(revisions: DataFrame) -> DataFrame:
    return revisions.groupBy("article").agg(F.count(F.lit(1)).alias("revisions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("user").alias("editors"))


def revisions_between(revisions: DataFrame, windows: DataFrame) -> DataFrame:
    """Revisions with start_ts < ts <= end_ts, for each window (article, start_ts, end_ts)."""
    return windows.join(revisions, "article").where((F.col("ts") > F.col("start_ts")) & (F.col("ts") <= F.col("end_ts")))


def account_type(account: Column, explicit: Column | None = None) -> Column:
    """explicit, else hidden, anonymous_ip, bot or registered."""
    ipv4 = account.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)\z")
    ipv6 = account.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]+\z") & (F.length(account) - F.length(F.replace(account, F.lit(":"))) >= 2)
    own = F.when(account.isNull() | (account == "hidden"), "hidden").when(ipv4 | ipv6, "anonymous_ip").when(F.lower(account).endswith("bot"), "bot").otherwise("registered")
    return own if explicit is None else F.coalesce(explicit, own)


def revision_evidence_between(revisions: DataFrame, windows: DataFrame, metadata: DataFrame | None, rev_size: DataFrame | None) -> DataFrame:
    """Revisions with start_ts <= ts <= end_ts and what is known of them; null where a table or a row is missing."""
    rows = windows.join(revisions, "article").where(F.col("ts").between(F.col("start_ts"), F.col("end_ts")))
    kinds = {"parent_id": "long", "sha1": "string", "comment": "string", "tags": "array<string>", "minor": "boolean", "user_hidden": "boolean"}
    if metadata is None:
        rows = rows.withColumns({k: F.lit(None).cast(v) for k, v in kinds.items()})
    else:
        rows = rows.join(metadata.select("article", "rev_id", *kinds), ["article", "rev_id"], "left")
    rows = rows.withColumn("size", F.lit(None).cast("long")) if rev_size is None else rows.join(rev_size, ["article", "rev_id"], "left")
    account = F.when(F.coalesce("user_hidden", F.lit(False)), F.lit("hidden")).otherwise(F.coalesce("user", F.lit("hidden")))
    return rows.withColumn("account", account).withColumn("account_type", account_type(account)).withColumn("tags", F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))))


def keep_latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key; ties go to the greatest row."""
    others = [c for c in rows.columns if c not in key]
    best = F.max(F.struct(F.col(order).alias("_at"), *others)).alias("_best")
    return rows.groupBy(*key).agg(best).select(*key, *(F.col(f"_best.{c}").alias(c) for c in others))


def merged_state(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: values of new that aren't null win over those of old, row by row."""
    a, b = old.alias("a"), new.alias("b")
    columns = [c for c in old.columns if c != key]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *(F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns))


def revision_as_of(timeline: DataFrame, targets: DataFrame, after: bool = False) -> DataFrame:
    """As-of join on article: the last revision at or before at_ts, or, if after, the first at or after it."""
    place = F.struct("ts", "rev_id")
    if after:
        pick = F.min(F.when(F.col("ts") >= F.col("at_ts"), place))
    else:
        pick = F.max(F.when(F.col("ts") <= F.col("at_ts"), place))
    return targets.join(timeline.select("article", "ts", "rev_id"), "article", "left").groupBy("article", "at_ts").agg(pick.alias("r")).select("article", "at_ts", "r.rev_id", F.col("r.ts").alias("rev_ts"))

"""Backfills: parts of stored confirmations that a newer contract asks for are computed again, and only these.

A part (an interval profile, an event's attribution, its process context) is stored with a fingerprint of the contract that it
was computed under: version, thresholds and horizon. A part is stale if its fingerprint isn't the present one, or it is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..lineage import settled


def fingerprint(version: int, thresholds: dict, horizon_date: Column, horizon_rev: Column) -> Column:
    """Of a contract at a horizon; thresholds in any order."""
    terms = [f"{k}={float(thresholds[k])!r}" for k in sorted(thresholds)]
    return F.sha2(F.concat_ws("|", F.lit(f"v{version}"), *map(F.lit, terms), F.coalesce(horizon_date.cast("string"), F.lit("-")), F.coalesce(horizon_rev.cast("string"), F.lit("-"))), 256)


def refusals(confirmations: DataFrame, contract: dict, horizon: DataFrame, version: int, episodes: DataFrame | None = None) -> DataFrame:
    """article, reason (null: it may be backfilled): the first gate that a confirmation fails.

    confirmations: article, schema_version (null: 1), thresholds (map), horizon_date, horizon_rev, status; horizon: article,
    snap_date, snap_rev. With episodes (article) it must also be confirmed and have one.
    """
    items = lambda m: F.array_sort(F.map_entries(m))
    now = items(F.create_map(*(x for k, v in contract.items() for x in (F.lit(k), F.lit(float(v))))))
    held = items(F.coalesce(F.col("thresholds").cast("map<string,double>"), F.create_map().cast("map<string,double>")))
    rows = confirmations.join(horizon.select("article", F.col("snap_date").alias("_date"), F.col("snap_rev").alias("_rev")), "article", "left")
    there = F.col("_rev").isNotNull() & F.col("horizon_rev").eqNullSafe(F.col("_rev")) & F.col("horizon_date").eqNullSafe(F.col("_date"))
    reason = F.when(F.coalesce("schema_version", F.lit(1)) > version, "version_newer").when(held != now, "thresholds_stale").when(~there, "horizon_stale")
    if episodes is not None:
        rows = rows.join(episodes.select("article").distinct().withColumn("_some", F.lit(True)), "article", "left")
        reason = reason.when(F.coalesce("status", F.lit("")) != "confirmed", "not_confirmed").when(F.col("_some").isNull(), "no_episodes")
    return rows.select("article", reason.alias("reason"))


def stale_parts(asked: DataFrame, stored: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """Rows of asked (key, fingerprint) whose stored part is missing, failed or of another contract; force: all."""
    if force:
        return asked
    fine = stored.where("error is null").select(*key, "fingerprint")
    return asked.join(fine, [*key, "fingerprint"], "left_anti")


def backfill(asked: DataFrame, stored: DataFrame, key: list[str], compute: Callable[[DataFrame], DataFrame], force: bool = False) -> tuple[DataFrame, Observation]:
    """(parts, counts): stored with its stale parts computed again, and how many were updated, skipped and failed.

    asked: key, fingerprint (see fingerprint()) of the parts that may be backfilled (see refusals()); stored: key, fingerprint,
    error and the part's columns, each key once. compute gets the stale rows of asked and gives key, error (null: none) and the part's columns; a
    part whose computation failed keeps its row with the error, and is stale again the next time. Parts that nothing asks for stay as they are.
    What compute gives is written once, so that it isn't asked again when the parts are read. The counts are there once the parts have been read.
    """
    stale = settled(stale_parts(asked, stored, key, force), "stale-parts")
    columns = [c for c in stored.columns if c not in (*key, "fingerprint")]
    fresh = settled(compute(stale).join(stale.select(*key, "fingerprint"), key).select(*key, "fingerprint", *columns), "backfilled")
    known = stored.join(asked.select(*key).withColumn("_asked", F.lit(True)), key, "left").join(stale.select(*key), key, "left_anti")
    rows = known.select(*key, "fingerprint", *columns, F.when(F.col("_asked"), "skipped").alias("_state"))
    rows = rows.unionByName(fresh.withColumn("_state", F.when(F.col("error").isNull(), "updated").otherwise("failed")))
    counts = Observation("backfill")
    seen = rows.observe(counts, *(F.count_if(F.col("_state") == s).alias(s) for s in ("updated", "skipped", "failed")))
    return seen.drop("_state"), counts

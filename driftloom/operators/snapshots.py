"""Snapshot selection, integrity, stable endpoints, and the trust gates that rest on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params

WINDOW_DAYS = 21
SIZE_TOLERANCE = 0.25
MANY_REVISIONS = 8000


def persistent_rev(revisions: DataFrame, rev_size: DataFrame, targets: DataFrame, window_days: int = WINDOW_DAYS) -> DataFrame:
    """For each (article, pick_date): the nearest revision within the window whose size is near the window's median, else
    the nearest one, else the last one before. Ties go to the earlier time, then the smaller id.

    The band join is bucketed by window: a revision meets the targets of its own bucket and the two beside it.
    """
    width = 2 * window_days + 1
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / width)
    revs = revisions.join(rev_size, ["article", "rev_id"]).select("article", "rev_id", "ts", "size").withColumn("bucket", bucket(F.to_date("ts")))
    wanted = targets.select("article", "pick_date").distinct().withColumn("bucket", F.explode(F.array(*(bucket(F.col("pick_date")) + k for k in (-1, 0, 1)))))
    near = wanted.join(revs, ["article", "bucket"]).withColumn("off", F.abs(F.datediff(F.to_date("ts"), "pick_date"))).where(F.col("off") <= window_days)
    own = Window.partitionBy("article", "pick_date")
    median = F.percentile("size", F.lit(0.5)).over(own)
    near = near.withColumn("median", median)
    ok = (F.col("median") == 0) | (F.abs(F.col("size") - F.col("median")) <= SIZE_TOLERANCE * F.col("median"))
    best = near.groupBy("article", "pick_date").agg(F.min(F.struct((~F.coalesce(ok, F.lit(False))).alias("odd"), "off", "ts", "rev_id")).alias("b"))
    rest = targets.select("article", "pick_date").distinct().join(best, ["article", "pick_date"], "left_anti")
    timeline = revisions.select("article", "rev_id", "ts")
    late = rest.join(timeline, "article").where(F.to_date("ts") <= F.col("pick_date")).groupBy("article", "pick_date").agg(F.max(F.struct("ts", "rev_id")).alias("b"))
    return best.select("article", "pick_date", "b.rev_id", F.lit("window").alias("how")).unionByName(late.select("article", "pick_date", "b.rev_id", F.lit("as_of").alias("how")))


def pick_dates(revisions: DataFrame) -> DataFrame:
    """Half-yearly dates from the first to the last year of an article, yearly for one with very many revisions."""
    span = revisions.groupBy("article").agg(F.year(F.min("ts")).alias("y0"), F.year(F.max("ts")).alias("y1"), F.count(F.lit(1)).alias("n"))
    months = F.when(F.col("n") <= MANY_REVISIONS, F.array(F.lit(1), F.lit(7))).otherwise(F.array(F.lit(1)))
    years = span.select("article", F.explode(F.sequence("y0", "y1")).alias("y"), months.alias("months"))
    return years.select("article", F.explode("months").alias("m"), "y").select("article", F.make_date("y", "m", F.lit(1)).alias("pick_date"))


def snapshot_picks(revisions: DataFrame, rev_size: DataFrame) -> DataFrame:
    """Picks in date order without those equal to the pick before."""
    found = persistent_rev(revisions, rev_size, pick_dates(revisions))
    order = Window.partitionBy("article").orderBy("pick_date")
    return found.withColumn("last", F.lag("rev_id").over(order)).where("not (rev_id <=> last)").select("article", "pick_date", "rev_id")


def snapshot_integrity(rsnap: DataFrame, rev_size: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """A receipt for each snapshot, from its own rows and its neighbours."""
    key = ["article", "snap_date", "snap_rev"]
    sizes = rev_size.groupBy("article", F.col("rev_id").alias("snap_rev")).agg(F.max("size").alias("revision_bytes"))
    own = rsnap.groupBy(*key).agg(F.count(F.lit(1)).alias("token_rows"), F.countDistinct("token_id").alias("unique_tokens"))
    rows = own.join(sizes, ["article", "snap_rev"], "left").withColumn("bytes", F.coalesce("revision_bytes", F.lit(0)))
    order = Window.partitionBy("article").orderBy("snap_date", "snap_rev")
    near = lambda f, c: f(c).over(order)
    ratio = lambda a, b: F.when(b != 0, a / b)
    rows = rows.withColumns({
        "duplicate_rate": 1 - F.col("unique_tokens") / F.col("token_rows"),
        "previous_token_ratio": ratio(F.col("token_rows"), near(F.lag, "token_rows")),
        "next_token_ratio": ratio(F.col("token_rows"), near(F.lead, "token_rows")),
        "previous_byte_ratio": ratio(F.col("bytes"), near(F.lag, "bytes")),
        "next_byte_ratio": ratio(F.col("bytes"), near(F.lead, "bytes")),
    })
    lost = (F.col("previous_token_ratio") < p.neighbor_token_ratio) & (F.col("next_token_ratio") < p.neighbor_token_ratio)
    steady = (F.col("previous_byte_ratio") >= p.neighbor_byte_ratio) & (F.col("next_byte_ratio") >= p.neighbor_byte_ratio)
    status = F.when(F.col("unique_tokens") != F.col("token_rows"), "quarantined").when(lost & steady, "suspect").otherwise("complete")
    return rows.withColumn("status", status).drop("bytes")


def status_audit(receipts: DataFrame, statuses: list[str], key: str = "article") -> DataFrame:
    """Receipts per key and status, and the worst status (the first of statuses is the best)."""
    counts = {f"n_{s}": F.count(F.when(F.col("status") == s, 1)) for s in statuses}
    rank = F.max(F.array_position(F.array(*map(F.lit, statuses)), F.col("status")))
    rows = receipts.groupBy(key).agg(*(v.alias(k) for k, v in counts.items()), rank.alias("rank"))
    return rows.withColumn("worst", F.get(F.array(*map(F.lit, statuses)), F.col("rank").cast("int") - 1)).drop("rank")


def stable_endpoint(snapshots: DataFrame, observed_at: Column, p: Params = DEFAULT) -> DataFrame:
    """The newest snapshot that has stood for survival_hours. snapshots: article, snap_date, snap_rev, ts (text or null)."""
    at = F.try_to_timestamp("ts")
    age = F.unix_seconds(observed_at) - F.unix_seconds(at)
    reason = F.when(F.col("ts").isNull(), "missing_revision_timestamp").when(at.isNull(), "invalid_revision_timestamp").when(age < p.survival_hours * 3600, "minimum_survival_not_met")
    rows = snapshots.select("article", "snap_date", "snap_rev", age.alias("age"), reason.alias("reason"))
    best = F.max(F.when(F.col("reason").isNull(), F.struct("snap_date", "snap_rev", "age"))).alias("best")
    tops = rows.groupBy("article").agg(best)
    newer = F.when(F.col("best").isNull() | (F.struct("snap_date", "snap_rev") > F.struct("best.snap_date", "best.snap_rev")), F.concat_ws(":", "snap_rev", "reason"))
    listed = rows.join(tops, "article").groupBy("article").agg(F.array_join(F.array_sort(F.collect_list(newer)), ",").alias("excluded"))
    return tops.join(listed, "article").select("article", F.when(F.col("best").isNull(), "unstable").otherwise("stable").alias("status"), F.col("best.snap_rev").alias("selected_rev"), F.col("best.snap_date").alias("selected_date"), F.col("best.age").alias("survival_seconds"), "excluded")


def artifact_trust(artifacts: DataFrame, endpoints: DataFrame, integrity: DataFrame) -> DataFrame:
    """The first gate that each artifact fails, or published.

    artifacts: artifact, article, kind (l1-confirmation, lexical or stance), end_rev (the saved horizon, or the later
    revision), from_snapshots (a lexical interval between snapshots), revs (array of the revisions that it names).
    """
    kind = F.col("kind")
    checked = F.when(kind == "l1-confirmation", F.array("end_rev")).when((kind == "stance") | ((kind == "lexical") & F.col("from_snapshots")), F.col("revs"))
    revs = artifacts.select("artifact", "article", F.explode(F.array_compact(checked)).alias("snap_rev"))
    held = integrity.groupBy("article", "snap_rev").agg(F.bool_or(F.col("status") == "quarantined").alias("bad"))
    facts = revs.join(held, ["article", "snap_rev"], "left").groupBy("artifact").agg(F.count_if(F.col("bad").isNull()).alias("unknown"), F.count_if("bad").alias("quarantined"))
    ends = endpoints.select("article", F.col("status").alias("endpoint"), "selected_rev")
    rows = artifacts.join(facts, "artifact", "left").join(ends, "article", "left")
    other = ~F.col("end_rev").eqNullSafe(F.col("selected_rev"))
    state = (
        F.when(F.col("endpoint").isNull(), "legacy_incompatible").when((F.col("endpoint") != "stable") | F.col("selected_rev").isNull(), "unstable")
        .when((kind == "l1-confirmation") & other, "stale").when((kind == "lexical") & F.col("end_rev").isNull(), "legacy_incompatible").when((kind == "lexical") & F.col("from_snapshots") & other, "stale")
        .when((kind == "stance") & (F.size("revs") == 0), "legacy_incompatible").when(F.col("unknown") > 0, "legacy_incompatible").when(F.col("quarantined") > 0, "quarantined").otherwise("published")
    )
    return rows.select("artifact", "article", state.alias("state"))


def trust_report(states: DataFrame, known: list[str]) -> DataFrame:
    """Counts of every known state, zero where there is none."""
    spark = states.sparkSession
    every = spark.createDataFrame([(s,) for s in known], "state string")
    return every.join(states.groupBy("state").agg(F.count(F.lit(1)).alias("n")), "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def fresh(confirmations: DataFrame, contract: dict, horizon: DataFrame, version: int) -> DataFrame:
    """Confirmations with is_fresh: made by this version, or by none without a run time, with these thresholds, for the present horizon.

    confirmations: article, schema_version, run_ts, thresholds (map, in any order; null is empty), horizon_date, horizon_rev;
    horizon: article, snap_date, snap_rev. An article without a present horizon has no fresh confirmation.
    """
    items = lambda m: F.array_sort(F.map_entries(m))
    now = items(F.create_map(*(x for k, v in contract.items() for x in (F.lit(k), F.lit(float(v))))))
    none = F.create_map().cast("map<string,double>")
    held = items(F.coalesce(F.col("thresholds").cast("map<string,double>"), none))
    known = F.coalesce(F.col("schema_version") == version, F.col("run_ts").isNull())
    there = F.struct(F.col("_date").alias("d"), F.col("_rev").alias("r")).eqNullSafe(F.struct(F.col("horizon_date").alias("d"), F.col("horizon_rev").alias("r"))) & F.col("_rev").isNotNull()
    rows = confirmations.join(horizon.select("article", F.col("snap_date").alias("_date"), F.col("snap_rev").alias("_rev")), "article", "left")
    return rows.withColumn("is_fresh", known & (held == now) & there).drop("_date", "_rev")

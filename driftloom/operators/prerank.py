"""Where to look, from metadata alone: size bins with leads, and mutual-revert scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params


def rolling_median(series: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Sizes smoothed by a centred median; a null size is 0."""
    near = Window.partitionBy("article").orderBy("ts", "rev_id").rowsBetween(-p.smooth_k, p.smooth_k)
    return series.withColumn("smooth", F.percentile(F.coalesce("size", F.lit(0)), F.lit(0.5)).over(near))


def revision_bins(series: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Smoothed series with each revision's delta and bin (days since the article's first revision)."""
    order = Window.partitionBy("article").orderBy("ts", "rev_id")
    first = F.min(F.col("ts").cast("timestamp")).over(Window.partitionBy("article"))
    bin_ = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(first)) / (86400 * p.bin_days)).cast("long")
    return rolling_median(series, p).withColumns({"delta": F.coalesce(F.col("smooth") - F.lag("smooth").over(order), F.lit(0.0)), "bin": bin_})


def delta_bins(binned: DataFrame) -> DataFrame:
    down = F.when(F.col("delta") < 0, -F.col("delta")).otherwise(0.0)
    up = F.when(F.col("delta") >= 0, F.col("delta")).otherwise(0.0)
    return binned.groupBy("article", "bin").agg(F.sum(down).alias("removed"), F.sum(up).alias("added"), F.count(F.lit(1)).alias("revs"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def prerank_leads(series: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row per article with min_revs revisions: peaks, their anomaly against the median bin, and leads. Ties: first bin,
    editor in order of name."""
    binned = revision_bins(series, p)
    bins = delta_bins(binned)
    users = binned.groupBy("article", "bin", "user").agg(F.count(F.lit(1)).alias("n")).groupBy("article", "bin").agg(F.max("n").alias("top_user_revs"))
    bins = bins.join(users, ["article", "bin"])
    positive = lambda c: F.coalesce(F.percentile(F.when(F.col(c) > 0, F.col(c)), F.lit(0.5)), F.lit(1.0))
    whole = F.struct("removed", "added", "revs", "start_ts", "end_ts", "top_user_revs")
    peak = lambda c: F.max_by(whole, F.struct(F.col(c), -F.col("bin")))
    rows = bins.groupBy("article").agg(F.sum("revs").alias("total_revs"), positive("removed").alias("rem_base"), positive("added").alias("add_base"), peak("removed").alias("pk"), peak("added").alias("pa")).where(F.col("total_revs") >= p.min_revs)
    rem, add = F.col("pk.removed") / F.col("rem_base"), F.col("pa.added") / F.col("add_base")
    removal = (F.col("pk.removed") >= p.lead_floor) & (rem >= p.anomaly_min)
    addition = (F.col("pa.added") >= p.lead_floor) & (add >= p.anomaly_min) & (F.col("pa.added") > p.growth_ratio * F.col("pa.removed"))
    churn = ~removal & (F.col("pk.removed") >= p.churn_min_bytes) & (rem >= p.churn_anomaly)
    leads = F.concat_ws(",", F.when(removal, "removal→PWR"), F.when(addition, "addition→L2"), F.when(churn, "churn→L2"))
    return rows.select(
        "article", F.col("pk.removed").alias("removed"), rem.alias("rem_anom"), F.to_date("pk.start_ts").alias("rem_start"), F.to_date("pk.end_ts").alias("rem_end"),
        F.col("pa.added").alias("added"), add.alias("add_anom"), F.to_date("pa.start_ts").alias("add_start"), F.to_date("pa.end_ts").alias("add_end"),
        (F.col("pk.top_user_revs") / F.col("pk.revs")).alias("editor_conc"), (F.col("pa.top_user_revs") / F.col("pa.revs")).alias("add_editor_conc"), leads.alias("leads"), "total_revs",
    )


#: Addresses in place of names: four decimal groups, or hexadecimal groups between colons.
ADDRESS = r"^(\d{1,3}(\.\d{1,3}){3}|[0-9A-Fa-f:]+:[0-9A-Fa-f:]+)\z"


def mscore(history: DataFrame, registered_only: bool = True, min_each: int = 2) -> DataFrame:
    """Mutual-revert score. history: article, k0 (order), user, sha1.

    A revision whose hash came before reverts the users strictly between; positions count after bots (and addresses) go.
    """
    rows = history.where("user is not null and sha1 is not null").where(~F.lower("user").endswith("bot"))
    if registered_only:
        rows = rows.where(~F.col("user").rlike(ADDRESS))
    order = Window.partitionBy("article").orderBy("k0")
    rows = rows.withColumn("k", F.row_number().over(order) - 1).withColumn("first", F.min("k").over(Window.partitionBy("article", "sha1")))
    back = rows.where("first < k - 1").select("article", "k", "first", F.col("user").alias("a"))
    # a user's next edit after a state decides which of the reverts to that state took it back
    states = back.groupBy("article", "first").agg(F.max("k").alias("until"))
    edit = rows.select("article", F.col("k").alias("m"), F.col("user").alias("b"))
    after = states.join(edit, "article").where("m > first and m < until").groupBy("article", "first", "b").agg(F.min("m").alias("m"))
    pairs = back.join(after, ["article", "first"]).where("m < k and a <> b").groupBy("article", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    other = pairs.select("article", F.col("a").alias("b"), F.col("b").alias("a"), F.col("n").alias("m"))
    mutual = pairs.join(other, ["article", "a", "b"]).where((F.col("a") < F.col("b")) & (F.col("n") >= min_each) & (F.col("m") >= min_each))
    edits = rows.groupBy("article", "user").agg(F.count(F.lit(1)).alias("edits"))
    mutual = mutual.join(edits.select("article", F.col("user").alias("a"), F.col("edits").alias("ea")), ["article", "a"]).join(edits.select("article", F.col("user").alias("b"), F.col("edits").alias("eb")), ["article", "b"])
    warriors = mutual.select("article", F.explode(F.array("a", "b")).alias("u")).groupBy("article").agg(F.countDistinct("u").alias("warriors"))
    sums = mutual.groupBy("article").agg(F.count(F.lit(1)).alias("mutual_pairs"), F.sum(F.least("ea", "eb")).alias("weight")).join(warriors, "article")
    total = rows.groupBy("article").agg(F.count(F.lit(1)).alias("revs"))
    m = F.coalesce(F.col("warriors") * F.col("weight"), F.lit(0)).alias("m")
    return total.join(sums, "article", "left").select("article", "revs", F.coalesce("mutual_pairs", F.lit(0)).alias("mutual_pairs"), m).withColumn("m_per_rev", F.bround(F.col("m") / F.col("revs"), 2))


def mscore_raw_vs_refined(history: DataFrame) -> DataFrame:
    """Both scores; contested when the refined one reaches 5 per raw row."""
    raw = mscore(history, False, 1).select("article", F.col("revs").alias("raw_revs"), F.col("m").alias("raw_m"))
    rows = history.groupBy("article").agg(F.count(F.lit(1)).alias("rows"))
    fine = mscore(history).select("article", F.col("m").alias("refined_m"))
    out = rows.join(raw, "article", "left").join(fine, "article", "left").na.fill(0, ["raw_revs", "raw_m", "refined_m"])
    return out.withColumn("refined_per_row", F.bround(F.col("refined_m") / F.col("rows"), 2)).withColumn("contested", F.col("refined_m") / F.col("rows") >= 5)


def recall_floor(leads: DataFrame) -> DataFrame:
    """Healthy articles that removed as much as the known pivot that removed least, with that floor; none without a pivot.
    leads: article, removed, kind (pivot, healthy or other)."""
    floor = leads.where("kind = 'pivot'").agg(F.min("removed"))
    return leads.where("kind = 'healthy'").withColumn("floor", floor.scalar()).where("removed >= floor").select("article", "removed", "floor")

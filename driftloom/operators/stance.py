"""Repeated stance runs: agreement, audited transitions, trajectories.

runs: article, revision_id, entity, run (its number), stance, confidence, has_evidence, contract (prompt version, provider
and model as one text, or null). passages: article, revision_id, passage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .claims import similarity

AGREEMENT_FLOOR, SIMILARITY_FLOOR, EVIDENCE_FLOOR = 0.8, 0.98, 1.0
KEY = ["article", "revision_id", "entity"]
#: The stances as numbers; others count as zero.
VALUES = {"critical": -1, "neutral": 0, "sympathetic": 1}


def summarize_runs(runs: DataFrame) -> DataFrame:
    """The most frequent label (of equal ones the first seen) of each revision and entity, and how far the runs agree."""
    counts = runs.withColumn("stance", F.coalesce("stance", F.lit("absent"))).groupBy(*KEY, "stance").agg(
        F.count(F.lit(1)).alias("n"), F.min("run").alias("first"), F.count_if(F.coalesce("has_evidence", F.lit(False))).alias("evident"),
        F.sum("confidence").alias("sure"), F.count("confidence").alias("told"), F.collect_set("contract").alias("own"),
    )
    share = lambda c: F.bround(c / F.sum("n"), 4)
    return counts.groupBy(*KEY).agg(
        F.max_by("stance", F.struct("n", -F.col("first"))).alias("label"), share(F.max("n")).alias("agreement"), F.sum("n").alias("runs"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("stance", "n")))).alias("label_counts"), share(F.sum("evident")).alias("evidence_coverage"),
        F.when(F.sum("told") > 0, F.bround(F.sum("sure") / F.sum("told"), 4)).alias("mean_confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("contracts"),
    )


def audit_transitions(summaries: DataFrame, passages: DataFrame, agreement: float = AGREEMENT_FLOOR, similar: float = SIMILARITY_FLOOR, evidence: float = EVIDENCE_FLOOR) -> DataFrame:
    """Each step between an article's consecutive revisions, for each entity of either: did the text or the model change?"""
    order = Window.partitionBy("article").orderBy("revision_id")
    steps = passages.select("article", F.lag("revision_id").over(order).alias("before_id"), "revision_id", F.lag("passage").over(order).alias("_old"), F.col("passage").alias("_new"))
    steps = steps.where("before_id is not null").withColumn("text_similarity", similarity(F.coalesce("_old", F.lit("")), F.coalesce("_new", F.lit(""))))
    s = summaries.select(*KEY, F.struct("label", "agreement", "evidence_coverage", "contracts").alias("s"))
    asked = steps.join(s.select("article", "entity").distinct(), "article")
    rows = asked.join(s.select("article", F.col("revision_id").alias("before_id"), "entity", F.col("s").alias("b")), ["article", "before_id", "entity"], "left").join(s.withColumnRenamed("s", "a"), KEY, "left")
    both = F.col("b").isNotNull() & F.col("a").isNotNull()
    sizes = F.size("b.contracts"), F.size("a.contracts")
    clash = (sizes[0] > 1) | (sizes[1] > 1) | ((sizes[0] > 0) & (sizes[1] > 0) & (F.col("b.contracts") != F.col("a.contracts")))
    text, label = F.col("text_similarity") < similar, F.col("b.label") != F.col("a.label")
    unstable = F.least("b.agreement", "a.agreement") < agreement
    whole = F.least("b.evidence_coverage", "a.evidence_coverage") >= evidence
    state = (
        F.when(~both | clash | ~whole, "insufficient_evidence").when(text & unstable, "both_changed").when(unstable | (label & ~text), "model_unstable").when(text, "text_changed").otherwise("no_change")
    )
    audited = F.coalesce(both & ~clash & text & label & ~unstable & whole, F.lit(False))
    return rows.select("article", "before_id", "revision_id", "entity", F.bround("text_similarity", 4).alias("text_similarity"), F.col("b.label").alias("before_label"), F.col("a.label").alias("after_label"), state.alias("state"), audited.alias("audited_shift"))


def near_changes(first: DataFrame) -> DataFrame:
    """(article, revision_id) on either side of a step where the first run's label of an entity changes."""
    order = Window.partitionBy("article", "entity").orderBy("place")
    places = first.select("article", "revision_id").distinct().withColumn("place", F.row_number().over(Window.partitionBy("article").orderBy("revision_id")))
    rows = first.join(places, ["article", "revision_id"]).withColumns({"_id": F.lag("revision_id").over(order), "_label": F.lag("stance").over(order), "_place": F.lag("place").over(order)})
    changed = rows.where((F.col("_label") != F.col("stance")) & (F.col("_place") == F.col("place") - 1))
    return changed.select("article", F.explode(F.array("_id", "revision_id")).alias("revision_id")).distinct()


def stance_trajectory(passages: DataFrame, classify: Callable[[DataFrame], DataFrame], runs: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, summaries and transitions. Every passage that isn't empty is classified once, those beside a change of label `runs` times.

    classify takes passages and gives runs without run. It is asked again for the result of the first pass: give it a
    deterministic function, or one that writes its answers to a table.
    """
    if runs < 1:
        raise ValueError("runs must be at least 1")
    asked = passages.where(F.coalesce(F.col("passage"), F.lit("")) != "")
    every = first = classify(asked).withColumn("run", F.lit(1))
    if runs > 1:
        again = asked.join(near_changes(first), ["article", "revision_id"], "left_semi")
        for k in range(2, runs + 1):
            every = every.unionByName(classify(again).withColumn("run", F.lit(k)))
    summaries = summarize_runs(every)
    return every, summaries, audit_transitions(summaries, passages)


def stance_shifts(summaries: DataFrame, transitions: DataFrame) -> DataFrame:
    """First and last stance of each article and entity as numbers, and how many of its steps are audited shifts."""
    value = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in VALUES.items() for x in pair)), F.col("label")), F.lit(0))
    ends = summaries.groupBy("article", "entity").agg(F.min_by(value, "revision_id").alias("start"), F.max_by(value, "revision_id").alias("end"), F.count(F.lit(1)).alias("n"))
    steps = transitions.groupBy("article", "entity").agg(F.count_if("audited_shift").alias("audited"))
    rows = ends.join(steps, ["article", "entity"], "left").na.fill(0, ["audited"])
    return rows.withColumn("shifted", F.col("audited") > 0)


def sampled_snapshots(snaps: DataFrame, most: int, since: str | None = None) -> DataFrame:
    """At most `most` snapshots of each article (0: all) from `since` on: number floor(i * n / most) for each i."""
    rows = snaps if since is None else snaps.where(F.col("snap_date") >= F.lit(since).cast("date"))
    if not most:
        return rows
    own = Window.partitionBy("article")
    rows = rows.withColumns({"_k": F.row_number().over(own.orderBy("snap_date", "snap_rev")) - 1, "_n": F.count(F.lit(1)).over(own)})
    slot = F.ceil(F.col("_k") * most / F.col("_n"))
    taken = (F.col("_n") <= most) | ((slot < most) & (F.floor(slot * F.col("_n") / most) == F.col("_k")))
    return rows.where(taken).drop("_k", "_n")

"""Leads from confirmed events: editor graph, concentration of removals, removal footprints and re-tests.

Tables: confirmations (article, status, is_fresh); episodes (article, before_revid, after_revid, candidate_start,
candidate_end, durable_spine_drop, pwr_mass, duration_seconds, removed_tokens, replacement_tokens, unavailable: why there
is no attribution); event_editors (article, before_revid, kind: removal or replacement, editor, tokens). An episode without
removed_tokens has no attribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_title
from ..lineage import settled
from ..params import DEFAULT, Params
from .corpus import account_type

EVENT = ["article", "before_revid"]
FEATURES = ("durable_spine_drop", "pwr_mass", "duration_seconds", "top_removal_share", "top_replacement_share", "top_two_removal_share")
SHARES = ("top_removal_share", "top_replacement_share", "top_two_removal_share")

#: Rows of seeds and titles that one part makes.
PART_ROWS = 200_000


def eligible_editor(editor: Column) -> Column:
    """A literal public account: neither hidden nor a bot nor an address."""
    named = editor.isNotNull() & ~editor.isin("", "?", "<hidden>")
    return named & account_type(editor).isin("registered", "hidden")


def _sums(event_editors: DataFrame) -> DataFrame:
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("tokens"))), F.lit(0))
    return event_editors.groupBy(*EVENT).agg(of("removal").alias("_removed"), of("replacement").alias("_replaced"))


def article_exclusions(confirmations: DataFrame) -> DataFrame:
    """Articles that give no events, with the reason."""
    reason = F.when(~F.col("status").eqNullSafe("confirmed"), "not_confirmed").when(~F.coalesce("is_fresh", F.lit(False)), "stale_confirmation")
    return confirmations.select("article", reason.alias("reason")).where("reason is not null")


def judged_events(confirmations: DataFrame, episodes: DataFrame, event_editors: DataFrame, replacements: bool = False) -> DataFrame:
    """Episodes of fresh confirmations with reason: null, or why the event can't be used. replacements: check these sums too."""
    usable = confirmations.where("status = 'confirmed' and is_fresh").select("article")
    rows = episodes.join(usable, "article", "left_semi").join(_sums(event_editors), EVENT, "left").na.fill(0, ["_removed", "_replaced"])
    reason = F.when(F.col("removed_tokens").isNull(), F.coalesce("unavailable", F.lit("attribution_missing"))).when(F.col("removed_tokens") != F.col("_removed"), "removal_attribution_mismatch")
    if replacements:
        reason = reason.when(~F.col("replacement_tokens").eqNullSafe(F.col("_replaced")), "replacement_attribution_mismatch")
    return rows.withColumn("reason", reason).drop("_removed", "_replaced")


def event_exclusions(confirmations: DataFrame, judged: DataFrame) -> DataFrame:
    """Articles and events that were left out."""
    return article_exclusions(confirmations).unionByName(judged.where("reason is not null").select("article", "before_revid", "after_revid", "reason"), allowMissingColumns=True)


def _removals(judged: DataFrame, event_editors: DataFrame) -> DataFrame:
    rows = event_editors.where("kind = 'removal'").where(eligible_editor(F.col("editor")))
    return judged.where("reason is null").join(rows.select(*EVENT, "editor", "tokens"), EVENT)


def event_graph(judged: DataFrame, event_editors: DataFrame) -> DataFrame:
    """One row an editor over all usable events. Ranking is the reader's orderBy: articles, events, tokens, editor."""
    event = F.format_string("%s:%d→%d", "article", "before_revid", "after_revid")
    return _removals(judged, event_editors).groupBy("editor").agg(
        F.countDistinct("article").alias("article_count"), F.count(F.lit(1)).alias("event_count"), F.sum("tokens").alias("removed_tokens"),
        F.array_sort(F.collect_set("article")).alias("articles"), F.array_sort(F.collect_list(event)).alias("events"),
    )


def seed_editors(judged: DataFrame, event_editors: DataFrame, most: int = 4) -> DataFrame:
    """The editors that removed most in each article's event of highest mass (the first of equal ones); none if that
    event can't be used."""
    top = Window.partitionBy("article").orderBy(F.desc("pwr_mass"), "before_revid")
    first = judged.withColumn("_n", F.row_number().over(top)).where("_n = 1").drop("_n")
    place = Window.partitionBy("article").orderBy(F.desc("tokens"), "editor")
    rows = _removals(first, event_editors).withColumn("rank", F.row_number().over(place))
    return rows.where(F.col("rank") <= most).select("article", "rank", "editor", "tokens")


def removal_footprint(contribs: DataFrame, seeds: DataFrame, tested: DataFrame, least: int = 1500) -> DataFrame:
    """Titles where seed editors removed at least `least` bytes in all (each editor's edits together, not one by one).

    contribs: editor, title, sizediff; seeds: article, editor; tested: title. Titles already tested and the seed's own
    article are left out. Result: article (the seed's), title, editors, removed, edits.
    """
    cuts = contribs.where("sizediff < 0").withColumn("title", plain_title(F.col("title"))).where("title <> ''")
    own = cuts.groupBy("editor", "title").agg((-F.sum("sizediff")).alias("removed"), F.count(F.lit(1)).alias("edits")).where(F.col("removed") >= least)
    known = tested.select(plain_title(F.col("title")).alias("title")).distinct()
    own = settled(own.join(known, "title", "left_anti"), "cuts")
    seeds = settled(seeds.select("article", "editor").distinct(), "seeds")
    # few seeds make many rows, so their parts go by what they will make, and each article stays in one
    n = seeds.groupBy("editor").count().join(own.groupBy("editor").agg(F.count(F.lit(1)).alias("titles")), "editor").agg(F.sum(F.col("count") * F.col("titles"))).first()[0] or 0
    parts = 1 + n // PART_ROWS
    fresh = seeds.repartition(parts, "article").join(own, "editor").where(F.col("title") != plain_title(F.col("article")))
    fresh = fresh.repartition(parts, "article")  # moves nothing where seeds stayed in their parts
    # a seed's editor has one row for each title
    return fresh.groupBy("article", "title").agg(F.count(F.lit(1)).alias("editors"), F.sum("removed").alias("removed"), F.sum("edits").alias("edits"))


def rank_candidates(footprint: DataFrame, most: int = 12) -> DataFrame:
    """The titles of each seed article to test next: most editors, then most bytes, then title."""
    place = Window.partitionBy("article").orderBy(F.desc("editors"), F.desc("removed"), "title")
    return footprint.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most)


def retest_class(results: DataFrame, episodes: DataFrame, revisions: DataFrame, p: Params = DEFAULT, mature_years: float = 2.0) -> DataFrame:
    """Class of an exact result (article, status) from its top episode's mass and the article's age when that began."""
    top = episodes.groupBy("article").agg(F.max("pwr_mass").alias("top_mass"), F.max_by("candidate_start", F.struct("pwr_mass", -F.col("before_revid"))).alias("began"))
    born = revisions.groupBy("article").agg(F.min("ts").cast("date").alias("born"))
    rows = results.join(top, "article", "left").join(born, "article", "left")
    age = F.when(F.col("status") == "confirmed", F.bround(F.datediff("began", "born") / 365.25, 1))
    rows = rows.withColumns({"top_mass": F.coalesce("top_mass", F.lit(0)), "age_at_pivot": age})
    label = (
        F.when(~F.col("status").eqNullSafe("confirmed"), F.coalesce("status", F.lit("unavailable"))).when(F.col("top_mass") < p.mass_floor, "confirmed-low-mass")
        .when(F.col("age_at_pivot").isNull(), "confirmed-age-unknown").when(F.col("age_at_pivot") < mature_years, "confirmed-born-in-contested").otherwise("confirmed-retrofit-lead")
    )
    return rows.select("article", "top_mass", "age_at_pivot", label.alias("lead_class"))


def concentration(judged: DataFrame, event_editors: DataFrame) -> DataFrame:
    """Editor shares of each usable event (judged with replacements)."""
    place = Window.partitionBy(*EVENT, "kind").orderBy(F.desc("tokens"), "editor")
    rows = event_editors.withColumn("_n", F.row_number().over(place)).where("_n <= 2")
    top = lambda kind: F.max(F.when((F.col("kind") == kind) & (F.col("_n") == 1), F.struct("tokens", "editor")))
    tops = rows.groupBy(*EVENT).agg(top("removal").alias("_r"), top("replacement").alias("_p"), F.sum(F.when(F.col("kind") == "removal", F.col("tokens"))).alias("_two"))
    share = lambda part, whole: F.when(F.col(whole) != 0, F.bround(part / F.col(whole), 6))
    return judged.where("reason is null").join(tops, EVENT, "left").select(
        *EVENT, "after_revid", "durable_spine_drop", "pwr_mass", "duration_seconds", "removed_tokens", "replacement_tokens",
        F.col("_r.editor").alias("top_removal_editor"), F.col("_p.editor").alias("top_replacement_editor"),
        share(F.col("_r.tokens"), "removed_tokens").alias("top_removal_share"), share(F.col("_p.tokens"), "replacement_tokens").alias("top_replacement_share"),
        F.coalesce(F.col("_r.editor") == F.col("_p.editor"), F.lit(False)).alias("same_top_editor"), share(F.col("_two"), "removed_tokens").alias("top_two_removal_share"),
    )


def concentration_summary(events: DataFrame) -> DataFrame:
    """Count, least, median and greatest value of each feature; blocker tells why a share can't be calibrated."""
    long = events.select(*(F.col(c).cast("double").alias(c) for c in FEATURES)).unpivot([], list(FEATURES), "feature", "value")
    rows = long.groupBy("feature").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.expr("percentile(value, 0.5)").alias("middle"), F.max("value").alias("most"))
    blocker = F.when(F.col("feature").isin(*SHARES), F.when(F.col("n") < 2, "fewer than two observations").when(F.col("least") == F.col("most"), "no observed variance"))
    return rows.withColumn("blocker", blocker)

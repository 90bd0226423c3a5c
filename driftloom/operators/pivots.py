"""Which revisions a comparison rests on: trajectories, pivots, fallbacks and what can be exported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("formative", "interval")
#: Wiki families that aren't language editions.
SISTERS = ("commons", "meta", "species", "wikidata", "sources", "quote", "voyage", "news", "books", "versity")


def trajectory_selection(snapshots: DataFrame, endpoints: DataFrame, mode: str = "formative", start: str | None = None, end: str | None = None) -> DataFrame:
    """article, reason, snap_date, snap_rev: the usable snapshots up to the stable endpoint (interval: within the dates).

    An article that can't be compared has one row with its reason and no snapshot. snapshots: article, snap_date, snap_rev,
    quarantined ones left out; endpoints: article, snap_date, snap_rev (null: no stable one), a row for each article.
    """
    if mode not in MODES:
        raise ValueError(f"unsupported mode: {mode}")
    if mode == "interval" and not (start and end):
        raise ValueError("a trajectory of an interval needs its start and end")
    ends = endpoints.select("article", F.col("snap_rev").alias("end_rev"), F.col("snap_date").alias("end_date"))
    rows = ends.join(snapshots.select("article", "snap_date", "snap_rev").distinct(), "article", "left")
    upto = F.struct("snap_date", "snap_rev") <= F.struct("end_date", "end_rev")
    within = upto & F.col("snap_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) if mode == "interval" else upto
    item = F.when(within, F.struct("snap_date", "snap_rev"))
    facts = rows.groupBy("article").agg(F.max("end_rev").alias("end_rev"), F.bool_or(F.col("snap_rev") == F.col("end_rev")).alias("usable"), F.array_sort(F.collect_list(item)).alias("found"))
    reason = (
        F.when(F.col("end_rev").isNull(), "endpoint_unstable").when(~F.coalesce("usable", F.lit(False)), "endpoint_unusable")
        .when(F.size("found") < 2, "too_few_revisions")
    )
    shown = facts.select("article", reason.alias("reason"), "found").withColumn("found", F.when(F.col("reason").isNull(), F.col("found")))
    return shown.select("article", "reason", F.explode_outer("found").alias("s")).select("article", "reason", "s.snap_date", "s.snap_rev")


def exact_selection(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """article, reason, place, rev_id: the revisions that the caller names for each article, in the order of place (article, place, rev_id).

    An article has one row with its reason, and no revision, if it names fewer than two, names one twice, or one that has no
    text (the first such is told). texts: article, rev_id, text.
    """
    known = texts.where("text is not null").select("article", "rev_id").distinct().withColumn("_known", F.lit(True))
    rows = requests.select("article", "place", "rev_id").join(known, ["article", "rev_id"], "left")
    missing = F.min(F.when(F.col("_known").isNull(), F.struct("place", "rev_id"))).alias("missing")
    facts = rows.groupBy("article").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rev_id").alias("ids"), missing, F.array_sort(F.collect_list(F.struct("place", "rev_id"))).alias("found"))
    reason = F.when(F.col("n") < 2, "too_few_revisions").when(F.col("ids") < F.col("n"), "repeated_revision").when(F.col("missing").isNotNull(), F.concat(F.lit("revision_unavailable:"), F.col("missing.rev_id").cast("string")))
    shown = facts.select("article", reason.alias("reason"), F.when(reason.isNull(), F.col("found")).alias("found"))
    return shown.select("article", "reason", F.explode_outer("found").alias("s")).select("article", "reason", "s.place", "s.rev_id")


def selected_pairs(selection: DataFrame, order: str = "place", rev: str = "rev_id") -> DataFrame:
    """article, before_rev, after_rev of the revisions that follow each other in a selection; articles with a reason have none."""
    rows = selection.where(F.col("reason").isNull()).select("article", order, F.col(rev).alias("before_rev"))
    following = F.lead("before_rev").over(Window.partitionBy("article").orderBy(order))
    return rows.withColumn("after_rev", following).where("after_rev is not null").select("article", "before_rev", "after_rev")


def edition_map(sitelinks: DataFrame, langs: list[str] | None = None) -> DataFrame:
    """item, lang, title of language editions. sitelinks: item, site, title."""
    rows = sitelinks.where(F.col("site").endswith("wiki") & ~F.col("site").rlike(f"^({'|'.join(SISTERS)})"))
    rows = rows.select("item", F.expr("substring(site, 1, length(site) - 4)").alias("lang"), "title")
    return rows.where(F.col("lang").isin(langs)) if langs else rows


def recent_episode(episodes: DataFrame) -> DataFrame:
    """article, start of the episode of least age; ties go to the better rank. episodes: article, start, age_years, rank."""
    return episodes.groupBy("article").agg(F.min_by("start", F.struct("age_years", "rank")).alias("start"))


def _fallback(rows: DataFrame, fallback: str | DataFrame) -> DataFrame:
    """rows with _fallback: a date for all, or those of a table (article, date), null where it has none."""
    if isinstance(fallback, str):
        return rows.withColumn("_fallback", F.lit(fallback).cast("date"))
    return rows.join(fallback.select("article", F.col("date").alias("_fallback")), "article", "left")


def pivot_choice(articles: DataFrame, confirmations: DataFrame, episodes: DataFrame, fallback: str | DataFrame) -> DataFrame:
    """article, pivot, source: a fresh confirmation's first episode, else the most recent candidate, else the fallback date (one for all, or a table article, date).

    A fresh confirmation that found nothing leaves no pivot. confirmations: article, status, is_fresh, start.
    """
    held = confirmations.where("is_fresh").select("article", "status", F.col("start").alias("confirmed"))
    rows = _fallback(articles.select("article").distinct().join(held, "article", "left").join(recent_episode(episodes), "article", "left"), fallback)
    of = lambda yes, no, found, none: F.when(F.col("status") == "confirmed", yes).when(F.col("status").isNotNull(), no).when(F.col("start").isNotNull(), found).otherwise(none)
    source = of(F.lit("confirmed"), F.lit("rejected"), F.lit("candidate"), F.lit("fallback"))
    return rows.select("article", of(F.col("confirmed"), F.lit(None), F.col("start"), F.col("_fallback")).alias("pivot"), source.alias("source"))


def before_date(articles: DataFrame, episodes: DataFrame, fallback: str | DataFrame, months: int = 24) -> DataFrame:
    """article, before, source: two years before the most recent episode, else the fallback date."""
    rows = _fallback(articles.select("article").distinct().join(recent_episode(episodes), "article", "left"), fallback)
    source = F.when(F.col("start").isNull(), "fallback").otherwise("pivot")
    return rows.select("article", F.coalesce(F.add_months("start", -months), "_fallback").alias("before"), source.alias("source"))


PIVOT = ["article", "place", "start", "end", "peak_pct", "pwr_mass", "before_rev", "after_rev", "status", "metric", "decision", "rejection_reason", "durable_spine_drop", "duration_seconds"]


def exact_pairs(episodes: DataFrame) -> DataFrame:
    """PIVOT of confirmed episodes: article, place (their order), before_revid, after_revid, before_ts, after_ts, durable_spine_drop, pwr_mass, duration_seconds."""
    drop = F.bround(100 * F.coalesce("durable_spine_drop", F.lit(0.0)), 2)
    return episodes.select(
        "article", "place", F.to_date("before_ts").alias("start"), F.to_date("after_ts").alias("end"), drop.alias("peak_pct"), "pwr_mass", F.col("before_revid").alias("before_rev"), F.col("after_revid").alias("after_rev"),
        F.lit("confirmed").alias("status"), F.lit("exact_durable_spine_drop").alias("metric"), F.lit(None).cast("string").alias("decision"), F.lit(None).cast("string").alias("rejection_reason"), "durable_spine_drop", "duration_seconds",
    )


def candidate_pairs(candidates: DataFrame) -> DataFrame:
    """PIVOT of evaluated candidates: article, place, candidate_start, candidate_end, candidate_before_revid, candidate_after_revid, peak_pct, pwr_mass, decision (null: rejected), rejection_reason, durable_spine_drop."""
    decision = F.coalesce("decision", F.lit("rejected"))
    return candidates.select(
        "article", "place", F.col("candidate_start").alias("start"), F.col("candidate_end").alias("end"), "peak_pct", "pwr_mass", F.col("candidate_before_revid").alias("before_rev"), F.col("candidate_after_revid").alias("after_rev"),
        F.when(decision == "confirmed", "confirmed").otherwise("rejected").alias("status"), F.lit("persistence_weighted_loss").alias("metric"), decision.alias("decision"), "rejection_reason", "durable_spine_drop", F.lit(None).cast("long").alias("duration_seconds"),
    )


def pivot_pairs(confirmations: DataFrame, exact: DataFrame, candidates: DataFrame) -> DataFrame:
    """PIVOT rows to be shown: an article's evaluated candidates if it has any, else the exact pairs of a confirmed one.

    confirmations: article, status.
    """
    judged = candidates.select("article").distinct()
    rest = exact.join(confirmations.where("status = 'confirmed'").select("article"), "article", "left_semi").join(judged, "article", "left_anti")
    return candidates.select(*PIVOT).unionByName(rest.select(*PIVOT))


def materialized_pivots(pairs: DataFrame, texts: DataFrame, authors: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """pairs (article, before_rev, after_rev and others) with both texts; available tells whether neither is missing or empty.

    texts: article, rev_id (unique in an article), text. authors (article, rev_id, word, author): adds authors_before and
    authors_after, maps from word to author that are empty where nothing is known.

    Revisions and the ends of pairs are dealt out by article once, and revisions not at all if they are already, into as many
    parts (None: Spark's own number). There each end follows its revision, and both ends of a pair meet.
    """
    kinds = {"text": "string"} | ({} if authors is None else {"authors": "map<string,string>"})
    of = lambda rows, **own: rows.select("article", F.col("rev_id").cast("long").alias("rev_id"), *(own.get(c, F.lit(None).cast(t)).alias(c) for c, t in kinds.items()), F.lit(None).cast(ends.schema["pair"].dataType).alias("pair"), F.lit(None).cast("int").alias("side"))
    sides = F.array(*(F.struct(F.col(f"{side}_rev").cast("long").alias("rev_id"), F.lit(k).alias("side")) for k, side in enumerate(("before", "after"))))
    ends = pairs.select("article", F.struct(*(c for c in pairs.columns if c != "article")).alias("pair"), F.explode(sides).alias("e"))
    ends = ends.select("article", "e.rev_id", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()), "pair", "e.side")
    ends = ends.repartition(parts, "article") if parts else ends.repartition("article")
    rows = of(texts, text=F.col("text"))
    if authors is not None:
        words = authors.groupBy("article", "rev_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "author")))).alias("authors"))
        rows = rows.unionByName(of(words, authors=F.col("authors")))
    facts = Window.partitionBy("article", "rev_id").orderBy(F.col("side").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.unionByName(ends).withColumns({c: F.last(c, ignorenulls=True).over(facts) for c in kinds}).where("side is not null")
    found = {f"{c}_{k}": F.first(F.when(F.col("side") == k, F.col(c)), ignorenulls=True) for c in kinds for k in (0, 1)}
    # equal pairs count as often as they are there
    both = met.groupBy("article", "pair").agg(F.count_if(F.col("side") == 0).alias("n"), *(x.alias(c) for c, x in found.items()))
    both = both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    rows = both.select(*(F.col(c if c == "article" else f"pair.{c}") for c in pairs.columns), F.col("text_0").alias("before_text"), F.col("text_1").alias("after_text"), *([] if authors is None else ["authors_0", "authors_1"]))
    rows = rows.withColumn("available", (F.coalesce("before_text", F.lit("")) != "") & (F.coalesce("after_text", F.lit("")) != ""))
    if authors is None:
        return rows
    own = {f"authors_{side}": F.coalesce(f"authors_{k}", F.create_map().cast("map<string,string>")) for k, side in enumerate(("before", "after"))}
    return rows.withColumns(own).drop("authors_0", "authors_1")


def unavailable_pairs(pivots: DataFrame) -> DataFrame:
    """article, pairs (before→after, in order) of those whose texts aren't there. pivots: of materialized_pivots, with place."""
    item = F.when(~F.col("available"), F.struct("place", F.concat_ws("→", "before_rev", "after_rev").alias("pair")))
    found = pivots.groupBy("article").agg(F.array_sort(F.collect_list(item)).alias("found"))
    return found.select("article", F.transform("found", lambda x: x["pair"]).alias("pairs"))


def export_state(confirmations: DataFrame, pivots: DataFrame) -> DataFrame:
    """article, state, reason of each article's pivots. confirmations: article, status, reason, is_fresh, trust (published or
    why not; null: no confirmation that can be read); pivots: of materialized_pivots."""
    pair: Column = F.when(~F.col("available"), F.concat_ws("→", "before_rev", "after_rev"))
    facts = pivots.groupBy("article").agg(F.count(F.lit(1)).alias("n"), F.count_if("available").alias("ready"), F.array_join(F.array_sort(F.collect_list(pair)), ", ").alias("missing"))
    rows = confirmations.join(facts, "article", "left").na.fill({"n": 0, "ready": 0})
    nothing = (F.col("n") == 0) & (F.col("status") != "confirmed")
    gates = [
        (F.col("trust").isNull(), "unavailable", F.lit("receipt_missing")),
        (F.col("trust") != "published", "unavailable", F.concat(F.lit("withheld: "), "trust")),
        (~F.coalesce("is_fresh", F.lit(False)), "unavailable", F.lit("confirmation_stale")),
        (nothing, "none", F.coalesce("reason", "status")),
        (F.col("ready") == 0, "unavailable", F.concat(F.lit("pairs_unavailable: "), F.coalesce(F.nullif("missing", F.lit("")), F.lit("none")))),
        (F.lit(True), "finding", F.lit("redlines_available")),
    ]
    first = F.coalesce(*(F.when(test, F.struct(F.lit(state).alias("state"), reason.alias("reason"))) for test, state, reason in gates))
    return rows.select("article", first.alias("x")).select("article", "x.state", "x.reason")

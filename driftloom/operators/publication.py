"""Queries over results that are ready to be shown. findings is one row an article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Terms that come from markup or say nothing.
LEX_NOISE = (
    "thumb", "alt", "left", "right", "px", "upright", "frameless", "frame", "border", "cite", "ref", "refs", "nbsp", "mdash", "ndash", "amp", "quot", "lt", "gt",
    "category", "file", "image", "jpg", "jpeg", "png", "svg", "webp", "http", "https", "www", "com", "org", "html", "php", "also", "however", "while", "which", "their",
    "there", "these", "those", "would", "could", "should", "about", "after", "before", "between", "through", "during", "under", "over", "into", "from", "with", "without",
    "that", "this", "than", "then", "when", "where", "what", "were", "been", "have", "has", "had", "are", "was", "will", "can", "may", "might", "must", "shall",
)
PER_PAGE = 25


def published_articles(named: list[DataFrame], confirmations: DataFrame, excluded: DataFrame) -> DataFrame:
    """Articles with a result to show: those of any finding or of a decided confirmation, less the excluded ones."""
    rows = confirmations.where(F.col("status").isin("confirmed", "not_confirmed")).select("article")
    for other in named:
        rows = rows.unionByName(other.select("article"))
    return rows.where("article is not null").distinct().join(excluded.select("article"), "article", "left_anti")


def top_pivot(pivots: DataFrame) -> DataFrame:
    """The pivot of highest mass of each article (article, start, pwr_mass, peak_pct); of equal ones the earliest."""
    place = Window.partitionBy("article").orderBy(F.desc(F.coalesce("pwr_mass", F.lit(0))), "start")
    return pivots.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def lexical_label(jsd: Column) -> Column:
    return F.when(jsd >= 0.35, "large").when(jsd >= 0.15, "clear").when(jsd >= 0.08, "slight")


def fact_counts(checks: DataFrame) -> DataFrame:
    """Verdict counts of each article's latest check (article, as_of, verdict); as_of "now" comes last."""
    rank = F.struct((F.col("as_of") == "now").alias("now"), "as_of")
    last = F.max(rank).over(Window.partitionBy("article"))
    rows = checks.withColumns({"_r": rank, "_last": last}).where("_r = _last").withColumn("verdict", F.coalesce("verdict", F.lit("insufficient")))
    return rows.groupBy("article", "verdict").agg(F.count(F.lit(1)).alias("n"))


def signal_badges(findings: DataFrame) -> DataFrame:
    """Badges of an article, in order. findings: article, pwr_mass, pivot_status, has_diff, js_divergence, contradictions,
    differences, framing (array of verdicts), top10_share, from_graph."""
    is_set = lambda c: F.coalesce(F.col(c), F.lit(False))
    tier = F.when(F.col("pwr_mass") >= 200_000, "high").when(F.col("pwr_mass") >= 50_000, "med").otherwise("low")
    kind = F.when(F.col("pivot_status").eqNullSafe("confirmed"), "rewrite").otherwise("candidate")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    badges = F.array_compact(F.array(
        F.when(F.col("pwr_mass").isNotNull(), F.concat_ws(":", kind, tier)).when(is_set("has_diff"), "rewrite:med"),
        F.concat(F.lit("wording:"), lexical_label(F.col("js_divergence"))),
        F.when(n("contradictions") > 0, "facts:contradict").when(n("differences") > 0, "facts:differ"),
        F.when(F.array_contains("framing", "contradict"), "framing:contradict").when(F.size("framing") > 0, "framing:differ"),
        F.when(n("top10_share") >= 85, "authors:dominate").when(n("top10_share") >= 70, "authors:few"),
        F.when(is_set("from_graph"), "graph"),
    ))
    return findings.select("article", badges.alias("badges"))


def findings_index(findings: DataFrame, search: str = "", category: str = "all", sort: str = "pwr", page: int = 1, per: int = PER_PAGE) -> DataFrame:
    """One page of the findings (article, category, blob, pwr, lex) that hold the search text, sorted by pwr, lex, cat or
    az, then title. A page beyond the last gives the last. position counts from 1 over all matches. Nothing runs before the page is read."""
    keys = {"pwr": [F.desc("pwr")], "lex": [F.desc("lex")], "cat": [F.asc("category")], "az": []}[sort]
    rows = findings.where(F.contains(F.lower("blob"), F.lit(search.lower())))
    if category != "all":
        rows = rows.where(F.col("category") == category)
    order = [*keys, F.lower("article"), "article"]
    pages = F.greatest(F.lit(1), F.ceil(rows.agg(F.count(F.lit(1))).scalar() / per))
    start = (F.least(F.lit(max(page, 1)), pages) - 1) * per
    # as many of the first as the page asked for can need; the last page is among them if it asks for one beyond
    top = rows.orderBy(*order).limit(max(page, 1) * per).withColumn("position", F.row_number().over(Window.orderBy(*order)))
    return top.where((F.col("position") > start) & (F.col("position") <= start + per))


def interval_state(intervals: DataFrame, candidates: DataFrame, episodes: DataFrame) -> DataFrame:
    """What became of each interval (article, start, end, eligible, confirmable, anomalous): the decision of the first
    candidate window that holds it, else of the first confirmed episode that does.

    candidates: article, position, candidate_start, candidate_end, decision; episodes: without decision.
    """
    windows = candidates.select("article", F.lit(0).alias("kind"), "position", "candidate_start", "candidate_end", "decision")
    windows = windows.unionByName(episodes.select("article", F.lit(1).alias("kind"), "position", "candidate_start", "candidate_end", F.lit("confirmed").alias("decision")))
    key = ["article", "start", "end"]
    inside = (F.col("candidate_start") <= F.col("start")) & (F.col("end") <= F.col("candidate_end"))
    first = intervals.select(*key).join(windows, "article").where(inside).groupBy(*key).agg(F.min_by(F.struct("candidate_start", "candidate_end", "decision"), F.struct("kind", "position")).alias("w"))
    rows = intervals.join(first, key, "left")
    d, odd = F.col("w.decision"), F.coalesce("anomalous", F.lit(False))
    state = (
        F.when(~F.coalesce("eligible", F.lit(True)), "excluded").when(d.isin("confirmed", "rejected"), d).when(F.col("w").isNotNull(), "candidate_pending")
        .when(odd & ~F.coalesce("confirmable", F.lit(False)), "descriptive").when(odd, "anomaly_pending").otherwise("measured")
    )
    return rows.select(*key, "w.candidate_start", "w.candidate_end", state.alias("state"))


def rewrite_info(articles: DataFrame, evidence: DataFrame) -> DataFrame:
    """finding, none or unavailable for each article, with the reason, from the first evidence that tells.

    evidence: article, status, reason, source_status, source_reason, coarse_verdict (of the confirmation), has_pivot,
    has_diff, recorded_state, recorded_reason, has_lexical_pivot, lexical_span.
    """
    rows = articles.join(evidence, "article", "left")
    s, r = F.col("status"), F.col("recorded_state")
    why = F.when(F.col("source_status") == "partial", F.coalesce(F.nullif("source_reason", F.lit("")), F.col("reason"))).when(F.col("coarse_verdict") == "SKIP", "too few snapshots").otherwise(F.col("reason"))
    shown = F.coalesce("has_pivot", F.lit(False)) | F.coalesce("has_diff", F.lit(False))
    silent = ~F.coalesce("has_lexical_pivot", F.lit(False)) & F.contains(F.lower("lexical_span"), F.lit("no l1 pivot"))
    state = F.when(s == "confirmed", "finding").when(s == "not_confirmed", "none").when(s == "unavailable", "unavailable").when(shown, "finding").when(r.isin("none", "unavailable"), r).when(silent, "none").otherwise("unavailable")
    reason = F.when(s == "unavailable", why).when(~F.coalesce(s.isin("confirmed", "not_confirmed"), F.lit(False)) & ~shown & r.isin("none", "unavailable"), F.col("recorded_reason"))
    return rows.select("article", state.alias("state"), reason.alias("reason"))


def lex_noise_filter(terms: DataFrame, most: int = 12) -> DataFrame:
    """The first `most` terms (article, direction, rank, term) that say something."""
    term = F.lower(F.trim("term"))
    rows = terms.where((F.length(term) >= 3) & ~term.isin(*LEX_NOISE) & ~term.rlike(r"^\d+\z"))
    place = Window.partitionBy("article", "direction").orderBy("rank", "term")
    return rows.withColumn("position", F.row_number().over(place)).where(F.col("position") <= most)


def episode_navigator(records: DataFrame) -> DataFrame:
    """Records of an article and layer in time, those without a time last, each under an id that is its own.

    records: article, layer, episode_id, at (null: unknown), before_revid, after_revid. A missing id is made of the
    revisions, a missing or repeated one of the layer and the place.
    """
    own = Window.partitionBy("article", "layer")
    rows = records.withColumn("position", F.row_number().over(own.orderBy(F.asc_nulls_last("at"), F.asc_nulls_last("before_revid"), F.asc_nulls_last("after_revid"), F.asc_nulls_last("episode_id"))))
    pair = F.when(F.col("before_revid").isNotNull() & F.col("after_revid").isNotNull(), F.concat_ws("-", "before_revid", "after_revid"))
    rows = rows.withColumn("_id", F.coalesce(F.nullif("episode_id", F.lit("")), pair))
    again = F.row_number().over(Window.partitionBy("article", "layer", "_id").orderBy("position")) > 1
    made = F.concat_ws("-", "layer", F.lit("event"), "position")
    return rows.withColumn("episode_id", F.when(F.col("_id").isNull() | again, made).otherwise(F.col("_id"))).drop("_id")


def mscore_panel(scores: DataFrame, floor: float = 5.0) -> DataFrame:
    """scores with contested: whether the refined score a revision is at or above the floor."""
    return scores.withColumn("contested", F.coalesce(F.col("refined_per_rev") >= floor, F.lit(False)))


def version_records(editions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Before and after text of each edition of an article; for articles without any, the receipts of its languages.

    editions: article, lang, before, after; receipts: article, lang, side, text, wanted.
    """
    pairs = editions.unpivot(["article", "lang"], ["before", "after"], "side", "text").where("text is not null")
    rest = receipts.where("wanted").select("article", "lang", "side", "text").join(editions.select("article").distinct(), "article", "left_anti")
    return pairs.unionByName(rest)

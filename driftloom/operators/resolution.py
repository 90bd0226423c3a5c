"""States that rest on several results of an article: resolution, corroboration, scoring, coverage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params

STALE_DAYS = 7


def source_status(state: DataFrame, now: Column, days: int = STALE_DAYS) -> DataFrame:
    """source_status and source_reason of each article. state: article, source_status, source_checked_at (text), reason.
    Only a current_complete source can turn stale; an article without a row is unchecked."""
    status = F.coalesce("source_status", F.lit("unchecked"))
    at = F.try_to_timestamp(F.col("source_checked_at"))
    given = F.coalesce("source_checked_at", F.lit("")) != ""
    late = F.when(given & at.isNull(), "source check timestamp is invalid").when(given & (F.unix_seconds(now) - F.unix_seconds(at) > days * 86400), f"source check expired after {days} days")
    late = F.when(status == "current_complete", late)
    return state.select("article", F.when(late.isNotNull(), "stale").otherwise(status).alias("source_status"), F.when(status.isin("partial", "unavailable"), F.col("reason")).otherwise(late).alias("source_reason"))


def l1_state(verdicts: DataFrame, confirmations: DataFrame, sources: DataFrame) -> DataFrame:
    """One state an article from the coarse verdict, the exact result and the source.

    verdicts: article, verdict; confirmations: article, status, is_fresh, coverage_status, reason; sources: source_status().
    """
    exact = confirmations.select("article", F.coalesce("is_fresh", F.lit(False)).alias("confirmation_fresh"), F.when(F.col("is_fresh"), F.col("status")).alias("_exact"), "coverage_status", F.col("reason").alias("_why"))
    rows = verdicts.join(exact, "article", "left").join(sources, "article", "left")
    rows = rows.withColumns({"confirmation_fresh": F.coalesce("confirmation_fresh", F.lit(False)), "source_status": F.coalesce("source_status", F.lit("unchecked"))})
    v = F.col("verdict")
    candidate = F.when(v == "PIVOT?", "pivot_candidate").when(v == "CREEP?", "creep_candidate").when(v == "HEALTHY", "no_candidate").otherwise("unavailable")
    known = F.col("_exact").isin("confirmed", "not_confirmed")
    partial = F.coalesce((F.col("source_status") == "partial") & (F.col("coverage_status") == "partial") & known, F.lit(False))
    rows = rows.withColumns({"candidate_status": candidate, "_qualified": partial})
    rows = rows.withColumn("_bad", F.col("source_status").isin("partial", "stale", "unavailable") & ~F.col("_qualified"))
    c, bad, gone = F.col("candidate_status"), F.col("_bad"), F.coalesce(F.col("_exact") == "unavailable", F.lit(False))
    decided = (c != "no_candidate") & F.coalesce(known | gone, F.lit(False))
    analysis = F.when(gone | bad | (c == "unavailable"), "unavailable").when(F.col("_qualified"), "qualified").otherwise("available")
    confirmation = F.when(bad, "unavailable").when(decided, F.col("_exact")).when(c == "no_candidate", "not_applicable").when(c == "unavailable", "unavailable").otherwise("not_run")
    resolved = F.when(bad, "unavailable").when(decided, F.col("_exact")).when(c == "no_candidate", "healthy").when(c == "unavailable", "unavailable").otherwise("candidate")
    reason = F.when(bad | F.col("_qualified"), F.col("source_reason")).when(gone, F.col("_why"))
    return rows.select("article", "source_status", analysis.alias("analysis_status"), "candidate_status", confirmation.alias("confirmation_status"), "confirmation_fresh", resolved.alias("resolved_status"), reason.alias("reason"))


def confirmed_windows(confirmations: DataFrame, episodes: DataFrame) -> DataFrame:
    """Episodes of fresh confirmations in order (episode_index from 1) with their lasting id."""
    usable = confirmations.where("status = 'confirmed' and is_fresh").select("article")
    rows = episodes.join(usable, "article", "left_semi")
    place = Window.partitionBy("article").orderBy("candidate_start", "before_revid", "after_revid")
    return rows.withColumns({"episode_id": F.concat_ws("-", "before_revid", "after_revid"), "episode_index": F.row_number().over(place)})


def episode_artifact(windows: DataFrame, results: DataFrame) -> DataFrame:
    """Each window with its result (article, episode_id, value, error): a failure leaves that record alone unavailable.
    is_primary marks the first available record of an article."""
    rows = windows.select("article", "episode_id", "episode_index").join(results, ["article", "episode_id"], "left")
    rows = rows.withColumn("analysis_status", F.when(F.col("error").isNotNull() | F.col("value").isNull(), "unavailable").otherwise("available"))
    first = F.min(F.when(F.col("analysis_status") == "available", F.col("episode_index"))).over(Window.partitionBy("article"))
    return rows.withColumn("is_primary", F.coalesce(F.col("episode_index") == first, F.lit(False)))


def framing_windows(confirmed: DataFrame, candidates: DataFrame) -> DataFrame:
    """All confirmed windows of an article, or else its top candidate (article, start, end, pwr_mass)."""
    names = ["article", "start", "end", "pwr_mass"]
    sure = confirmed.select("article", F.col("candidate_start").alias("start"), F.col("candidate_end").alias("end"), "pwr_mass", F.lit("confirmed").alias("status"))
    place = Window.partitionBy("article").orderBy(F.desc("pwr_mass"), "start")
    rest = candidates.select(*names).join(confirmed.select("article").distinct(), "article", "left_anti")
    rest = rest.withColumn("_n", F.row_number().over(place)).where("_n = 1").select(*names, F.lit("candidate").alias("status"))
    return sure.unionByName(rest)


def corroboration(results: DataFrame) -> DataFrame:
    """Independent signals of an article. results: article, verdict, confirmation_status, l2_shifted, lexical_mode,
    lexical_adequate, js_divergence, refined_m, framing (array of verdicts)."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    state, coarse = F.col("confirmation_status"), F.col("verdict")
    open_state = ~yes(state.isin("confirmed", "not_confirmed", "unavailable", "not_applicable"))
    flagged = yes(coarse != "") & ~yes(coarse.rlike("^(HEALTHY|SKIP|n/a)"))
    lexical = yes(F.col("lexical_mode") == "pivot_relative") & yes(F.col("lexical_adequate")) & yes(F.col("js_divergence") > 0.05)
    contradict = yes(F.array_contains("framing", "contradict"))
    differ = ~contradict & yes(F.arrays_overlap("framing", F.array(*(F.lit(x) for x in ("differ", "absent_en", "absent_other")))))
    signals = F.array_compact(F.array(
        F.when(yes(state == "confirmed") | (open_state & flagged), "l1_pivot"), F.when(yes(F.col("l2_shifted")), "l2_shift"), F.when(lexical, "lexical_drift"),
        F.when(yes(F.col("refined_m") != 0), "mscore_contested"), F.when(contradict, "framing_contradict"), F.when(differ, "framing_differ"),
    ))
    return results.select("article", signals.alias("signals"), F.size(signals).alias("n_signals"))


def benchmark_score(roster: DataFrame, verdicts: DataFrame, leads: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Whether each case (article, cat, pending) came out as its category asks. leads: article, lead."""
    routes = leads.groupBy("article").agg(F.bool_or(F.col("lead").isin("addition→L2", "churn→L2")).alias("routed"))
    rows = roster.join(verdicts.select("article", "verdict", F.col("top_mass").alias("pwr_mass")), "article", "left").join(routes, "article", "left")
    rows = rows.withColumns({"pwr_mass": F.coalesce("pwr_mass", F.lit(0)), "routed": F.coalesce("routed", F.lit(False)), "verdict": F.coalesce("verdict", F.lit("SKIP"))})
    heavy, v, cat = F.col("pwr_mass") >= p.mass_floor, F.col("verdict"), F.col("cat")
    quiet = (v == "HEALTHY") | ~heavy
    status = (
        F.when(F.coalesce("pending", F.lit(False)) | (v == "SKIP"), "PENDING")
        .when(cat == "A_removal", F.when((v == "PIVOT?") & heavy, "PASS").when(v == "PIVOT?", "PARTIAL").otherwise("FAIL"))
        .when(cat == "B_addition", F.when(F.col("routed"), "PASS").otherwise("FAIL"))
        .when(cat == "D_benign", F.when(quiet, "PASS").otherwise("PARTIAL"))
        .when(cat == "E_clean", F.when(quiet, "PASS").otherwise("FAIL"))
        .when(cat == "C_l5gap", "L5-GAP").otherwise("PENDING")
    )
    return rows.select("article", "cat", status.alias("status"), "verdict", "pwr_mass", "routed")


def benchmark_summary(scores: DataFrame) -> DataFrame:
    """Passes and cases of each category, without those still pending."""
    return scores.where("status <> 'PENDING'").groupBy("cat").agg(F.count_if(F.col("status") == "PASS").alias("hit"), F.count(F.lit(1)).alias("total"))


def adaptive_cap(diagnostics: DataFrame, topics: DataFrame, default: int = 6, least: int = 3) -> DataFrame:
    """How many editions to ask next time, from the latest run of a topic (topic, at, langs, effective, errors)."""
    last = diagnostics.groupBy("topic").agg(F.max(F.struct("at", "langs", "effective", "errors")).alias("d"))
    rows = topics.join(last, "topic", "left").select("topic", "d.langs", "d.effective", "d.errors")
    won = F.coalesce("effective", F.lit(0))
    share = won / F.greatest(F.coalesce("langs", F.lit(0)), won + F.coalesce("errors", F.lit(0)), F.lit(1))
    cap = F.greatest(F.lit(least), F.least(F.lit(default), won + 1))
    cap = F.when((won < 2) | (share < 0.5), least).when(share < 0.7, F.least(cap, F.lit(4))).when(share < 0.85, F.least(cap, F.lit(5))).otherwise(F.least(F.lit(default), cap))
    return rows.select("topic", F.when(F.col("langs").isNull(), default).otherwise(cap).cast("int").alias("cap"))


def coverage_gaps(layers: DataFrame, topics: DataFrame, required: list[str]) -> DataFrame:
    """Topics that lack a required layer, with the missing ones in order. layers: topic, layer."""
    have = layers.groupBy("topic").agg(F.collect_set("layer").alias("have"))
    missing = F.array_except(F.array(*(F.lit(x) for x in required)), F.coalesce("have", F.array().cast("array<string>")))
    return topics.join(have, "topic", "left").select("topic", missing.alias("missing")).where(F.size("missing") > 0)


def canonicalize_topics(topics: DataFrame, identity: DataFrame) -> DataFrame:
    """topics (topic, position) as canonical titles, each at its first position."""
    rows = topics.join(identity.select(F.col("requested_title").alias("topic"), "canonical_title"), "topic", "left")
    return rows.groupBy(F.coalesce("canonical_title", "topic").alias("topic")).agg(F.min("position").alias("position"))


def usage_summary(calls: DataFrame, prices: DataFrame, *key: str) -> DataFrame:
    """Calls, tokens and cost. calls: provider, model, input_tokens, output_tokens; prices: provider, model and two rates a
    million tokens. The cost is null unless every call has a price."""
    rows = calls.join(prices, ["provider", "model"], "left")
    usd = F.bround((F.col("input_tokens") * F.col("input_per_million") + F.col("output_tokens") * F.col("output_per_million")) / 1e6, 8)
    whole = F.count("usd") == F.count(F.lit(1))
    return rows.withColumn("usd", usd).groupBy(*key).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.when(whole, F.bround(F.sum("usd"), 8)).alias("estimated_usd"), whole.alias("all_calls_priced"),
    )


def corpus_plan(requests: DataFrame) -> DataFrame:
    """How an update (article, shard_present, backend) goes on; an unknown backend gives kind null."""
    backend = F.lower(F.trim(F.when(F.coalesce("backend", F.lit("")) == "", "hosted").otherwise(F.col("backend"))))
    ingest, present = backend == "ingest", F.col("shard_present")
    kind = F.when(backend.isin("hosted", "ingest"), F.when(present, "delta").when(ingest, "cold_start").otherwise("cold_start_blocked"))
    return requests.select("article", kind.alias("kind"), F.coalesce(kind != "cold_start_blocked", F.lit(False)).alias("ok"), (ingest | ~present).alias("need_ingest"))


def categories(articles: DataFrame, curated: DataFrame, cached: DataFrame, allowed: list[str], default: str = "Other") -> DataFrame:
    """Category of an article: curated, else cached if it is an allowed one, else default."""
    own = curated.select("article", F.col("category").alias("_curated"))
    old = cached.where(F.col("category").isin(*allowed)).select("article", F.col("category").alias("_cached"))
    rows = articles.join(own, "article", "left").join(old, "article", "left")
    return rows.select("article", F.coalesce("_curated", "_cached", F.lit(default)).alias("category"))


def focal_entities(articles: DataFrame, registry: DataFrame) -> DataFrame:
    """Entities to follow: those of the registry (article, entities), else the title itself."""
    title = F.trim(F.coalesce("article", F.lit("")))
    own = F.when(title != "", F.array(title)).otherwise(F.array().cast("array<string>"))
    return articles.join(registry, "article", "left").select("article", F.coalesce("entities", own).alias("entities"))

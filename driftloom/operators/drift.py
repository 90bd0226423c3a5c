"""Persistence-weighted drift: interval profile, episodes, rolling windows, durable spine, verdicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import settled
from ..params import DEFAULT, Params
from .corpus import snapshots_distinct
from .membership import membership, places, snapshot_sums


def priority(percents: list[Column], masses: list[Column], p: Params = DEFAULT) -> Column:
    most, mass = F.greatest(*percents), F.greatest(*masses)
    return F.when((mass >= p.mass_floor) | (most >= p.extreme_change), "high").when(mass >= p.review_mass_floor, "review").otherwise("low")


def interval_profile(rsnap: DataFrame, p: Params = DEFAULT, excluded: DataFrame | None = None, member: DataFrame | None = None) -> DataFrame:
    """A row for each two snapshots that follow each other. excluded: (article, start_rev, end_rev) of uncovered intervals; member: rsnap's membership, if it is at hand."""
    snaps = places(rsnap) if member is None else snapshots_distinct(rsnap)
    order = Window.partitionBy("article").orderBy("k")
    sums = snapshot_sums(membership(rsnap, snaps) if member is None else member).join(snaps, ["article", "k"])
    ahead = {f"end_{c}": F.lead(c).over(order) for c in ("k", "snap_date", "snap_rev", "coming")}
    rows = sums.withColumns(ahead).where("end_k is not null")
    removed, added = F.col("leaving"), F.col("end_coming")
    replaced = F.least(removed, added)
    share = lambda x: F.lit(100.0) * x / F.col("weight")
    rows = rows.select(
        "article", "k", F.col("snap_date").alias("start_date"), F.col("snap_rev").alias("start_rev"), F.col("end_snap_date").alias("end_date"), F.col("end_snap_rev").alias("end_rev"),
        "size", F.col("weight").alias("start_weight"), removed.alias("pwr_removed"), added.alias("pwr_added"), (F.col("weight") - removed).alias("pwr_kept"), replaced.alias("pwr_replaced"),
        share(removed).alias("loss_pct"), share(added).alias("gain_pct"), share(F.col("weight") - removed).alias("retained_pct"), share(replaced).alias("replacement_pct"),
        (F.col("size") >= p.min_mature).alias("confirmable"),
    )
    kinds = F.concat_ws(",", F.when(F.col("loss_pct") >= p.elevated, "loss"), F.when(F.col("gain_pct") >= p.gain_floor, "gain"), F.when(F.col("replacement_pct") >= p.replacement_floor, "replacement"))
    percents = [F.col(c) for c in ("loss_pct", "gain_pct", "replacement_pct")]
    rows = rows.withColumns({"anomaly_types": kinds, "priority": priority(percents, [F.col(c) for c in ("pwr_removed", "pwr_added", "pwr_replaced")], p)})
    if excluded is None:
        return rows.withColumn("eligible", F.lit(True))
    gone = excluded.select("article", "start_rev", "end_rev").distinct().withColumn("_gone", F.lit(True))
    return rows.join(gone, ["article", "start_rev", "end_rev"], "left").withColumn("eligible", F.col("_gone").isNull()).drop("_gone")


def coarse_stats(profile: DataFrame) -> DataFrame:
    """Mean, median and population deviation of the loss over mature, covered intervals."""
    x = F.when(F.col("confirmable") & F.col("eligible"), F.col("loss_pct"))
    return profile.groupBy("article").agg(F.count(x).alias("intervals"), F.avg(x).alias("mean_loss"), F.percentile(x, F.lit(0.5)).alias("median_loss"), F.stddev_pop(x).alias("std_loss"), F.max(x).alias("peak_loss"))


def sweep_candidates(profile: DataFrame) -> DataFrame:
    """Every covered interval with an anomaly."""
    decision = F.when(F.col("confirmable"), "pending_confirmation").otherwise("descriptive_only")
    return profile.where((F.col("anomaly_types") != "") & F.col("eligible")).select("article", "start_date", "end_date", "anomaly_types", "priority", decision.alias("decision"), "loss_pct", "pwr_removed", "gain_pct", "pwr_added", "replacement_pct", "pwr_replaced")


def build_episodes(series: DataFrame, elevated: float = DEFAULT.elevated) -> DataFrame:
    """Runs of intervals at or above elevated whose dates touch. series: article, k, start/end date and rev, loss_pct, pwr_removed."""
    order = Window.partitionBy("article").orderBy("start_date", "start_rev")
    high = F.col("loss_pct") >= elevated
    rows = series.withColumns({"high": high, "last_high": F.lag(high).over(order), "last_end": F.lag("end_date").over(order)})
    begins = F.when(F.col("high") & F.coalesce("last_high", F.lit(False)) & (F.col("last_end") == F.col("start_date")), 0).otherwise(1)
    rows = rows.withColumn("island", F.sum(begins).over(order)).where("high")
    return rows.groupBy("article", "island").agg(
        F.min(F.struct("start_date", "start_rev")).alias("s"), F.max(F.struct("end_date", "end_rev")).alias("e"), F.sum("pwr_removed").cast("long").alias("pwr_mass"), F.max("loss_pct").alias("peak_pct")
    ).select("article", F.col("s.start_date"), F.col("s.start_rev"), F.col("e.end_date"), F.col("e.end_rev"), "pwr_mass", "peak_pct")


def age_years(day: Column, horizon: Column) -> Column:
    return F.greatest(F.lit(0.0), F.datediff(horizon, day) / F.lit(365.25))


def recency(age: Column, p: Params = DEFAULT) -> Column:
    return F.when(age <= p.recent_years, "recent").otherwise(F.concat(F.lit("standing "), F.format_string("%.0f", F.bround(age, 0)), F.lit("yr")))


def annotate_episodes(episodes: DataFrame, horizons: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Age at the horizon (article, horizon) and rank by mass, then date."""
    rank = Window.partitionBy("article").orderBy(F.desc("pwr_mass"), "start_date", "start_rev")
    rows = episodes.join(horizons, "article").withColumn("age_years", age_years(F.col("end_date"), F.col("horizon")))
    return rows.withColumns({"recency": recency(F.col("age_years"), p), "rank": F.row_number().over(rank)}).drop("horizon")


def horizons(rsnap: DataFrame) -> DataFrame:
    return rsnap.groupBy("article").agg(F.max("snap_date").alias("horizon"), F.countDistinct("snap_date", "snap_rev").alias("snapshots"))


def ranked_episodes(rsnap: DataFrame, p: Params = DEFAULT, profile: DataFrame | None = None) -> DataFrame:
    """Episodes that peak at or above the floor, of articles with three snapshots."""
    profile = interval_profile(rsnap, p) if profile is None else profile
    found = build_episodes(profile.where("confirmable and eligible"), p.elevated).where(F.col("peak_pct") >= p.mag_floor)
    return annotate_episodes(found, horizons(rsnap).where("snapshots >= 3").drop("snapshots"), p)


def verdict(rsnap: DataFrame, p: Params = DEFAULT, profile: DataFrame | None = None) -> DataFrame:
    """SKIP, PIVOT?, CREEP? or HEALTHY for each article. Three snapshots without a mature interval are HEALTHY."""
    profile = interval_profile(rsnap, p) if profile is None else profile
    top = ranked_episodes(rsnap, p, profile).groupBy("article").agg(F.count(F.lit(1)).alias("episodes"), F.max("pwr_mass").alias("top_mass"), F.min_by("recency", "rank").alias("top_recency"))
    rows = horizons(rsnap).join(coarse_stats(profile), "article", "left").join(top, "article", "left")
    mean = F.coalesce("mean_loss", F.lit(0.0))
    label = F.when(F.col("snapshots") < 3, "SKIP").when(F.col("episodes") > 0, "PIVOT?").when(mean > p.creep_mean, "CREEP?").otherwise("HEALTHY")
    return rows.select(
        "article", "horizon", "snapshots", label.alias("verdict"), F.bround(mean, 2).alias("mean_loss"), F.bround(F.coalesce("peak_loss", F.lit(0.0)), 2).alias("peak_loss"),
        F.coalesce("episodes", F.lit(0)).alias("episodes"), F.coalesce("top_mass", F.lit(0)).alias("top_mass"), "top_recency",
    )


def rolling_candidates(rsnap: DataFrame, p: Params = DEFAULT, blocked: DataFrame | None = None, mass_floor: int = 0) -> DataFrame:
    """Cohort loss over about a year. blocked: (article, blocked_date); a window with one strictly inside is skipped."""
    snaps = places(rsnap)
    member = membership(rsnap, snaps)
    target = round(p.rolling_window_months * 365.25 / 12)
    a = snaps.select("article", F.col("k").alias("start_k"), F.col("snap_date").alias("start_date"), F.col("snap_rev").alias("start_rev"))
    b = snaps.select("article", F.col("k").alias("end_k"), F.col("snap_date").alias("end_date"), F.col("snap_rev").alias("end_rev"))
    off = F.abs(F.datediff("end_date", "start_date") - target)
    pairs = a.join(b, "article").where((F.col("end_k") > F.col("start_k")) & (off <= p.rolling_tolerance_days))
    best = F.min(F.struct(off.alias("off"), "end_k", "end_date", "end_rev")).alias("b")
    pairs = pairs.groupBy("article", "start_k", "start_date", "start_rev").agg(best).select("article", "start_k", "start_date", "start_rev", "b.end_k", "b.end_date", "b.end_rev")
    if blocked is not None:
        inside = (pairs["article"] == blocked["article"]) & (blocked["blocked_date"] > pairs["start_date"]) & (blocked["blocked_date"] < pairs["end_date"])
        pairs = pairs.join(blocked, inside, "left_anti")
    pairs = settled(pairs, "windows")  # few: their size decides how they meet the tokens, which stay where they are
    held = member.select("article", F.col("k").alias("start_k"), "w", F.collect_list("k").over(Window.partitionBy("article", "token_id")).alias("ks"))
    lost = F.coalesce(F.sum(F.when(~F.array_contains("ks", F.col("end_k")), F.col("w"))), F.lit(0)).cast("long")
    rows = held.join(pairs, ["article", "start_k"]).groupBy(*pairs.columns).agg(F.count(F.lit(1)).alias("size"), F.sum("w").cast("long").alias("weight"), lost.alias("pwr_mass"))
    rows = rows.withColumn("peak_pct", F.lit(100.0) * F.col("pwr_mass") / F.col("weight"))
    kept = (F.col("size") >= p.min_mature) & (F.col("peak_pct") >= p.rolling_drop) & (F.col("pwr_mass") >= mass_floor)
    return rows.where(kept).select("article", "start_date", "start_rev", "end_date", "end_rev", "pwr_mass", "peak_pct")


def non_overlapping(candidates: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """Greedy choice by mass (then start): a window that overlaps one chosen before, or a blocked one, goes.

    The windows of one article are few (one for each snapshot at most), so they fit in an array.
    """
    item = F.struct((-F.col("pwr_mass")).alias("order"), "start_date", "end_date", "start_rev", "end_rev", "peak_pct")
    rows = candidates.groupBy("article").agg(F.sort_array(F.collect_list(item)).alias("found"))
    kind = "array<struct<start_date:date,end_date:date>>"
    if blocked is None:
        rows = rows.withColumn("blocked", F.array().cast(kind))
    else:
        other = blocked.groupBy("article").agg(F.collect_list(F.struct("start_date", "end_date")).alias("blocked"))
        rows = rows.join(other, "article", "left").withColumn("blocked", F.coalesce("blocked", F.array().cast(kind)))
    hits = lambda x, y: (x["start_date"] < y["end_date"]) & (y["start_date"] < x["end_date"])
    taken = rows.schema["found"].dataType.simpleString()
    step = lambda acc, x: F.when(F.exists(acc, lambda y: hits(x, y)) | F.exists("blocked", lambda y: hits(x, y)), acc).otherwise(F.array_append(acc, x))
    chosen = F.aggregate("found", F.array().cast(taken), step)
    return rows.select("article", F.explode(chosen).alias("c")).select("article", "c.start_date", "c.start_rev", "c.end_date", "c.end_rev", (-F.col("c.order")).alias("pwr_mass"), "c.peak_pct")


def durable_spine(member: DataFrame, windows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Tokens at a window's start whose weight reaches the lower median. windows: article, k, and what else tells them apart."""
    rows = windows.join(member.select("article", "k", "token_id", "w"), ["article", "k"])
    own = Window.partitionBy(*windows.columns)
    # the element at int(q * (n - 1)) of the sorted weights
    counts = rows.groupBy(*windows.columns, "w").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*windows.columns).orderBy("w")
    cut = counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(own)})
    cut = cut.where(F.col("upto") > F.floor(F.lit(p.durable_q) * (F.col("total") - 1))).groupBy(*windows.columns).agg(F.min("w").alias("cut"))
    return rows.join(cut, windows.columns).where("w >= cut")


def cohort_survival(spine: DataFrame, windows: DataFrame, revisions: DataFrame, token_state: DataFrame) -> DataFrame:
    """For each revision of a window (article, k, start_ts, end_ts), the share of the spine that it has.

    A revision without any token state has a null share, never 0. seq: the place in the window, from 0.
    """
    seq = Window.partitionBy("article", "k").orderBy("ts", "rev_id")
    revs = windows.join(revisions.select("article", "rev_id", "ts"), "article").where("ts > start_ts and ts <= end_ts")
    revs = revs.withColumn("seq", F.row_number().over(seq) - 1).select("article", "k", "rev_id", "ts", "seq")
    size = spine.groupBy("article", "k").agg(F.count(F.lit(1)).alias("cohort"))
    state = token_state.select("article", "rev_id", "token_id").distinct()
    known = state.select("article", "rev_id").distinct().withColumn("known", F.lit(True))
    hits = revs.join(state, ["article", "rev_id"]).join(spine.select("article", "k", "token_id"), ["article", "k", "token_id"], "left_semi").groupBy("article", "k", "rev_id").agg(F.count(F.lit(1)).alias("hits"))
    rows = revs.join(size, ["article", "k"]).join(known, ["article", "rev_id"], "left").join(hits, ["article", "k", "rev_id"], "left")
    return rows.select("article", "k", "rev_id", "ts", "seq", "cohort", F.when(F.col("known"), F.coalesce("hits", F.lit(0)) / F.col("cohort")).alias("share"))


def refine(spine: DataFrame, windows: DataFrame, revisions: DataFrame, token_state: DataFrame | Callable[[DataFrame], DataFrame], p: Params = DEFAULT) -> DataFrame:
    """Bisect each window (article, k, start_ts, end_ts) to the pair of revisions with the dominant drop of the spine:
    article, k, before_rev, after_rev, drop (the whole window's), probed (revisions whose states were read).

    All windows go together: a round probes one revision of each that isn't settled, and reads the token states (article,
    rev_id, token_id) of the probed revisions alone. token_state may be a function that gets the probes (article, rev_id) and
    gives their states. There are as many rounds as bits in the longest window's number of revisions; each ends in a
    checkpoint, so lost executors cost a round at most.

    A revision without any token state ends a window's search with no pair and no drop, which leaves the fallback to the
    caller; so do fewer than three revisions or a small cohort.
    """
    spine = spine.select("article", "k", "token_id").checkpoint()
    place = Window.partitionBy("article", "k").orderBy("ts", "rev_id")
    revs = windows.join(revisions.select("article", "rev_id", "ts"), "article").where("ts > start_ts and ts <= end_ts")
    revs = revs.withColumn("seq", F.row_number().over(place) - 1).select("article", "k", "seq", "rev_id").checkpoint()
    sizes = revs.groupBy("article", "k").agg(F.count(F.lit(1)).alias("n"))
    cohorts = spine.groupBy("article", "k").agg(F.count(F.lit(1)).alias("cohort"))

    def shares(asked: DataFrame) -> DataFrame:
        """article, k, rev_id of asked, with share: null without states."""
        asked = asked.select("article", "k", "rev_id").distinct()
        wanted = asked.select("article", "rev_id").distinct()
        state = (token_state(wanted) if callable(token_state) else token_state.join(wanted, ["article", "rev_id"], "left_semi")).select("article", "rev_id", "token_id").distinct()
        known = state.select("article", "rev_id").distinct().withColumn("known", F.lit(True))
        hits = asked.join(state, ["article", "rev_id"]).join(spine, ["article", "k", "token_id"], "left_semi").groupBy("article", "k", "rev_id").agg(F.count(F.lit(1)).alias("hits"))
        rows = asked.join(known, ["article", "rev_id"], "left").join(hits, ["article", "k", "rev_id"], "left").join(cohorts, ["article", "k"])
        return rows.select("article", "k", "rev_id", F.when(F.col("known"), F.coalesce("hits", F.lit(0)) / F.col("cohort")).alias("share"))

    at = lambda seq, name: revs.select("article", "k", F.col("seq").alias(seq), F.col("rev_id").alias(name))
    able = sizes.join(cohorts, ["article", "k"]).where((F.col("n") >= 3) & (F.col("cohort") >= p.min_cohort))
    able = able.select("article", "k", F.lit(0).alias("lo"), (F.col("n") - 1).cast("int").alias("hi")).join(at("lo", "lo_rev"), ["article", "k", "lo"]).join(at("hi", "hi_rev"), ["article", "k", "hi"]).checkpoint()
    ends = shares(able.select("article", "k", F.explode(F.array("lo_rev", "hi_rev")).alias("rev_id"))).checkpoint()
    end = lambda rev, name: ends.select("article", "k", F.col("rev_id").alias(rev), F.col("share").alias(name))
    now = able.join(end("lo_rev", "lo_share"), ["article", "k", "lo_rev"]).join(end("hi_rev", "hi_share"), ["article", "k", "hi_rev"])
    now = now.withColumns({"drop": F.col("lo_share") - F.col("hi_share"), "failed": F.col("lo_share").isNull() | F.col("hi_share").isNull(), "probed": F.lit(2)}).checkpoint()
    longest = sizes.agg(F.max("n")).first()[0] or 0
    for _ in range((longest - 1).bit_length() if longest >= 3 else 0):
        going = ~F.col("failed") & (F.col("hi") - F.col("lo") > 1)
        asked = now.where(going).withColumn("seq", F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")).join(revs, ["article", "k", "seq"])
        mids = asked.select("article", "k", "seq", "rev_id").join(shares(asked), ["article", "k", "rev_id"])
        left = F.col("lo_share") - F.col("share") >= F.col("share") - F.col("hi_share")
        known, keep = F.col("share").isNotNull(), lambda c, other, when: F.when(when, F.col(other)).otherwise(F.col(c)).alias(c)
        rows = now.where(going).join(mids, ["article", "k"])
        moved = rows.select(
            "article", "k", *(keep(f"hi{s}", other, known & left) for s, other in (("", "seq"), ("_rev", "rev_id"), ("_share", "share"))),
            *(keep(f"lo{s}", other, known & ~left) for s, other in (("", "seq"), ("_rev", "rev_id"), ("_share", "share"))), "drop", (~known).alias("failed"), (F.col("probed") + 1).alias("probed"),
        )
        now = now.where(~going).unionByName(moved).checkpoint()
    found = sizes.join(now, ["article", "k"], "left")
    fine = F.coalesce(~F.col("failed"), F.lit(False))
    return found.select("article", "k", F.when(fine, F.col("lo_rev")).alias("before_rev"), F.when(fine, F.col("hi_rev")).alias("after_rev"), F.when(fine, F.col("drop")).alias("drop"), F.coalesce("probed", F.lit(0)).alias("probed"))


def endpoint_refine(spine: DataFrame, member: DataFrame, windows: DataFrame) -> DataFrame:
    """The fallback without token states: the spine's decline between a window's snapshots (article, k, end_k)."""
    ends = windows.select("article", F.col("end_k").alias("k")).distinct()  # few: other snapshots' tokens needn't be dealt out
    end = member.join(ends, ["article", "k"], "left_semi").select("article", F.col("k").alias("end_k"), "token_id", F.lit(1).alias("there"))
    rows = spine.select("article", "k", "token_id").join(windows.select("article", "k", "end_k"), ["article", "k"]).join(end, ["article", "end_k", "token_id"], "left")
    return rows.groupBy("article", "k", "end_k").agg(F.count(F.lit(1)).alias("cohort"), (1 - F.sum(F.coalesce("there", F.lit(0))) / F.count(F.lit(1))).alias("drop"))


def candidate_evaluation(candidates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """candidates with drop (null: no evidence) get a decision and its reason."""
    decision = F.when(F.col("drop") >= p.confirm_drop, "confirmed").otherwise("rejected")
    reason = F.when(F.col("drop").isNull(), "insufficient_revision_evidence").when(F.col("drop") < p.confirm_drop, "durable_spine_drop_below_threshold")
    return candidates.withColumns({"decision": decision, "rejection_reason": reason, "drop": F.bround("drop", 6)})


def two_pass(primary: DataFrame, rolling: DataFrame) -> DataFrame:
    """Evaluations of both passes: rolling ones count only where no primary one of the article is confirmed."""
    done = primary.where("decision = 'confirmed'").select("article").distinct()
    return primary.withColumn("source", F.lit("interval")).unionByName(rolling.join(done, "article", "left_anti").withColumn("source", F.lit("rolling")))


def removal_attribution(token_life: DataFrame, revisions: DataFrame, windows: DataFrame, latest_tokens: DataFrame) -> DataFrame:
    """Tokens older than a window (article, rev_id, start_ts, end_ts) whose last removal falls into it and that the latest
    snapshot lacks, by the editor of that removal. The last removal is the greatest revision id with a known editor."""
    revs = revisions.select("article", "rev_id", "ts", "user")
    born = revs.select("article", F.col("rev_id").alias("o_rev_id"), F.col("ts").alias("o_ts"))
    rows = windows.join(token_life, ["article", "rev_id"]).join(born, ["article", "o_rev_id"]).where("o_ts < start_ts")
    outs = rows.select("article", "rev_id", "start_ts", "end_ts", "token_id", F.explode("out").alias("out_rev"))
    outs = outs.join(revs.select("article", F.col("rev_id").alias("out_rev"), F.col("ts").alias("out_ts"), "user").where("user is not null"), ["article", "out_rev"])
    last = outs.groupBy("article", "rev_id", "start_ts", "end_ts", "token_id").agg(F.max(F.struct("out_rev", "out_ts", "user")).alias("o"))
    last = last.where("o.out_ts > start_ts and o.out_ts <= end_ts").join(latest_tokens.select("article", "token_id").distinct(), ["article", "token_id"], "left_anti")
    return last.groupBy("article", "rev_id", F.col("o.user").alias("editor")).agg(F.count(F.lit(1)).alias("tokens"))


def profile(rsnap: DataFrame, revisions: DataFrame, latest: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Age and authorship of the current text. An unknown origin counts as editor '?' and has no age."""
    rows = rsnap.join(latest.select("article", "snap_date", "snap_rev"), ["article", "snap_date", "snap_rev"])
    born = revisions.select("article", F.col("rev_id").alias("o_rev_id"), "ts", "user")
    rows = rows.join(born, ["article", "o_rev_id"], "left").withColumns({"age": F.datediff("snap_date", F.to_date("ts")) / F.lit(365.25), "editor": F.coalesce("user", F.lit("?"))})
    total = rows.groupBy("article", "snap_date").agg(F.count(F.lit(1)).alias("n_tokens"), F.percentile("age", F.lit(0.5)).alias("median"), F.sum(F.when(F.col("age") <= p.recent_years, 1).otherwise(0)).alias("recent"))
    rank = Window.partitionBy("article").orderBy(F.desc("n"), "editor")
    editors = rows.groupBy("article", "editor").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(rank))
    editors = editors.groupBy("article").agg(F.count(F.lit(1)).alias("distinct_editors"), F.sum(F.when(F.col("rank") <= 10, F.col("n"))).alias("top"))
    return total.join(editors, "article").select(
        "article", F.col("snap_date").alias("horizon"), "n_tokens", F.bround(F.coalesce("median", F.lit(0.0)), 1).alias("median_age_yrs"),
        F.bround(F.lit(100.0) * F.col("recent") / F.col("n_tokens"), 1).alias("pct_recent"), F.bround(F.lit(100.0) * F.col("top") / F.col("n_tokens"), 1).alias("top10_editor_share"), "distinct_editors",
    )


def coverage_plan(expected: DataFrame, loaded: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(missing, excluded intervals, endpoints_complete) from tables of (article, snap_date, snap_rev)."""
    missing = expected.join(loaded.select("article", "snap_rev").distinct(), ["article", "snap_rev"], "left_anti")
    order = Window.partitionBy("article").orderBy("snap_date", "snap_rev")
    pairs = loaded.withColumns({"end_date": F.lead("snap_date").over(order), "end_rev": F.lead("snap_rev").over(order)}).where("end_rev is not null")
    pairs = pairs.select("article", F.col("snap_date").alias("start_date"), F.col("snap_rev").alias("start_rev"), "end_date", "end_rev")
    gap = missing.select(F.col("article").alias("_a"), F.col("snap_date").alias("_d"))
    excluded = pairs.join(gap, (F.col("article") == F.col("_a")) & (F.col("start_date") < F.col("_d")) & (F.col("_d") < F.col("end_date")), "left_semi")
    ends = expected.groupBy("article").agg(F.min_by("snap_rev", F.struct("snap_date", "snap_rev")).alias("first"), F.max_by("snap_rev", F.struct("snap_date", "snap_rev")).alias("last"))
    have = loaded.select("article", "snap_rev").distinct()
    both = ends.select("article", F.explode(F.array("first", "last")).alias("snap_rev")).join(have.withColumn("ok", F.lit(True)), ["article", "snap_rev"], "left")
    return missing, excluded, both.groupBy("article").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("endpoints_complete"))

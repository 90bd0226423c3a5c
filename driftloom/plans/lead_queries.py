"""Queries of discovery, resolution, stance runs and publication, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import discovery, publication, resolution, stance
from .bindings import SMALL as P
from .bindings import Views
from .drift_queries import query

_ELIGIBLE = "editor not in ('', '?', '<hidden>') and lower(editor) not like '%bot' and editor not like '10.0.0.%'"


def _judged(v: Views, replacements: bool = False) -> DataFrame:
    return discovery.judged_events(v.confirmations, v.episodes, v.event_editors, replacements)


@query(f"""select editor, count(distinct u.article) article_count, count(*) event_count, sum(tokens)::bigint removed_tokens, array_to_string(list_sort(list(distinct u.article)), ' ') articles, array_to_string(list_sort(list(u.article || ':' || u.before_revid || '→' || after_revid)), ' ') events
  from usable u join event_editors x on x.before_revid = u.before_revid and kind = 'removal' where reason is null and {_ELIGIBLE} group by 1""")
def event_graph(v: Views) -> DataFrame:
    return discovery.event_graph(_judged(v), v.event_editors).withColumns({c: F.array_join(c, " ") for c in ("articles", "events")})


@query("""select article, case when status <> 'confirmed' then 'not_confirmed' else 'stale_confirmation' end reason, null::bigint before_revid, null::bigint after_revid from confirmations where status <> 'confirmed' or not is_fresh
  union all select article, reason, before_revid, after_revid from usable where reason is not null""")
def event_exclusions(v: Views) -> DataFrame:
    return discovery.event_exclusions(v.confirmations, _judged(v))


_SEEDS = f""", first as (select * from usable qualify row_number() over (partition by article order by pwr_mass desc, before_revid) = 1),
seeds as (select f.article, row_number() over (partition by f.article order by tokens desc, editor)::int rank, editor, tokens from first f join event_editors x on x.before_revid = f.before_revid and kind = 'removal' where reason is null and {_ELIGIBLE} qualify rank <= 4)"""


@query(_SEEDS + " select * from seeds")
def seed_editors(v: Views) -> DataFrame:
    return discovery.seed_editors(_judged(v), v.event_editors)


def _footprint(v: Views) -> DataFrame:
    n = F.col("l_orderkey")
    contribs = v.table("lineitem").select(
        F.concat(F.lit("u"), F.col("l_suppkey") % 23).alias("editor"), F.concat(F.lit("c_"), F.col("l_partkey") % 60).alias("title"), F.when(n % 3 == 0, 40).otherwise(-F.col("l_quantity") * 20).cast("long").alias("sizediff")
    )
    tested = v.table("customer").where("c_custkey % 10 = 3").select(F.concat(F.lit("c "), "c_custkey").alias("title"))
    seeds = seed_editors(v).withColumn("article", F.replace("article", F.lit("c"), F.lit("c_")))
    return discovery.removal_footprint(contribs, seeds, tested)


_FOOTPRINT = _SEEDS + """, cuts as (select 'u' || (l_suppkey % 23) editor, 'c ' || (l_partkey % 60) title, sum(-(-l_quantity * 20)::bigint)::bigint removed, count(*) edits from lineitem where l_orderkey % 3 <> 0 group by 1, 2 having removed >= 1500),
foot as (select replace(s.article, 'c', 'c_') article, title, count(distinct editor) editors, sum(removed)::bigint removed, sum(edits)::bigint edits from seeds s join cuts using (editor)
  where title <> replace(s.article, 'c', 'c ') and title not in (select 'c ' || c_custkey from customer where c_custkey % 10 = 3) group by 1, 2)"""


@query(_FOOTPRINT + " select * from foot")
def removal_footprint(v: Views) -> DataFrame:
    return _footprint(v)


@query(_FOOTPRINT + " select *, row_number() over (partition by article order by editors desc, removed desc, title)::int rank from foot qualify rank <= 12")
def rank_candidates(v: Views) -> DataFrame:
    return discovery.rank_candidates(_footprint(v))


_ORDERS_AS_LOG = "(select 'c' || c_custkey article, date '1993-01-01' + (c_custkey % 900)::int born from customer where c_custkey % 4 <> 0)"


@query(f""", top as (select article, max(pwr_mass) top_mass, arg_max(candidate_start, (pwr_mass, -before_revid)) began from lead_episodes group by 1),
r as (select article, status, coalesce(top_mass, 0) top_mass, case when status = 'confirmed' then round_even((began - born) / 365.25::double, 1) end age_at_pivot from confirmations left join top using (article) left join {_ORDERS_AS_LOG} using (article))
select article, top_mass, age_at_pivot, case when status <> 'confirmed' then status when top_mass < 150000 then 'confirmed-low-mass' when age_at_pivot is null then 'confirmed-age-unknown' when age_at_pivot < 2 then 'confirmed-born-in-contested' else 'confirmed-retrofit-lead' end lead_class from r""")
def retest_class(v: Views) -> DataFrame:
    from dataclasses import replace

    born = F.date_add(F.lit("1993-01-01").cast("date"), (F.col("c_custkey") % 900).cast("int"))
    log = v.table("customer").where("c_custkey % 4 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("article"), born.cast("timestamp").alias("ts"))
    return discovery.retest_class(v.confirmations, v.episodes, log, replace(P, mass_floor=150_000))


_SHARES = """, tops as (select before_revid, max(case when kind = 'removal' then (tokens, n) end) x, arg_max(editor, n) filter (where kind = 'removal') re, max(tokens) filter (where kind = 'removal') rt, arg_max(editor, n) filter (where kind = 'replacement') pe, max(tokens) filter (where kind = 'replacement') pt, sum(tokens) filter (where kind = 'removal') two
  from (select *, -row_number() over (partition by before_revid, kind order by tokens desc, editor) n from event_editors qualify n >= -2) group by 1),
conc as (select u.article, u.before_revid, after_revid, durable_spine_drop, pwr_mass, duration_seconds, removed_tokens, replacement_tokens, re top_removal_editor, pe top_replacement_editor, case when removed_tokens <> 0 then round_even(rt / removed_tokens, 6) end top_removal_share,
  case when replacement_tokens <> 0 then round_even(pt / replacement_tokens, 6) end top_replacement_share, coalesce(re = pe, false) same_top_editor, case when removed_tokens <> 0 then round_even(two / removed_tokens, 6) end top_two_removal_share from usable u left join tops using (before_revid) where reason is null and reason2 is null)"""
_SHARES = _SHARES.replace("max(case when kind = 'removal' then (tokens, n) end) x, ", "")


@query(_SHARES + " select * from conc")
def concentration(v: Views) -> DataFrame:
    return discovery.concentration(_judged(v, True), v.event_editors)


@query(_SHARES + ", long as (" + " union all ".join(f"select '{c}' feature, {c}::double as value from conc" for c in discovery.FEATURES) + """),
s as (select feature, count(value) n, min(value) least, quantile_cont(value, 0.5) middle, max(value) most from long group by 1)
select *, case when feature like '%share' then case when n < 2 then 'fewer than two observations' when least = most then 'no observed variance' end end blocker from s""")
def concentration_summary(v: Views) -> DataFrame:
    return discovery.concentration_summary(concentration(v))


def _article() -> Column:
    return F.concat(F.lit("c"), F.col("c_custkey"))


def _pick(key: str, *values: str | None) -> Column:
    """One of the values by the remainder of key."""
    out = F.when(F.col(key) % len(values) == 0, F.lit(values[0]))
    for k, x in enumerate(values[1:], 1):
        out = out.when(F.col(key) % len(values) == k, F.lit(x))
    return out


def _pick_sql(key: str, *values: str | None) -> str:
    return f"case {key} % {len(values)} " + " ".join(f"when {k} then " + ("null" if x is None else f"'{x}'") for k, x in enumerate(values)) + " end"


_STATUS = ("current_complete", "partial", "unavailable", None, "history_complete", "current_complete", "current_complete")
_CHECKED = ("2026-01-01 00:00:00", "2025-12-20 00:00:00", "", "soon")
_STATES = f""", src0 as (select 'c' || c_custkey article, {_pick_sql('c_custkey', *_STATUS)} st, {_pick_sql('(c_custkey // 7)', *_CHECKED)} checked, 'r' || c_custkey why from customer where c_custkey % 9 <> 0),
src as (select article, case when st = 'current_complete' and checked = 'soon' then 'stale' when st = 'current_complete' and checked <> '' and timestamp '2026-01-03' - try_cast(checked as timestamp) > interval 7 days then 'stale' else coalesce(st, 'unchecked') end source_status,
  case when st in ('partial', 'unavailable') then why when st = 'current_complete' and checked = 'soon' then 'source check timestamp is invalid' when st = 'current_complete' and checked <> '' and timestamp '2026-01-03' - try_cast(checked as timestamp) > interval 7 days then 'source check expired after 7 days' end source_reason from src0)"""


def _sources(v: Views, every: bool = False) -> DataFrame:
    """Source states of most customers; every: those of all, unchecked where nothing is known."""
    rows = v.table("customer").where("c_custkey % 9 <> 0").withColumn("k7", F.floor(F.col("c_custkey") / 7))
    rows = rows.select(_article().alias("article"), _pick("c_custkey", *_STATUS).alias("source_status"), _pick("k7", *_CHECKED).alias("source_checked_at"), F.concat(F.lit("r"), "c_custkey").alias("reason"))
    rows = v.table("customer").select(_article().alias("article")).join(rows, "article", "left") if every else rows
    return resolution.source_status(rows, F.lit("2026-01-03").cast("timestamp"))


@query(_STATES + " select article, coalesce(source_status, 'unchecked') source_status, source_reason from (select 'c' || c_custkey article from customer) left join src using (article)")
def source_status(v: Views) -> DataFrame:
    return _sources(v, every=True)


_VERDICTS = ("PIVOT?", "CREEP?", "HEALTHY", "SKIP", "PIVOT?", None)


@query(_STATES + f""", a as (select 'c' || c_custkey article, {_pick_sql('c_custkey', *_VERDICTS)} verdict, case when c_custkey % 2 = 1 then 'partial' end coverage_status from customer),
b as (select a.article, verdict, coverage_status, coalesce(is_fresh, false) confirmation_fresh, case when is_fresh then status end exact, 'w' || a.article why, coalesce(source_status, 'unchecked') source_status, source_reason from a left join confirmations c on c.article = a.article left join src on src.article = a.article),
d as (select *, case verdict when 'PIVOT?' then 'pivot_candidate' when 'CREEP?' then 'creep_candidate' when 'HEALTHY' then 'no_candidate' else 'unavailable' end candidate_status, coalesce(source_status = 'partial' and coverage_status = 'partial' and exact in ('confirmed', 'not_confirmed'), false) q from b),
e as (select *, source_status in ('partial', 'stale', 'unavailable') and not q bad, candidate_status <> 'no_candidate' and exact is not null decided from d)
select article, source_status, case when bad or exact = 'unavailable' or candidate_status = 'unavailable' then 'unavailable' when q then 'qualified' else 'available' end analysis_status, candidate_status,
  case when bad then 'unavailable' when decided then exact when candidate_status = 'no_candidate' then 'not_applicable' when candidate_status = 'unavailable' then 'unavailable' else 'not_run' end confirmation_status, confirmation_fresh,
  case when bad then 'unavailable' when decided then exact when candidate_status = 'no_candidate' then 'healthy' when candidate_status = 'unavailable' then 'unavailable' else 'candidate' end resolved_status, case when bad or q then source_reason when exact = 'unavailable' then why end reason from e""")
def l1_state(v: Views) -> DataFrame:
    verdicts = v.table("customer").select(_article().alias("article"), _pick("c_custkey", *_VERDICTS).alias("verdict"))
    number = F.substring("article", 2, 20).cast("long")
    exact = v.confirmations.withColumns({"coverage_status": F.when(number % 2 == 1, "partial"), "reason": F.concat(F.lit("w"), "article")})
    return resolution.l1_state(verdicts, exact, _sources(v))


_WINDOWS = ", win as (select e.article, before_revid || '-' || after_revid episode_id, row_number() over (partition by e.article order by candidate_start, before_revid, after_revid)::int episode_index, candidate_start, candidate_end, pwr_mass, before_revid from lead_episodes e join confirmations c on c.article = e.article and status = 'confirmed' and is_fresh)"


@query(_WINDOWS + " select article, episode_id, episode_index, candidate_start, candidate_end from win")
def confirmed_windows(v: Views) -> DataFrame:
    return resolution.confirmed_windows(v.confirmations, v.episodes).select("article", "episode_id", "episode_index", "candidate_start", "candidate_end")


@query(_WINDOWS + """, r as (select article, episode_id, episode_index, case when before_revid % 4 = 1 then before_revid end as value, case when before_revid % 4 = 2 then 'failed' end error from win),
s as (select *, case when error is not null or value is null then 'unavailable' else 'available' end analysis_status from r)
select *, coalesce(episode_index = min(case when analysis_status = 'available' then episode_index end) over (partition by article), false) is_primary from s""")
def episode_artifact(v: Views) -> DataFrame:
    n = F.col("before_revid")
    made = v.episodes.where(n % 4 != 3).select("article", F.concat_ws("-", "before_revid", "after_revid").alias("episode_id"), F.when(n % 4 == 1, n).alias("value"), F.when(n % 4 == 2, "failed").alias("error"))
    return resolution.episode_artifact(resolution.confirmed_windows(v.confirmations, v.episodes), made)


@query(_WINDOWS + """ select article, candidate_start "start", candidate_end "end", pwr_mass, 'confirmed' status from win union all
select * from (select article, candidate_start, candidate_end, pwr_mass, 'candidate' from lead_episodes where article not in (select article from win) qualify row_number() over (partition by article order by pwr_mass desc, candidate_start) = 1)""")
def framing_windows(v: Views) -> DataFrame:
    coarse = v.episodes.select("article", F.col("candidate_start").alias("start"), F.col("candidate_end").alias("end"), "pwr_mass")
    return resolution.framing_windows(resolution.confirmed_windows(v.confirmations, v.episodes), coarse)


_CONFIRMED = ("confirmed", "not_confirmed", None, "not_applicable", "not_run")
_FRAMING = ("contradict", "differ", "agree", None, "absent_en")


@query(f""", c as (select c_custkey n, 'c' || c_custkey article, {_pick_sql('c_custkey', *_VERDICTS)} verdict, {_pick_sql('c_custkey', *_CONFIRMED)} st, {_pick_sql('(c_custkey // 3)', *_FRAMING)} fr from customer),
s as (select article, concat_ws(',', case when st = 'confirmed' or ((st is null or st = 'not_run') and verdict in ('PIVOT?', 'CREEP?')) then 'l1_pivot' end, case when n % 4 = 0 then 'l2_shift' end, case when n % 3 <> 0 and n % 2 = 0 and n % 10 > 5 then 'lexical_drift' end,
  case when n % 8 <> 0 then 'mscore_contested' end, case when fr = 'contradict' then 'framing_contradict' end, case when fr in ('differ', 'absent_en') then 'framing_differ' end) signals from c)
select article, signals, case when signals = '' then 0 else len(string_split(signals, ',')) end::int n_signals from s""")
def corroboration(v: Views) -> DataFrame:
    n = F.col("c_custkey")
    rows = v.table("customer").withColumn("k3", F.floor(n / 3)).select(
        _article().alias("article"), _pick("c_custkey", *_VERDICTS).alias("verdict"), _pick("c_custkey", *_CONFIRMED).alias("confirmation_status"), (n % 4 == 0).alias("l2_shifted"),
        F.when(n % 3 != 0, "pivot_relative").alias("lexical_mode"), F.when(n % 2 == 0, F.lit(True)).alias("lexical_adequate"), ((n % 10) / 100.0).alias("js_divergence"), (n % 8).alias("refined_m"),
        F.array_compact(F.array(_pick("k3", *_FRAMING))).alias("framing"),
    )
    return resolution.corroboration(rows).withColumn("signals", F.array_join("signals", ","))


_CATS = ("A_removal", "B_addition", "C_l5gap", "D_benign", "E_clean", "other")
_LEADS = ("addition→L2", "removal→PWR", "churn→L2")
_SCORES = f""", ro as (select 'c' || c_custkey article, {_pick_sql('(c_custkey // 2)', *_CATS)} cat, c_custkey % 13 = 0 pending from customer),
ve as (select 'c' || c_custkey article, {_pick_sql('c_custkey', *_VERDICTS)} verdict, (c_custkey * 7919 % 1000)::bigint top_mass from customer where c_custkey % 17 <> 0),
le as (select distinct 'c' || c_custkey article from customer where c_custkey % 3 <> 1 and c_custkey % 7 <> 0),
sc as (select ro.article, cat, coalesce(verdict, 'SKIP') verdict, coalesce(top_mass, 0) pwr_mass, le.article is not null routed, pending from ro left join ve on ve.article = ro.article left join le on le.article = ro.article),
score as (select article, cat, case when pending or verdict = 'SKIP' then 'PENDING' when cat = 'A_removal' then case when verdict <> 'PIVOT?' then 'FAIL' when pwr_mass >= {P.mass_floor} then 'PASS' else 'PARTIAL' end when cat = 'B_addition' then case when routed then 'PASS' else 'FAIL' end
  when cat in ('D_benign', 'E_clean') then case when verdict = 'HEALTHY' or pwr_mass < {P.mass_floor} then 'PASS' when cat = 'D_benign' then 'PARTIAL' else 'FAIL' end when cat = 'C_l5gap' then 'L5-GAP' else 'PENDING' end status, verdict, pwr_mass, routed from sc)"""


@query(_SCORES + " select * from score")
def benchmark_score(v: Views) -> DataFrame:
    n, c = F.col("c_custkey"), v.table("customer").withColumn("k2", F.floor(F.col("c_custkey") / 2))
    roster = c.select(_article().alias("article"), _pick("k2", *_CATS).alias("cat"), (n % 13 == 0).alias("pending"))
    verdicts = c.where(n % 17 != 0).select(_article().alias("article"), _pick("c_custkey", *_VERDICTS).alias("verdict"), (n * 7919 % 1000).alias("top_mass"))
    return resolution.benchmark_score(roster, verdicts, c.where(n % 7 != 0).select(_article().alias("article"), _pick("c_custkey", *_LEADS).alias("lead")), P)


@query(_SCORES + " select cat, count(*) filter (where status = 'PASS') hit, count(*) total from score where status <> 'PENDING' group by 1")
def benchmark_summary(v: Views) -> DataFrame:
    return resolution.benchmark_summary(benchmark_score(v))


@query(""", d as (select user_id % 300 topic, arg_max((event_id % 9)::int, event_id) langs, arg_max((event_id % 8)::int, event_id) eff, arg_max((event_id % 4)::int, event_id) err from events where user_id % 5 <> 0 group by 1), t as (select distinct user_id % 300 topic from events),
s as (select topic, langs, eff, least(6, eff + 1) c, eff / greatest(langs, eff + err, 1) share from t left join d using (topic))
select topic, case when langs is null then 6 when eff < 2 or share < 0.5 then 3 when share < 0.7 then least(greatest(3, c), 4) when share < 0.85 then least(greatest(3, c), 5) else least(6, greatest(3, c)) end::int cap from s""")
def adaptive_cap(v: Views) -> DataFrame:
    e = v.table("events").select((F.col("user_id") % 300).alias("topic"), F.col("event_id").alias("at"), *((F.col("event_id") % n).cast("int").alias(c) for c, n in (("langs", 9), ("effective", 8), ("errors", 4))), "user_id")
    return resolution.adaptive_cap(e.where("user_id % 5 <> 0"), e.select("topic").distinct())


_REQUIRED = ["click", "purchase", "signup", "view"]


@query(f""", w as (select user_id topic, unnest({_REQUIRED}) layer from (select distinct user_id from events)), g as (select * from w where (topic, layer) not in (select (user_id, event_type) from events group by user_id, event_type having sum(value) > 600))
select topic, string_agg(layer, ',' order by layer) missing from g group by 1""")
def coverage_gaps(v: Views) -> DataFrame:
    """A topic has a layer when its events add up to enough."""
    e = v.table("events").groupBy(F.col("user_id").alias("topic"), F.col("event_type").alias("layer")).agg(F.sum("value").alias("total"))
    return resolution.coverage_gaps(e.where("total > 600"), e.select("topic").distinct(), _REQUIRED).withColumn("missing", F.array_join("missing", ","))


@query("select coalesce(n_name, 't' || (c_nationkey + c_custkey % 2 * 100)) topic, min(c_custkey) as position from customer left join nation on n_nationkey = c_nationkey + c_custkey % 2 * 100 group by 1")
def canonicalize_topics(v: Views) -> DataFrame:
    asked = v.table("customer").select(F.concat(F.lit("t"), F.col("c_nationkey") + F.col("c_custkey") % 2 * 100).alias("topic"), F.col("c_custkey").alias("position"))
    return resolution.canonicalize_topics(asked, v.table("nation").select(F.concat(F.lit("t"), "n_nationkey").alias("requested_title"), F.col("n_name").alias("canonical_title")))


@query(""", c as (select event_type stage, 'p' || (user_id % 3) provider, 'm' || (user_id % 2) model, event_id i, event_id % 77 o from events), p as (select distinct provider, model, length(provider) * 0.5::double a, 1.5::double b from c where not (provider = 'p2' and model = 'm1')),
u as (select c.*, round_even((i * a + o * b) / 1e6, 8) usd from c left join p using (provider, model))
select stage, provider, count(*) calls, sum(i)::bigint input_tokens, sum(o)::bigint output_tokens, case when count(usd) = count(*) then round_even(sum(usd), 8) end estimated_usd, count(usd) = count(*) all_calls_priced from u group by 1, 2""")
def usage_summary(v: Views) -> DataFrame:
    name = lambda c, n: F.concat(F.lit(c), F.col("user_id") % n)
    calls = v.table("events").select(F.col("event_type").alias("stage"), name("p", 3).alias("provider"), name("m", 2).alias("model"), F.col("event_id").alias("input_tokens"), (F.col("event_id") % 77).alias("output_tokens"))
    prices = calls.select("provider", "model").distinct().where("not (provider = 'p2' and model = 'm1')").withColumns({"input_per_million": F.length("provider") * F.lit(0.5), "output_per_million": F.lit(1.5)})
    return resolution.usage_summary(calls, prices, "stage", "provider")


_BACKENDS = ("hosted", " Ingest", "", None, "other")


@query(f""", r as (select 'c' || c_custkey article, c_custkey % 3 = 0 present, coalesce(nullif(lower(trim({_pick_sql('c_custkey', *_BACKENDS)})), ''), 'hosted') backend from customer),
k as (select *, case when backend in ('hosted', 'ingest') then case when present then 'delta' when backend = 'ingest' then 'cold_start' else 'cold_start_blocked' end end kind from r)
select article, kind, coalesce(kind <> 'cold_start_blocked', false) ok, backend = 'ingest' or not present need_ingest from k""")
def corpus_plan(v: Views) -> DataFrame:
    return resolution.corpus_plan(v.table("customer").select(_article().alias("article"), (F.col("c_custkey") % 3 == 0).alias("shard_present"), _pick("c_custkey", *_BACKENDS).alias("backend")))


@query("select 'c' || c_custkey article, case when c_custkey % 3 = 0 then 'People' when c_custkey % 2 = 0 and c_mktsegment in ('BUILDING', 'MACHINERY') then c_mktsegment else 'Other' end category from customer")
def categories(v: Views) -> DataFrame:
    c = v.table("customer").withColumn("article", _article())
    return resolution.categories(c.select("article"), c.where("c_custkey % 3 = 0").select("article", F.lit("People").alias("category")), c.where("c_custkey % 2 = 0").select("article", F.col("c_mktsegment").alias("category")), ["BUILDING", "MACHINERY"])


@query("select 'c' || c_custkey article, case when c_custkey % 3 = 0 then c_name || ',' || c_mktsegment else 'c' || c_custkey end entities from customer")
def focal_entities(v: Views) -> DataFrame:
    c = v.table("customer").withColumn("article", _article())
    return resolution.focal_entities(c.select("article"), c.where("c_custkey % 3 = 0").select("article", F.array("c_name", "c_mktsegment").alias("entities"))).withColumn("entities", F.array_join("entities", ","))


# publication

@query("select article from (select article from confirmations where status in ('confirmed', 'not_confirmed') union select article from lead_episodes) where article not in (select article from confirmations where not is_fresh)")
def published_articles(v: Views) -> DataFrame:
    return publication.published_articles([v.episodes], v.confirmations, v.confirmations.where("not is_fresh"))


def _pivots(v: Views) -> DataFrame:
    return publication.top_pivot(v.episodes.select("article", F.col("candidate_start").alias("start"), "pwr_mass", (F.col("durable_spine_drop") * 100).alias("peak_pct"), "before_revid"))


_TOP = ", top as (select article, candidate_start \"start\", pwr_mass, durable_spine_drop * 100 peak_pct, before_revid from lead_episodes qualify row_number() over (partition by article order by pwr_mass desc, candidate_start) = 1)"


@query(_TOP + " select * from top")
def top_pivot(v: Views) -> DataFrame:
    return _pivots(v)


_FACTS = ("contradict", "differ", "agree", None)


@query(f""", f as (select user_id article, case when event_id % 50 = 0 then 'now' else strftime(ts, '%Y-%m') end as_of, coalesce({_pick_sql('event_id', *_FACTS)}, 'insufficient') verdict from events)
select article, verdict, count(*) n from (select * from f qualify rank() over (partition by article order by as_of = 'now' desc, as_of desc) = 1) group by 1, 2""")
def fact_counts(v: Views) -> DataFrame:
    n = F.col("event_id")
    return publication.fact_counts(v.table("events").select(F.col("user_id").alias("article"), F.when(n % 50 == 0, "now").otherwise(F.date_format("ts", "yyyy-MM")).alias("as_of"), _pick("event_id", *_FACTS).alias("verdict")))


@query(f"""select 'c' || c_custkey article, concat_ws(',', case when c_custkey % 3 <> 0 then case when c_custkey % 2 = 0 then 'rewrite:' else 'candidate:' end || case when c_custkey * 2500 >= 200000 then 'high' when c_custkey * 2500 >= 50000 then 'med' else 'low' end when c_custkey % 5 = 0 then 'rewrite:med' end,
  'wording:' || case when c_custkey % 50 >= 35 then 'large' when c_custkey % 50 >= 15 then 'clear' when c_custkey % 50 >= 8 then 'slight' end, case when c_custkey % 3 > 0 then 'facts:contradict' when c_custkey % 2 > 0 then 'facts:differ' end,
  case {_pick_sql('c_custkey', *_FRAMING)} when 'contradict' then 'framing:contradict' when 'differ' then 'framing:differ' when 'agree' then 'framing:differ' when 'absent_en' then 'framing:differ' end, case when c_custkey % 100 >= 85 then 'authors:dominate' when c_custkey % 100 >= 70 then 'authors:few' end, case when c_custkey % 7 = 0 then 'graph' end) badges from customer""")
def signal_badges(v: Views) -> DataFrame:
    n = F.col("c_custkey")
    rows = v.table("customer").select(
        _article().alias("article"), F.when(n % 3 != 0, n * 2500).alias("pwr_mass"), F.when(n % 2 == 0, "confirmed").alias("pivot_status"), (n % 5 == 0).alias("has_diff"), ((n % 50) / 100.0).alias("js_divergence"), (n % 3).alias("contradictions"), (n % 2).alias("differences"),
        F.array_compact(F.array(_pick("c_custkey", *_FRAMING))).alias("framing"), (n % 100).alias("top10_share"), (n % 7 == 0).alias("from_graph"),
    )
    return publication.signal_badges(rows).withColumn("badges", F.array_join("badges", ","))


@query(""", f as (select c_name article, c_mktsegment category, c_name || ' ' || c_mktsegment blob, round(c_acctbal)::bigint pwr, c_custkey % 10 lex from customer where c_mktsegment = 'BUILDING' and contains(lower(c_name || ' ' || c_mktsegment), '1'))
select * from (select *, row_number() over (order by lex desc, lower(article), article)::int as position from f) where position between 1 + 25 * (least(2, greatest(1, (select (count(*) + 24) // 25 from f))) - 1) and 25 * least(2, greatest(1, (select (count(*) + 24) // 25 from f)))""")
def findings_index(v: Views) -> DataFrame:
    rows = v.table("customer").select(F.col("c_name").alias("article"), F.col("c_mktsegment").alias("category"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("blob"), F.round("c_acctbal").cast("long").alias("pwr"), (F.col("c_custkey") % 10).alias("lex"))
    return publication.findings_index(rows, "1", "BUILDING", "lex", 2)


@query(""", iv as (select article, candidate_start "start", candidate_start + 90 "end", before_revid n from lead_episodes), wi as (select article, 0 kind, before_revid pos, candidate_start s, candidate_end e, case before_revid % 3 when 0 then 'confirmed' when 1 then 'rejected' end decision from lead_episodes where before_revid % 3 <> 0 or before_revid % 2 = 0
  union all select article, 1, before_revid, candidate_start, candidate_end, 'confirmed' from lead_episodes where before_revid % 5 = 0),
iv2 as (select article, "start", "end", min(n) n from iv group by 1, 2, 3),
j as (select i.article, i."start", i."end", arg_min((s, e, decision), (kind, pos)) w from iv2 i join wi on wi.article = i.article and s <= i."start" and i."end" <= e group by 1, 2, 3)
select i.article, i."start", i."end", w[1] candidate_start, w[2] candidate_end, case when n % 8 = 0 then 'excluded' when w[3] in ('confirmed', 'rejected') then w[3] when w is not null then 'candidate_pending' when n % 6 = 0 then case when n % 4 = 0 then 'anomaly_pending' else 'descriptive' end else 'measured' end state
from iv2 i left join j on j.article = i.article and j."start" = i."start" and j."end" = i."end\"""")
def interval_state(v: Views) -> DataFrame:
    n = F.col("before_revid")
    e = v.episodes.withColumn("position", n)
    iv = e.groupBy("article", F.col("candidate_start").alias("start"), F.date_add("candidate_start", 90).alias("end")).agg(F.min(n).alias("n"))
    iv = iv.select("article", "start", "end", (F.col("n") % 8 != 0).alias("eligible"), (F.col("n") % 4 == 0).alias("confirmable"), (F.col("n") % 6 == 0).alias("anomalous"))
    c = e.where((n % 3 != 0) | (n % 2 == 0)).withColumn("decision", F.when(n % 3 == 0, "confirmed").when(n % 3 == 1, "rejected"))
    return publication.interval_state(iv, c, e.where(n % 5 == 0))


_REWRITES = ("confirmed", "not_confirmed", "unavailable", None, None)
_RECORDED = ("none", None, "unavailable", "odd")


@query(f""", e as (select c_custkey n, {_pick_sql('c_custkey', *_REWRITES)} s, 'r' || c_custkey reason, case when c_custkey % 2 = 0 then 'partial' end ss, case when c_custkey % 4 = 0 then 'sr' end sr, case when c_custkey % 3 = 0 then 'SKIP' end cv, c_custkey % 7 = 0 pv, c_custkey % 11 = 0 df, {_pick_sql('(c_custkey // 5)', *_RECORDED)} rs, case when c_custkey % 2 = 0 then 'No L1 pivot found' end sp from customer)
select 'c' || n article, case when s = 'confirmed' then 'finding' when s = 'not_confirmed' then 'none' when s = 'unavailable' then s when pv or df then 'finding' when rs in ('none', 'unavailable') then rs when n % 3 <> 0 and sp is not null then 'none' else 'unavailable' end state,
case when s = 'unavailable' then case when ss = 'partial' then coalesce(sr, reason) when cv = 'SKIP' then 'too few snapshots' else reason end when s is null and not pv and not df and rs in ('none', 'unavailable') then 'rr' || n end reason from e""")
def rewrite_info(v: Views) -> DataFrame:
    n = F.col("c_custkey")
    e = v.table("customer").withColumn("k5", F.floor(n / 5)).select(
        _article().alias("article"), _pick("c_custkey", *_REWRITES).alias("status"), F.concat(F.lit("r"), n).alias("reason"), F.when(n % 2 == 0, "partial").alias("source_status"), F.when(n % 4 == 0, "sr").alias("source_reason"), F.when(n % 3 == 0, "SKIP").alias("coarse_verdict"),
        (n % 7 == 0).alias("has_pivot"), (n % 11 == 0).alias("has_diff"), _pick("k5", *_RECORDED).alias("recorded_state"), F.concat(F.lit("rr"), n).alias("recorded_reason"), (n % 3 == 0).alias("has_lexical_pivot"), F.when(n % 2 == 0, "No L1 pivot found").alias("lexical_span"),
    )
    return publication.rewrite_info(e.select("article"), e)


_NOISE = ", ".join(f"'{x}'" for x in publication.LEX_NOISE)


@query(rf""", t as (select source article, lang direction, doc_id rank, split_part(trim(text), ' ', 1) term from documents)
select *, row_number() over (partition by article, direction order by rank, term)::int as position from t where length(trim(term)) >= 3 and lower(trim(term)) not in ({_NOISE}) and not regexp_full_match(trim(term), '\d+') qualify position <= 12""")
def lex_noise_filter(v: Views) -> DataFrame:
    first = F.split_part(F.trim("text"), F.lit(" "), F.lit(1))
    return publication.lex_noise_filter(v.table("documents").select(F.col("source").alias("article"), F.col("lang").alias("direction"), F.col("doc_id").alias("rank"), first.alias("term")))


@query(""", r as (select article, 'lexical' layer, case when before_revid % 3 = 0 then '' when before_revid % 3 = 1 then 'id' || (before_revid % 5) end episode_id, case when before_revid % 7 <> 0 then candidate_start end "at", case when before_revid % 2 = 0 then before_revid end b, after_revid a from lead_episodes),
s as (select *, row_number() over (partition by article, layer order by "at" nulls last, b nulls last, a nulls last, episode_id nulls last)::int pos, coalesce(nullif(episode_id, ''), b || '-' || a) id from r)
select article, layer, case when id is null or row_number() over (partition by article, layer, id order by pos) > 1 then layer || '-event-' || pos else id end episode_id, "at", b before_revid, a after_revid, pos as position from s""")
def episode_navigator(v: Views) -> DataFrame:
    n = F.col("before_revid")
    rows = v.episodes.select("article", F.lit("lexical").alias("layer"), F.when(n % 3 == 0, "").when(n % 3 == 1, F.concat(F.lit("id"), n % 5)).alias("episode_id"), F.when(n % 7 != 0, F.col("candidate_start")).alias("at"), F.when(n % 2 == 0, n).alias("before_revid"), "after_revid")
    return publication.episode_navigator(rows)


@query("select c_custkey article, case when c_custkey % 9 <> 0 then c_custkey % 10 / 1.0::double end refined_per_rev, c_custkey % 9 <> 0 and c_custkey % 10 >= 5 contested from customer")
def mscore_panel(v: Views) -> DataFrame:
    n = F.col("c_custkey")
    return publication.mscore_panel(v.table("customer").select(n.alias("article"), F.when(n % 9 != 0, (n % 10) / F.lit(1.0)).alias("refined_per_rev")))


@query(""", e as (select source article, lang, min(doc_id) filter (where doc_id % 2 = 0)::varchar b, min(doc_id) filter (where doc_id % 2 = 1)::varchar a from documents where source < 'm' group by 1, 2)
select article, lang, 'before' side, b text from e where b is not null union all select article, lang, 'after', a from e where a is not null union all
select source, lang, 'before', doc_id::varchar from documents where lang in ('en', 'de') and source not in (select article from e)""")
def version_records(v: Views) -> DataFrame:
    d = v.table("documents").withColumn("article", F.col("source"))
    at = lambda k: F.min(F.when(F.col("doc_id") % 2 == k, F.col("doc_id"))).cast("string")
    e = d.where("source < 'm'").groupBy("article", "lang").agg(at(0).alias("before"), at(1).alias("after"))
    return publication.version_records(e, d.select("article", "lang", F.lit("before").alias("side"), F.col("doc_id").cast("string").alias("text"), F.col("lang").isin("en", "de").alias("wanted")))


# stance

_STANCE = ("critical", "neutral", "sympathetic", None, "neutral")


def _runs(v: Views) -> DataFrame:
    """Events as runs: an article's events in fours are the runs of a revision."""
    n = F.col("event_id")
    return v.table("events").select(
        F.concat(F.lit("h"), F.floor(n / 200)).alias("article"), F.floor(n / 8).alias("revision_id"), _pick("event_id", "e0", "e1").alias("entity"), (F.floor(n / 2) % 4).cast("int").alias("run"), _pick("user_id", *_STANCE).alias("stance"),
        F.when(n % 3 != 0, (n % 10) / 10.0).alias("confidence"), (n % 5 != 0).alias("has_evidence"), F.when(n % 400 != 7, "v1").otherwise("v2").alias("contract"),
    )


_RUNS = f""", ru as (select 'h' || (event_id // 200) article, event_id // 8 revision_id, 'e' || (event_id % 2) entity, event_id // 2 % 4 run, coalesce({_pick_sql('user_id', *_STANCE)}, 'absent') stance, case when event_id % 3 <> 0 then (event_id % 10) / 10.0::double end confidence, event_id % 5 <> 0 ev, case when event_id % 400 <> 7 then 'v1' else 'v2' end contract from events),
rc as (select article, revision_id, entity, stance, count(*) n, min(run) f from ru group by all),
ra as (select article, revision_id, entity, count(*) runs, round_even(count(*) filter (where ev) / count(*), 4) evidence_coverage, round_even(avg(confidence), 4) mean_confidence, array_to_string(list_sort(list(distinct contract)), ',') contracts from ru group by 1, 2, 3),
su as (select ra.*, label, round_even(m / runs, 4) agreement, label_counts from ra join (select article, revision_id, entity, arg_max(stance, (n, -f)) label, max(n) m, string_agg(stance || '=' || n, ',' order by stance) label_counts from rc group by 1, 2, 3) using (article, revision_id, entity))"""


@query(_RUNS + " select * from su")
def summarize_runs(v: Views) -> DataFrame:
    counts = F.array_join(F.transform(F.map_entries("label_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return stance.summarize_runs(_runs(v)).withColumns({"label_counts": counts, "contracts": F.array_join("contracts", ",")})


def _audits(v: Views) -> DataFrame:
    n = F.col("event_id")
    words = F.concat_ws(" ", F.lit("a passage of the page"), F.floor(n / 24).cast("string"), F.repeat(F.lit("with more "), (F.floor(n / 24) % 3).cast("int")))
    passages = v.table("events").select(F.concat(F.lit("h"), F.floor(n / 200)).alias("article"), F.floor(n / 8).alias("revision_id"), words.alias("passage"), n.alias("n"))
    first = passages.groupBy("article", "revision_id").agg(F.min_by("passage", "n").alias("passage"))
    return stance.audit_transitions(stance.summarize_runs(_runs(v)), first)


@query()
def audit_transition(v: Views) -> DataFrame:
    """The similarity of texts isn't for SQL; tests hold it against a plain version."""
    return _audits(v)


@query()
def stance_shifts(v: Views) -> DataFrame:
    return stance.stance_shifts(stance.summarize_runs(_runs(v)), _audits(v))


@query(""", s as (select article, snap_date, snap_rev, row_number() over w - 1 k, count(*) over (partition by article) n from (select distinct article, snap_date, snap_rev from rsnap where snap_date >= date '1995-07-01') window w as (partition by article order by snap_date, snap_rev))
select article, snap_date, snap_rev from s where n <= 4 or k in (0, n * 1 // 4, n * 2 // 4, n * 3 // 4)""")
def sampled_snapshots(v: Views) -> DataFrame:
    return stance.sampled_snapshots(v.rsnap.select("article", "snap_date", "snap_rev").distinct(), 4, "1995-07-01")

"""Queries of trust, freshness, faults, trajectories, pivots and exports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attribution, claims, corpus, drift, editions, pivots, snapshots
from .bindings import SMALL as P
from .bindings import Views
from .drift_queries import query
from .history_queries import DRAFTS

STATES = ["published", "legacy_incompatible", "unstable", "stale", "quarantined"]


def _artifacts(v: Views) -> DataFrame:
    """Orders as artifacts of the three kinds."""
    n = F.col("o_orderkey")
    kind = F.when(n % 3 == 0, "l1-confirmation").when(n % 3 == 1, "lexical").otherwise("stance")
    end = F.when(n % 5 == 1, 8).when(n % 5 > 1, 9).cast("long")
    revs = F.when(n % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array((n % 13 + 3).cast("long")))
    return v.table("orders").select(n.alias("artifact"), F.concat(F.lit("a"), F.pmod("o_custkey", F.lit(20))).alias("article"), kind.alias("kind"), end.alias("end_rev"), (F.floor(n / 4) % 2 == 0).alias("from_snapshots"), revs.alias("revs"))


def _trust(v: Views) -> DataFrame:
    return snapshots.artifact_trust(_artifacts(v), v.endpoints.withColumnRenamed("selected_revid", "selected_rev"), v.integrity)


_TRUST = """, arts as (select o_orderkey artifact, 'a' || (o_custkey % 20) article, o_orderkey % 3 kind, case when o_orderkey % 5 = 1 then 8 when o_orderkey % 5 > 1 then 9 end end_rev, o_orderkey // 4 % 2 = 0 fs, case when o_orderkey % 7 <> 0 then o_orderkey % 13 + 3 end rev from orders),
named as (select *, case when kind = 0 then end_rev when kind = 2 or fs then rev end seen from arts),
trust as (select artifact, n.article, case when e.article is null then 'legacy_incompatible' when e.status <> 'stable' then 'unstable' when kind = 0 and end_rev is distinct from selected_rev then 'stale' when kind = 1 and end_rev is null then 'legacy_incompatible'
  when kind = 1 and fs and end_rev <> selected_rev then 'stale' when kind = 2 and rev is null then 'legacy_incompatible' when seen is not null and i.status is null then 'legacy_incompatible' when i.status = 'quarantined' then 'quarantined' else 'published' end state
  from named n left join endpoints e on e.article = n.article left join integrity i on i.article = n.article and i.snap_rev = seen)"""


@query(_TRUST + " select * from trust")
def artifact_trust(v: Views) -> DataFrame:
    return _trust(v)


@query(_TRUST + " select state, count(artifact) n from (select unnest(['published', 'legacy_incompatible', 'unstable', 'stale', 'quarantined', 'withheld']) state) left join trust using (state) group by 1")
def trust_report(v: Views) -> DataFrame:
    return snapshots.trust_report(_trust(v), [*STATES, "withheld"])


@query(f""", l as (select article, max(snap_date) d, arg_max(snap_rev, (snap_date, snap_rev)) r from rsnap group by 1),
c as (select *, 'a' || (o_custkey % 20) article, case o_orderkey % 6 when 0 then 1 when 1 then null else 2 end version, o_orderkey % 8 = 1 ran, o_orderkey % 4 > 0 same, o_orderkey // 7 % 15 hr, o_orderkey % 10 <> 3 dated from orders)
select o_orderkey before_revid, c.article, coalesce(version = 2, not ran) and same and r is not null and hr = r and dated is_fresh from c left join l using (article)""")
def fresh(v: Views) -> DataFrame:
    """Orders as confirmations of different versions, thresholds (in both orders) and horizons."""
    n, contract = F.col("o_orderkey"), {"mag_floor": P.mag_floor, "confirm_drop": P.confirm_drop}
    drop, floor = (F.lit("confirm_drop"), F.when(n % 4 > 0, P.confirm_drop).otherwise(0.5)), (F.lit("mag_floor"), F.lit(P.mag_floor))
    now = v.rsnap.groupBy("article").agg(F.max(F.struct("snap_date", "snap_rev")).alias("s")).select("article", "s.snap_date", "s.snap_rev")
    held = v.table("orders").select(
        n.alias("before_revid"), F.concat(F.lit("a"), F.pmod("o_custkey", F.lit(20))).alias("article"), F.when(n % 6 == 0, 1).when(n % 6 != 1, 2).alias("schema_version"), F.when(n % 8 == 1, "2026-01-01").alias("run_ts"),
        F.when(n % 2 == 0, F.create_map(*drop, *floor)).otherwise(F.create_map(*floor, *drop)).alias("thresholds"), (F.floor(n / 7) % 15).cast("long").alias("horizon_rev"), (n % 10 != 3).alias("dated"),
    )
    dates = now.select("article", F.col("snap_date").alias("d"))
    held = held.join(dates, "article", "left").withColumn("horizon_date", F.when(F.col("dated"), F.col("d")).otherwise(F.date_add("d", -1))).drop("d", "dated")
    return snapshots.fresh(held, contract, now, 2).select("before_revid", "article", "is_fresh")


@query("select article, count(*) filter (where status = 'stable') n_stable, count(*) filter (where status = 'unstable') n_unstable, max(status) worst from endpoints group by 1")
def endpoint_audit(v: Views) -> DataFrame:
    return snapshots.status_audit(v.endpoints, ["stable", "unstable"])


@query(""", q as (select event_id seq, event_id // 50 g, case when g % 5 = 1 then event_id // 2 else event_id end rev_id, case when g % 5 = 2 then -event_id else event_id end ts, case when g % 5 = 3 then 2 else 1 end copies from events),
f as (select *, ts < lag(ts) over (partition by g order by seq) back from q)
select 'h' || g article, case when count(*) < 2 then 'fewer than two revisions' when count(distinct rev_id) < count(*) then 'repeated revision id' when bool_or(coalesce(back, false)) then 'times out of order' when max(copies) > 1 then 'repeated token' end fault from f group by g having fault is not null""")
def sequence_faults(v: Views) -> DataFrame:
    n, g = F.col("event_id"), F.floor(F.col("event_id") / 50)
    rows = v.table("events").select(F.concat(F.lit("h"), g).alias("article"), n.alias("seq"), F.when(g % 5 == 1, F.floor(n / 2)).otherwise(n).alias("rev_id"), F.when(g % 5 == 2, -n).otherwise(n).alias("ts"), F.when(g % 5 == 3, F.array(n, n)).otherwise(F.array(n)).alias("tokens"))
    return attribution.sequence_faults(rows.drop("tokens"), rows.select("article", "seq", F.explode("tokens").alias("token_id")))


_PASSES = f""", judged as (select *, case when durable_spine_drop >= {P.confirm_drop} then 'confirmed' else 'rejected' end decision, case when durable_spine_drop < {P.confirm_drop} then 'durable_spine_drop_below_threshold' end rejection_reason, candidate_start < date '1996-06-01' prim from lead_episodes)"""


@query(_PASSES + """ select article, before_revid, round_even(durable_spine_drop, 6) "drop", decision, rejection_reason, case when prim then 'interval' else 'rolling' end source from judged
  where prim or article not in (select article from judged where prim and decision = 'confirmed')""")
def two_pass(v: Views) -> DataFrame:
    """Earlier episodes as the first pass, later ones as the second."""
    rows = v.episodes.select("article", "before_revid", "candidate_start", F.col("durable_spine_drop").alias("drop"))
    rows, early = drift.candidate_evaluation(rows, P), F.col("candidate_start") < F.lit("1996-06-01").cast("date")
    return drift.two_pass(rows.where(early), rows.where(~early)).drop("candidate_start")


@query(""", n as (select article, ts, rev_id, row_number() over (partition by article order by rev_id) - 1 k, count(*) over (partition by article) n from revisions)
select article, rev_id from n where n <= 12 or k = n - 1 or list_contains(list_transform(range(12), lambda i: floor(i * (n / 12.0::double))::bigint), k)""")
def evenly_sampled(v: Views) -> DataFrame:
    return editions.evenly_sampled(v.revisions, "rev_id", 12).select("article", "rev_id")


_USABLE = """, ok as (select article, snap_date, snap_rev from integrity where status <> 'quarantined'),
l as (select article, max(snap_date) snap_date, arg_max(snap_rev, (snap_date, snap_rev)) snap_rev from rsnap group by 1),
ends as (select l.article, case when e.status is null then l.snap_rev when e.status = 'stable' then selected_rev end er, case when e.status is null then l.snap_date when e.status = 'stable' then selected_date end ed from l left join endpoints e using (article)),
modes as (select * from (values ('formative', date '0001-01-01', date '9999-01-01'), ('interval', date '1995-07-01', date '1997-02-01')) t(mode, d0, d1)),
facts as (select mode, article, er, exists(select 1 from ok where ok.article = ends.article and ok.snap_rev = er) usable, (select count(*) from ok where ok.article = ends.article and (snap_date, snap_rev) <= (ed, er) and snap_date between d0 and d1) n, ed, d0, d1 from ends, modes),
why as (select *, case when er is null then 'endpoint_unstable' when not usable then 'endpoint_unusable' when n < 2 then 'too_few_revisions' end reason from facts)"""


@query(_USABLE + """ select mode, w.article, reason, snap_date, snap_rev from why w left join ok on reason is null and ok.article = w.article and (snap_date, snap_rev) <= (ed, er) and snap_date between d0 and d1""")
def trajectory_selection(v: Views) -> DataFrame:
    usable, ends = v.integrity.where("status <> 'quarantined'"), corpus.latest_snapshot(v.rsnap, v.endpoints)
    long = pivots.trajectory_selection(usable, ends).withColumn("mode", F.lit("formative"))
    return long.unionByName(pivots.trajectory_selection(usable, ends, "interval", "1995-07-01", "1997-02-01").withColumn("mode", F.lit("interval")))


@query(""", nm as (select 'c' || o_custkey article, o_orderkey place, case when o_custkey % 13 = 0 then o_custkey else o_orderkey end rev_id, o_orderstatus st from orders),
wy as (select article, case when count(*) < 2 then 'too_few_revisions' when count(distinct rev_id) < count(*) then 'repeated_revision' when count(*) filter (where st = 'P') > 0 then 'revision_unavailable:' || arg_min(rev_id, place) filter (where st = 'P') end reason from nm group by 1)
select article, reason, place, rev_id from wy join nm using (article) where reason is null union all select article, reason, null, null from wy where reason is not null""")
def exact_selection(v: Views) -> DataFrame:
    """A customer's orders as named revisions; those in process have no text, and some customers name one revision again and again."""
    rev = F.when(F.col("o_custkey") % 13 == 0, F.col("o_custkey")).otherwise(F.col("o_orderkey"))
    named = v.table("orders").select(F.concat(F.lit("c"), "o_custkey").alias("article"), F.col("o_orderkey").alias("place"), rev.alias("rev_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("text"))
    return pivots.exact_selection(named, named.where("text is not null"))


@query("""select item, substr(site, 1, length(site) - 4) lang, title from (select s_suppkey item, n_name title, 'l' || s_nationkey || case s_suppkey % 4 when 0 then 'wiki' when 1 then 'wiki' when 2 then 'wikiquote' else '' end site from supplier join nation on n_nationkey = s_nationkey
  union all select s_suppkey, s_name, 'commonswiki' from supplier) where site like '%wiki' and site not like 'commons%'""")
def edition_map(v: Views) -> DataFrame:
    """Suppliers as items with one edition of their nation, and a sister project."""
    n = F.col("s_suppkey") % 4
    names = v.table("supplier").join(v.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("title")), "s_nationkey")
    kind = F.when(n < 2, "wiki").when(n == 2, "wikiquote").otherwise("")
    rows = names.select(F.col("s_suppkey").alias("item"), F.concat(F.lit("l"), "s_nationkey", kind).alias("site"), "title")
    return pivots.edition_map(rows.union(v.table("supplier").select("s_suppkey", F.lit("commonswiki"), "s_name")))


def _episodes(v: Views) -> DataFrame:
    age = F.round(F.datediff(F.lit("1999-01-01").cast("date"), "candidate_start") / F.lit(365.25), 1)
    return v.episodes.select("article", F.col("candidate_start").alias("start"), age.alias("age_years"), F.struct(-F.col("pwr_mass"), F.col("before_revid")).alias("rank"))


def _confirmed(v: Views) -> DataFrame:
    """Confirmations with the start of the heaviest episode."""
    top = v.episodes.groupBy("article").agg(F.min_by("candidate_start", F.struct(-F.col("pwr_mass"), F.col("before_revid"))).alias("start"))
    return v.confirmations.join(top, "article", "left")


_RECENT = """, tops as (select article, arg_min(candidate_start, (-pwr_mass, before_revid)) top, arg_min(candidate_start, (round(date_diff('day', candidate_start, date '1999-01-01') / 365.25::double, 1), -pwr_mass, before_revid)) recent from lead_episodes group by 1)"""


@query(_RECENT + """ select article, case when is_fresh and status = 'confirmed' then top when is_fresh then null else coalesce(recent, date '2023-10-01') end AS "pivot",
  case when is_fresh and status = 'confirmed' then 'confirmed' when is_fresh then 'rejected' when recent is not null then 'candidate' else 'fallback' end source from confirmations left join tops using (article)""")
def pivot_choice(v: Views) -> DataFrame:
    return pivots.pivot_choice(v.confirmations, _confirmed(v), _episodes(v), "2023-10-01")


@query(_RECENT + " select article, coalesce((recent - interval 2 year)::date, date '2022-07-01') before, case when recent is null then 'fallback' else 'pivot' end source from confirmations left join tops using (article)")
def before_date(v: Views) -> DataFrame:
    return pivots.before_date(v.confirmations, _episodes(v), "2022-07-01")


def _materialized(v: Views) -> DataFrame:
    """Episodes with texts of their customers' orders; the after revision's is that of the order itself, if it is done."""
    owner = F.concat(F.lit("c"), "o_custkey").alias("article")
    own = v.table("orders").select(owner, F.col("o_orderkey").alias("rev_id"), F.col("o_orderpriority").alias("text"))
    later = v.table("orders").where("o_orderstatus = 'F'").select(owner, (F.col("o_orderkey") + 1).alias("rev_id"), F.col("o_orderpriority").alias("text"))
    pairs = v.episodes.select("article", F.col("before_revid").alias("before_rev"), F.col("after_revid").alias("after_rev"))
    return pivots.materialized_pivots(pairs, own.union(later).dropDuplicates(["article", "rev_id"]))


_READY = """, rv as (select 'c' || o_custkey article, o_orderkey rev_id from orders union select 'c' || o_custkey, o_orderkey + 1 from orders where o_orderstatus = 'F'),
pv as (select article, before_revid before_rev, after_revid after_rev, (article, after_revid) in (select (article, rev_id) from rv) available from lead_episodes)"""


def _draft_pivots(v: Views) -> DataFrame:
    """Documents as articles, their drafts as revisions: those of even number have evaluated candidates, the others exact pairs, and every third isn't confirmed.

    The last pair of each names a draft that doesn't exist.
    """
    docs = v.table("documents")
    n, name = F.col("doc_id"), F.concat(F.lit("d"), F.col("doc_id")).alias("article")
    rows = docs.select(name, n.alias("n"), F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 2, 3, 4)))).alias("place"))
    drop, day = (F.col("n") % 10) / 8.0, F.date_add(F.lit("2010-01-01").cast("date"), F.col("place").cast("int"))
    even = rows.where("n % 2 = 0").select("article", "place", day.alias("candidate_start"), F.date_add(day, 9).alias("candidate_end"), F.col("place").alias("candidate_before_revid"), (F.col("place") + 1).alias("candidate_after_revid"),
        (F.col("n") % 100 * 1.0).alias("peak_pct"), F.col("n").alias("pwr_mass"), F.when(F.col("n") % 4 == 0, F.when(drop >= 0.5, "confirmed").otherwise("rejected")).alias("decision"), F.when(drop < 0.5, "small").alias("rejection_reason"), drop.alias("durable_spine_drop"))
    odd = rows.where("n % 2 = 1").select("article", "place", F.col("place").alias("before_revid"), (F.col("place") + 1).alias("after_revid"), day.cast("timestamp").alias("before_ts"), F.date_add(day, 9).cast("timestamp").alias("after_ts"),
        drop.alias("durable_spine_drop"), F.col("n").alias("pwr_mass"), F.col("place").alias("duration_seconds"))
    status = docs.select(name, F.when(n % 3 == 0, "not_confirmed").otherwise("confirmed").alias("status"))
    return pivots.pivot_pairs(status, pivots.exact_pairs(odd), pivots.candidate_pairs(even))


def draft_authors(v: Views, drafts: DataFrame | None = None) -> DataFrame:
    """Each draft's words, of authors by their place."""
    rows = (v.drafts if drafts is None else drafts).select("article", "rev_id", F.posexplode(F.split("text", " ")).alias("pos", "str"))
    tokens = rows.withColumn("author", F.concat(F.lit("u"), F.pmod(F.floor(F.col("pos") / 7) + F.col("rev_id"), F.lit(5))))
    return claims.word_authors(tokens, ("article", "rev_id"))


_DRAFT_PIVOTS = f""", {DRAFTS}, dp as (select 'd' || doc_id article, doc_id n, unnest([1, 2, 3, 4])::bigint place from documents),
wt0 as (select article, rev_id, string_split(text, ' ') ws from drafts), wt1 as (select article, rev_id, unnest(ws) str, unnest(range(len(ws))) pos from wt0),
wa as (select article, rev_id, word, arg_min(author, (-c, p)) author from (select article, rev_id, lower(str) word, 'u' || ((pos // 7 + rev_id) % 5) author, count(*) c, min(pos) p from wt1 where regexp_full_match(str, '\\p{{L}}{{3,}}') group by all) group by 1, 2, 3),
maps as (select article, rev_id, sha256(string_agg(word || '=' || author, ',' order by word)) own from wa group by 1, 2),
shown as (select article, n, place, place before_rev, place + 1 after_rev from dp where n % 2 = 0 or n % 3 <> 0)"""


@query(_DRAFT_PIVOTS + """ select s.article, place, before_rev, after_rev, (date '2010-01-01' + place::int)::date "start", (date '2010-01-01' + place::int + 9)::date "end", case when n % 2 = 0 then n % 100 * 1.0 else round_even(100 * (n % 10 / 8.0::double), 2) end::double peak_pct, n pwr_mass,
  case when n % 2 = 1 or n % 4 = 0 and n % 10 >= 4 then 'confirmed' else 'rejected' end status, case when n % 2 = 0 then 'persistence_weighted_loss' else 'exact_durable_spine_drop' end metric, case when n % 2 = 1 then null when n % 4 = 0 and n % 10 >= 4 then 'confirmed' else 'rejected' end decision,
  case when n % 2 = 0 and n % 10 < 4 then 'small' end rejection_reason, n % 10 / 8.0::double durable_spine_drop, case when n % 2 = 1 then place end duration_seconds, coalesce(b.text, '') <> '' and coalesce(a.text, '') <> '' available, sha256(b.text) before_sha256, sha256(a.text) after_sha256,
  coalesce(x.own, sha256('')) before_authors, coalesce(y.own, sha256('')) after_authors
  from shown s left join drafts b on b.article = s.article and b.rev_id = before_rev left join drafts a on a.article = s.article and a.rev_id = after_rev
  left join maps x on x.article = s.article and x.rev_id = before_rev left join maps y on y.article = s.article and y.rev_id = after_rev""")
def materialized_pivots(v: Views) -> DataFrame:
    """Pivots of drafts with digests of both texts and of who wrote their words."""
    parts = v.text_parts()
    drafts = v.drafts_in(parts)
    rows = pivots.materialized_pivots(_draft_pivots(v), drafts, draft_authors(v, drafts), parts)
    told = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), 256)
    return rows.select(*pivots.PIVOT, "available", F.sha2("before_text", 256).alias("before_sha256"), F.sha2("after_text", 256).alias("after_sha256"), told("authors_before").alias("before_authors"), told("authors_after").alias("after_authors"))


@query(_DRAFT_PIVOTS + """ select s.article, list_filter(list(case when coalesce(b.text, '') = '' or coalesce(a.text, '') = '' then before_rev || '→' || after_rev end order by place), lambda x: x is not null) pairs
  from shown s left join drafts b on b.article = s.article and b.rev_id = before_rev left join drafts a on a.article = s.article and a.rev_id = after_rev group by 1""")
def unavailable_pairs(v: Views) -> DataFrame:
    parts = v.text_parts()
    return pivots.unavailable_pairs(pivots.materialized_pivots(_draft_pivots(v), v.drafts_in(parts), parts=parts))


@query(_READY + """, fx as (select article, count(*) n, count(*) filter (where available) ready, string_agg(before_rev || '→' || after_rev, ', ' order by before_rev || '→' || after_rev) filter (where not available) missing from pv group by 1)
select article, case when article[2:]::int % 13 = 0 or article[2:]::int % 17 = 0 or not is_fresh then 'unavailable' when n is null and status <> 'confirmed' then 'none' when coalesce(ready, 0) = 0 then 'unavailable' else 'finding' end state,
  case when article[2:]::int % 13 = 0 then 'receipt_missing' when article[2:]::int % 17 = 0 then 'withheld: stale' when not is_fresh then 'confirmation_stale' when n is null and status <> 'confirmed' then status
  when coalesce(ready, 0) = 0 then 'pairs_unavailable: ' || coalesce(missing, 'none') else 'redlines_available' end reason from confirmations left join fx using (article)""")
def export_state(v: Views) -> DataFrame:
    n = F.expr("cast(substring(article, 2) as int)")
    held = v.confirmations.withColumns({"trust": F.when(n % 13 == 0, None).when(n % 17 == 0, "stale").otherwise("published"), "reason": F.lit(None).cast("string")})
    return pivots.export_state(held, _materialized(v))


@query("""select 'c' || o_custkey article, o_orderkey place, array_to_string(langs[:5], ' ') editions from (select o_orderkey, o_custkey, list('l' || l_linenumber order by l_linenumber) langs from orders join lineitem on l_orderkey = o_orderkey group by 1, 2)
  qualify row_number() over (partition by o_custkey order by o_orderkey) <= 6""")
def bound_comparison(v: Views) -> DataFrame:
    """Orders as divergences, their lines as the editions that differ."""
    langs = v.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("l"), "l_linenumber"))).alias("editions_differ"))
    rows = v.table("orders").join(langs, F.col("o_orderkey") == F.col("l_orderkey"))
    found = editions.bound_comparison(rows.select(F.concat(F.lit("c"), "o_custkey").alias("article"), F.col("o_orderkey").alias("place"), "editions_differ"))
    return found.select("article", "place", F.array_join("editions_differ", " ").alias("editions"))

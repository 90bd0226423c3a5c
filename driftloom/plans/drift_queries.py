"""Queries of corpus reads, snapshots, drift, attribution and pre-ranking, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import settled
from ..operators import attribution as at
from ..operators import corpus, drift, prerank, snapshots
from ..operators.membership import membership
from .bindings import SMALL, Views, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
P = SMALL


def query(body: str | None = None) -> Callable:
    """Register a function of Views under its name; body: its SQL after the views."""

    def put(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if body is not None:
            SQL[f.__name__] = sql(body)
        return f

    return put


@query("select article, count(*) n_rows, sum(token_id)::bigint tokens from rsnap where (article, snap_rev) not in (select (article, snap_rev) from integrity where status = 'quarantined') group by 1")
def usable_snapshots(v: Views) -> DataFrame:
    return corpus.usable_snapshots(v.rsnap, v.integrity).groupBy("article").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("token_id").alias("tokens"))


@query("select article, snap_date, snap_rev, k from snaps")
def snapshots_distinct(v: Views) -> DataFrame:
    return corpus.snapshots_distinct(v.rsnap)


@query("select article, k, token_id, w, prev_k, next_k from member")
def membership_rows(v: Views) -> DataFrame:
    return membership(v.rsnap)


@query(""", l as (select article, max(snap_date) snap_date, arg_max(snap_rev, (snap_date, snap_rev)) snap_rev from rsnap group by 1)
select article, case when e.status is null then l.snap_date when e.status = 'stable' then selected_date end snap_date,
  case when e.status is null then l.snap_rev when e.status = 'stable' then selected_rev end snap_rev from l left join endpoints e using (article)""")
def latest_snapshot(v: Views) -> DataFrame:
    return corpus.latest_snapshot(v.rsnap, v.endpoints)


@query(""", t as (select distinct article, unnest([date '1995-03-01', date '1998-10-20', date '2030-01-01', date '1990-01-01']) as_of from rsnap)
select t.article, as_of, max(snap_date) snap_date, arg_max(snap_rev, (snap_date, snap_rev)) snap_rev from t left join snaps s on s.article = t.article and snap_date <= as_of group by 1, 2""")
def snapshot_as_of(v: Views) -> DataFrame:
    days = F.explode(F.array(*(F.lit(d).cast("date") for d in ("1995-03-01", "1998-10-20", "2030-01-01", "1990-01-01"))))
    return corpus.snapshot_as_of(v.rsnap, v.rsnap.select("article").distinct().select("article", days.alias("as_of")))


@query("select article, count(distinct snap_rev) snapshots from rsnap group by 1 having count(distinct snap_rev) >= 10")
def articles_with_snapshots(v: Views) -> DataFrame:
    return corpus.articles_with_snapshots(v.rsnap, 10)


@query('select article, rev_id, ts, size, "user" from revisions join rev_size using (article, rev_id)')
def size_series(v: Views) -> DataFrame:
    return corpus.size_series(v.revisions, v.rev_size)


@query('select article, count(*) revisions, min(ts) first_ts, max(ts) last_ts, count(distinct "user") editors from revisions group by 1')
def revision_stats(v: Views) -> DataFrame:
    return corpus.revision_stats(v.revisions)


def _windows(v: Views) -> DataFrame:
    return v.revisions.select("article").distinct().select("article", F.explode(F.array(*(F.struct(F.lit(f"{y}-01-01").cast("timestamp").alias("start_ts"), F.lit(f"{y}-07-01").cast("timestamp").alias("end_ts")) for y in (1996, 1998)))).alias("w")).select("article", "w.*")


_WINDOWS = ", wins as (select distinct article, make_timestamp(y, 1, 1, 0, 0, 0) start_ts, make_timestamp(y, 7, 1, 0, 0, 0) end_ts from revisions, (select unnest([1996, 1998]) y))"


@query(_WINDOWS + ' select article, start_ts, end_ts, rev_id, ts, "user" from wins join revisions using (article) where ts > start_ts and ts <= end_ts')
def revisions_between(v: Views) -> DataFrame:
    return corpus.revisions_between(v.revisions, _windows(v)).select("article", "start_ts", "end_ts", "rev_id", "ts", "user")


def _metadata(v: Views) -> DataFrame:
    o = v.table("orders")
    return o.select(
        F.concat(F.lit("a"), F.pmod("o_custkey", F.lit(20))).alias("article"), F.col("o_orderkey").alias("rev_id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") - 1).alias("parent_id"),
        F.md5(F.pmod("o_custkey", F.lit(200)).cast("string")).alias("sha1"), F.concat(F.lit("/* "), "o_orderpriority", F.lit(" */ edit")).alias("comment"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.lit("mw-undo"), F.lit("minor"))).when(F.col("o_orderstatus") == "P", F.array(F.lit("mw-rollback"))).alias("tags"),
        (F.col("o_orderstatus") == "O").alias("minor"), (F.pmod("o_orderkey", F.lit(11)) == 0).alias("user_hidden"),
    )


_METADATA = """, metadata as (select 'a' || (o_custkey % 20) article, o_orderkey rev_id, o_orderdate ts, o_orderkey - 1 parent_id, md5((o_custkey % 200)::varchar) sha1, '/* ' || o_orderpriority || ' */ edit' "comment",
  case o_orderstatus when 'F' then ['mw-undo', 'minor'] when 'P' then ['mw-rollback'] end tags, o_orderstatus = 'O' minor, o_orderkey % 11 = 0 user_hidden from orders)"""


@query(_WINDOWS + _METADATA + """ select r.article, r.rev_id, parent_id, sha1, array_to_string(list_sort(coalesce(tags, [])), ',') tags, minor, size,
  case when coalesce(user_hidden, false) then 'hidden' else "user" end account, case when coalesce(user_hidden, false) then 'hidden' else 'registered' end account_type, regexp_extract("comment", '/\\*\\s*(.*?)\\s*\\*/', 1) section
  from wins join revisions r using (article) left join metadata m on m.article = r.article and m.rev_id = r.rev_id and not contains(m."comment", 'SPECIFIED') left join rev_size s on s.article = r.article and s.rev_id = r.rev_id where r.ts between start_ts and end_ts""")
def revision_evidence_between(v: Views) -> DataFrame:
    """Revisions of one priority have no metadata."""
    rows = corpus.revision_evidence_between(v.revisions, _windows(v), _metadata(v).where(~F.contains("comment", F.lit("SPECIFIED"))), v.rev_size)
    return rows.select("article", "rev_id", "parent_id", "sha1", F.array_join("tags", ",").alias("tags"), "minor", "size", "account", "account_type", at.section_of(F.col("comment")).alias("section"))


@query(_METADATA + """, s as (select *, lag(rev_id) over (partition by article, sha1 order by ts, rev_id) restores_rev from metadata),
u as (select article, rev_id, restores_rev, list_concat(list_sort(list_intersect(coalesce(tags, []), ['mw-manual-revert', 'mw-reverted', 'mw-rollback', 'mw-undo'])), case when restores_rev is not null then ['sha1_restoration'] else [] end) g from s)
select article, rev_id, array_to_string(g, ',') signals, restores_rev from u where len(g) > 0""")
def revert_relationships(v: Views) -> DataFrame:
    return at.revert_relationships(_metadata(v))


@query(r"""select distinct account, case when account = 'hidden' then 'hidden' when regexp_full_match(account, '10\.0\.0\.[0-9]+') then 'anonymous_ip' when lower(account) like '%bot' then 'bot' else 'registered' end account_type
  from (select case when editor = '<hidden>' then 'hidden' else editor end account from event_editors)""")
def account_types(v: Views) -> DataFrame:
    """Accounts of all event editors."""
    accounts = v.event_editors.select(F.when(F.col("editor") == "<hidden>", "hidden").otherwise(F.col("editor")).alias("account")).distinct()
    return accounts.withColumn("account_type", corpus.account_type(F.col("account")))


def _targets(v: Views) -> DataFrame:
    return v.revisions.select("article").distinct().select("article", F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2002-01-01").cast("date"), F.expr("interval 6 months"))).alias("at_day")).select("article", F.col("at_day").cast("timestamp").alias("at_ts"))


_TARGETS = ", targets as (select distinct article, unnest(generate_series(timestamp '1995-01-01', timestamp '2002-01-01', interval 6 month)) at_ts from revisions)"


@query(_TARGETS + """ select t.article, at_ts, arg_max(rev_id, (ts, rev_id)) rev_id, max(ts) rev_ts from targets t left join revisions r on r.article = t.article and ts <= at_ts group by 1, 2""")
def text_asof(v: Views) -> DataFrame:
    return corpus.revision_as_of(v.revisions, _targets(v))


@query(_TARGETS + """ select t.article, at_ts, arg_min(rev_id, (ts, rev_id)) rev_id, min(ts) rev_ts from targets t left join revisions r on r.article = t.article and ts >= at_ts group by 1, 2""")
def text_asof_after(v: Views) -> DataFrame:
    return corpus.revision_as_of(v.revisions, _targets(v), after=True)


@query("""select requested_title, canonical, resolved_at from (select source requested_title, lang canonical, doc_id resolved_at, row_number() over (partition by source order by doc_id desc) n from documents) where n = 1""")
def article_identity(v: Views) -> DataFrame:
    rows = v.table("documents").select(F.col("source").alias("requested_title"), F.col("lang").alias("canonical"), F.col("doc_id").alias("resolved_at"))
    return corpus.keep_latest(rows, ["requested_title"], "resolved_at")


@query(""", o as (select c_custkey key, c_name name, c_acctbal bal from customer where c_custkey % 3 <> 0), n as (select c_custkey key, case when c_custkey % 2 = 0 then upper(c_name) end name, -c_acctbal bal from customer where c_custkey % 3 <> 1)
select coalesce(n.key, o.key) key, coalesce(n.name, o.name) name, coalesce(n.bal, o.bal) bal from o full join n on o.key = n.key""")
def source_state_merge(v: Views) -> DataFrame:
    c = v.table("customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    new = c.where("key % 3 <> 1").select("key", F.when(F.col("key") % 2 == 0, F.upper("name")).alias("name"), (-F.col("bal")).alias("bal"))
    return corpus.merged_state(c.where("key % 3 <> 0"), new, "key")


_PICKS = """, span as (select article, year(min(ts)) y0, year(max(ts)) y1, count(*) n from revisions group by 1),
picks0 as (select article, unnest(generate_series(y0, y1)) y, case when n <= 8000 then [1, 7] else [1] end ms from span),
dates as (select article, make_date(y::int, m::int, 1) pick_date from (select article, y, unnest(ms) m from picks0)),
sized as (select article, rev_id, ts, size from revisions join rev_size using (article, rev_id)),
near as (select d.article, pick_date, rev_id, ts, size, abs(date_diff('day', ts, pick_date::timestamp)) gap, median(size) over (partition by d.article, pick_date) med from dates d join sized s on s.article = d.article and abs(date_diff('day', ts, pick_date::timestamp)) <= 21),
inwin as (select article, pick_date, rev_id from near qualify row_number() over (partition by article, pick_date order by not (med = 0 or abs(size - med) <= 0.25*med), gap, ts, rev_id) = 1),
late as (select d.article, d.pick_date, arg_max(r.rev_id, (r.ts, r.rev_id)) rev_id from dates d join revisions r on r.article = d.article and r.ts::date <= pick_date where (d.article, d.pick_date) not in (select (article, pick_date) from inwin) group by 1, 2),
found as (select *, 'window' how from inwin union all select *, 'as_of' from late)"""


@query(_PICKS + " select article, pick_date, rev_id, how from found")
def persistent_rev(v: Views) -> DataFrame:
    return snapshots.persistent_rev(v.revisions, v.rev_size, snapshots.pick_dates(v.revisions))


@query(_PICKS + " select article, pick_date, rev_id from (select *, lag(rev_id) over (partition by article order by pick_date) l from found) where rev_id is distinct from l")
def snapshot_picks(v: Views) -> DataFrame:
    return snapshots.snapshot_picks(v.revisions, v.rev_size)


_RECEIPTS = """, doubled as (select * from rsnap union all select * from rsnap where snap_rev = 5 and token_id % 100 = 0), bytes as (select article, rev_id snap_rev, max(size) revision_bytes from rev_size group by 1, 2),
own as (select article, snap_date, snap_rev, count(*) token_rows, count(distinct token_id) unique_tokens from doubled group by 1, 2, 3),
r as (select *, coalesce(revision_bytes, 0) b from own left join bytes using (article, snap_rev)),
q as (select article, snap_date, snap_rev, token_rows, unique_tokens, revision_bytes, 1 - unique_tokens/token_rows duplicate_rate, token_rows/nullif(lag(token_rows) over o, 0) previous_token_ratio, token_rows/nullif(lead(token_rows) over o, 0) next_token_ratio,
  b/nullif(lag(b) over o, 0) previous_byte_ratio, b/nullif(lead(b) over o, 0) next_byte_ratio from r window o as (partition by article order by snap_date, snap_rev)),
receipts as (select *, case when unique_tokens <> token_rows then 'quarantined' when previous_token_ratio < 0.5 and next_token_ratio < 0.5 and previous_byte_ratio >= 0.8 and next_byte_ratio >= 0.8 then 'suspect' else 'complete' end status from q)"""


def _receipts(v: Views) -> DataFrame:
    twice = v.rsnap.unionByName(v.rsnap.where("snap_rev = 5 and token_id % 100 = 0"))
    return snapshots.snapshot_integrity(twice, v.rev_size)


@query(_RECEIPTS + " select * from receipts")
def snapshot_integrity(v: Views) -> DataFrame:
    return _receipts(v)


@query(_RECEIPTS + """ select article, count(*) filter (where status = 'complete') n_complete, count(*) filter (where status = 'suspect') n_suspect, count(*) filter (where status = 'quarantined') n_quarantined,
  ['complete', 'suspect', 'quarantined'][max(list_position(['complete', 'suspect', 'quarantined'], status))] worst from receipts group by 1""")
def integrity_audit(v: Views) -> DataFrame:
    return snapshots.status_audit(_receipts(v), ["complete", "suspect", "quarantined"])


@query(""", s as (select article, snap_date, snap_rev, case when snap_rev = 14 then null when snap_rev = 13 then 'soon' else strftime(snap_date, '%Y-%m-%d') || ' 00:00:00' end ts from snaps),
a as (select *, epoch(timestamp '2001-01-02') - epoch(try_cast(ts as timestamp)) age from s),
w as (select article, snap_date, snap_rev, age::bigint age, case when ts is null then 'missing_revision_timestamp' when age is null then 'invalid_revision_timestamp' when age < 172800 then 'minimum_survival_not_met' end reason from a),
b as (select article, arg_max(snap_rev, (snap_date, snap_rev)) filter (where reason is null) rev, max(snap_date) filter (where reason is null) best_day, arg_max(age, (snap_date, snap_rev)) filter (where reason is null) age from w group by 1)
select w.article, case when any_value(b.rev) is null then 'unstable' else 'stable' end status, any_value(b.rev) selected_rev, any_value(b.best_day) selected_date, any_value(b.age) survival_seconds,
  coalesce(string_agg(case when b.rev is null or (w.snap_date, w.snap_rev) > (b.best_day, b.rev) then w.snap_rev || ':' || reason end, ',' order by w.snap_rev || ':' || reason), '') excluded from w join b using (article) group by 1""")
def stable_endpoint(v: Views) -> DataFrame:
    ts = F.when(F.col("snap_rev") == 14, F.lit(None)).when(F.col("snap_rev") == 13, "soon").otherwise(F.concat(F.col("snap_date").cast("string"), F.lit(" 00:00:00")))
    rows = v.rsnap.select("article", "snap_date", "snap_rev").distinct().withColumn("ts", ts)
    return snapshots.stable_endpoint(rows, F.lit("2001-01-02").cast("timestamp"))


_COVERAGE = """, expected as (select article, snap_date, snap_rev from snaps), loaded as (select * from expected where (snap_rev + substr(article, 2)::int) % 4 <> 0), missing as (select * from expected where (article, snap_rev) not in (select (article, snap_rev) from loaded)),
pairs as (select article, snap_date start_date, snap_rev start_rev, lead(snap_date) over o end_date, lead(snap_rev) over o end_rev from loaded window o as (partition by article order by snap_date, snap_rev))"""


def _coverage(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    expected = v.rsnap.select("article", "snap_date", "snap_rev").distinct()
    return drift.coverage_plan(expected, expected.where("(snap_rev + cast(substring(article, 2) as int)) % 4 <> 0"))


@query(_COVERAGE + " select article, snap_rev, snap_date from missing")
def coverage_missing(v: Views) -> DataFrame:
    return _coverage(v)[0].select("article", "snap_rev", "snap_date")


@query(_COVERAGE + " select p.* from pairs p where end_rev is not null and exists (select 1 from missing m where m.article = p.article and start_date < m.snap_date and m.snap_date < end_date)")
def coverage_plan(v: Views) -> DataFrame:
    return _coverage(v)[1]


@query(_COVERAGE + """ select article, bool_and(ok) endpoints_complete from (select e.article, unnest([arg_min(snap_rev, (snap_date, snap_rev)), arg_max(snap_rev, (snap_date, snap_rev))]) r from expected e group by 1) x,
  lateral (select (x.article, x.r) in (select (article, snap_rev) from loaded) ok) group by 1""")
def coverage_endpoints(v: Views) -> DataFrame:
    return _coverage(v)[2]


_PROFILE = f""", sums as (select article, k, count(*) size, sum(w)::bigint weight, coalesce(sum(w) filter (where next_k is null or next_k > k + 1), 0)::bigint leaving, coalesce(sum(w) filter (where prev_k is null or prev_k < k - 1), 0)::bigint coming from member group by 1, 2),
iv0 as (select s.article, s.k, snap_date start_date, snap_rev start_rev, lead(snap_date) over o end_date, lead(snap_rev) over o end_rev, size, weight start_weight, leaving pwr_removed, lead(coming) over o pwr_added from sums s join snaps n using (article, k) window o as (partition by s.article order by s.k)),
iv1 as (select *, start_weight - pwr_removed pwr_kept, least(pwr_removed, pwr_added) pwr_replaced from iv0 where end_rev is not null),
iv2 as (select *, 100.0::double*pwr_removed/start_weight loss_pct, 100.0::double*pwr_added/start_weight gain_pct, 100.0::double*pwr_kept/start_weight retained_pct, 100.0::double*pwr_replaced/start_weight replacement_pct, size >= {P.min_mature} confirmable from iv1),
iv as (select *, concat_ws(',', case when loss_pct >= {P.elevated} then 'loss' end, case when gain_pct >= {P.gain_floor} then 'gain' end, case when replacement_pct >= {P.replacement_floor} then 'replacement' end) anomaly_types,
  case when greatest(pwr_removed, pwr_added, pwr_replaced) >= {P.mass_floor} or greatest(loss_pct, gain_pct, replacement_pct) >= {P.extreme_change} then 'high' when greatest(pwr_removed, pwr_added, pwr_replaced) >= {P.review_mass_floor} then 'review' else 'low' end priority, true eligible from iv2)"""


@query(_PROFILE + " select * from iv")
def interval_profile(v: Views) -> DataFrame:
    return drift.interval_profile(v.rsnap, P)


@query(_PROFILE + """ select article, count(*) filter (where confirmable) intervals, avg(loss_pct) filter (where confirmable) mean_loss, median(loss_pct) filter (where confirmable) median_loss, stddev_pop(loss_pct) filter (where confirmable) std_loss, max(loss_pct) filter (where confirmable) peak_loss from iv group by 1""")
def coarse_stats(v: Views) -> DataFrame:
    return drift.coarse_stats(drift.interval_profile(v.rsnap, P))


@query(_PROFILE + """ select article, start_date, end_date, anomaly_types, priority, case when confirmable then 'pending_confirmation' else 'descriptive_only' end decision, loss_pct, pwr_removed, gain_pct, pwr_added, replacement_pct, pwr_replaced from iv where anomaly_types <> ''""")
def sweep_candidates(v: Views) -> DataFrame:
    return drift.sweep_candidates(drift.interval_profile(v.rsnap, P))


_EPISODES = _PROFILE + f""", e0 as (select *, loss_pct >= {P.elevated} high, lag(loss_pct >= {P.elevated}) over o last_high, lag(end_date) over o last_end from iv where confirmable window o as (partition by article order by start_date, start_rev)),
e1 as (select *, sum(case when high and coalesce(last_high, false) and last_end = start_date then 0 else 1 end) over (partition by article order by start_date, start_rev) island from e0),
episodes as (select article, min(start_date) start_date, arg_min(start_rev, start_date) start_rev, max(end_date) end_date, arg_max(end_rev, end_date) end_rev, sum(pwr_removed)::bigint pwr_mass, max(loss_pct) peak_pct from e1 where high group by article, island),
hz as (select article, max(snap_date) horizon, count(*) snapshots from snaps group by 1),
ranked0 as (select e.*, greatest(0, date_diff('day', end_date, horizon)/365.25) age_years from episodes e join hz using (article) where peak_pct >= {P.mag_floor} and snapshots >= 3),
ranked as (select *, case when age_years <= {P.recent_years} then 'recent' else 'standing ' || round_even(age_years, 0)::int || 'yr' end recency, row_number() over (partition by article order by pwr_mass desc, start_date, start_rev) "rank" from ranked0)"""


@query(_EPISODES + " select * from episodes")
def build_episodes(v: Views) -> DataFrame:
    return drift.build_episodes(drift.interval_profile(v.rsnap, P).where("confirmable"), P.elevated)


@query(_EPISODES + " select * from ranked")
def ranked_episodes(v: Views) -> DataFrame:
    return drift.ranked_episodes(v.rsnap, P)


@query(_EPISODES + f""", st as (select article, avg(loss_pct) m, max(loss_pct) p from iv where confirmable group by 1), t as (select article, count(*) episodes, max(pwr_mass) top_mass, arg_min(recency, "rank") top_recency from ranked group by 1)
select article, horizon, snapshots, case when snapshots < 3 then 'SKIP' when episodes > 0 then 'PIVOT?' when coalesce(m, 0) > {P.creep_mean} then 'CREEP?' else 'HEALTHY' end verdict, round_even(coalesce(m, 0), 2) mean_loss, round_even(coalesce(p, 0), 2) peak_loss,
  coalesce(episodes, 0) episodes, coalesce(top_mass, 0) top_mass, top_recency from hz left join st using (article) left join t using (article)""")
def verdict(v: Views) -> DataFrame:
    return drift.verdict(v.rsnap, P)


_ROLLING = f""", rp as (select a.article, a.k start_k, a.snap_date start_date, a.snap_rev start_rev, b.k end_k, b.snap_date end_date, b.snap_rev end_rev from snaps a join snaps b on a.article = b.article and b.k > a.k and abs(date_diff('day', a.snap_date, b.snap_date) - 365) <= {P.rolling_tolerance_days}
  qualify row_number() over (partition by a.article, a.k order by abs(date_diff('day', a.snap_date, b.snap_date) - 365), b.k) = 1),
rs as (select p.article, start_date, start_rev, end_date, end_rev, count(*) size, sum(m.w) weight, coalesce(sum(m.w) filter (where e.token_id is null), 0)::bigint pwr_mass from rp p join member m on m.article = p.article and m.k = start_k left join member e on e.article = p.article and e.k = end_k and e.token_id = m.token_id group by all),
rolling as (select article, start_date, start_rev, end_date, end_rev, pwr_mass, 100.0::double*pwr_mass/weight peak_pct from rs where size >= {P.min_mature} and 100.0::double*pwr_mass/weight >= {P.rolling_drop})"""


@query(_ROLLING + " select * from rolling")
def rolling_candidates(v: Views) -> DataFrame:
    return drift.rolling_candidates(v.rsnap, P)


@query()
def non_overlapping(v: Views) -> DataFrame:
    return drift.non_overlapping(drift.rolling_candidates(v.rsnap, P))


_SPINE = _EPISODES + f""", win as (select r.article, s.k from ranked r join snaps s on s.article = r.article and s.snap_rev = r.start_rev), sw as (select win.article, win.k, token_id, w from win join member m on m.article = win.article and m.k = win.k),
spine as (select * from sw join (select article, k, quantile_disc(w, {P.durable_q}) cut from sw group by 1, 2) using (article, k) where w >= cut)"""


def _spine_windows(v: Views, member: DataFrame | None = None) -> DataFrame:
    snaps = corpus.snapshots_distinct(v.rsnap)
    rows = drift.ranked_episodes(v.rsnap, P, settled(drift.interval_profile(v.rsnap, P, member=member), "profile"))
    starts = snaps.select("article", F.col("snap_rev").alias("start_rev"), "k")
    ends = snaps.select("article", F.col("snap_rev").alias("end_rev"), F.col("k").alias("end_k"))
    return rows.join(starts, ["article", "start_rev"]).join(ends, ["article", "end_rev"])


@query(_SPINE + " select article, k, token_id, w, cut from spine")
def durable_spine(v: Views) -> DataFrame:
    member = settled(membership(v.rsnap), "membership")
    return drift.durable_spine(member, _spine_windows(v, member).select("article", "k"), P)


@query(_SPINE + f""", d as (select s.article, s.k, e.k end_k, count(*) cohort, 1 - count(m.token_id)/count(*) "drop" from spine s join ranked r on r.article = s.article join snaps a on a.article = r.article and a.snap_rev = r.start_rev and a.k = s.k join snaps e on e.article = r.article and e.snap_rev = r.end_rev
  left join member m on m.article = s.article and m.k = e.k and m.token_id = s.token_id group by 1, 2, 3)
select article, k, end_k, cohort, round_even("drop", 6) "drop", case when "drop" >= {P.confirm_drop} then 'confirmed' else 'rejected' end decision, case when "drop" is null then 'insufficient_revision_evidence' when "drop" < {P.confirm_drop} then 'durable_spine_drop_below_threshold' end rejection_reason from d""")
def candidate_evaluation(v: Views) -> DataFrame:
    member = settled(membership(v.rsnap), "membership")
    windows = settled(_spine_windows(v, member), "spine-windows")
    found = drift.endpoint_refine(drift.durable_spine(member, windows.select("article", "k"), P), member, windows)
    return drift.candidate_evaluation(found, P)


def _states(v: Views) -> DataFrame:
    """The raw snapshots as token states of the revisions in their half-year."""
    return v.rsnap_raw.select("article", F.col("snap_rev").alias("rev_id"), "token_id", "o_rev_id", "snap_date")


def _localisation(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The spine, windows from an episode's start to two years after its end, and all snapshots as revisions and their states."""
    member = settled(membership(v.rsnap), "membership")
    windows = _spine_windows(v, member).select("article", "k", F.col("start_date").cast("timestamp").alias("start_ts"), F.add_months("end_date", 24).cast("timestamp").alias("end_ts")).distinct()
    revs = v.rsnap.select("article", F.col("snap_rev").alias("rev_id"), F.col("snap_date").cast("timestamp").alias("ts")).distinct()
    windows = settled(windows, "spine-windows")
    return drift.durable_spine(member, windows.select("article", "k"), P), windows, revs, v.rsnap.select("article", F.col("snap_rev").alias("rev_id"), "token_id")


_SURVIVAL = _SPINE + """, w as (select distinct r.article, a.k, r.start_date, r.end_date + interval 24 month until from ranked r join snaps a on a.article = r.article and a.snap_rev = r.start_rev),
rv as (select w.article, w.k, s.snap_rev rev_id, row_number() over (partition by w.article, w.k order by s.snap_date, s.snap_rev) - 1 seq, count(*) over (partition by w.article, w.k) n from w join snaps s on s.article = w.article and s.snap_date > w.start_date and s.snap_date <= w.until),
c as (select article, k, count(*) cohort from spine group by 1, 2), t as (select distinct article, snap_rev rev_id, token_id from rsnap),
h as (select rv.article, rv.k, rv.seq, count(s.token_id) hits from rv join t using (article, rev_id) left join spine s on s.article = rv.article and s.k = rv.k and s.token_id = t.token_id group by 1, 2, 3),
sv as (select rv.*, cohort, hits / cohort share from rv join c using (article, k) left join h using (article, k, seq))"""


@query(_SURVIVAL + " select article, k, rev_id, seq::int seq, cohort, share from sv")
def cohort_survival(v: Views) -> DataFrame:
    """Every snapshot of the spine's article is a revision of the window."""
    return drift.cohort_survival(*_localisation(v)).select("article", "k", "rev_id", "seq", "cohort", "share")


@query(_SURVIVAL + f""", ends as (select a.article, a.k, a.share s0, b.share s1, a.n from sv a join sv b on b.article = a.article and b.k = a.k and a.seq = 0 and b.seq = a.n - 1 where a.n >= 3 and a.cohort >= {P.min_cohort} and a.share is not null and b.share is not null),
found as (with recursive b as (select article, k, 0::bigint lo, n - 1 hi, s0, s1, s0 - s1 "drop", 2 probed from ends union all
  select b.article, b.k, case when s0 - m.share >= m.share - s1 then lo else m.seq end, case when s0 - m.share >= m.share - s1 then m.seq else hi end, case when s0 - m.share >= m.share - s1 then s0 else m.share end,
    case when s0 - m.share >= m.share - s1 then m.share else s1 end, "drop", probed + 1 from b join sv m on m.article = b.article and m.k = b.k and m.seq = (lo + hi) // 2 where hi - lo > 1 and m.share is not null) select * from b where hi - lo = 1)
select g.article, g.k, x.rev_id before_rev, y.rev_id after_rev, "drop", coalesce(probed, 0) probed from (select distinct article, k from rv) g left join found f using (article, k)
  left join rv x on x.article = f.article and x.k = f.k and x.seq = lo left join rv y on y.article = f.article and y.k = f.k and y.seq = hi""")
def refine(v: Views) -> DataFrame:
    """Exact localisation by rounds."""
    return drift.refine(*_localisation(v), P)


@query(""", life as (select article, 9 rev_id, token_id, o_rev_id, max(l_orderkey) out_rev from rsnap r join lineitem l on l.l_partkey = r.token_id and 'a' || (l_suppkey % 20) = r.article where snap_rev = 9 group by all),
o as (select o_orderkey, o_orderdate ts, 'u' || (o_custkey % 37) u from orders), j as (select life.article, token_id, d.u from life join o b on b.o_orderkey = o_rev_id join o d on d.o_orderkey = out_rev where b.ts < timestamp '1999-01-01' and d.ts > timestamp '1999-01-01' and d.ts <= timestamp '2000-07-01'),
l as (select r.article, r.token_id from rsnap r join (select article, max(snap_date) snap_date from snaps group by 1) using (article, snap_date))
select article, 9::bigint rev_id, u editor, count(*) tokens from j where (article, token_id) not in (select (article, token_id) from l) group by 1, 3""")
def removal_attribution(v: Views) -> DataFrame:
    last = v.table("lineitem").groupBy(F.concat(F.lit("a"), F.pmod("l_suppkey", F.lit(20))).alias("article"), F.col("l_partkey").alias("token_id")).agg(F.max("l_orderkey").alias("out_rev"))
    life = v.rsnap.where("snap_rev = 9").join(last, ["article", "token_id"]).select("article", F.col("snap_rev").alias("rev_id"), "token_id", "o_rev_id", F.array("out_rev").alias("out"))
    o = v.table("orders").select(F.col("o_orderkey").alias("rev_id"), F.col("o_orderdate").alias("ts"), F.concat(F.lit("u"), F.pmod("o_custkey", F.lit(37))).alias("user"))
    named = life.select("article", F.explode(F.array_append("out", F.col("o_rev_id"))).alias("rev_id")).distinct().join(o, "rev_id")
    windows = v.rsnap.select("article").distinct().select("article", F.lit(9).cast("long").alias("rev_id"), F.lit("1999-01-01").cast("timestamp").alias("start_ts"), F.lit("2000-07-01").cast("timestamp").alias("end_ts"))
    latest = v.rsnap.join(corpus.latest_snapshot(v.rsnap), ["article", "snap_date", "snap_rev"], "left_semi")
    return drift.removal_attribution(life, named, windows, latest)


@query(""", l as (select r.* from rsnap r join (select article, max(snap_date) snap_date from snaps group by 1) using (article, snap_date)), o as (select o_orderkey, o_orderdate ts, 'u' || (o_custkey % 37) u from orders where o_orderkey % 9 <> 0),
j as (select article, snap_date, date_diff('day', ts::date, snap_date)/365.25 age, coalesce(u, '?') u from l left join o on o_orderkey = o_rev_id), t as (select article, snap_date horizon, count(*) n_tokens, median(age) m, count(*) filter (where age <= 3) recent from j group by 1, 2),
e as (select article, count(*) distinct_editors, sum(n) filter (where r <= 10) top from (select article, u, count(*) n, row_number() over (partition by article order by count(*) desc, u) r from j group by 1, 2) group by 1)
select article, horizon, n_tokens, round_even(coalesce(m, 0), 1) median_age_yrs, round_even(100.0*recent/n_tokens, 1) pct_recent, round_even(100.0*top/n_tokens, 1) top10_editor_share, distinct_editors from t join e using (article)""")
def profile(v: Views) -> DataFrame:
    o = v.table("orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("rev_id"), F.col("o_orderdate").alias("ts"), F.concat(F.lit("u"), F.pmod("o_custkey", F.lit(37))).alias("user"))
    named = v.rsnap.select("article", F.col("o_rev_id").alias("rev_id")).distinct().join(o, "rev_id")
    return drift.profile(v.rsnap, named, corpus.latest_snapshot(v.rsnap))


_LEDGER = """, rsn as (select *, row_number() over (partition by article order by snap_rev) - 1 seq from (select distinct article, snap_rev, snap_date from rsnap_raw)),
revs as (select article, seq, snap_rev rev_id, snap_date::timestamp ts, 'u' || (snap_rev % 5) account from rsn), st as (select distinct s.article, s.seq, token_id, case when o_rev_id % 3 = 0 then 1 + o_rev_id % 14 else 0 end o_rev_id from rsnap_raw r join rsn s using (article, snap_rev)),
lst as (select article, max(seq) last_seq from revs group by 1), nb as (select st.*, last_seq, lag(seq) over t before, lead(seq) over t after from st join lst using (article) window t as (partition by st.article, token_id order by seq)),
ops as (select article, token_id, seq, case when before is null then 'added' else 'restored' end op from nb where (seq > 0 and before is null) or before < seq - 1 union all select article, token_id, seq + 1, 'removed' from nb where seq < last_seq and (after is null or after > seq + 1)),
ledger as (select r.article, r.seq, rev_id, account, count(*) filter (where op = 'removed') removed, count(*) filter (where op in ('added', 'restored')) added, count(*) filter (where op = 'restored') restored from revs r left join ops o on o.article = r.article and o.seq = r.seq group by 1, 2, 3, 4),
f0 as (select article, token_id from st where seq = 0), f1 as (select st.article, token_id, o_rev_id from st join lst on lst.article = st.article and seq = last_seq),
gone as (select article, token_id, max(seq) seq from ops where op = 'removed' and (article, token_id) in (select (article, token_id) from f0) and (article, token_id) not in (select (article, token_id) from f1) group by 1, 2),
fresh0 as (select * from f1 where (article, token_id) not in (select (article, token_id) from f0)),
fresh1 as (select f.article, f.token_id, coalesce(nullif(any_value(r.seq), 0), max(o.seq)) seq from fresh0 f join ops o on o.article = f.article and o.token_id = f.token_id and op <> 'removed' left join revs r on r.article = f.article and r.rev_id = f.o_rev_id group by 1, 2),
standing as (select 'removal' kind, article, seq, count(*) tokens from gone group by 2, 3 union all select 'replacement', article, seq, count(*) from fresh1 group by 2, 3)"""


def _event(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(revs, states, last, ops) over the raw snapshots."""
    number = Window.partitionBy("article").orderBy("snap_rev")
    rsn = v.rsnap_raw.select("article", "snap_rev", "snap_date").distinct().withColumn("seq", F.row_number().over(number) - 1)
    revs = rsn.select("article", "seq", F.col("snap_rev").alias("rev_id"), F.col("snap_date").cast("timestamp").alias("ts"), F.concat(F.lit("u"), F.pmod("snap_rev", F.lit(5))).alias("account"))
    origin = F.when(F.col("o_rev_id") % 3 == 0, 1 + F.col("o_rev_id") % 14).otherwise(0)
    states = v.rsnap_raw.join(rsn.select("article", "snap_rev", "seq"), ["article", "snap_rev"]).select("article", "seq", "token_id", origin.alias("o_rev_id")).distinct()
    last = revs.groupBy("article").agg(F.max("seq").alias("last_seq"))
    return revs, states, last, at.token_operations(states, last)


@query(_LEDGER + " select * from ledger")
def event_ledger(v: Views) -> DataFrame:
    revs, _, _, ops = _event(v)
    return at.event_ledger(revs, ops).select("article", "seq", "rev_id", "account", "removed", "added", "restored")


@query(_LEDGER + " select * from standing")
def net_standing(v: Views) -> DataFrame:
    revs, states, last, ops = _event(v)
    return at.net_standing(states, ops, revs, last)


@query(_LEDGER + """, sets as (select article, seq, string_agg(distinct token_id::varchar, ',' order by token_id::varchar) s from st group by 1, 2), rv as (select *, lag(seq) over (partition by article, s order by seq) back from sets),
bk as (select article, seq at_seq, token_id from ops where op = 'restored'), bn as (select article, at_seq, count(*) n from bk group by 1, 2), hd as (select bk.article, at_seq, st.seq old, count(*) n from bk join st on st.article = bk.article and st.token_id = bk.token_id and st.seq < at_seq group by 1, 2, 3),
wh as (select article, at_seq, max(old) whole from hd join bn using (article, at_seq, n) group by 1, 2)
select rv.article, rv.seq, case when rv.seq = 0 then 'stable_before' when back is not null then 'revert' when rv.seq = last_seq then 'consolidation' when n > 0 then 'restoration' when rv.seq = 1 then 'initiating_change' else 'intermediate_change' end "role",
  case when rv.seq = 0 then null when back is not null then back when rv.seq = last_seq then null when n > 0 then whole end restores_seq from rv join lst using (article) left join bn on bn.article = rv.article and bn.at_seq = rv.seq left join wh on wh.article = rv.article and wh.at_seq = rv.seq""")
def revision_role(v: Views) -> DataFrame:
    revs, states, last, ops = _event(v)
    return at.revision_roles(revs, states, ops, last)


@query(_LEDGER + """, pa as (select kind, article, account, sum(tokens) n from standing join revs using (article, seq) group by 1, 2, 3), pr as (select *, row_number() over (partition by article, kind order by n desc, account) r from pa)
select article, coalesce(sum(n) filter (where kind = 'removal'), 0)::bigint removed_tokens, coalesce(sum(n) filter (where kind = 'replacement'), 0)::bigint replacement_tokens,
  round_even(sum(n) filter (where kind = 'removal' and r <= 1)/sum(n) filter (where kind = 'removal'), 6) top_removal_share, round_even(sum(n) filter (where kind = 'replacement' and r <= 1)/sum(n) filter (where kind = 'replacement'), 6) top_replacement_share,
  round_even(sum(n) filter (where kind = 'removal' and r <= 2)/sum(n) filter (where kind = 'removal'), 6) top_two_removal_share,
  coalesce(max(account) filter (where kind = 'removal' and r = 1) = max(account) filter (where kind = 'replacement' and r = 1), false) same_top_editor from pr group by 1""")
def participation(v: Views) -> DataFrame:
    revs, states, last, ops = _event(v)
    return at.participation(at.net_standing(states, ops, revs, last), revs)


@query(_LEDGER + """, g as (select article, sum(removed)::bigint removed, sum(added)::bigint added, sum(restored)::bigint restored from ledger group by 1), n as (select article, sum(tokens)::bigint net from standing group by 1)
select article, removed, added, restored, coalesce(net, 0) net, case when net is null and removed + added > 0 then 'reverted' else 'standing' end event_status from g left join n using (article)""")
def event_status(v: Views) -> DataFrame:
    revs, states, last, ops = _event(v)
    return at.event_status(at.event_ledger(revs, ops), at.net_standing(states, ops, revs, last))


@query("select article, rev_id, ts, size, \"user\", size - lag(size) over (partition by article order by ts, rev_id) size_delta from revisions join rev_size using (article, rev_id)")
def size_delta(v: Views) -> DataFrame:
    return at.size_deltas(corpus.size_series(v.revisions, v.rev_size))


@query(""", e as (select article, min(ts) + interval 400 day start_ts, min(ts) + interval 401 day end_ts from revisions group by 1)
select e.article event_id, 'revision' family, case when count(r.ts) > 0 then 'observed' else 'not_observed' end state, count(r.ts) n from e left join revisions r on r.article = e.article and r.ts >= start_ts - interval 24 hour and r.ts <= end_ts + interval 24 hour group by 1
union all select article, 'talk', 'unavailable', null from e""")
def process_context(v: Views) -> DataFrame:
    events = v.revisions.groupBy("article").agg(F.min("ts").alias("t")).select(F.col("article").alias("event_id"), "article", (F.col("t") + F.expr("interval 400 days")).alias("start_ts"), (F.col("t") + F.expr("interval 401 days")).alias("end_ts"))
    return at.process_context(events, {"revision": v.revisions, "talk": None})


_BINS = f""", ser as (select article, rev_id, ts, size, "user" from revisions join rev_size using (article, rev_id)), sm as (select *, median(coalesce(size, 0)) over (partition by article order by ts, rev_id rows between {P.smooth_k} preceding and {P.smooth_k} following) smooth, min(ts) over (partition by article) t0 from ser),
bn as (select *, coalesce(smooth - lag(smooth) over (partition by article order by ts, rev_id), 0) delta, floor((epoch(ts) - epoch(t0))/(86400*{P.bin_days}))::bigint bin from sm),
bins as (select article, bin, sum(case when delta < 0 then -delta else 0 end) removed, sum(case when delta >= 0 then delta else 0 end) added, count(*) revs, min(ts) start_ts, max(ts) end_ts from bn group by 1, 2)"""


@query(_BINS + " select article, rev_id, smooth from sm")
def rolling_median(v: Views) -> DataFrame:
    return prerank.rolling_median(corpus.size_series(v.revisions, v.rev_size), P).select("article", "rev_id", "smooth")


@query(_BINS + " select * from bins")
def delta_bins(v: Views) -> DataFrame:
    return prerank.delta_bins(prerank.revision_bins(corpus.size_series(v.revisions, v.rev_size), P))


@query(_BINS + f""", us as (select article, bin, max(n) top from (select article, bin, "user", count(*) n from bn group by 1, 2, 3) group by 1, 2), b2 as (select * from bins join us using (article, bin)),
pk as (select * from b2 qualify row_number() over (partition by article order by removed desc, bin) = 1), pa as (select * from b2 qualify row_number() over (partition by article order by added desc, bin) = 1),
base as (select article, sum(revs)::bigint total_revs, coalesce(median(removed) filter (where removed > 0), 1) rb, coalesce(median(added) filter (where added > 0), 1) ab from bins group by 1 having sum(revs) >= {P.min_revs}),
j as (select article, pk.removed, pk.removed/rb rem_anom, pk.start_ts::date rem_start, pk.end_ts::date rem_end, pa.added, pa.added/ab add_anom, pa.start_ts::date add_start, pa.end_ts::date add_end, pk.top/pk.revs editor_conc, pa.top/pa.revs add_editor_conc, pa.removed par, total_revs from base join pk using (article) join pa using (article))
select article, removed, rem_anom, rem_start, rem_end, added, add_anom, add_start, add_end, editor_conc, add_editor_conc, concat_ws(',', case when removed >= {P.lead_floor} and rem_anom >= {P.anomaly_min} then 'removal→PWR' end,
  case when added >= {P.lead_floor} and add_anom >= {P.anomaly_min} and added > {P.growth_ratio}*par then 'addition→L2' end, case when not (removed >= {P.lead_floor} and rem_anom >= {P.anomaly_min}) and removed >= {P.churn_min_bytes} and rem_anom >= {P.churn_anomaly} then 'churn→L2' end) leads, total_revs from j""")
def prerank_leads(v: Views) -> DataFrame:
    return prerank.prerank_leads(corpus.size_series(v.revisions, v.rev_size), P)


_MSCORE = """, hk as (select *, row_number() over (partition by article order by k0) - 1 k from history where "user" is not null and sha1 is not null), hf as (select *, min(k) over (partition by article, sha1) f from hk),
pr as (select x.article, x."user" a, y."user" b, count(distinct x.k) n from hf x join hf y on y.article = x.article and y.k > x.f and y.k < x.k and y."user" <> x."user" where x.f < x.k - 1 group by 1, 2, 3),
ed as (select article, "user" u, count(*) e from hk group by 1, 2), tot as (select article, count(*) revs from hk group by 1)"""


def _m_sql(least: int, name: str) -> str:
    return f"""{name}_mu as (select p.article, p.a, p.b, least(ea.e, eb.e) w from pr p join pr q on q.article = p.article and q.a = p.b and q.b = p.a and p.a < p.b and p.n >= {least} and q.n >= {least} join ed ea on ea.article = p.article and ea.u = p.a join ed eb on eb.article = p.article and eb.u = p.b),
{name} as (select tot.article, revs, coalesce(mutual_pairs, 0) mutual_pairs, coalesce(ws*w, 0)::bigint m from tot left join (select article, count(*) mutual_pairs, sum(w) w from {name}_mu group by 1) using (article) left join (select article, count(distinct u) ws from (select article, unnest([a, b]) u from {name}_mu) group by 1) using (article))"""


@query(_MSCORE + ", " + _m_sql(2, "f2") + " select *, round_even(m/revs, 2) m_per_rev from f2")
def mscore(v: Views) -> DataFrame:
    return prerank.mscore(v.history)


@query(_MSCORE + ", " + _m_sql(1, "f1") + ", " + _m_sql(2, "f2") + """ select article, f1.revs "rows", f1.revs raw_revs, f1.m raw_m, f2.m refined_m, round_even(f2.m/f1.revs, 2) refined_per_row, f2.m/f1.revs >= 5 contested from f1 join f2 using (article)""")
def mscore_raw_vs_refined(v: Views) -> DataFrame:
    return prerank.mscore_raw_vs_refined(v.history)


@query("""select article, removed, floor from (select article, removed, min(removed) filter (where kind = 'pivot') over () as floor, kind from (select 'c' || o_custkey article, max(round(o_totalprice))::bigint removed, case o_custkey % 10 when 0 then 'pivot' when 1 then 'other' else 'healthy' end kind from orders group by o_custkey)) where kind = 'healthy' and removed >= floor""")
def recall_floor(v: Views) -> DataFrame:
    """Customers as articles; every tenth is a known pivot."""
    n = F.col("o_custkey") % 10
    kind = F.when(n == 0, "pivot").when(n == 1, "other").otherwise("healthy")
    rows = v.table("orders").groupBy("o_custkey").agg(F.max(F.round("o_totalprice")).cast("long").alias("removed"))
    return prerank.recall_floor(rows.select(F.concat(F.lit("c"), "o_custkey").alias("article"), "removed", kind.alias("kind")))

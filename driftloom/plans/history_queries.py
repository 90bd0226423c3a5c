"""Queries of token provenance over drafts as revisions, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attribution, provenance
from .bindings import Views
from .drift_queries import QUERIES, SQL, query

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|\[\[|\]\]|\{\{|\}\}|[^\p{L}\p{N}_\s]')"
_HALF = "(length(text) // 2)::int"
DRAFTS = f"""dr0 as (select 'd' || doc_id article, text, substr(text, 1, {_HALF}) || '. Added <ref>[http://www.example.org/a x]</ref> here. More.' || chr(10) || '== Later ==' || chr(10) || substr(text, {_HALF} + 1) cut from documents),
dr1 as (select *, replace(replace(cut, 'e ', 'ee '), 'example.org', 'example.net') other from dr0),
drafts as (select article, rev_id, text from (select article, 1::bigint rev_id, text from dr1 union all select article, 2, cut from dr1 union all select article, 3, other from dr1 union all select article, 4, substr(other, 1, {_HALF}) from dr1))"""


@query(f""", {DRAFTS}, t as (select article, rev_id, {_TOKENS} ts from drafts)
select article, rev_id, len(ts)::bigint n_tokens, len(ts)::bigint n_distinct, sha256(array_to_string(ts, ' ')) words_sha256, case when rev_id = 1 then len(ts) else 0 end::bigint own from t where len(ts) > 0""")
def token_states(v: Views) -> DataFrame:
    """Every state holds the tokens of its text in order, each once; the first has no other's. own: tokens that came with revision 1, of it."""
    parts = v.text_parts()
    rows = provenance.revision_tokens(v.drafts_in(parts), pass_over=False, parts=parts)
    own = F.when(F.col("rev_id") == 1, F.size(F.filter("origins", lambda o: o == 1))).otherwise(0)
    return rows.select("article", "rev_id", F.size("ids").cast("long").alias("n_tokens"), F.size(F.array_distinct("ids")).cast("long").alias("n_distinct"), F.sha2(F.array_join("strs", " "), 256).alias("words_sha256"), own.cast("long").alias("own"))


@query()
def token_lives(v: Views) -> DataFrame:
    """Tokens of all drafts with the revisions that took them out and put them back."""
    parts = v.text_parts()
    return provenance.lives(provenance.token_provenance(v.drafts_in(parts), kinds=("life",), parts=parts))


@query()
def revision_origins(v: Views) -> DataFrame:
    """What each draft brought, brought back and kept."""
    parts = v.text_parts()
    return provenance.revision_origins(v.drafts_in(parts), parts=parts)


_QUOTED = "replace(replace(replace(replace(url_encode(replace(title, ' ', '_')), '%28', '('), '%29', ')'), '%3A', ':'), '%2F', '/')"


@query(f""", t as (select doc_id, source || ' (' || lang || '): ' || substr(text, 1, 60) || '*~+/' title from documents)
select doc_id, 'https://en.wikipedia.org/wiki/' || {_QUOTED} page, 'https://en.wikipedia.org/w/index.php?title=' || {_QUOTED} || '&oldid=' || doc_id AS "revision" from t""")
def addresses(v: Views) -> DataFrame:
    """Beginnings of documents as titles."""
    title = F.concat("source", F.lit(" ("), "lang", F.lit("): "), F.substring("text", 1, 60), F.lit("*~+/"))
    return v.table("documents").select("doc_id", T.page_address(title).alias("page"), T.oldid_address(title, F.col("doc_id")).alias("revision"))


def _receipt_sources(v: Views, events: DataFrame) -> dict:
    """Orders as revisions, the urgent ones as talk too, poor suppliers as protections, dear orders as texts with disputes; the log can't be read."""
    o, article = v.table("orders"), F.concat(F.lit("a"), F.pmod("o_custkey", F.lit(20))).alias("article")
    tags = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("mw-undo"), F.lit("minor"))).when(F.col("o_orderstatus") == "P", F.array(F.lit("mw-rollback")))
    metadata = o.select(article, F.col("o_orderkey").alias("rev_id"), (F.col("o_orderkey") - 1).alias("parent_id"), F.col("o_orderdate").alias("ts"), F.concat(F.lit("u"), F.pmod("o_custkey", F.lit(37))).alias("account"),
        F.concat(F.lit("/* "), "o_orderpriority", F.lit(" */ edit")).alias("comment"), tags.alias("tags"), F.md5(F.pmod("o_custkey", F.lit(200)).cast("string")).alias("sha1"), F.lit(1).alias("size"))
    talk = metadata.where(F.contains("comment", F.lit("URGENT")))
    guards = v.table("supplier").where("s_acctbal < 0").select(F.concat(F.lit("a"), F.pmod("s_suppkey", F.lit(20))).alias("article"), F.col("s_name").alias("type"), F.lit("sysop").alias("level"), F.lit("infinity").alias("expiry"))
    texts = o.select(article, F.col("o_orderkey").alias("rev_id"), F.when(F.col("o_totalprice") > 150000, F.lit("{{POV section|x}} {{ Split }} {{cite web|url=a}} {{POV section}}")).otherwise("{{Infobox}} pov").alias("text"))

    def log() -> DataFrame:
        raise OSError("the log is away")

    return {
        "revision_activity": lambda: attribution.revision_items(events, metadata), "revert_relationships": lambda: attribution.revert_items(events, metadata), "talk_activity": lambda: attribution.revision_items(events, talk, talk=True),
        "page_operations": log, "protection": lambda: attribution.protection_items(events, guards), "dispute_templates": lambda: attribution.dispute_items(events, texts), "arbitration": "no public source",
    }


def _receipts(v: Views) -> tuple[DataFrame, DataFrame]:
    o = v.revisions.groupBy("article").agg(F.min("ts").alias("t"), F.max("rev_id").alias("after_rev"))
    events = o.select(F.col("article").alias("event_id"), "article", (F.col("t") + F.expr("interval 400 days")).alias("start_ts"), (F.col("t") + F.expr("interval 430 days")).alias("end_ts"), "after_rev")
    return attribution.process_receipts(events, _receipt_sources(v, events))


_RECEIPTS = """, ev as (select article, min(ts) + interval 400 day s, min(ts) + interval 430 day e, max(rev_id) after_rev from revisions group by 1), o as (select 'a' || (o_custkey % 20) article, * from orders),
inside as (select ev.article, o_orderkey, o_orderdate, o_orderstatus, lag(o_orderkey) over (partition by ev.article, o_custkey % 200 order by o_orderdate, o_orderkey) back from ev join o on o.article = ev.article and o_orderdate between s and e),
found as (select article, 'revision_activity' family, count(*) n from inside group by 1 union all select article, 'revert_relationships', count(*) from inside where o_orderstatus in ('F', 'P') or back is not null group by 1
  union all select ev.article, 'talk_activity', count(*) from ev join o on o.article = ev.article and o_orderpriority like '%URGENT%' and o_orderdate between s - interval 24 hour and e + interval 24 hour group by 1
  union all select ev.article, 'protection', count(*) from ev join supplier on 'a' || (s_suppkey % 20) = ev.article and s_acctbal < 0 group by 1 union all select ev.article, 'dispute_templates', 2 from ev join o on o_orderkey = after_rev and o_totalprice > 150000),
fams as (select unnest(['revision_activity', 'revert_relationships', 'talk_activity', 'page_operations', 'protection', 'dispute_templates', 'arbitration']) family)"""


@query(_RECEIPTS + """ select ev.article event_id, family, case when family in ('page_operations', 'arbitration') then 'unavailable' when n > 0 then 'observed' else 'not_observed' end status,
  case family when 'page_operations' then 'page_operations failed: the log is away' when 'arbitration' then 'no public source' end reason, case when family not in ('page_operations', 'arbitration') then coalesce(n, 0) end n from ev cross join fams left join found using (article, family)""")
def process_receipts(v: Views) -> DataFrame:
    return _receipts(v)[0]


@query(_RECEIPTS + """ select article event_id, o_orderkey "at", case when o_orderstatus = 'F' then 'mw-undo' when o_orderstatus = 'P' then 'mw-rollback' end tag, back restores, 'https://en.wikipedia.org/w/index.php?title=' || article || '&oldid=' || o_orderkey source_url from inside where o_orderstatus in ('F', 'P') or back is not null""")
def revert_evidence(v: Views) -> DataFrame:
    """The items of the reverts' family, read back from their JSON."""
    rows = _receipts(v)[1].where("family = 'revert_relationships'").withColumn("x", F.from_json("item", "signals array<string>, restores_revision_id long, source_url string"))
    tag = F.get(F.filter("x.signals", lambda t: t != "sha1_restoration"), F.lit(0))
    return rows.select("event_id", "at", tag.alias("tag"), F.col("x.restores_revision_id").alias("restores"), "x.source_url")

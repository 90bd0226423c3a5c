"""Views of the test tables as corpus tables, in Spark and (WITH) in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import Params

#: Floors that fit the small views.
SMALL = Params(min_mature=300, min_cohort=100, mass_floor=500, review_mass_floor=100, lead_floor=1000, anomaly_min=1.2, churn_min_bytes=500, churn_anomaly=1.5, lexical_tokens=100)


class Views:
    """Corpus tables over one data folder; each is built when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _shipments(self, articles: int, rows: int = 150_000) -> DataFrame:
        """Shipments of so many articles, each part in one task with all of its shipments in an article: a task has about so many rows at any scale."""
        half = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).cast("int")
        table = self.table("lineitem")
        found = table.select(F.concat(F.lit("a"), F.pmod("l_suppkey", F.lit(articles))).alias("article"), F.col("l_partkey").alias("token_id"), "l_orderkey", F.floor(half / 6).cast("int").alias("half"))
        return found.repartition(1 + table.count() // rows, "article", "token_id")

    @staticmethod
    def _dated(rows: DataFrame) -> DataFrame:
        day = F.make_date((1995 + F.floor(F.col("half") / 2)).cast("int"), (1 + 6 * F.pmod("half", F.lit(2))).cast("int"), F.lit(1))
        return rows.select("article", day.alias("snap_date"), (F.col("half") + 1).cast("long").alias("snap_rev"), "token_id", "o_rev_id")

    @property
    def rsnap(self) -> DataFrame:
        """A part is in a supplier group's text from its first to its last shipment."""
        rows = self._shipments(20).groupBy("article", "token_id")
        rows = rows.agg(F.min("half").alias("h0"), F.max("half").alias("h1"), F.min("l_orderkey").alias("o_rev_id"))
        return self._dated(rows.withColumn("half", F.explode(F.sequence("h0", "h1"))))

    @property
    def rsnap_raw(self) -> DataFrame:
        """A part is in the text of the half-years with a shipment alone, so that parts go and come back."""
        rows = self._shipments(8).groupBy("article", "token_id", "half")
        rows = rows.agg(F.min("l_orderkey").alias("o0"))
        from pyspark.sql import Window

        return self._dated(rows.withColumn("o_rev_id", F.min("o0").over(Window.partitionBy("article", "token_id"))))

    @property
    def revisions(self) -> DataFrame:
        return self.table("orders").select(F.concat(F.lit("a"), F.pmod("o_custkey", F.lit(20))).alias("article"), F.col("o_orderkey").alias("rev_id"), F.col("o_orderdate").alias("ts"), F.concat(F.lit("u"), F.pmod("o_custkey", F.lit(37))).alias("user"))

    @property
    def rev_size(self) -> DataFrame:
        return self.table("orders").select(F.concat(F.lit("a"), F.pmod("o_custkey", F.lit(20))).alias("article"), F.col("o_orderkey").alias("rev_id"), F.round("o_totalprice").cast("long").alias("size"))

    @property
    def integrity(self) -> DataFrame:
        """Every seventh snapshot of an article is quarantined, every fifth suspect."""
        status = F.when(F.pmod("snap_rev", F.lit(7)) == 0, "quarantined").when(F.pmod("snap_rev", F.lit(5)) == 0, "suspect").otherwise("complete")
        return self.rsnap.select("article", "snap_date", "snap_rev").distinct().withColumn("status", status)

    @property
    def endpoints(self) -> DataFrame:
        """Articles of even number have a receipt, a stable one if divisible by four."""
        n = F.expr("cast(substring(article, 2) as int)")
        rows = self.rsnap.select("article", "snap_date", "snap_rev").distinct().where((F.col("snap_rev") == 9) & (n % 2 == 0))
        return rows.select("article", F.when(n % 4 == 0, "stable").otherwise("unstable").alias("status"), F.col("snap_date").alias("selected_snapshot_date"), F.col("snap_rev").alias("selected_revid"))

    @property
    def history(self) -> DataFrame:
        return self.table("events").select(F.concat(F.lit("h"), F.floor(F.col("event_id") / 250)).alias("article"), F.col("event_id").alias("k0"), F.concat(F.lit("u"), F.pmod("user_id", F.lit(12))).alias("user"), F.col("props").alias("sha1"))

    @property
    def texts(self) -> DataFrame:
        """Documents as revisions of their source; side is before or after. Two sources have one document before."""
        early = (F.pmod(F.floor(F.col("doc_id") / 20), F.lit(2)) == 0) & (~F.col("source").isin("src2", "src3") | (F.col("doc_id") < 20))
        side = F.when(early, "before").otherwise("after")
        return self.table("documents").select(F.col("source").alias("article"), F.col("doc_id").alias("rev_id"), "lang", side.alias("side"), "text")

    def text_parts(self, chars: int = 1_000_000) -> int:
        """Into how many parts documents go, so that one has about so many characters at any scale: two at least, as one would be dealt out whole."""
        return 2 + (self.table("documents").agg(F.sum(F.length("text"))).first()[0] or 0) // chars

    @property
    def drafts(self) -> DataFrame:
        return self.drafts_in()

    def drafts_in(self, parts: int | None = None) -> DataFrame:
        """Each document in four states: plain, with a heading and a source halfway, with words replaced, and shortened.

        Documents are dealt out by article (into so many parts) before they become states, so that what goes on by article needn't deal out four texts of each.
        """
        docs = self.table("documents").select(F.concat(F.lit("d"), "doc_id").alias("article"), "text")
        docs = docs.repartition(parts, "article") if parts else docs.repartition("article")
        half = F.floor(F.length("text") / 2).cast("int")
        cut = F.concat(F.substring("text", F.lit(1), half), F.lit(". Added <ref>[http://www.example.org/a x]</ref> here. More.\n== Later ==\n"), F.substring("text", half + 1, F.length("text")))
        other = F.replace(F.replace(cut, F.lit("e "), F.lit("ee ")), F.lit("example.org"), F.lit("example.net"))
        states = F.array(F.col("text"), cut, other, F.substring(other, F.lit(1), half))
        return docs.select("article", F.posexplode(states).alias("rev_id", "text")).withColumn("rev_id", F.col("rev_id").cast("long") + 1)

    def _owner(self, key: str) -> Column:
        return F.concat(F.lit("c"), F.col(key)).alias("article")

    @property
    def confirmations(self) -> DataFrame:
        """Customers as articles with an exact result."""
        n = F.col("c_custkey")
        status = F.when(n % 5 == 0, "not_confirmed").when(n % 7 == 0, "unavailable").otherwise("confirmed")
        return self.table("customer").select(self._owner("c_custkey"), status.alias("status"), (n % 11 != 0).alias("is_fresh"))

    @property
    def event_editors(self) -> DataFrame:
        """Line items as tokens of an editor in an event (an order), some of a bot, a hidden account or an address."""
        # numbers are summed up, and become names afterwards
        n, odd = F.col("l_suppkey"), (F.col("l_linenumber") % 2 == 1).alias("odd")
        code = F.when(n % 9 == 0, -1).when(n % 9 == 1, -2).when(n % 9 == 2, 100 + n % 200).otherwise(n % 23).cast("int").alias("code")
        rows = self.table("lineitem").join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
        sums = rows.groupBy("o_custkey", F.col("l_orderkey").alias("before_revid"), odd, code).agg(F.sum("l_quantity").cast("long").alias("tokens"))
        c = F.col("code")
        editor = F.when(c == -1, "HelperBot").when(c == -2, "<hidden>").when(c >= 100, F.concat(F.lit("10.0.0."), c - 100)).otherwise(F.concat(F.lit("u"), c))
        return sums.select(self._owner("o_custkey"), "before_revid", F.when(F.col("odd"), "removal").otherwise("replacement").alias("kind"), editor.alias("editor"), "tokens")

    @property
    def episodes(self) -> DataFrame:
        """Orders as confirmed episodes: some without attribution, some whose sums don't fit."""
        n, day = F.col("o_orderkey"), F.to_date("o_orderdate")
        of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("tokens")))
        sums = self.event_editors.groupBy(F.col("before_revid").alias("o_orderkey")).agg(of("removal").alias("r"), of("replacement").alias("p"))
        zero = F.lit(0).cast("long")
        return self.table("orders").join(sums, "o_orderkey", "left").select(
            self._owner("o_custkey"), n.alias("before_revid"), (n + 1).alias("after_revid"), day.alias("candidate_start"), F.date_add(day, 180).alias("candidate_end"),
            ((n % 100) / 100.0).alias("durable_spine_drop"), F.round("o_totalprice").cast("long").alias("pwr_mass"), (n % 86400).alias("duration_seconds"),
            F.when(n % 13 != 0, F.coalesce("r", zero) + (n % 17 == 0).cast("long")).alias("removed_tokens"), (F.coalesce("p", zero) + (n % 19 == 0).cast("long")).alias("replacement_tokens"),
            F.when(n % 26 == 0, "revision_states_missing").alias("unavailable"),
        )


WITH = """
ship as (select *, ((year(l_shipdate)-1995)*12 + month(l_shipdate) - 1)//6 half from lineitem),
span0 as (select 'a' || (l_suppkey % 20) article, l_partkey token_id, min(half) h0, max(half) h1, min(l_orderkey) o_rev_id from ship group by 1, 2),
span1 as (select article, token_id, o_rev_id, unnest(range(h0, h1 + 1)) half from span0),
rsnap as (select article, make_date((1995 + half // 2)::int, (1 + 6*(half % 2))::int, 1) snap_date, (half + 1)::bigint snap_rev, token_id, o_rev_id from span1),
raw0 as (select 'a' || (l_suppkey % 8) article, l_partkey token_id, half, min(l_orderkey) o0 from ship group by 1, 2, 3),
rsnap_raw as (select article, make_date((1995 + half // 2)::int, (1 + 6*(half % 2))::int, 1) snap_date, (half + 1)::bigint snap_rev, token_id, min(o0) over (partition by article, token_id) o_rev_id from raw0),
revisions as (select 'a' || (o_custkey % 20) article, o_orderkey rev_id, o_orderdate ts, 'u' || (o_custkey % 37) "user" from orders),
rev_size as (select 'a' || (o_custkey % 20) article, o_orderkey rev_id, round(o_totalprice)::bigint size from orders),
integrity as (select distinct article, snap_date, snap_rev, case when snap_rev % 7 = 0 then 'quarantined' when snap_rev % 5 = 0 then 'suspect' else 'complete' end status from rsnap),
endpoints as (select distinct article, case when substr(article, 2)::int % 4 = 0 then 'stable' else 'unstable' end status, snap_date selected_date, snap_rev selected_rev from rsnap where snap_rev = 9 and substr(article, 2)::int % 2 = 0),
history as (select 'h' || (event_id // 250) article, event_id k0, 'u' || (user_id % 12) "user", props sha1 from events),
confirmations as (select 'c' || c_custkey article, case when c_custkey % 5 = 0 then 'not_confirmed' when c_custkey % 7 = 0 then 'unavailable' else 'confirmed' end status, c_custkey % 11 <> 0 is_fresh from customer),
event_editors as (select 'c' || o_custkey article, l_orderkey before_revid, case when l_linenumber % 2 = 1 then 'removal' else 'replacement' end kind, case l_suppkey % 9 when 0 then 'HelperBot' when 1 then '<hidden>' when 2 then '10.0.0.' || (l_suppkey % 200) else 'u' || (l_suppkey % 23) end editor, sum(l_quantity)::bigint tokens from lineitem join orders on o_orderkey = l_orderkey group by 1, 2, 3, 4),
event_sums as (select before_revid, sum(tokens) filter (where kind = 'removal') r, sum(tokens) filter (where kind = 'replacement') p from event_editors group by 1),
lead_episodes as (select 'c' || o_custkey article, o_orderkey before_revid, o_orderkey + 1 after_revid, o_orderdate::date candidate_start, o_orderdate::date + 180 candidate_end, (o_orderkey % 100) / 100.0::double durable_spine_drop, round(o_totalprice)::bigint pwr_mass, o_orderkey % 86400 duration_seconds,
  case when o_orderkey % 13 <> 0 then coalesce(r, 0) + (o_orderkey % 17 = 0)::int end::bigint removed_tokens, (coalesce(p, 0) + (o_orderkey % 19 = 0)::int)::bigint replacement_tokens, case when o_orderkey % 26 = 0 then 'revision_states_missing' end unavailable from orders left join event_sums on before_revid = o_orderkey),
usable as (select e.*, case when removed_tokens is null then coalesce(unavailable, 'attribution_missing') when removed_tokens <> coalesce(r, 0) then 'removal_attribution_mismatch' end reason, case when removed_tokens is not null and removed_tokens = coalesce(r, 0) and replacement_tokens <> coalesce(p, 0) then 'replacement_attribution_mismatch' end reason2
  from lead_episodes e join confirmations c on c.article = e.article and status = 'confirmed' and is_fresh left join event_sums s using (before_revid)),
texts as (select source article, doc_id rev_id, lang, case when (doc_id // 20) % 2 = 0 and (source not in ('src2', 'src3') or doc_id < 20) then 'before' else 'after' end side, text from documents),
snaps as (select *, row_number() over (partition by article order by snap_date, snap_rev) - 1 k from (select distinct article, snap_date, snap_rev from rsnap)),
mem0 as (select distinct s.article, s.k, r.token_id from rsnap r join snaps s using (article, snap_date, snap_rev)),
member as (select *, row_number() over t w, lag(k) over t prev_k, lead(k) over t next_k from mem0 window t as (partition by article, token_id order by k))
"""


def sql(body: str) -> str:
    """body, which may use the views: a select, or further CTEs after a comma."""
    return f"with {WITH.strip()} {body}"

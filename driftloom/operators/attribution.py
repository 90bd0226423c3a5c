"""Event attribution over ordered revision states, and process context.

States come in long form: article, seq (from 0), token_id, o_rev_id; revs: article, seq, rev_id, ts, account, size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..lineage import settled


def token_operations(states: DataFrame, last: DataFrame) -> DataFrame:
    """article, seq, token_id, op: removed, added or restored (added though seen before). last: article, last_seq."""
    life = Window.partitionBy("article", "token_id").orderBy("seq")
    rows = states.select("article", "seq", "token_id").distinct().join(last, "article")
    rows = rows.withColumns({"before": F.lag("seq").over(life), "after": F.lead("seq").over(life)})
    added = F.when((F.col("seq") > 0) & F.col("before").isNull(), "added").when(F.col("before") < F.col("seq") - 1, "restored")
    removed = F.when((F.col("seq") < F.col("last_seq")) & (F.col("after").isNull() | (F.col("after") > F.col("seq") + 1)), "removed")
    ops = F.array_compact(F.array(F.when(added.isNotNull(), F.struct(F.col("seq").alias("seq"), added.alias("op"))), F.when(removed.isNotNull(), F.struct((F.col("seq") + 1).alias("seq"), removed.alias("op")))))
    return rows.select("article", "token_id", F.explode(ops).alias("o")).select("article", "token_id", "o.seq", "o.op")


def event_ledger(revs: DataFrame, ops: DataFrame) -> DataFrame:
    """Gross removed, added and restored tokens of each revision."""
    n = lambda *kinds: F.count(F.when(F.col("op").isin(*kinds), 1))
    sums = ops.groupBy("article", "seq").agg(n("removed").alias("removed"), n("added", "restored").alias("added"), n("restored").alias("restored"))
    return revs.join(sums, ["article", "seq"], "left").na.fill(0, ["removed", "added", "restored"])


def net_standing(states: DataFrame, ops: DataFrame, revs: DataFrame, last: DataFrame) -> DataFrame:
    """Tokens that are gone or new at the end, credited to a revision: kind (removal or replacement), article, seq, tokens.

    A removal goes to the token's last removal; a replacement to its origin revision if that is in the sequence and not
    its first, else to its last addition.
    """
    first = states.where("seq = 0").select("article", "token_id").distinct()
    final = states.join(last, "article").where("seq = last_seq").select("article", "token_id", "o_rev_id").dropDuplicates(["article", "token_id"])
    gone = first.join(final, ["article", "token_id"], "left_anti").join(ops.where("op = 'removed'"), ["article", "token_id"]).groupBy("article", "token_id").agg(F.max("seq").alias("seq"))
    new = final.join(first, ["article", "token_id"], "left_anti")
    added = ops.where("op <> 'removed'").groupBy("article", "token_id").agg(F.max("seq").alias("added_seq"))
    origin = revs.select("article", F.col("rev_id").alias("o_rev_id"), F.col("seq").alias("origin_seq"))
    new = new.join(added, ["article", "token_id"]).join(origin, ["article", "o_rev_id"], "left")
    new = new.select("article", "token_id", F.coalesce(F.expr("nullif(origin_seq, 0)"), "added_seq").alias("seq"))
    rows = gone.withColumn("kind", F.lit("removal")).unionByName(new.withColumn("kind", F.lit("replacement")))
    return rows.groupBy("kind", "article", "seq").agg(F.count(F.lit(1)).alias("tokens"))


def _stretches(states: DataFrame) -> DataFrame:
    """article, token_id, start, end: each token's unbroken stretches of revisions."""
    life = Window.partitionBy("article", "token_id").orderBy("seq")
    rows = states.select("article", "seq", "token_id").distinct().withColumn("cut", F.when(F.lag("seq").over(life) == F.col("seq") - 1, 0).otherwise(1))
    rows = rows.withColumn("k", F.sum("cut").over(life))
    return rows.groupBy("article", "token_id", "k").agg(F.min("seq").alias("start"), F.max("seq").alias("end")).drop("k")


def _last_with_all(back: DataFrame, size: DataFrame, states: DataFrame) -> DataFrame:
    """article, at, whole: the last revision before each `at` that has all tokens which `at` restored.

    back: article, at, token_id; size: article, at, n. Stretches are begun and ended along the sequence; where n of them run,
    all tokens are there. No state is compared with another.
    """
    runs = back.join(_stretches(states), ["article", "token_id"]).where("start < at")
    marks = F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("pos"), F.lit(-1).alias("d")))
    steps = runs.select("article", "at", F.explode(marks).alias("m")).groupBy("article", "at", "m.pos").agg(F.sum("m.d").alias("d"))
    along = Window.partitionBy("article", "at").orderBy("pos")
    held = steps.withColumns({"held": F.sum("d").over(along), "next": F.lead("pos").over(along)})
    return held.join(size, ["article", "at"]).where("held = n").groupBy("article", "at").agg((F.max("next") - 1).alias("whole"))


def revision_roles(revs: DataFrame, states: DataFrame, ops: DataFrame, last: DataFrame) -> DataFrame:
    """article, seq, role, restores_seq. A state is known by the number of its tokens and two sums of their hashes; a revision without tokens has an empty set."""
    one, two = F.xxhash64("token_id"), F.xxhash64(F.lit(1), "token_id")
    known = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(one).alias("x"), F.sum(two.cast("decimal(20,0)")).alias("s"))
    sets = states.select("article", "seq", "token_id").distinct().groupBy("article", "seq").agg(known.alias("state"))
    rows = revs.select("article", "seq").join(sets, ["article", "seq"], "left")
    rows = rows.join(last, "article").withColumn("revert_to", F.lag("seq").over(Window.partitionBy("article", "state").orderBy("seq")))
    back = ops.where("op = 'restored'").select("article", F.col("seq").alias("at"), "token_id")
    size = back.groupBy("article", "at").agg(F.count(F.lit(1)).alias("n"))
    whole = _last_with_all(back, size, states)
    rows = rows.join(size.select("article", F.col("at").alias("seq"), "n"), ["article", "seq"], "left").join(whole.withColumnRenamed("at", "seq"), ["article", "seq"], "left")
    role = F.when(F.col("seq") == 0, "stable_before").when(F.col("revert_to").isNotNull(), "revert").when(F.col("seq") == F.col("last_seq"), "consolidation").when(F.col("n") > 0, "restoration").when(F.col("seq") == 1, "initiating_change").otherwise("intermediate_change")
    rows = rows.withColumn("role", role)
    return rows.select("article", "seq", "role", F.when(F.col("role") == "revert", F.col("revert_to")).when(F.col("role") == "restoration", F.col("whole")).alias("restores_seq"))


def participation(standing: DataFrame, revs: DataFrame) -> DataFrame:
    """Shares of the editors that did most; null without tokens."""
    rows = standing.join(revs.select("article", "seq", "account"), ["article", "seq"]).groupBy("article", "kind", "account").agg(F.sum("tokens").alias("tokens"))
    rank = Window.partitionBy("article", "kind").orderBy(F.desc("tokens"), "account")
    rows = rows.withColumn("rank", F.row_number().over(rank))
    mine = lambda kind, c: F.when(F.col("kind") == kind, c)
    top = lambda kind, k: F.sum(mine(kind, F.when(F.col("rank") <= k, F.col("tokens"))))
    share = lambda kind, k: F.bround(top(kind, k) / F.sum(mine(kind, F.col("tokens"))), 6)
    name = lambda kind: F.max(mine(kind, F.when(F.col("rank") == 1, F.col("account"))))
    return rows.groupBy("article").agg(
        F.coalesce(F.sum(mine("removal", F.col("tokens"))), F.lit(0)).alias("removed_tokens"), F.coalesce(F.sum(mine("replacement", F.col("tokens"))), F.lit(0)).alias("replacement_tokens"),
        share("removal", 1).alias("top_removal_share"), share("replacement", 1).alias("top_replacement_share"), share("removal", 2).alias("top_two_removal_share"),
        F.coalesce(name("removal") == name("replacement"), F.lit(False)).alias("same_top_editor"),
    )


def event_status(ledger: DataFrame, standing: DataFrame) -> DataFrame:
    """reverted: there was activity, and nothing of it stands."""
    gross = ledger.groupBy("article").agg(F.sum("removed").alias("removed"), F.sum("added").alias("added"), F.sum("restored").alias("restored"))
    net = standing.groupBy("article").agg(F.sum("tokens").alias("net"))
    status = F.when(F.col("net").isNull() & (F.col("removed") + F.col("added") > 0), "reverted").otherwise("standing")
    return gross.join(net, "article", "left").select("article", "removed", "added", "restored", F.coalesce("net", F.lit(0)).alias("net"), status.alias("event_status"))


def size_deltas(series: DataFrame) -> DataFrame:
    order = Window.partitionBy("article").orderBy("ts", "rev_id")
    return series.withColumn("size_delta", F.col("size") - F.lag("size").over(order))


def sequence_faults(revs: DataFrame, states: DataFrame) -> DataFrame:
    """Articles whose sequence can't be attributed: fewer than two revisions, repeated ids, times out of order, repeated tokens."""
    order = Window.partitionBy("article").orderBy("seq")
    back = F.col("ts") < F.lag("ts").over(order)
    own = revs.withColumn("back", F.coalesce(back, F.lit(False))).groupBy("article").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rev_id").alias("ids"), F.bool_or("back").alias("back"))
    twice = states.groupBy("article", "seq", "token_id").count().where("count > 1").select("article").distinct().withColumn("twice", F.lit(True))
    fault = F.when(F.col("n") < 2, "fewer than two revisions").when(F.col("ids") < F.col("n"), "repeated revision id").when(F.col("back"), "times out of order").when(F.col("twice"), "repeated token")
    return own.join(twice, "article", "left").select("article", fault.alias("fault")).where("fault is not null")


def bounded(revisions: DataFrame, windows: DataFrame) -> DataFrame:
    """The revisions from before_rev to after_rev, numbered, with the window's length in seconds."""
    at = revisions.select("article", "rev_id", "ts")
    ends = windows.join(at.select("article", F.col("rev_id").alias("before_rev"), F.col("ts").alias("ts0")), ["article", "before_rev"]).join(at.select("article", F.col("rev_id").alias("after_rev"), F.col("ts").alias("ts1")), ["article", "after_rev"])
    order = Window.partitionBy("article", "before_rev", "after_rev").orderBy("ts", "rev_id")
    rows = ends.join(revisions, "article").where((F.struct("ts", "rev_id") >= F.struct("ts0", "before_rev")) & (F.struct("ts", "rev_id") <= F.struct("ts1", "after_rev")))
    return rows.withColumns({"seq": F.row_number().over(order) - 1, "seconds": F.unix_seconds(F.col("ts1").cast("timestamp")) - F.unix_seconds(F.col("ts0").cast("timestamp"))}).drop("ts0", "ts1")


#: Revert tags as wikis publish them.
REVERT_TAGS = ("mw-manual-revert", "mw-reverted", "mw-rollback", "mw-undo")


def revert_relationships(metadata: DataFrame) -> DataFrame:
    """Signals of a revert per revision: its tags, and a hash seen before; then the latest revision with that hash."""
    seen = F.lag("rev_id").over(Window.partitionBy("article", "sha1").orderBy("ts", "rev_id"))
    rows = metadata.withColumn("restores_rev", F.when(F.col("sha1").isNotNull(), seen))
    tags = F.array_intersect(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, REVERT_TAGS)))
    signals = F.concat(F.array_sort(tags), F.when(F.col("restores_rev").isNotNull(), F.array(F.lit("sha1_restoration"))).otherwise(F.array().cast("array<string>")))
    return rows.select("article", "rev_id", F.array_join(signals, ",").alias("signals"), "restores_rev").where("signals <> ''")


SECTION = r"^/\*\s*(.*?)\s*\*/"


def section_of(comment: Column) -> Column:
    """The section that an edit summary names between /* and */ at its start; null if it names none."""
    return F.when(comment.rlike(SECTION), F.trim(F.regexp_extract(comment, SECTION, 1)))


def process_context(events: DataFrame, families: dict[str, DataFrame | None], hours: int = 24) -> DataFrame:
    """State of each evidence family around an event (event_id, article, start_ts, end_ts): observed, not_observed, or
    unavailable where the family has no table. families: name to a table with article, ts."""
    out = None
    for name in sorted(families):
        table = families[name]
        if table is None:
            part = events.select("event_id", F.lit(name).alias("family"), F.lit("unavailable").alias("state"), F.lit(None).cast("long").alias("n"))
        else:
            part = near(events, table, hours).groupBy("event_id").agg(F.count("ts").alias("n")).select("event_id", F.lit(name).alias("family"), F.when(F.col("n") > 0, "observed").otherwise("not_observed").alias("state"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def near(events: DataFrame, table: DataFrame, hours: int = 0) -> DataFrame:
    """event_id and the columns of table (article, ts and others) for its rows of the event's article within so many hours of it; events without one have nulls."""
    wide = F.expr(f"interval {hours} hours")
    ends = events.select("event_id", F.col("article").alias("_a"), F.col("start_ts").alias("_from"), F.col("end_ts").alias("_to"))
    within = (F.col("article") == F.col("_a")) & (F.col("ts") >= F.col("_from") - wide) & (F.col("ts") <= F.col("_to") + wide)
    return ends.join(table, within, "left").select("event_id", *table.columns)


#: Hours around an event in which its talk page counts.
TALK_HOURS = 24
#: Templates that speak of a dispute.
DISPUTES = r"(?i)disput|pov|contentious|neutrality|merge|split"
#: Families of evidence; there is no public source for arbitration.
FAMILIES = ("revision_activity", "revert_relationships", "talk_activity", "page_operations", "protection", "dispute_templates", "arbitration")


def revision_items(events: DataFrame, metadata: DataFrame, talk: bool = False) -> DataFrame:
    """event_id, at, item of revisions (article, rev_id, parent_id, ts, account, comment, tags, sha1, size) of the event's time; talk: those of the talk page, in the day
    before and after too. metadata's article is the page that is talked about."""
    rows = near(events, metadata, TALK_HOURS if talk else 0).where("rev_id is not null")
    page = F.concat(F.lit("Talk:"), "article") if talk else F.col("article")
    own = [F.col("rev_id").alias("revision_id"), "ts", F.coalesce("account", F.lit("<hidden>")).alias("account"), F.coalesce("comment", F.lit("")).alias("comment"), section_of(F.col("comment")).alias("section"), F.array_sort(F.coalesce("tags", F.array().cast("array<string>"))).alias("tags")]
    own += [] if talk else ["parent_id", "sha1", "size"]
    return rows.select("event_id", F.col("rev_id").alias("at"), F.to_json(F.struct(*own, T.oldid_address(page, F.col("rev_id")).alias("source_url"))).alias("item"))


def revert_items(events: DataFrame, metadata: DataFrame) -> DataFrame:
    """event_id, at, item of revisions of the event's time that restore another of them or are tagged as reverts."""
    rows = near(events, metadata).where("rev_id is not null")
    signs = revert_relationships(rows.drop("article").withColumnRenamed("event_id", "article")).withColumnRenamed("article", "event_id")
    named = signs.join(rows.select("event_id", "rev_id", "parent_id", "article"), ["event_id", "rev_id"])
    item = F.struct(F.col("rev_id").alias("revision_id"), "parent_id", F.col("restores_rev").alias("restores_revision_id"), F.split("signals", ",").alias("signals"), T.oldid_address(F.col("article"), F.col("rev_id")).alias("source_url"))
    return named.select("event_id", F.col("rev_id").alias("at"), F.to_json(item).alias("item"))


def operation_items(events: DataFrame, log: DataFrame) -> DataFrame:
    """event_id, at, item of the page's log (article, log_id, ts, type, action, account, comment) in the event's time."""
    rows = near(events, log).where("log_id is not null")
    return rows.select("event_id", F.col("log_id").alias("at"), F.to_json(F.struct("log_id", "ts", "type", "action", F.coalesce("account", F.lit("<hidden>")).alias("account"), F.coalesce("comment", F.lit("")).alias("comment"))).alias("item"))


def protection_items(events: DataFrame, protection: DataFrame) -> DataFrame:
    """event_id, at, item of what protects the page now. protection: article, type, level, expiry."""
    rows = events.select("event_id", "article").join(protection, "article")
    return rows.select("event_id", F.xxhash64("type", "level", "expiry").alias("at"), F.to_json(F.struct("type", "level", "expiry", T.page_address(F.col("article")).alias("source_url"))).alias("item"))


def dispute_items(events: DataFrame, texts: DataFrame) -> DataFrame:
    """event_id, at, item of templates that speak of a dispute in the revision after the event (after_rev). texts: article, rev_id, text."""
    rows = events.select("event_id", "article", F.col("after_rev").alias("rev_id")).join(texts.select("article", "rev_id", "text"), ["article", "rev_id"])
    names = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\{\{\s*([^{}|<>]+)"), F.lit(1)), lambda n: F.trim(n)))
    rows = rows.withColumn("title", F.explode(F.filter(names, lambda n: n.rlike(DISPUTES))))
    return rows.select("event_id", F.xxhash64("title").alias("at"), F.to_json(F.struct("title", F.col("rev_id").alias("revision_id"), T.oldid_address(F.col("article"), F.col("rev_id")).alias("source_url"))).alias("item"))


def process_receipts(events: DataFrame, sources: dict[str, Callable[[], DataFrame] | str | None]) -> tuple[DataFrame, DataFrame]:
    """(receipts: event_id, family, status, reason, n; items: event_id, family, at, item as JSON) for every event and family.

    events: event_id (unique), article, start_ts, end_ts, after_rev. sources: for a family, a function that gives its items (see above), or the reason why
    there are none. Each family is read apart: one whose function or plan fails is unavailable for all events, with the error as its
    reason, and the others stay. Reverts are read from the revisions and share their failure. A family without a source is unavailable.
    """
    spark, parts, reasons = events.sparkSession, {}, {}
    for family in FAMILIES:
        source = sources.get(family)
        if not callable(source):
            reasons[family] = source or "no source"
            continue
        try:
            found = source().select("event_id", F.lit(family).alias("family"), F.col("at").cast("long").alias("at"), "item")
            parts[family] = settled(found, f"evidence-{family}")
        except Exception as e:  # noqa: BLE001  a source may fail in any way; the others mustn't
            reasons[family] = f"{family} failed: {(str(e).splitlines() or [''])[0][:300]}"
    if "revision_activity" in reasons and reasons["revision_activity"] != "no source":
        reasons["revert_relationships"] = reasons["revision_activity"]
        parts.pop("revert_relationships", None)
    empty = spark.createDataFrame([], "event_id string, family string, at long, item string")
    items = reduce(DataFrame.unionByName, parts.values()) if parts else empty.withColumn("event_id", F.col("event_id").cast(events.schema["event_id"].dataType))
    states = spark.createDataFrame([(f, reasons.get(f)) for f in FAMILIES], "family string, reason string")
    counts = items.groupBy("event_id", "family").agg(F.count(F.lit(1)).alias("n"))
    rows = events.select("event_id", F.explode(F.array(*map(F.lit, FAMILIES))).alias("family")).join(F.broadcast(states), "family").join(counts, ["event_id", "family"], "left")
    status = F.when(F.col("reason").isNotNull(), "unavailable").when(F.col("n") > 0, "observed").otherwise("not_observed")
    return rows.select("event_id", "family", status.alias("status"), "reason", F.when(F.col("reason").isNull(), F.coalesce("n", F.lit(0))).alias("n")), items

"""Process receipts family by family, sections of comments, addresses, and greedy windows, stance shifts and samples against plain versions."""

import json
import random
import urllib.parse

from pyspark.sql import functions as F

from driftloom.functions import text as T
from driftloom.operators import attribution as at
from driftloom.operators import drift, editions, stance

EVENTS = "event_id int, article string, start_ts timestamp, end_ts timestamp, after_rev long"


def events(spark):
    rows = spark.createDataFrame([(1, "A b", "2020-01-02 00:00:00", "2020-01-04 00:00:00", 13), (2, "C", "2020-01-02 00:00:00", "2020-01-04 00:00:00", 99)], "event_id int, article string, s string, e string, after_rev long")
    return rows.select("event_id", "article", F.col("s").cast("timestamp").alias("start_ts"), F.col("e").cast("timestamp").alias("end_ts"), "after_rev")


def metadata(spark):
    rows = [(10, 9, 1, "u", "x", [], "s1"), (11, 10, 2, None, "/* Early life */ fix", ["mw-undo", "b"], "s2"), (12, 11, 3, "v", "no /* section */", None, "s1"), (13, 12, 4, "v", None, [], "s2"), (14, 13, 6, "w", "late", [], "s2")]
    df = spark.createDataFrame(rows, "rev_id long, parent_id long, d int, account string, comment string, tags array<string>, sha1 string")
    return df.select(F.lit("A b").alias("article"), "rev_id", "parent_id", F.expr("timestamp '2020-01-01' + make_interval(0, 0, 0, d - 1)").alias("ts"), "account", "comment", "tags", "sha1", F.lit(5).alias("size"))


def test_receipts(spark):
    ev, meta = events(spark), metadata(spark)
    log = spark.createDataFrame([("A b", 5, "move", "move", None, None)], "article string, log_id long, type string, action string, account string, comment string").withColumn("ts", F.lit("2020-01-03").cast("timestamp"))
    guard = spark.createDataFrame([("A b", "edit", "sysop", "infinity")], "article string, type string, level string, expiry string")
    texts = spark.createDataFrame([("A b", 13, "{{Disputed|a}} {{ POV }} {{cite web|disputed}} {{POV}} {{Infobox\n|x=1}}"), ("C", 99, None)], "article string, rev_id long, text string")

    def broken():
        return meta.select(F.lit(1).alias("event_id"), F.lit(1).alias("at"), F.raise_error(F.lit("gone away")).cast("string").alias("item"))

    sources = {
        "revision_activity": lambda: at.revision_items(ev, meta), "revert_relationships": lambda: at.revert_items(ev, meta), "talk_activity": lambda: at.revision_items(ev, meta, talk=True),
        "page_operations": lambda: at.operation_items(ev, log), "protection": lambda: at.protection_items(ev, guard), "dispute_templates": lambda: at.dispute_items(ev, texts),
    }
    receipts, items = at.process_receipts(ev, sources)
    found = {(r.event_id, r.family): (r.status, r.n, r.reason) for r in receipts.collect()}
    assert found == {
        (1, "revision_activity"): ("observed", 3, None), (1, "revert_relationships"): ("observed", 2, None), (1, "talk_activity"): ("observed", 4, None), (1, "page_operations"): ("observed", 1, None),
        (1, "protection"): ("observed", 1, None), (1, "dispute_templates"): ("observed", 2, None), (1, "arbitration"): ("unavailable", None, "no source"),
        **{(2, f): ("not_observed", 0, None) for f in at.FAMILIES[:-1]}, (2, "arbitration"): ("unavailable", None, "no source"),
    }
    shown = {(r.family, r.at): json.loads(r.item) for r in items.collect()}
    assert shown["revision_activity", 11]["section"] == "Early life" and shown["revision_activity", 11]["account"] == "<hidden>" and "section" not in shown["revision_activity", 12]
    assert shown["revert_relationships", 13]["signals"] == ["sha1_restoration"] and shown["revert_relationships", 13]["restores_revision_id"] == 11 and shown["revert_relationships", 11]["signals"] == ["mw-undo"]
    assert shown["talk_activity", 10]["source_url"].endswith("title=Talk:A_b&oldid=10")
    assert {x["title"] for (f, _), x in shown.items() if f == "dispute_templates"} == {"Disputed", "POV"}

    receipts, items = at.process_receipts(ev, sources | {"revision_activity": broken, "talk_activity": "not loaded", "protection": broken})
    states = {(r.family): (r.status, r.reason) for r in receipts.where("event_id = 1").collect()}
    assert states["talk_activity"] == ("unavailable", "not loaded") and states["page_operations"] == ("observed", None)
    assert states["revision_activity"][0] == states["revert_relationships"][0] == "unavailable" and states["revision_activity"][1] == states["revert_relationships"][1]
    assert states["revision_activity"][1].startswith("revision_activity failed: ") and states["protection"][1].startswith("protection failed: ")
    assert {r.family for r in items.select("family").distinct().collect()} == {"page_operations", "dispute_templates"}
    none, nothing = at.process_receipts(ev, {})
    assert none.where("status = 'unavailable'").count() == 14 and nothing.count() == 0


def test_addresses(spark):
    titles = ["A b", "É (x): y/z", "a+b&c=d*~-._!'\"", "100% #1?", "日本"]
    found = spark.createDataFrame([(t, 7) for t in titles], "t string, n long").select("t", T.page_address(F.col("t")).alias("p"), T.oldid_address(F.col("t"), F.col("n"), "de").alias("o")).collect()
    quoted = {t: urllib.parse.quote(t.replace(" ", "_"), safe="():/") for t in titles}
    assert {r.t: r.p for r in found} == {t: f"https://en.wikipedia.org/wiki/{q}" for t, q in quoted.items()}
    assert {r.t: r.o for r in found} == {t: f"https://de.wikipedia.org/w/index.php?title={q}&oldid=7" for t, q in quoted.items()}


def plain_role(sets, n):
    """The last earlier state with all tokens that state n has put back."""
    seen = set().union(*sets[:n])
    back = (sets[n] - sets[n - 1]) & seen
    return max((k for k in range(n) if back <= sets[k]), default=None) if back else None


def test_restored_states(spark):
    r = random.Random(6)
    rows, revs, sequences = [], [], {}
    for a in range(12):
        sets = [set(r.sample(range(12), 8))]
        for _ in range(14):
            sets.append(set(r.choice(sets)) if r.random() < 0.2 else {t for t in sets[-1] if r.random() < 0.7} | {t for t in range(12) if r.random() < 0.25})
        sequences[f"a{a}"] = sets
        rows += [(f"a{a}", n, t) for n, s in enumerate(sets) for t in s]
        revs += [(f"a{a}", n) for n in range(len(sets))]
    states, last = spark.createDataFrame(rows, "article string, seq int, token_id long"), spark.createDataFrame([(a, 14) for a in sequences], "article string, last_seq int")
    found = {(x.article, x.seq): (x.role, x.restores_seq) for x in at.revision_roles(spark.createDataFrame(revs, "article string, seq int"), states, at.token_operations(states, last), last).collect()}
    for a, sets in sequences.items():
        for n, s in enumerate(sets):
            same = [k for k in range(n) if sets[k] == s]
            want = ("stable_before", None) if n == 0 else ("revert", same[-1]) if same else ("consolidation", None) if n == 14 else None
            if want is None:
                whole = plain_role(sets, n)
                put_back = (s - sets[n - 1]) & set().union(*sets[:n])
                want = ("restoration", whole) if put_back else ("initiating_change", None) if n == 1 else ("intermediate_change", None)
            assert found[a, n] == want
    assert {role for role, _ in found.values()} >= {"revert", "restoration"} and any(role == "restoration" and x is not None for role, x in found.values())


def test_non_overlapping(spark):
    r = random.Random(2)
    rows = [(f"a{r.randrange(4)}", s := r.randrange(60), s + r.randrange(1, 20), r.randrange(30)) for _ in range(90)]
    rows = sorted({(a, s): (a, s, e, m) for a, s, e, m in rows}.values())
    blocked = [("a0", 10, 20), ("a0", 40, 41), ("a1", 0, 9)]
    day = lambda c: F.date_add(F.lit("2010-01-01").cast("date"), F.col(c))
    df = spark.createDataFrame(rows, "article string, s int, e int, pwr_mass long").select("article", day("s").alias("start_date"), F.col("s").cast("long").alias("start_rev"), day("e").alias("end_date"), F.col("e").cast("long").alias("end_rev"), "pwr_mass", F.lit(1.0).alias("peak_pct"))
    out = spark.createDataFrame(blocked, "article string, s int, e int").select("article", day("s").alias("start_date"), day("e").alias("end_date"))
    for used, given in (([], None), (blocked, out)):
        want = []
        for a, s, e, m in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):
            if all(not (s < y and x < e) for b, x, y, *_ in [*used, *want] if b == a):
                want.append((a, s, e, m))
        assert sorted((x.article, x.start_rev, x.end_rev, x.pwr_mass) for x in drift.non_overlapping(df, given).collect()) == sorted(want)


def test_evenly_sampled(spark):
    sizes, most = {"a": 3, "b": 4, "c": 7, "d": 25, "e": 100, "f": 2, "g": 49}, 3
    df = spark.createDataFrame([(a, k) for a, n in sizes.items() for k in range(n)], "article string, rev_id long")
    for most in (2, 3, 12):
        want = {(a, k) for a, n in sizes.items() for k in (range(n) if n <= most else {int(i * (n / most)) for i in range(most)} | {n - 1})}
        assert {tuple(x) for x in editions.evenly_sampled(df, "rev_id", most).collect()} == want


def test_halves_go_to_even(spark):
    counts = spark.createDataFrame([("a", "news", 1), ("a", "book", 7), ("b", "web", 3), ("b", "book", 5), ("b", "other", 9)], "article string, name string, n long")
    assert sorted(map(tuple, editions.cite_mix(counts).collect())) == [("a", "book", round(87.5)), ("a", "news", round(12.5)), ("b", "book", round(62.5)), ("b", "web", round(37.5))]


def test_stance_shifts(spark):
    summaries = spark.createDataFrame([("a", "e", 1, "support"), ("a", "e", 3, "oppose"), ("a", "e", 2, "odd"), ("b", "e", 1, "neutral")], "article string, entity string, revision_id long, label string")
    steps = spark.createDataFrame([("a", "e", True), ("a", "e", False), ("a", "e", True)], "article string, entity string, audited_shift boolean")
    found = {x.article: (x.start, x.end, x.n, x.audited, x.shifted) for x in stance.stance_shifts(summaries, steps).collect()}
    value = lambda label: stance.VALUES.get(label, 0)
    assert found == {"a": (value("support"), value("oppose"), 3, 2, True), "b": (value("neutral"), value("neutral"), 1, 0, False)}

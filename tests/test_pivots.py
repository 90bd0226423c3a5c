"""Trajectories, pivots and export states on small cases; mscore against every revision between."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

from driftloom.operators import claims, pivots, prerank
from driftloom.operators import provenance as pv

CONFIRMED = "article string, status string, reason string, is_fresh boolean, trust string"


def test_export_state(spark):
    held = spark.createDataFrame(
        [("a", "confirmed", None, True, "published"), ("b", "rejected", "too small", True, "published"), ("c", "rejected", None, True, "published"), ("d", "confirmed", None, True, "published"),
         ("e", "confirmed", None, False, "published"), ("f", "confirmed", None, True, "stale"), ("g", None, None, None, None), ("h", "rejected", None, True, "published")], CONFIRMED
    )
    pairs = spark.createDataFrame([("a", 1, 2), ("a", 3, 4), ("c", 1, 2), ("h", 1, 2)], "article string, before_rev long, after_rev long")
    texts = spark.createDataFrame([("a", 1, "x"), ("a", 2, ""), ("a", 3, "x"), ("c", 1, "x"), ("c", 2, None), ("h", 1, "x"), ("h", 2, "y")], "article string, rev_id long, text string")
    found = {r["article"]: (r["state"], r["reason"]) for r in pivots.export_state(held, pivots.materialized_pivots(pairs, texts)).collect()}
    assert found == {
        "a": ("unavailable", "pairs_unavailable: 1→2, 3→4"), "b": ("none", "too small"), "c": ("unavailable", "pairs_unavailable: 1→2"),
        "d": ("unavailable", "pairs_unavailable: none"), "e": ("unavailable", "confirmation_stale"), "f": ("unavailable", "withheld: stale"),
        "g": ("unavailable", "receipt_missing"), "h": ("finding", "redlines_available"),
    }


def test_trajectory(spark):
    snaps = spark.sql("select * from values ('a', date '2020-01-01', 1L), ('a', date '2020-07-01', 2L), ('a', date '2021-01-01', 3L), ('a', date '2021-07-01', 4L), ('b', date '2020-01-01', 1L) t(article, snap_date, snap_rev)")
    ends = spark.sql("select * from values ('a', date '2021-01-01', 3L), ('b', date '2020-01-01', 1L), ('c', null, null), ('d', date '2020-01-01', 5L) t(article, snap_date, snap_rev)")
    rows = lambda *args: sorted((r["article"], r["reason"] or "", r["snap_rev"]) for r in pivots.trajectory_selection(snaps, ends, *args).collect())
    none = [("c", "endpoint_unstable", None), ("d", "endpoint_unusable", None)]
    assert rows() == [("a", "", 1), ("a", "", 2), ("a", "", 3), ("b", "too_few_revisions", None), *none]
    assert rows("interval", "2020-06-01", "2022-01-01")[:2] == [("a", "", 2), ("a", "", 3)]
    assert rows("interval", "2021-06-01", "2022-01-01")[0] == ("a", "too_few_revisions", None)


def test_editions_and_pivots(spark):
    links = spark.createDataFrame([(1, s, "T") for s in ("enwiki", "dewiki", "commonswiki", "enwikiquote", "wikidatawiki")], "item int, site string, title string")
    assert {r["lang"] for r in pivots.edition_map(links).collect()} == {"en", "de"}
    assert [r["lang"] for r in pivots.edition_map(links, ["de", "fr"]).collect()] == ["de"]
    held = spark.sql("select * from values ('a', 'confirmed', true, date '2010-01-01'), ('b', 'rejected', true, null), ('c', 'confirmed', false, date '2010-01-01'), ('d', 'rejected', false, null) t(article, status, is_fresh, start)")
    episodes = spark.sql("select * from values ('a', date '2015-01-01', 3.0D, 1), ('c', date '2012-02-29', 2.0D, 2), ('c', date '2011-01-01', 2.0D, 3) t(article, start, age_years, rank)")
    found = {r["article"]: (str(r["pivot"]), r["source"]) for r in pivots.pivot_choice(held, held, episodes, "2023-10-01").collect()}
    assert found == {"a": ("2010-01-01", "confirmed"), "b": ("None", "rejected"), "c": ("2012-02-29", "candidate"), "d": ("2023-10-01", "fallback")}
    before = {r["article"]: str(r["before"]) for r in pivots.before_date(held, episodes, "2022-07-01").collect()}
    assert (before["a"], before["c"], before["d"]) == ("2013-01-01", "2010-02-28", "2022-07-01")


def test_mscore(spark):
    rng = random.Random(3)
    rows = [(f"a{i % 3}", k, f"u{rng.randrange(6)}", rng.choice("xyzvw") if rng.random() < 0.7 else f"s{k}") for i in range(3) for k in range(i, 240, 3)]
    got = {r["article"]: (r["revs"], r["mutual_pairs"], r["m"]) for r in prerank.mscore(spark.createDataFrame(rows, "article string, k0 int, user string, sha1 string")).collect()}
    for article in got:
        own = [(u, s) for a, _, u, s in sorted(rows, key=lambda r: r[1]) if a == article]
        first, taken = {}, {}
        for k, (u, s) in enumerate(own):
            f = first.setdefault(s, k)
            for other in {x for x, _ in own[f + 1 : k]} - {u}:
                taken[u, other] = taken.get((u, other), 0) + 1
        pairs = [(a, b) for (a, b), n in taken.items() if a < b and n >= 2 and taken.get((b, a), 0) >= 2]
        edits = {u: sum(x == u for x, _ in own) for u, _ in own}
        assert got[article] == (len(own), len(pairs), len({u for p in pairs for u in p}) * sum(min(edits[a], edits[b]) for a, b in pairs))
        assert pairs


def plain_redline(before, after, wb, wa):
    """Steps with the majority author of each piece's words, the first among equals."""
    cut = lambda t: [x for x in re.split(r"(?<=[.!?])[ \t\n\f\r]+", (t or "").strip(" ")) if x]

    def author(piece, words):
        known = [words[w] for w in re.findall("[a-z]{3,}", piece.lower()) if w in words]
        return Counter(known).most_common(1)[0][0] if known else None

    a, b = cut(before), cut(after)
    steps = [x for x in SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if x[0] != "equal"]
    pieces = [(tag, " ".join(a[i:j]), " ".join(b[x:y])) for tag, i, j, x, y in steps]
    return [(k, tag, gone, come, author(gone, wb), author(come, wa)) for k, (tag, gone, come) in enumerate(pieces)]


def test_redline(spark):
    rng = random.Random(4)
    words = "the old wall Über stone near garden x fox12 of was RAIN".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 8))) + rng.choice(".!?")
    rows, tokens, state = [], [], [sentence() for _ in range(9)]
    for n in range(1, 9):
        text = rng.choice([" ", "\n", "  "]).join(state) if n != 5 else None
        rows.append(("a", n, text))
        tokens += [("a", n, k, w, f"u{rng.randrange(3)}") for k, w in enumerate(re.findall(r"\w+", text or ""))]
        for _ in range(3):
            at = rng.randrange(len(state))
            state[at : at + 1] = rng.choice([[], [sentence()], [state[at], sentence()]])
    texts = spark.createDataFrame(rows, "article string, rev_id long, text string")
    authors = claims.word_authors(spark.createDataFrame(tokens, "article string, rev_id long, pos int, str string, author string"), ("article", "rev_id")).cache()
    known = {}
    for r in authors.collect():
        known.setdefault(r.rev_id, {})[r.word] = r.author
    text = lambda side: texts.select("article", texts.rev_id.alias(f"{side}_rev"), texts.text.alias(f"{side}_text"))
    pairs = claims.revision_pairs(texts).join(text("before"), ["article", "before_rev"]).join(text("after"), ["article", "after_rev"])
    found = claims.redline(pairs, authors).orderBy("before_rev", "step").collect()
    want = [(n, *x) for n in range(1, 8) for x in plain_redline(rows[n - 1][2], rows[n][2], known.get(n, {}), known.get(n + 1, {}))]
    assert [(r.before_rev, r.step, r.tag, r.removed, r.added, r.removed_author, r.added_author) for r in found] == want
    assert {r.tag for r in found} == {"replace", "insert", "delete"}
    bare = claims.redline(pairs, equal=True)
    assert bare.columns == [*claims.PAIR, "step", "tag", "removed", "added"] and bare.where("tag = 'equal' and removed = added").count() > 0
    authors.unpersist()


def test_authors_from_token_provenance(spark):
    rows = [("a", 1, "Stone wall here. Rain.", "ann"), ("a", 2, "Stone wall here. Rain fell on stone.", "bob"), ("a", 3, "Rain! Fell on stone.", None)]
    revisions = spark.createDataFrame(rows, "article string, rev_id long, text string, user string")
    authors = claims.revision_word_authors(pv.states(pv.token_provenance(revisions)), revisions)
    found = {(r.rev_id, r.word): r.author for r in authors.collect()}
    assert (found[2, "stone"], found[2, "fell"], found[3, "fell"]) == ("ann", "bob", "bob")
    pairs = spark.createDataFrame([("a", 1, 2, 1), ("a", 2, 9, 2)], "article string, before_rev long, after_rev long, place int")
    shown = {r.place: r for r in pivots.materialized_pivots(pairs, revisions.select("article", "rev_id", "text"), authors).collect()}
    assert shown[1].available and shown[1].after_text == rows[1][2] and shown[1].authors_after["fell"] == "bob" and shown[1].authors_before == {"stone": "ann", "wall": "ann", "here": "ann", "rain": "ann"}
    assert not shown[2].available and shown[2].authors_after == {}
    missing = pivots.unavailable_pairs(pivots.materialized_pivots(pairs, revisions.select("article", "rev_id", "text")))
    assert [(r.article, r.pairs) for r in missing.collect()] == [("a", ["2→9"])]


def test_exact_selection(spark):
    named = spark.createDataFrame([("a", 1, 30), ("a", 2, 10), ("a", 3, 20), ("b", 1, 10), ("c", 1, 10), ("c", 2, 10), ("d", 1, 10), ("d", 2, 11), ("d", 3, 12)], "article string, place int, rev_id long")
    texts = spark.createDataFrame([(x, n, f"Same line here. Only {n}.") for x, n in (("a", 10), ("a", 20), ("a", 30), ("b", 10), ("c", 10), ("d", 10))] + [("d", 12, None)], "article string, rev_id long, text string")
    found = pivots.exact_selection(named, texts)
    assert sorted((r.article, r.reason or "", r.place or 0, r.rev_id or 0) for r in found.collect()) == [("a", "", 1, 30), ("a", "", 2, 10), ("a", "", 3, 20), ("b", "too_few_revisions", 0, 0), ("c", "repeated_revision", 0, 0), ("d", "revision_unavailable:11", 0, 0)]
    pairs = pivots.selected_pairs(found)
    assert sorted(map(tuple, pairs.collect())) == [("a", 10, 20), ("a", 30, 10)]  # in the caller's order
    changes = claims.claim_transition(claims.claim_units(texts.where("text is not null")), pairs).collect()
    assert sorted((r.before_rev, r.after_rev, r.retained, r.added, r.removed) for r in changes) == [(10, 20, 1, 1, 1), (30, 10, 1, 1, 1)]


def test_fallbacks_by_article(spark):
    held = spark.sql("select * from values ('a', 'rejected', false, null), ('b', 'rejected', false, null), ('c', 'confirmed', true, date '2010-01-01') t(article, status, is_fresh, start)")
    episodes = spark.createDataFrame([], "article string, start date, age_years double, rank int")
    dates = spark.sql("select * from values ('a', date '2015-01-01'), ('c', date '2016-01-01') t(article, date)")
    assert {r["article"]: (str(r["pivot"]), r["source"]) for r in pivots.pivot_choice(held, held, episodes, dates).collect()} == {"a": ("2015-01-01", "fallback"), "b": ("None", "fallback"), "c": ("2010-01-01", "confirmed")}
    assert {r["article"]: str(r["before"]) for r in pivots.before_date(held, episodes, dates).collect()} == {"a": "2015-01-01", "b": "None", "c": "2016-01-01"}


def test_redline_deals_out_no_words(spark):
    """Authors come to a pair as two maps: after the differences nothing is joined or dealt out."""
    pairs = spark.createDataFrame([("a", 1, 2, "Old wall. Rain.", "Old wall. Snow now.")], "article string, before_rev long, after_rev long, before_text string, after_text string")
    authors = spark.createDataFrame([("a", 1, "rain", "ann"), ("a", 2, "snow", "bob"), ("a", 2, "now", "cy")], "article string, rev_id long, word string, author string")
    found = claims.redline(pairs, authors)
    assert [(r.tag, r.removed_author, r.added_author) for r in found.collect()] == [("replace", "ann", "bob")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 2

"""Steps whose shuffles or memory once grew faster than their input."""

import os
import re

from pyspark.sql import functions as F

from driftloom.operators import drift, pivots
from driftloom.operators.membership import membership


def exchanges(df, capsys):
    capsys.readouterr()
    df.explain()
    return len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", capsys.readouterr().out))


def test_materialized_texts_move_once(spark, capsys):
    """Texts and authors that are dealt out by article stay where they are; equal pairs, missing revisions and empty texts count."""
    texts = spark.createDataFrame([("a", 1, "one"), ("a", 2, "two"), ("b", 1, ""), ("b", 2, "four")], "article string, rev_id long, text string").repartition(3, "article")
    words = texts.select("article", "rev_id", F.explode(F.split("text", " ")).alias("word"), F.lit("u").alias("author")).where("word <> ''")
    pairs = spark.createDataFrame([("a", 1, 2, 7), ("a", 1, 2, 7), ("a", 2, 2, 8), ("a", 2, 9, None), ("b", 1, 2, 9), ("c", 1, 2, 1)], "article string, before_rev long, after_rev long, place int")
    df = pivots.materialized_pivots(pairs, texts, words, 3)
    assert exchanges(df, capsys) == 3  # texts, words, ends
    found = sorted(((r.article, r.before_rev, r.after_rev, r.place or 0, r.before_text, r.after_text, r.available, r.authors_before, r.authors_after) for r in df.collect()), key=str)
    assert found == [
        ("a", 1, 2, 7, "one", "two", True, {"one": "u"}, {"two": "u"}), ("a", 1, 2, 7, "one", "two", True, {"one": "u"}, {"two": "u"}),
        ("a", 2, 2, 8, "two", "two", True, {"two": "u"}, {"two": "u"}), ("a", 2, 9, 0, "two", None, False, {"two": "u"}, {}),
        ("b", 1, 2, 9, "", "four", False, {}, {"four": "u"}), ("c", 1, 2, 1, None, None, False, {}, {}),
    ]


def test_membership_stays_where_it_is(spark, capsys):
    """Tokens that are dealt out aren't dealt out again, nor held in a hash table; repeated rows count once."""
    rows = [("a", day, rev, t) for day, rev, tokens in (("2001-01-01", 5, "xyx"), ("2002-01-01", 3, "y"), ("2003-01-01", 9, "xyy")) for t in tokens]
    rsnap = spark.createDataFrame(rows, "article string, snap_date string, snap_rev long, token_id string").withColumn("snap_date", F.to_date("snap_date")).repartition(3, "article", "token_id")
    df = membership(rsnap)
    assert exchanges(df, capsys) == 1
    df.explain()
    assert "HashAggregate" not in capsys.readouterr().out
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("a", 0, "x", 1, None, 2), ("a", 0, "y", 1, None, 1), ("a", 1, "y", 2, 0, 2), ("a", 2, "x", 2, 0, None), ("a", 2, "y", 3, 1, None)], key=str)


def test_shipments_come_in_parts_of_bounded_size(spark):
    from driftloom.plans.bindings import Views

    v = Views(spark, "/root/testdata/sf0.001")
    n = v.table("lineitem").count()
    assert v._shipments(20, n // 7).rdd.getNumPartitions() == 1 + n // (n // 7)


def test_footprint_goes_in_parts(spark, monkeypatch):
    """Seeds of few bytes that make many rows don't make them in one task."""
    from driftloom.operators import discovery

    monkeypatch.setattr(discovery, "PART_ROWS", 10, raising=False)
    contribs = spark.createDataFrame([(f"u{e}", f"t{t}", -2000) for e in range(3) for t in range(5)], "editor string, title string, sizediff long")
    seeds = spark.createDataFrame([(f"a{k}", f"u{k % 3}") for k in range(12)] + [("a0", "u1"), ("a0", "u1")], "article string, editor string")
    tested = spark.createDataFrame([("t4",)], "title string")
    made = discovery.removal_footprint(contribs, seeds, tested)
    assert made.rdd.getNumPartitions() == 6  # 13 seeds of 4 titles each: 52 rows
    found = {(r.article, r.title): (r.editors, r.removed, r.edits) for r in made.collect()}
    assert len(found) == 48 and found["a0", "t1"] == (2, 4000, 2) and found["a5", "t0"] == (1, 2000, 1)


def test_candidates_without_the_words_are_not_compared(monkeypatch):
    """A passage near an item in the latent space whose text lacks the item's words costs no comparison; others are found as before."""
    import numpy as np
    import pyarrow as pa

    from driftloom.llm import lsa_decontam as L

    space = L.Space(np.ones((L.BUCKETS, 4), np.float32))  # all are alike
    asked = []
    share = L.Items.share
    monkeypatch.setattr(L.Items, "share", lambda self, k, *rest: asked.append(k) or share(self, k, *rest))
    item, empty = "one two three four five six seven eight nine ten", "alpha beta gamma delta epsilon zeta eta theta iota"
    monkeypatch.setattr(L.F, "arrow_udf", lambda kind: lambda f: f)
    monkeypatch.setattr(L, "small_batches", lambda *_: None)
    texts = pa.array([f"so {item} it is", "nothing of it is here " * 9, None, item.replace("two ", "").replace("six", "6")])
    found = next(iter(L.found_column(iter([texts]), [(1, item), (2, empty), (3, "")], space)))
    assert [[(x["item"], x["share"]) for x in row] for row in found.to_pylist()] == [[(1, 1.0)], [], [], [(1, 0.8)]]
    assert set(asked) == {0}


def test_tokens_of_other_snapshots_are_not_dealt_out(spark, capsys):
    """A spine meets the tokens of its windows' ends alone, which a small table of ends picks."""
    member = spark.createDataFrame([("a", k, t) for k, tokens in enumerate(("xyz", "xz", "x", "xyz")) for t in tokens], "article string, k int, token_id string")
    windows = spark.createDataFrame([("a", 0, 2)], "article string, k int, end_k int")
    df = drift.endpoint_refine(member.where("k = 0"), member, windows)
    assert [tuple(r) for r in df.collect()] == [("a", 0, 2, 3, 1 - 1 / 3)]
    df.explain()
    assert "LeftSemi" in capsys.readouterr().out


def claims_of_dealt_texts(spark):
    from driftloom.operators import claims

    rows = [("a", 1, "Old walls stand. A cat sleeps on the warm stone."), ("a", 2, "Old walls stood. A cat sleeps on the warm stones. New."), ("a", 3, "Old walls stood. New."), ("b", 1, "One."), ("b", 2, "One."), ("c", 1, None)]
    texts = spark.createDataFrame(rows, "article string, rev_id long, text string").repartition(3, "article")
    return claims.claim_units(texts), claims.revision_pairs(texts)


def stays_by_article(spark, capsys, df, before, most):
    """No table was put aside for df, and it deals out texts by article alone, most times at most."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) == before
    assert exchanges(df, capsys) <= most
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "REPARTITION_BY_NUM" not in line]


def test_alike_claims_of_a_pair_stay_by_article(spark, capsys):
    """What is left over of two revisions meets where their texts lie: nothing is put aside or dealt out by bands."""
    from driftloom.operators import claims

    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    df = claims.claim_match_fuzzy(*claims_of_dealt_texts(spark))
    assert stays_by_article(spark, capsys, df, before, 2) == []  # the texts, for units and for pairs
    assert [(r.article, r.before_rev, r.after_rev, r.i, r.j) for r in df.collect()] == [("a", 1, 2, 1, 1)]


def test_transitions_deal_out_counts_alone(spark, capsys):
    from driftloom.operators import claims

    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    df = claims.claim_transition(*claims_of_dealt_texts(spark))
    moved = stays_by_article(spark, capsys, df, before, 3)
    assert len(moved) == 1 and "before_rev" in moved[0]  # a row a pair, after its claims were summed up
    found = {(r.article, r.before_rev): (r.retained, r.relocated, r.added, r.removed) for r in df.collect()}
    assert found == {("a", 1): (1, 0, 2, 1), ("a", 2): (2, 0, 0, 1), ("b", 1): (1, 0, 0, 0)}


def test_persistence_deals_out_new_claims_alone(spark, capsys):
    """Claims that stand stay by article with their revisions; those that came are met there."""
    from driftloom.operators import claims

    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    df = claims.claim_persistence(*claims_of_dealt_texts(spark))
    stays_by_article(spark, capsys, df, before, 9)
    assert sorted((r.article, r.after_rev, r.persistence, r.standing) for r in df.collect()) == [("a", 2, 1, True), ("a", 2, 1, True)]


def test_likeness_is_that_of_difflib():
    import random
    from difflib import SequenceMatcher

    from driftloom.operators.claims import likeness

    r = random.Random(7)
    for n in range(3000):
        letters = r.choice(["ab", "abc d", "abcdefghijklm ß𝄞"])
        a = "".join(r.choice(letters) for _ in range(r.randrange(r.choice([3, 30, 230]))))
        b = list(a) if n % 3 else [r.choice(letters) for _ in range(r.randrange(40))]
        for _ in range(r.randrange(9)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(3)] = r.choice(["", "x", "ab"])
        assert likeness(a, "".join(b)) == SequenceMatcher(None, a, "".join(b)).ratio()


def test_redline_of_dealt_texts_deals_out_documents_alone(spark):
    """Both texts of a pair and the maps of their authors come from one deal of the documents."""
    from driftloom.plans import QUERIES

    plan = QUERIES["redline"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and all("REPARTITION_BY_NUM" in line for line in moved)
    assert "Join" not in plan


def dealt_in_parts(spark, query, folder="/root/testdata/sf0.01"):
    """Whether the documents of a query are dealt out once, into parts of about equal numbers of characters."""
    from driftloom.plans import QUERIES
    from driftloom.plans.bindings import Views

    parts = Views(spark, folder).text_parts()
    plan = QUERIES[query](spark, folder)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert parts > 2
    return len(moved) == 1 and f", {parts}), REPARTITION_BY_NUM" in moved[0]


def test_token_states_come_in_parts_of_bounded_size(spark):
    assert dealt_in_parts(spark, "token_states")


def test_token_lives_come_in_parts_of_bounded_size(spark):
    assert dealt_in_parts(spark, "token_lives")


def test_sentences_of_the_last_revision_are_not_cut_again(monkeypatch):
    from driftloom.operators import provenance as pv

    cut = []
    monkeypatch.setattr(pv, "_digest", lambda parts, own=pv._digest: cut.append(parts) or own(parts))
    ledger = pv.Ledger()
    for k, text in enumerate(("One two.\nThree! Four", "One two. Three! Five\n\nFour", "four")):
        assert ledger.add(k + 1, text, "so")
    assert [x for x in cut if x and isinstance(x[0], str) and len(x) < 4 and " " not in "".join(x)] == [["one", "two", "."], ["three", "!"], ["four"], ["five"], ["four"]]
    assert ledger.words == ["one", "two", ".", "three", "!", "four", "five"] and ledger.outs == {0: [3], 1: [3], 2: [3], 3: [3], 4: [3], 6: [3]} and ledger.ins == {}


def test_origins_are_counted_without_a_row_a_token(spark):
    import random

    from driftloom.operators import provenance as pv
    from driftloom.plans import QUERIES

    r = random.Random(5)
    rows = [(f"a{n % 3}", n, r.choice([None, "", "x."]) if n % 7 == 0 else " ".join(r.choice(["red.", "Blue", "wall\n\n", "stone", "old!"]) for _ in range(r.randrange(30)))) for n in range(60)]
    texts = spark.createDataFrame(rows, "article string, rev_id long, text string")
    found, want = pv.revision_origins(texts, parts=3), pv.origins_of(pv.token_provenance(texts, kinds=("state",)))
    assert found.dtypes == want.dtypes and sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert found.where("n_back > 0").count()
    plan = QUERIES["revision_origins"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1  # the drafts


def test_texts_of_few_words_are_aligned_without_difflib(monkeypatch):
    """Where very many places meet, neither a table of them is held nor each word walked through all its places."""
    import random
    from difflib import SequenceMatcher

    from driftloom.operators import provenance as pv

    r = random.Random(2)
    cells = lambda blocks: sorted((i + k, j + k) for i, j, n in blocks for k in range(n))
    cases = [([r.choice("abc"[: 1 + n % 3]) for _ in range(r.randrange(40))], [r.choice("abc") for _ in range(r.randrange(40))]) for n in range(300)]
    want = [cells(SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) for a, b in cases]
    monkeypatch.setattr(pv, "SequenceMatcher", None)
    long = ["so", "it", "is"] * 2000
    assert cells(pv.matching_blocks(long, [*long[:3000], "not", *long[3000:]])) == [(k, k + (k > 2999)) for k in range(6000)]
    monkeypatch.setattr(pv, "MEETINGS", 0)
    assert [cells(pv.matching_blocks(a, b)) for a, b in cases] == want

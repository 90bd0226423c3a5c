"""History exports, token provenance and what is computed from both, against plain versions."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from driftloom.operators import drift
from driftloom.operators import provenance as pv
from driftloom.operators.membership import membership
from driftloom.params import Params
from driftloom.plans import QUERIES
from driftloom.plans.bindings import Views
from driftloom.sources import export_files, history_tables, read_history

HEAD = '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.11/" version="0.11" xml:lang="en">\n  <siteinfo><sitename>W</sitename></siteinfo>\n  <page>\n    <title>{}</title>\n    <ns>0</ns>\n    <id>77</id>\n'


def escaped(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def revision(n, text, who="<username>A &amp; B</username>", extra="", day=None):
    return f'    <revision>\n      <id>{n}</id>\n      <parentid>{n - 1}</parentid>\n      <timestamp>{day or f"2020-01-{n:02}"}T00:00:00Z</timestamp>\n      <contributor>{who}</contributor>\n{extra}      <text xml:space="preserve">{escaped(text)}</text>\n    </revision>\n'


def export(title, revisions, closed=True):
    return HEAD.format(escaped(title)) + "".join(revisions) + ("  </page>\n</mediawiki>\n" if closed else "")


HIDDEN_TEXT = '    <revision>\n<id>3</id><timestamp>2020-01-03T00:00:00Z</timestamp><contributor deleted="deleted" /><text deleted="deleted" /></revision>\n'
HIDDEN_USER = '    <revision>\n<id>4</id><timestamp>2020-01-04T00:00:00Z</timestamp><contributor deleted="deleted" /><text xml:space="preserve">x</text></revision>\n'


@pytest.mark.parametrize("ranged", [True, False])
def test_read_history(spark, tmp_path, ranged):
    first = "  one <ref> two\n\nthree É </mediawiki> "
    (tmp_path / "a b.xml").write_text(export("A & b", [revision(1, first), revision(2, "x", "<ip>10.0.0.1</ip>", "      <minor />\n      <comment>c &amp; d</comment>\n"), HIDDEN_TEXT, HIDDEN_USER, revision(5, "")]))
    (tmp_path / "cut.xml").write_text(export("Cut", [revision(1, "a"), revision(2, "bbb")[:200]], closed=False))
    (tmp_path / "bad.xml").write_text(export("Bad", [revision(1, "a"), revision(2, "b").replace("<id>2</id>", "<id>x</id>")]))
    (tmp_path / "none.xml").write_text("<mediawiki>\n</mediawiki>\n")
    (tmp_path / "empty.xml").write_text("")
    revisions, faults = read_history(spark, str(tmp_path), ranged)
    found = {(r.article, r.rev_id): r for r in revisions.collect()}
    assert sorted(found) == [("A & b", 1), ("A & b", 2), ("A & b", 4), ("A & b", 5), ("Bad", 1)]
    a = found["A & b", 1]
    assert (a.parent_id, str(a.ts), a.user, a.anonymous, a.user_hidden, a.comment, a.minor, a.text, a.size) == (0, "2020-01-01 00:00:00", "A & B", False, False, None, False, first, len(first.encode()))
    b = found["A & b", 2]
    assert (b.user, b.anonymous, b.minor, b.comment) == ("10.0.0.1", True, True, "c & d")
    assert (found["A & b", 4].user, found["A & b", 4].user_hidden, found["A & b", 5].text, found["A & b", 5].size) == (None, True, "", 0)
    assert sorted((r.file.rsplit("/", 1)[1], r.reason, r.n) for r in faults.collect()) == [("bad.xml", "corrupt_record", 1), ("cut.xml", "truncated", 1), ("none.xml", "untitled", 1)]
    tables = history_tables(revisions.unionByName(revisions))
    assert {k: t.count() for k, t in tables.items()} == {"revisions": 5, "rev_size": 5, "revision_metadata": 5, "texts": 5}
    assert tables["revisions"].where("rev_id = 4").first()["user"] == "<hidden>"


def test_tails_are_read_alone(spark, tmp_path):
    """A closing tag outside the last bytes doesn't close a file."""
    (tmp_path / "a.xml").write_text(export("A", []) + " " * 300)
    (tmp_path / "b.xml").write_text(export("B", []))
    assert sorted((r.article, r.complete) for r in export_files(spark, str(tmp_path)).collect()) == [("A", False), ("B", True)]


def plain_provenance(history):
    """[(rev_id, [(token_id, word, origin)])] of revisions that count, and {token_id: (ins, outs)}; history: (rev_id, text, comment).

    Places of earlier revisions are looked through one by one, the last revision's first.
    """
    past, passed, out, ins, outs, names = [], set(), [], {}, {}, []
    size = 0
    for rev_id, text, comment in history:
        if text in passed or (not comment and size > 1000 > len(text) and len(text) < 0.6 * size):
            passed.add(text)
            continue
        now = [[[None, s] for s in p] for p in pv.structure(text)]
        last = past[-1] if past else []
        used = set()

        def reuse(wanted, places, words_of=lambda ids: [names[t][0] for t in ids]):
            return next((ids for ids in places if words_of(ids) == wanted and not used.intersection(ids)), None)

        for p in now:
            wanted = [s for _, s in p]
            for cand in [*last, *(q for rev in past for q in rev)]:
                if [[names[t][0] for t in ids] for ids in cand] == wanted and not used.intersection(t for ids in cand for t in ids):
                    for own, ids in zip(p, cand):
                        own[0] = ids
                        used.update(ids)
                    break
        rest = [ids for q in last for ids in q if not used.intersection(ids)]
        for p in now:
            for own in p:
                if own[0] is None:
                    own[0] = reuse(own[1], [*rest, *(ids for rev in past for q in rev for ids in q)])
                    used.update(own[0] or ())
        gone = [t for q in last for ids in q for t in ids if t not in used]
        places = [(own, k) for p in now for own in p if own[0] is None for k in range(len(own[1]))]
        words = [own[1][k] for own, k in places]
        got = [None] * len(words)
        for i, j, n in SequenceMatcher(None, [names[t][0] for t in gone], words, autojunk=False).get_matching_blocks():
            got[j : j + n] = gone[i : i + n]
        fresh = Counter(w for w, t in zip(words, got) if t is None)
        if fresh and sum(fresh.values()) / len(fresh) > 20:
            passed.add(text)
            continue
        for (own, k), t in zip(places, got):
            if t is None:
                t = len(names)
                names.append((own[1][k], rev_id))
                ins[t], outs[t] = [], []
            own[0] = (*(own[0] or ()), t)
        before = {t for q in last for ids in q for t in ids}
        past.append([[own[0] for own in p] for p in now])
        size = len(text)
        tokens = [t for q in past[-1] for ids in q for t in ids]
        for t in before - set(tokens):
            outs[t].append(rev_id)
        for t in set(tokens) - before:
            if names[t][1] != rev_id:
                ins[t].append(rev_id)
        out.append((rev_id, [(t, *names[t]) for t in tokens]))
    return out, {t: (ins[t], outs[t]) for t in ins}


def histories(seed, articles=6, length=14):
    """Random edits: words, sentences and paragraphs put in, taken out, moved, reverted and blanked."""
    r = random.Random(seed)
    for a in range(articles):
        word = lambda: r.choice(["Ab", "c", "d", "e'f", "[[g]]", "h1", "É", "the", "of"])  # noqa: B023, E731
        sentence = lambda: " ".join(word() for _ in range(r.randrange(1, 7))) + r.choice(".!?")  # noqa: B023, E731
        state = [[sentence() for _ in range(r.randrange(1, 4))] for _ in range(4)]
        past = []
        for n in range(1, length + 1):
            past.append([list(p) for p in state])
            k = r.randrange(9)
            if k == 0:
                state = [list(p) for p in r.choice(past)]
            elif k == 1 and state:
                state.pop(r.randrange(len(state)))
            elif k == 2:
                state.insert(r.randrange(len(state) + 1), list(r.choice(past[-1])) if past[-1] else [sentence()])
            elif k == 3:
                r.shuffle(state)
            else:
                for p in state:
                    if p and r.random() < 0.5:
                        at = r.randrange(len(p))
                        words = p[at].split()
                        words[r.randrange(len(words))] = word() + r.choice(["", "."])
                        p[at] = r.choice([" ".join(words), sentence(), p[at] + " " + sentence()])
            text = "\n\n".join(" ".join(p) for p in state)
            yield f"a{a}", n, "" if r.random() < 0.05 else text, r.choice([None, "c"])
        yield f"a{a}", length + 1, text + " " + " ".join(f"w{k}" for k in range(400)), None
        yield f"a{a}", length + 2, "gone", None  # passed over
        yield f"a{a}", length + 3, text + " spam" * 300, "c"  # passed over
        yield f"a{a}", length + 4, text + " end", "gone is fine with a comment"
        yield f"a{a}", length + 5, "gone", "c"  # passed over before


TEXTS = "article string, rev_id long, text string, comment string"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_provenance(spark, seed):
    rows = list(histories(seed))
    facts = pv.token_provenance(spark.createDataFrame(rows, TEXTS).repartition(5)).persist()
    found, lives = {}, {}
    for r in facts.collect():
        if r.kind == "state":
            found.setdefault((r.article, r.rev_id), []).append((r.place, (r.token_id, r.str, r.o_rev_id)))
        else:
            lives[r.article, r.token_id] = (r.ins, r.outs)
    for a in {r[0] for r in rows}:
        own, life = plain_provenance([r[1:] for r in rows if r[0] == a])
        assert {n: [x for _, x in sorted(v)] for (b, n), v in found.items() if b == a} == {n: t for n, t in own if t}
        assert {t: v for (b, t), v in lives.items() if b == a} == life
        assert not {n for n, _ in own} & {16, 17, 19}
    facts.unpersist()


def test_targets(spark):
    rows = spark.createDataFrame(list(histories(4, articles=3)), TEXTS)
    every = {(r.article, r.rev_id, r.place): (r.token_id, r.o_rev_id) for r in pv.states(pv.token_provenance(rows)).collect()}
    targets = spark.createDataFrame([("a0", 3), ("a0", 9), ("a0", 9), ("a1", 1), ("a2", 16), ("zz", 4)], "article string, rev_id long")
    facts = pv.token_provenance(rows, targets).persist()
    found = {(r.article, r.rev_id, r.place): (r.token_id, r.o_rev_id) for r in pv.states(facts).collect()}
    assert found == {k: v for k, v in every.items() if k[:2] in {("a0", 3), ("a0", 9), ("a1", 1)}}  # 16 is passed over
    lives = pv.lives(facts).groupBy("article").agg(F.max("o_rev_id").alias("o"), F.max("rev_id").alias("newest")).collect()
    assert {r.article: r.newest for r in lives} == {"a0": 9, "a1": 1, "a2": 15}
    assert all(r.o <= r.newest for r in lives)
    facts.unpersist()
    assert pv.token_provenance(rows, targets.limit(0)).count() == 0


def test_odd_revisions(spark):
    rows = [("a", 1, None, None), ("a", 2, "x", None), ("a", 2, "x", None), (None, 1, "x", None), ("a", None, "x", None), ("b", 1, " \n\n . ", None), ("c", 1, "y " * 3, None)]
    found = sorted(map(tuple, pv.states(pv.token_provenance(spark.createDataFrame(rows, TEXTS))).collect()))
    assert found == [("a", 2, 0, 0, "x", 2), ("b", 1, 0, 0, ".", 1), ("c", 1, 0, 0, "y", 1), ("c", 1, 1, 1, "y", 1), ("c", 1, 2, 2, "y", 1)]
    assert pv.token_provenance(spark.createDataFrame([], TEXTS)).count() == 0


def test_batches_are_folded_across_their_ends(spark):
    """One article in many batches, and many rows from one revision."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    rows = [("a", n, " ".join(f"w{k}" for k in range(n, n + 12_000)), None) for n in range(1, 12)]
    try:
        spark.conf.set(key, "2")
        facts = pv.token_provenance(spark.createDataFrame(rows, TEXTS), spark.createDataFrame([("a", 11)], "article string, rev_id long"))
        assert pv.states(facts).groupBy("o_rev_id").count().orderBy("o_rev_id").collect()[0].asDict() == {"o_rev_id": 1, "count": 11_990}
        assert pv.lives(facts).where("size(out) = 1").count() == 10
    finally:
        spark.conf.set(key, old)


def test_from_exports_to_a_verdict(spark, tmp_path):
    """An article loses most of an old text for good, another doesn't: exports, provenance, snapshots, verdicts."""
    old = [f"w{k}a w{k}b w{k}c w{k}d." for k in range(60)]
    for title in ("Cut", "Kept"):
        revisions = []
        for n in range(1, 9):
            text = " ".join(old[40:] if title == "Cut" and n > 5 else old) + f" Added v{n}."
            revisions.append(revision(n, text, extra="      <comment>c</comment>\n", day=f"20{10 + n}-01-01"))
        (tmp_path / f"{title}.xml").write_text(export(title, revisions))
    revisions, faults = read_history(spark, str(tmp_path))
    tables = history_tables(revisions)
    facts = pv.token_provenance(tables["texts"]).persist()
    rsnap = pv.snapshot_rows(facts, tables["revisions"])
    p = Params(min_mature=100, min_cohort=50, mass_floor=100)
    assert faults.count() == 0
    assert {r.article: r.verdict for r in drift.verdict(rsnap, p).collect()} == {"Cut": "PIVOT?", "Kept": "HEALTHY"}
    member = membership(rsnap)
    assert member.where("article = 'Cut' and k = 4").agg(F.max("w")).first()[0] == 5
    windows = spark.createDataFrame([("Cut", 4, "2013-06-01", "2018-06-01"), ("Kept", 4, "2013-06-01", "2018-06-01")], "article string, k int, s string, e string")
    windows = windows.select("article", "k", F.col("s").cast("timestamp").alias("start_ts"), F.col("e").cast("timestamp").alias("end_ts"))
    spine = drift.durable_spine(member, windows.select("article", "k"), p)
    found = {r.article: (r.before_rev, r.after_rev, round(r.drop, 2)) for r in drift.refine(spine, windows, tables["revisions"], pv.states(facts), p).collect()}
    assert found["Cut"] == (5, 6, 0.67) and found["Kept"][2] == 0.0
    life = pv.token_life(facts)
    attributed = drift.removal_attribution(life, tables["revisions"], windows.select("article", F.lit(5).cast("long").alias("rev_id"), "start_ts", "end_ts"), rsnap.where("snap_rev = 8"))
    # 40 sentences of 5 tokens; the new last sentence takes a full stop of theirs, and leaves "added" and its own
    assert [(r.article, r.editor, r.tokens) for r in attributed.collect()] == [("Cut", "A & B", 201)]
    facts.unpersist()


def test_what_revisions_bring(spark):
    rows = [("a", 1, "x y z.", None), ("a", 2, "x q z.", None), ("a", 3, "x y z.", None)]
    found = pv.origins_of(pv.token_provenance(spark.createDataFrame(rows, TEXTS))).orderBy("rev_id").collect()
    assert [(r.rev_id, r.n_tokens, r.n_new, r.n_back, r.share_kept) for r in found] == [(1, 4, 4, 0, None), (2, 4, 1, 0, 0.75), (3, 4, 0, 1, 0.75)]


def plain_bisect(revs, spine, states, least):
    """(before, after, drop, probed) of one window; revs in order, states by revision."""
    share = lambda r: len(spine & states[r]) / len(spine) if states.get(r) else None
    if len(revs) < 3 or len(spine) < least:
        return None, None, None, 0
    lo, hi, probed = 0, len(revs) - 1, 2
    first, last = share(revs[0]), share(revs[-1])
    if first is None or last is None:
        return None, None, None, 2
    drop = first - last
    while hi - lo > 1:
        mid, probed = (lo + hi) // 2, probed + 1
        s = share(revs[mid])
        if s is None:
            return None, None, None, probed
        if first - s >= s - last:
            hi, last = mid, s
        else:
            lo, first = mid, s
    return revs[lo], revs[hi], drop, probed


def test_refine(spark):
    """Windows of many lengths, with revisions without states, against one bisection after another; only what is probed is read."""
    r = random.Random(8)
    revs, states, spine, windows, want = [], [], [], [], {}
    p = Params(min_cohort=5)
    for a in range(40):
        n, cohort = r.choice([1, 2, 3, 4, 9, 30, 64, 65]), r.choice([4, 5, 20])
        tokens = set(range(cohort))
        keep, held = [t for t in tokens], {}
        for k in range(n):
            keep = [t for t in keep if r.random() < (0.4 if k == n // 2 else 0.98)]
            held[k] = set(keep) | {100 + r.randrange(3)} if r.random() > 0.03 else set()
        order = sorted(range(n), key=lambda k: (k // 2, k))
        revs += [(f"a{a}", 10 + k, k // 2) for k in range(n)]
        states += [(f"a{a}", 10 + k, t) for k, s in held.items() for t in s]
        spine += [(f"a{a}", 3, t) for t in tokens]
        windows.append((f"a{a}", 3))
        want[f"a{a}"] = plain_bisect([10 + k for k in order], tokens, {10 + k: s for k, s in held.items()}, 5)
    at = lambda c: (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(F.col(c)))
    revisions = spark.createDataFrame(revs, "article string, rev_id long, d int").select("article", "rev_id", at("d").alias("ts"))
    spans = spark.createDataFrame(windows, "article string, k int").select("article", "k", F.lit("2019-12-31").cast("timestamp").alias("start_ts"), F.lit("2021-01-01").cast("timestamp").alias("end_ts"))
    token_state, asked = spark.createDataFrame(states, "article string, rev_id long, token_id long"), set()

    def read(probes):
        asked.update(map(tuple, probes.collect()))
        return token_state.join(probes, ["article", "rev_id"], "left_semi")

    cohort = spark.createDataFrame(spine, "article string, k int, token_id long")
    found = {x.article: (x.before_rev, x.after_rev, x.drop, x.probed) for x in drift.refine(cohort, spans, revisions, read, p).collect()}
    assert found == want and sum(x[3] > 4 for x in want.values()) > 5 and any(x[2] is None and x[3] for x in want.values())
    assert len(asked) <= sum(x[3] for x in want.values()) < len(revs) / 2
    assert {x.article: (x.before_rev, x.after_rev) for x in drift.refine(cohort, spans, revisions, token_state, p).collect()} == {a: x[:2] for a, x in want.items()}


@pytest.mark.parametrize("many", [1, 48])
def test_blocks_are_those_of_sequence_matcher(monkeypatch, many):
    """Runs clipped to what is left give the blocks that comparing every place gives."""
    monkeypatch.setattr(pv, "MANY", many)
    rng = random.Random(6)
    cells = lambda blocks: sorted((i + k, j + k) for i, j, n in blocks for k in range(n))
    for k in range(400):
        kinds = rng.choice([1, 2, 3, 8, 40])
        old = [str(rng.randrange(kinds)) for _ in range(rng.randrange(40))]
        new = list(old) if k % 3 == 0 else [str(rng.randrange(kinds)) for _ in range(rng.randrange(40))]
        for _ in range(k % 7):
            if new:
                new[rng.randrange(len(new))] = str(rng.randrange(kinds))
        assert cells(pv.matching_blocks(old, new)) == cells(SequenceMatcher(None, old, new, autojunk=False).get_matching_blocks())
    monkeypatch.setattr(pv, "MEETINGS", 10)
    assert cells(pv.matching_blocks(list("abababab"), list("babababa"))) == [(k, k + 1) for k in range(7)]


def shuffles(df):
    """How often a plan deals rows out anew."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_drafts_are_dealt_out_once(spark):
    """The texts of all states go nowhere once documents lie by article, and no token row is shuffled."""
    v = Views(spark, "/root/testdata/sf0.001")
    assert shuffles(pv.revision_tokens(v.drafts)) == 1
    assert shuffles(pv.token_provenance(v.drafts)) == 1
    assert shuffles(QUERIES["token_states"](spark, "/root/testdata/sf0.001")) == 1

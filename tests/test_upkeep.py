"""Backfills, resumed stages and tables that are replaced together."""

import os

import pytest
from pyspark.sql import functions as F

from driftloom.operators import backfill as bf
from driftloom.operators import snapshots
from driftloom.sources import Published, Stage, build_snapshots, ledger, run_stages

CONTRACT = {"confirm_drop": 0.5, "mag_floor": 10.0}
HELD = "article string, schema_version int, run_ts string, thresholds map<string,double>, horizon_date string, horizon_rev long, status string"
NOW = [("a", "2026-01-01", 9), ("b", "2026-01-01", 9), ("n", "2026-01-01", None)]
CASES = [
    ("a", 2, "t", {"mag_floor": 10.0, "confirm_drop": 0.5}, "2026-01-01", 9, "confirmed"), ("a", 2, "t", {"confirm_drop": 0.5, "mag_floor": 10.0}, "2026-01-01", 9, "confirmed"),
    ("a", None, None, {"confirm_drop": 0.5, "mag_floor": 10.0}, "2026-01-01", 9, "confirmed"), ("a", None, "t", {"confirm_drop": 0.5, "mag_floor": 10.0}, "2026-01-01", 9, "rejected"),
    ("a", 1, None, {"confirm_drop": 0.5, "mag_floor": 10.0}, "2026-01-01", 9, "confirmed"), ("a", 2, "t", {"confirm_drop": 0.5}, "2026-01-01", 9, "confirmed"), ("a", 2, "t", None, "2026-01-01", 9, "confirmed"),
    ("a", 2, "t", {"confirm_drop": 0.5, "mag_floor": 10.0}, "2025-01-01", 9, "confirmed"), ("a", 2, "t", {"confirm_drop": 0.5, "mag_floor": 10.0}, "2026-01-01", 8, "confirmed"),
    ("a", 3, "t", {"confirm_drop": 0.5, "mag_floor": 10.0}, "2026-01-01", 9, "confirmed"), ("x", 2, "t", {"confirm_drop": 0.5, "mag_floor": 10.0}, None, None, "confirmed"), ("n", 2, "t", {"confirm_drop": 0.5, "mag_floor": 10.0}, "2026-01-01", None, "confirmed"),
]


@pytest.fixture(scope="module")
def held(spark):
    rows = spark.createDataFrame([(*c, k) for k, c in enumerate(CASES)], HELD + ", k int").withColumn("horizon_date", F.col("horizon_date").cast("date"))
    horizon = spark.createDataFrame(NOW, "article string, d string, snap_rev long").select("article", F.col("d").cast("date").alias("snap_date"), "snap_rev")
    return rows, horizon


def test_fresh(held):
    rows, horizon = held
    found = {r.k for r in snapshots.fresh(rows, CONTRACT, horizon, 2).where("is_fresh").collect()}
    assert found == {0, 1, 2}  # the order of thresholds doesn't count; a result without version or run time is fresh


def test_refusals(spark, held):
    rows, horizon = held
    named = rows.withColumn("article", F.concat("article", F.lit("-"), "k"))
    now = horizon.join(rows.select("article", "k"), "article").withColumn("article", F.concat("article", F.lit("-"), "k"))
    some = spark.createDataFrame([(f"a-{k}",) for k in (0, 3)], "article string")
    found = {int(r.article.split("-")[1]): r.reason for r in bf.refusals(named, CONTRACT, now, 2, some).collect()}
    assert found == {0: None, 1: "no_episodes", 2: "no_episodes", 3: "not_confirmed", 4: "no_episodes", 5: "thresholds_stale", 6: "thresholds_stale", 7: "horizon_stale", 8: "horizon_stale", 9: "version_newer", 10: "horizon_stale", 11: "horizon_stale"}
    assert bf.refusals(named, CONTRACT, now, 2).where("reason is null").count() == 5


def test_backfill(spark):
    key, columns = ["article", "before_revid"], "article string, before_revid long, fingerprint string, error string, value long"
    asks = lambda version: spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "article string, before_revid long").withColumn("fingerprint", bf.fingerprint(version, CONTRACT, F.lit("2026-01-01").cast("date"), F.lit(9)))
    asked_for = []

    def compute(stale):
        asked_for.append(sorted(tuple(r)[:2] for r in stale.collect()))
        return stale.select(*key, F.when(F.col("before_revid") == 3, "gone").alias("error"), F.when(F.col("before_revid") != 3, F.col("before_revid") * 10).alias("value"))

    stored = spark.createDataFrame([("old", 7, "f", None, 70)], columns)
    for version, counts, wanted in ((1, (2, 0, 1), [("a", 1), ("a", 2), ("b", 3)]), (1, (0, 2, 1), [("b", 3)]), (2, (2, 0, 1), [("a", 1), ("a", 2), ("b", 3)])):
        parts, seen = bf.backfill(asks(version), stored, key, compute)
        rows = parts.collect()
        assert asked_for[-1] == wanted and tuple(seen.get[c] for c in ("updated", "skipped", "failed")) == counts
        assert sorted((r.article, r.before_revid, r.error, r.value) for r in rows) == [("a", 1, None, 10), ("a", 2, None, 20), ("b", 3, "gone", None), ("old", 7, None, 70)]
        assert len({r.fingerprint for r in rows}) == 2
        stored = spark.createDataFrame(rows, columns)
    assert bf.stale_parts(asks(2), stored, key, force=True).count() == 3
    assert bf.backfill(asks(2).limit(0), stored, key, compute)[0].count() == 4
    names = spark.range(1).select(bf.fingerprint(1, {"a": 1, "b": 2}, F.lit(None), F.lit(1)), bf.fingerprint(1, {"b": 2.0, "a": 1.0}, F.lit(None), F.lit(1)), bf.fingerprint(1, {"a": 1, "b": 3}, F.lit(None), F.lit(1))).first()
    assert names[0] == names[1] != names[2]


def test_stages(spark, tmp_path):
    path, topics, ran = str(tmp_path / "ledger"), spark.createDataFrame([("x",), ("y",), ("z",), ("z",)], "topic string"), []

    def stage(name, bad=(), **command):
        def run(due):
            ran.append((name, sorted(r.topic for r in due.collect())))
            return due.select("topic", F.when(F.col("topic").isin(*bad) if bad else F.lit(False), f"{name} failed").alias("error"))

        return Stage(name, run, command)

    def states(*stages, **kw):
        ran.clear()
        return sorted((r.topic, r.stage, r.state) for r in run_stages(topics, list(stages), path, **kw).collect())

    def broken(due):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run_stages(topics, [stage("load"), Stage("score", broken)], path)
    assert ran == [("load", ["x", "y", "z"])] and ledger(spark, path).count() == 3
    assert states(stage("load"), stage("score", ["y"]), stage("show")) == [
        ("x", "load", "skipped"), ("x", "score", "done"), ("x", "show", "done"), ("y", "load", "skipped"), ("y", "score", "failed"), ("y", "show", "not_reached"), ("z", "load", "skipped"), ("z", "score", "done"), ("z", "show", "done"),
    ]
    assert ran == [("load", []), ("score", ["x", "y", "z"]), ("show", ["x", "z"])]
    states(stage("load"), stage("score"), stage("show"))
    assert ran == [("load", []), ("score", ["y"]), ("show", ["y"])]
    states(stage("load"), stage("score", deep=True), stage("show"))
    assert ran == [("load", []), ("score", ["x", "y", "z"]), ("show", [])]  # another command runs again
    states(stage("load"), stage("score"))
    assert ran[1] == ("score", ["x", "y", "z"])  # the last command that ran counts
    states(stage("load"), resume=False)
    assert ran == [("load", ["x", "y", "z"])]


RSNAP, RECEIPTS, STATE = "article string, snap_rev long, token_id long", "article string, snap_rev long, status string", "article string, source_status string, expected_snapshots long, loaded_snapshots long, reason string"


def test_published(spark, tmp_path):
    tables = Published(spark, str(tmp_path / "db"))
    names = lambda *a: spark.createDataFrame([(x,) for x in a], "article string")
    rows = lambda *r: spark.createDataFrame(list(r), RSNAP)
    expected = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 5)], "article string, snap_rev long")
    judge = lambda rsnap: rsnap.groupBy("article", "snap_rev").agg(F.when(F.count(F.lit(1)) > 1, "complete").otherwise("quarantined").alias("status"))
    read = lambda t, s: sorted(map(tuple, tables.read(t, s).collect()))
    assert read("rsnap", RSNAP) == [] and tables.current() is None and tables.unused_loads() == []
    build_snapshots(tables, names("a", "b", "c"), rows(("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", 2, 2), ("b", 1, 1)), expected, judge)
    assert [x[:2] for x in read("rsnap", RSNAP)] == [("a", 1), ("a", 1), ("a", 2), ("a", 2), ("b", 1)]
    assert read("article_source_state", STATE) == [("a", "current_complete", 2, 2, None), ("b", "partial", 1, 1, "quarantined_1"), ("c", "partial", 1, 0, "loaded_0_of_1")]
    before = {t: read(t, s) for t, s in (("rsnap", RSNAP), ("snapshot_integrity", RECEIPTS), ("article_source_state", STATE))}

    def failing(rsnap):
        return judge(rsnap).withColumn("status", F.raise_error(F.lit("receipts failed")))

    with pytest.raises(Exception, match="receipts failed"):
        build_snapshots(tables, names("b"), rows(("b", 1, 8), ("b", 1, 9)), expected, failing)
    with pytest.raises(ValueError):
        tables.replace(names("b"), {"rsnap": rows(("b", 1, 8)), "snapshot_integrity": judge(rows(("b", 1, 8)))}, check=lambda written: int(f"x{written['rsnap'].count()}"))
    assert {t: read(t, s) for t, s in (("rsnap", RSNAP), ("snapshot_integrity", RECEIPTS), ("article_source_state", STATE))} == before
    assert len(os.listdir(tmp_path / "db/tables/rsnap")) == 1 and tables.unused_loads() == []

    old = tables.read("rsnap", RSNAP)
    build_snapshots(tables, names("b"), rows(("b", 1, 8), ("b", 1, 9), ("a", 7, 7)), expected, judge)  # rows of other articles aren't taken
    assert read("article_source_state", STATE)[:2] == [("a", "current_complete", 2, 2, None), ("b", "current_complete", 1, 1, None)]
    assert [x for x in read("rsnap", RSNAP) if x[0] == "b"] == [("b", 1, 8), ("b", 1, 9)] and ("a", 7, 7) not in read("rsnap", RSNAP)
    assert sorted(map(tuple, old.collect())) == before["rsnap"]  # a reader goes on with the manifest that it began with
    build_snapshots(tables, names("a", "b", "c"), rows(), expected, judge)
    assert read("rsnap", RSNAP) == [] and len(tables.unused_loads()) == 6

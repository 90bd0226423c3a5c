"""Stance runs against plain Python, and trajectories with a made-up classifier."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from driftloom.operators import stance

RUNS = "article string, revision_id long, entity string, run int, stance string, confidence double, has_evidence boolean, contract string"


def audit(spark, before, after, old="one text", new="one text", contracts=("v", "v")):
    rows = [("a", rev, "e", k, s, 0.5, True, contract) for rev, labels, contract in ((1, before, contracts[0]), (2, after, contracts[1])) for k, s in enumerate(labels)]
    passages = spark.createDataFrame([("a", 1, old), ("a", 2, new)], "article string, revision_id long, passage string")
    found = stance.audit_transitions(stance.summarize_runs(spark.createDataFrame(rows, RUNS)), passages).collect()
    assert len(found) == 1 and found[0].text_similarity == round(SequenceMatcher(None, old, new).ratio(), 4)
    return found[0].state, found[0].audited_shift


@pytest.mark.parametrize(
    ("before", "after", "new", "expected"),
    [
        (["neutral"] * 3, ["critical", "neutral", "critical"], "one text", ("model_unstable", False)),
        (["neutral"] * 3, ["critical"] * 3, "quite another passage", ("text_changed", True)),
        (["neutral"] * 3, ["neutral"] * 3, "quite another passage", ("text_changed", False)),
        (["neutral"] * 3, ["critical"] * 3, "one text", ("model_unstable", False)),
        (["neutral"] * 3, ["critical", "neutral", "critical"], "quite another passage", ("both_changed", False)),
        (["neutral"] * 3, ["neutral"] * 3, "one text", ("no_change", False)),
        (["neutral"] * 3, [], "one text", ("insufficient_evidence", False)),
    ],
)
def test_audit(spark, before, after, new, expected):
    assert audit(spark, before, after, new=new) == expected


def test_contracts_must_agree(spark):
    assert audit(spark, ["neutral"], ["critical"], new="other", contracts=("v", "w")) == ("insufficient_evidence", False)
    assert audit(spark, ["neutral"], ["critical"], new="other", contracts=(None, "w")) == ("text_changed", True)


def test_ties_go_to_the_label_seen_first(spark):
    rows = [("a", 1, "e", k, s, None, False, None) for k, s in enumerate(["neutral", "critical", "critical", "neutral"])]
    r = stance.summarize_runs(spark.createDataFrame(rows, RUNS)).collect()[0]
    assert (r.label, r.agreement, r.runs, r.label_counts, r.evidence_coverage, r.mean_confidence, r.contracts) == ("neutral", 0.5, 4, {"critical": 2, "neutral": 2}, 0.0, None, [])


def test_trajectory_repeats_beside_changes_alone(spark):
    texts = ["calm words", "calm words", "harsh words now", "", "harsh words now", None]
    passages = spark.createDataFrame([("a", k, t) for k, t in enumerate(texts)], "article string, revision_id long, passage string")

    def classify(asked):
        label = F.when(F.col("passage").contains("harsh"), "critical").otherwise("neutral")
        return asked.select("article", "revision_id", F.lit("e").alias("entity"), label.alias("stance"), F.lit(1.0).alias("confidence"), F.lit(True).alias("has_evidence"), F.lit("v").alias("contract"))

    runs, summaries, steps = stance.stance_trajectory(passages, classify)
    assert sorted((r.revision_id, r.n) for r in runs.groupBy("revision_id").agg(F.count("*").alias("n")).collect()) == [(0, 1), (1, 3), (2, 3), (4, 1)]
    assert [(r.revision_id, r.state) for r in steps.orderBy("revision_id").collect()] == [(1, "no_change"), (2, "text_changed"), (3, "insufficient_evidence"), (4, "insufficient_evidence"), (5, "insufficient_evidence")]
    shift = stance.stance_shifts(summaries, steps).collect()[0]
    assert (shift.start, shift.end, shift.n, shift.audited, shift.shifted) == (0, -1, 4, 1, True)
    with pytest.raises(ValueError):
        stance.stance_trajectory(passages, classify, runs=0)

"""Model ports: schema checks, isolated failures, one repair pass, matched editions and fact checks, with functions that answer by rule."""

import json
import re

import pytest

from driftloom.operators import ports

LEADS = "article string, lang string, side string, rev_id long, ts string, text string"


def test_ask_and_repair(spark):
    """Each kind of failure costs its own row, and only failed rows are asked again."""

    def complete(prompt):
        name, again = prompt.split()[0], "could not be read" in prompt
        if name == "raises" or name == "mends" and not again:
            raise TimeoutError("slow")
        return {"good": '{"n": 1, "xs": ["a"]}', "mends": '{"n": 2, "xs": []}', "prose": "Sure: {", "half": '{"n": 3}', "wrong": '{"n": "three", "xs": []}', "fence": '```json\n{"n": 1}\n```'}[name] if not (again and name == "good") else "asked twice"

    rows = spark.createDataFrame([(k, f"{n} please") for k, n in enumerate(("good", "mends", "raises", "prose", "half", "wrong", "fence"))] + [(9, None)], "id int, prompt string").repartition(3)
    answers, failures = ports.ask_with_repair(rows, ["id"], "n int, xs array<string>", ["n", "xs"], complete)
    assert sorted((r.id, r.answer.n, r.answer.xs) for r in answers.collect()) == [(0, 1, ["a"]), (1, 2, [])]
    found = {r.id: (r.first_error, r.error) for r in failures.collect()}
    unread = "not JSON of the schema"
    assert found == {1: ("TimeoutError: slow", None), 2: ("TimeoutError: slow",) * 2, 3: (unread,) * 2, 4: ("missing: xs",) * 2, 5: (unread,) * 2, 6: (unread,) * 2}
    none, failed = ports.ask_with_repair(rows.limit(0), ["id"], "n int", ["n"], complete)
    assert none.count() == failed.count() == 0


def test_lead_comparison(spark):
    lead = lambda a, lang, side, n, text: (a, lang, side, n, f"2020-01-0{n}", text)
    rows = [lead("a", "de", "before", 1, "Alt."), lead("a", "de", "after", 2, "Neu “heute”."), lead("a", "en", "after", 4, "New  text."), lead("a", "en", "before", 3, "Old text."), lead("a", "fr", "before", 5, "Seul."), lead("a", "en", "before", 2, "Older text.")]
    rows += [lead("b", "en", "before", 1, "x"), lead("b", "en", "after", 2, "y"), lead("c", "en", "before", 1, "x"), lead("c", "en", "after", 2, "y"), lead("c", "es", "before", 1, "x"), lead("c", "es", "after", 2, ""), lead("d", "en", "before", 1, "x"), lead("d", "en", "after", 2, "y"), lead("d", "pl", "before", 1, "x"), lead("d", "pl", "after", 2, "y")]
    matched = {r.article: [e.lang for e in r.editions] for r in ports.matched_leads(spark.createDataFrame(rows, LEADS)).collect()}
    assert matched == {"a": ["en", "de"], "d": ["en", "pl"]}

    def complete(prompt):
        article = re.search("Article: (.*)", prompt)[1]
        assert "# en before" in prompt and prompt.index("# en before") < prompt.index("# en after") < prompt.rindex("\n\n# ")
        if article == "d":
            raise ValueError("no")
        one = {"topic": "t", "editions_differ": ["en", "de"], "verdict": "differ", "evidence_en_before": "older TEXT", "evidence_en_after": "new text", "evidence_other_before": "new text", "evidence_other_after": 'neu "heute"'}
        return json.dumps({"divergences": [one | {"topic": f"t{k}"} for k in range(9)]})

    windows = spark.createDataFrame([(x, "2020-01-01", "2020-02-01", None) for x in "abcd"], "article string, start string, end string, status string")
    found, told = ports.compare_leads(spark.createDataFrame(rows, LEADS), windows, complete)
    got = sorted(found.collect(), key=lambda r: r.place)
    assert [r.topic for r in got] == [f"t{k}" for k in range(6)] and {r.article for r in got} == {"a"}
    assert {tuple(r[e] for e in ports.EVIDENCE) for r in got} == {("older TEXT", "new text", None, 'neu "heute"')}
    assert {(r.article, r.state, r.n_editions, r.error) for r in told.collect()} == {("a", "compared", 2, None), ("b", "too_few_editions", 1, None), ("c", "too_few_editions", 1, None), ("d", "failed", 2, "ValueError: no")}


@pytest.fixture(scope="module")
def checked(spark):
    cite = "Text <ref>[http://www.x.org/a b]</ref> [http://y.org/ z] {mark}."
    rows = [("a", "en", cite), ("a", "de", "Nur [http://y.org/q] {mark}."), ("a", "fr", None), ("b", "en", "x"), ("b", "de", None), ("c", "en", "x bad"), ("c", "de", "y bad"), ("c", "fr", "z"), ("d", "en", "m"), ("d", "de", "m"), ("e", "en", "k"), ("e", "de", "k"), ("f", "en", "u"), ("f", "de", "v")]
    asks = [("a", "Q1?"), ("a", "Q2?"), ("a", "Q1?"), ("b", "Q?"), ("c", "Q?"), ("d", "Q?"), ("e", "Q?"), ("z", "Q?")]

    def extract(prompt):
        assert "<ref" not in prompt
        if "bad" in prompt:
            raise OSError("down")
        return json.dumps({"answers": [{"question": q, "value": "yes", "answer": "long " * 99} for q in re.findall(r"^- (.*)$", prompt, re.M)] + [{"question": "other", "value": "no", "answer": ""}]})

    def adjudicate(prompt):
        if "Q1?" in prompt:
            assert len(re.findall(r"^  \[(?:de|en)\] yes: (?:long ){36}$", prompt, re.M)) == 4
            return json.dumps({"questions": [{"question": "Q1?", "verdict": "agree", "note": "same"}]})
        if "could not be read" in prompt and "[de] yes" in prompt and adjudicate.calls[0] == "mends":
            return json.dumps({"questions": [{"question": "Q?", "verdict": "contradict", "note": "n"}]})
        return "prose"

    adjudicate.calls = ["mends"]
    return ports.fact_check(spark.createDataFrame(rows, "article string, lang string, text string"), spark.createDataFrame(asks, "article string, question string"), extract, adjudicate)


def test_fact_check(checked):
    citations = {r.article: (r.n_editions, r.jaccard) for r in checked["citations"].collect()}
    assert citations["a"] == (2, 0.5) and citations["b"] == (1, 1.0) and citations["f"] == (2, 1.0)
    verdicts = {(r.article, r.question): (r.verdict, r.note) for r in checked["verdicts"].collect()}
    assert verdicts == {
        ("a", "Q1?"): ("agree", "same"), ("a", "Q2?"): ("insufficient", "no ruling"), ("b", "Q?"): ("insufficient", "editions read: 1 of 2"), ("c", "Q?"): ("insufficient", "editions answered: 0 of 2"),
        ("d", "Q?"): ("contradict", "n"), ("e", "Q?"): ("contradict", "n"), ("z", "Q?"): ("insufficient", "editions read: 0 of 2"),
    }
    assert {r.question for r in checked["answers"].collect()} == {"Q1?", "Q2?", "Q?"}
    errors = sorted((r.article, r.lang, r.stage, r.error) for r in checked["errors"].collect())
    assert errors == [("a", "fr", "fetch", "no text"), ("b", "de", "fetch", "no text"), ("c", "de", "extract", "OSError: down"), ("c", "en", "extract", "OSError: down"), ("d", "all", "adjudicate", "not JSON of the schema"), ("e", "all", "adjudicate", "not JSON of the schema")]

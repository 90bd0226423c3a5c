"""Questions to a language model as a step of a plan: answers checked against a schema, failures kept apart, one repair pass.

The model itself is the caller's: a function from prompts to texts that runs in the tasks. What it says is JSON or a failure. A call that
raises an error, or an answer that the schema can't read or that lacks a required field, costs that row alone. Each pass is written once, so
that nothing is asked again when its rows are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..lineage import settled
from .editions import bound_comparison, citation_jaccard, ground_evidence

REPAIR = "\n\nThe last answer could not be read. Answer with one JSON object of the named fields and nothing else."
LEAST_EDITIONS = 2
#: Parts of answers and texts that go into further prompts.
MOST_LEAD, MOST_PASSAGE, MOST_ANSWER = 3000, 12_000, 180


def ask(rows: DataFrame, key: list[str], schema: str, required: list[str], complete: Callable[[str], str]) -> DataFrame:
    """key, answer (struct of schema, null if there is none), error (null: fine). rows: key, prompt; a null prompt isn't asked."""
    asked = rows.where("prompt is not null").select(*key, "prompt")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema if f.name in key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            said, failed = [], []
            for prompt in pdf["prompt"]:
                try:
                    said.append(complete(prompt))
                    failed.append(None)
                except Exception as e:  # noqa: BLE001  whatever a model's client raises is this row's failure
                    said.append(None)
                    failed.append(f"{type(e).__name__}: {e}")
            yield pdf[key].assign(said=said, failed=failed)

    answers = asked.mapInPandas(run, f"{kinds}, said string, failed string")
    names = StructType.fromDDL(schema).fieldNames()
    read = answers.withColumn("answer", F.from_json("said", f"{schema}, _unread string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"}))
    lacks = F.concat_ws(",", *(F.when(F.col(f"answer.{f}").isNull(), F.lit(f)) for f in required)) if required else F.lit("")
    error = F.coalesce("failed", F.when(F.col("answer").isNull() | F.col("answer._unread").isNotNull(), "not JSON of the schema").when(lacks != "", F.concat(F.lit("missing: "), lacks)))
    return read.select(*key, F.when(error.isNull(), F.struct(*(F.col(f"answer.{n}").alias(n) for n in names))).alias("answer"), error.alias("error"))


def ask_with_repair(rows: DataFrame, key: list[str], schema: str, required: list[str], complete: Callable[[str], str], repair: str = REPAIR) -> tuple[DataFrame, DataFrame]:
    """(answers: key, answer; failures: key, first_error, error). Rows that fail are asked once more, with repair after their prompt, and no others.

    A failure whose second answer is fine has error null. key must tell rows apart.
    """
    first = settled(ask(rows, key, schema, required, complete), "answers")
    failed = first.where("error is not null")
    again = rows.join(failed.select(*key), key, "left_semi").withColumn("prompt", F.concat("prompt", F.lit(repair)))
    second = settled(ask(again, key, schema, required, complete), "answers-again")
    fine = "error is null"
    answers = first.where(fine).unionByName(second.where(fine)).drop("error")
    failures = failed.select(*key, F.col("error").alias("first_error")).join(second.select(*key, "error"), key, "left")
    return answers, failures


def matched_leads(leads: DataFrame, least: int = LEAST_EDITIONS) -> DataFrame:
    """article, editions: array of lang, before and after (rev_id, ts, text) of editions with a lead on both sides, English first; articles with fewer than `least`
    such editions are left out. leads: article, lang, side (before or after), rev_id, ts, text; of several the first by rev_id counts."""
    shown = leads.where(F.coalesce("text", F.lit("")) != "")
    part = F.struct("rev_id", "ts", F.substring("text", 1, MOST_LEAD).alias("text"))
    side = lambda s: F.min_by(F.when(F.col("side") == s, part), F.when(F.col("side") == s, F.col("rev_id"))).alias(s)
    both = shown.groupBy("article", "lang").agg(side("before"), side("after")).where("before is not null and after is not null")
    edition = F.struct((F.col("lang") != "en").alias("other"), "lang", "before", "after")
    rows = both.groupBy("article").agg(F.array_sort(F.collect_list(edition)).alias("editions")).where(F.size("editions") >= least)
    return rows.withColumn("editions", F.transform("editions", lambda e: e.dropFields("other")))


DIVERGENCES = "divergences array<struct<topic:string,editions_differ:array<string>,verdict:string,evidence_en_before:string,evidence_en_after:string,evidence_other_before:string,evidence_other_after:string>>"
EVIDENCE = ("evidence_en_before", "evidence_en_after", "evidence_other_before", "evidence_other_after")


def lead_prompt(article: Column, window: Column, editions: Column) -> Column:
    told = lambda e, when: F.concat(F.lit("# "), e["lang"], F.lit(f" {when}, revision "), e[when]["rev_id"].cast("string"), F.lit("\n"), e[when]["text"])
    parts = F.transform(editions, lambda e: F.concat(told(e, "before"), F.lit("\n"), told(e, "after")))
    task = "How did the editions' leads change over this time, and where do they part? Name only what quotations show; a difference is a lead for a reader, no judgement. Answer in JSON: divergences, a list of topic, editions_differ, verdict and the quotations " + ", ".join(EVIDENCE) + "."
    return F.concat_ws("\n\n", F.concat(F.lit("Article: "), article), F.concat(F.lit("Time: "), window), F.array_join(parts, "\n\n"), F.lit(task))


def compare_leads(leads: DataFrame, windows: DataFrame, complete: Callable[[str], str], least: int = LEAST_EDITIONS) -> tuple[DataFrame, DataFrame]:
    """(divergences: article, place, topic, editions_differ, verdict and EVIDENCE; diagnostics: article, state, n_editions, first_error, error).

    Leads of editions are compared before and after each article's window (article, start, end, status). The first few divergences count, with
    quotations null that none of the texts of their side and time holds. state: compared, repaired, failed, or too_few_editions.
    """
    matched = settled(matched_leads(leads, 0), "matched-leads")
    rows = matched.where(F.size("editions") >= least).join(windows, "article")
    time = F.concat_ws(" ", F.col("start").cast("string"), F.lit("to"), F.col("end").cast("string"), F.concat(F.lit("("), F.coalesce("status", F.lit("candidate")), F.lit(")")))
    answers, failures = ask_with_repair(rows.select("article", lead_prompt(F.col("article"), time, F.col("editions")).alias("prompt")), ["article"], DIVERGENCES, ["divergences"], complete)
    found = answers.select("article", F.posexplode("answer.divergences").alias("place", "d")).select("article", "place", "d.*")
    found = bound_comparison(found)
    for name in EVIDENCE:
        _, whose, when = name.split("_")
        texts = matched.select("article", F.explode("editions").alias("e")).where((F.col("e.lang") == "en") == F.lit(whose == "en"))
        sources = texts.select(F.col("article").alias("id"), F.col(f"e.{when}.text").alias("text"))
        held = found.withColumnsRenamed({"article": "id", name: "quote"})
        found = ground_evidence(held, sources).withColumnsRenamed({"id": "article", "quote": name})
    n = F.coalesce(F.size("editions"), F.lit(0))
    told = windows.select("article").distinct().join(matched, "article", "left").select("article", n.alias("n_editions")).join(failures, "article", "left")
    state = F.when(F.col("n_editions") < least, "too_few_editions").when(F.col("first_error").isNull(), "compared").when(F.col("error").isNull(), "repaired").otherwise("failed")
    return found, told.select("article", state.alias("state"), "n_editions", "first_error", "error")


EXTRACTED = "answers array<struct<question:string,value:string,answer:string>>"
JUDGED = "questions array<struct<question:string,verdict:string,note:string>>"


def fact_check(editions: DataFrame, questions: DataFrame, extract: Callable[[str], str], adjudicate: Callable[[str], str], least: int = LEAST_EDITIONS) -> dict[str, DataFrame]:
    """What editions cite, what each answers, and whether the answers agree.

    editions: article, lang, text (null: couldn't be fetched), each edition once; questions: article, question. Tables:
    `citations` article, n_editions, jaccard (mean overlap of cited domains; 1 for fewer than two editions); `answers` article, lang, question, value, answer; `verdicts` article, question, verdict,
    note: insufficient, with the reason, if fewer than `least` editions could be read or answered, or if adjudication failed twice; `errors`
    article, lang, stage (fetch, extract, adjudicate), error: each failure, those that a second adjudication mended too.
    Articles without questions are read for their citations alone.
    """
    got = editions.where("text is not null")
    errors = editions.where("text is null").select("article", "lang", F.lit("fetch").alias("stage"), F.lit("no text").alias("error"))
    sizes = editions.groupBy("article").agg(F.count("text").alias("n_editions"))
    enough = sizes.where(F.col("n_editions") >= least)
    domains = got.select("article", "lang", F.array_distinct(T.cited_domains(F.col("text"))).alias("domains"))
    citations = sizes.join(citation_jaccard(domains).select("article", "jaccard"), "article", "left").withColumn("jaccard", F.coalesce("jaccard", F.lit(1.0)))
    asked = questions.select("article", "question").distinct()
    lists = asked.groupBy("article").agg(F.array_join(F.transform(F.array_sort(F.collect_list("question")), lambda q: F.concat(F.lit("- "), q)), "\n").alias("qs"))

    passages = got.join(enough.select("article"), "article", "left_semi").join(lists, "article")
    task = F.lit("Answer each question from the passage alone, in JSON: answers, a list of question, value (yes, no, mixed or absent) and answer.")
    prompts = passages.select("article", "lang", F.concat_ws("\n\n", task, F.col("qs"), F.substring(T.squeezed(T.without_markup(F.col("text"))), 1, MOST_PASSAGE)).alias("prompt"))
    said = settled(ask(prompts, ["article", "lang"], EXTRACTED, ["answers"], extract), "extracted")
    errors = errors.unionByName(said.where("error is not null").select("article", "lang", F.lit("extract").alias("stage"), "error"))
    answers = said.where("error is null").select("article", "lang", F.explode("answer.answers").alias("a")).select("article", "lang", "a.*")
    answers = answers.join(asked, ["article", "question"], "left_semi").dropDuplicates(["article", "lang", "question"]).select("article", "lang", "question", "value", "answer")

    able = said.where("error is null").groupBy("article").agg(F.count(F.lit(1)).alias("n_answered"), F.collect_set("lang").alias("langs")).where(F.col("n_answered") >= least)
    lines = asked.join(able, "article").select("article", "question", F.explode("langs").alias("lang")).join(answers, ["article", "lang", "question"], "left")
    line = F.concat(F.lit("  ["), F.col("lang"), F.lit("] "), F.coalesce("value", F.lit("?")), F.lit(": "), F.substring(F.coalesce("answer", F.lit("")), 1, MOST_ANSWER))
    block = lines.groupBy("article", "question").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("block"))
    block = block.groupBy("article").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("question", "block"))), lambda b: F.concat(b["question"], F.lit("\n"), b["block"])), "\n").alias("payload"))
    ruling = F.lit("Do these editions' answers agree? In JSON: questions, a list of question, verdict (agree, differ, contradict or insufficient) and note.")
    judged, failures = ask_with_repair(block.select("article", F.concat_ws("\n\n", ruling, F.col("payload")).alias("prompt")), ["article"], JUDGED, ["questions"], adjudicate)
    both = F.concat_ws(" | ", "first_error", "error")
    errors = errors.unionByName(failures.select("article", F.lit("all").alias("lang"), F.lit("adjudicate").alias("stage"), both.alias("error")))

    ruled = judged.select("article", F.explode("answer.questions").alias("q")).select("article", "q.*").dropDuplicates(["article", "question"])
    note = F.when(F.coalesce("n_editions", F.lit(0)) < least, F.format_string("editions read: %d of %d", F.coalesce("n_editions", F.lit(0)), F.lit(least))).when(F.coalesce("n_answered", F.lit(0)) < least, F.format_string("editions answered: %d of %d", F.coalesce("n_answered", F.lit(0)), F.lit(least)))
    rows = asked.join(sizes, "article", "left").join(able.select("article", "n_answered"), "article", "left").join(failures.select("article", F.col("error").alias("_failed")), "article", "left").join(ruled, ["article", "question"], "left")
    verdicts = rows.select("article", "question", F.coalesce("verdict", F.lit("insufficient")).alias("verdict"), F.coalesce(note, F.when(F.col("_failed").isNotNull(), F.concat(F.lit("adjudication failed: "), "_failed")), F.col("note"), F.lit("no ruling")).alias("note"))
    return {"citations": citations, "answers": answers, "verdicts": verdicts, "errors": errors}

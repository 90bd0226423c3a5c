"""Stages over many topics that can be resumed: a ledger tells which topic has been through which stage, by which command."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "topic string, stage string, digest string, ok boolean, error string, at timestamp"


@dataclass(frozen=True)
class Stage:
    """run gets the topics (topic) that are due and gives topic, error (null: done); command tells one way of running it from another."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    command: dict = field(default_factory=dict)

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps([self.name, self.command], sort_keys=True, default=str).encode()).hexdigest()


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """All entries, oldest and newest; empty if there is no ledger yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def done(entries: DataFrame, stage: Stage) -> DataFrame:
    """Topics whose last entry for a stage says that the present command has ended well."""
    last = entries.where(F.col("stage") == stage.name).groupBy("topic").agg(F.max_by(F.struct("digest", "ok"), "at").alias("e"))
    return last.where((F.col("e.digest") == stage.digest) & F.col("e.ok")).select("topic")


def run_stages(topics: DataFrame, stages: list[Stage], path: str, resume: bool = True) -> DataFrame:
    """Run the stages in order over all topics (topic) and return topic, stage, state: skipped, done, failed or not_reached, with error.

    A topic is skipped at a stage if the ledger at path says that its present command has ended well for it, and goes no further once a
    stage has failed for it. Each stage's outcome is appended to the ledger before the next begins: an interrupted run keeps
    what was done, and the next goes on from there. A stage that raises an error ends the run; what other stages have done stays.
    """
    spark = topics.sparkSession
    left, states = topics.select("topic").distinct(), None
    for stage in stages:
        entries = ledger(spark, path)
        had = done(entries, stage) if resume else entries.select("topic").limit(0)
        due = left.join(had, "topic", "left_anti").checkpoint()
        skipped = left.join(had, "topic", "left_semi").select("topic", F.lit("skipped").alias("state"), F.lit(None).cast("string").alias("error"))
        outcome = stage.run(due).select("topic", "error").join(due, "topic", "right").checkpoint()
        new = outcome.select("topic", F.lit(stage.name).alias("stage"), F.lit(stage.digest).alias("digest"), F.col("error").isNull().alias("ok"), "error", F.current_timestamp().alias("at"))
        new.write.mode("append").parquet(path)
        ran = outcome.select("topic", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("state"), "error")
        rows = skipped.unionByName(ran).checkpoint()
        beyond = topics.select("topic").distinct().join(rows, "topic", "left_anti").select("topic", F.lit("not_reached").alias("state"), F.lit(None).cast("string").alias("error"))
        told = rows.unionByName(beyond).withColumn("stage", F.lit(stage.name)).select("topic", "stage", "state", "error")
        states = told if states is None else states.unionByName(told)
        left = rows.where("state <> 'failed'").select("topic")
    return states

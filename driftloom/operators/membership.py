"""Snapshot membership: for each token of each snapshot, its earned weight and its neighbours in time.

One window over (article, token) gives all that the interval measures need; no snapshot is joined with another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import settled
from .corpus import SNAP, snapshots_distinct


def places(rsnap: DataFrame) -> DataFrame:
    """snapshots_distinct as a table of its own, so that its size decides how it meets the tokens."""
    return settled(snapshots_distinct(rsnap), "snapshots")


def membership(rsnap: DataFrame, snaps: DataFrame | None = None) -> DataFrame:
    """article, k, token_id, w (snapshots up to k that have the token), prev_k, next_k. Repeated rows count once.

    Rows that are dealt out by article and token stay where they are; a task sorts them and holds one token's. snaps: of places().
    """
    rows = rsnap.select(*SNAP, "token_id").join(places(rsnap) if snaps is None else snaps, SNAP).select("article", "k", "token_id")
    life = Window.partitionBy("article", "token_id").orderBy("k")
    rows = rows.withColumn("_last", F.lag("k").over(life)).where("_last is null or _last < k").drop("_last")
    return rows.withColumns({"w": F.row_number().over(life), "prev_k": F.lag("k").over(life), "next_k": F.lead("k").over(life)})


def snapshot_sums(member: DataFrame) -> DataFrame:
    """Per snapshot: size, weight, and what leaves after it and has come with it."""
    leaves = F.col("next_k").isNull() | (F.col("next_k") > F.col("k") + 1)
    comes = F.col("prev_k").isNull() | (F.col("prev_k") < F.col("k") - 1)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("w"))), F.lit(0)).cast("long")
    return member.groupBy("article", "k").agg(F.count(F.lit(1)).alias("size"), F.sum("w").cast("long").alias("weight"), total(leaves).alias("leaving"), total(comes).alias("coming"))

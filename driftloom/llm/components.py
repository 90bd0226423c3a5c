"""Connected components of an edge table, by alternating large-star and small-star steps.

A table of no more than FEW edges (256 KB) is settled in one task at once, as a round over so few takes longer than all of it; the result
is the same. Edges that are null on one side or lead from a node to itself don't count, repeated ones count once, and an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Edges that one task settles; a bound at any size of the table.
FEW = 16_384


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b")


def _at_once(edges: DataFrame) -> DataFrame:
    """node, root, by union-find over all edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def connected_components(edges: DataFrame, most_rounds: int = 60, few: int = FEW) -> DataFrame:
    """node, root (the component's least node) of each node that has an edge and isn't a root. edges: longs a, b.

    Each round is written to the shared folder. It ends when a round changes nothing and fails if most_rounds don't do.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    print_of = lambda df: df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
    mark = print_of(now)
    if mark[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if mark[0] <= few:
        return _at_once(now)
    for _ in range(most_rounds):
        now = saved(_small_star(_large_star(now).distinct()).distinct(), "edges")
        before, mark = mark, print_of(now)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

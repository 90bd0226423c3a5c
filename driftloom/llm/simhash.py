"""Near-duplicates by SimHash and tiled exact comparison.

A text's fingerprint has 64 bits: the majority of the XXH64 values of its 3-word shingles. Distinct fingerprints, sorted by
the population counts of their four 16-bit words, are cut into tiles. Two fingerprints within the radius have population
counts whose differences sum up to the radius at most, so a pair of tiles whose ranges are further apart is skipped; the
same test is made on sub-tiles. All other pairs are compared by exclusive-or and bit counts in numpy. A pair of tiles
returns a forest of its links, not the links, and components of the forests are joined afterwards.

Null texts are empty; texts without words have fingerprint 0 and are linked like others. Each input row gives one result
row; a null doc_id counts in its class but names none (a class of nulls alone has a null component_id). Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches
from .components import connected_components

RADIUS = 3
WORDS = 3
SEED = 42
TILE = 8192
SUB = 256
#: For each byte value, a 64-bit word whose byte k is bit k.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingles(text: str | None, words: int = WORDS) -> list[bytes]:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) <= words:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[k:] for k in range(words)))))


def simhash(text: str | None, words: int = WORDS) -> int:
    parts = shingles(text, words)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(x, SEED) for x in parts], np.uint64, len(parts))
    lanes = SPREAD[h.view(np.uint8)].reshape(len(h), 8)
    counts = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, h (a hash of the text), fp (the 64 bits as a signed long)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(x.as_py(), words) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, fp long")


def counts_of(fps: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit words."""
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def tiles(classes: DataFrame, size: int = TILE) -> DataFrame:
    """tile, lo and hi (ranges of the four counts), fps (packed), in the order of the counts."""
    word = lambda k: F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(65535)))
    ordered = classes.select("fp", (((word(0) * 17 + word(1)) * 17 + word(2)) * 17 + word(3)).alias("order"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held = TaskContext.get().partitionId(), 0, []

        def out(fps: np.ndarray) -> pa.RecordBatch:
            c = counts_of(fps)
            row = {"tile": [(part << 32) | k], "lo": [c.min(0).tolist()], "hi": [c.max(0).tolist()], "fps": [fps.tobytes()]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("tile", pa.int64()), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32())), ("fps", pa.binary())]))

        rest = np.empty(0, np.uint64)
        for batch in batches:
            rest = np.concatenate([rest, np.asarray(batch.column(0)).view(np.uint64)])
            while len(rest) >= size:
                yield out(rest[:size])
                rest, k = rest[size:], k + 1
        if len(rest):
            yield out(rest)

    return ordered.repartitionByRange("order", "fp").sortWithinPartitions("order", "fp").mapInArrow(run, "tile long, lo array<int>, hi array<int>, fps binary")


def tile_pairs(tiled: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs a <= b of tiles whose count ranges are within the radius. They meet on the first word's count."""
    a = tiled.select(F.col("tile").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(F.sequence(F.col("lo")[0] - radius, F.col("hi")[0] + radius)).alias("count"))
    b = tiled.select(F.col("tile").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.explode(F.sequence(F.col("lo")[0], F.col("hi")[0])).alias("count"))
    apart = sum((F.greatest(F.col("lo_a")[k] - F.col("hi_b")[k], F.col("lo_b")[k] - F.col("hi_a")[k], F.lit(0)) for k in range(4)), F.lit(0))
    return a.join(b, "count").where((F.col("a") <= F.col("b")) & (apart <= radius)).select("a", "b").distinct()


class _Forest:
    """Union-find over n places; union() takes arrays."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def union(self, i: np.ndarray, j: np.ndarray) -> None:
        i, j = self.find(i), self.find(j)
        apart = i != j
        if not apart.any():
            return
        for x, y in np.unique(np.stack([np.minimum(i, j)[apart], np.maximum(i, j)[apart]], 1), axis=0):
            x, y = self.find(np.array([x, y]))
            if x != y:
                self.root[max(x, y)] = min(x, y)

    def find(self, x: np.ndarray) -> np.ndarray:
        up = self.root[x]
        while ((top := self.root[up]) != up).any():
            up = top
        self.root[x] = up
        return up

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        top = self.find(np.arange(len(self.root)))
        child = np.flatnonzero(top != np.arange(len(top)))
        return child, top[child]


def compare(a: np.ndarray, b: np.ndarray, same: bool, radius: int = RADIUS, sub: int = SUB) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between a and b (or within a): pairs of linked fingerprints."""
    both = a if same else np.concatenate([a, b])
    forest, shift = _Forest(len(both)), 0 if same else len(a)
    starts_a, starts_b = np.arange(0, len(a), sub), np.arange(0, len(b), sub)
    ca, cb = counts_of(a), counts_of(b)
    lo_a, hi_a = np.minimum.reduceat(ca, starts_a), np.maximum.reduceat(ca, starts_a)
    lo_b, hi_b = np.minimum.reduceat(cb, starts_b), np.maximum.reduceat(cb, starts_b)
    apart = np.maximum(np.maximum(lo_a[:, None] - hi_b[None], lo_b[None] - hi_a[:, None]), 0).sum(2)
    near = apart <= radius
    if same:
        near = np.triu(near)
    for x, y in zip(*np.nonzero(near), strict=True):
        i, j = starts_a[x], starts_b[y]
        found = np.nonzero(np.bitwise_count(a[i : i + sub, None] ^ b[None, j : j + sub]) <= radius)
        if len(found[0]):
            forest.union(found[0] + i, found[1] + j + shift)
    child, top = forest.stars()
    return both[child], both[top]


def links(tiled: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: a forest of the links for each pair of tiles."""
    pairs = tile_pairs(tiled, radius)
    fps = tiled.select("tile", "fps")
    loaded = pairs.join(fps.select(F.col("tile").alias("a"), F.col("fps").alias("fps_a")), "a").join(fps.select(F.col("tile").alias("b"), F.col("fps").alias("fps_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, fps_a, fps_b in zip(*batch.columns, strict=True):
                x, y = compare(*(np.frombuffer(f.as_buffer(), np.uint64) for f in (fps_a, fps_b)), a.as_py() == b.as_py(), radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return loaded.repartition("a", "b").mapInArrow(run, "a long, b long")


def simhash_dedup(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links), root (a number of the
    component) and h (XXH64 of the text by Spark, which tells rows with one id apart)."""
    printed = saved(fingerprints(docs, words), "simhash")
    classes = saved(printed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "classes")
    roots = connected_components(links(saved(tiles(classes, tile), "tiles"), radius))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    labelled = rooted.join(least, "root").select("fp", "component_id", "root")
    return printed.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "h")

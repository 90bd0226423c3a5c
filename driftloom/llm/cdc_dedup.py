"""Substring dedup by content-defined chunks.

A gear hash rolls over each text: h = (h << 1) + G[byte], 32 bits, so that it depends on the last 32 bytes. A chunk ends
where the hash's top bits are zero, not before `shortest` bytes and at `longest` bytes at the latest, and never within a
character. As ends depend on the bytes around them alone, an insertion shifts no chunk but those next to it. Chunks are
compared by 128-bit digests over the whole corpus; the first copy (in the order of doc_id, text hash, position) stays. Of
the later ones, those that touch form runs, and runs of at least `least_run` bytes are removed; shorter ones are left, as
single lines and phrases repeat by chance.

Rows that repeat both id and text count as one document, and each gets its result. Null texts are empty and have no chunk.
Null ids are one id, before all others. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches
from .spans import KEY, bodies_of, remove_spans

SHORTEST, LONGEST, BITS = 16, 160, 5
LEAST_RUN = 120
GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(a: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the number of bytes it has seen."""
    h = GEAR[a]
    for step in (1, 2, 4, 8, 16):
        if len(h) <= step:
            break
        h = np.concatenate([h[:step], h[step:] + (h[:-step] << np.uint32(step))])
    return h


def cuts(data: bytes, shortest: int = SHORTEST, longest: int = LONGEST, bits: int = BITS) -> list[int]:
    """Where chunks start and the last one ends."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return [0]
    starts_char = np.append((a[1:] & 0xC0) != 0x80, True)
    last, out = 0, [0]

    def forced(upto: int) -> None:
        nonlocal last
        while upto - last > longest:
            last += longest
            while last < len(a) and a[last] & 0xC0 == 0x80:
                last += 1
            out.append(last)

    for c in (np.flatnonzero((gear_hashes(a) >> np.uint32(32 - bits) == 0) & starts_char) + 1).tolist():
        forced(c)
        if c - last >= shortest:
            last = c
            out.append(c)
    forced(len(a))
    if last < len(a):
        out.append(len(a))
    return out


def chunks(bodies: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """KEY, a, b (the chunk's bytes), d1, d2 (its digest)."""
    small_batches(bodies.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            starts, ends, digests, numbers = [], [], [], []
            for text in batch.column(2):
                data = text.as_buffer().to_pybytes()
                at = cuts(data, shortest, longest, bits)
                starts += at[:-1]
                ends += at[1:]
                digests += [digest(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                numbers.append(len(at) - 1)
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), numbers))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])], ["doc_id", "h", "a", "b", "d1", "d2"])

    return bodies.mapInArrow(run, f"{KEY}, a int, b int, d1 long, d2 long")


def repeated_chunks(bodies: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """KEY, a, b, gone: chunks that occur twice or more; gone: not the first copy."""
    every = saved(chunks(bodies, shortest, longest, bits), "chunks")
    # half of the digest finds those that may repeat with less to shuffle
    twice = saved(every.groupBy("d1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "digests")
    some = saved(every.join(twice, "d1"), "some-chunks")
    place = F.struct("doc_id", "h", "a")
    groups = saved(some.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.max(place).alias("final")).where("not (first <=> final)").drop("final"), "chunk-groups")
    return some.join(groups, ["d1", "d2"]).select("doc_id", "h", "a", "b", (~place.eqNullSafe(F.col("first"))).alias("gone"))


def cdc_dedup(docs: DataFrame, shortest: int = SHORTEST, longest: int = LONGEST, bits: int = BITS, least_run: int = LEAST_RUN, keep_text: bool = True) -> DataFrame:
    bodies = bodies_of(docs)
    return remove_spans(bodies, repeated_chunks(bodies, shortest, longest, bits), keep_text, least_run)

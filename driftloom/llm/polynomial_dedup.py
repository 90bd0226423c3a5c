"""Exact dedup by composable polynomial fingerprints.

A text without ASCII white space is cut into chunks of fixed byte length. Each chunk is hashed as a polynomial modulo two
primes, all chunks of a text at once, and the chunk hashes are combined by length-shifted arithmetic,
H(A+B) = H(A) * r^|B| + H(B). Rows whose fingerprints and lengths agree are then compared byte by byte, chunk after chunk,
with the row that their group would keep; a row that differs goes on in a group of its own text.

Nulls count as empty texts, and empty texts are equal to each other. Each input row gives one result row, repeated rows and
null ids too; a null doc_id sorts after all others. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

#: Two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1048583, 805306457)
CHUNK = 1 << 15
WHITE = b" \t\n\x0b\x0c\r"


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base^(n-1), ..., base, 1 modulo prime."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:  # doubles the part that is filled
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += step
    return out[::-1].copy()


class Fingerprinter:
    """Fingerprints of byte strings; combine() joins those of adjacent strings."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk = chunk
        self.powers = [_powers(b, p, chunk) for b, p in zip(BASES, PRIMES, strict=True)]

    def chunks(self, data: bytes) -> list[tuple[int, int, int]]:
        """(hash, hash, length) of each chunk; the full ones are hashed together."""
        a = np.frombuffer(data, np.uint8)
        full = len(a) // self.chunk
        head = a[: full * self.chunk].reshape(full, self.chunk)
        tail = a[full * self.chunk :].astype(np.uint64)
        both = []
        for powers, prime in zip(self.powers, PRIMES, strict=True):
            p = np.uint64(prime)
            hs = [int((row.astype(np.uint64) @ powers) % p) for row in head]
            if len(tail):
                hs.append(int((tail @ powers[self.chunk - len(tail) :]) % p))
            both.append(hs)
        lengths = [self.chunk] * full + ([len(tail)] if len(tail) else [])
        return list(zip(*both, lengths, strict=True))

    @staticmethod
    def combine(parts: Iterable[tuple[int, int, int]]) -> tuple[int, int, int]:
        h0 = h1 = n = 0
        for a, b, length in parts:
            h0 = (h0 * pow(BASES[0], length, PRIMES[0]) + a) % PRIMES[0]
            h1 = (h1 * pow(BASES[1], length, PRIMES[1]) + b) % PRIMES[1]
            n += length
        return h0, h1, n

    def of(self, data: bytes) -> tuple[int, int, int]:
        return self.combine(self.chunks(data))


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE)


def fingerprints(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, h (a hash of the text), fp (both hashes), n_bytes, text_sha256 and the normalised text as body."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Fingerprinter(chunk)
        for batch in batches:
            bodies = [normalised(x.as_py()) for x in batch.column(1)]
            hashed = [printer.of(b) for b in bodies]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    batch.column(3),
                    pa.array([(h0 << 31) | h1 for h0, h1, _ in hashed], pa.int64()),
                    pa.array([n for _, _, n in hashed], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()),
                    pa.array(bodies, pa.binary()),
                ],
                ["doc_id", "n_chars", "h", "fp", "n_bytes", "text_sha256", "body"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.xxhash64("text").alias("h"))
    return rows.mapInArrow(run, "doc_id long, n_chars long, h long, fp long, n_bytes long, text_sha256 string, body binary")


def _differing(pairs: DataFrame, chunk: int) -> DataFrame:
    """Rows of pairs (fp, n_bytes, text_sha256, body, kept_body) whose bodies aren't the same, compared chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = []
            for i in range(batch.num_rows):
                a, b = (memoryview(batch.column(k)[i].as_buffer()) for k in (3, 4))
                if len(a) != len(b) or any(a[s : s + chunk] != b[s : s + chunk] for s in range(0, len(a), chunk)):
                    odd.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(odd, pa.int64())) for k in range(3)], ["fp", "n_bytes", "text_sha256"])

    return pairs.select("fp", "n_bytes", "text_sha256", "body", "kept_body").mapInArrow(run, "fp long, n_bytes long, text_sha256 string")


def polynomial_dedup(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, h (XXH64 of the text by Spark).

    Of equal texts the row with the most code points in the original text stays, then the smallest doc_id; where that row
    itself is repeated (same id and text), each repetition has kept set, as ids can't tell them apart.
    """
    printed = saved(fingerprints(docs, chunk), "fingerprints")
    return _grouped(printed, chunk)


def _grouped(printed: DataFrame, chunk: int) -> DataFrame:
    best = F.min(F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("best")
    key = ["fp", "n_bytes"]
    shared = printed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), best).where("n > 1").select(*key, "best")
    # written tables between a join and what groups its rows let Spark split the join of a group of very many copies
    best_rows = printed.join(saved(shared, "shared"), key).where((F.col("n_chars") == -F.col("best.less")) & F.col("doc_id").eqNullSafe(F.col("best.id")))
    keeper = saved(best_rows.select(*key, "body"), "best-rows").groupBy(*key).agg(F.min("body").alias("kept_body"))
    odd = _differing(printed.select(*key, "text_sha256", "body").join(saved(keeper, "kept-texts"), key), chunk).distinct().withColumn("own", F.col("text_sha256"))
    rows = printed.drop("body").join(saved(odd, "collisions"), [*key, "text_sha256"], "left").withColumn("own", F.coalesce("own", F.lit("")))
    key = [*key, "own"]
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), best)
    return rows.join(saved(groups, "groups"), key).select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n_chars") == -F.col("best.less"))).alias("kept"),
        "text_sha256",
        "h",
    )

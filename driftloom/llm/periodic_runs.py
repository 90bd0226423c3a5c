"""Runs of words that repeat with a period, and texts collapsed to the first period of each run.

Karp-Miller-Rosenberg naming: the words of a text are numbered, and level k + 1 names each stretch of 2**(k+1) words by the
pair of names that its halves have at level k, so that two stretches of a level are equal just if their names are. Names are
exact: no hashes and no suffix order. A stretch that occurs once has no equal, nor has any longer one that holds it, so only
those named twice or more go on to the next level, and naming ends at the level where none does.

A run of period p has at least four periods. Of the grid places 0, p, 2p, ... the first in the run has at least 2p + 1 words
in common with the place p later, so that places whose names differ at the level of the greatest power of two up to 2p + 1
are left out at once. What is left is extended to both sides by the levels in falling order, each by at most one step, which
gives the length of the longest common extension. Of equal stretches the smallest period counts; with four periods the
others are its multiples.

Work and memory for a text of n words are n log n at most; places are taken in blocks of BLOCK. A task holds one Arrow batch
of texts and the names of one text.

Null texts are empty and have no run. Rows that repeat id and text each get their result. Every input row gives one result
row, an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, small_batches

LEAST_LENGTH = 6
LEAST_PERIODS = 4
BLOCK = 1 << 20


def names(words: list[bytes]) -> list[np.ndarray]:
    """At level k the name of the 2**k words from each place, or -1 if they occur once."""
    known: dict[bytes, int] = {}
    first = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    levels = [np.where(np.bincount(first)[first] > 1, first, -1) if len(words) else first]
    while True:
        name, step = levels[-1], 1 << len(levels) - 1
        both = np.flatnonzero((name[:-step] >= 0) & (name[step:] >= 0)) if len(name) > step else np.empty(0, np.int64)
        if len(both) < 2:
            return levels
        pairs, own, n = np.unique(name[both] * (int(name.max()) + 1) + name[both + step], return_inverse=True, return_counts=True)
        if len(pairs) == len(both):
            return levels
        level = np.full(len(name) - step, -1, np.int64)
        level[both] = np.where(n[own] > 1, own, -1)
        levels.append(level)


def _alike(level: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the stretches of a level from a and from b, a < b, are equal; False where one doesn't fit in."""
    fits = (a >= 0) & (b < len(level))
    out = np.zeros(len(a), bool)
    name = level[a[fits]]
    out[fits] = (name >= 0) & (name == level[b[fits]])
    return out


def extension(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """Longest common extension of the places a < b: how many words from them on, or before them, are equal."""
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):  # it is shorter than twice the longest stretches with a name
        step = 1 << k
        more = _alike(levels[k], a - got - step, b - got - step) if back else _alike(levels[k], a + got, b + got)
        got[more] += step
    return got


def _grid(n: int, last: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Periods 1 to last and the places that are multiples of them with two periods behind, in blocks."""
    p = 1
    while p <= last:
        q = min(last, p + max(1, BLOCK * p // n) - 1)
        period = np.arange(p, q + 1)
        count = np.maximum(0, (n - 2 * period) // period + 1)
        own = np.repeat(period, count)
        yield own, (np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)) * own
        p = q + 1


def runs(words: list[bytes], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start and period. least_periods: 3 or more."""
    n = len(words)
    levels = names(words)
    # a run's first grid place shares (least_periods - 2) * p + 1 words with the next
    last = min(n // least_periods, ((1 << len(levels)) - 2) // (least_periods - 2)) if n else 0
    found: dict[tuple[int, int], int] = {}
    for period, place in _grid(n, last):
        need = np.frexp((least_periods - 2) * period + 1)[1] - 1  # the level of the greatest power of two up to it
        kept = np.zeros(len(place), bool)
        for k in np.unique(need):
            at = np.flatnonzero(need == k)
            kept[at] = _alike(levels[k], place[at], place[at] + period[at])
        p, g = period[kept], place[kept]
        start = g - extension(levels, g, g + p, back=True)
        length = g + p + extension(levels, g, g + p) - start
        enough = (length >= np.maximum(least_length, least_periods * p)) & (g - start < p)  # of a run's places the first
        for s, m, q in zip(start[enough].tolist(), length[enough].tolist(), p[enough].tolist(), strict=True):
            found[s, m] = min(q, found.get((s, m), q))
    return sorted((s, m, q) for (s, m), q in found.items())


def collapsed(words: list[bytes], own: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run has after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, m, q in own:
        gone[s + q] += 1
        gone[s + m] -= 1
    return [w for w, x in zip(words, np.cumsum(gone).tolist(), strict=False) if not x]


def periodic_runs(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run with the most periods, runs_sha256, collapsed_sha256 and, if asked for, runs and collapsed (the text)."""
    small_batches(docs.sparkSession)
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    fields = [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    fields += [("runs", pa.list_(triple)), ("collapsed", pa.string())] * keep_text
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" * keep_text

    def row(doc_id: int | None, data: bytes) -> tuple:
        words = data.split()
        own = runs(words)
        most = max(own, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        head = (*most, 1000 * most[1] // most[2]) if most else (None,) * 4
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in own).encode()
        left = b" ".join(collapsed(words, own) if own else words)
        out = (doc_id, len(own), *head, hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest())
        return (*out, [dict(zip(("start", "length", "period"), x, strict=True)) for x in own], left.decode()) if keep_text else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [row(i, t.as_buffer().to_pybytes()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            columns = zip(*found, strict=True) if found else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: in one row of ten, by a hash of the id, the words from some place on are replaced by those of one period.

    With h the CRC-32 of the id as text, g = h div 10 and n words, rows with h % 10 = 0 have word i >= a = g % n replaced by word
    a + (i - a) % p, where p = 1 + (n - a) div (3 + g % 8). Rows without id or word stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", f"{SPACE_CLASS}+"), lambda w: w != "")
    # a column of its own, so that it is split once and not for every word
    rows = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words").cast("long")
    rows = rows.withColumns({"g": F.floor(F.col("h") / 10), "n": n}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    at = lambda i: F.when(i < F.col("a"), i + 1).otherwise((F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))
    changed = F.transform("words", lambda w, i: F.element_at("words", at(i)))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(changed, " ")).otherwise(F.col("text")).alias("text"))

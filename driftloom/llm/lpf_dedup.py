"""Substring dedup with longest-previous-factor arrays.

A byte is repeated when a string of `least` bytes that covers it also starts elsewhere, in the same document or another.
n_shared counts, besides, the bytes that strings of `shared` bytes cover so; that is reported, not removed.

A suffix array of the whole corpus is not built; suffixes are brought together by seeds, and each seed has its own. Every
window of `shared` bytes picks the leftmost least hash among the 16-byte strings that start in its first `span` bytes;
equal windows pick the same place, and the `shared - span + 1` bytes from there are its seed. Windows with the same pick
form a run; its text goes from its first window to `least` bytes after the start of its last. Runs with equal seeds and
texts are a class, which is represented by its first and its last run. Of a seed that occurs twice, the texts of all
classes come to one task. They are put into suffix order there, byte by byte, with their common prefixes: sorted from the
seed on, and then once for each byte before it. At each step the previous and the next smaller place in suffix order give
the longest previous factor of the suffixes that begin there. Where it reaches `least`, a window is a later copy, and the
place that it was found at is an earlier one. What holds for the last run of a class holds for all but its first.

A seed with more than `most_texts` classes is split: its runs are cut into shorter ones, whose windows have longer strings
in common; these are the new seeds. This goes on, down to single windows and then to their `least` bytes, which make one
class of each seed, so that no task meets an unbounded group.

keep_first leaves the first copy (in the order of doc_id, text hash, position) and removes later ones; without it all are
removed. Rows that repeat both id and text count as one document, and each gets its result. Null texts are empty; texts of
less than `shared` bytes have no window. Null ids are one id of their own, before all others. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, small_batches
from .spans import KEY, bodies_of, by_document, joined, remove_spans

LEAST = 400
#: Bytes from which on a repeated string is reported.
SHARED = 288
SPAN = 172
GRAM = 16
#: Classes of a seed, of two texts each, that one task puts in order (in about 50 MB); seeds with more are split.
MOST_TEXTS = 1 << 14
#: Texts that are put in order at a time: whole seeds, until there are so many.
BATCH_TEXTS = 8192
_MIX = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
RUN = f"{KEY}, at int, lo int, hi int, s long, u long"
#: A seed, a text and the place of the seed in it. Seeds need not be told apart for certain, as their bytes are put in order too.
CLASS = ["s", "u", "lo", "hi"]
PLACE = ["doc_id", "h", "at"]
_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}


def _arrays(schema: str, columns: list) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def rolling(a: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes, modulo 2^64, of all strings of this many bytes (a power of two), by doubling."""
    with np.errstate(over="ignore"):
        power, size, part = _BASE, 1, _MIX[a]
        while size < width:
            part = part[:-size] * power + part[size:]
            power, size = power * power, size * 2
    return part


def runs(data: bytes, shared: int = SHARED, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with the same pick: the pick, the first and the last window's start."""
    a = np.frombuffer(data, np.uint8)
    n = len(a) - shared + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    grams = rolling(a[: n + span + GRAM - 2], GRAM)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= span:  # least over size places, then over span places
        key, size = np.minimum(key[:-size], key[size:]), size * 2
    pick = (np.minimum(key[:n], key[span - size : span - size + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(pick, prepend=-1))
    return pick[first], first, np.append(first[1:], n) - 1


class _Rows:
    """Collects runs of one batch. A run: windows of a document that start lo to hi bytes before `at`, where its seed is."""

    def __init__(self, least: int):
        self.least, self.ids, self.numbers, self.digests = least, ([], []), ([], [], []), []

    def add(self, doc_id: int | None, h: int, data: bytes, at: list[int], lo: list[int], hi: list[int], seed_bytes: int) -> None:
        digest, least = xxhash.xxh3_64_digest, self.least
        self.digests += [digest(data[p : p + seed_bytes]) + digest(data[p - b : p - a + least]) for p, a, b in zip(at, lo, hi, strict=True)]
        for column, value in zip(self.ids, (doc_id, h), strict=True):
            column.extend([value] * len(at))
        for column, values in zip(self.numbers, (at, lo, hi), strict=True):
            column.extend(values)

    def batch(self) -> pa.RecordBatch:
        d = np.frombuffer(b"".join(self.digests), np.int64).reshape(-1, 2)
        return _arrays(RUN, [*self.ids, *self.numbers, *d.T])


def _seeded(bodies: DataFrame, least: int, shared: int, span: int) -> DataFrame:
    """All runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(least)
            for doc_id, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                pick, first, last = runs(data, shared, span)
                rows.add(doc_id, h, data, pick.tolist(), (pick - last).tolist(), (pick - first).tolist(), shared - span + 1)
            yield rows.batch()

    return bodies.mapInArrow(run, RUN)


def _split(bodies: DataFrame, crowded: DataFrame, least: int, window: int, width: int) -> DataFrame:
    """Runs cut into runs of at most width windows, with the longer seeds that `window` bytes of these have in common."""
    wanted = saved(by_document(crowded, ["at", "lo", "hi"], "own"), "crowded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(least)
            for doc_id, h, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes()
                for x in own:
                    for d in range(x["lo"] // width * width, x["hi"] + 1, width):
                        at, lo, hi = x["at"] - d, max(x["lo"] - d, 0), min(x["hi"] - d, width - 1)
                        if at - lo + window <= len(data):
                            rows.add(doc_id, h, data, [at], [lo], [hi], window - width + 1)
            yield rows.batch()

    return joined(bodies, wanted, "inner").select("doc_id", "h", "text", "own").mapInArrow(run, RUN)


def _twice(rows: DataFrame) -> DataFrame:
    """The runs whose seed occurs twice or more."""
    rows = saved(rows, "runs")
    seeds = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    kept = saved(rows.join(saved(seeds, "seeds"), ["s"], "left_semi"), "seeded-runs")
    discard(rows)
    return kept


def previous_smaller(v: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1, by following those found so far."""
    at = np.arange(-1, len(v) - 1)
    todo = np.flatnonzero(v[:-1] > v[1:]) + 1
    while len(todo):
        up = at[at[todo]]
        at[todo] = up
        todo = todo[(up >= 0) & (v[up] > v[todo])]
    return at


class Least:
    """Least of any range of an array, by tables over ranges of 1, 2, 4, ... places up to `most`."""

    def __init__(self, values: np.ndarray, most: int):
        self.tables = [values]
        while (size := 1 << len(self.tables)) <= most and size <= len(values):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[: len(last) - size // 2], last[size // 2 :]))
        self.flat = np.concatenate(self.tables)
        self.starts = np.cumsum([0, *(len(t) for t in self.tables[:-1])])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over places a to b, both included."""
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        start = self.starts[level]
        return np.minimum(self.flat[start + a], self.flat[start + b + 1 - (1 << level)])


def previous_factors(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, texts: list[bytes], width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factors, up to depth bytes, of the suffixes that start lo to hi bytes before the seeds of texts.

    Texts come by group (their seed) and in a group by place; a text's seed is at its byte hi. Returned by text and
    distance: the factor's length, and the greatest length with which a later suffix found this one as its factor.
    """
    n = len(texts)
    held = np.full((n, 4 + depth), 255, np.uint8)  # 255 isn't a byte of UTF-8
    held[:, :4] = group.astype(">u4").view(np.uint8).reshape(n, 4)
    before = np.zeros((width, n), np.uint8)
    for k, (x, b) in enumerate(zip(texts, hi.tolist(), strict=True)):
        own = np.frombuffer(x, np.uint8)
        held[k, 4 : 4 + len(own) - b] = own[b:]
        before[:b, k] = own[:b][::-1]
    sizes = np.array([len(x) for x in texts]) - hi
    order = np.argsort(held.view(f"S{4 + depth}").ravel(), kind="stable")
    differ = held[order[1:]] != held[order[:-1]]
    common = np.zeros(n, np.int32)
    common[1:] = np.where(differ.any(1), differ.argmax(1), 4 + depth) - 4
    same_group = np.zeros(n, bool)
    same_group[1:] = group[order][1:] == group[order][:-1]
    common[~same_group] = 0
    most = int(np.bincount(group - group[0]).max())
    factor, source = np.zeros((n, width), np.int16), np.zeros((n, width), np.int16)
    for d in range(width):
        if d:
            left = hi[order] >= d
            if not left.all():  # texts that begin later than this don't come back
                places = np.flatnonzero(left)
                if not len(places):
                    break
                common = np.minimum.reduceat(common[: places[-1] + 1], np.append(0, places[:-1] + 1))
                order = order[places]
            key = group[order].astype(np.int64) << 8 | before[d - 1][order]
            by = np.argsort(key, kind="stable")
            least = Least(common, most)
            key = key[by]
            joint = np.flatnonzero(key[1:] == key[:-1]) + 1
            common = np.zeros(len(order), np.int32)
            common[joint] = np.minimum(least.of(by[joint - 1] + 1, by[joint]) + 1, depth)
            order = order[by]
        active = np.flatnonzero(lo[order] <= d)
        if len(active) < 2:
            continue
        own = order[active]
        lcp = np.minimum.reduceat(common[: active[-1] + 1], np.append(0, active[:-1] + 1))
        if not (lcp[1:] > 0).any():
            continue
        least, g = Least(lcp, most), group[own].astype(np.int64) << 32
        up = previous_smaller(g + own)
        down = len(own) - 1 - previous_smaller((own - g)[::-1])[::-1]
        for other in (up, down):
            k = np.flatnonzero((other >= 0) & (other < len(own)))
            k = k[group[own[k]] == group[own[other[k]]]]
            i, j = own[k], own[other[k]]
            found = np.minimum(least.of(np.minimum(k, other[k]) + 1, np.maximum(k, other[k])), sizes[i] + d).astype(np.int16)
            factor[i, d] = np.maximum(factor[i, d], found)
            np.maximum.at(source[:, d], j, found)
    return factor, source


def _stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each stretch of true cells."""
    edge = np.zeros((hit.shape[0], hit.shape[1] + 2), np.int8)
    edge[:, 1:-1] = hit
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


def _ordered(cut: DataFrame, least: int, shared: int, width: int, keep_first: bool) -> DataFrame:
    """Distances d0 to d1 before `at` where windows of runs are repeated. cut: CLASS, PLACE, body. gone: they reach least bytes
    and are to be removed. rest: this holds for all runs of the class but that at (doc_id, h, at)."""
    schema = f"s long, u long, lo int, hi int, {KEY}, at int, rest boolean, gone boolean, d0 int, d1 int"

    def solve(held: list[tuple]) -> pa.RecordBatch:
        group = np.cumsum([0, *(x[0] != y[0] for x, y in zip(held[1:], held, strict=False))])
        lo, hi = (np.array([x[k] for x in held]) for k in (2, 3))
        factor, source = previous_factors(group, lo, hi, [x[7] for x in held], width, least)
        first: dict[tuple, int] = {}
        firsts = np.array([first.setdefault(x[:4], k) for k, x in enumerate(held)])
        out: list[list] = [[], [], [], []]
        for gone, hit in ((True, factor >= least if keep_first else np.maximum(factor, source) >= least), (False, np.maximum(factor, source) >= shared)):
            row, d0, d1 = _stretches(hit)
            for column, values in zip(out, (row, [gone] * len(row), d0, d1), strict=True):
                column.append(values)
        row, gone, d0, d1 = (np.concatenate(c) for c in out)
        at = [held[k] for k in firsts[row]]
        columns = [[x[k] for x in at] for k in range(7)]
        return _arrays(schema, [*columns, firsts[row] != row, gone.astype(bool), d0, d1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(held) >= BATCH_TEXTS and x[0] != held[-1][0]:
                    yield solve(held)
                    held = []
                if not held or x[:7] != held[-1][:7]:  # else a row that repeats id and text
                    held.append(x)
        if held:
            yield solve(held)

    rows = cut.select(*CLASS, *PLACE, "body")
    return rows.repartition("s").sortWithinPartitions("s", *PLACE).mapInArrow(run, schema)


def _cut(bodies: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """Texts of runs, with their classes and places."""
    wanted = saved(by_document(asked, ["at", *CLASS], "own"), "asked")
    schema = f"s long, u long, lo int, hi int, {KEY}, at int, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for doc_id, h, text, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data = text.as_buffer()
                for x in own:
                    a, b = x["at"] - x["hi"], min(x["at"] - x["lo"] + least, len(data))
                    for column, value in zip(columns, (*(x[k] for k in CLASS), doc_id, h, x["at"], data[a:b].to_pybytes()), strict=True):
                        column.append(value)
                if len(columns[0]) > 20_000:
                    yield _arrays(schema, columns)
                    columns = [[] for _ in range(8)]
            yield _arrays(schema, columns)

    return joined(bodies, wanted, "inner").select("doc_id", "h", "text", "own").mapInArrow(run, schema)


def repeated_spans(bodies: DataFrame, least: int = LEAST, shared: int = SHARED, span: int = SPAN, most_texts: int = MOST_TEXTS, keep_first: bool = False) -> DataFrame:
    """doc_id, h, a, b, gone: byte ranges, which may overlap, that cover all repeated bytes; those with gone set are to be
    removed, the others have strings of `shared` bytes that also start elsewhere. bodies: as bodies_of() gives them."""
    small_batches(bodies.sparkSession)
    levels = [(shared, span)]
    while levels[-1][1] > 1:
        levels.append((shared, -(-levels[-1][1] // 8)))
    levels.append((least, 1))
    rows, found = _seeded(bodies, least, shared, span), None
    for k, (window, width) in enumerate(levels):
        if k:
            rows = _split(bodies, rows, least, window, width)
        rows = _twice(rows)
        place = F.struct(*PLACE)
        classes = saved(rows.groupBy(*CLASS).agg(F.min(place).alias("first"), F.max(place).alias("final")), "classes")
        crowded = saved(classes.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > (most_texts if k + 1 < len(levels) else 1 << 62)).drop("n"), "crowded-seeds")
        split = not crowded.isEmpty()
        calm = classes.join(crowded, ["s"], "left_anti") if split else classes
        asked = calm.select(*CLASS, F.explode(F.array_distinct(F.array("first", "final"))).alias("x")).select(*CLASS, "x.*")
        solved = saved(_ordered(_cut(bodies, asked, least), least, shared, width, keep_first), "factors")
        others = rows.join(solved.where("rest").select(*CLASS, place.alias("first"), "gone", "d0", "d1"), CLASS).where(~place.eqNullSafe(F.col("first")))
        own = [*PLACE, "gone", "d0", "d1"]
        end = F.col("at") - F.col("d0") + F.when(F.col("gone"), F.lit(least)).otherwise(F.lit(shared))
        spans = solved.where("not rest").select(*own).union(others.select(*own)).select("doc_id", "h", (F.col("at") - F.col("d1")).alias("a"), end.alias("b"), "gone")
        rows = saved(rows.join(crowded, ["s"], "left_semi"), "crowded-runs") if split else rows
        if split and levels[k + 1][0] > window:  # single windows: the seed is all that is compared at this length
            spans = spans.union(rows.select("doc_id", "h", F.col("at").alias("a"), (F.col("at") + window).alias("b"), F.lit(False)))
        found = saved(spans if found is None else found.union(spans), "repeats")
        if not split:
            break
    return found


def lpf_dedup(docs: DataFrame, least: int = LEAST, keep_first: bool = True, shared: int = SHARED, span: int = SPAN, most_texts: int = MOST_TEXTS, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared and, if asked for, spans and kept (bytes)."""
    texts = bodies_of(docs)
    return remove_spans(texts, repeated_spans(texts, least, shared, span, most_texts, keep_first), keep_text)

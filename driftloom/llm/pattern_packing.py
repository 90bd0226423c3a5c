"""Best-fit packing by length patterns and non-negative least squares.

Documents become token ids and an end id, longer ones are cut into full pieces and a last one. The histogram of piece
lengths (as many entries as a sequence has tokens, whatever the corpus) goes to the driver. There, patterns of two to four
lengths that fill a sequence are enumerated, repeat counts are fitted to the histogram by non-negative least squares, and
rounded so that no length is used more often than it occurs; what is left is packed largest first, each time with the best
fit. The plan goes out with the tasks: the i-th piece of a length takes the i-th place that the plan has for this length.

A null text is empty and has the end id alone. Every input row is packed, repeated rows and null ids too. Other columns are
ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, saved, small_batches

CAPACITY = 2048
END_ID = 0
#: Bound of a worker's table of words, in bytes as estimated: KEY_BYTES for each, and its characters and ids.
MOST_BYTES = 160 << 20
KEY_BYTES = 150
#: Bytes of texts that are encoded together; what they repeat is looked up once.
TEXT_BYTES = 8 << 20


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of flat with these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Known:
    """Ids by string. It forgets all when it grows beyond MOST_BYTES."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat, self.starts, self.sizes, self.bytes = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def of(self, keys: list[str], learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where they start and how many there are of each key. learn gives those of new keys, and how many each has."""
        number = np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))
        if (number < 0).any():
            if self.bytes > MOST_BYTES:
                self.__init__()
            new = [k for k in dict.fromkeys(keys) if k not in self.number]
            ids, sizes = learn(new)
            self.number.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])
            self.bytes += KEY_BYTES * len(new) + 2 * sum(map(len, new)) + 4 * len(ids)
            number = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
        return self.flat, self.starts[number], self.sizes[number]


class Tokenizer:
    """The ids of a tokenizers file. Words are looked up where that can't change a
    text's ids: the file splits texts at white space and into words before it merges, and the characters of PLAIN have the
    same case and class in Python's tables as in the file's library. New words go to it together, other texts whole."""

    PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA0-\u012F\u0132-\u024F\u2010-\u2027\u20AC]*")
    WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    PARTS = regex.compile(WORDS.pattern + r"|\n")
    #: Control characters, at some of which Arrow splits, and what may be a special token.
    ODD = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|<\|"

    def __init__(self, path: str):
        from tokenizers import Tokenizer as File

        self.file = File.from_file(path)
        self.by_word = self._splits_words(path)
        vocabulary = self.file.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.words = Known()

    @staticmethod
    def _splits_words(path: str) -> bool:
        """Whether the file's normalizer and pre-tokenizer are those that by_word stands for."""
        import json

        with open(path, encoding="utf-8") as f:
            x = json.load(f)
        normal = [n["type"] for n in (x["normalizer"] or {}).get("normalizers", [])]
        split = (x["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        return normal == ["NFC", "Replace", "Lowercase"] and split == Tokenizer.WORDS.pattern and not x["post_processor"]

    def _slow(self, text: str) -> bytes:
        return np.array(self.file.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def __call__(self, text: str | None) -> bytes:
        return self.encoded(pa.array([text], pa.string()))[0]

    def encoded(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers; a null text has none."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.ODD).to_numpy(zero_copy_only=False).copy()
        if not self.by_word:
            whole[:] = True
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", texts))
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        chunks, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        odd = np.empty(0, np.int64)
        if not self.PLAIN.fullmatch("\n".join(chunks)):
            plain = [bool(self.PLAIN.fullmatch(x)) for x in chunks]
            odd = np.flatnonzero(~np.array(plain))
            chunks = [x if good else "" for x, good in zip(chunks, plain, strict=True)]
            whole[np.repeat(np.arange(len(texts)), np.diff(offsets))[np.isin(code, odd)]] = True
        ids, starts, sizes = self._of_chunks(chunks)
        numbers = sizes[code]
        upto = np.append(0, np.cumsum(numbers))[offsets - offsets[0]] * 4
        data = _gathered(ids, starts[code], numbers).tobytes()
        return [self._slow(texts[k].as_py()) if slow else data[a:b] for k, (slow, a, b) in enumerate(zip(whole.tolist(), upto[:-1].tolist(), upto[1:].tolist(), strict=True))]

    def _of_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of what stands between white space, where those of each start and how many there are."""
        found = self.PARTS.findall("\n".join(chunks).lower())
        lines = np.fromiter((w == "\n" for w in found), bool, len(found))
        ids, starts, sizes = self.words.of([w for w in found if w != "\n"], self._of_words)
        upto = np.append(0, np.cumsum(sizes))[np.append(np.cumsum(~lines)[lines], len(sizes))]
        return _gathered(ids, starts, sizes), np.append(0, upto[:-1]), np.diff(np.append(0, upto))

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All in one call; the last token of each is marked as a word's end."""
        ids = np.frombuffer(self._slow(" ".join(words)), "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            each = [np.frombuffer(self._slow(w), "<u4") for w in words]
            return np.concatenate(each), np.array([len(x) for x in each])
        return ids, np.diff(np.append(0, ends))


@cache
def tokenizer_of(path: str) -> Tokenizer:
    """One for each Python worker, so that a task finds the words that earlier ones learned."""
    return Tokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part (the task that made it) and, if asked for, the ids packed."""
    small_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part"] + ["ids"] * keep_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()] + [pa.binary()] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = tokenizer_of(tokenizer_path), TaskContext.get().partitionId()
        for batch in gathered(batches, TEXT_BYTES):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokenizer.encoded(batch.column(1)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own), part, own)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def enumerate_patterns(lengths: np.ndarray, capacity: int, partners: int = 12) -> np.ndarray:
    """Rows of two to four of these lengths (0: none) that add up to capacity or to just below it."""
    lengths = np.sort(lengths)
    out = []

    def best(room: np.ndarray) -> np.ndarray:
        """The longest length of at most room, or 0."""
        k = np.searchsorted(lengths, room, side="right") - 1
        return np.where(k >= 0, lengths[np.maximum(k, 0)], 0)

    a = lengths[lengths < capacity]
    if not len(a):
        return np.empty((0, 4), np.int64)
    none = np.zeros_like(a)
    out.append(np.stack([a, best(capacity - a), none, none], 1))
    for share in np.linspace(0.08, 0.92, partners):
        b = best(np.maximum((capacity - a) * share, 0))
        c = best(capacity - a - b)
        out.append(np.stack([a, b, c, none], 1))
        d = best(np.maximum((capacity - a - b) * share, 0))
        out.append(np.stack([a, b, d, best(capacity - a - b - d)], 1))
    rows = np.sort(np.concatenate(out), 1)[:, ::-1]
    return np.unique(rows, axis=0)


def fit(patterns: np.ndarray, wanted: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """Repeat counts x >= 0 for which the lengths that patterns use come near wanted (counts by length) in least squares.

    From none, each round takes the patterns along which the error falls most, as many as share no length, and gives each
    its best step; a count never turns negative. Few patterns are ever used.
    """
    x, left = np.zeros(len(patterns)), wanted.astype(float)
    left[0] = 0
    norm = (patterns[:, :, None] == patterns[:, None, :]).sum((1, 2)) - (patterns == 0).sum(1) ** 2
    worth = 1 / np.sqrt(norm)
    for _ in range(rounds):
        fall = left[patterns].sum(1)
        step = np.maximum(fall / norm, -x)
        gain = np.abs(step) * worth * norm
        best = np.argpartition(gain, -min(512, len(gain)))[-min(512, len(gain)) :]
        best = best[np.argsort(-gain[best], kind="stable")]
        taken: set[int] = set()
        chosen = []
        for j, own in zip(best.tolist(), patterns[best].tolist(), strict=True):
            if taken.isdisjoint(own):
                chosen.append(j)
                taken.update(k for k in own if k)
        if gain[chosen[0]] < 1e-3:
            break
        x[chosen] += step[chosen]
        np.subtract.at(left, patterns[chosen], step[chosen][:, None])
        left[0] = 0
    return x


def fill(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Pack counts by length: the longest that is left, then again and again the longest that fits. left is used up."""
    out = []
    top = len(left) - 1
    while top > 0:
        if left[top] == 0:
            top -= 1
            continue
        own, room = [top], capacity - top
        taken = {top: 1}
        at = min(room, top)
        while at > 0:
            if left[at] > (n := taken.get(at, 0)):
                own.append(at)
                taken[at] = n + 1
                room -= at
                at = min(room, at)
            else:
                at -= 1
        times = min(int(left[k]) // n for k, n in taken.items())
        for k, n in taken.items():
            left[k] -= n * times
        out.append((own, times))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[list[int], int]], int]:
    """Patterns of lengths and how often each is used, together every length as often as it occurs; how many are of the fit.

    Repeat counts are rounded down and to the nearest, with patterns that fill a sequence or nearly so; the rounding that
    needs the fewest sequences is taken.
    """
    wanted = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        wanted[k] = n
    tries = []
    patterns = enumerate_patterns(np.flatnonzero(wanted), capacity)
    x = fit(patterns, wanted) if len(patterns) else np.empty(0)
    waste = capacity - patterns.sum(1) if len(patterns) else np.empty(0)
    for whole, most_waste in ((np.floor, 0), (np.floor, capacity // 256), (np.round, capacity // 256)):
        left, out = wanted.copy(), []
        for j in np.lexsort((-x, waste)):
            own = [int(k) for k in patterns[j] if k]
            if waste[j] > most_waste or whole(x[j]) < 1:
                continue
            need = {k: own.count(k) for k in own}
            times = min(int(whole(x[j])), *(int(left[k]) // n for k, n in need.items()))
            if times > 0:
                out.append((own, times))
                for k, n in need.items():
                    left[k] -= n * times
        by_pattern = len(out)
        out += fill(left, capacity)
        tries.append((sum(n for _, n in out), len(tries), out, by_pattern))
    return min(tries)[2:]


def places(planned: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: where runs of its pieces start, the first sequence of each run and the offset in it."""
    out: dict[int, list] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for own, times in planned:
        offset = 0
        for k in own:
            out[k].append((used[k], sequence, offset))
            used[k] += times
            offset += k
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of pieces() with sequence_id and offset, without part. made must give the same rows whenever it is read."""
    counts = made.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    found = places(plan(totals, capacity)[0])
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = made.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("part", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for k in np.unique(length):
                own = length == k
                starts, firsts, offsets = found[int(k)]
                at = np.searchsorted(starts, rank[own], side="right") - 1
                sequence[own], offset[own] = firsts[at] + rank[own] - starts[at], offsets[at]
            kept = [i for i, c in enumerate(batch.schema.names) if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], [*(batch.schema.names[i] for i in kept), "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * keep_ids
    return pack(saved(pieces(docs, tokenizer_path, capacity, keep_ids), "pieces"), capacity).select(*columns)

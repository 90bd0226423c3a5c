"""Quality rules: lines that many documents of one host share, and what is left of a document without them.

Each text is read once: counts of words, symbols, repeated lines and repeated windows of words, and the hashes of its
normalised lines (A-Z lower-cased, digit runs as 0, white space as one blank). A line is boilerplate on a host if more than
`least_docs` distinct documents of the host have it and these are more than `share` of the host's distinct documents.
Documents with equal texts are one distinct document here: whole copies are for the dedup operators to judge, and a page
that was copied a thousand times isn't boilerplate for it. Boilerplate lines are removed; a document is depleted, and
rejected, if fewer than `least_words` words are left or more than `most_removed` of its words went.

Repeated windows are found without hashes: words are numbered within the text, pairs of numbers are numbered, and so on to
windows of five. Lines are known by 64-bit hashes, compared within a host.

Null texts are empty: no word, base_failed. A null host is a host of its own. Rows that repeat id and text each get their
result. Every input row gives one result row, an empty table an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

WINDOW = 5
LEAST_WORDS = 10
#: Of 100 words, those in repeated windows that a text may have at most.
MOST_REPEATED = 20
LEAST_DOCS = 5
SHARE = 0.02
MOST_REMOVED = 0.5
SYMBOLS = b"#*$%&|<>"
_SPACE, _DIGITS = b" \t\n\x0b\x0c\r", re.compile(rb"[0-9]+")
_LOWER = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))
_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers from 0 for pairs, equal for equal pairs."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of so many words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    single = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    name = single
    for k in range(1, window):
        name = numbered(name[: len(words) - k], single[k:])
    twice = np.flatnonzero(np.bincount(name)[name] > 1)
    ends = np.zeros(len(words) + 1, np.int64)
    np.add.at(ends, twice, 1)
    np.add.at(ends, twice + window, -1)
    return int((np.cumsum(ends) > 0).sum())


def normal(line: bytes) -> bytes:
    return _DIGITS.sub(b"0", b" ".join(line.split()).translate(_LOWER))


def examined(data: bytes) -> tuple[tuple[int, ...], dict[int, list[int]]]:
    """Counts as _STATS names them, and words and occurrences of each hashed line."""
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(_SPACE)]
    spaces = sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    chars = int((np.frombuffer(data, np.uint8) & 0xC0 != 0x80).sum()) - spaces
    own: dict[int, list[int]] = {}
    for x in lines:
        h = xxhash.xxh3_64_intdigest(normal(x))
        own.setdefault(h - (1 << 64) * (h >> 63), [0])[0] += len(x.split())
    return (len(words), chars, sum(data.count(bytes([s])) for s in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words)), own


def measured(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, host, own (a hash of the text), the counts, lines (hash and words of each distinct normalised line)."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.xxhash64(text).alias("own"), text.alias("text"))
    kind = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [examined(x.as_buffer().to_pybytes()) for x in batch.column(3)]
            counts = [pa.array(c, pa.int64()) for c in (zip(*(f[0] for f in found), strict=True) if found else [[]] * len(_STATS))]
            lines = pa.array([[{"line": h, "words": w[0]} for h, w in f[1].items()] for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *counts, lines], ["doc_id", "host", "own", *_STATS, "lines"])

    return rows.mapInArrow(run, "doc_id long, host string, own long, " + ", ".join(f"{c} long" for c in _STATS) + ", lines array<struct<line:bigint,words:bigint>>")


def frequent_lines(lines: DataFrame, contents: DataFrame, least_docs: int = LEAST_DOCS, share: float = SHARE) -> DataFrame:
    """host, line, n (distinct documents) of boilerplate lines; lines: host, line, once for each distinct document; contents: host."""
    many = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least_docs)
    sizes = contents.groupBy("host").agg(F.count(F.lit(1)).alias("of")).withColumnRenamed("host", "its_host")
    return many.join(sizes, F.col("host").eqNullSafe(F.col("its_host"))).where(F.col("n") > share * F.col("of")).select("host", "line", "n")


def line_rules(docs: DataFrame, host: str = "source", least_docs: int = LEAST_DOCS, share: float = SHARE, least_words: int = LEAST_WORDS, most_removed: float = MOST_REMOVED) -> DataFrame:
    """doc_id, the counts, n_removed (words in boilerplate lines), base_failed, kept."""
    rows = saved(measured(docs, host), "measured")
    contents = rows.select("host", "own", "lines").dropDuplicates(["host", "own"])
    lines = saved(contents.select("host", "own", F.explode("lines").alias("l")).select("host", "own", "l.line", "l.words"), "lines")
    frequent = saved(frequent_lines(lines, rows.select("host", "own").distinct(), least_docs, share), "frequent-lines")
    same = lines["host"].eqNullSafe(frequent["host"]) & (lines["line"] == frequent["line"])
    met = lines.join(frequent, same).groupBy(lines["host"].alias("its_host"), lines["own"].alias("its_own")).agg(F.sum("words").alias("n_removed"))
    found = rows.drop("lines").join(met, rows["host"].eqNullSafe(met["its_host"]) & (rows["own"] == met["its_own"]), "left")
    removed = F.coalesce("n_removed", F.lit(0))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = (F.col("n_words") - removed < least_words) | (removed > most_removed * F.col("n_words"))
    return found.select("doc_id", *_STATS, removed.alias("n_removed"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))

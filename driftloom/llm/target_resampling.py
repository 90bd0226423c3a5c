"""Draw the documents that look most like a target set, by importance weights over hashed words.

Two passes over Arrow batches. The first counts words into `buckets` by CRC-32: np.bincount gives one vector of counts for
each partition, and treeReduce merges these, so that no task and not the driver gets more than a few vectors at a time. A
bucket's gain is the log of its smoothed share among the targets over that in the corpus, in thousandths, rounded down. The
second pass takes the gains along (`buckets` whole numbers, the same size at any corpus) and sums them for each document with
np.bincount weights. Gumbel noise from a hash of the id turns the drawing without replacement into taking the highest scores.

Ranks need no global sort: the number of documents at each score gives how many lie above it, and only the drawn ones are
ordered, within each score. Scores are whole numbers in thousandths; gains lie within some 60,000 of each other and the
noise within 26,000, so that there are under 100,000 of them at any size, and the noise alone spreads equal texts so that one
score has under 0.04 % of all documents with ids of their own.

Null texts are empty: no words, weight 0. A document without words is scored and never drawn, unless least_words is 0. A null
doc_id hashes as the text `null` and comes after all others. Rows that repeat an id and a text have one score and follow each
other. Every input row gives one result row; an empty table gives an empty one, empty targets gains from smoothing alone;
other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, small_batches

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Bytes that words are made of, after lower-casing: digits, a-z and everything beyond ASCII.
_LOWER = bytes(k + 32 if 65 <= k <= 90 else k for k in range(256))
_IN_WORD = np.array([48 <= k <= 57 or 97 <= k <= 122 or k >= 128 for k in range(256)])
#: Words of up to this many bytes are hashed together, longer ones one by one.
TOGETHER = 64


def _crc_tables(longest: int) -> tuple[np.ndarray, np.ndarray]:
    """What a byte adds to the CRC-32 when so many bytes follow it, and the CRC-32 of so many zero bytes.

    CRC-32 is affine over exclusive-or: a text's is that of as many zero bytes, changed by each byte alone.
    """
    zero = np.array([zlib.crc32(bytes(n)) for n in range(longest + 1)], np.uint32)
    alone = np.array([[zlib.crc32(bytes([b]) + bytes(n)) for b in range(256)] for n in range(longest)], np.uint32)
    return alone ^ zero[1:, None], zero


_ADDS, _ZERO = _crc_tables(TOGETHER)


def word_buckets(data: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word of the bytes, and where the word starts."""
    data = data.translate(_LOWER)
    a = np.frombuffer(data, np.uint8)
    inside = _IN_WORD[a]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    if not len(starts):
        return np.empty(0, np.int64), starts
    a, after = a[inside], np.repeat(ends, sizes) - np.flatnonzero(inside) - 1
    adds = _ADDS[np.minimum(after, TOGETHER - 1), a]
    crc = np.bitwise_xor.reduceat(adds, np.cumsum(sizes) - sizes) ^ _ZERO[np.minimum(sizes, TOGETHER)]
    for k in np.flatnonzero(sizes > TOGETHER):
        crc[k] = zlib.crc32(data[starts[k] : ends[k]])
    return (crc % np.uint32(buckets)).astype(np.int64), starts


def _joined(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts of a column with a line end after each, and where each begins."""
    column = column.cast(pa.large_binary())
    texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column]
    return b"\n".join([*texts, b""]), np.cumsum([0, *(len(x) + 1 for x in texts)])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many words of the column text each bucket has."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            own, _ = word_buckets(_joined(batch.column(0))[0], buckets)
            total += np.bincount(own, minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select("text").mapInArrow(count, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    return vectors.treeReduce(lambda a, b: a + b, depth=3) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of each bucket's share among the targets over its share in the corpus, in thousandths, rounded down."""
    n, of_corpus, of_target = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [(float(t) + 1) * (of_corpus + n) / ((float(s) + 1) * (of_target + n)) for s, t in zip(corpus, target, strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_features, weight: the mean gain of each document's words, rounded down."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = sent.value
        for batch in batches:
            data, begins = _joined(batch.column(1))
            own, starts = word_buckets(data, len(gain))
            row = np.searchsorted(begins, starts, "right") - 1
            n = np.bincount(row, minlength=batch.num_rows)
            # whole numbers of under 2**53, so that sums in doubles are exact
            total = np.bincount(row, weights=gain[own], minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())], ["doc_id", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds rank: 1, 2, 3 ... for the highest scores among documents with least_words, ties to the smaller id; null beyond percent of these.

    scored is read three times and should be a table.
    """
    drawable = F.col("n_features") >= least_words
    at_score = scored.where(drawable).groupBy("score").agg(F.count(F.lit(1)).alias("at"))
    down = Window.orderBy(F.desc("score"))  # under 100,000 rows at any size, see above
    levels = at_score.select("score", (F.sum("at").over(down) - F.col("at")).alias("above"), F.expr(f"sum(at) over () * {percent} div 100").alias("wanted"))
    placed = scored.join(levels, "score", "left").withColumn("drawn", drawable & (F.col("above") < F.col("wanted")))
    within = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last())
    rank = F.col("above") + F.row_number().over(within)
    drawn = placed.where("drawn").withColumn("rank", F.when(rank <= F.col("wanted"), rank))
    return drawn.unionByName(placed.where(~F.coalesce("drawn", F.lit(False))).withColumn("rank", F.lit(None).cast("long"))).select(*scored.columns, "rank")


def resample(docs: DataFrame, targets: DataFrame, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of docs; targets: text. Both have their texts read whole."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(targets, buckets))
    scored = weights(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(saved(scored, "scored"), least_words, percent)

"""Components of near copies: SimHash links together with links of a 5-word Jaccard similarity of 0.8 or more.

The similar pairs are found without loss by prefixes. All distinct shingles of a text are put into one order that holds for
all texts; of n shingles the first n - ceil(0.8 n) + 1 are its prefix, and two texts that are similar share a shingle of
their prefixes. The order is by XXH64, with shingles that a sample of SAMPLE texts often has last; the sample decides how
many candidates there are, not what is found. Pairs that size or place of their first common shingle rule out are left
out, and so are those in one component already: first each text is compared with one text of each shingle's group, the
least, and then HUBS times with one that a hash picks, so that large groups of copies meet in few comparisons; then of each
two components that are still apart the two texts whose sketches are closest, as many texts of few components would else make
many pairs; then what is still apart with all of the group. A text's sketch has BITS bits, each the parity of the number of its
shingles that fall there, so two sketches differ in no more bits than the sets differ in shingles; the last two of these joins have
sketches folded to FOLDED words in their condition, candidates whose
sketches differ in more bits than similar sets can are left out, then those whose sketches of FINE_BITS bits do, which
tells long texts apart. All others are checked on their full sets of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved, small_batches
from .components import connected_components
from .simhash import SEED, shingles, simhash_dedup

WORDS = 5
SAMPLE = 4_000
#: Texts of the sample from which on a shingle is common.
COMMON = 4
#: Bits of the sketches of all texts and of those that these leave; multiples of 64.
BITS = 1024
FINE_BITS = 8192
#: Rounds in which each text of a group meets one text that a hash picks from those still apart, before all of them meet.
HUBS = 2
#: 64-bit words of the folded sketches that the last join compares; divides BITS // 64.
FOLDED = 4


def shingle_hashes(text: str | None) -> np.ndarray:
    """Distinct shingles as XXH64, sorted."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, SEED) for x in shingles(text, WORDS)), np.uint64))


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 in the order of all texts. common: sorted."""
    n = len(hashes)
    if len(common):
        often = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~often], hashes[often]])
    return hashes[: n - (4 * n + 4) // 5 + 1] if n else hashes


def _hashed(texts: DataFrame) -> DataFrame:
    """h, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(x.as_py()).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["h", "shingles"])

    return texts.select("h", "text").mapInArrow(run, "h long, shingles array<long>")


def common_shingles(texts: DataFrame) -> np.ndarray:
    rows = max(1, texts.count())
    some = texts.where(F.pmod(F.xxhash64("h"), F.lit(max(1, rows // SAMPLE))) == 0)
    often = _hashed(some).select(F.explode("shingles").alias("x")).groupBy("x").count().where(F.col("count") >= COMMON)
    return np.sort(np.array([r["x"] for r in often.orderBy(F.desc("count"), "x").limit(200_000).collect()], np.int64).view(np.uint64))


def prefixes(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """h, n (shingles of the text), at (place in the prefix), shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs = batch.column(0).to_numpy()
            sets = [shingle_hashes(x.as_py()) for x in batch.column(1)]
            firsts = [prefix(x, common) for x in sets]
            sizes = [len(x) for x in firsts]
            if not sum(sizes):
                continue
            at = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
            n = np.repeat(np.array([len(x) for x in sets], np.int32), sizes)
            columns = [np.repeat(hs, sizes), n, at, np.concatenate(firsts).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "n", "at", "shingle"])

    return texts.select("h", "text").mapInArrow(run, "h long, n int, at int, shingle long")


def _possible(a: str, b: str) -> Column:
    """Whether texts whose first common shingle this is can be similar: 9 i >= 4 (n + m) for i common shingles."""
    rest = F.least(F.col(f"{a}.n") - F.col(f"{a}.at"), F.col(f"{b}.n") - F.col(f"{b}.at"))
    return 9 * rest >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def sketch(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parities of the numbers of shingles by bit, as 64-bit words."""
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) % 2
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def sketches(texts: DataFrame, bits: int = BITS) -> DataFrame:
    """h, n (shingles of the text), bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(x.as_py()) for x in batch.column(1)]
            n = pa.array([len(x) for x in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array([sketch(x, bits) for x in sets], pa.list_(pa.int64()))], ["h", "n", "bits"])

    return texts.select("h", "text").mapInArrow(run, "h long, n int, bits array<long>")


def folded(drawn: DataFrame) -> DataFrame:
    """h and fold, the sketch of FOLDED words that a sketch of more bits holds: the exclusive-or of its parts."""
    words = BITS // 64
    part = lambda k: reduce(Column.bitwiseXOR, (F.col("bits")[j] for j in range(k, words, FOLDED)))
    return drawn.select("h", F.struct(*(part(k).alias(f"f{k}") for k in range(FOLDED))).alias("fold"))


def _of(df: DataFrame, side: str) -> DataFrame:
    """df with its h as this side of a pair."""
    return df.select(*(F.col(c).alias(side if c == "h" else f"{c}_{side}") for c in df.columns))


def _alike(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """Those of pairs whose sketches allow it: similar sets differ in (n + m) / 9 shingles at most, and sketches in no more bits."""
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda x, y: x + y)
    both = pairs.join(_of(drawn, "a"), "a").join(_of(drawn, "b"), "b")
    return saved(both.where(9 * apart <= F.col("n_a") + F.col("n_b")).select("a", "b"), "near-alike")


def similar(pairs: DataFrame, texts: DataFrame, drawn: DataFrame) -> DataFrame:
    """Those of pairs (a, b: hashes of texts; a saved table, deleted then) with a Jaccard similarity of 0.8 or more.

    drawn: sketches of texts. Texts go to their pairs, not sets of shingles, which are larger and don't compress; only to
    pairs of alike sketches.
    """
    alike = _alike(pairs, drawn)
    ends = saved(alike.select(F.col("a").alias("h")).union(alike.select(F.col("b").alias("h"))).distinct(), "near-used")
    near = saved(texts.join(ends, "h", "left_semi").select("h", "text"), "near-texts")
    fine = saved(sketches(near, FINE_BITS), "near-sketches")
    closer = _alike(alike, fine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, x = None, None
        for batch in batches:
            good = []
            for a, b, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != last:
                    last, x = b, shingle_hashes(text_b.as_py())
                y = shingle_hashes(text_a.as_py())
                if 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in good], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = closer.join(_of(near, "a"), "a").join(_of(near, "b"), "b")
    found = saved(rows.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"), "near-links")
    discard(pairs, alike, ends, near, fine, closer)
    return found


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (h, root) after links between texts."""
    of = lambda side: roots.select(F.col("h").alias(side), F.col("root").alias(f"root_{side}"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    upper = connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return saved(roots.join(upper, "root", "left").select("h", F.coalesce("top", "root").alias("root")), "near-roots")


def _off(fold_a: str, fold_b: str) -> Column:
    """In how many bits folded sketches differ."""
    return sum((F.bit_count(F.col(f"{fold_a}.f{k}").bitwiseXOR(F.col(f"{fold_b}.f{k}"))).cast("int") for k in range(FOLDED)), F.lit(0))


def _close(fold_a: str, fold_b: str, a: str, b: str) -> Column:
    """Whether folded sketches allow that texts are similar."""
    return 9 * _off(fold_a, fold_b) <= F.col(f"{a}.n") + F.col(f"{b}.n")


def _mixed(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (shingle, b, fold) with their roots, of the shingles whose texts are in several components."""
    now = rows.join(roots, F.col("b.h") == roots["h"]).select("shingle", "b", "fold", "root")
    several = now.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("shingle")
    return saved(now.join(several, "shingle", "left_semi"), "near-apart")


def closest(pairs: DataFrame) -> DataFrame:
    """a, b of the pair with the least off for each two components (root_a, root)."""
    return pairs.groupBy("root_a", "root").agg(F.min(F.struct("off", "a", "b")).alias("p")).select("p.a", "p.b")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, h (XXH64 of the text by Spark) and root, a number of the component, for each row."""
    small_batches(docs.sparkSession)
    labelled = saved(simhash_dedup(docs).select("doc_id", "h", "root"), "near-bits")
    # each text once; those that occur once, all after an exact dedup, needn't be shuffled for it
    copies = saved(labelled.groupBy("h").count().where(F.col("count") > 1).select("h"), "near-copied")
    every = docs.select(F.xxhash64("text").alias("h"), "text")
    texts = every.join(copies, "h", "left_anti").union(every.join(copies, "h", "left_semi").dropDuplicates(["h"]))
    roots = labelled.select("h", "root").distinct()
    drawn = saved(sketches(texts), "near-sketches")
    every = saved(prefixes(texts, common_shingles(texts)), "near-prefixes")
    twice = saved(every.groupBy("shingle").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("shingle"), "near-twice")
    rows = saved(every.join(twice, "shingle", "left_semi"), "near-shared")
    discard(every, twice)
    groups = rows.groupBy("shingle").agg(F.min(F.struct("n", "at", "h")).alias("a")).select("shingle", "a")
    held = saved(rows.join(groups, "shingle").join(roots, "h").select("shingle", "a", F.struct("n", "at", "h").alias("b"), "root"), "near-groups")
    discard(rows)

    hubs = roots.select(F.col("h").alias("a_h"), F.col("root").alias("hub_root"))
    first = held.where(_possible("a", "b")).select(F.col("a.h").alias("a"), F.col("b.h").alias("b"), "root").distinct()
    first = first.join(hubs, F.col("a") == F.col("a_h")).where("root <> hub_root").select("a", "b")
    roots = _joined(roots, similar(saved(first, "near-pairs"), texts, drawn))

    fold = folded(drawn).withColumnRenamed("h", "b_h")
    rows = saved(held.select("shingle", "b").join(fold, F.col("b.h") == F.col("b_h")).drop("b_h"), "near-folded")
    discard(held)
    for k in range(HUBS):
        apart = _mixed(rows, roots)
        hub = apart.groupBy("shingle").agg(F.min_by(F.struct("b", "root", "fold"), F.xxhash64(F.lit(k), F.col("b.h"))).alias("hub"))
        met = apart.join(hub, "shingle").where((F.col("root") != F.col("hub.root")) & _possible("hub.b", "b") & _close("hub.fold", "fold", "hub.b", "b"))
        pairs = met.select(F.least(F.col("hub.b.h"), F.col("b.h")).alias("a"), F.greatest(F.col("hub.b.h"), F.col("b.h")).alias("b")).distinct()
        pairs = saved(pairs, "near-pairs")
        discard(apart)
        roots = _joined(roots, similar(pairs, texts, drawn))
    for every_pair in (False, True):
        apart = _mixed(rows, roots)
        other = apart.select("shingle", F.col("b").alias("a"), F.col("root").alias("root_a"), F.col("fold").alias("fold_a"))
        # all of it is the join's condition, so that only pairs which are worth a comparison leave it
        pairs = other.join(apart, "shingle").where((F.col("root_a") < F.col("root")) & _possible("a", "b") & _close("fold_a", "fold", "a", "b"))
        if every_pair:
            pairs = pairs.select(F.col("a.h").alias("a"), F.col("b.h").alias("b")).distinct()
        else:
            off = _off("fold_a", "fold") / (F.col("a.n") + F.col("b.n"))
            pairs = closest(pairs.select("root_a", "root", off.alias("off"), F.col("a.h").alias("a"), F.col("b.h").alias("b")))
        pairs = saved(pairs, "near-pairs")
        discard(apart)
        roots = _joined(roots, similar(pairs, texts, drawn))
    return labelled.select("doc_id", "h").join(roots, "h")

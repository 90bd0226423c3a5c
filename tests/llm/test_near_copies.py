"""The near-dedup stage against all pairs of texts: 3 bits of 64, or a 5-word Jaccard similarity of 0.8 or more."""

import random

import numpy as np

import corpus_pipeline
from driftloom.llm.near_copies import BITS, FINE_BITS, closest, prefix, shingle_hashes, sketch

from . import brute


def five(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(texts):
    fps, sets, root = [brute.fingerprint(t) for t in texts], [five(t) for t in texts], list(range(len(texts)))
    far = 0
    for j in range(len(texts)):
        for i in range(j):
            both = len(sets[i] & sets[j])
            alike = bool(both) and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)
            bits = (fps[i] ^ fps[j]).bit_count()
            far += alike and bits > 3
            if alike or bits <= 3:
                old, new = root[j], root[i]
                root = [new if x == old else x for x in root]
    return root, far


def test_near_copies_beyond_three_bits(spark):
    r = random.Random(3)
    texts = [None, "", "a b", "A  b", "one two three four five", "One two\nthree four five", "one two three four six"]
    for k in range(25):
        words = [f"w{r.randrange(4000)}" for _ in range(r.choice([30, 60, 150, 400]))] + ["the same last line of all the texts"] * (k % 2)
        texts.append(" ".join(words))
        for share in (0.004, 0.01, 0.02, 0.04, 0.06):
            own = list(words)
            for _ in range(max(1, int(share * len(own)))):
                at = r.randrange(len(own))
                own[at : at + 1] = r.choice([[], ["new"], [own[at], "new"]])
            texts.append(" ".join(own))
    root, far = components(texts)
    assert far > 20  # such as the 3 bits alone don't show
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = sorted(x["doc_id"] for x in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert left == sorted(min(k for k, x in enumerate(root) if x == c) for c in set(root))


def test_prefixes_meet():
    """Similar sets share a shingle of their prefixes, whatever is common."""
    r = random.Random(5)
    for _ in range(300):
        a = np.array(sorted(r.sample(range(1000), r.randrange(1, 60))), np.uint64)
        b = np.array(sorted({*a.tolist()} - {*r.sample(a.tolist(), len(a) // 10)} | {*r.sample(range(1000, 1100), len(a) // 12)}), np.uint64)
        common = np.array(sorted(r.sample(range(1100), r.randrange(300))), np.uint64)
        both = len(np.intersect1d(a, b))
        if 9 * both >= 4 * (len(a) + len(b)):
            assert len(np.intersect1d(prefix(a, common), prefix(b, common)))
    assert len(prefix(shingle_hashes(None), np.zeros(0, np.uint64))) == 0


def test_sketches_of_similar_sets():
    """Sketches never differ in more bits than the sets do in shingles."""
    r = np.random.default_rng(7)
    for n in (0, 1, 5, 60, 900, 20_000):
        a = np.unique(r.integers(0, 2**64, n, np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - len(a) // 9], r.integers(0, 2**64, n // 9, np.uint64)]))
        for bits in (BITS, FINE_BITS):
            apart = int(np.bitwise_count((sketch(a, bits) ^ sketch(b, bits)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(a, b))
    assert int(np.bitwise_count(sketch(np.arange(BITS, dtype=np.uint64)).view(np.uint64)).sum()) == BITS


def test_two_components_meet_in_their_closest_texts(spark):
    """However many texts they have; before, all pairs of their texts were compared."""
    rows = [(1, 2, 0.1 + (a - 7) ** 2 + (b - 40) ** 2, a, b) for a in range(30) for b in range(30, 60)] + [(1, 3, 0.5, 4, 70), (2, 3, 0.5, 33, 70), (2, 3, 0.5, 32, 71)]
    pairs = spark.createDataFrame(rows, "root_a long, root long, off double, a long, b long")
    assert sorted(map(tuple, closest(pairs).collect())) == [(4, 70), (7, 40), (32, 71)]

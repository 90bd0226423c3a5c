"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE words. Every passage is encoded by its shape: counts of pairs of byte classes,
counts of hashed byte triples, and shares of distinct words, word lengths and the like. A learned layer turns the code into
a vector h, gated attention w . (tanh(V h) * sigmoid(U h)) weighs the passages, and the weighted mean is scored by a
logistic unit. All weights are learned together, from document labels alone, by Adam on a bounded sample of labelled rows:
the MOST_BAGS rows of each label with the least hash of their id, with all their passages. Class weights restore the labels'
true shares. Scoring reads all passages of all texts.

Null texts are empty; an empty text is one passage without words. Without labels of both kinds the score is the share of
good labels, 0.5 without any. Rows labelled more than once count once, with their least label; labels that are null, or
whose document is missing, don't count; of documents with one id that with the least text is learned from. Every input row gives one result row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches

PASSAGE = 50
MOST_BAGS = 1500
HASHED = 128
THRESHOLD = 0.3
#: Byte classes: lower case, upper case, digit, space, line end, comma-like, end-like, quote-like, other marks, high bytes.
CLASSES = 10
_CLASS = np.full(256, 8, np.uint8)
for _k, _members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b",;:-", b".?", b"'\"()[]")):
    _CLASS[list(_members)] = _k
_CLASS[128:] = 9
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
STATS = 6
WIDTH = CLASSES * CLASSES + HASHED + STATS


def encode(text: str | None) -> np.ndarray:
    """A row of WIDTH for each passage."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    a = np.frombuffer(data, np.uint8)
    space = _SPACE[a]
    first = np.flatnonzero(~space & np.append(True, space[:-1]))[::PASSAGE]
    n = len(first)
    sizes = np.diff(np.append(first, len(a)))
    own = np.repeat(np.arange(n), sizes)  # bytes before the first word aren't in a passage
    a = a[first[0] :]
    c = _CLASS[a].astype(np.int64)
    pairs = np.bincount(own[1:] * 100 + c[:-1] * 10 + c[1:], minlength=n * 100).reshape(n, 100)
    w = a.astype(np.uint32)
    triple = ((w[:-2] * np.uint32(2654435761)) ^ (w[1:-1] * np.uint32(2246822519)) ^ (w[2:] * np.uint32(3266489917))) >> np.uint32(25)
    triples = np.bincount(own[2:] * HASHED + triple.astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
    stats = np.empty((n, STATS), np.float32)
    for k in range(n):
        part = words[k * PASSAGE : (k + 1) * PASSAGE]
        distinct = set(part)
        longest = max(map(len, distinct))
        stats[k] = (len(distinct) / len(part), len(part) / PASSAGE, sum(map(len, part)) / len(part) / 10, min(longest, 60) / 30, len({x.lower() for x in distinct}) / len(distinct), 1)
    total = sizes[:, None].astype(np.float32)
    return np.concatenate([np.sqrt(pairs / total), np.sqrt(triples / total), stats], 1).astype(np.float32)


@dataclass
class Model:
    """Weights; without them the score is prior."""

    prior: float
    weights: dict[str, np.ndarray] | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of bags: x has the rows of all, starts where each begins."""
        w = self.weights
        h = np.tanh((x - w["mean"]) / w["sd"] @ w["E"] + w["e"])
        t = np.tanh(h @ w["V"])
        g = 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
        s = (t * g) @ w["w"]
        bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        e = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        att = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(att[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
        return {"h": h, "t": t, "g": g, "att": att, "z": z, "p": p, "bag": bag}

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(bags), self.prior)
        starts = np.cumsum([0, *(len(b) for b in bags[:-1])])
        return self.forward(np.concatenate(bags), starts)["p"].astype(float)


def train(bags: list[np.ndarray], labels: np.ndarray, bag_weights: np.ndarray, prior: float, hidden: int = 24, gate: int = 12, epochs: int = 60, seed: int = 1) -> Model:
    if len(set(labels.tolist())) < 2:
        return Model(prior)
    r = np.random.default_rng(seed)
    every = np.concatenate(bags)
    weights = {"mean": every.mean(0), "sd": every.std(0) + 1e-3, "E": r.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)), "e": np.zeros(hidden), "V": r.normal(0, 0.3, (hidden, gate)), "U": r.normal(0, 0.3, (hidden, gate)), "w": r.normal(0, 0.3, gate), "c": r.normal(0, 0.3, hidden), "b": np.zeros(1)}
    weights = {k: v.astype(np.float32) for k, v in weights.items()}
    model = Model(prior, weights)
    names = ["E", "e", "V", "U", "w", "c", "b"]
    m, v = ({k: np.zeros_like(weights[k]) for k in names} for _ in range(2))
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(r.permutation(len(bags)), max(1, len(bags) // 100)):
            x = np.concatenate([bags[i] for i in batch])
            starts = np.cumsum([0, *(len(bags[i]) for i in batch[:-1])])
            f = model.forward(x, starts)
            own = bag_weights[batch] / bag_weights[batch].sum()
            dp = ((f["p"] - labels[batch]) * own).astype(np.float32)
            dz = dp[:, None] * weights["c"]
            bag, h, att = f["bag"], f["h"], f["att"]
            datt = (dz[bag] * h).sum(1)
            ds = att * (datt - np.add.reduceat(att * datt, starts)[bag])
            dt, dg = ds[:, None] * weights["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * weights["w"] * f["t"] * f["g"] * (1 - f["g"])
            dh = att[:, None] * dz[bag] + dt @ weights["V"].T + dg @ weights["U"].T
            du = dh * (1 - h * h)
            grads = {"E": ((x - weights["mean"]) / weights["sd"]).T @ du + 1e-4 * weights["E"], "e": du.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (f["t"] * f["g"]).T @ ds, "c": f["z"].T @ dp + 1e-4 * weights["c"], "b": dp.sum(keepdims=True)}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                weights[k] -= (0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, most_bags: int = MOST_BAGS) -> Model:
    """labels: doc_id, label (0 or 1). Rows of the held-out fold aren't read."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if len(counts) < 2:
        return Model(prior)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("label = 0").orderBy(*order).limit(most_bags).union(known.where("label = 1").orderBy(*order).limit(most_bags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for text in batch.column(2):
                codes.append(encode(text.as_py()).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.binary())], ["doc_id", "label", "code"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the sample has 2 * most_bags rows at most
    learned = ids.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = learned.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, code binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["code"])))
    if not rows:
        return Model(prior)
    bags = [np.frombuffer(r["code"], np.float16).astype(np.float32).reshape(-1, WIDTH) for r in rows]
    y = np.array([r["label"] for r in rows], np.float32)
    share = {k: counts[k] / max(1, (y == k).sum()) for k in (0, 1)}
    return train(bags, y, np.array([share[int(k)] for k in y], np.float32), prior)


def score_column(model: Model, text: Column) -> Column:
    """The model's score of a text."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, held, size = [np.empty(0)], [], 0
            for x in batch:
                held.append(encode(x.as_py()))
                size += len(held[-1])
                if size > 5000:
                    out.append(model.scores(held))
                    held, size = [], 0
            if held:
                out.append(model.scores(held))
            yield pa.array(np.concatenate(out), pa.float64())

    return scored(text)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score_column(model, F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, fit(docs, labels), threshold)

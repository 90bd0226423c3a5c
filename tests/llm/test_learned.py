"""Operators that learn (held-out accuracy, recall), and the pipeline against plain versions."""

import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftloom.llm.lsa_decontam import Space, common_subsequence, decontaminate, fit_space, masks_of, words_of
from driftloom.llm.polynomial_dedup import normalised
from driftloom.llm.quality_mil import WIDTH, Model, encode, fit, quality_scores, score, train

from . import brute
from .test_near_copies import components

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def labels_of(spark, d):
    return spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("quality").alias("label"))


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    found = {r["doc_id"]: r for r in quality_scores(docs, labels_of(spark, MIDDLE)).collect()}
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for k, r in found.items())
    known = [(r["doc_id"], r["label"]) for r in labels_of(spark, MIDDLE).collect()]
    right = [found[k]["predicted"] == y for k, y in known if found[k]["held_out"]]
    assert len(right) > 50 and np.mean(right) > 0.95


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (2, "  \n", 0.1), (3, "word " * 100_000, 0.2), (None, "é", 0.2)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert {r["score"] for r in quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, label int")
    assert {r["score"] for r in quality_scores(docs, one).collect()} == {1.0}
    both = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, label int")
    some = docs.select("doc_id", "text").union(spark.createDataFrame([(k, "aa bb" if k % 2 else "XX!! YY!!") for k in range(4, 40)], "doc_id long, text string"))
    model = fit(some, both)
    rows = score(docs, model).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert score(docs.limit(0), model).count() == 0
    assert fit(docs.limit(0), both).weights is None


def test_attention_finds_the_passage_that_counts():
    """One passage of a bag decides; training lowers the loss, and gradients point downhill."""
    r = np.random.default_rng(0)
    bags = [r.normal(size=(r.integers(1, 9), WIDTH)).astype(np.float32) for _ in range(300)]
    y = np.zeros(300, np.float32)
    for k in range(0, 300, 2):
        bags[k][r.integers(len(bags[k])), :5] += 6
        y[k] = 1
    model = train(bags, y, np.ones(300, np.float32), 0.5)
    assert ((model.scores(bags) > 0.5) == (y == 1)).mean() > 0.95


def test_every_passage_is_encoded():
    assert encode("w " * 50_000).shape == (1000, WIDTH) and encode(None).shape == (1, WIDTH)
    assert np.allclose(encode(" a b\n").sum(), encode(" a b\n").sum())
    assert Model(0.25).scores([encode("x")]).tolist() == [0.25]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_common_subsequence():
    r = random.Random(4)
    for _ in range(200):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(40))] for _ in range(2))
        assert common_subsequence(a, masks_of(b), len(b)) == lcs(a, b)


def paraphrase(words, r):
    out = list(words)
    for k in r.sample(range(len(out)), len(out) // 6):
        out[k] = f"other{k}"
    return out


def test_leaks_are_found_and_clean_rows_left(spark):
    r = random.Random(8)
    docs = duckdb.sql(f"select doc_id, text from '{MIDDLE}/documents.parquet' order by 1").fetchall()
    items = duckdb.sql(f"select item_id, text from '{MIDDLE}/benchmark.parquet' order by 1").fetchall()
    clean, planted = docs[:300], []
    for n, (i, text) in enumerate(items):
        words = text.split()
        own = docs[300 + n][1].split()
        at = r.randrange(len(own))
        body = paraphrase(words, r) if n % 2 and len(words) > 12 else words
        planted.append((10_000 + i, " ".join(own[:at] + body + own[at:])))
    rows = spark.createDataFrame(clean + planted, "doc_id long, text string")
    bench = spark.createDataFrame([(*x, "n") for x in [*items, (None, "no id here at all"), (77, None), (78, "")]], "item_id long, text string, found string")
    found = {x["doc_id"]: x["item_ids"] for x in decontaminate(rows, bench, block_items=15).collect()}
    assert len(found) == len(clean) + len(planted)
    caught = [i in found[10_000 + i] for i, _ in items]
    assert np.mean(caught) >= 0.95
    whole = {i: b" ".join(words_of(t)) for i, t in items}
    for d, text in clean:
        held = {i for i, w in whole.items() if w in b" ".join(words_of(text))}
        assert held <= set(found[d])
        near = b" ".join(words_of(text))
        assert all(sum(x in near.split() for x in set(whole[i].split())) >= 0.6 * len(set(whole[i].split())) for i in found[d])


def test_decontamination_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (None, "x"), (4, "w " * 60_000 + "one TWO, three. " + "w " * 9)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, "One two three.")], "item_id long, text string")
    space = Space(np.random.default_rng(0).normal(size=(4096, 8)).astype(np.float32))
    found = decontaminate(docs, bench, space, least_cosine=0.0)
    assert sorted((tuple(r[:3]) for r in found.collect()), key=repr) == sorted([(1, False, []), (2, False, []), (3, True, [5]), (3, True, [5]), (None, False, []), (4, True, [5])], key=repr)
    assert decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert fit_space(docs.limit(0)).vectors.shape == (4096, 96)


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """The rows that each stage gets and returns."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "A clean text of words", None, None, None), (9002, "A clean text of words", None, None, None), (9002, "Another text of words that is here", "en", "s", 1), (None, "A clean  text of words", "en", "s", 2)], docs.schema)
    now, out = docs.unionByName(odd), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, now, SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, now, after))
        now = after
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_keep_columns_and_drop_rows(staged):
    assert [n for n, _, _ in staged] == ["quality classifier", "exact dedup", "near dedup", "decontamination", "packing"]
    for _, before, after in staged[:-1]:
        assert after.columns == before.columns and set(rows(after)) <= set(rows(before)) and 0 < after.count() <= before.count()


def test_quality_stage(spark, staged):
    _, before, after = staged[0]
    model = fit(before, labels_of(spark, SMALL))
    kept = [tuple(r) for r in before.collect() if model.scores([encode(r["text"])])[0] >= 0.3]
    assert rows(after) == sorted(kept, key=repr)


def test_exact_stage(staged):
    _, before, after = staged[1]
    best = {}
    for r in before.collect():
        key, own = normalised(r["text"]), (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0)
        if key not in best or own < best[key][0]:
            best[key] = (own, tuple(r))
    assert rows(after) == sorted((x for _, x in best.values()), key=repr)


def test_near_stage(staged):
    """One row stays of each group that 3 bits of 64 or a 5-word Jaccard similarity of 0.8 link, that with the least doc_id."""
    _, before, after = staged[2]
    held = before.collect()
    groups, left = {}, set(rows(after))
    for r, root in zip(held, components([r["text"] for r in held])[0], strict=True):
        groups.setdefault(root, []).append(r)
    for own in groups.values():
        kept = [r for r in own if tuple(r) in left]
        assert len(kept) == 1 and kept[0]["doc_id"] == min((r["doc_id"] for r in own if r["doc_id"] is not None), default=None)
    assert after.count() == len(groups)


def test_decontamination_stage(spark, staged):
    _, before, after = staged[3]
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = set(rows(after))
    for r in before.collect():
        near = b" ".join(words_of(r["text"]))
        if any(b" ".join(w) in near for w in items):
            assert tuple(r) not in left
        elif not any(len(set(w) & set(near.split())) >= 0.6 * len(set(w)) for w in items):
            assert tuple(r) in left


def test_packing_stage(staged):
    from tokenizers import Tokenizer

    _, before, after = staged[4]
    found = after.collect()
    file = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in found), key=repr) == brute.pieces([(r["doc_id"], r["text"]) for r in before.collect()], file)
    brute.fits([(r["sequence_id"], r["offset"], r["length"]) for r in found])


def test_run_is_the_stages(spark, staged):
    plain = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    found = corpus_pipeline.run(spark, SMALL)
    assert found.columns == staged[4][2].columns and 0 < found.select("doc_id").distinct().count() < plain

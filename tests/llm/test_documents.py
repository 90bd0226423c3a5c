"""Operators over documents against plain versions, on whole small tables and on odd rows."""

import random

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from driftloom.llm.cdc_dedup import cdc_dedup, cuts
from driftloom.llm.common import held_out
from driftloom.llm.lpf_dedup import lpf_dedup
from driftloom.llm.pattern_packing import Tokenizer, pack_documents, pieces, plan
from driftloom.llm.polynomial_dedup import Fingerprinter, _grouped, fingerprints, polynomial_dedup
from driftloom.llm.simhash import simhash_dedup

from . import brute

SMALL = "/root/testdata/sf0.001"
TOKENS = public_tokenizers.path("word_bpe_49k.json")
#: Further columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, fp long, h string, n long, part int"


def rows_of(name="documents", columns="doc_id, text"):
    return duckdb.sql(f"select {columns} from '{SMALL}/{name}.parquet' order by 1").fetchall()


def odd_rows():
    r = random.Random(3)
    words = ["ab", "Éa", "c,", "d", "<|x|>", "ﬁ", "10", "it's"]
    long = " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(60_000))
    passage = " ".join(r.choice(words) + str(r.randrange(900)) for _ in range(120))
    other = " ".join(r.choice(words) + str(r.randrange(900)) for _ in range(120))
    out = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a b"), (6, "A\x0bb"), (7, "a b c"), (8, long), (9, long + " x"), (10, "x " + long), (11, passage + other), (12, other + passage)]
    out += [(13, f"q {passage} w"), (14, f"u {passage} v"), (15, "same text"), (15, "same text"), (15, "same\ttext"), (None, "same text"), (None, None), (16, "ß" * 500), (17, "aa" * 900)]
    return out


@pytest.fixture(params=["table", "odd", "empty"])
def case(request, spark):
    rows = {"table": rows_of, "odd": odd_rows, "empty": list}[request.param]()
    return rows, spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def in_order(rows, spark):
    """One row for each id and text, in the order that decides which copy is first."""
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    return [(r.doc_id, r.text) for r in df.dropDuplicates(["doc_id", "h"]).orderBy("doc_id", "h").collect()]


def test_simhash(case, spark):
    rows, df = case
    assert got(simhash_dedup(df, tile=64), "doc_id", "fingerprint", "component_id") == brute.simhash(rows)


@pytest.mark.parametrize("most_texts", [2048, 1])
@pytest.mark.parametrize("keep_first", [False, True])
def test_lpf(case, spark, keep_first, most_texts):
    rows, df = case
    distinct = in_order(rows, spark)
    one = brute.repeated(distinct, 400, keep_first)
    found = got(lpf_dedup(df, 400, keep_first, most_texts=most_texts), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")
    assert {x[:5] for x in found} == set(one)
    assert {(x[0], x[1], x[5]) for x in found} == {x[:3] for x in brute.repeated(distinct, 288)}
    assert len(found) == len(rows)


def test_lpf_crowded_seed(spark):
    """A passage that over a thousand different texts have, shorter and longer than what is removed."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    shared = [" ".join(word() for _ in range(n)) for n in (45, 70)]  # 359 and 559 bytes
    rows = [(k, " ".join([word() for _ in range(20)] + [shared[k % 2]] + [word() for _ in range(20)])) for k in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most_texts in (2048, 100):
        found = lpf_dedup(df, keep_first=False, most_texts=most_texts).collect()
        assert len(found) == 2400
        assert {(r.n_removed, r.n_shared >= 359) for r in found if r.doc_id % 2 == 0} == {(0, True)}
        assert all(559 <= r.n_removed <= r.n_shared < 600 for r in found if r.doc_id % 2)


def test_cdc(case, spark):
    rows, df = case
    one = brute.chunk_runs(in_order(rows, spark), cuts, 120)
    found = got(cdc_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert set(found) == set(one) and len(found) == len(rows)


def test_cdc_resists_shifts():
    r = random.Random(1)
    data = bytes(r.choice(b"abcdefgh ") for _ in range(5000))
    a = {data[i:j] for i, j in zip(cuts(data), cuts(data)[1:])}
    moved = data[:100] + b"XYZ" + data[100:]
    b = [moved[i:j] for i, j in zip(cuts(moved), cuts(moved)[1:])]
    assert sum(len(x) for x in b if x in a) > 4700


def test_packing(case, spark):
    from tokenizers import Tokenizer as File

    rows, df = case
    found = pack_documents(df, TOKENS, keep_ids=True).collect()
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in found), key=repr) == brute.pieces(rows, File.from_file(TOKENS))
    n = brute.fits([(r.sequence_id, r.offset, r.length) for r in found])
    total = sum(r.length for r in found)
    assert -(-total // 2048) <= n <= -(-total // 2048) * 1.02 + 1


def test_tokenizer_is_the_library():
    t = Tokenizer(TOKENS)
    assert t.by_word
    for x in ["it's I'LL <|endoftext|> ok", "Ünï ΣΑΣ x", "İstanbul", "a\x1cb", "½²ª ³4", "don't—stop “x” 10€", "a\xa0b\x0bc\x0cd\x1ee", "", " \n ", "x" * 5000, " \xad'' 's''s", "ŒœŸß ǅ", "é", "a\x85b"]:
        assert t(x) == t._slow(x), x


def test_plan_uses_each_length_as_often_as_it_occurs():
    r = random.Random(5)
    counts = {r.randrange(1, 2049): r.randrange(1, 400) for _ in range(600)}
    used = {}
    planned, _ = plan(counts)
    for own, times in planned:
        assert sum(own) <= 2048
        for k in own:
            used[k] = used.get(k, 0) + times
    assert used == counts


def test_patterns_carry_the_packing(spark):
    """Over half of the pieces that don't fill a sequence, in as few sequences as there can be."""
    made = pieces(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), TOKENS)
    counts = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    planned, by_pattern = plan(counts)
    assert sum(len(own) * times for own, times in planned[:by_pattern]) > 0.5 * sum(n for k, n in counts.items() if k < 2048)
    assert sum(times for _, times in planned) == -(-sum(k * n for k, n in counts.items()) // 2048)


def test_polynomial(case):
    rows, df = case
    found = got(polynomial_dedup(df), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    from hashlib import sha256

    from driftloom.llm.polynomial_dedup import normalised

    groups = {}
    for d, t in rows:
        groups.setdefault(normalised(t), []).append((-len(t or ""), d is None, d))
    want = []
    for d, t in rows:
        own = groups[normalised(t)]
        best = min(own, key=lambda x: (x[0], x[1], x[2] or 0))
        want.append((d, best[2], len(own), (-len(t or ""), d is None, d) == best, sha256(normalised(t)).hexdigest()))
    assert found == sorted(want, key=repr)


def test_fingerprints_combine():
    data = bytes(random.Random(2).randrange(256) for _ in range(5000))
    p = Fingerprinter(64)
    assert p.combine([p.of(data[:1234]), p.of(data[1234:])]) == p.of(data)
    h = 0
    for b in data:
        h = (h * 1048583 + b) % 2147483647
    assert p.of(data)[0] == h


def test_collisions_are_told_apart(spark):
    """Rows whose fingerprints agree by force, though their texts don't."""
    docs = spark.createDataFrame([(1, "aaa"), (2, "bbb"), (3, "b b b"), (4, "ccc")], "doc_id long, text string")
    printed = fingerprints(docs).withColumn("fp", F.lit(7).cast("long"))
    found = got(_grouped(printed, 2), "doc_id", "keep_id", "group_size", "kept")
    assert found == [(1, 1, 1, True), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True)]


def test_held_out(spark):
    import zlib

    found = spark.range(200).select("id", held_out(F.col("id")).alias("x")).collect()
    assert all(r.x == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in found)

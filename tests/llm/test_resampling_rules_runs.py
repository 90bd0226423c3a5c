"""Target resampling, line rules and periodic runs against plain versions, on whole small tables and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.llm.line_rules import line_rules, repeat_words
from driftloom.llm.periodic_runs import collapsed, extension, names, periodic_runs, runs, with_planted_runs
from driftloom.llm.queries import op11_target_resampling, op13_periodic_runs
from driftloom.llm.target_resampling import ranked, resample, word_buckets

SMALL = "/root/testdata/sf0.001"
#: Further columns whose names the operators use themselves.
SCHEMA = "doc_id long, text string, source string, own long, score string, h int, words string, line long, start int, n int"
SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(name, columns):
    return duckdb.sql(f"select {columns} from '{SMALL}/{name}.parquet' order by 1").fetchall()


def odd_rows():
    r = random.Random(5)
    long = " ".join(r.choice(["ab", "Éa", "c,", "x1-y", "ﬁ"]) + str(r.randrange(40)) for _ in range(70_000))
    boiler = "Shared  line\tof 12 words, see page 7"
    out = [(1, None, "s"), (2, "", "s"), (3, " \t\n\x0b", None), (4, "a", "s"), (5, "x" * 5000 + " É", "s"), (6, long, "s"), (6, long, "s"), (None, long, "t"), (None, None, None)]
    out += [(7, "same text " * 30, "s"), (8, "same text " * 30, "s"), (9, "#*$%&|<>     b", "s"), (10, "a\nb\na\n\nA\n b", "s")]
    out += [(20 + k, f"{boiler if k % 2 else boiler.lower().replace('12', '3')}\n{'abcdefghi'[k]} only here", "h") for k in range(9)]
    out += [(40 + k, boiler + "\n" + " ".join("w" * k + "v" * j for j in range(1, 41)), None) for k in range(9)]
    out += [(60 + k, boiler, "c") for k in range(30)]  # copies of one text
    return [*out, *((k, " ".join(f"{k}q{j % (3 + k % 5)}" for j in range(k)), "p") for k in range(100, 160))]


@pytest.fixture(params=["table", "odd", "empty"])
def case(request, spark):
    rows = {"table": lambda: rows_of("documents", "doc_id, text, source"), "odd": odd_rows, "empty": list}[request.param]()
    return rows, spark.createDataFrame([(*r, 4, "x", 1, "y", 2, 3, 5) for r in rows], SCHEMA).repartition(3)


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_resample(rows, targets):
    buckets = [[zlib.crc32(w.encode()) % 10_000 for w in words_of(t)] for _, t in rows]
    s, t = Counter(b for own in buckets for b in own), Counter(zlib.crc32(w.encode()) % 10_000 for x in targets for w in words_of(x))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for (doc_id, _), own in zip(rows, buckets):
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 10 * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=repr)


def test_resampling(case, spark):
    rows, df = case
    targets = [t for _, t in rows_of("benchmark", "item_id, text")] + [None, ""]
    found = resample(df, spark.createDataFrame([(t,) for t in targets], "text string"))
    assert got(found, "doc_id", "n_features", "weight", "score", "rank") == plain_resample([r[:2] for r in rows], targets)


def test_resampling_without_targets(spark):
    rows = [(k, f"word{k} " * 30) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(resample(df, spark.createDataFrame([], "text string")), "doc_id", "n_features", "weight", "score", "rank") == plain_resample(rows, [])


def test_resampling_query(spark):
    want = plain_resample(rows_of("documents", "doc_id, text"), [t for _, t in rows_of("benchmark", "item_id, text")])
    assert got(op11_target_resampling(spark, SMALL), "doc_id", "n_features", "weight", "score", "rank") == want


def test_ranks_with_ties(spark):
    """Equal scores across the limit: the smaller ids are drawn."""
    rows = [(k, 20, 0, 5) for k in range(95)] + [(200, 20, 0, 9), (201, 19, 0, 99), (None, 20, 0, 5), (3, 20, 0, 5), (300, 20, 0, 4)]
    found = ranked(spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long"))
    drawn = sorted((r["rank"], r["doc_id"]) for r in found.where("rank is not null").collect())
    assert found.count() == 100
    assert drawn == list(enumerate([200, 0, 1, 2, 3, 3, 4, 5, 6], 1))  # 9 of 99


def test_long_words_hash_alike():
    text = " ".join("é" * n + "z" * m for n in (0, 1, 31, 32, 33, 90) for m in (0, 1, 2, 63)) + "\n0" * 3
    own, starts = word_buckets(text.encode())
    assert own.tolist() == [zlib.crc32(w.encode()) % 10_000 for w in words_of(text)] and len(starts) == len(own)


def plain_rules(rows, least_docs=5, share=0.02):
    lines, texts = defaultdict(set), defaultdict(set)
    normal = lambda x: re.sub("[0-9]+", "0", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in " ".join(SPACES.findall(x))))
    for _, t, host in rows:
        texts[host].add(t or "")
        for x in (t or "").split("\n"):
            lines[host, normal(x)].add(t or "")
    out = []
    for doc_id, t, host in rows:
        t = t or ""
        words, own = SPACES.findall(t), [x for x in t.split("\n") if SPACES.search(x)]
        grams = defaultdict(list)
        for i in range(len(words) - 4):
            grams[tuple(words[i : i + 5])].append(i)
        repeat = len({i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)})
        removed = sum(len(SPACES.findall(x)) for x in own if len(lines[host, normal(x)]) > max(least_docs, share * len(texts[host])))
        failed = len(words) < 10 or 100 * repeat > 20 * len(words)
        kept = not failed and len(words) - removed >= 10 and removed <= 0.5 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(own) - len(set(own)), repeat, removed, failed, kept))
    return sorted(out, key=repr)


def test_line_rules(case):
    rows, df = case
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed", "base_failed", "kept")
    assert got(line_rules(df), *columns) == plain_rules(rows)


def test_boilerplate_depletes(spark):
    rows = odd_rows()
    kept = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert kept[21] == (8, False)  # three words of its own
    assert kept[41] == (8, True)
    assert kept[60][0] == 0  # thirty copies are one document


def test_repeat_words_on_small_alphabets():
    r = random.Random(2)
    for _ in range(400):
        words = [bytes([97 + r.randrange(3)]) for _ in range(r.randrange(40))]
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        assert repeat_words(words) == len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})


def plain_runs(words):
    n, out = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            s, m = i, j + p - i
            if j > i and m >= max(6, 4 * p) and not any(p % q == 0 and all(words[k] == words[k + q] for k in range(s, s + m - q)) for q in range(1, p)):
                out.append((s, m, p))
            i = j + (j == i)
    return sorted(out)


def small_texts():
    r = random.Random(1)
    for _ in range(1500):
        words = [bytes([97 + r.randrange(r.choice([1, 2, 3, 6]))]) for _ in range(r.randrange(60))]
        if words and r.random() < 0.6:
            a = r.randrange(len(words))
            p = 1 + r.randrange(max(1, (len(words) - a) // 3))
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
        yield words + [b"x"] + words + words if r.random() < 0.3 else words


def test_runs():
    for words in small_texts():
        assert runs(words) == plain_runs(words)


def test_runs_of_long_texts():
    assert runs([b"a"] * 50_000) == [(0, 50_000, 1)]
    words = [b"%d" % (i % 12_500) for i in range(50_000)]
    assert runs(words) == [(0, 50_000, 12_500)] and runs(words[:-1]) == []
    assert runs([b"x", *words, b"0", b"y"]) == [(1, 50_001, 12_500)]


def test_extension():
    for words in small_texts():
        levels, pairs = names(words), [(a, b) for b in range(len(words)) for a in range(b)]
        if pairs:
            a, b = map(np.array, zip(*pairs))
            on = [next((k for k in range(len(words) - j) if words[i + k] != words[j + k]), len(words) - j) for i, j in pairs]
            back = [next((k for k in range(i) if words[i - 1 - k] != words[j - 1 - k]), i) for i, j in pairs]
            assert extension(levels, a, b).tolist() == on and extension(levels, a, b, back=True).tolist() == back
        if len(words) > 40:
            break


def planted(doc_id, text):
    words = SPACES.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not words:
        return words
    a = g % len(words)
    p = 1 + (len(words) - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]


def plain_row(doc_id, words):
    own = plain_runs(words)
    best = max(own, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    gone = {i for s, m, q in own for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(own), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in own)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_periodic_runs(case):
    rows, df = case
    rows = [r for r in rows if len(r[1] or "") < 30_000]
    df = df.where("coalesce(length(text), 0) < 30000")
    assert got(periodic_runs(with_planted_runs(df)), *COLUMNS) == sorted((plain_row(d, planted(d, t)) for d, t, _ in rows), key=repr)


def test_periodic_runs_of_a_long_text(spark):
    text = next(t for d, t, _ in odd_rows() if d == 6) + " la" * 90
    found = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (found["n_runs"], found["length"], found["period"]) == (1, 90, 1)
    assert found["collapsed"] == text[: -3 * 89] and found["runs"][0].asDict() == {"start": 70_000, "length": 90, "period": 1}


def test_periodic_query(spark):
    rows = rows_of("documents", "doc_id, text")
    assert got(op13_periodic_runs(spark, SMALL), *COLUMNS) == sorted((plain_row(d, planted(d, t)) for d, t in rows), key=repr)


def test_collapsed_keeps_the_first_period():
    words = b"x a b a b a b a b y".split()
    assert collapsed(words, runs(words)) == b"x a b y".split()


def test_planted_words_are_split_once(spark):
    """A plan that splits the text anew for each word would be quadratic."""
    df = spark.createDataFrame([(k, "w " * 20_000) for k in range(12)], "doc_id long, text string")
    assert with_planted_runs(df).agg(F.sum(F.length("text"))).first()[0] > 0

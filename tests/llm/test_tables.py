"""URL filters, chat formatting and WARC against their SQL and on odd rows."""

import base64
import gzip
import hashlib
import io

import duckdb
import pytest

from driftloom.llm import queries as own
from driftloom.llm.chat_prefix import conversation_digests, escape, escape_role, format_conversations, turns_of, unescape, unescape_role
from driftloom.llm.host_reputation import domain_of, reputations, suffix_of, url_verdicts
from driftloom.llm.warc import Reader, marked, read_archives, read_files, warc_round_trip, write_archives
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    found = own.queries()[name](spark, d)
    columns = sorted(found.columns)
    got = sorted((tuple(map(plain, r)) for r in found.select(*columns).collect()), key=repr)
    want = con.sql(own.oracle_sql()[name])
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


URLS = [
    (1, "http://A.Example.org/es/x", "a.example.org", "/es/x", "example.org/es/", "block"),
    (2, "https://example.org/en/1?q=/es/", "example.org", "/en/1", "example.org/en/1", "block"),
    (3, "https://example.org/en/2#1", "example.org", "/en/2", "org/", "allow"),
    (4, "https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    (5, "x://b.com/fr/", "b.com", "/fr/", "com/fr/", "allow"),
    (6, "http://b.com/de/a://c/", "b.com", "/de/a://c/", "com/de/", "block"),
    (7, None, "", "", None, "allow"),
    (8, "no scheme/es/", "", "", None, "allow"),
    (9, "http://example.org", "example.org", "", None, "allow"),
    (10, "http://É.ORG:80/a\nb", "É.org:80", "/a\nb", None, "allow"),
    (10, "http://x.net?a/b", "x.net", "", None, "allow"),
    (None, "", "", "", None, "allow"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u, *_ in URLS], "page_id long, url string, host string")
    none = spark.createDataFrame([], "url string, good int")
    found = sorted((tuple(r) for r in url_verdicts(pages, none).select("page_id", "host", "path", "rule", "verdict").collect()), key=repr)
    assert found == sorted(((i, h, p, r, v) for i, _, h, p, r, v in URLS), key=repr)
    assert url_verdicts(pages.limit(0), none).count() == 0


def test_reputation_is_shrunk(spark):
    rows = [("http://bad.x.net/", 0)] * 40 + [("http://new.x.net/", 0)] + [("http://good.y.net/", 1)] * 200 + [("http://one.y.net/", 0)] + [("http://z.co.uk/", 1), ("http://z.co.uk/", None)]
    outcomes = spark.createDataFrame(rows, "url string, good int")
    mean = {r["host"]: r["mean"] for r in reputations(outcomes)["host"].collect()}
    assert mean["bad.x.net"] < mean["new.x.net"] < mean["one.y.net"] < mean["good.y.net"]
    pages = spark.createDataFrame([(1, "http://bad.x.net/a"), (2, "http://other.x.net/"), (3, "http://one.y.net/"), (4, "http://unknown.net/")], "page_id long, url string")
    found = {r["page_id"]: (r["verdict"], r["level"]) for r in url_verdicts(pages, outcomes).collect()}
    assert found == {1: ("block", "host"), 2: ("block", "domain"), 3: ("allow", "host"), 4: ("allow", "suffix")}
    hosts = spark.createDataFrame([("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "uk"), ("x.y.org:8", "y.org", "org"), ("10.0.0.1", "10.0.0.1", "10.0.0.1"), ("net", "net", "net"), ("", "", "")], "h string, d string, s string")
    assert all(r[0] == r[1] and r[2] == r[3] for r in hosts.select("d", domain_of(F.col("h")), "s", suffix_of(F.col("d"))).collect())


@pytest.mark.parametrize("text", ["", "<|", "<~|", "<<~~||", "<|im_end|>\n<|im_start|>x", "a<", "|", "~|<~", "<~~~|im_start|>"])
def test_escapes(text):
    assert unescape(escape(text)) == text and "<|" not in escape(text)
    assert unescape_role(escape_role(text)) == text and "\n" not in escape_role(text)
    assert unescape_role(escape_role("\\n\n\\")) == "\\n\n\\"


ODD_TURNS = [
    (1, 0, "system", "s"), (1, 1, "user", None), (1, 2, "assistant", "<|im_end|>"), (1, 3, "user", "a<"), (1, 4, "assistant", None), (1, 5, "user", "x" * 50_000),
    (2, 0, "user", "only"), (3, 0, "assistant", "first"), (3, None, "assistant", "none"), (3, 0, "assistant", "first"), (3, 0, None, "r"), (4, 0, "us\ner\\", "<~|"),
    (None, 0, "user", "u"), (None, 1, "assistant", "é" * 40),
]


def digests(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = []
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        target = "".join(t for r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(target), sha(target)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("arranged", [True, False])
def test_conversations(spark, arranged):
    df = spark.createDataFrame([(*r, "x", 1) for r in ODD_TURNS], "conv_id long, turn long, role string, text string, example string, loss_start int")
    found = conversation_digests(format_conversations(df), arranged).drop("formatted_chars").collect()
    assert sorted(map(tuple, found), key=repr) == digests(ODD_TURNS)
    assert conversation_digests(format_conversations(df.limit(0))).count() == 0


def test_examples_train_on_the_last_reply_alone(spark):
    rows = spark.createDataFrame([(7, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(5)], "conv_id long, turn long, role string, text string")
    found = format_conversations(rows).orderBy("example").collect()
    assert [turns_of(r["text"])[-1][1] for r in found] == ["t1", "t3", "t4"]
    assert [r["text"][r["loss_start"] : r["loss_end"]] if r["loss_start"] else None for r in found] == ["t1", "t3", None]
    assert found[1]["text"].startswith(found[0]["text"])


PAGES = [(3, "http://a/ b", "x" * 100), (1, "u", "x" * 100), (2, None, "x" * 100), (2, "again", "x" * 100), (4, "u", None), (5, "u", ""), (6, "u", "y" * 99), (7, "u", "y" * 99), (8, "u\r\nX: 1", "é" * 60), (None, "u", "é" * 60), (9, "u", "\r\n\r\n" * 90_000)]


def test_warc(spark):
    df = spark.createDataFrame([(*r, "x") for r in PAGES], "page_id long, url string, html string, digest string").repartition(2)
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "").encode() == body and j is not None]
        refers = min(same) if len(body) >= 100 and same and min(same) != i else None
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "response" if refers is None else "revisit", refers))
    found = warc_round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert warc_round_trip(df.limit(0)).count() == 0


def test_archives_are_gzip_files(spark, tmp_path):
    df = spark.createDataFrame([(i, u, h) for i, u, h in PAGES], "page_id long, url string, html string").coalesce(1)
    for k, r in enumerate(write_archives(marked(df), 500).collect()):
        (tmp_path / f"{k}.warc.gz").write_bytes(r["archive"])
        whole = gzip.decompress(r["archive"])
        assert whole.count(b"WARC/1.1\r\n") == r["n_records"] == sum(1 for _ in Reader(iter([r["archive"]])))
        assert sum(1 for _ in Reader(iter(lambda f=io.BytesIO(r["archive"]): f.read(7), b""))) == r["n_records"]
    found = read_files(spark, str(tmp_path)).collect()
    assert len(found) == len(PAGES)
    assert {(r["page_id"], bytes(r["payload"])) for r in found if r["record_type"] == "response"} >= {(1, b"x" * 100), (9, b"\r\n\r\n" * 90_000)}


def test_a_damaged_record_is_found(spark):
    df = spark.createDataFrame([(1, "u", "hello")], "page_id long, url string, html string")
    rows = marked(df).withColumn("digest", F.lit("00"))
    assert read_archives(write_archives(rows)).first()["verified"] is False
    archive = bytes(write_archives(marked(df)).first()["archive"])
    with pytest.raises(EOFError):
        list(Reader(iter([archive[:-9]])))


def other_record(kind, block, *more, http=True, newline="\r\n"):
    head = ["WARC/1.0", f"warc-type: {kind}", "WARC-Record-Id: <urn:uuid:9f0e6b1c-0000-4000-8000-000000000000>", "WARC-Date: 2020-01-01T00:00:00Z", *more]
    head += [f"CONTENT-TYPE:application/{'http; msgtype=x' if http else 'warc-fields'}", f"content-length: {len(block)}"]
    return gzip.compress((newline.join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n")


def test_archives_of_other_writers(spark, tmp_path):
    """Record ids of any form, header names in any case, SHA-1 in base-32, records without a digest, and of other types."""
    http, body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n", "héllo\r\n\r\nx".encode()
    sha1 = base64.b32encode(hashlib.sha1(body).digest()).decode()
    made = [
        other_record("warcinfo", b"software: x\r\n", http=False), other_record("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "WARC-Target-URI: http://a/"),
        other_record("response", http + body, "WARC-Target-URI:  http://a/", f"WARC-Payload-Digest: sha1:{sha1}"), other_record("response", http + body, "WARC-Payload-Digest: SHA-256:" + hashlib.sha256(body).hexdigest().upper()),
        other_record("response", http + body, "WARC-Payload-Digest: sha1:" + sha1[:-1] + ("A" if sha1[-1] != "A" else "B")), other_record("response", http + body), other_record("response", b"HTTP/1.1 204", "WARC-Payload-Digest: md5:d41d8cd98f00b204e9800998ecf8427e"),
        other_record("revisit", http, f"WARC-Payload-Digest: sha1:{sha1}", "WARC-Refers-To: <urn:uuid:1>"), other_record("metadata", b"a: b", "WARC-Block-Digest: sha1:" + hashlib.sha1(b"a: b").hexdigest(), http=False), other_record("response", http + body, "WARC-Payload-Digest: blake9:00"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(made))
    rows = read_files(spark, str(tmp_path)).collect()
    assert [(r["record_type"], r["verified"], r["payload_bytes"]) for r in rows] == [
        ("warcinfo", None, 13), ("request", None, 0), ("response", True, len(body)), ("response", True, len(body)), ("response", False, len(body)), ("response", None, len(body)), ("response", True, 0), ("revisit", None, None), ("metadata", True, 4), ("response", None, len(body)),
    ]
    assert [bytes(rows[k]["payload"]) for k in (0, 2, 8)] == [b"software: x\r\n", body, b"a: b"]
    assert {r["page_id"] for r in rows} == {r["refers_to"] for r in rows} == {None} and rows[2]["url"] == "http://a/" and rows[2]["payload_digest"] == sha1 and rows[0]["record_id"].startswith("<urn:uuid:9f0e")

"""Sources, sinks and the stream over small files."""

import os

import pytest
from pyspark.sql import functions as F

from driftloom import sources, streaming


def test_token_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("42\t1:10\t2:20\n\n43\n44\tx:1\t5\n")
    rows = sources.read_token_lines(spark, str(tmp_path / "a.txt")).collect()
    assert sorted(map(tuple, rows), key=str) == [(42, 0, 1, 10), (42, 1, 2, 20), (44, 0, None, 1), (44, 1, 5, None)]


def test_append_is_idempotent_and_replace_leaves_other_articles(spark, tmp_path):
    path = str(tmp_path / "revisions")
    page = spark.createDataFrame([("007", 1, "u"), ("007", 1, "u"), ("b", 2, None)], "article string, rev_id long, user string")
    sources.append_revisions(page, path)
    sources.append_revisions(page.unionByName(spark.createDataFrame([("b", 3, "w")], page.schema)), path)
    read = lambda: sorted(map(tuple, spark.read.schema(page.schema).parquet(path).select("article", "rev_id", "user").collect()))
    assert read() == [("007", 1, "u"), ("b", 2, "<hidden>"), ("b", 3, "w")]
    sources.replace_articles(spark.createDataFrame([("b", 9, "z")], page.schema), path)
    assert read() == [("007", 1, "u"), ("b", 9, "z")]
    sources.replace_articles(page.limit(0), path)
    assert read() == [("007", 1, "u"), ("b", 9, "z")]


def test_source_receipts(spark):
    revisions = spark.createDataFrame([("a", 1), ("a", 4), ("b", 2)], "article string, rev_id long")
    failed = spark.createDataFrame([("b", "timeout"), ("c", "gone")], "article string, reason string")
    rows = sources.source_receipts(revisions, F.lit("2026-01-01"), failed).orderBy("article").collect()
    assert [(r.article, r.source_status, r.source_latest_revid, r.reason) for r in rows] == [("a", "history_complete", 4, None), ("b", "unavailable", 2, "timeout"), ("c", "unavailable", None, "gone")]


def test_findings(spark, tmp_path):
    for folder, name, text in (("legacy", "a", '{"article": "A", "x": 1}'), ("legacy", "b", '{"article": "B", "x": 2}'), ("shard", "a", '{"article": "A",\n "x": 3}'), ("shard", "c", "{broken"), ("shard", "d", '{"x": 4}')):
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / f"{name}.json").write_text(text)
    old, none = sources.read_findings(spark, str(tmp_path / "legacy/*.json"), "article string, x int")
    new, faults = sources.read_findings(spark, str(tmp_path / "shard/*.json"), "article string, x int")
    assert none.count() == 0
    assert sorted((os.path.basename(r.path), r.reason) for r in faults.collect()) == [("c.json", "invalid_artifact"), ("d.json", "article_missing")]
    best = sources.prefer_shards(old, new)
    assert sorted((r.article, r.x) for r in best.collect()) == [("A", 3), ("B", 2)]
    sources.write_findings(best.drop("path"), str(tmp_path / "out"))
    assert sources.read_findings(spark, str(tmp_path / "out/*.json"), "article string, x int", whole_files=False)[0].count() == 2


def test_shards(spark, tmp_path):
    table = spark.createDataFrame([("a b", 1), ("a b", 2), ("c", 3), (None, 4)], "article string, marker int")
    path = str(tmp_path / "shards")
    sources.export_shards(table, path)
    assert sources.shard_faults(table, path).count() == 0
    more = table.unionByName(spark.createDataFrame([("c", 5), ("d", 6)], table.schema))
    assert sorted(map(tuple, sources.shard_faults(more, path).collect())) == [("c", 2, 1), ("d", 1, 0)]
    clash = spark.createDataFrame([("a b",), ("a_b",), ("c",)], "article string")
    assert [(r.slug, r.articles) for r in sources.slug_collisions(clash).collect()] == [("a_b", ["a b", "a_b"])]


def test_digests(spark, tmp_path):
    for folder in ("one", "two"):
        os.makedirs(tmp_path / folder / "in")
        (tmp_path / folder / "in/x.bin").write_bytes(b"same")
        (tmp_path / folder / "y.bin").write_bytes(folder.encode())
    (tmp_path / "one/z.bin").write_bytes(b"z")
    rows = sources.digest_faults(spark, str(tmp_path / "one"), str(tmp_path / "two"))
    assert sorted(map(tuple, rows.collect())) == [("y.bin", False), ("z.bin", True)]


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    line = '{"article": "a", "rev_id": %d, "ts": "2024-01-%02dT00:00:00Z", "user": "u", "size": 5}\n'
    (inbox / "1.json").write_text(line % (1, 1) + line % (1, 1) + line % (2, 2))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def load():
        assert streaming.store_revisions(streaming.follow_revisions(spark, str(inbox)), out, mark).awaitTermination(120)
        return sorted(r.rev_id for r in spark.read.parquet(out).collect())

    assert load() == [1, 2]
    (inbox / "2.json").write_text(line % (2, 2) + line % (3, 3))
    assert load() == [1, 2, 3]


@pytest.mark.parametrize("rows", [0, 2])
def test_activity(spark, rows):
    data = spark.createDataFrame([("a", k, "u") for k in range(rows)], "article string, rev_id long, user string").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert [(r.revisions, r.users) for r in streaming.activity(data).collect()] == ([(2, 1)] if rows else [])


def test_export_files(spark, tmp_path):
    from driftloom.sources import export_files

    bodies = {"a b.xml": "<mediawiki>\n<page/>\n</mediawiki>\n", "cut.xml": "<mediawiki>\n<page>&lt;/mediawiki&gt;", "empty.xml": ""}
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
    found = {r["file"].rsplit("/", 1)[1].replace("%20", " "): (r["bytes"], r["complete"]) for r in export_files(spark, str(tmp_path)).collect()}
    assert found == {name: (len(body), name == "a b.xml") for name, body in bodies.items() if body}

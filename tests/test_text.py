"""Column functions and small operators that no query reaches."""

from pyspark.sql import functions as F

from driftloom.functions import text as T
from driftloom.operators import attribution, claims


def column(spark, values, made, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"n int, x {kind}").select("n", made(F.col("x")).alias("y")).orderBy("n")
    return [r.y for r in rows.collect()]


def test_titles(spark):
    values = ["A_b", " A b ", "https://en.wikipedia.org/wiki/A_b", "https://de.wikipedia.org/wiki/%C3%89a+b?x=1#y", "https://en.wikipedia.org/w/index.php?oldid=3&title=A_b%2Fc#z", "https://example.org/wiki/A", "https://en.wikipedia.org/wiki/", "", None, "https://en.wikipedia.org/wiki/%ZZ"]
    assert column(spark, values, T.title_of) == ["A_b", "A b", "A b", "Éa+b", "A b/c", "https://example.org/wiki/A", "https://en.wikipedia.org/wiki/", "", "", "https://en.wikipedia.org/wiki/%ZZ"]


def test_leads(spark):
    assert column(spark, ["Lead.\n== A ==\nx", "== A ==\nx", "only", "", None, "a==b\n=c=\nd"], T.lead_of) == ["Lead.\n", "", "only", "", None, "a==b\n=c=\nd"]
    assert column(spark, ["abcdef"], lambda c: T.lead_of(c, 3)) == ["abc"]


def test_contrast(spark):
    colours = {"white": (100.0, 0.0, 0.0), "black": (0.0, 0.0, 0.0), "grey": (50.0, 0.0, 0.0)}
    rows = spark.createDataFrame([(a, b, colours[a], colours[b]) for a in colours for b in colours], "a string, b string, x struct<l:double,c:double,h:double>, y struct<l:double,c:double,h:double>")
    found = {(r.a, r.b): round(r.c, 2) for r in rows.select("a", "b", T.contrast_ratio(F.col("x"), F.col("y")).alias("c")).collect()}
    assert found["white", "black"] == found["black", "white"] == 21.0 and {found[k, k] for k in colours} == {1.0}
    assert 1 < found["grey", "black"] < found["white", "grey"] < 21


def test_section_weights(spark):
    units = claims.claim_units(spark.createDataFrame([("a", 1, "Abc.\n== S ==\nDefgh. Ij.")], "article string, rev_id long, text string"))
    found = {r.section: (r.chars, r.weight) for r in claims.section_weights(units).collect()}
    assert found == {"Lead": (4, round(4 / 13, 4)), "S": (9, round(9 / 13, 4))}


def test_bounded(spark):
    at = lambda c: (F.lit("2020-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col(c).cast("decimal(18,6)")))
    revisions = spark.createDataFrame([("a", n, n // 2) for n in range(8)] + [("b", 3, 1)], "article string, rev_id long, s int").select("article", "rev_id", at("s").alias("ts"))
    windows = spark.createDataFrame([("a", 2, 5), ("a", 0, 0), ("a", 1, 99), ("b", 3, 3)], "article string, before_rev long, after_rev long")
    found = sorted((r.article, r.before_rev, r.seq, r.rev_id, r.seconds) for r in attribution.bounded(revisions, windows).collect())
    assert found == [("a", 0, 0, 0, 0), ("a", 2, 0, 2, 1), ("a", 2, 1, 3, 1), ("a", 2, 2, 4, 1), ("a", 2, 3, 5, 1), ("b", 3, 0, 3, 0)]

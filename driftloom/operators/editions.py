"""Comparisons across language editions and of their sources."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

LEAST_EDITION_BYTES = 2000
DEAD_BAND = 0.25


def static_divergence(stances: DataFrame) -> DataFrame:
    """Mean over entities of the spread between editions. stances: variant, entity, lang, value; nulls don't count."""
    spread = stances.where("value is not null").groupBy("variant", "entity").agg((F.max("value") - F.min("value")).alias("spread"), F.countDistinct("lang").alias("n")).where("n >= 2")
    return spread.groupBy("variant").agg(F.bround(F.avg("spread"), 2).alias("divergence"), F.count(F.lit(1)).alias("entities"))


def en_gap(stances: DataFrame) -> DataFrame:
    """Mean over entities of the distance from the English edition to the mean of the others."""
    own, others = F.avg(F.when(F.col("lang") == "en", F.col("value"))), F.avg(F.when(F.col("lang") != "en", F.col("value")))
    rows = stances.where("value is not null").groupBy("variant", "entity").agg(F.abs(own - others).alias("gap")).where("gap is not null")
    return rows.groupBy("variant").agg(F.bround(F.avg("gap"), 2).alias("gap"))


def read_gap(before: Column, after: Column) -> Column:
    return F.when(after - before > DEAD_BAND, "PEELED AWAY").when(before - after > DEAD_BAND, "converged").when(before.isNotNull() & after.isNotNull(), "no net change")


def select_editions(lengths: DataFrame, slate: list[str], extra: int = 2, most: int = 5, least: int = LEAST_EDITION_BYTES) -> DataFrame:
    """article, place, lang: English, the slate in its order, then the longest others. lengths: article, lang, length."""
    pinned = ["en", *(x for x in slate if x != "en")]
    fixed = F.array_position(F.array(*map(F.lit, pinned)), F.col("lang"))
    order = Window.partitionBy("article", "free").orderBy(F.desc("length"), "lang")
    rows = lengths.withColumns({"fixed": fixed, "free": fixed == 0}).withColumn("r", F.row_number().over(order))
    rows = rows.where(~F.col("free") | ((F.col("length") >= least) & (F.col("r") <= extra)))
    place = Window.partitionBy("article").orderBy("free", "fixed", "r")
    return rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= most).select("article", "place", "lang")


def established_langs(lengths: DataFrame, priority: list[str], pinned: list[str], most: int = 3) -> DataFrame:
    """article, langs: pinned editions, then the longest of the well-known ones; English is always in if it exists."""
    known = F.array_position(F.array(*map(F.lit, priority)), F.col("lang"))
    place = F.array_position(F.array(*map(F.lit, pinned)), F.col("lang")) if pinned else F.lit(0)
    rows = lengths.withColumns({"known": known, "pin": place})
    facts = rows.groupBy("article").agg(F.max(F.col("known") > 0).alias("any_known"), F.count(F.when(F.col("pin") > 0, 1)).alias("n_pins"), F.max(F.when((F.col("known") > 0) & (F.col("pin") == 0) & (F.col("length") > 0), 1)).alias("has_text"))
    rows = rows.join(facts, "article").withColumn("cap", F.when(F.col("n_pins") > 0, F.greatest(F.lit(most), F.col("n_pins") + 2)).otherwise(most))
    pool = (F.col("pin") > 0) | (~F.col("any_known") | (F.col("known") > 0)) & (F.col("has_text").isNull() | (F.col("length") > 0))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("article", pool).orderBy(F.col("pin") == 0, "pin", F.desc("length"), F.when(F.col("known") > 0, F.col("known")).otherwise(999), "lang")))
    chosen = rows.groupBy("article").agg(
        F.transform(F.sort_array(F.collect_list(F.when(pool & (F.col("r") <= F.col("cap")), F.struct("r", "lang")))), lambda x: x["lang"]).alias("langs"), F.max(F.col("lang") == "en").alias("has_en"), F.max("cap").alias("cap")
    )
    absent = F.col("has_en") & ~F.array_contains("langs", "en")
    forced = F.when(F.size("langs") < F.col("cap"), F.array_append("langs", F.lit("en"))).otherwise(F.array_append(F.slice("langs", F.lit(1), F.size("langs") - 1), F.lit("en")))
    return chosen.select("article", F.when(absent, forced).otherwise(F.col("langs")).alias("langs"))


def citation_jaccard(sets: DataFrame) -> DataFrame:
    """Mean overlap of cited domains over pairs of editions; two empty sets overlap in full. sets: article, lang, domains."""
    a = sets.select("article", F.col("lang").alias("x"), F.col("domains").alias("dx"))
    b = sets.select("article", F.col("lang").alias("y"), F.col("domains").alias("dy"))
    union = F.size(F.array_union("dx", "dy"))
    share = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("dx", "dy")) / union)
    rows = a.join(b, "article").where("x < y").withColumn("share", share)
    return rows.groupBy("article").agg(F.count(F.lit(1)).alias("pairs"), F.bround(F.avg("share"), 2).alias("jaccard"))


def source_composition(texts: DataFrame, *key: str) -> DataFrame:
    """key, refs, and counts by kind and name (kind: cite, domain or class) as rows. texts: key columns and text."""
    refs = F.regexp_count("text", F.lit(r"(?i)<ref\b"))
    domains = T.cited_domains(F.col("text"))
    named = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    found = F.concat(named("cite", T.cite_classes(F.col("text"))), named("domain", domains), named("class", F.transform(domains, T.domain_class)))
    rows = texts.select(*key, refs.alias("refs"), F.explode_outer(found).alias("f"))
    return rows.groupBy(*key, "refs", F.col("f.kind").alias("kind"), F.col("f.name").alias("name")).agg(F.count("f.name").alias("n"))


def domain_deltas(counts: DataFrame) -> DataFrame:
    """Domains whose count changed: article, domain, before, after, delta. counts: article, side, domain, n."""
    n = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0)).cast("long")
    rows = counts.groupBy("article", "domain").agg(n("before").alias("before"), n("after").alias("after"))
    return rows.withColumn("delta", F.col("after") - F.col("before")).where("delta <> 0")


def cite_mix(counts: DataFrame) -> DataFrame:
    """Shares of the named classes in percent. counts: article, name, n."""
    rows = counts.where(F.col("name").isin("journal", "book", "news", "web", "report", "press"))
    return rows.withColumn("percent", F.bround(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("article"))).cast("int")).select("article", "name", "percent")


def bound_comparison(divergences: DataFrame, most: int = 6, editions: int = 5) -> DataFrame:
    """The first divergences of each article, with the first editions that differ (null: none). divergences: article, place
    (from 0, unique in an article), editions_differ (array) and others."""
    order = Window.partitionBy("article").orderBy("place")
    rows = divergences.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).drop("_r")
    return rows.withColumn("editions_differ", F.slice(F.coalesce("editions_differ", F.array().cast("array<string>")), 1, editions))


def evenly_sampled(rows: DataFrame, order: str, most: int) -> DataFrame:
    """Rows int(i * n / most) of each article's n, for i from 0 to most - 1, and the last one; all if they are no more than most."""
    place = Window.partitionBy("article").orderBy(order)
    rows = rows.withColumns({"_k": F.row_number().over(place) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy("article"))})
    step = F.col("_n") / F.lit(float(most))
    near = F.ceil(F.col("_k") / step)  # the i of row k, but for rounding
    hit = [(near + d >= 0) & (near + d < most) & (F.floor((near + d) * step) == F.col("_k")) for d in (-1, 0, 1)]
    return rows.where((F.col("_n") <= most) | hit[0] | hit[1] | hit[2] | (F.col("_k") == F.col("_n") - 1)).drop("_k", "_n")


_QUOTES = str.maketrans({"“": '"', "”": '"', "’": "'", "–": "-", "—": "-"})


@F.pandas_udf(StringType())
def plain_quote(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility forms, quotes, dashes, white space and case made equal."""
    for s in batches:
        yield s.map(lambda x: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x or "").translate(_QUOTES)).strip().casefold())


def ground_evidence(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """quotes (id, quote and others) with the quote null unless a source (id, text) of the same id contains it."""
    held = sources.select("id", plain_quote("text").alias("_s"))
    asked = quotes.where("quote is not null").select("id", "quote", plain_quote("quote").alias("_q")).distinct()
    good = asked.join(held, "id").where(F.contains("_s", "_q")).select("id", F.col("quote").alias("_good")).distinct()
    good = good.withColumnRenamed("id", "_id")
    rows = quotes.join(good, (F.col("id") == F.col("_id")) & (F.col("quote") == F.col("_good")), "left")
    return rows.withColumn("quote", F.when((F.col("quote") == "") | F.col("_good").isNotNull(), F.col("quote"))).select(quotes.columns)

"""Vocabulary before and after a change: counts, divergence, terms that gained or lost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_terms
from ..params import DEFAULT, Params

SMOOTHING = 0.5
LEAST_TOTAL = 3
MOST_TERMS = 20


def term_counts(texts: DataFrame, *key: str) -> DataFrame:
    """key, term, n. texts: key columns and text."""
    return texts.select(*key, F.explode(content_terms(F.col("text"))).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("n"))


def paired(counts: DataFrame) -> DataFrame:
    """article, term, b, a and the totals tb, ta. counts: article, side (before or after), term, n."""
    n = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0))
    rows = counts.groupBy("article", "term").agg(n("before").alias("b"), n("after").alias("a"))
    totals = counts.groupBy("article").agg(n("before").alias("tb"), n("after").alias("ta"))
    return rows.join(totals, "article")


def js_divergence(pairs: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence in nats; 0 where a side has no terms."""
    p, q = F.col("b") / F.col("tb"), F.col("a") / F.col("ta")
    half = lambda x: F.when(x > 0, 0.5 * x * F.ln(x / (0.5 * (p + q)))).otherwise(0.0)
    both = (F.col("tb") > 0) & (F.col("ta") > 0)
    total = F.sum(F.when(both, half(p) + half(q)).otherwise(0.0))
    return pairs.groupBy("article").agg(F.bround(total, 4).alias("js_divergence"), F.max("tb").alias("before_tokens"), F.max("ta").alias("after_tokens"))


def log_odds(pairs: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """The terms that gained and lost most: article, direction, rank, term, before, after, delta, log_odds."""
    odds = lambda n, total: F.ln((F.col(n) + SMOOTHING) / (F.greatest(F.lit(0), F.col(total) - F.col(n)) + SMOOTHING))
    rows = pairs.where((F.col("tb") > 0) & (F.col("ta") > 0) & (F.col("a") + F.col("b") >= LEAST_TOTAL) & (F.col("a") != F.col("b")))
    rows = rows.withColumns({"log_odds": F.bround(odds("a", "ta") - odds("b", "tb"), 4), "delta": F.col("a") - F.col("b")}).where("log_odds <> 0")
    rows = rows.withColumn("direction", F.when(F.col("log_odds") > 0, "gained").otherwise("lost"))
    further = F.when(F.col("direction") == "gained", -F.col("delta")).otherwise(F.col("delta"))  # not its size: with unlike totals the signs can differ
    order = Window.partitionBy("article", "direction").orderBy(F.desc(F.abs("log_odds")), further, "term")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return rows.select("article", "direction", "rank", "term", F.col("b").alias("before"), F.col("a").alias("after"), "delta", "log_odds")


def baseline_adequacy(totals: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds size_ratio, adequate and inadequacy. totals: before_tokens, after_tokens."""
    small, large = F.least("before_tokens", "after_tokens"), F.greatest("before_tokens", "after_tokens")
    ratio = F.bround(F.when(small > 0, large / small), 4)
    reason = F.when(small < p.lexical_tokens, "token_floor").when(ratio > p.lexical_ratio, "size_ratio")
    return totals.withColumns({"size_ratio": ratio, "inadequacy": reason}).withColumn("adequate", F.col("inadequacy").isNull())


def lexical_drift(texts: DataFrame, confirmed: DataFrame | None = None, p: Params = DEFAULT) -> DataFrame:
    """One row per article of texts (article, side, text). An article of confirmed (article) is compared across its pivot,
    others over their whole history."""
    rows = baseline_adequacy(js_divergence(paired(term_counts(texts, "article", "side"))), p)
    rows = texts.select("article").distinct().join(rows, "article", "left")
    if confirmed is None:
        rows = rows.withColumn("pivot", F.lit(False))
    else:
        rows = rows.join(confirmed.select("article").distinct().withColumn("pivot", F.lit(True)), "article", "left")
    mode = F.when(F.coalesce("pivot", F.lit(False)), "pivot_relative").otherwise("whole_history")
    state = F.when(F.col("js_divergence").isNull(), "not_applicable").when(F.col("adequate"), "available").otherwise("insufficient_baseline")
    return rows.select("article", mode.alias("mode"), state.alias("analysis_status"), "js_divergence", "before_tokens", "after_tokens", "size_ratio", "adequate", "inadequacy")

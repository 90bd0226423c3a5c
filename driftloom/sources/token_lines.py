"""Lines of a token tool: a revision, then token:origin for each token, parted by tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_token_lines(lines: DataFrame) -> DataFrame:
    """rev_id, place, token_id, o_rev_id of each token of lines (value). Blank lines give nothing; a number that can't be
    read is null (tell such lines with `where token_id is null`)."""
    parts = F.split("value", "\t")
    rows = lines.where(F.trim("value") != "").select(F.try_element_at(parts, F.lit(1)).try_cast("long").alias("rev_id"), F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("place", "token"))
    pair = F.split("token", ":")
    return rows.select("rev_id", "place", pair[0].try_cast("long").alias("token_id"), F.try_element_at(pair, F.lit(2)).try_cast("long").alias("o_rev_id"))


def read_token_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_token_lines(spark.read.text(path))

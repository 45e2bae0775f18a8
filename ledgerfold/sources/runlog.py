"""Run logs: lines of white-space separated tokens, of which some carry a figure after a known message."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tokens(lines: DataFrame, value: str = "value") -> DataFrame:
    return lines.withColumn("tokens", F.split(F.trim(F.col(value)), r"\s+"))


def figures(lines: DataFrame, message: str, places: dict[str, int], value: str = "value") -> DataFrame:
    """Of lines that hold the message, the tokens at the given places (0 first) as numbers; what is no number is null.
    The message text is looked for, not the source line that wrote it, which moves."""
    rows = tokens(lines, value).where(F.contains(F.col(value), F.lit(message)))
    number = lambda k: F.expr(f"try_cast(try_element_at(tokens, {k + 1}) AS DOUBLE)")
    return rows.select(*(c for c in lines.columns if c != value), *(number(k).alias(n) for n, k in places.items()))


def read(spark: SparkSession, path: str, message: str, places: dict[str, int]) -> DataFrame:
    return figures(spark.read.text(path).withColumn("file", F.input_file_name()), message, places)

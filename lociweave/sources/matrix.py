"""Number tables as text: blanks between values, one row a line, no header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociweave.sources.text import decimal, numbered


def read(spark: SparkSession, path: str) -> DataFrame:
    """row, values: the lines in order; what is no number is 0."""
    return numbered(spark, path).select("row", F.transform(F.split(F.trim("value"), " +"), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))).alias("values"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """row, population: the first word of each line, in order."""
    return numbered(spark, path).select("row", F.element_at(F.split(F.trim("value"), r"\s+"), 1).alias("population"))


def lines(rows: DataFrame, order: list[str], values: str, places: int = 6) -> DataFrame:
    """Text lines of an array column, in order."""
    text = F.array_join(F.transform(values, lambda x: decimal(x, places)), " ")
    return rows.orderBy(*order).select(text.alias("value"))


def written(rows: DataFrame, order: list[str], values: str, path: str, places: int = 6) -> None:
    lines(rows, order, values, places).write.text(path)

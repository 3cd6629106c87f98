"""Scored search over a table, in place of a remote paper search; and a synthetic population."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def relevance(docs: DataFrame, key: str, text: str, terms: list[str], k: int) -> DataFrame:
    """(key, score): the k rows with the most occurrences of the terms, ties to the smaller key."""
    low = F.lower(F.col(text))
    score = sum((F.regexp_count(low, F.lit(rf"\b{t.lower()}\b")) for t in terms), F.lit(0)).cast("long")
    return docs.select(key, score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), key).limit(k)


def population(spark: SparkSession, sizes: tuple[int, int, int] = (600, 300, 100), seed: int = 42) -> DataFrame:
    """(business_id, employees, revenue): three strata of 1-5, 6-20 and 21-50 employees, noise growing with size."""
    a, b, c = sizes
    u = F.rand(seed)
    i = F.col("id")
    e = F.when(i < a, 1 + F.floor(u * 5)).when(i < a + b, 6 + F.floor(u * 15)).otherwise(21 + F.floor(u * 30))
    rows = spark.range(a + b + c).select((i + 1).alias("business_id"), e.cast("int").alias("employees"), F.randn(seed + 1).alias("noise"))
    return rows.select("business_id", "employees", (50000 * F.col("employees") + 20000 * F.col("noise") * F.col("employees")).alias("revenue"))

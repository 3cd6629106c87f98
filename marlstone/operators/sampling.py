"""Samples and folds that reruns and other partitionings reproduce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exactly(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement: the smallest seeded hashes of the key (ties by key)."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def fold(key: str, k: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int")


def uniform(*key: str, seed: int = 0) -> Column:
    """A number in [0, 1) by row, the same wherever it is computed: 32 bits of the MD5 of seed and key."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def weighted_choice(u: Column, values: list, weights: list[float]) -> Column:
    """The value whose share of [0, 1) has u."""
    total, upto, out = sum(weights), sum(weights), F.lit(values[-1])
    for v, w in zip(values[:-1][::-1], weights[:-1][::-1], strict=True):
        upto -= weights[values.index(v) + 1]
        out = F.when(u < F.lit(upto / total), F.lit(v)).otherwise(out)
    return out


def described(df: DataFrame, c: str) -> DataFrame:
    """Count, mean, standard deviation, extremes and exact quartiles (interpolated) of a column."""
    return df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        *[F.percentile(c, F.lit(q)).alias(name) for q, name in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))], F.max(c).alias("max"),
    )


def best(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group in a total order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= k).drop("__r")

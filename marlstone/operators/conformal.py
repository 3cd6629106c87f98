"""Split conformal prediction sets."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.session import cut


def order_statistic(scores: DataFrame, s: str, alpha: float, rows: int = 1 << 18) -> DataFrame:
    """One row: the ceil((n + 1)(1 - alpha))-th smallest score, infinity if there are fewer (n, rank, q).

    Scores are counted by value. While more than rows values may be the one, approximate quantiles
    cut them into 64 ranges, whose exact counts tell the range with the rank; so a bounded number
    of values meets in the ordered pass, and the result is exact.
    """
    near = cut(scores.where(F.col(s).isNotNull()).groupBy(F.col(s).alias("s")).agg(F.count("*").alias("c")), "scores")
    values, n = near.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    rank, below = rank_of(n, alpha), 0
    while values > rows and rank <= n:
        cuts = sorted(set(near.agg(F.percentile_approx("s", [i / 64 for i in range(1, 64)])).first()[0]))
        part = near.withColumn("at", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("s"))))
        for at, held, c in sorted(map(tuple, part.groupBy("at").agg(F.count("*"), F.sum("c")).collect())):  # 64 rows at most
            if below + c >= rank:
                break
            below += c
        if held == values:
            break
        near, values = part.where(F.col("at") == at).select("s", "c"), held
    upto = near.withColumn("upto", F.sum("c").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(below))
    q = F.coalesce(F.min(F.when(F.col("upto") >= rank, F.col("s"))), F.lit(float("inf")))
    return upto.agg(F.lit(n).cast("long").alias("n"), F.lit(rank).cast("long").alias("rank"), q.alias("q"))


def sets(scores: DataFrame, row: str, label: str, p: str, threshold: DataFrame) -> DataFrame:
    """(row, labels, size): all labels with 1 - p <= q, sorted. Rows whose set is empty have an empty list."""
    kept = scores.crossJoin(F.broadcast(threshold.select("q"))).withColumn("__in", (1 - F.col(p)) <= F.col("q"))
    labels = F.array_sort(F.collect_list(F.when(F.col("__in"), F.col(label))))
    return kept.groupBy(row).agg(labels.alias("labels")).withColumn("size", F.size("labels"))


def interval(pred: Column, q: Column) -> Column:
    """Regression interval around a prediction from absolute-residual scores."""
    return F.struct((pred - q).alias("lo"), (pred + q).alias("hi"))


def anomalies(df: DataFrame, pred: str, truth: str, q: Column) -> DataFrame:
    """df with the interval's ends lo and hi and ``anomaly``: the truth lies outside. A null truth is imputed: pred, with its interval."""
    out = df.withColumns({"lo": F.col(pred) - q, "hi": F.col(pred) + q, "imputed": F.coalesce(truth, pred)})
    return out.withColumn("anomaly", ~F.coalesce(F.col(truth).between(F.col("lo"), F.col("hi")), F.lit(True)))


def coverage(sets_: DataFrame, truth: DataFrame, row: str, label: str) -> DataFrame:
    """Share of rows whose set has the true label."""
    return sets_.join(truth, row).agg(F.avg(F.array_contains("labels", F.col(label)).cast("double")).alias("coverage"), F.count("*").alias("n"))


def rank_of(n: int, alpha: float) -> int:
    return ceil(round((n + 1) * (1 - alpha), 9))

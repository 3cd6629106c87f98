"""Keyed state on streams: message upserts, incremental means, windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.session import scratch


def incremental_means(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean) after each batch that touches the key, in update mode. Native state: a count and a sum."""
    return stream.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for what is there now: of complete mode the last result, of others every row with its ``batch``.

    Results, offsets and state go to the shared folder.
    """
    spark = stream.sparkSession
    out, offsets, batches = scratch(spark, "stream"), scratch(spark, "offsets"), []

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/at={batch}")  # a repeated batch replaces itself
        batches.append(batch)

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", offsets).trigger(availableNow=True).start()
    q.awaitTermination()
    schema = stream.schema.add("batch", T.IntegerType())
    if not batches:
        return spark.createDataFrame([], schema)
    held = [max(batches)] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(schema).parquet(*[f"{out}/at={b}" for b in held])


def latest_messages(stream: DataFrame, conv: str, ident: str, order: str, text: str) -> DataFrame:
    """(conv, ident, position, text): upsert by id, in the place of the first, in update mode. Native state."""
    return stream.groupBy(conv, ident).agg(F.min(order).alias("position"), F.max_by(text, order).alias(text))


def windowed(stream: DataFrame, ts: str, by: str, value: str, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(start, end, by, n, total) by event time; rows later than late are dropped by the watermark.

    An extension: event-time windows. ts may be a timestamp without a zone, taken as UTC.
    """
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = marked.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, by, n): sessions closed by a gap. An extension."""
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = marked.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")

"""Documents of the form {id: record, ...}: read, upsert, look up over many folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_FOUND = "There's no saved information related to paper %s."  # fixed text
RECORD = "title string, authors array<string>, summary string, pdf_url string, published string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read(spark: SparkSession, path: str, record: str = RECORD) -> DataFrame:
    """(id, record fields, path). A missing path or a file that isn't such a document gives no rows."""
    empty = spark.createDataFrame([], f"id string, r struct<{record}>, path string").select("id", "r.*", "path")
    if not _exists(spark, path):
        return empty
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), "value")
    held = F.from_json("value", f"map<string, struct<{record}>>")
    return text.select("path", F.explode(held).alias("id", "r")).select("id", "r.*", "path")


def upserted(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """All of new, and of old what new doesn't have. Of rows of new with one key the last by ``priority`` (if it is a column)."""
    order = [F.col("priority").desc()] if "priority" in new.columns else [F.lit(1)]
    from pyspark.sql import Window

    last = new.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r", "priority")
    return old.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def write(df: DataFrame, path: str, key: str = "id") -> None:
    """One file a partition, each record under its key (sorted); a fresh path, never one that is being read."""
    fields = [c for c in df.columns if c not in (key, "path")]
    part = df.groupBy(F.spark_partition_id().alias("p")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.struct(*fields).alias("r"))))).alias("m"))
    part.select("p", F.to_json("m", {"pretty": "true"}).alias("value")).write.partitionBy("p").text(path)


def lookup(rows: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """wanted's keys with the record of the first path that has them, as JSON, or a message."""
    fields = F.to_json(F.struct(*[c for c in rows.columns if c not in (key, "path")]))
    first = rows.groupBy(key).agg(F.min_by(fields, "path").alias("found"))
    return wanted.select(key).join(first, key, "left").withColumn("found", F.coalesce("found", F.format_string(NOT_FOUND, F.col(key).cast("string"))))

"""From raw documents to a sharded training mix: five stages over the whole corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet in the shared folder and reads it back as the next one's input. A stage's input and its
scratch tables are deleted once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, mixing, near_dup, sharding, toxicity
from marlstone.session import remove, scope, scratch, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, trained on the labelled ones, doesn't find toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    kept = docs.withColumn("__toxicity", toxicity.scored(docs, model))
    return kept.where(~F.col("__toxicity.toxic")).drop("__toxicity")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_dup.kept(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, however long they are."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), quotes=False)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once or twice, or not at all."""
    out = mixing.mixed(docs)
    return out.where("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents of the mix with their shard and slot, which replace columns of these names."""
    out = sharding.sharded(docs)
    return out.select(*(c for c in docs.columns if c.lower() not in ("shard", "slot")), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"))


STAGES = [
    ("toxicity", not_toxic),
    ("near_dup", one_of_each),
    ("decontaminate", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The near-duplicate stage takes connected components and the mixing stage a knapsack, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; empty if documents are. Columns beside those of documents are carried along."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name)
        with scope(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)

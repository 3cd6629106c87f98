"""Record linkage: variants of names, scored, and the hardest matching and non-matching of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.strings import jaro_winkler, strip

PLACEHOLDER = "no additional verified variant found"  # fixed value


def rule_variants(name: Column, other: Column) -> tuple[Column, Column]:
    """Stand-in for a language model's variants: (positive, negative), by fixed edits.

    Not equivalent to a model; it makes the pipeline testable. Positive: upper case, first letters
    dropped to initials, a suffix. Negative: the next entity's name, and it with a suffix.
    """
    positive = F.array(F.upper(name), F.concat(name, F.lit(" inc")), F.regexp_replace(name, r"\s+", "-"), F.lit("No additional verified variant found"))
    negative = F.array(other, F.concat(other, F.lit(" ltd")))
    return positive, negative


def cleaned(variants: Column) -> Column:
    """Without placeholders."""
    return F.filter(variants, lambda v: v.isNotNull() & (F.lower(strip(v)) != PLACEHOLDER))


def matched_pairs(entities: DataFrame, key: str, name: str, positive: str, negative: str, score: Callable[[Column, Column], Column] | None = None, n_samples: int | None = None) -> DataFrame:
    """Two rows for each entity: (key, name_one, name_two, similarity, label).

    Label 1 is its least similar positive variant, 0 its most similar negative one (the first of
    equals). Entities without variants on either side are left out. A zero or missing n_samples
    takes all; otherwise the first of them by key.
    """
    score = score or (lambda a, b: jaro_winkler(a, b, ignore_case=True))
    rows = entities.orderBy(key).limit(n_samples) if n_samples else entities
    rows = rows.select(key, F.col(name).alias("name_one"), cleaned(F.col(positive)).alias("p"), cleaned(F.col(negative)).alias("q")).where("size(p) > 0 and size(q) > 0")
    one = rows.select(key, "name_one", F.posexplode("p").alias("pos", "name_two")).withColumn("label", F.lit(1))
    two = rows.select(key, "name_one", F.posexplode("q").alias("pos", "name_two")).withColumn("label", F.lit(0))
    scored = one.unionByName(two).withColumn("similarity", score(F.col("name_one"), F.col("name_two")))
    hard = F.when(F.col("label") == 1, F.col("similarity")).otherwise(-F.col("similarity"))
    r = F.row_number().over(Window.partitionBy(key, "label").orderBy(hard, "pos"))
    return scored.withColumn("__r", r).where("__r = 1").select(key, "name_one", "name_two", "similarity", "label")


def matched_table(entities: DataFrame, key: str, name: str, positive: str, negative: str, base: list[str]) -> DataFrame:
    """matched_pairs with the entity's base columns and without the similarity."""
    pairs = matched_pairs(entities, key, name, positive, negative).drop("similarity")
    return entities.select(key, *base).join(pairs, key).select(key, *base, "name_one", "name_two", "label")


def same_entity(a: Column, b: Column, least: float = 0.85) -> Column:
    """1 if two names are taken for the same entity: a threshold, standing in for a model's label."""
    return (jaro_winkler(a, b, ignore_case=True) >= least).cast("int")

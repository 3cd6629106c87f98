"""Structured extraction: a provider turns text into JSON, which is parsed, validated and split.

A provider is a function Column -> Column of JSON text. Language models and web services can't be
reached here; the providers below are rules. They stand in for a model where a text follows the
pattern they know, and aren't equivalent to one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.jsons import as_array, parsed
from marlstone.operators.validation import Rule, validated

Provider = Callable[[Column], Column]

LISTING = "name string, street_number string, street_name string, city string, postal_code string, email string, website string"


def pattern_provider(regex: str, fields: list[str]) -> Provider:
    """A rule-based provider: every match of regex is a record, its groups the fields (empty: null)."""

    def run(text: Column) -> Column:
        groups = [F.regexp_extract_all(text, F.lit(regex), F.lit(i + 1)) for i in range(len(fields))]
        rows = F.arrays_zip(*[g.alias(f) for g, f in zip(groups, fields, strict=True)])
        return F.to_json(F.transform(rows, lambda r: F.struct(*[F.when(r[f] != "", r[f]).alias(f) for f in fields])))

    return run


def html_provider(text: Column) -> Column:
    """Title and headings of a page, as one JSON object."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", ""))
    title = clean(F.regexp_extract(text, r"(?is)<title[^>]*>(.*?)</title>", 1))
    heads = F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), clean)
    return F.to_json(F.struct(title.alias("title"), heads.alias("headings")))


def extracted(df: DataFrame, text: str, provider: Provider, element: str, rules: list[Rule], key: str) -> DataFrame:
    """One row for each record: (key, position, fields, errors, valid, error_class).

    error_class: ``json`` for text that isn't JSON or not a list of records (one row, null
    fields), ``validation`` for records that break a rule, null for good ones.
    """
    raw = df.select(key, as_array(provider(F.col(text))).alias("__json"))
    found = raw.withColumn("__list", parsed(F.col("__json"), f"array<struct<{element}>>"))
    rows = found.select(key, F.col("__list").isNull().alias("__bad"), F.posexplode_outer("__list").alias("position", "__r"))
    checked = validated(rows.select(key, "__bad", "position", "__r.*"), rules)
    kind = F.when(F.col("__bad"), "json").when(~F.col("valid"), "validation")
    return checked.where("__bad or position is not null").withColumn("error_class", kind).drop("__bad")


def entities(text: Column) -> Column:
    """Dates, amounts of money and percentages of a text, by rules; other classes need a model."""
    every = lambda r: F.regexp_extract_all(text, F.lit(r), F.lit(0))
    return F.struct(every(r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b").alias("dates"), every(r"[$€£][0-9][0-9,]*(?:\.[0-9]+)?").alias("money"), every(r"\b[0-9]+(?:\.[0-9]+)?%").alias("percentages"))


def address_kind(text: Column) -> tuple[Column, Column]:
    """(kind, certainty) of an address line by key words; a low certainty makes the kind ``review``."""
    home = text.rlike(r"(?i)\b(apt|apartment|unit|house)\b")
    shop = text.rlike(r"(?i)\b(suite|plaza|mall|office|inc|ltd|store)\b")
    certainty = F.when(home != shop, "high").otherwise("low")
    return F.when(certainty == "low", "review").when(home, "residential").otherwise("commercial"), certainty


def content_filter(text: Column, classifiers: list[Column]) -> Column:
    """Majority of boolean classifiers; null votes don't count; a tie passes."""
    votes = F.filter(F.array(*classifiers), lambda v: v.isNotNull())
    return 2 * F.size(F.filter(votes, lambda v: v)) > F.size(votes)


def exact_match(df: DataFrame, pred: str, label: str) -> DataFrame:
    return df.agg(F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"), F.count("*").alias("n"))

"""Declarative record validation: rules compile to Columns, errors are collected, nothing is dropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.strings import is_digits

# Two-digit industry sectors that a six-digit code may begin with (fixed values).
SECTORS = "11 21 22 23 31 32 33 42 44 45 48 49 51 52 53 54 55 56 61 62 71 72 81 92".split()
# Letters that a Canadian postal code doesn't have in its first, and in its third and fifth place (fixed values).
NOT_FIRST, NOT_LATER = "DFIO", "DFIOQU"


@dataclass(frozen=True)
class Rule:
    """A field with its failure messages in order; the first whose condition fails is reported.

    A null condition counts as failed.
    """

    field: str
    checks: tuple[tuple[Column, str], ...]

    def message(self) -> Column:
        out = F.lit(None).cast("string")
        for ok, text in reversed(self.checks):
            out = F.when(~F.coalesce(ok, F.lit(False)), text).otherwise(out)
        return out


def required(field: str) -> Rule:
    return Rule(field, ((F.col(field).isNotNull(), "Field required"),))


def optional(rule: Rule) -> Rule:
    """A null value passes."""
    return Rule(rule.field, tuple((F.col(rule.field).isNull() | ok, text) for ok, text in rule.checks))


def coerced(field: str, kind: str) -> Rule:
    return Rule(field, ((F.col(field).isNotNull(), "Field required"), (F.col(field).try_cast(kind).isNotNull(), f"Input should be a valid {kind}")))


def length(field: str, least: int, most: int) -> Rule:
    n = F.char_length(F.col(field))
    return Rule(field, ((F.col(field).isNotNull(), "Field required"), (n >= least, f"At least {least} characters"), (n <= most, f"At most {most} characters")))


def pattern(field: str, regex: str) -> Rule:
    return Rule(field, ((F.col(field).isNotNull(), "Field required"), (F.col(field).rlike(regex), f"String should match {regex}")))


def one_of(field: str, values: list[str]) -> Rule:
    return Rule(field, ((F.col(field).isin(values), f"Must be one of: {', '.join(values)}"),))


def at_most(field: str, n: int) -> Rule:
    return Rule(field, ((F.size(field) <= n, f"At most {n} items"),))


def business_number(field: str = "business_number") -> Rule:
    c = F.col(field)
    return Rule(field, ((c.isNotNull(), "Field required"), (is_digits(c), "Business number must contain only digits"), (F.char_length(c) == 9, "Business number must be exactly 9 digits")))


def industry_code(field: str = "naics_code") -> Rule:
    c = F.col(field)
    sector = F.substring(c, 1, 2).isin(SECTORS)
    return Rule(field, ((c.isNotNull(), "Field required"), (is_digits(c), "NAICS code must contain only digits"), (F.char_length(c) == 6, "NAICS code must be exactly 6 digits"), (sector, "Invalid NAICS sector code")))


def street_number(field: str = "street_number") -> Rule:
    return Rule(field, ((F.col(field).isNotNull(), "Field required"), (is_digits(F.replace(F.col(field), F.lit(" "), F.lit(""))), "Street number must be numeric")))


def postal_code(field: str = "postal_code", strict: bool = False) -> Rule:
    """A1A 1A1 with letters barred from some places. A null code is valid.

    Letters are looked up in the trimmed code as it is written, so that with an inner space the
    fifth place is a digit; strict looks them up in the code without spaces.
    """
    c = F.upper(F.trim(F.col(field)))
    bare = F.replace(c, F.lit(" "), F.lit(""))
    at = bare if strict else c
    place = lambda i, letters: ~F.substring(at, i, 1).isin(list(letters))
    return optional(
        Rule(field, (
            (bare.rlike(r"^[A-Z][0-9][A-Z][0-9][A-Z][0-9]$"), "Invalid postal code format"), (place(1, NOT_FIRST), "Invalid first letter in postal code"),
            (place(3, NOT_LATER), "Invalid third letter in postal code"), (place(5, NOT_LATER), "Invalid fifth letter in postal code"),
        ))
    )


def email(field: str) -> Rule:
    return optional(pattern(field, r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}$"))


def http_url(field: str) -> Rule:
    host = F.try_parse_url(F.col(field), F.lit("HOST"))
    return optional(Rule(field, ((F.col(field).rlike(r"(?i)^https?://") & host.isNotNull(), "Invalid URL"),)))


def validated(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with ``errors`` (an array of (field, message), in rule order) and ``valid``."""
    found = F.array(*[F.struct(F.lit(r.field).alias("field"), r.message().alias("message")) for r in rules])
    return df.withColumn("errors", F.filter(found, lambda e: e["message"].isNotNull())).withColumn("valid", F.size("errors") == 0)


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows with df's columns, rejected rows with their errors)."""
    out = validated(df, rules)
    return out.where("valid").select(*df.columns), out.where("not valid").drop("valid")


def report(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(field, message, n), and the number of valid rows under a null field."""
    out = validated(df, rules).select(F.explode_outer("errors").alias("e"))
    return out.groupBy(F.col("e.field").alias("field"), F.col("e.message").alias("message")).agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Collection-level rule: keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")

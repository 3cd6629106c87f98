"""String functions that Spark has no equivalent of, and small text helpers as Columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _places(b: str) -> dict[str, int]:
    """Each character's places in b, a bit a place."""
    at: dict[str, int] = {}
    for j, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << j
    return at


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(0, max(n, m) // 2 - 1)
    at, window, free, hits = _places(b), (1 << 2 * reach + 1) - 1, (1 << m) - 1, []
    for i, c in enumerate(a):
        near = window << i - reach if i >= reach else window >> reach - i
        if met := at.get(c, 0) & free & near:
            free ^= met & -met  # the first free place
            hits.append(c)
    if not hits:
        return 0.0
    moved = sum(x != y for x, y in zip(hits, (b[j] for j in range(m) if not free >> j & 1), strict=True)) // 2
    k = len(hits)
    return (k / n + k / m + (k - moved) / k) / 3


def _jaro_winkler(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    s = _jaro(a, b)
    if s <= 0.7:
        return s
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return s + 0.1 * same * (1 - s)


def _indel_ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if not a and not b:
        return 1.0
    at, every = _places(b), (1 << len(b)) - 1
    row = every  # bit-parallel longest common subsequence: a zero bit for each of its characters
    for c in a:
        met = row & at.get(c, 0)
        row = (row + met | row - met) & every
    return 2 * (len(b) - row.bit_count()) / (len(a) + len(b))


def _pairwise(f):
    """A vectorised UDF of two string columns; each distinct pair of a batch is computed once."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for x in zip(a, b, strict=True):
            if x not in known:
                known[x] = f(*x)
            out.append(known[x])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")


def jaro_winkler(a: Column, b: Column, ignore_case: bool = False) -> Column:
    """Jaro-Winkler similarity by code points: prefix of 4 at most, scale 0.1, only above Jaro 0.7."""
    return _pairwise(_jaro_winkler)(F.lower(a), F.lower(b)) if ignore_case else _pairwise(_jaro_winkler)(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """1 - (insertions + deletions) / both lengths, that is twice the longest common subsequence over them."""
    return _pairwise(_indel_ratio)(a, b)


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def is_digits(c: Column) -> Column:
    return c.rlike(r"^[0-9]+$")


def topic_path(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def prompt(instructions: str, text: Column, ask: str = "Polarity: ") -> Column:
    return F.concat_ws("\n", F.lit(instructions), F.concat(F.lit("Input: "), text), F.lit(ask))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def signed(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%+.{digits}f", c.cast("double"))


def percent(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c.cast("double"))


def fenced_json(c: Column) -> Column:
    """The body of a fenced block of a Markdown text, or the text itself."""
    body = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    return F.when(body != "", body).otherwise(c)

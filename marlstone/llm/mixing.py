"""Mixing sources to target weights by subset-sum budget fitting.

Each source has a budget of words. Whole passes over the source are taken as often as they fit;
what remains of the budget is filled with documents taken once more. Documents are counted by
exact length within each source, and the rest of the work is on those counts:

1. of each length an even share of its documents, rounded down;
2. from the longest length down, further documents while they fit, until at most ``reach``
   words remain;
3. a bounded knapsack over the documents still left (binary splitting, one bit for each
   reachable sum, 2 x ``reach`` bits) picks the sum nearest to what remains (of two as near, the
   smaller). Where more than ``reach`` remains, all that fits is taken already, and the choice is
   between nothing and the shortest document left.

Of each source a row and its distinct lengths meet in one task; documents never do.

Documents are then selected seeded: within (source, length) by a hash of their id and text, as many
as the count says. Groups are salted, so that one (source, length) may hold any share of the rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 7
REACH = 1 << 15
SALT_ROWS = 512


def size_of(text: str = "text"):
    """Words of a text: runs of anything but a space and \\x09-\\x0D. Null: 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: (__src, source, source_size), a row a source. Adds target.

    Sources in code-point order, null last, weigh weights[0], weights[1], ... repeating. share x
    all sizes is dealt out by weight; a target above most x its source's size stops there and the
    excess goes to the others by weight until none is above. In closed form: sources in order of
    cap / weight reach their caps one after the other, and the first that doesn't fixes the level
    of all later ones. If even all caps together are below the budget, every target is its cap.
    """
    number = Window.orderBy(F.col("source").asc_nulls_last())
    k = len(weights)
    weighed = sizes.withColumn("__i", F.row_number().over(number) - 1).withColumn(
        "__w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__i") % k + 1).cast("int"))
    )
    cap = F.col("source_size") * F.lit(float(most))
    by = Window.orderBy(F.col("__cap") / F.col("__w"), "__i")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.col("__budget") - F.coalesce(F.sum("__cap").over(upto), F.lit(0.0))) / F.sum("__w").over(rest)
    return (
        weighed.withColumn("__cap", cap)
        .withColumn("__budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("__level", level)
        .withColumn("__free", F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level")))
        .withColumn("__final", F.first("__free", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("target", F.least("__cap", F.coalesce(F.col("__final") * F.col("__w"), F.col("__cap"))))
        .select("__src", "source", "source_size", "target")
    )


def fit(lengths: list[int], counts: list[int], budget: int, reach: int = REACH) -> list[int]:
    """How many documents of each length to take, so that their sum is near the budget."""
    total = sum(a * b for a, b in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [n * budget // total if total else 0 for n in counts]
    left = budget - sum(a * b for a, b in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left <= reach:
            break
        if lengths[i] > 0:
            more = min(counts[i] - take[i], (left - reach // 2) // lengths[i]) if lengths[i] <= reach // 2 else min(counts[i] - take[i], left // lengths[i])
            take[i] += more
            left -= more * lengths[i]
    if left > reach:
        more = [i for i in order if 0 < lengths[i] and take[i] < counts[i]]
        if more and lengths[more[-1]] - left < left:
            take[more[-1]] += 1
    elif left > 0:
        mask, reached, steps = (1 << (2 * left + 1)) - 1, 1, []  # more than left over is worse than nothing
        for i in order[::-1]:
            free, chunk = counts[i] - take[i], 1
            if lengths[i] <= 0 or lengths[i] > 2 * left:
                continue
            free = min(free, 2 * left // lengths[i])
            while free > 0:
                chunk = min(chunk, free)
                steps.append((i, chunk, reached))
                reached |= (reached << (chunk * lengths[i])) & mask
                free -= chunk
                chunk *= 2
            if reached >> left & 1:
                break
        below = (reached & ((1 << (left + 1)) - 1)).bit_length() - 1
        over = reached >> (left + 1)
        above = left + (over & -over).bit_length() if over else None
        best = above if above is not None and above - left < left - below else below
        for i, chunk, before in reversed(steps):
            if not before >> best & 1:
                take[i] += chunk
                best -= chunk * lengths[i]
    return take


def _plan(reach: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        total, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = int(target // total) if total else 0
        budget = int(round(target - passes * total)) if total else 0
        pdf["passes"] = passes
        pdf["extra"] = fit(pdf["size"].tolist(), pdf["n"].tolist(), budget, reach)
        return pdf[["__src", "size", "source_size", "target", "passes", "extra"]]

    return plan


def mixed(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", keep: list[str] | None = None,
          weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, reach: int = REACH) -> DataFrame:
    """docs' columns (or those of keep) with __size, __source_size, __target and __times.

    ``__times`` is how often a document is in the mix; it takes __times x __size words. A null
    or empty text has size 0 and is never taken. A null source is a source of its own, the last.
    Repeated rows count one each; rows with one id and text are interchangeable. An empty
    table gives an empty result.
    """
    n = docs.count()
    salts = max(1, n // SALT_ROWS)  # so that no salted group grows with the input
    columns = list(keep if keep is not None else docs.columns)
    hashed = F.xxhash64(F.lit(seed), F.col(key).cast("string"), F.col(text))  # the text too: one id may be on many rows
    rows = docs.withColumns({"__size": size_of(text), "__h": hashed, "__src": F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))})
    rows = rows.select(*columns, "__size", "__h", "__src", F.pmod(F.shiftrightunsigned("__h", 20), F.lit(salts)).alias("__salt"))
    cells = rows.groupBy("__src", "__size", "__salt").agg(F.count("*").alias("__n"))
    histogram = cells.groupBy("__src", "__size").agg(F.sum("__n").alias("n")).withColumnRenamed("__size", "size")
    sizes = histogram.groupBy("__src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("__src") != "n", F.substring(F.col("__src"), 2, 2147483647)))
    goal = targets(sizes, weights, share, most).drop("source")
    plan = histogram.join(goal, "__src").groupBy("__src").applyInPandas(
        _plan(reach), "__src string, size long, source_size long, target double, passes long, extra long"
    )  # a source's distinct lengths, not its documents
    before = Window.partitionBy("__src", "__size").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    cells = cells.join(plan.withColumnRenamed("size", "__size"), ["__src", "__size"])
    cells = cells.select(
        "__src", "__size", "__salt", "passes", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.least(F.greatest(F.col("extra") - F.col("__before"), F.lit(0)), F.col("__n")).alias("__from_here"),
    )
    first = Window.partitionBy("__src", "__size", "__salt").orderBy("__h", key)
    out = rows.join(cells, ["__src", "__size", "__salt"])
    once = (F.row_number().over(first) <= F.col("__from_here")).cast("long")
    times = F.when(F.col("__size") > 0, F.col("passes") + once).otherwise(F.lit(0))
    return out.withColumn("__times", times.cast("long")).select(*columns, "__size", "__source_size", "__target", "__times")

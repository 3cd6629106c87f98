"""Keyed state: reducers over a log of updates, snapshots, time travel, message lists.

A log is (thread, step, ...) rows, each a partial update; null means no update of that key. The
state of a thread is a reduction of its rows, so history, resuming and edits are all reads or
appends of the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overwritten(thread: str, step: str, value: str) -> Column:
    """Aggregate: the last value that isn't null."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(step)))


def appended(step: str, value: str) -> Column:
    """Aggregate: all updates' lists, joined in order of steps."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).alias("v"))))
    return F.flatten(F.transform(F.filter(ordered, lambda x: x["v"].isNotNull()), lambda x: x["v"]))


def current(log: DataFrame, thread: str, step: str, overwrite: list[str], append: list[str]) -> DataFrame:
    """One row a thread: its state after all steps."""
    return log.groupBy(thread).agg(F.max(step).alias(step), *[overwritten(thread, step, c).alias(c) for c in overwrite], *[appended(step, c).alias(c) for c in append])


def history(log: DataFrame, thread: str, step: str, overwrite: list[str], append: list[str]) -> DataFrame:
    """One row a step: the thread's state after it."""
    w = Window.partitionBy(thread).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    cols = [F.last(c, ignorenulls=True).over(w).alias(c) for c in overwrite] + [F.flatten(F.collect_list(c).over(w)).alias(c) for c in append]
    return log.select(thread, step, *cols)


def at(log: DataFrame, step: str, last: int, **how) -> DataFrame:
    """Time travel: the state as it was after a step."""
    return current(log.where(F.col(step) <= last), step=step, **how)


def edited(log: DataFrame, edits: DataFrame, thread: str, step: str) -> DataFrame:
    """An outside edit is one more update, after the thread's last."""
    last = log.groupBy(thread).agg((F.max(step) + 1).alias(step))
    return log.unionByName(edits.join(last, thread), allowMissingColumns=True)


def upserted(messages: DataFrame, conv: str, ident: str, order: str) -> DataFrame:
    """Messages by id: a later one replaces the earlier, in the earlier's place (``position``)."""
    w = Window.partitionBy(conv, ident)
    r = F.row_number().over(w.orderBy(F.col(order).desc()))
    return messages.withColumns({"position": F.min(order).over(w), "__r": r}).where("__r = 1").drop("__r")


def transcript(messages: DataFrame, conv: str, order: str, role: str, text: str) -> DataFrame:
    """(conv, messages): an ordered list of (turn, role, text) for each conversation."""
    m = F.array_sort(F.collect_list(F.struct(F.col(order).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))))
    return messages.groupBy(conv).agg(m.alias("messages"))


def last_message(messages: DataFrame, conv: str, order: str, text: str) -> DataFrame:
    return messages.groupBy(conv).agg(F.max(order).alias(order), F.max_by(text, order).alias(text))


def within_budget(messages: DataFrame, conv: str, order: str, tokens: Column, budget: int) -> DataFrame:
    """The newest messages of each conversation whose tokens together fit the budget."""
    w = Window.partitionBy(conv).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("used", F.sum(tokens).over(w)).where(F.col("used") <= budget)


def positive_feedback(c: Column) -> Column:
    """Whether a reviewer's answer agrees (fixed words)."""
    return c.isNotNull() & F.lower(F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")).isin("ok", "looks good", "yes", "proceed", "")

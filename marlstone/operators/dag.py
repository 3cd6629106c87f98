"""Task graphs with retries: each task reads tables of the tasks before it and writes one of its own.

A task's result is written to a fresh path in the shared folder and taken up only when the write has
ended, so a failed attempt leaves nothing that a later task could read, and a repeated run of a
task replaces nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from marlstone.session import cut


class Dag:
    def __init__(self):
        self.tasks: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...], int]] = {}

    def task(self, name: str, f: Callable[..., DataFrame], after: tuple[str, ...] = (), retries: int = 0) -> Dag:
        """f gets the results of the tasks in after, in that order."""
        if name in self.tasks:
            raise ValueError(f"task {name} exists")
        self.tasks[name] = (f, after, retries)
        return self

    def run(self, spark: SparkSession) -> tuple[dict[str, DataFrame], list[tuple[str, int, str]]]:
        """(results by task, log of (task, attempt, ok or the error's name)). The last error of a task ends the run."""
        if unknown := {a for _, after, _ in self.tasks.values() for a in after} - set(self.tasks):
            raise ValueError(f"unknown tasks {sorted(unknown)}")
        results: dict[str, DataFrame] = {}
        log: list[tuple[str, int, str]] = []
        for name in TopologicalSorter({n: after for n, (_, after, _) in self.tasks.items()}).static_order():
            f, after, retries = self.tasks[name]
            for attempt in range(1, retries + 2):
                try:
                    results[name] = cut(f(*[results[a] for a in after]), name)
                    log.append((name, attempt, "ok"))
                    break
                except Exception as e:
                    log.append((name, attempt, type(e).__name__))
                    if attempt > retries:
                        raise
        return results, log

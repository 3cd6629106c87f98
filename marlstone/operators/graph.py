"""Workflow graphs over DataFrames: nodes are functions, edges may depend on each row.

A compiled graph runs rows from START to END. A node gets the rows that are routed to it and
returns them changed; a conditional edge is a Column that names the next node of each row. Rows
may loop; each super-step runs every node that has rows, and several functions may work on the
same rows in one super-step (parallel). Rows are written to the shared folder after each
super-step, so a step runs once and plans don't grow; checkpoints() keeps those tables by step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.session import cut

START, END = "__start__", "__end__"


class Graph:
    def __init__(self, output: list[str] | None = None):
        """output: the columns that leave the graph; others are private."""
        self.nodes: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.edges: dict[str, str | Column] = {}
        self.targets: dict[str, list[str]] = {}
        self.output = output

    def node(self, name: str, f: Callable[[DataFrame], DataFrame]) -> Graph:
        if name in self.nodes or name in (START, END):
            raise ValueError(f"node {name} exists")
        self.nodes[name] = f
        return self

    def parallel(self, name: str, fs: list[Callable[[DataFrame], DataFrame]], key: str, columns: list[list[str]], reducers: dict[str, Callable[..., Column]] | None = None) -> Graph:
        """A node of several functions that all get the same rows, in one super-step.

        columns: what each function sets. A column set by more than one needs a reducer of its
        values, in the functions' order. Rows meet by key again, which has to be unique in them.
        """
        reducers, every = reducers or {}, {c for cs in columns for c in cs}
        if twice := {c for c in every if sum(c in cs for cs in columns) > 1} - set(reducers):
            raise ValueError(f"{name}: no reducer for {sorted(twice)}")

        def run(df: DataFrame) -> DataFrame:
            out = df
            for i, (f, cs) in enumerate(zip(fs, columns, strict=True)):
                out = out.join(f(df).select(key, *[F.col(c).alias(f"__{i}_{c}") for c in cs]), key)
            found = {c: [F.col(f"__{i}_{c}") for i, cs in enumerate(columns) if c in cs] for c in sorted(every)}
            out = out.withColumns({c: reducers[c](*v) if c in reducers else v[0] for c, v in found.items()})
            return out.drop(*[f"__{i}_{c}" for i, cs in enumerate(columns) for c in cs])

        return self.node(name, run)

    def edge(self, a: str, b: str) -> Graph:
        return self._edge(a, b, [b])

    def branch(self, a: str, route: Column, targets: list[str]) -> Graph:
        """route: a Column with one of targets in each row."""
        return self._edge(a, route, targets)

    def _edge(self, a, b, targets) -> Graph:
        if a in self.edges:
            raise ValueError(f"{a} has an edge")
        self.edges[a], self.targets[a] = b, targets
        return self

    def compile(self) -> Graph:
        """Checks that every node is reachable, has a way on, and that targets exist."""
        if START not in self.edges:
            raise ValueError("no edge from START")
        for a, ts in self.targets.items():
            for t in ts:
                if t != END and t not in self.nodes:
                    raise ValueError(f"{a} leads to unknown {t}")
            if a != START and a not in self.nodes:
                raise ValueError(f"edge from unknown {a}")
        seen, todo = set(), [START]
        while todo:
            for t in self.targets.get(todo.pop(), []):
                if t not in seen and t != END:
                    seen.add(t)
                    todo.append(t)
        if orphans := set(self.nodes) - seen:
            raise ValueError(f"unreachable: {sorted(orphans)}")
        if ends := [n for n in self.nodes if n not in self.edges]:
            raise ValueError(f"no edge from {ends}")
        return self

    def _routed(self, rows: DataFrame, a: str) -> DataFrame:
        to = self.edges[a]
        named = F.lit(to) if isinstance(to, str) else to
        bad = F.raise_error(F.concat(F.lit(f"{a} routes to "), F.coalesce(named, F.lit("null")))).cast("string")
        return rows.withColumn("__at", F.when(named.isin(self.targets[a]), named).otherwise(bad))

    def steps(self, rows: DataFrame, most: int = 25, before: set[str] | None = None):
        """Yields (step, rows) after each super-step; rows carry ``__at``, the node they wait for.

        before: nodes at which rows stop until they are passed to resume().
        """
        rows = cut(self._routed(rows, START), "step")
        for step in range(most):
            yield step, rows
            waiting = rows.where(F.col("__at") != END)
            if before:
                waiting = waiting.where(~F.col("__at").isin(sorted(before)))
            names = {r[0] for r in waiting.select("__at").distinct().collect()}  # at most as many as nodes
            if not names:
                return
            rows = self._advance(rows, names)
        raise RecursionError(f"not finished after {most} steps")

    def _advance(self, rows: DataFrame, names: set[str]) -> DataFrame:
        out = rows.where(~F.col("__at").isin(sorted(names)))
        for n in sorted(names):
            done = self._routed(self.nodes[n](rows.where(F.col("__at") == n).drop("__at")), n)
            out = out.unionByName(done, allowMissingColumns=True)
        return cut(out, "step")

    def checkpoints(self, rows: DataFrame, most: int = 25, before: set[str] | None = None) -> DataFrame:
        """The rows after every super-step, with ``step`` and ``__at``: each thread's states in order."""
        out = None
        for step, now in self.steps(rows, most, before):
            now = now.withColumn("step", F.lit(step))
            out = now if out is None else out.unionByName(now, allowMissingColumns=True)
        return out

    def invoke(self, rows: DataFrame, most: int = 25) -> DataFrame:
        last = rows
        for _, last in self.steps(rows, most):
            pass
        return last.select(*self.output) if self.output else last.drop("__at")

    def resume(self, rows: DataFrame, most: int = 25) -> DataFrame:
        """Go on with rows that stopped (they carry __at), possibly edited."""
        for _ in range(most):
            names = {r[0] for r in rows.where(F.col("__at") != END).select("__at").distinct().collect()}
            if not names:
                return rows.select(*self.output) if self.output else rows.drop("__at")
            rows = self._advance(rows, names)
        raise RecursionError(f"not finished after {most} steps")

"""Named functions: typed Python functions as tools, dispatch by name, hooks around operators."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_RESULT = "Operation completed without results"  # fixed text
_KINDS = {int: ("bigint", "integer"), float: ("double", "number"), str: ("string", "string"), bool: ("boolean", "boolean")}


def _null_safe(f: Callable) -> Callable:
    def run(*args):
        return None if any(a is None for a in args) else f(*args)

    return run


@dataclass
class Registry:
    """Tools by name. A tool is a Python function whose parameters and result are int, float, str or bool."""

    tools: dict[str, Callable] = field(default_factory=dict)

    def tool(self, f: Callable) -> Callable:
        sig = inspect.signature(f, eval_str=True)
        kinds = [p.annotation for p in sig.parameters.values()] + [sig.return_annotation]
        if any(k not in _KINDS for k in kinds):
            raise TypeError(f"{f.__name__}: parameters and result need one of int, float, str, bool")
        self.tools[f.__name__] = f
        return f

    def schema(self, name: str) -> dict:
        f = self.tools[name]
        params = inspect.signature(f, eval_str=True).parameters
        return {
            "name": name, "description": inspect.getdoc(f) or "",
            "parameters": {"type": "object", "properties": {k: {"type": _KINDS[p.annotation][1]} for k, p in params.items()}, "required": [k for k, p in params.items() if p.default is p.empty]},
        }

    def register(self, spark: SparkSession) -> None:
        """All tools as SQL functions (Arrow-batched)."""
        for name, f in self.tools.items():
            kind = _KINDS[inspect.signature(f, eval_str=True).return_annotation][0]
            spark.udf.register(name, F.udf(_null_safe(f), kind, useArrow=True))

    def call(self, name: str, arguments: dict):
        if name not in self.tools:
            raise KeyError(f"unknown tool {name}")
        return normalised(self.tools[name](**arguments))


    def dispatched(self, spark: SparkSession, name: Column, arguments: Column) -> Column:
        """Calls as data: the tool named in each row on its JSON arguments; the result as text.

        Null for a null name; a message for an unknown tool and for arguments that don't fit.
        """
        self.register(spark)
        out = F.when(name.isNotNull(), F.concat(F.lit("unknown tool "), name))
        for tool, f in self.tools.items():
            params = inspect.signature(f, eval_str=True).parameters
            schema = ", ".join(f"{k} {_KINDS[p.annotation][0]}" for k, p in params.items())
            given = F.from_json(F.when(name == tool, arguments), schema or "none string")
            args = [given[k] for k in params]
            fits = given.isNotNull()
            for a in args:
                fits = fits & a.isNotNull()
            # other rows' calls get null arguments
            answer = F.coalesce(F.call_function(tool, *args).cast("string"), F.lit(NO_RESULT))
            out = F.when(name == tool, F.when(fits, answer).otherwise(F.lit(f"arguments don't fit {tool}"))).otherwise(out)
        return out


def normalised(result) -> str:
    """A tool's result as text: None, lists, records, others."""
    import json

    if result is None:
        return NO_RESULT
    if isinstance(result, list):
        return ", ".join(map(str, result))
    if isinstance(result, dict):
        return json.dumps(result, indent=2)
    return str(result)


def dispatched(name: Column, a: Column, b: Column) -> Column:
    """The arithmetic tools by name, in the JVM: add, multiply, divide (by zero: null), double."""
    return (
        F.when(name == "add", (a + b).cast("double")).when(name == "multiply", (a * b).cast("double"))
        .when(name == "divide", F.try_divide(a.cast("double"), b.cast("double"))).when(name == "double", (a * 2).cast("double"))
    )


@dataclass
class Context:
    """Settings passed to operators instead of read from the surroundings."""

    year: int
    values: dict = field(default_factory=dict)


@dataclass
class Hooks:
    """Counts and times the operators it wraps."""

    events: list[tuple[str, str, float]] = field(default_factory=list)

    def around(self, name: str, f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(*a, **b):
            self.events.append((name, "start", time.time()))
            out = f(*a, **b)
            self.events.append((name, "end", time.time()))
            return out

        return run

"""All queries of the library by name, each with the SQL that checks it where SQL can."""

from __future__ import annotations

import importlib

MODULES = ["marlstone.plans.ppi", "marlstone.plans.models", "marlstone.plans.text", "marlstone.plans.control", "marlstone.plans.records"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _gather() -> None:
    for name in MODULES:
        module = importlib.import_module(name)
        QUERIES.update(module.QUERIES)
        ORACLES.update(module.ORACLES)


_gather()

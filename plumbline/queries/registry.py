"""All registered queries and their oracle SQL. The subpackage ``llm`` is not imported here; the driver entry adds it if it is there."""

from __future__ import annotations

import importlib

_MODULES = ("references", "catalog", "checks", "corpus")


def collect() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in _MODULES:
        m = importlib.import_module(f"plumbline.queries.{name}")
        queries.update(m.QUERIES)
        oracle.update(m.ORACLE)
    return queries, oracle

"""Queries and oracle SQL of the subpackage."""

from __future__ import annotations

import importlib

_MODULES = ("splits", "copies", "sampling", "overlap", "sentences", "encoding", "packing", "subjects")


def collect() -> tuple[dict, dict]:
    queries, oracle = {}, {}
    for name in _MODULES:
        m = importlib.import_module(f"plumbline.llm.{name}")
        queries.update(m.QUERIES)
        oracle.update(m.ORACLE)
    return queries, oracle

"""Changes to model SQL for benchmarks: a family, its intent, and the changed text."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from plumbline.session import ship


def _drop_output(sql: str) -> str | None:
    m = re.search(r"(?is)\bselect\b(.*?)\bfrom\b", sql)
    parts = [p for p in (m.group(1).split(",") if m else [])]
    if len(parts) < 2 or "(" in parts[-1]:
        return None
    return sql[: m.start(1)] + ",".join(parts[:-1]) + "\n" + sql[m.end(1) :]


def _sub(pattern: str, replacement: str):
    return lambda sql: new if (new := re.sub(pattern, replacement, sql, count=1)) != sql else None


#: family -> (intent, change); a change that does not apply gives None.
FAMILIES = {
    "drop_column": ("harmful", _drop_output),
    "rename_column": ("harmful", _sub(r"(?i)\bas\s+(\w+)", r"as \1_renamed")),
    "flip_comparison": ("harmful", _sub(r"(?<![<>!])>(?!=)", "<")),
    "loosen_join": ("harmful", _sub(r"(?i)\binner\s+join\b|(?<!left )(?<!right )(?<!full )(?<!cross )\bjoin\b", "left join")),
    "drop_where": ("harmful", _sub(r"(?is)\bwhere\b.*?(?=\bgroup\b|\border\b|\Z)", "")),
    "drop_distinct": ("harmful", _sub(r"(?i)\bdistinct\s+", "")),
    "change_aggregate": ("harmful", _sub(r"(?i)\bsum\s*\(", "max(")),
    "change_literal": ("harmful", lambda s: re.sub(r"\b(\d+)\b", lambda m: str(int(m.group(1)) + 1), s, count=1) if re.search(r"\b\d+\b", s) else None),
    "unknown_reference": ("harmful", _sub(r"(?i)\bselect\s+", "select no_such_column, ")),
    "comment": ("benign", lambda s: "-- reviewed\n" + s),
    "blank_lines": ("benign", lambda s: s.replace("\n", "\n\n", 1) if "\n" in s else s + "\n"),
    "upper_keywords": ("benign", lambda s: re.sub(r"\b(select|from|where|group by|order by|join|on|as)\b", lambda m: m.group(1).upper(), s)),
    "trailing_semicolon": ("benign", lambda s: s.rstrip() + ";"),
    "indent": ("benign", lambda s: "\n".join("  " + x for x in s.split("\n"))),
    "parentheses": ("benign", _sub(r"(?i)\bwhere\s+(.+)$", r"where (\1)")),
}


def mutate(sql: str) -> Iterator[tuple[str, str, str]]:
    """(family, intent, changed text) of every family that applies."""
    for family, (intent, change) in FAMILIES.items():
        new = change(sql)
        if new is not None and new != sql:
            yield family, intent, new


def diff(old: str, new: str, path: str = "model.sql") -> str:
    return "".join(difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{path}", f"b/{path}"))


def mutants(models: DataFrame) -> DataFrame:
    """models(path, sql) -> (path, family, intent, mutated, diff)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, f, i, new, diff(s, new, p)) for p, s in zip(b["path"], b["sql"]) for f, i, new in mutate(s)]
            yield pd.DataFrame(rows, columns=["path", "family", "intent", "mutated", "diff"])

    ship(models.sparkSession)
    return models.select("path", "sql").mapInPandas(run, "path string, family string, intent string, mutated string, diff string")

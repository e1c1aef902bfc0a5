"""Pairs of prose and constraint from files: one miner per format, text in, pairs out; run in bulk by ``mine``."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import yaml
from pyspark.sql import DataFrame

from plumbline.session import ship

PAIR = "path string, sentence string, table_name string, column_name string, claim_type string, problem string"


def schema_yml(text: str) -> Iterator[tuple]:
    """Model documentation: descriptions with the tests declared beside them."""
    doc = yaml.safe_load(text) or {}
    for m in doc.get("models") or []:
        for c in m.get("columns") or []:
            for t in c.get("tests") or [None]:
                name = t if isinstance(t, str) or t is None else next(iter(t), None)
                if c.get("description"):
                    yield c["description"], m.get("name"), c.get("name"), name


def sql_ddl(text: str) -> Iterator[tuple]:
    """Column comments with the constraint in the column's definition."""
    for t in re.finditer(r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)[\"`]?\s*\((.*?)\)\s*;", text):
        for line in t.group(2).split("\n"):
            m = re.match(r"\s*[\"`]?(\w+)[\"`]?\s+[^-]*?(not null|unique|primary key|references|check)?[^-]*--\s*(.+)$", line, re.I)
            if m:
                kinds = {"not null": "not_null", "primary key": "unique", "unique": "unique", "references": "relationships", "check": "expression"}
                yield m.group(3).strip(), t.group(1), m.group(1), kinds.get((m.group(2) or "").lower())


def json_schema(text: str) -> Iterator[tuple]:
    """Descriptions of properties with what the schema says of them."""

    def walk(node: dict, name: str) -> Iterator[tuple]:
        required = set(node.get("required") or [])
        for k, v in (node.get("properties") or {}).items():
            if isinstance(v, dict):
                kind = "accepted_values" if "enum" in v else "expression" if {"minimum", "maximum"} & v.keys() else "not_null" if k in required else None
                if v.get("description"):
                    yield v["description"], name, k, kind
                yield from walk(v, k)

    yield from walk(json.loads(text), "root")


def expectations(text: str) -> Iterator[tuple]:
    """Expectation suites: the note of an expectation and its type."""
    kinds = {"expect_column_values_to_be_unique": "unique", "expect_column_values_to_not_be_null": "not_null", "expect_column_values_to_be_in_set": "accepted_values", "expect_column_values_to_be_between": "expression"}
    for e in json.loads(text).get("expectations") or []:
        note = (e.get("meta") or {}).get("notes")
        if isinstance(note, str):
            yield note, None, (e.get("kwargs") or {}).get("column"), kinds.get(e.get("expectation_type"))


def error_messages(text: str) -> Iterator[tuple]:
    """Messages of raised errors that state a rule of a name."""
    for m in re.finditer(r"raise\s+\w+\(\s*f?[\"'](.{8,200}?)[\"']\s*\)", text):
        name = re.search(r"\b([a-z]+_[a-z_]+)\b", m.group(1))
        kind = "not_null" if re.search(r"\brequired\b|must not be (?:null|empty)", m.group(1)) else "accepted_values" if re.search(r"\bone of\b", m.group(1)) else None
        yield m.group(1), None, name and name.group(1), kind


def code_choices(text: str) -> Iterator[tuple]:
    """Literal types and choices with the comment above them."""
    for m in re.finditer(r"#\s*(.{8,200})\n\s*(\w+)\s*(?::\s*Literal\[|=.*choices=)", text):
        yield m.group(1), None, m.group(2), "accepted_values"


MINERS = {".yml": schema_yml, ".yaml": schema_yml, ".sql": sql_ddl, ".json": json_schema, ".suite": expectations, ".py": error_messages, ".choices": code_choices}


def mine(files: DataFrame) -> DataFrame:
    """files(path, text) -> pairs; a file that cannot be read gives one row with its problem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"]):
                miner = MINERS.get(re.search(r"(\.\w+)?$", path).group(0))
                try:
                    rows += [(path, *r, None) for r in (miner(text) if miner else ())]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, None, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "sentence", "table_name", "column_name", "claim_type", "problem"])

    ship(files.sparkSession)
    return files.select("path", "text").mapInPandas(run, PAIR)

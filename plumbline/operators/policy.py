"""A rule table over evidence, folded to one verdict. Rules are compiled to columns; evidence is scanned once, whatever their number."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import message

OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "contains", "empty", "not_empty")
SEVERITIES = ("info", "warn", "block")
DEFAULT = Path(__file__).parent.parent / "plans" / "rules.yaml"


class PolicyError(ValueError):
    pass


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    severity: str
    message: str = "{subject}"
    reason_code: str | None = None
    where: tuple[Condition, ...] = ()
    where_any: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Policy:
    rules: tuple[Rule, ...]
    unhandled: str = "block"
    settings: dict = field(default_factory=dict)


def _condition(raw: dict, settings: dict) -> Condition:
    if raw.get("op") not in OPS:
        raise PolicyError(f"unknown operator: {raw}")
    path = raw.get("field", "")
    if not (path in ("subject", "links") or path.startswith("detail.")) or any(not p for p in path.split(".")):
        raise PolicyError(f"not a field: {raw}")
    value = raw.get("value")
    if isinstance(value, str) and value.startswith("$settings."):
        name = value.removeprefix("$settings.")
        if name not in settings:
            raise PolicyError(f"unknown setting: {name}")
        value = settings[name]
    return Condition(path, raw["op"], value)


def load(source: str | Path = DEFAULT) -> Policy:
    """Rules from YAML text or a file, checked when they are loaded."""
    raw = yaml.safe_load(Path(source).read_text() if isinstance(source, Path) else source)
    if not isinstance(raw, dict) or raw.get("version") != 1 or raw.get("unhandled_evidence") not in ("block", "info"):
        raise PolicyError("not a rule file of version 1")
    settings, rules, seen = raw.get("settings") or {}, [], set()
    for r in raw.get("rules") or []:
        if r.get("severity") not in SEVERITIES or not r.get("kind") or not r.get("id") or r["id"] in seen:
            raise PolicyError(f"bad rule: {r}")
        seen.add(r["id"])
        of = {k: tuple(_condition(c, settings) for c in r.get(k) or ()) for k in ("where", "where_any")}
        rules.append(Rule(r["id"], r["kind"], r["severity"], r.get("message", "{subject}"), r.get("reason_code"), **of))
    return Policy(tuple(rules), raw["unhandled_evidence"], settings)


def _at(path: str) -> Column:
    return F.col(path) if path in ("subject", "links") else F.get_json_object("detail", "$." + path.removeprefix("detail."))


def matches(c: Condition) -> tuple[Column, Column]:
    """(does it hold, is it a type error). A missing field holds for none of the valued operators, not even ``ne``."""
    v, x = c.value, _at(c.field)
    no = F.lit(False)
    if c.op in ("empty", "not_empty"):
        blank = x.isNull() | x.isin("", "[]", "{}")
        return (blank if c.op == "empty" else ~blank), no
    if c.op in ("gt", "gte", "lt", "lte"):
        n = F.expr(f"try_cast(get_json_object(detail, '$.{c.field.removeprefix('detail.')}') as double)") if c.field.startswith("detail.") else x.try_cast("double")
        test = {"gt": n > v, "gte": n >= v, "lt": n < v, "lte": n <= v}[c.op]
        return F.coalesce(test, no), x.isNotNull() & n.isNull()
    if c.op == "in":
        return F.coalesce(x.isin(*(str(i) for i in v)), no), no
    if c.op == "contains":
        members = F.from_json(x, "array<string>")
        return F.coalesce(F.when(x.startswith("["), F.array_contains(members, str(v))).otherwise(F.contains(x, F.lit(str(v)))), no), no
    text = str(v).lower() if isinstance(v, bool) else str(v)
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    same = (x.try_cast("double") == float(v)) if number else (x == text)
    same = F.coalesce(same, no)
    return (same if c.op == "eq" else x.isNotNull() & ~same), no


def _all(cs: tuple[Condition, ...], join) -> Column | None:
    out = None
    for c in cs:
        held, _ = matches(c)
        out = held if out is None else join(out, held)
    return out


def rule_match(r: Rule) -> tuple[Column, Column]:
    """(the rule applies, a type error came up while matching it)."""
    of_kind = F.col("kind") == r.kind
    held, wrong = of_kind, F.lit(False)
    if r.where:
        held = held & _all(r.where, lambda a, b: a & b)
    if r.where_any:
        held = held & _all(r.where_any, lambda a, b: a | b)
    for c in (*r.where, *r.where_any):
        wrong = wrong | matches(c)[1]
    return held, of_kind & wrong


def findings(evidence: DataFrame, policy: Policy) -> DataFrame:
    """evidence(ord, kind, subject, detail) -> (ord, rule_ord, rule_id, severity, reason_code, message, kind, subject).

    Every rule that applies gives a finding; evidence of a known kind that no rule takes is information; of an unknown kind it is what
    the policy says. A type error blocks, and the evidence's later rules are not looked at.
    """
    kinds = sorted({r.kind for r in policy.rules})
    hits = F.array().cast("array<struct<n:int,wrong:boolean>>")
    for kind in kinds:  # a row only looks at the rules of its kind
        tests = []
        for i, r in enumerate(policy.rules):
            if r.kind == kind:
                held, wrong = rule_match(r)
                tests.append(F.when(wrong | held, F.struct(F.lit(i).alias("n"), wrong.alias("wrong"))))
        hits = F.when(F.col("kind") == kind, F.filter(F.array(*tests), lambda x: x.isNotNull())).otherwise(hits)
    # up to and with the first type error
    first_wrong = F.array_min(F.transform(F.filter("_h", lambda x: x["wrong"]), lambda x: x["n"]))
    kept = F.filter("_h", lambda x: first_wrong.isNull() | (x["n"] <= first_wrong))
    n = len(policy.rules)
    none = F.array(F.struct(F.lit(n).alias("n"), F.lit(False).alias("wrong")))
    each = evidence.withColumn("_h", hits).withColumn("_f", kept).withColumn("_f", F.explode(F.when(F.size("_f") > 0, F.col("_f")).otherwise(none)))
    texts = F.lit(None).cast("string")
    for i, r in enumerate(policy.rules):
        places = {"subject": F.col("subject"), "kind": F.col("kind")} | {f"detail_{k}": F.get_json_object("detail", f"$.{k}") for k in _places(r.message)}
        texts = F.when(F.col("_f.n") == i, message(r.message.replace("{detail.", "{detail_"), places)).otherwise(texts)
    pick = lambda values: F.element_at(F.array(*(F.lit(v).cast("string") for v in [*values, None])), F.col("_f.n") + 1)
    wrong, rest, known = F.col("_f.wrong"), F.col("_f.n") == n, F.col("kind").isin(*kinds)
    return each.select(
        "ord", F.col("_f.n").alias("rule_ord"),
        F.when(wrong, "policy_evaluation_failed").when(rest & known, "informational").when(rest, "unhandled_evidence").otherwise(pick([r.id for r in policy.rules])).alias("rule_id"),
        F.when(wrong, "block").when(rest & known, "info").when(rest, policy.unhandled).otherwise(pick([r.severity for r in policy.rules])).alias("severity"),
        F.when(~wrong & ~rest, pick([r.reason_code for r in policy.rules])).alias("reason_code"),
        F.when(wrong, "a rule could not be evaluated").when(rest, F.col("subject")).otherwise(texts).alias("message"), "kind", "subject",
    )


def _places(template: str) -> list[str]:
    import re

    return re.findall(r"\{detail\.(\w+)\}", template)


def verdict(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (or one per group): BLOCK, WARN or PASS; the reason is that of the first blocking finding that has one."""
    rank = F.when(F.col("severity") == "block", 2).when(F.col("severity") == "warn", 1).otherwise(0)
    reason = F.min(F.when((F.col("severity") == "block") & F.col("reason_code").isNotNull(), F.struct("ord", "rule_ord", "reason_code")))
    out = found.groupBy(*(by or [])).agg(F.coalesce(F.max(rank), F.lit(0)).alias("_r"), reason.alias("_c"), F.count("*").alias("n_findings"))
    return out.select(*(by or []), F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("BLOCK")), F.col("_r") + 1).alias("decision"), F.col("_c.reason_code").alias("reason_code"), "n_findings")


def combine(verdicts: DataFrame, order: str) -> DataFrame:
    """One verdict of several: the worst decision, and the reason of the first that blocks and has one."""
    rank = F.when(F.col("decision") == "BLOCK", 2).when(F.col("decision") == "WARN", 1).otherwise(0)
    code = F.min(F.when((F.col("decision") == "BLOCK") & F.col("reason_code").isNotNull(), F.struct(order, "reason_code")))
    return verdicts.agg(F.max(rank).alias("_r"), code.alias("_c"), F.count("*").alias("n")).select(F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("BLOCK")), F.col("_r") + 1).alias("decision"), F.col("_c.reason_code").alias("reason_code"), "n")

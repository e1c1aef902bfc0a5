"""What a SQL text reads and makes, from Catalyst's own parser and analyser.

The catalog's schemas become empty relations; the text is analysed against them, and the analysed plan is walked from its output down to
the leaves. Attributes carry ids, so aliases, subqueries, common table expressions, stars and unions need no special care. The accessors
of plan nodes are internal to Spark and are only used here; what cannot be walked is unverifiable, not guessed.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


#: What stands after a table's name where it is given another name.
_ALIAS = r"\s+(?:as\s+)?(?!(?:where|join|on|using|group|order|inner|left|right|full|cross|natural|union|intersect|except|limit|having|window|lateral|sort|cluster|distribute)\b)[a-z_]\w*"


@dataclass
class SqlScan:
    outputs: list[str] = field(default_factory=list)
    lineage: set[tuple[str, str, str]] = field(default_factory=set)  # (source table, source column, output column)
    problem: str | None = None


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _ids(expression) -> set[int]:
    found = {expression.exprId().id()} if _name(expression) == "AttributeReference" else set()
    for c in _seq(expression.children()):
        found |= _ids(c)
    return found


def _walk_plan(plan, sources: dict[int, set], marks: dict[int, set]) -> None:
    """Bottom up: attribute id -> leaf columns it is made from."""
    for c in _seq(plan.children()):
        _walk_plan(c, sources, marks)
    kind = _name(plan)
    if kind == "WithCTE":
        for c in _seq(plan.cteDefs()):
            _walk_plan(c, sources, marks)
        _walk_plan(plan.plan(), sources, marks)
        return
    if kind == "CTERelationDef":
        marks[plan.id()] = [a.exprId().id() for a in _seq(plan.child().output())]
    elif kind == "CTERelationRef":
        for a, i in zip(_seq(plan.output()), marks.get(plan.cteId(), [])):
            sources[a.exprId().id()] = set(sources.get(i, set()))
    elif kind == "SubqueryAlias":
        name = plan.alias()
        child = plan.child()
        while _name(child) in ("View", "Project", "SubqueryAlias") and _seq(child.children()):
            child = child.child()
        if _name(child) in ("LocalRelation", "LogicalRDD") and name.startswith("src"):
            for a in _seq(plan.output()):
                sources[a.exprId().id()] = {(name, a.name().lower())}
    elif kind in ("Project", "Aggregate", "Window", "Generate", "Expand"):
        lists = [plan.projectList()] if kind == "Project" else [plan.aggregateExpressions()] if kind == "Aggregate" else [plan.windowExpressions()] if kind == "Window" else []
        for e in (x for s in lists for x in _seq(s)):
            made = set()
            for i in _ids(e):
                made |= sources.get(i, set())
            if e.exprId().id() not in sources or _name(e) == "Alias":
                sources[e.exprId().id()] = made
    elif kind == "Union":
        inputs = [[a.exprId().id() for a in _seq(c.output())] for c in _seq(plan.children())]
        for k, a in enumerate(_seq(plan.output())):
            sources[a.exprId().id()] = set().union(*(sources.get(i[k], set()) for i in inputs))


def scan(spark: SparkSession, sql: str, schemas: dict[str, list[str]], strict: bool = False) -> SqlScan:
    """sql over tables with the given columns -> its outputs and column lineage.

    ``strict`` abstains where text-level readers do: stars, set operations and templates.
    """
    if re.search(r"\{\{|\{%", re.sub(r"\{\{\s*ref\('([^']+)'\)\s*\}\}", r"\1", sql)):
        return SqlScan(problem="template syntax")
    text = re.sub(r"\{\{\s*ref\('([^']+)'\)\s*\}\}", r"\1", sql)
    if strict and re.search(r"(?i)\bunion\b|\bintersect\b|\bexcept\b", text):
        return SqlScan(problem="set operation")
    if strict and re.search(r"(?i)select\s+(?:\w+\.)?\*", text):
        return SqlScan(problem="star")
    tag, views = uuid.uuid4().hex[:8], {}
    try:
        for i, (t, cols) in enumerate(schemas.items()):
            views[t] = f"src{i}_{tag}"
            spark.createDataFrame([], ", ".join(f"`{c}` string" for c in cols)).createOrReplaceTempView(views[t])
        for t in sorted(views, key=len, reverse=True):
            text = re.sub(rf"(?i)\b(from|join)\s+{re.escape(t)}\b(?![.\w])({_ALIAS})?", lambda m, t=t: f"{m.group(1)} {views[t]}{m.group(2) or ' ' + t.rpartition('.')[2] + ' '}", text)
        # empty relations of strings: arithmetic on them must analyse, so the check of types is left to casts
        plan = spark.sql(text)._jdf.queryExecution().analyzed()
    except Exception as e:  # noqa: BLE001
        return SqlScan(problem=type(e).__name__)
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)
    back = {v: t for t, v in views.items()}
    out, sources = SqlScan(), {}
    try:
        _walk_plan(plan, sources, {})
        for a in _seq(plan.output()):
            out.outputs.append(a.name())
            out.lineage |= {(back.get(t, t), c, a.name().lower()) for t, c in sources.get(a.exprId().id(), set())}
    except Exception as e:  # noqa: BLE001
        return SqlScan(problem=f"plan: {type(e).__name__}")
    return out


def references(spark: SparkSession, sql: str) -> list[str]:
    """Names of the tables that a text reads, without those it defines itself."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    found, own = set(), set()

    def walk(p) -> None:
        if _name(p) == "UnresolvedRelation":
            found.add(".".join(_seq(p.multipartIdentifier())))
        if _name(p) == "UnresolvedWith":
            for c in _seq(p.cteRelations()):
                own.add(c._1())
                walk(c._2())
        for c in _seq(p.children()):
            walk(c)

    walk(plan)
    return sorted(found - own)

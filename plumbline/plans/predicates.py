"""Predicates of constraints, compared by Catalyst instead of by text.

Two predicates are equal on tier T1 if their analysed filters have the same result, on T2 if the optimised ones have. All columns are
nullable strings, longs or doubles of a scratch relation, so no fact of a table's schema takes part.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import SparkSession

#: Nodes that an expression claim may be made of; anything else is refused.
ALLOWED = frozenset(
    "UnresolvedAttribute Literal And Or Not EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual IsNull IsNotNull In Add Subtract Multiply Divide UnaryMinus UnaryPositive Between Cast".split()
)


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def to_spark(text: str) -> str | None:
    """PostgreSQL predicate text in Spark's grammar; None if a construct has no safe translation."""
    t = text.strip()
    m = re.fullmatch(r"(?is)check\s*\((.*)\)", t)
    if m:
        t = m.group(1)
    t = re.sub(r"(?i)::\s*(?:character varying|double precision|timestamp(?:\s+with(?:out)?\s+time\s+zone)?|[a-z_]\w*)(?:\s*\([\d, ]+\))?(?:\[\])?", "", t)
    t = re.sub(r"(?is)\(\s*(array\s*\[[^\]]*\])\s*\)", r"(\1)", re.sub(r"(?is)\(\s*\(\s*(array\s*\[[^\]]*\])\s*\)\s*\)", r"(\1)", t))
    t = re.sub(r"(?is)=\s*any\s*\(array\s*\[([^\]]*)\]\)", r"IN (\1)", t)
    t = re.sub(r"(?is)<>\s*all\s*\(array\s*\[([^\]]*)\]\)", r"NOT IN (\1)", t)
    t = re.sub(r"(?<![!~])~\*?\s*('(?:[^']|'')*')", r"RLIKE \1", t)
    t = t.replace('"', "`")
    return None if re.search(r"\[|\]|~|@|::|\bany\b|\ball\b", re.sub(r"'(?:[^']|'')*'", "''", t), re.I) else t


def _nodes(plan) -> list[str]:
    name = plan.getClass().getSimpleName()
    out, children = [name], plan.children()
    for i in range(children.size()):
        out += _nodes(children.apply(i))
    return out


def parse(text: str):
    """Catalyst expression, or None."""
    t = to_spark(text)
    if not t:
        return None
    try:
        return _session()._jsparkSession.sessionState().sqlParser().parseExpression(t)
    except Exception:  # noqa: BLE001
        return None


def allowed_expression(text: str) -> bool:
    """Comparisons, logic, null tests, literal lists and arithmetic only."""
    e = parse(text)
    return e is not None and all(n in ALLOWED or n in ("UnresolvedFunction",) and _operator_function(e) for n in _nodes(e))


def _operator_function(e) -> bool:
    """Arithmetic and BETWEEN arrive as functions in some versions; only their names are let through."""
    text = e.toString()
    return not re.search(r"'(?!between\b|[-+*/])[a-z_]\w*\(", text)


def _walk(e):
    yield e
    children = e.children()
    for i in range(children.size()):
        yield from _walk(children.apply(i))


def columns_of(text: str) -> list[str]:
    e = parse(text)
    if e is None:
        return []
    return sorted({n.name().strip("`").lower() for n in _walk(e) if n.getClass().getSimpleName() == "UnresolvedAttribute"})


def _literals(text: str) -> list:
    """Numbers and strings of a predicate; a sign is taken both ways."""
    e = parse(text)
    out = []
    for n in _walk(e) if e is not None else ():
        if n.getClass().getSimpleName() == "Literal" and n.value() is not None:
            v = n.value()
            try:
                out += [float(str(v)), -float(str(v))]
            except ValueError:
                out.append(str(v))
    return out


def _same_on_all_values(left: str, right: str, column: str) -> bool:
    """Exact for predicates of one column made of comparisons with literals: they can only differ at a literal, between two, or beyond."""
    plain = {"And", "Or", "Not", "EqualTo", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "In", "IsNull", "IsNotNull", "UnresolvedAttribute", "Literal", "UnaryMinus", "UnresolvedFunction", "Between"}
    for t in (left, right):
        e = parse(t)
        if not set(_nodes(e)) <= plain or not _operator_function(e):
            return False
    values = _literals(left) + _literals(right)
    numbers = sorted({v for v in values if isinstance(v, float)})
    words = sorted({v for v in values if isinstance(v, str)})
    if words and (numbers or any("Than" in n or n == "Between" for t in (left, right) for n in _nodes(parse(t)))):
        return False
    if words:
        points, kind = [*words, "".join(words) + "?", None], "string"
    else:
        points, kind = [*numbers, *((x + y) / 2 for x, y in zip(numbers, numbers[1:])), *([numbers[0] - 1, numbers[-1] + 1] if numbers else [0.0]), None], "double"
    df = _session().createDataFrame([(v,) for v in points], f"`{column}` {kind}")
    return df.where(f"not (({to_spark(left)}) <=> ({to_spark(right)}))").isEmpty()


def tier(left: str, right: str) -> str:
    """T0 same text but for blanks and case, T1 same analysed filter, T2 same optimised filter or same truth on all values, '' if none of them shows it."""
    squash = lambda s: re.sub(r"\s+", "", s).lower()
    if squash(left) == squash(right):
        return "T0"
    a, b = columns_of(left), columns_of(right)
    if not a or a != b:
        return ""
    numeric = any(isinstance(v, float) for v in _literals(left) + _literals(right))
    spark = _session()
    try:
        # a relation with unknown rows: an empty one would be folded away
        base = spark.createDataFrame(spark.sparkContext.parallelize([tuple(None for _ in a)], 1), ", ".join(f"`{c}` {'double' if numeric else 'string'}" for c in a))
        p, q = (base.where(to_spark(t))._jdf.queryExecution() for t in (left, right))
        if p.analyzed().sameResult(q.analyzed()):
            return "T1"
        if p.optimizedPlan().sameResult(q.optimizedPlan()):
            return "T2"
        return "T2" if len(a) == 1 and _same_on_all_values(left, right, a[0]) else ""
    except Exception:  # noqa: BLE001  what cannot be compared is undetermined
        return ""


def fingerprint(kind: str, text: str) -> str:
    return f"{kind}:{hashlib.sha256(re.sub(r'\s+', ' ', text.strip().lower()).encode()).hexdigest()[:16]}"


def shape(kind: str, text: str) -> str:
    """Family of a constraint: not_null, unique, foreign_key, nullable_guard, accepted_values, conditional, range, pattern, cross_column, function, comparison, or '' if it fits none."""
    kind = kind.lower()
    if kind in ("not_null", "foreign_key"):
        return kind
    if kind in ("unique", "primary_key"):
        return "unique"
    e = parse(text)
    if e is None:
        return ""
    root, nodes = e.getClass().getSimpleName(), _nodes(e)
    cols = len(columns_of(text))
    if root == "IsNotNull" and cols == 1:
        return "not_null"
    if root == "Or":
        if "IsNull" in nodes and cols == 1:
            return "nullable_guard"
        return "accepted_values" if cols == 1 and set(nodes) <= {"Or", "EqualTo", "UnresolvedAttribute", "Literal"} else "conditional"
    if root == "In" and cols == 1:
        return "accepted_values"
    if root == "And" and cols == 1 and set(nodes) <= {"And", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "UnresolvedAttribute", "Literal", "UnaryMinus", "UnresolvedFunction"}:
        return "range"
    if "RLike" in nodes or "Like" in nodes or "LikeAll" in nodes:
        return "pattern"
    if "between" in e.toString().lower() and cols == 1:
        return "range"
    if cols > 1:
        return "cross_column"
    if "UnresolvedFunction" in nodes:
        return "function"
    return "comparison" if root in ("EqualTo", "Not", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual") and cols == 1 else ""

"""Prose: references to columns, claims in sentences, cleaning. All as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _phrases(*wordings: str) -> str:
    """A pattern for any of the wordings as whole words, with blanks of any width."""
    return r"\b(?:" + "|".join(r"\s+".join(w.split()) for w in wordings) + r")\b"


#: Wordings that are taken as claims, on the lower-case sentence; ``claim_type`` says in which order.
DENIED = _phrases("not unique", "never unique", "may be unique")
ALONE = ("unique", "primary key")
UNIQUE = _phrases("is unique", "must be unique", "is primary key", "the primary key")
PRESENT = _phrases("not null", "never null", "never be null", "must not be null")
ROW_PER = _phrases("one row per") + r"\s+([a-z][a-z0-9_]*)\b"
LISTED = r"(?i)" + _phrases("one of") + r"\s*:\s*([^.]+)\.?\s*$"

_W = r"[\p{L}\p{N}_]"
_SNAKE = rf"{_W}*\p{{L}}{_W}*_{_W}+"


def strict_references(text: Column) -> Column:
    """Snake-case tokens right beside the word column or field, sorted and distinct."""
    before = F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:column|field)\s+[\"'`]?({_SNAKE})"), F.lit(1))
    after = F.regexp_extract_all(text, F.lit(rf"(?i)({_SNAKE})[\"'`]?\s+(?:column|field)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(before, after)))


def loose_references(text: Column) -> Column:
    """What stands between any two quotes, and any lower-case ASCII name with an underscore that is a whole word."""
    quotes, name = "`\"'", "[A-Za-z0-9_]"
    quoted = F.regexp_extract_all(text, F.lit(f"[{quotes}]([^{quotes}]+)[{quotes}]"), F.lit(1))
    snake = F.regexp_extract_all(text, F.lit(f"(?<!{name})([a-z][a-z0-9]*_[a-z0-9_]+)(?!{name})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(quoted, snake)))


def meaningful(text: Column) -> Column:
    """At least four word tokens."""
    return F.size(F.regexp_extract_all(text, F.lit(rf"({_W}+)"), F.lit(1))) >= 4


def cleaned(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_sentences(text: Column) -> Column:
    """Simple split at end marks before a capital; pieces under eight characters are left out."""
    return F.filter(F.split(cleaned(text), r"(?<=[.!?])\s+(?=\p{Lu})"), lambda s: F.length(s) >= 8)


def claim_type(sentence: Column, column: Column) -> Column:
    """The one claim that a sentence makes of a column, or null. Negated and hedged wording abstains; the first rule that applies wins."""
    s, c = F.lower(sentence), F.lower(F.trim(column))
    bare = F.regexp_replace(F.trim(s), r"\.+$", "")
    entity = F.regexp_extract(s, ROW_PER, 1)
    abstain = s.rlike(DENIED)
    return (
        F.when(sentence.isNull() | column.isNull() | (sentence == "") | (column == "") | abstain, F.lit(None).cast("string"))
        .when(bare.isin(*ALONE) | s.rlike(UNIQUE), "unique")
        .when(s.rlike(PRESENT), "not_null")
        .when((entity != "") & ((c == entity) | (c == F.concat(entity, F.lit("_id")))), "unique")
        .when((F.size(listed_values(sentence)) >= 2), "accepted_values")
    )


def listed_values(sentence: Column) -> Column:
    """Values of a closing 'one of: a, b, c'; the empty list if any is no plain word."""
    raw = F.regexp_extract(sentence, LISTED, 1)
    parts = F.transform(F.split(raw, ","), lambda p: F.regexp_replace(F.trim(p), r"^['\"]+|['\"]+$", ""))
    return F.when((raw != "") & F.forall(parts, lambda p: p.rlike(r"^[A-Za-z0-9_-]+$")), parts).otherwise(F.array().cast("array<string>"))


def expresses(kind: Column, sentence: Column) -> Column:
    """Does the wording state a constraint of the kind at all? Used to filter mined pairs."""
    s = F.lower(sentence)
    negated = s.rlike(r"\b(?:need not|may not be unique|not necessarily|optional(?:ly)?|can be null|nullable)\b")
    return ~negated & (
        F.when(kind == "unique", s.rlike(r"\bunique\b|\bprimary key\b|\bone row per\b|\bidentif(?:y|ies)\b|\bnever repeats\b|\bkeyed by\b"))
        .when(kind == "not_null", s.rlike(r"\bnot null\b|\brequired\b|\bmust be (?:present|set)\b|\bnever (?:be )?(?:null|empty|blank)\b|\bmandatory\b"))
        .when(kind == "accepted_values", s.rlike(r"\bone of\b|\ballowed values?\b|\beither\b|\benum"))
        .when(kind == "relationships", s.rlike(r"\brefer(?:s|ences)?\b|\bforeign key\b|\bmust match\b|\blinks?\b"))
        .when(kind == "expression", s.rlike(r"[<>]=?|\bat least\b|\bat most\b|\bgreater\b|\bless\b|\bexceed\b|\bbetween\b"))
        .otherwise(F.lit(False))
    )


def message(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} places as a concatenation; a name that is not given leaves the whole template as it is."""
    import string

    parts = list(string.Formatter().parse(template))
    if any(name is not None and name not in values for _, name, _, _ in parts):
        return F.lit(template)
    out = []
    for text, name, _, _ in parts:
        if text:
            out.append(F.lit(text))
        if name is not None:
            out.append(F.coalesce(values[name].cast("string"), F.lit("null")))
    return F.concat(*out) if out else F.lit("")


def parse_time(value: Column) -> Column:
    """ISO text (without a zone it is UTC) or milliseconds since 1970 as a timestamp; null for anything else."""
    millis = F.when(value.rlike(r"^-?\d{1,16}$"), F.timestamp_millis(value.try_cast("bigint")))
    return F.coalesce(millis, F.when(value.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d"), value.try_cast("timestamp")))


def threshold(raw: str | None, default: float, low: float = 0.0, high: float = 1.0) -> float:
    """A threshold from a setting: the default where it is not set; an error where it is no number within the bounds."""
    if raw is None or not raw.strip():
        return default
    value = float(raw)
    if not low <= value <= high:
        raise ValueError(f"not within {low} and {high}: {raw}")
    return value

"""Names of assets and fields, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dataset_urn(platform: Column, relation: Column, env: Column) -> Column:
    """The urn of a dataset; quotes around the parts of the relation are dropped."""
    bare = F.regexp_replace(relation, "[\"'`]", "")
    return F.format_string("urn:li:dataset:(urn:li:dataPlatform:%s,%s,%s)", platform, bare, env)


def field_urn(urn: Column, path: Column) -> Column:
    return F.format_string("urn:li:schemaField:(%s,%s)", urn, path)


def urn_kind(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r"^urn:li:([A-Za-z]+):", 1), F.lit(""))


def urn_relation(urn: Column) -> Column:
    """The dotted relation (or the last part) inside an urn; null if it is none."""
    of_dataset = F.regexp_extract(urn, r"^urn:li:dataset:\(urn:li:dataplatform:[^,]+,([^,]+),[^,)]+\)$", 1)
    of_rest = F.regexp_extract(urn, r"^urn:li:[A-Za-z]+:\([^,]+,([^)]+)\)$", 1)
    lowered = F.regexp_extract(urn, r"^urn:li:dataset:\(urn:li:dataPlatform:[^,]+,([^,]+),[^,)]+\)$", 1)
    return F.coalesce(F.nullif(of_dataset, F.lit("")), F.nullif(lowered, F.lit("")), F.nullif(of_rest, F.lit("")))


def urn_platform(urn: Column) -> Column:
    return F.nullif(F.regexp_extract(urn, r"(?i)urn:li:dataPlatform:([^,)]+)", 1), F.lit(""))


def schema_and_table(relation: Column) -> tuple[Column, Column]:
    """Last two dotted parts; null for both where there are fewer than two."""
    parts = F.split(relation, r"\.")
    enough = F.size(parts) >= 2
    return F.when(enough, F.element_at(parts, -2)), F.when(enough, F.element_at(parts, -1))


def leaf(path: Column) -> Column:
    """Last segment of a field path without bracketed annotations, case folded; the split is on every dot."""
    kept = F.filter(F.split(path, r"\."), lambda p: ~(p.startswith("[") & p.endswith("]")))
    return F.when(F.size(kept) > 0, F.lower(F.element_at(kept, -1))).otherwise(F.lit(""))


def graph_link(base: str, urn: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), F.url_encode(urn))


#: Marks of tags that declare a column protected (fixed values).
PROTECTION = ("pii", "gdpr", "hipaa", "phi", "sensitive", "confidential", "restricted", "personal", "private", "ccpa", "pci")


def _compact(tag: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(tag, r"([^:]*)$", 1), "[^A-Za-z0-9]", ""))


def is_negated_tag(tag: Column) -> Column:
    """'not', 'non' or 'no' right before a mark of protection."""
    return _compact(tag).rlike(rf"^(?:not|non|no)(?:{'|'.join(PROTECTION)})")


def is_pii_tag(tag: Column) -> Column:
    return _compact(tag).rlike("pii|personallyidentifiable") & ~is_negated_tag(tag)


def is_protection_tag(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"([^:]*)$", 1)).rlike("|".join(PROTECTION)) & ~is_negated_tag(tag)


#: Spellings of a type that are one type (fixed values).
TYPE_ALIASES = {"int": "integer", "int4": "integer", "int8": "bigint", "varchar": "charactervarying", "bool": "boolean"}


def type_token(native: Column) -> Column:
    """Comparable token of a native type: lower case, no blanks, five aliases, length arguments kept."""
    bare = F.lower(F.regexp_replace(native, r"\s+", ""))
    head, tail = F.regexp_extract(bare, r"^([^(]*)", 1), F.regexp_extract(bare, r"(\(.*)$", 1)
    swapped = F.lit(None).cast("string")
    for k, v in TYPE_ALIASES.items():
        swapped = F.when(head == k, F.lit(v)).otherwise(swapped)
    return F.concat(F.coalesce(swapped, head), tail)


def is_deprecated(flag: Column, properties: Column) -> Column:
    """The flag, or a custom property that says so (fixed values); ``properties`` is a map."""
    return F.coalesce(flag, F.lit(False)) | F.coalesce(F.lower(F.element_at(properties, F.lit("deprecated"))).isin("true", "yes", "deprecated"), F.lit(False))

"""Schemas and constraints of live tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIVE_CONSTRAINT = "relation string, name string, kind string, columns array<string>, definition string, is_partial boolean"


def profile(df: DataFrame, relation: str) -> DataFrame:
    """(relation, position, path, native_type, nullable) of a table, nested fields by their dotted path."""
    rows = []

    def walk(schema, prefix: str) -> None:
        for f in schema.fields:
            rows.append((relation, len(rows), prefix + f.name, f.dataType.simpleString(), f.nullable))
            if f.dataType.typeName() == "struct":
                walk(f.dataType, prefix + f.name + ".")

    walk(df.schema, "")
    return df.sparkSession.createDataFrame(rows, "relation string, position int, path string, native_type string, nullable boolean")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query of a live database; filters and columns are pushed to it."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


#: The constraints of a PostgreSQL schema as one query: NOT NULL, declared constraints, and unique indexes that stand alone.
POSTGRES_CONSTRAINTS = """
SELECT c.relname AS relation, a.attname || '_not_null' AS name, 'not_null' AS kind, ARRAY[a.attname::text] AS columns, 'NOT NULL' AS definition, false AS is_partial
FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid WHERE a.attnotnull AND a.attnum > 0 AND c.relkind = 'r' AND c.relnamespace = '{schema}'::regnamespace
UNION ALL
SELECT c.relname, k.conname, CASE k.contype WHEN 'c' THEN 'check' WHEN 'p' THEN 'primary_key' WHEN 'u' THEN 'unique' WHEN 'f' THEN 'foreign_key' ELSE 'opaque' END,
  ARRAY(SELECT attname::text FROM pg_attribute WHERE attrelid = k.conrelid AND attnum = ANY (k.conkey)), pg_get_constraintdef(k.oid), false
FROM pg_constraint k JOIN pg_class c ON c.oid = k.conrelid WHERE c.relnamespace = '{schema}'::regnamespace
UNION ALL
SELECT c.relname, i.relname, CASE WHEN x.indexprs IS NULL THEN 'unique' ELSE 'opaque' END, ARRAY(SELECT attname::text FROM pg_attribute WHERE attrelid = x.indrelid AND attnum = ANY (x.indkey)), pg_get_indexdef(x.indexrelid), x.indpred IS NOT NULL
FROM pg_index x JOIN pg_class c ON c.oid = x.indrelid JOIN pg_class i ON i.oid = x.indexrelid WHERE x.indisunique AND NOT EXISTS (SELECT 1 FROM pg_constraint k WHERE k.conindid = x.indexrelid) AND c.relnamespace = '{schema}'::regnamespace
"""


def from_ddl(spark: SparkSession, ddl: DataFrame) -> DataFrame:
    """ddl(relation, text) of CREATE TABLE statements -> live constraints, read with expressions only."""
    body = F.regexp_extract("text", r"(?is)create\s+table\s+[^(]+\((.*)\)\s*;?\s*$", 1)
    # items are parted by commas that no bracket encloses (two levels of brackets are looked into)
    items = F.transform(F.regexp_extract_all(body, F.lit(r"((?:[^,()]|\((?:[^()]|\([^()]*\))*\))+)"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    it = ddl.select("relation", F.posexplode(items).alias("pos", "item"))
    head = F.regexp_extract("item", r"(?i)^constraint\s+\"?(\w+)\"?\s+", 1)
    bare = F.regexp_replace("item", r"(?i)^constraint\s+\"?\w+\"?\s+", "")
    cols = lambda rx: F.transform(F.split(F.regexp_extract(bare, rx, 1), ","), lambda c: F.lower(F.regexp_replace(F.trim(c), '"', "")))
    named = lambda suffix: F.when(head != "", head).otherwise(F.concat("relation", F.lit("_"), F.col("pos").cast("string"), F.lit(suffix)))
    none = F.array().cast("array<string>")
    of_table = it.where(bare.rlike(r"(?i)^(?:check|primary key|unique|foreign key|exclude)\b")).select(
        "relation", named("").alias("name"),
        F.when(bare.rlike("(?i)^check"), "check").when(bare.rlike("(?i)^primary"), "primary_key").when(bare.rlike("(?i)^unique"), "unique").when(bare.rlike("(?i)^exclude"), "opaque").otherwise("foreign_key").alias("kind"),
        F.when(bare.rlike("(?i)^(?:check|exclude)"), none).otherwise(cols(r"(?i)^(?:primary key|unique|foreign key)\s*\(([^)]*)\)")).alias("columns"), bare.alias("definition"), F.lit(False).alias("is_partial"),
    )
    column = it.where(~bare.rlike(r"(?i)^(?:check|primary key|unique|foreign key|exclude)\b")).withColumn("col", F.lower(F.regexp_extract("item", r'^"?(\w+)"?', 1)))
    says = lambda rx, kind, text: F.when(F.col("item").rlike(rx), F.struct(F.lit(kind).alias("k"), text.alias("d")))
    target = F.regexp_extract("item", r"(?i)(references\s+\S+(?:\s*\([^)]*\))?)", 1)
    check = F.regexp_extract("item", r"(?i)(check\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))", 1)
    wordings = F.array(
        says(r"(?i)\bnot null\b|\bprimary key\b", "not_null", F.lit("NOT NULL")), says(r"(?i)\bprimary key\b", "primary_key", F.lit("PRIMARY KEY")), says(r"(?i)\bunique\b", "unique", F.lit("UNIQUE")),
        says(r"(?i)\breferences\b", "foreign_key", target), says(r"(?i)\bcheck\s*\(", "check", check),
    )
    of_column = column.select("relation", "pos", "col", F.explode(F.filter(wordings, lambda x: x.isNotNull())).alias("w")).select(
        "relation", F.concat_ws("_", "relation", "col", "w.k").alias("name"), F.col("w.k").alias("kind"), F.array("col").alias("columns"), F.col("w.d").alias("definition"), F.lit(False).alias("is_partial")
    )
    return of_table.unionByName(of_column)

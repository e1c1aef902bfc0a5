"""Queries of the orphan reference operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.references import catalog_orphans, orphan_report
from plumbline.session import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return catalog_orphans(table(spark, d, "cat_entity"), table(spark, d, "cat_field"), table(spark, d, "cat_edge"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every dangling reference of an edge."""
    found = _orphans(spark, d).where((F.col("table_name") == "cat_edge") & (F.col("kind") == "direct"))
    return found.select(F.col("record_id").cast("long").alias("edge_id"), "ref_name", F.col("state").alias("ref_state")).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table, column and month."""
    return orphan_report(_orphans(spark, d))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report}

_STATES = r"""
WITH ent AS (
  SELECT DISTINCT lower(regexp_replace(regexp_replace(urn, '["''`]', '', 'g'), '^\s+|\s+$', '', 'g')) AS k, registered_at AS s, removed_at AS e, schema_available AS ok FROM cat_entity WHERE urn IS NOT NULL),
fld AS (
  SELECT DISTINCT lower(regexp_replace(regexp_replace(urn, '["''`]', '', 'g'), '^\s+|\s+$', '', 'g')) AS u,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(field_path, '["''`]', '', 'g'), '^\s+|\s+$', '', 'g')), '\[[^\]]*\]', '', 'g'), '\.\.+', '.', 'g'), '^\.+|\.+$', '', 'g') AS p,
    added_at AS s, dropped_at AS e FROM cat_field WHERE urn IS NOT NULL AND field_path IS NOT NULL),
edge AS (
  SELECT edge_id, asserted_at AS t,
    nullif(lower(regexp_replace(regexp_replace(source_urn, '["''`]', '', 'g'), '^\s+|\s+$', '', 'g')), '') AS src,
    nullif(lower(regexp_replace(regexp_replace(target_urn, '["''`]', '', 'g'), '^\s+|\s+$', '', 'g')), '') AS dst,
    nullif(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(target_field, '["''`]', '', 'g'), '^\s+|\s+$', '', 'g')), '\[[^\]]*\]', '', 'g'), '\.\.+', '.', 'g'), '^\.+|\.+$', '', 'g'), '') AS f
  FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY ingested_at DESC) AS rn FROM cat_edge WHERE edge_id IS NOT NULL) WHERE rn = 1 AND asserted_at IS NOT NULL),
a AS (
  SELECT r.edge_id, r.ref_name, max(CASE WHEN ent.k IS NULL THEN 0 ELSE 1 END) AS there,
    max(CASE WHEN ent.s <= r.t AND (ent.e IS NULL OR r.t < ent.e) THEN 1 ELSE 0 END) AS held,
    max(CASE WHEN ent.e <= r.t THEN 1 ELSE 0 END) AS ended,
    max(CASE WHEN ent.s <= r.t AND (ent.e IS NULL OR r.t < ent.e) AND ent.ok THEN 1 ELSE 0 END) AS ok,
    max(CASE WHEN ent.s <= r.t AND (ent.e IS NULL OR r.t < ent.e) THEN ent.s END) AS life, any_value(r.k) AS k, any_value(r.t) AS t
  FROM (SELECT edge_id, t, 'source_urn' AS ref_name, src AS k FROM edge WHERE src IS NOT NULL UNION ALL SELECT edge_id, t, 'target_urn', dst FROM edge WHERE dst IS NOT NULL) r
  LEFT JOIN ent ON ent.k = r.k GROUP BY r.edge_id, r.ref_name),
b AS (
  SELECT edge.edge_id, 'target_field' AS ref_name, max(CASE WHEN fld.u IS NULL THEN 0 ELSE 1 END) AS there,
    max(CASE WHEN fld.s <= edge.t AND (fld.e IS NULL OR edge.t < fld.e) THEN 1 ELSE 0 END) AS held,
    max(CASE WHEN fld.e <= edge.t THEN 1 ELSE 0 END) AS ended,
    max(CASE WHEN fld.s <= edge.t AND (fld.e IS NULL OR edge.t < fld.e) THEN fld.s END) AS life, any_value(concat(edge.dst, '#', edge.f)) AS k, any_value(edge.t) AS t
  FROM edge JOIN a ON a.edge_id = edge.edge_id AND a.ref_name = 'target_urn' AND a.held = 1 AND a.ok = 1
  LEFT JOIN fld ON fld.u = edge.dst AND fld.p = edge.f WHERE edge.f IS NOT NULL GROUP BY edge.edge_id)
"""

ORACLE = {
    "p1_found": _STATES
    + """SELECT edge_id, ref_name, CASE WHEN there = 0 THEN 'missing' WHEN ended = 1 THEN 'deleted' ELSE 'late' END AS ref_state
FROM (SELECT edge_id, ref_name, there, held, ended FROM a UNION ALL SELECT edge_id, ref_name, there, held, ended FROM b) WHERE held = 0""",
    "p1_report": _STATES.replace("WITH ent", "WITH RECURSIVE ent", 1)
    + """, fa AS (
  SELECT f.u, f.p, f.s, max(CASE WHEN ent.k IS NULL THEN 0 ELSE 1 END) AS there, max(CASE WHEN ent.s <= f.s AND (ent.e IS NULL OR f.s < ent.e) THEN 1 ELSE 0 END) AS held, max(CASE WHEN ent.e <= f.s THEN 1 ELSE 0 END) AS ended,
    max(CASE WHEN ent.s <= f.s AND (ent.e IS NULL OR f.s < ent.e) THEN ent.s END) AS life
  FROM (SELECT DISTINCT u, p, s FROM fld WHERE s IS NOT NULL AND u <> '' AND p <> '') f LEFT JOIN ent ON ent.k = f.u GROUP BY 1, 2, 3),
st AS (
  SELECT concat(ref_name, ':', edge_id) AS node, 'cat_edge' AS table_name, ref_name, k, t, there, held, ended, concat('A:', k, '@', CAST(life AS VARCHAR)) AS parent FROM a
  UNION ALL SELECT concat(ref_name, ':', edge_id), 'cat_edge', ref_name, k, t, there, held, ended, concat('L:', k, '@', CAST(life AS VARCHAR)) FROM b
  UNION ALL SELECT concat('L:', u, '#', p, '@', CAST(s AS VARCHAR)), 'cat_field', 'urn', u, s, there, held, ended, concat('A:', u, '@', CAST(life AS VARCHAR)) FROM fa),
link AS (
  SELECT node, table_name, ref_name, k, t, 'held' AS state, parent FROM st WHERE held = 1
  UNION ALL SELECT concat('target_field:', edge.edge_id), 'cat_edge', 'target_field', concat(edge.dst, '#', edge.f), edge.t, 'unjudged', concat('target_urn:', edge.edge_id) FROM edge JOIN a ON a.edge_id = edge.edge_id AND a.ref_name = 'target_urn' AND a.held = 0 WHERE edge.f IS NOT NULL
  UNION ALL SELECT concat('A:', a.k, '@', CAST(a.life AS VARCHAR)), 'cat_entity', 'derived_by', CAST(a.edge_id AS VARCHAR), a.t, 'held', concat('source_urn:', a.edge_id) FROM a JOIN edge ON edge.edge_id = a.edge_id AND edge.src IS NOT NULL WHERE a.ref_name = 'target_urn' AND a.held = 1),
orph AS (SELECT node FROM st WHERE held = 0 UNION SELECT link.node FROM link JOIN orph ON orph.node = link.parent),
out AS (
  SELECT table_name, ref_name, t, k, 'direct' AS kind, CASE WHEN there = 0 THEN 'missing' WHEN ended = 1 THEN 'deleted' ELSE 'late' END AS state FROM st WHERE held = 0
  UNION ALL SELECT table_name, ref_name, t, k, 'inherited', state FROM link WHERE parent IN (SELECT node FROM orph))
SELECT table_name, ref_name, strftime(t, '%Y-%m') AS month, kind, state, count(*) AS n_references, count(DISTINCT k) AS n_keys FROM out GROUP BY 1, 2, 3, 4, 5""",
}

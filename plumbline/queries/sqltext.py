"""Pieces of SQL that several oracle texts share."""


def key(c: str) -> str:
    return f"""lower(regexp_replace(regexp_replace({c}, '["''`]', '', 'g'), '^\\s+|\\s+$', '', 'g'))"""


def path(c: str) -> str:
    return f"""regexp_replace(regexp_replace(regexp_replace({key(c)}, '\\[[^\\]]*\\]', '', 'g'), '\\.\\.+', '.', 'g'), '^\\.+|\\.+$', '', 'g')"""


#: The current catalog: ent, fld, edg and asset edges ae.
CATALOG = f"""WITH RECURSIVE ent AS (
  SELECT {key("urn")} AS urn, min(kind) AS kind, min(owner) AS owner, coalesce(bool_or(deprecated), false) AS deprecated, coalesce(bool_or(live), false) AS live, coalesce(bool_or(schema_available), false) AS schema_ok
  FROM cat_entity WHERE removed_at IS NULL AND urn IS NOT NULL GROUP BY 1),
fld AS (
  SELECT {key("urn")} AS urn, {path("field_path")} AS path, min(native_type) AS native_type, bool_and(nullable) AS nullable, list_sort(list_distinct(flatten(list(coalesce(tags, []))))) AS tags, min(description) AS description
  FROM cat_field WHERE dropped_at IS NULL AND urn IS NOT NULL AND field_path IS NOT NULL GROUP BY 1, 2),
edg AS (
  SELECT DISTINCT {key("source_urn")} AS src, nullif({path("source_field")}, '') AS src_field, {key("target_urn")} AS dst, nullif({path("target_field")}, '') AS dst_field
  FROM cat_edge WHERE coalesce({key("source_urn")}, '') <> '' AND coalesce({key("target_urn")}, '') <> ''),
ae AS (SELECT DISTINCT src, dst FROM edg)
"""

#: A derived catalog over the order tables: order -> customer -> nation -> region, a DAG of three hops.
DERIVED = """WITH RECURSIVE ent AS (
  SELECT concat('ord:', CAST(o_orderkey AS VARCHAR)) AS urn, 'dataset' AS kind, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS owner, o_totalprice < 20000 AS deprecated, false AS live FROM orders
  UNION ALL SELECT concat('cust:', CAST(c_custkey AS VARCHAR)), 'dataset', CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END, c_acctbal < 0, false FROM customer
  UNION ALL SELECT concat('nat:', CAST(n_nationkey AS VARCHAR)), 'chart', 'viz', false, n_nationkey % 5 <> 0 FROM nation
  UNION ALL SELECT concat('reg:', CAST(r_regionkey AS VARCHAR)), 'dashboard', 'viz', false, true FROM region),
ae AS (
  SELECT concat('ord:', CAST(o_orderkey AS VARCHAR)) AS src, concat('cust:', CAST(o_custkey AS VARCHAR)) AS dst FROM orders
  UNION SELECT concat('cust:', CAST(c_custkey AS VARCHAR)), concat('nat:', CAST(c_nationkey AS VARCHAR)) FROM customer
  UNION SELECT concat('nat:', CAST(n_nationkey AS VARCHAR)), concat('reg:', CAST(n_regionkey AS VARCHAR)) FROM nation)
"""

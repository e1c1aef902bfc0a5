"""Queries of claims, changes, lineage, policy, receipts, audits and repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import api
from plumbline.functions.names import urn_relation
from plumbline.functions.text import claim_type, expresses, listed_values, parse_time
from plumbline.operators import audit as au
from plumbline.operators import change as ch
from plumbline.operators import claims as cl
from plumbline.operators import policy as po
from plumbline.operators import receipts as rc
from plumbline.operators import repair as rp
from plumbline.operators import self_check as sc
from plumbline.operators.graph import neighbours
from plumbline.operators.lineage import lineage_diff, resolve_sources
from plumbline.operators.snapshot import load, lookup
from plumbline.queries.catalog import _LEAK, _ORPHAN, _TAGGED, _UNOWNED, LOOSE, _pii
from plumbline.queries.derived import derived_snapshot
from plumbline.queries.sqltext import CATALOG, DERIVED, key
from plumbline.session import cut, table, tidy

# ------------------------------------------------------------------------------------------------------------------------ claims

UNIQUE_LINE = cl.Claim("unique", ("l_orderkey", "l_linenumber"))


def claim_unique(spark: SparkSession, d: str) -> DataFrame:
    return cl.unique_violations(table(spark, d, "lineitem"), UNIQUE_LINE)


def claim_unique_sample(spark: SparkSession, d: str) -> DataFrame:
    return cl.unique_sample(table(spark, d, "part"), cl.Claim("unique", ("p_name",)))


def claim_not_null(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return cl.row_claims(o, [cl.Claim("not_null", ("o_orderstatus",))])


def claim_accepted_values(spark: SparkSession, d: str) -> DataFrame:
    return cl.row_claims(table(spark, d, "orders"), [cl.Claim("accepted_values", ("o_orderstatus",), ("F", "O"))])


def claim_expression(spark: SparkSession, d: str) -> DataFrame:
    return cl.row_claims(table(spark, d, "lineitem"), [cl.Claim("expression", ("l_quantity",), expr="l_quantity <= 40 and l_discount < 0.08")])


def claim_relationships(spark: SparkSession, d: str) -> DataFrame:
    pairs = ((table(spark, d, "lineitem"), "l_orderkey", table(spark, d, "orders").where("o_totalprice > 1000"), "o_orderkey"), (table(spark, d, "doc_label"), "doc_id", table(spark, d, "documents").where("text is not null"), "doc_id"))
    out = [cl.relationship_violations(a, cl.Claim("relationships", (x,), target=("", y)), b) for a, x, b, y in pairs]
    return out[0].unionByName(out[1])


FUSED = [
    cl.Claim("not_null", ("o_custkey",)), cl.Claim("accepted_values", ("o_orderstatus",), ("F", "O")), cl.Claim("accepted_values", ("o_orderpriority",), ("1-URGENT", "2-HIGH", "3-MEDIUM")),
    cl.Claim("expression", ("o_totalprice",), expr="o_totalprice between 5000 and 300000"), cl.Claim("expression", ("o_orderkey",), expr="o_orderkey + 1 > o_custkey"),
]


def claims_fused(spark: SparkSession, d: str) -> DataFrame:
    return cl.row_claims(table(spark, d, "orders"), FUSED)


def claim_status_report(spark: SparkSession, d: str) -> DataFrame:
    broken = cl.Claim("not_null", ("no_such_column",))
    rows = cl.verify(table(spark, d, "orders"), [*FUSED, broken, cl.Claim("unique", ("o_orderkey",)), cl.Claim("relationships", ("o_custkey",), target=("customer", "c_custkey"))], {"customer": table(spark, d, "customer")})
    return rows.groupBy("type", "status").agg(F.count("*").alias("n"), F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"))


_SENTENCES = ("o_orderkey is unique", "The status must not be null", "Holds one row per order", "Status is one of: F, O, P", "This may be unique", "Primary key.", "free text", "is not unique and never null")
_COLUMNS = ("order", "order_id", "o_orderstatus")


def _phrased(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % n + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", pick(_SENTENCES, 8).alias("sentence"), pick(_COLUMNS, 3).alias("column_name"))


def claim_phrases(spark: SparkSession, d: str) -> DataFrame:
    return _phrased(spark, d).select("o_orderkey", claim_type(F.col("sentence"), F.col("column_name")).alias("type"), F.size(listed_values(F.col("sentence"))).alias("n_values"))


def _attested(spark: SparkSession, d: str) -> DataFrame:
    p = _phrased(spark, d).select(
        F.concat(F.lit("t"), (F.col("o_orderkey") % 100).cast("string")).alias("urn"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("column_name"),
        claim_type(F.col("sentence"), F.col("column_name")).alias("rule_type"), F.when(F.col("o_orderkey") % 5 == 0, "not_null").alias("model_type"),
    )
    return cl.attest(p, 10)


def attestation_summary(spark: SparkSession, d: str) -> DataFrame:
    return cl.attestation_summary(_attested(spark, d))


def attestation_budget(spark: SparkSession, d: str) -> DataFrame:
    return _attested(spark, d).where("taken").select("urn", "column_name", "type", "origin")


def claim_wording(spark: SparkSession, d: str) -> DataFrame:
    """Mined claims by whether their sentence states a constraint of their type."""
    t = table(spark, d, "mine_claims_release").where("claim_type is not null and sentence is not null")
    return t.groupBy("claim_type").agg(F.count("*").alias("n"), F.count_if(expresses(F.col("claim_type"), F.col("sentence"))).alias("n_expressed"))


# ----------------------------------------------------------------------------------------------------------------------- changes


def _refs(s) -> DataFrame:
    return s.edge.where("dst_field is not null").select(F.col("dst").alias("urn"), F.col("dst_field").alias("path")).distinct()


def schema_gate(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d)
    return ch.schema_gate(s, _refs(s)).select("kind", "subject")


def _changed(s) -> DataFrame:
    kind = F.when(F.col("path").endswith("_no"), "text").otherwise(F.col("native_type"))
    return s.field.where(F.length("path") % 11 != 0).select("urn", "path", kind.alias("native_type"), "nullable")


def schema_type_mismatch(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d)
    return ch.type_mismatch(s, _changed(s)).select("subject")


def reality_diff(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d)
    size = lambda f: F.size(F.from_json(F.get_json_object("detail", f), "array<string>"))
    e = ch.reality_diff(s, _changed(s), s.entity.where("kind = 'dataset'"))
    return e.select("kind", "subject", F.coalesce(size("$.only_catalog"), F.lit(0)).alias("n_catalog"), F.coalesce(size("$.only_live"), F.lit(0)).alias("n_live"))


def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d)
    return ch.blast_radius(s, s.entity.where("deprecated").select(F.col("urn").alias("root")))


def blast_paths(spark: SparkSession, d: str) -> DataFrame:
    s = derived_snapshot(spark, d)
    return ch.blast_paths(s, s.entity.where(F.col("deprecated") & F.col("urn").startswith("cust:")).select(F.col("urn").alias("root"))).select("root", "node", F.array_join("path", ">").alias("path"))


def deprecated_upstream(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d)
    return ch.deprecated_upstream(s, _refs(s)).select("subject", F.size(F.from_json(F.get_json_object("detail", "$.fields"), "array<string>")).alias("n_fields"))


def unowned_asset(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d)
    return ch.unowned_asset(s, _refs(s)).select("subject")


def field_delta(spark: SparkSession, d: str) -> DataFrame:
    """Fields of each asset with an even length against all of them."""
    f = load(spark, d).field
    per = f.groupBy("urn").agg(F.collect_set(F.when(F.length("path") % 2 == 0, F.col("path"))).alias("now"), F.collect_set(F.when(F.length("path") % 3 == 0, F.col("path"))).alias("before"))
    added, removed = ch.field_delta(F.col("now"), F.col("before"))
    return per.select("urn", F.array_join(added, ",").alias("added"), F.array_join(removed, ",").alias("removed"), F.array_join(ch.schema_after(F.col("before"), added, removed), ",").alias("after"))


def _documented(spark: SparkSession, d: str) -> DataFrame:
    """Sentences as documentation of their table, whose columns are those that claims are about; columns with a name of 3, 6, 9 ... letters go."""
    t = table(spark, d, "mine_claims_release").where("table_name is not null")
    columns = t.where("column_name is not null").groupBy("table_name").agg(F.collect_set("column_name").alias("fields"))
    none = F.array().cast("array<string>")
    docs = t.where("sentence is not null and record_id is not null").join(columns, "table_name", "left").withColumn("fields", F.coalesce("fields", none))
    return docs.select(F.col("record_id").cast("string").alias("urn"), F.col("sentence").alias("description"), "fields", none.alias("added"), F.filter("fields", lambda c: F.length(c) % 3 == 0).alias("removed"))


def doc_rot(spark: SparkSession, d: str) -> DataFrame:
    return ch.doc_rot(_documented(spark, d)).select("subject", F.get_json_object("detail", "$.mentioned_field").alias("mentioned"))


def _computed(e: DataFrame) -> DataFrame:
    """What an analysis of the SQL might say: some stored edges not, and some the other way round."""
    back = e.where(F.length("src") % 7 == 0).select(F.col("dst").alias("src"), F.col("dst_field").alias("src_field"), F.col("src").alias("dst"), F.col("src_field").alias("dst_field"))
    return e.where((F.length("src") + F.length("dst")) % 5 != 0).unionByName(back)


def check_change(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of all gates for a change of the deprecated assets: how much of each kind, and over how many assets and fields."""
    s = load(spark, d).settled()
    refs = _refs(s).join(s.entity.where("deprecated").select("urn"), "urn", "left_semi")
    e = api.change_evidence(s, refs, _changed(s), _documented(spark, d), _computed(s.edge))
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("n_subjects"))


def blast_evidence(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d)
    e = ch.blast_evidence(s, s.entity.where("deprecated").select(F.col("urn").alias("root")))
    return e.select("subject", *(F.get_json_object("detail", f"$.{k}").cast("long").alias(k) for k in ("count", "dashboards", "critical_assets", "pii_assets", "unreadable_assets", "cross_team_owners")))


def attributed_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings per asset and kind; an edge to nowhere counts for the asset that states it."""
    s = load(spark, d)
    return sc.attributed(s, sc.orphan_lineage(s).unionByName(sc.unowned_consumed(s))).select("urn", "kind")


def lineage_rot_diff(spark: SparkSession, d: str) -> DataFrame:
    e = cut(load(spark, d).edge.select("src", "src_field", "dst", "dst_field"))
    return lineage_diff(e, _computed(e))


def lineage_source_resolve(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d)
    rel = s.entity.select("urn", urn_relation(F.col("urn")).alias("relation"))
    names = table(spark, d, "mine_claims_release").select(F.col("table_name").alias("name")).where("name is not null").union(rel.select("relation")).union(rel.select(F.substring_index("relation", ".", -1))).where("name is not null")
    return resolve_sources(names, rel)


# ------------------------------------------------------------------------------------------------------------------------ policy


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("count"), F.count_if(F.col("o_orderstatus") == "P").alias("p"), F.count_if(F.col("o_totalprice") > 450000).alias("c"))
    kind = F.element_at(F.array(*map(F.lit, ("blast_radius", "blast_radius", "unowned_asset", "unknown_dataset", "doc_claim_holds", "mystery"))), (F.col("o_custkey") % 6 + 1).cast("int"))
    body = F.to_json(F.struct("count", F.greatest(F.col("p") - 5, F.lit(0)).alias("unreadable_assets"), F.col("c").alias("critical_assets"), F.lit(0).alias("cross_team_owners")))
    return o.select(F.col("o_custkey").alias("ord"), kind.alias("kind"), F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("subject"), body.alias("detail"))


def policy_findings(spark: SparkSession, d: str) -> DataFrame:
    return po.findings(_evidence(spark, d), po.load()).select("ord", "rule_id", "severity", "reason_code", "message")


def policy_rule_match(spark: SparkSession, d: str) -> DataFrame:
    return po.findings(_evidence(spark, d), po.load()).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


def policy_verdict(spark: SparkSession, d: str) -> DataFrame:
    f = po.findings(_evidence(spark, d), po.load()).withColumn("team", F.col("ord") % 50)
    return po.verdict(f, ["team"])


def verdict_combine(spark: SparkSession, d: str) -> DataFrame:
    f = po.findings(_evidence(spark, d).where("kind in ('blast_radius', 'unowned_asset')"), po.load()).withColumn("team", F.col("ord") % 50)
    return po.combine(po.verdict(f, ["team"]), "team")


_MATRIX = [po.Condition("detail.count", o, v) for o, v in (("eq", 10), ("ne", 10), ("gt", 9), ("gte", 9), ("lt", 9), ("lte", 9), ("in", [8, 9]))] + [
    po.Condition("detail.nothing", "ne", 1), po.Condition("detail.nothing", "empty"), po.Condition("detail.count", "not_empty"), po.Condition("subject", "contains", "7"),
]


def policy_ops_matrix(spark: SparkSession, d: str) -> DataFrame:
    e = _evidence(spark, d)
    one = e.agg(*(F.count_if(po.matches(c)[0]).alias(f"v{i}") for i, c in enumerate(_MATRIX)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f"{c.field} {c.op}").alias("condition"), F.col(f"v{i}").alias("n")) for i, c in enumerate(_MATRIX)))).alias("p")).select("p.*")


# ---------------------------------------------------------------------------------------------------------------------- receipts


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    verdict = F.when(F.col("event_type") == "purchase", "PASS").when(F.col("event_type").isin("view", "signup"), "WARN").when(F.col("event_type") == "error", "BLOCK").otherwise("UNKNOWN")
    i = F.col("event_id")
    return e.select(
        F.col("user_id").cast("string").alias("urn"), F.col("ts").alias("checked_at"), verdict.alias("verdict"), (i % 3).cast("string").alias("policy_hash"), F.when(i % 4 != 0, (i % 2).cast("string")).alias("context_hash"),
        F.concat(F.lit("run"), (i % 4).cast("string")).alias("swarm_run"), F.when(i % 7 != 0, F.concat(F.lit("w"), (i % 5).cast("string"))).alias("worker_id"), i.alias("event_id"),
    )


def _now():
    return F.lit("2024-01-30 00:00:00").cast("timestamp")


def latest_receipt(spark: SparkSession, d: str) -> DataFrame:
    return rc.latest(_log(spark, d)).select("urn", "verdict", "event_id")


def _asked(spark: SparkSession, d: str, log: DataFrame) -> DataFrame:
    """Every customer, and every urn of the log."""
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("urn")).union(log.select("urn")).where("urn is not null").distinct()


def receipt_status(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return rc.status(_asked(spark, d, log), log).select("urn", "verdict")


def _stale(log: DataFrame):
    return rc.staleness(F.col("checked_at"), _now(), (F.col("policy_hash"), F.lit("1")), F.lit("2024-01-10 00:00:00").cast("timestamp"), (F.col("context_hash"), F.when(F.col("event_id") % 5 != 0, F.lit("1"))), 15 * 86400)


def receipt_staleness(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return log.select(F.coalesce(_stale(log), F.lit("current")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def receipt_judgment(spark: SparkSession, d: str) -> DataFrame:
    log = rc.latest(_log(spark, d))
    state, action = rc.judgment(F.col("verdict"), _stale(log).isNotNull() & (F.col("event_id") % 2 == 0), F.lit(True))
    return log.select("urn", state.alias("state"), action.alias("action"))


def swarm_ledger(spark: SparkSession, d: str) -> DataFrame:
    return rc.swarm_ledger(_log(spark, d), "run2")


def search_classification(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    return rc.classification(_asked(spark, d, log), log, _now(), 86400)


def receipt_badges(spark: SparkSession, d: str) -> DataFrame:
    return rc.latest(_log(spark, d)).groupBy(F.coalesce(rc.badge(F.col("verdict")), F.lit("none")).alias("badge")).agg(F.count("*").alias("n"))


def signed_log(spark: SparkSession, d: str) -> DataFrame:
    """The log signed, a seventh of it changed, and checked."""
    log = rc.sign(_log(spark, d), b"key").withColumn("verdict", F.when(F.col("event_id") % 7 == 0, "FORGED").otherwise(F.col("verdict")))
    return rc.check_signatures(log, b"key").groupBy("intact").agg(F.count("*").alias("n"))


def swarm_run(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d).settled()
    return au.swarm(cut(au.plan(s)), neighbours(s.asset_edges), sc.attributed(s, sc.run_all(s, paths=False)), ["a", "b", "c"], 20)


def bi_hops(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d)
    return ch.with_bi_hops(s, s.entity.where("deprecated").select(F.col("urn").alias("root")))


def asset_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d)
    names = table(spark, d, "cat_edge").select(F.col("target_urn").alias("name")).where("name is not null").union(s.entity.select(F.substring_index(urn_relation(F.col("urn")), ".", -1)))
    return lookup(s, names.where("name is not null"))


def time_parse(spark: SparkSession, d: str) -> DataFrame:
    """Times of events as text in three forms."""
    form = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).otherwise("soon")
    return table(spark, d, "events").select("event_id", F.date_format(parse_time(form), "yyyy-MM-dd HH:mm:ss").alias("at"))


def context_hash(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d)
    return rc.context_hash(s.entity, neighbours(s.asset_edges))


# ------------------------------------------------------------------------------------------------------------- audits and repairs


def audit_plan(spark: SparkSession, d: str) -> DataFrame:
    return au.plan(load(spark, d))


def audit_budget(spark: SparkSession, d: str) -> DataFrame:
    return au.split_by_budget(au.plan(load(spark, d)), 25).groupBy("examined").agg(F.count("*").alias("n"), F.sum("score").alias("score"))


def audit_resume(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d)
    return au.resume(au.plan(s), s.entity.where(F.col("owner").isNotNull() & (F.length("urn") % 2 == 0))).select("urn", "score", "position")


def audit_run(spark: SparkSession, d: str) -> DataFrame:
    with tidy(spark):
        s = load(spark, d).settled()
        planned = au.plan(s)
    prior = s.entity.where(F.length("urn") % 5 == 0).select("urn", F.when(F.length("urn") % 2 == 0, "PASS").otherwise("BLOCK").alias("verdict"))
    return au.run(planned, s.edge.select(F.col("src").alias("node"), F.col("dst").alias("neighbour")), sc.kinds(s), prior, 50)


def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return au.summary(audit_run(spark, d))


def swarm_rotation(spark: SparkSession, d: str) -> DataFrame:
    return au.rotation(au.plan(load(spark, d)), "worker-3")


def repair_owner(spark: SparkSession, d: str) -> DataFrame:
    return rp.propose_owners(derived_snapshot(spark, d))


def repair_owner_catalog(spark: SparkSession, d: str) -> DataFrame:
    return rp.propose_owners(load(spark, d))


def repair_tags(spark: SparkSession, d: str) -> DataFrame:
    return rp.propose_tags(load(spark, d))


def repair_prove(spark: SparkSession, d: str) -> DataFrame:
    """Tags put on the leaking fields and the check run again; fields the repair makes leak in turn are collateral."""
    s = load(spark, d)
    before = sc.pii_leak_untagged(s)
    after = sc.pii_leak_untagged(rp.with_tags(s, rp.propose_tags(s)))
    return rp.prove(before, after, before)


def repair_unfixed(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d)
    before = sc.unowned_consumed(s).unionByName(sc.pii_leak_untagged(s))
    fixed = rp.with_tags(s, rp.propose_tags(s))
    after = sc.unowned_consumed(fixed).unionByName(sc.pii_leak_untagged(fixed))
    return rp.unfixed(before, rp.prove(before, after, before))


_FUNCS = (
    claim_unique, claim_unique_sample, claim_not_null, claim_accepted_values, claim_expression, claim_relationships, claims_fused, claim_status_report, claim_phrases, attestation_summary, attestation_budget, claim_wording,
    schema_gate, schema_type_mismatch, reality_diff, blast_radius, blast_evidence, blast_paths, check_change, attributed_findings, deprecated_upstream, unowned_asset, field_delta, doc_rot, lineage_rot_diff, lineage_source_resolve,
    policy_findings, policy_rule_match, policy_verdict, verdict_combine, policy_ops_matrix, latest_receipt, receipt_status, receipt_staleness, receipt_judgment, swarm_ledger, search_classification, context_hash, receipt_badges, signed_log, swarm_run, bi_hops, asset_lookup, time_parse,
    audit_plan, audit_budget, audit_resume, audit_run, audit_summary, swarm_rotation, repair_owner, repair_owner_catalog, repair_tags, repair_prove, repair_unfixed,
)
QUERIES = {f.__name__: f for f in _FUNCS}

_FUSED_SQL = {
    "not_null(o_custkey)": "o_custkey IS NULL", "accepted_values(o_orderstatus)": "o_orderstatus NOT IN ('F', 'O')", "accepted_values(o_orderpriority)": "o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')",
    "expression(o_totalprice)": "NOT coalesce(o_totalprice BETWEEN 5000 AND 300000, false)", "expression(o_orderkey)": "NOT coalesce(o_orderkey + 1 > o_custkey, false)",
}
_FUSED_ROWS = " UNION ALL ".join(f"SELECT '{k}' AS claim, count(*) FILTER (WHERE {v}) AS violations FROM orders" for k, v in _FUSED_SQL.items())
_PHRASED = f"""WITH ph AS (SELECT o_orderkey, [{", ".join(f"'{s}'" for s in _SENTENCES)}][o_orderkey % 8 + 1] AS sentence, [{", ".join(f"'{s}'" for s in _COLUMNS)}][o_orderkey % 3 + 1] AS column_name FROM orders),
ty AS (SELECT *, CASE o_orderkey % 8 WHEN 0 THEN 'unique' WHEN 1 THEN 'not_null' WHEN 2 THEN CASE WHEN column_name IN ('order', 'order_id') THEN 'unique' END WHEN 3 THEN 'accepted_values' WHEN 5 THEN 'unique' END AS type FROM ph)
"""
_ATTESTED = _PHRASED + """, att AS (SELECT concat('t', CAST(o_orderkey % 100 AS VARCHAR)) AS urn, lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS column_name, type AS rule_type, CASE WHEN o_orderkey % 5 = 0 THEN 'not_null' END AS model_type FROM ty),
tk AS (SELECT urn, column_name, coalesce(rule_type, model_type) AS type, CASE WHEN rule_type IS NOT NULL THEN 'rule' ELSE 'model' END AS origin, row_number() OVER (PARTITION BY urn ORDER BY column_name) <= 10 AS taken FROM att WHERE coalesce(rule_type, model_type) IS NOT NULL)
"""
_REFS = ", rf AS (SELECT DISTINCT dst AS urn, dst_field AS path FROM edg WHERE dst_field IS NOT NULL)"
_TOKEN = r"concat(CASE regexp_extract(lower(regexp_replace({c}, '\s+', '', 'g')), '^([^(]*)', 1) WHEN 'int' THEN 'integer' WHEN 'int4' THEN 'integer' WHEN 'int8' THEN 'bigint' WHEN 'varchar' THEN 'charactervarying' WHEN 'bool' THEN 'boolean' ELSE regexp_extract(lower(regexp_replace({c}, '\s+', '', 'g')), '^([^(]*)', 1) END, regexp_extract(lower(regexp_replace({c}, '\s+', '', 'g')), '(\(.*)$', 1))"
_CHANGED = ", lv AS (SELECT urn, path, CASE WHEN path LIKE '%!_no' ESCAPE '!' THEN 'text' ELSE native_type END AS native_type, nullable FROM fld WHERE length(path) % 11 <> 0)"
_FIELDTEXT = "concat_ws(' ', path, " + _TOKEN.format(c="native_type") + ", coalesce(CAST(nullable AS VARCHAR), '?'))"
_REL = r"coalesce(nullif(regexp_extract(urn, '^urn:li:dataset:\(urn:li:dataplatform:[^,]+,([^,]+),[^,)]+\)$', 1), ''), nullif(regexp_extract(urn, '^urn:li:[A-Za-z]+:\([^,]+,([^)]+)\)$', 1), ''))"
_EVIDENCE = """WITH g AS (SELECT o_custkey AS ord, count(*) AS cnt, count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_totalprice > 450000) AS c FROM orders GROUP BY 1),
ev AS (SELECT ord, ['blast_radius', 'blast_radius', 'unowned_asset', 'unknown_dataset', 'doc_claim_holds', 'mystery'][ord % 6 + 1] AS kind, concat('cust:', CAST(ord AS VARCHAR)) AS subject, cnt, greatest(p - 5, 0) AS unread, c AS crit FROM g),
hit AS (
  SELECT ord, 10 AS ro, 'partial_blast_radius' AS rule_id, 'block' AS severity, 'UNVERIFIABLE_CHANGE' AS reason_code, concat('part of what is downstream of ', subject, ' could not be read') AS message, kind FROM ev WHERE kind = 'blast_radius' AND unread > 0
  UNION ALL SELECT ord, 11, 'critical_downstream', 'block', NULL, concat('critical or foreign assets are downstream of ', subject), kind FROM ev WHERE kind = 'blast_radius' AND crit > 0
  UNION ALL SELECT ord, 12, 'wide_blast_radius', 'warn', NULL, concat(CAST(cnt AS VARCHAR), ' assets are downstream of ', subject), kind FROM ev WHERE kind = 'blast_radius' AND cnt > 5
  UNION ALL SELECT ord, 14, 'unowned_asset', 'warn', NULL, concat(subject, ' has no owner'), kind FROM ev WHERE kind = 'unowned_asset'
  UNION ALL SELECT ord, 3, 'unknown_dataset', 'block', 'UNVERIFIABLE_CHANGE', concat(subject, ' is not in the catalog'), kind FROM ev WHERE kind = 'unknown_dataset'
  UNION ALL SELECT ord, 27, 'doc_claim_holds', 'info', NULL, concat('a claim about ', subject, ' holds'), kind FROM ev WHERE kind = 'doc_claim_holds'),
fi AS (SELECT * FROM hit UNION ALL SELECT ord, 99, CASE WHEN kind = 'mystery' THEN 'unhandled_evidence' ELSE 'informational' END, CASE WHEN kind = 'mystery' THEN 'block' ELSE 'info' END, NULL, subject, kind FROM ev WHERE ord NOT IN (SELECT ord FROM hit))
"""
_VERDICT = "CASE max(CASE severity WHEN 'block' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) WHEN 2 THEN 'BLOCK' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS decision, arg_min(reason_code, (ord, ro)) FILTER (WHERE severity = 'block' AND reason_code IS NOT NULL) AS reason_code"
_LOGSQL = """WITH lg AS (SELECT CAST(user_id AS VARCHAR) AS urn, ts AS checked_at, CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'view' THEN 'WARN' WHEN 'signup' THEN 'WARN' WHEN 'error' THEN 'BLOCK' ELSE 'UNKNOWN' END AS verdict,
  CAST(event_id % 3 AS VARCHAR) AS policy_hash, CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 2 AS VARCHAR) END AS context_hash, concat('run', CAST(event_id % 4 AS VARCHAR)) AS swarm_run, CASE WHEN event_id % 7 <> 0 THEN concat('w', CAST(event_id % 5 AS VARCHAR)) END AS worker_id, event_id FROM events),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY urn ORDER BY checked_at DESC, verdict DESC) AS rn FROM lg) WHERE rn = 1),
st AS (SELECT *, CASE WHEN policy_hash <> '1' THEN 'policy_changed' WHEN TIMESTAMP '2024-01-10' > checked_at THEN 'schema_changed' WHEN floor(epoch(TIMESTAMP '2024-01-30')) - floor(epoch(checked_at)) > 1296000 THEN 'too_old'
  WHEN context_hash IS NULL THEN 'no_context' WHEN event_id % 5 = 0 THEN 'context_unknown' WHEN context_hash <> '1' THEN 'context_changed' END AS reason FROM lg)
"""
_ASKED = "SELECT CAST(c_custkey AS VARCHAR) AS urn FROM customer WHERE c_custkey IS NOT NULL UNION SELECT urn FROM lg WHERE urn IS NOT NULL"
_PLAN = f""", sco AS (SELECT ent.urn, (10 * coalesce(n.n, 0) + CASE WHEN pi.urn IS NOT NULL THEN 50 ELSE 0 END + CASE WHEN owner IS NULL THEN 15 ELSE 0 END + CASE WHEN deprecated THEN 20 ELSE 0 END + CASE WHEN NOT schema_ok THEN 25 ELSE 0 END)::BIGINT AS score
  FROM ent LEFT JOIN (SELECT src, count(*) AS n FROM edg GROUP BY src) n ON n.src = ent.urn LEFT JOIN (SELECT DISTINCT urn FROM fld WHERE len(list_filter(tags, lambda x: {_pii("x")})) > 0) pi ON pi.urn = ent.urn WHERE ent.kind = 'dataset'),
pl AS (SELECT urn, score, row_number() OVER (ORDER BY score DESC, urn) AS position FROM sco)"""
_OWNER = f", bad AS ({_UNOWNED}) SELECT bad.subject AS urn, min(s.owner) AS owner FROM bad JOIN ae ON ae.dst = bad.subject AND ae.src <> ae.dst JOIN ent s ON s.urn = ae.src AND s.owner IS NOT NULL GROUP BY 1 HAVING count(DISTINCT s.owner) = 1"
_LEAKS = f""", {_TAGGED}, lk AS (SELECT t.urn AS urn, t.path AS path, list_filter(s.tags, lambda x: {_pii("x")}) AS tags FROM edg JOIN tf s ON s.urn = edg.src AND s.path = edg.src_field JOIN tf t ON t.urn = edg.dst AND t.path = edg.dst_field
  WHERE len(list_filter(s.tags, lambda x: {_pii("x")})) > 0 AND NOT list_has_any(list_filter(s.tags, lambda x: {_pii("x")}), t.tags) AND ({_LEAK.rpartition("AND len")[2].join(("len", ""))})),
fix AS (SELECT urn, path, min(tag) AS tag FROM (SELECT urn, path, unnest(tags) AS tag FROM lk) GROUP BY 1, 2 HAVING count(DISTINCT tag) = 1)"""
_DOCUMENTED = f"""WITH dt AS (SELECT * FROM mine_claims_release WHERE table_name IS NOT NULL), dk AS (SELECT DISTINCT table_name, column_name FROM dt WHERE column_name IS NOT NULL AND length(column_name) % 3 <> 0),
dm AS (SELECT CAST(record_id AS VARCHAR) AS subject, table_name, unnest({LOOSE.format(c="sentence")}) AS mentioned FROM dt WHERE sentence IS NOT NULL AND record_id IS NOT NULL),
rot AS (SELECT subject, mentioned FROM dm WHERE NOT EXISTS (SELECT 1 FROM dk WHERE dk.table_name = dm.table_name AND dk.column_name = dm.mentioned))
"""
_BI = """, w3 AS (SELECT urn AS root, urn AS node, 0 AS depth FROM ent WHERE deprecated UNION SELECT w3.root, ae.dst, w3.depth + 1 FROM w3 JOIN ae ON ae.src = w3.node AND ae.src <> ae.dst WHERE w3.depth < 3),
nr AS (SELECT root, node, min(depth) AS depth FROM w3 GROUP BY 1, 2 HAVING min(depth) > 0), rim AS (SELECT nr.* FROM nr JOIN ent b ON b.urn = nr.node AND (b.kind IN ('chart', 'dashboard') OR contains(b.urn, '.explore.')) WHERE nr.depth > 1),
h1 AS (SELECT DISTINCT rim.root, ae.dst AS node, rim.depth + 1 AS depth FROM rim JOIN ae ON ae.src = rim.node AND ae.src <> ae.dst), h2 AS (SELECT DISTINCT h1.root, ae.dst AS node, h1.depth + 1 AS depth FROM h1 JOIN ae ON ae.src = h1.node AND ae.src <> ae.dst),
bi AS (SELECT root, node, min(depth)::INTEGER AS depth FROM (SELECT * FROM nr UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) WHERE root <> node GROUP BY 1, 2)
"""
_BLAST = f""", tg AS (SELECT urn, bool_or(len(list_filter(tags, lambda x: {_pii("x")})) > 0) AS pii, bool_or(len(list_filter(tags, lambda x: contains(lower(x), 'critical'))) > 0) AS critical FROM fld GROUP BY 1),
bl AS (SELECT o.urn AS root, count(bi.node) AS n, count(*) FILTER (WHERE n.kind IN ('chart', 'dashboard')) AS dashboards, count(*) FILTER (WHERE tg.critical) AS critical_assets, count(*) FILTER (WHERE tg.pii) AS pii_assets,
  count(*) FILTER (WHERE bi.node IS NOT NULL AND n.urn IS NULL) AS unreadable_assets, count(DISTINCT CASE WHEN o.owner IS NOT NULL AND n.owner <> o.owner THEN n.owner END) AS cross_team_owners
  FROM ent o LEFT JOIN bi ON bi.root = o.urn LEFT JOIN ent n ON n.urn = bi.node LEFT JOIN tg ON tg.urn = bi.node WHERE o.deprecated GROUP BY 1)
"""

ORACLE = {
    "claim_unique": "SELECT 'unique(l_orderkey,l_linenumber)' AS claim, coalesce(sum(n), 0)::BIGINT AS violations FROM (SELECT count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "claim_unique_sample": "SELECT p_name, count(*) AS row_count FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1 ORDER BY p_name LIMIT 10",
    "claim_not_null": "SELECT 'not_null(o_orderstatus)' AS claim, count(*) FILTER (WHERE nullif(o_orderstatus, 'P') IS NULL) AS violations FROM orders",
    "claim_accepted_values": "SELECT 'accepted_values(o_orderstatus)' AS claim, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS violations FROM orders",
    "claim_expression": "SELECT 'expression(l_quantity)' AS claim, count(*) FILTER (WHERE NOT coalesce(l_quantity <= 40 AND l_discount < 0.08, false)) AS violations FROM lineitem",
    "claim_relationships": "SELECT 'relationships(l_orderkey)' AS claim, count(*) AS violations FROM lineitem WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_totalprice > 1000) UNION ALL SELECT 'relationships(doc_id)', count(*) FROM doc_label l WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.text IS NOT NULL)",
    "claims_fused": _FUSED_ROWS,
    "claim_status_report": f"""SELECT type, status, count(*) AS n, coalesce(sum(violations), 0)::BIGINT AS violations FROM (
  SELECT regexp_extract(claim, '^(\\w+)\\(', 1) AS type, CASE WHEN violations = 0 THEN 'holds' ELSE 'violated' END AS status, violations FROM ({_FUSED_ROWS})
  UNION ALL SELECT 'not_null', 'unverifiable', NULL
  UNION ALL SELECT 'unique', CASE WHEN v = 0 THEN 'holds' ELSE 'violated' END, v FROM (SELECT coalesce(sum(n), 0) AS v FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1))
  UNION ALL SELECT 'relationships', CASE WHEN v = 0 THEN 'holds' ELSE 'violated' END, v FROM (SELECT count(*) AS v FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))) GROUP BY 1, 2""",
    "claim_phrases": _PHRASED + "SELECT o_orderkey, type, (CASE WHEN o_orderkey % 8 = 3 THEN 3 ELSE 0 END)::INTEGER AS n_values FROM ty",
    "attestation_summary": _ATTESTED + "SELECT origin, type, count(*) FILTER (WHERE taken) AS n_taken, count(*) FILTER (WHERE NOT taken) AS n_declined FROM tk GROUP BY 1, 2",
    "attestation_budget": _ATTESTED + "SELECT urn, column_name, type, origin FROM tk WHERE taken",
    "claim_wording": r"""SELECT claim_type, count(*) AS n, count(*) FILTER (WHERE NOT regexp_matches(s, '\b(?:need not|may not be unique|not necessarily|optional(?:ly)?|can be null|nullable)\b') AND CASE claim_type
  WHEN 'unique' THEN regexp_matches(s, '\bunique\b|\bprimary key\b|\bone row per\b|\bidentif(?:y|ies)\b|\bnever repeats\b|\bkeyed by\b') WHEN 'not_null' THEN regexp_matches(s, '\bnot null\b|\brequired\b|\bmust be (?:present|set)\b|\bnever (?:be )?(?:null|empty|blank)\b|\bmandatory\b')
  WHEN 'accepted_values' THEN regexp_matches(s, '\bone of\b|\ballowed values?\b|\beither\b|\benum') WHEN 'relationships' THEN regexp_matches(s, '\brefer(?:s|ences)?\b|\bforeign key\b|\bmust match\b|\blinks?\b')
  WHEN 'expression' THEN regexp_matches(s, '[<>]=?|\bat least\b|\bat most\b|\bgreater\b|\bless\b|\bexceed\b|\bbetween\b') ELSE false END) AS n_expressed FROM (SELECT claim_type, lower(sentence) AS s FROM mine_claims_release WHERE claim_type IS NOT NULL AND sentence IS NOT NULL) GROUP BY 1""",
    "schema_gate": CATALOG + _REFS + """SELECT DISTINCT CASE WHEN ent.urn IS NULL THEN 'unknown_dataset' WHEN NOT schema_ok THEN 'schema_unverifiable' ELSE 'unknown_field' END AS kind, CASE WHEN ent.urn IS NULL OR NOT schema_ok THEN rf.urn ELSE concat(rf.urn, '#', rf.path) END AS subject
FROM rf LEFT JOIN ent ON ent.urn = rf.urn WHERE ent.urn IS NULL OR NOT schema_ok OR NOT EXISTS (SELECT 1 FROM fld WHERE fld.urn = rf.urn AND fld.path = rf.path)""",
    "schema_type_mismatch": CATALOG + _CHANGED + f" SELECT concat(lv.urn, '#', lv.path) AS subject FROM lv JOIN fld ON fld.urn = lv.urn AND fld.path = lv.path WHERE {_TOKEN.format(c='lv.native_type')} <> {_TOKEN.format(c='fld.native_type')}",
    "reality_diff": CATALOG + _CHANGED + f""", a AS (SELECT urn, {_FIELDTEXT} AS f FROM fld), b AS (SELECT urn, {_FIELDTEXT} AS f FROM lv),
x AS (SELECT urn, count(*) FILTER (WHERE f NOT IN (SELECT f FROM b WHERE b.urn = a.urn)) AS oc, count(*) AS nc FROM a GROUP BY urn), y AS (SELECT urn, count(*) FILTER (WHERE f NOT IN (SELECT f FROM a WHERE a.urn = b.urn)) AS ol, count(*) AS nl FROM b GROUP BY urn)
SELECT CASE WHEN nc IS NULL OR nl IS NULL THEN 'graph_unavailable' ELSE 'catalog_reality_mismatch' END AS kind, ent.urn AS subject, (CASE WHEN nc IS NOT NULL AND nl IS NOT NULL THEN oc ELSE 0 END)::INTEGER AS n_catalog, (CASE WHEN nc IS NOT NULL AND nl IS NOT NULL THEN ol ELSE 0 END)::INTEGER AS n_live
FROM ent LEFT JOIN x ON x.urn = ent.urn LEFT JOIN y ON y.urn = ent.urn WHERE ent.kind = 'dataset' AND (nc IS NULL OR nl IS NULL OR oc > 0 OR ol > 0)""",
    "blast_radius": CATALOG + f""", w AS (SELECT urn AS root, urn AS node, 0 AS depth FROM ent WHERE deprecated UNION SELECT w.root, ae.dst, w.depth + 1 FROM w JOIN ae ON ae.src = w.node AND ae.src <> ae.dst WHERE w.depth < 3),
r AS (SELECT root, node, min(depth) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) > 0)
SELECT r.root, count(*) AS n_assets, count(*) FILTER (WHERE n.kind IN ('chart', 'dashboard')) AS n_dashboards, count(*) FILTER (WHERE n.kind IS NULL) AS n_unreadable, count(DISTINCT CASE WHEN o.owner IS NOT NULL AND n.owner <> o.owner THEN n.owner END) AS n_other_teams,
  count(*) FILTER (WHERE r.node IN (SELECT urn FROM fld WHERE len(list_filter(tags, lambda x: {_pii("x")})) > 0)) AS n_pii, max(r.depth)::INTEGER AS depth FROM r LEFT JOIN ent n ON n.urn = r.node LEFT JOIN ent o ON o.urn = r.root GROUP BY r.root""",
    "blast_paths": DERIVED + ", p AS (SELECT urn AS root, urn AS node, 0 AS depth, urn AS path FROM ent WHERE deprecated AND urn LIKE 'cust:%' UNION ALL SELECT p.root, ae.dst, p.depth + 1, concat(p.path, '>', ae.dst) FROM p JOIN ae ON ae.src = p.node WHERE p.depth < 3) SELECT p.root, p.node, min(p.path) AS path FROM p JOIN ent ON ent.urn = p.node AND ent.kind IN ('chart', 'dashboard') GROUP BY 1, 2",
    "deprecated_upstream": CATALOG + _REFS + "SELECT rf.urn AS subject, count(DISTINCT rf.path)::INTEGER AS n_fields FROM rf JOIN ent ON ent.urn = rf.urn AND ent.deprecated GROUP BY 1",
    "unowned_asset": CATALOG + _REFS + "SELECT DISTINCT ent.urn AS subject FROM rf JOIN ent ON ent.urn = rf.urn AND ent.owner IS NULL",
    "field_delta": CATALOG + """, g AS (SELECT urn, coalesce(list(DISTINCT path) FILTER (WHERE length(path) % 2 = 0), []) AS nw, coalesce(list(DISTINCT path) FILTER (WHERE length(path) % 3 = 0), []) AS bf FROM fld GROUP BY urn),
h AS (SELECT urn, nw, bf, list_sort(list_filter(nw, lambda x: NOT list_contains(bf, x))) AS ad, list_sort(list_filter(bf, lambda x: NOT list_contains(nw, x))) AS rm FROM g)
SELECT urn, array_to_string(ad, ',') AS added, array_to_string(rm, ',') AS removed, array_to_string(list_sort(list_filter(list_distinct(list_concat(bf, ad)), lambda x: NOT list_contains(rm, x))), ',') AS after FROM h""",
    "doc_rot": _DOCUMENTED + "SELECT DISTINCT subject, mentioned FROM rot",
    "blast_evidence": CATALOG + _BI + _BLAST + "SELECT root AS subject, n AS count, dashboards, critical_assets, pii_assets, unreadable_assets, cross_team_owners FROM bl",
    "attributed_findings": CATALOG + f"SELECT DISTINCT CASE WHEN side = 'source' THEN dst ELSE src END AS urn, 'orphan_lineage' AS kind FROM ({_ORPHAN}) WHERE src <> dst UNION SELECT subject, 'unowned_consumed' FROM ({_UNOWNED})",
    "check_change": CATALOG + _REFS + _CHANGED + _BI + ", " + _DOCUMENTED.removeprefix("WITH ") + f""", cr AS (SELECT rf.* FROM rf JOIN ent ON ent.urn = rf.urn AND ent.deprecated),
cp AS (SELECT src, src_field, dst, dst_field FROM edg WHERE (length(src) + length(dst)) % 5 <> 0 UNION SELECT dst, dst_field, src, src_field FROM edg WHERE length(src) % 7 = 0),
e1 AS (SELECT * FROM edg WHERE src_field IS NOT NULL AND dst_field IS NOT NULL AND dst IN (SELECT urn FROM cr)), e2 AS (SELECT * FROM cp WHERE src_field IS NOT NULL AND dst_field IS NOT NULL AND dst IN (SELECT urn FROM cr)),
a AS (SELECT urn, {_FIELDTEXT} AS f FROM fld), b AS (SELECT urn, {_FIELDTEXT} AS f FROM lv),
x AS (SELECT urn, count(*) FILTER (WHERE f NOT IN (SELECT f FROM b WHERE b.urn = a.urn)) AS oc, count(*) AS nc FROM a GROUP BY urn), y AS (SELECT urn, count(*) FILTER (WHERE f NOT IN (SELECT f FROM a WHERE a.urn = b.urn)) AS ol, count(*) AS nl FROM b GROUP BY urn),
ev AS (
  SELECT DISTINCT CASE WHEN NOT schema_ok THEN 'schema_unverifiable' ELSE 'unknown_field' END AS kind, CASE WHEN NOT schema_ok THEN cr.urn ELSE concat(cr.urn, '#', cr.path) END AS subject, '' AS more
    FROM cr JOIN ent ON ent.urn = cr.urn WHERE NOT schema_ok OR NOT EXISTS (SELECT 1 FROM fld WHERE fld.urn = cr.urn AND fld.path = cr.path)
  UNION ALL SELECT DISTINCT 'deprecated_upstream', urn, '' FROM cr
  UNION ALL SELECT DISTINCT 'unowned_asset', cr.urn, '' FROM cr JOIN ent ON ent.urn = cr.urn AND ent.owner IS NULL
  UNION ALL SELECT DISTINCT 'blast_radius', urn, '' FROM cr
  UNION ALL SELECT CASE WHEN nc IS NULL OR nl IS NULL THEN 'graph_unavailable' ELSE 'catalog_reality_mismatch' END, c.urn, '' FROM (SELECT DISTINCT urn FROM cr) c LEFT JOIN x ON x.urn = c.urn LEFT JOIN y ON y.urn = c.urn WHERE nc IS NULL OR nl IS NULL OR oc > 0 OR ol > 0
  UNION ALL SELECT DISTINCT 'doc_rot', subject, mentioned FROM rot
  UNION ALL SELECT 'lineage_rot_missing', concat(dst, '#', dst_field), concat(src, '#', src_field) FROM (SELECT src, src_field, dst, dst_field FROM e1 EXCEPT SELECT * FROM e2)
  UNION ALL SELECT 'lineage_rot_extra', concat(dst, '#', dst_field), concat(src, '#', src_field) FROM (SELECT * FROM e2 EXCEPT SELECT src, src_field, dst, dst_field FROM e1))
SELECT kind, count(*) AS n, count(DISTINCT subject) AS n_subjects FROM ev GROUP BY 1""",
    "lineage_rot_diff": CATALOG + """, cp AS (SELECT src, src_field, dst, dst_field FROM edg WHERE (length(src) + length(dst)) % 5 <> 0 UNION SELECT dst, dst_field, src, src_field FROM edg WHERE length(src) % 7 = 0)
SELECT 'lineage_rot_missing' AS kind, * FROM (SELECT src, src_field, dst, dst_field FROM edg EXCEPT SELECT * FROM cp) UNION ALL SELECT 'lineage_rot_extra', * FROM (SELECT * FROM cp EXCEPT SELECT src, src_field, dst, dst_field FROM edg)""",
    "lineage_source_resolve": CATALOG + f""", re AS (SELECT urn, {_REL} AS relation FROM ent), sx AS (SELECT urn, unnest(list_transform(range(1, len(string_split(relation, '.')) + 1), lambda n: array_to_string(string_split(lower(relation), '.')[-n:], '.'))) AS k FROM re WHERE relation IS NOT NULL),
nm AS (SELECT DISTINCT name FROM (SELECT table_name AS name FROM mine_claims_release UNION SELECT relation FROM re UNION SELECT string_split(relation, '.')[-1] FROM re) WHERE name IS NOT NULL)
SELECT name, CASE WHEN count(DISTINCT urn) = 1 THEN min(urn) END AS urn, CASE count(DISTINCT urn) WHEN 1 THEN 'resolved' WHEN 0 THEN 'unknown' ELSE 'ambiguous' END AS status FROM nm LEFT JOIN sx ON sx.k = lower(nm.name) GROUP BY name""",
    "policy_findings": _EVIDENCE + "SELECT ord, rule_id, severity, reason_code, message FROM fi",
    "policy_rule_match": _EVIDENCE + "SELECT rule_id, severity, count(*) AS n FROM fi GROUP BY 1, 2",
    "policy_verdict": _EVIDENCE + f"SELECT ord % 50 AS team, {_VERDICT}, count(*) AS n_findings FROM fi GROUP BY 1",
    "verdict_combine": _EVIDENCE + f", tv AS (SELECT ord % 50 AS team, {_VERDICT} FROM fi WHERE kind IN ('blast_radius', 'unowned_asset') GROUP BY 1) SELECT CASE max(CASE decision WHEN 'BLOCK' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'BLOCK' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS decision, arg_min(reason_code, team) FILTER (WHERE decision = 'BLOCK' AND reason_code IS NOT NULL) AS reason_code, count(*) AS n FROM tv",
    "policy_ops_matrix": _EVIDENCE + " UNION ALL ".join(
        f"SELECT '{c}' AS condition, count(*) FILTER (WHERE {w}) AS n FROM ev"
        for c, w in (("detail.count eq", "cnt = 10"), ("detail.count ne", "cnt <> 10"), ("detail.count gt", "cnt > 9"), ("detail.count gte", "cnt >= 9"), ("detail.count lt", "cnt < 9"), ("detail.count lte", "cnt <= 9"), ("detail.count in", "cnt IN (8, 9)"),
                     ("detail.nothing ne", "false"), ("detail.nothing empty", "true"), ("detail.count not_empty", "true"), ("subject contains", "contains(subject, '7')"))
    ),
    "latest_receipt": _LOGSQL + "SELECT urn, verdict, event_id FROM lt",
    "receipt_status": _LOGSQL + f"SELECT q.urn, lt.verdict FROM ({_ASKED}) q LEFT JOIN lt ON lt.urn = q.urn",
    "receipt_staleness": _LOGSQL + "SELECT coalesce(reason, 'current') AS reason, count(*) AS n FROM st GROUP BY 1",
    "receipt_judgment": _LOGSQL + """, jd AS (SELECT lt.urn, lt.verdict, CASE WHEN lt.verdict = 'UNKNOWN' THEN 'INVALID' WHEN st.reason IS NOT NULL AND lt.event_id % 2 = 0 THEN 'STALE' ELSE 'CURRENT' END AS state FROM lt JOIN st ON st.event_id = lt.event_id)
SELECT urn, state, CASE WHEN state <> 'CURRENT' THEN 'RECHECK' WHEN verdict = 'BLOCK' THEN 'STOP' WHEN verdict = 'WARN' THEN 'REVIEW_OR_ESCALATE' ELSE 'CONTINUE' END AS action FROM jd""",
    "swarm_ledger": _LOGSQL + "SELECT coalesce(worker_id, 'unattributed') AS worker_id, count(*) AS n_receipts, count(DISTINCT urn) AS n_assets FROM lg WHERE swarm_run = 'run2' GROUP BY 1",
    "search_classification": _LOGSQL + f""", q AS (SELECT q.urn, lt.verdict, CASE WHEN lt.verdict IS NULL THEN 'never' WHEN lt.verdict = 'UNKNOWN' THEN 'tampered' WHEN floor(epoch(TIMESTAMP '2024-01-30')) - floor(epoch(lt.checked_at)) > 86400 THEN 'expired' END AS reason FROM ({_ASKED}) q LEFT JOIN lt ON lt.urn = q.urn)
SELECT urn, CASE WHEN reason IS NOT NULL THEN 'unverified' WHEN verdict = 'BLOCK' THEN 'rejected' ELSE 'verified' END AS class, reason FROM q""",
    "receipt_badges": _LOGSQL + "SELECT CASE WHEN verdict IN ('PASS', 'WARN') THEN 'verified' WHEN verdict = 'BLOCK' THEN 'blocked' ELSE 'none' END AS badge, count(*) AS n FROM lt GROUP BY 1",
    "signed_log": "SELECT event_id % 7 <> 0 AS intact, count(*) AS n FROM events GROUP BY 1",
    "bi_hops": CATALOG + _BI + "SELECT root, node, depth FROM bi",
    "asset_lookup": CATALOG + f""", re AS (SELECT urn, kind, owner, lower({_REL}) AS rel FROM ent), kk AS (SELECT DISTINCT urn, kind, owner, unnest(list_concat([urn], CASE WHEN rel IS NULL THEN [] ELSE list_transform(range(1, len(string_split(rel, '.')) + 1), lambda n: array_to_string(string_split(rel, '.')[-n:], '.')) END)) AS k FROM re),
nm AS (SELECT DISTINCT name FROM (SELECT target_urn AS name FROM cat_edge UNION SELECT string_split({_REL}, '.')[-1] FROM ent) WHERE name IS NOT NULL)
SELECT nm.name, kk.urn, kk.kind, kk.owner, (SELECT count(*) FROM fld WHERE fld.urn = kk.urn) AS n_fields FROM nm JOIN kk ON kk.k = {key("nm.name")}""",
    "time_parse": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at FROM events",
    "audit_plan": CATALOG + _PLAN + "SELECT urn, score, position FROM pl",
    "audit_budget": CATALOG + _PLAN + "SELECT position <= 25 AS examined, count(*) AS n, sum(score)::BIGINT AS score FROM pl GROUP BY 1",
    "audit_resume": CATALOG + _PLAN + "SELECT urn, score, position FROM pl WHERE urn NOT IN (SELECT urn FROM ent WHERE owner IS NOT NULL AND length(urn) % 2 = 0)",
    "swarm_rotation": CATALOG + _PLAN + ", k AS (SELECT count(*) AS n FROM pl) SELECT urn, ((position - 1 - ('0x' || substr(sha256('worker-3'), 1, 8))::BIGINT % n + n) % n)::BIGINT AS turn FROM pl, k",
    "repair_owner": DERIVED + _OWNER,
    "repair_owner_catalog": CATALOG + _OWNER,
    "repair_tags": CATALOG + _LEAKS + "SELECT urn, path, tag FROM fix",
}

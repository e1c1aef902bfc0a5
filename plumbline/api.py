"""Entry points over whole snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import audit as au
from plumbline.operators import change, policy, receipts, self_check
from plumbline.operators.graph import neighbours
from plumbline.operators.snapshot import Snapshot
from plumbline.schemas import union


def _numbered(evidence: DataFrame) -> DataFrame:
    """Evidence in a fixed order: by kind, subject and detail."""
    from plumbline.operators.ranking import global_position

    return global_position(evidence, F.col("kind"), F.col("subject"), F.col("detail"), name="ord")


def change_evidence(
    s: Snapshot, refs: DataFrame, live: DataFrame | None = None, docs: DataFrame | None = None, computed: DataFrame | None = None, depth: int = 3
) -> DataFrame:
    """All gates of a change that refers to refs(urn, path): schema, governance and blast radius always; the live schema, the
    documentation after the change (docs as in ``change.doc_rot``) and the computed lineage where they are given."""
    urns = refs.select("urn").distinct()
    known = urns.join(s.entity.select("urn"), "urn", "left_semi")
    parts = [change.schema_gate(s, refs), change.deprecated_upstream(s, refs), change.unowned_asset(s, urns), change.blast_evidence(s, known.select(F.col("urn").alias("root")), depth)]
    if live is not None:
        parts.append(change.reality_diff(s, live, known))
    if docs is not None:
        parts.append(change.doc_rot(docs))
    if computed is not None:
        parts.append(change.lineage_rot(s, computed, known))
    return union(*parts)


def check(s: Snapshot, refs: DataFrame, rules: policy.Policy | None = None, **sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and verdict of a change; ``sources`` as in ``change_evidence``."""
    found = policy.findings(_numbered(change_evidence(s, refs, **sources)), rules or policy.load())
    return found, policy.verdict(found)


def audit(s: Snapshot, budget: int, log: DataFrame | None = None) -> DataFrame:
    """Transcript of a budgeted audit of the whole catalog."""
    prior = receipts.latest(log) if log is not None else s.entity.sparkSession.createDataFrame([], "urn string, verdict string")
    return au.run(au.plan(s), neighbours(s.asset_edges), self_check.attributed(s, self_check.run_all(s, paths=False)), prior, budget)


def verify_context(s: Snapshot, live: DataFrame, urns: DataFrame, computed: DataFrame | None = None, reconciled: DataFrame | None = None) -> DataFrame:
    """(urn, truthful): no finding and no gap for the asset. ``computed`` lineage and ``reconciled`` constraints, rows (relation, state)
    with the urn as relation, count where they are given."""
    e = change.reality_diff(s, live, urns).unionByName(self_check.run_all(s, paths=False))
    if computed is not None:
        e = e.unionByName(change.lineage_rot(s, computed, urns))
    bad = self_check.attributed(s, e).select("urn")
    if reconciled is not None:
        bad = bad.unionByName(reconciled.where("state in ('contradicts', 'unverifiable')").select(F.col("relation").alias("urn")))
    return urns.select("urn").distinct().join(bad.distinct().withColumn("_bad", F.lit(True)), "urn", "left").select("urn", F.col("_bad").isNull().alias("truthful"))

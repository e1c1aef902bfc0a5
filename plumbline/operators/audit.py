"""Which assets to look at first, and a budgeted run over them."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.hashing import rotated
from plumbline.functions.names import is_pii_tag
from plumbline.operators.ranking import global_position
from plumbline.operators.snapshot import Snapshot
from plumbline.session import cut, tidy

#: What makes an asset consequential.
WEIGHTS = {"edges": 10, "pii": 50, "unowned": 15, "deprecated": 20, "no_schema": 25}
#: Findings that make the neighbours of an asset suspect (fixed values).
CONTAGIOUS = ("pii_leak_untagged", "lineage_field_missing", "orphan_lineage", "deprecated_upstream_of_live")
#: Verdicts of the outcomes that a run establishes.
VERDICT_OF = {"finding": "WARN", "clean": "PASS"}


def plan(s: Snapshot) -> DataFrame:
    """(urn, score, position): every dataset by consequence, ties by urn. Edges are counted as they are stated, column edges each for itself."""
    down = s.edge.groupBy(F.col("src").alias("urn")).agg(F.count("*").alias("_n"))
    pii = s.field.where(F.exists("tags", is_pii_tag)).select("urn", F.lit(1).alias("_pii")).distinct()
    w = WEIGHTS
    one = lambda c: c.cast("int")
    score = w["edges"] * F.coalesce("_n", F.lit(0)) + w["pii"] * F.coalesce("_pii", F.lit(0)) + w["unowned"] * one(F.col("owner").isNull()) + w["deprecated"] * one(F.col("deprecated")) + w["no_schema"] * one(~F.col("schema_ok"))
    scored = s.entity.where("kind = 'dataset'").join(down, "urn", "left").join(pii, "urn", "left").select("urn", score.cast("long").alias("score"))
    return global_position(scored, F.desc("score"), F.col("urn"))


def split_by_budget(planned: DataFrame, budget: int) -> DataFrame:
    return planned.withColumn("examined", F.col("position") <= budget)


def resume(planned: DataFrame, covered: DataFrame) -> DataFrame:
    """What is left once assets with a current receipt are taken out."""
    return planned.join(covered.select("urn").distinct(), "urn", "left_anti")


def rotation(planned: DataFrame, worker: str) -> DataFrame:
    """The plan as a worker of a swarm starts it."""
    n = planned.count()
    return planned.select("urn", rotated(F.col("position") - 1, F.lit(worker), F.lit(max(1, n)).cast("long")).alias("turn"))


def run(planned: DataFrame, neighbours: DataFrame, findings: DataFrame, receipts: DataFrame, budget: int) -> DataFrame:
    """Replay of the budgeted, feedback-driven audit.

    findings(urn, kind), as ``self_check.attributed`` gives them, are computed before, for all assets at once; the queue itself is a sequence and runs on the driver over names
    of the plan, at most ``budget`` of which are examined. An asset with a current receipt is vouched for or refused and costs nothing; a
    contagious finding moves the neighbours that were not seen to the front, the last of them first. An asset of which nothing is known
    but that a check could not be made is ``unestablished``.
    """
    with tidy(planned.sparkSession):
        planned = cut(planned)
        prior = {r["urn"]: r["verdict"] for r in receipts.select("urn", "verdict").collect()}
        rows = _replay(_order(planned), prior, _kinds(findings), Near(neighbours, planned), budget)
    return planned.sparkSession.createDataFrame(rows, "step int, urn string, outcome string, n_kinds int")


def _order(planned: DataFrame) -> list[str]:
    return [r["urn"] for r in planned.orderBy("position").select("urn").collect()]


def _kinds(findings: DataFrame) -> dict[str, set]:
    return {r["urn"]: set(r["kinds"]) for r in findings.groupBy("urn").agg(F.collect_set("kind").alias("kinds")).collect()}


class Near:
    """Neighbours of one asset at a time, sorted by node so that a look reads little; only of examined assets with a contagious finding, of which
    there are no more than the budget, while the neighbours of all such assets may be most of the graph. A pair counts both ways. Assets stand
    as their positions in the plan, since no other is examined."""

    def __init__(self, neighbours: DataFrame, planned: DataFrame):
        self.names = {r["position"]: r["urn"] for r in planned.select("position", "urn").collect()}
        self.at = {u: p for p, u in self.names.items()}
        at = lambda c: planned.select(F.col("urn").alias(c), F.col("position").alias(f"_{c}"))
        one = neighbours.select("node", "neighbour").where("node <> neighbour").join(at("node"), "node").join(at("neighbour"), "neighbour").select("_node", "_neighbour").distinct()
        both = one.select(F.explode(F.array(F.struct(F.col("_node").alias("node"), F.col("_neighbour").alias("neighbour")), F.struct(F.col("_neighbour").alias("node"), F.col("_node").alias("neighbour")))).alias("p")).select("p.*")
        self.table = cut(both.repartitionByRange("node").sortWithinPartitions("node"))
        self.known: dict[str, list[str]] = {}

    def __call__(self, u: str) -> list[str]:
        if u not in self.known:
            self.known[u] = sorted({self.names[r["neighbour"]] for r in self.table.where(F.col("node") == self.at[u]).select("neighbour").collect()})
        return self.known[u]


def _replay(order: list[str], prior: dict[str, str], bad: dict[str, set], near: Callable[[str], list[str]], budget: int) -> list[tuple]:
    known, queue, seen, rows, spent = set(order), deque(order), set(), [], 0
    while queue:
        u = queue.popleft()
        if u in seen:
            continue
        seen.add(u)
        if u in prior:
            rows.append((len(rows), u, "refused" if prior[u] == "BLOCK" else "vouched", 0))
        elif spent >= budget:
            rows.append((len(rows), u, "deferred", 0))
        else:
            spent += 1
            kinds = bad.get(u, set())
            blind = kinds and all(k.endswith("_unverifiable") for k in kinds)
            rows.append((len(rows), u, "unestablished" if blind else "finding" if kinds else "clean", len(kinds)))
            if kinds & set(CONTAGIOUS):
                queue.extendleft(x for x in near(u) if x in known and x not in seen)
    return rows


def summary(transcript: DataFrame) -> DataFrame:
    return transcript.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("n_kinds").alias("n_kinds"))


def run_receipts(transcript: DataFrame) -> DataFrame:
    """(urn, verdict) of the assets that a run established: what was deferred, vouched for or could not be checked gets no receipt."""
    verdict = F.create_map(*(F.lit(x) for pair in VERDICT_OF.items() for x in pair))
    return transcript.where(F.col("outcome").isin(*VERDICT_OF)).select("urn", verdict[F.col("outcome")].alias("verdict"))


def swarm(planned: DataFrame, neighbours: DataFrame, findings: DataFrame, workers: list[str], budget: int) -> DataFrame:
    """Workers one after the other, each from its own place in the plan, each seeing the receipts of those before it: (worker, step, urn, outcome, n_kinds)."""
    bad, near, done, rows = _kinds(findings), Near(neighbours, planned), {}, []  # read once for all workers
    for w in workers:
        turn = rotation(planned, w).select("urn", (F.col("turn") + 1).alias("position"))
        got = _replay(_order(turn), done, bad, near, budget)
        rows += ((w, *x) for x in got)
        done |= {u: VERDICT_OF[outcome] for _, u, outcome, _ in got if outcome in VERDICT_OF}
    return planned.sparkSession.createDataFrame(rows, "worker string, step int, urn string, outcome string, n_kinds int")

"""A sample whose categories have given shares.

Allocation runs top-down over a category tree (mix, group, category). The mix's quota is the size of its sample; it is divided over the
groups by the shares of their categories, and a group's quota over its categories, by largest remainders and never below the minima that
the rows at hand allow. If the minima of a mix add up to more than its sample, the minima win and the excess is reported (``over``).
Where a category has fewer rows than its quota, what is missing is first given to its siblings (the other categories of its group) in
proportion to what they have left, and what they cannot take to its cousins (the categories of the mix's other groups). What nobody can
take is reported (``unmet``). So a sample has exactly ``max(sample_rows, minima)`` rows wherever there are as many.

The tree is an argument, a table of (category, parent). Without one it comes from the names of a mix's categories: those that have a word
in common are siblings.

The draw takes, within each leaf, the rows with the smallest ranks of a seeded permutation. The permutation is a hash; the rank is dense
and global, but no leaf is ever sorted as a whole: rows are counted per hash bucket, the counts of the buckets give each bucket's first
rank, and ranks are only worked out within buckets, so a leaf with a third of all rows is spread over all tasks.

Defined cases: null keys take no part; a row id counts once per leaf; the categories of a mix that the data lack have no rows at hand and are
unmet if anything is asked of them; categories of the data that no mix names are not drawn; a null category of ``source_kind`` is none,
a null claim is ``no_claim``, null shares and sizes ask for nothing, a claim with a null or blank type is none; empty tables leave all quotas unmet.
"""

from __future__ import annotations

import re
from fractions import Fraction
from math import ceil, isfinite

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.session import cut, table

#: Rows of a leaf in a bucket of the draw, about.
BUCKET_ROWS = 50_000


def name_groups(categories: list[str]) -> dict[str, str]:
    """category -> parent: names that share a word (directly or through others) have one parent, the least of them."""
    root = {c: c for c in categories}

    def find(c: str) -> str:
        while root[c] != c:
            c = root[c]
        return c

    first: dict[str, str] = {}
    for c in sorted(categories):
        for w in re.findall(r"[^\W_]{3,}", c.lower()):
            a, b = find(first.setdefault(w, c)), find(c)
            root[max(a, b)] = min(a, b)
    return {c: find(c) for c in categories}


def apportion(total: int, share: dict[str, Fraction], floor: dict[str, int]) -> dict[str, int]:
    """``total`` divided by shares, none below its floor, by largest remainders (ties by name); the floors, if they are more than that."""
    out, active = dict(floor), {c for c, s in share.items() if s > 0}
    if total <= sum(floor.values()):
        return out
    while active:
        rest, whole = total - sum(f for c, f in floor.items() if c not in active), sum(share[c] for c in active)
        below = {c for c in active if rest * share[c] / whole < floor[c]}
        if not below:
            exact = {c: rest * share[c] / whole for c in active}
            out |= {c: int(x) for c, x in exact.items()}
            left = total - sum(out.values())
            for c in sorted(active, key=lambda c: (int(exact[c]) - exact[c], c))[:left]:
                out[c] += 1
            return out
        active -= below
    return out


def _fill(open_: dict[str, int], spare: dict[str, int], amount: int) -> int:
    """Hand ``amount`` out to categories in proportion to ``spare`` (largest remainders last by name); returns what is left over."""
    for _ in range(2):
        total = sum(spare.values())
        if amount <= 0 or not total:
            break
        give = min(amount, total)
        parts = {c: give * s // total for c, s in spare.items()}
        rest = give - sum(parts.values())
        for c in sorted(spare, key=lambda c: (-(give * spare[c] % total), c)):
            if rest > 0 and parts[c] < spare[c]:
                parts[c] += 1
                rest -= 1
        for c, p in parts.items():
            open_[c] += p
            spare[c] -= p
        amount -= give - rest
    return amount


def allocate(asked: list[dict], at_hand: dict[str, int], groups: dict[str, str] | None = None) -> list[dict]:
    """One mix: asked rows (category, target_share, min_rows, sample_rows) -> a row per category.

    ``needed`` is what the category asks for by itself, ``quota`` what the tree gives it, ``drawn`` what it gets in the end; ``lacking`` is
    what it has too little of for ``needed``, ``unmet`` the part of its quota that nobody could take over.
    """
    need, share, least, sample = {}, {}, {}, 0
    for r in asked:
        c, s = r["category"], r["target_share"]
        part = Fraction(repr(s)) if s is not None and isfinite(s) and s > 0 else Fraction(0)
        need[c] = max(ceil(part * (r["sample_rows"] or 0)), r["min_rows"] or 0, need.get(c, 0))
        share[c], least[c] = max(part, share.get(c, Fraction(0))), max(r["min_rows"] or 0, least.get(c, 0))
        sample = max(sample, r["sample_rows"] or 0)
    have = {c: at_hand.get(c, 0) for c in need}
    parent = name_groups(list(need)) if groups is None else {c: groups.get(c) or c for c in need}
    floor = {c: min(least[c], have[c]) for c in need}
    kin = {g: [c for c in need if parent[c] == g] for g in sorted(set(parent.values()))}
    goal = sample if any(share.values()) else 0
    per_group = apportion(goal, {g: sum((share[c] for c in cs), Fraction(0)) for g, cs in kin.items()}, {g: sum(floor[c] for c in cs) for g, cs in kin.items()})
    quota = {c: q for g, cs in kin.items() for c, q in apportion(per_group[g], {c: share[c] for c in cs}, {c: floor[c] for c in cs}).items()}
    draw = {c: min(quota[c], have[c]) for c in need}
    spare = {c: have[c] - draw[c] for c in need}
    short = {c: quota[c] - draw[c] for c in need}
    unmet = {}
    for near in (True, False):  # all siblings before any cousin
        for c in sorted(need, key=lambda c: (short[c], c)):
            takers = {k: spare[k] for k in need if k != c and (parent[k] == parent[c]) == near}
            short[c] = unmet[c] = _fill(draw, takers, short[c])
            spare.update(takers)
    over = max(0, sum(floor.values()) - sample)
    return [
        {"category": c, "parent": parent[c], "needed": need[c], "quota": quota[c], "at_hand": have[c], "drawn": draw[c], "lacking": max(0, need[c] - have[c]), "unmet": unmet[c], "over": over} for c in need
    ]


_PLAN = T.StructType([T.StructField(n, T.StringType()) for n in ("mix_name", "field_name", "category", "parent")] + [T.StructField(n, T.LongType()) for n in ("needed", "quota", "at_hand", "drawn", "lacking", "unmet", "over")])


def plan_mixes(spark: SparkSession, leaves: DataFrame, targets: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """leaves(field_name, category, row_id) x targets, tree(category, parent) -> the allocation of every mix, one row per category (a few dozen rows)."""
    counts = {(r["field_name"], r["category"]): r["n"] for r in leaves.join(F.broadcast(targets.select("field_name", "category").distinct()), ["field_name", "category"], "left_semi").groupBy("field_name", "category").agg(F.count("*").alias("n")).collect()}
    mixes: dict[tuple, list] = {}
    for r in sorted({(r["mix_name"], r["field_name"], r["category"], r["target_share"], r["min_rows"], r["sample_rows"]) for r in targets.collect() if r["category"] is not None}, key=str):
        mixes.setdefault(r[:2], []).append(dict(zip(("category", "target_share", "min_rows", "sample_rows"), r[2:])))
    asked_for = targets.select("category").distinct()
    groups = None if tree is None else {r["category"]: r["parent"] for r in tree.join(F.broadcast(asked_for), "category", "left_semi").collect()}
    rows = []
    for (mix, field), asked in mixes.items():
        rows += [{"mix_name": mix, "field_name": field} | x for x in allocate(asked, {c: n for (f, c), n in counts.items() if f == field}, groups)]
    return spark.createDataFrame([tuple(r[f.name] for f in _PLAN) for r in rows], _PLAN)


def draw(leaves: DataFrame, plan: DataFrame, seed: int = 11) -> DataFrame:
    """(mix_name, category, row_id, draw_rank): of each leaf the ``drawn`` first rows in the order of a permutation seeded per mix."""
    most = plan.agg(F.coalesce(F.max("at_hand"), F.lit(0))).first()[0]
    bits = max(6, (most // BUCKET_ROWS).bit_length())
    wanted = F.broadcast(plan.where("drawn > 0").select("mix_name", "field_name", "category", "drawn"))  # a row per category of a mix
    rows = leaves.join(wanted, ["field_name", "category"]).withColumn("_h", F.xxhash64(F.lit(seed), "mix_name", "row_id"))
    rows = rows.withColumn("_b", F.shiftrightunsigned("_h", 64 - bits))
    per = rows.groupBy("mix_name", "category", "_b").agg(F.count("*").alias("n"))  # a row per bucket of BUCKET_ROWS rows
    before = F.coalesce(F.sum("n").over(Window.partitionBy("mix_name", "category").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = per.withColumn("_before", before).select("mix_name", "category", "_b", "_before")
    near = rows.join(first, ["mix_name", "category", "_b"]).where(F.col("_before") < F.col("drawn"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("mix_name", "category", "_b").orderBy("_h", "row_id"))
    return near.withColumn("draw_rank", rank).where(F.col("draw_rank") <= F.col("drawn")).select("mix_name", "category", "row_id", "draw_rank")


def _tidy(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$", ""))


def category_rows(claims: DataFrame, progress: DataFrame) -> DataFrame:
    """The rows that can be drawn: (field_name, category, row_id), a row id once per category."""
    records = progress.select("model", "run", F.explode("records").alias("_r")).where(F.col("_r").isNotNull() & F.col("_r.item_index").isNotNull() & F.col("model").isNotNull() & F.col("run").isNotNull())
    kind = F.when(F.col("_r.claim").isNull(), F.lit("no_claim")).otherwise(_tidy(F.col("_r.claim.type")))
    of_type = records.select(F.lit("progress.records.claim.type").alias("field_name"), kind.alias("category"), F.concat_ws("|", "model", "run", F.col("_r.item_index").cast("string")).alias("row_id"))
    of_kind = claims.select(F.lit("mine_claims_release.source_kind").alias("field_name"), _tidy(F.col("source_kind")).alias("category"), F.col("record_id").cast("string").alias("row_id"))
    both = of_type.unionByName(of_kind).where(F.col("category").isNotNull() & (F.col("category") != "") & F.col("row_id").isNotNull())
    return both.distinct()


def _prepared(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    leaves = cut(category_rows(table(spark, d, "mine_claims_release"), table(spark, d, "progress")))
    return leaves, plan_mixes(spark, leaves, table(spark, d, "mix_target"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Categories that cannot be filled."""
    return _prepared(spark, d)[1].where("lacking > 0").select("mix_name", "category")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """The allocation: what each category needs, has and gets, and what nobody could take over."""
    return _prepared(spark, d)[1]


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn rows of all mixes."""
    return draw(*_prepared(spark, d))


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per mix: the size asked, the rows that were drawn, and by how many the minima exceed the size."""
    leaves, plan = _prepared(spark, d)
    drawn = draw(leaves, plan).groupBy("mix_name").agg(F.count("*").alias("n_drawn"))
    asked = table(spark, d, "mix_target").groupBy("mix_name").agg(F.max("sample_rows").alias("sample_rows"))
    over = plan.groupBy("mix_name").agg(F.max("over").alias("over"))
    return asked.join(drawn, "mix_name", "left").join(over, "mix_name").select("mix_name", "sample_rows", F.coalesce("n_drawn", F.lit(0).cast("long")).alias("n_drawn"), "over")


QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_sample": p4_sample, "p4_totals": p4_totals}

_LEAVES = r"""
WITH leaf AS (
  SELECT DISTINCT 'progress.records.claim.type' AS field_name, CASE WHEN r.claim IS NULL THEN 'no_claim' ELSE lower(regexp_replace(r.claim.type, '^\s+|\s+$', '', 'g')) END AS category, concat_ws('|', model, run, r.item_index) AS row_id
  FROM (SELECT model, run, unnest(records) AS r FROM progress) WHERE r.item_index IS NOT NULL AND model IS NOT NULL AND run IS NOT NULL
  UNION SELECT 'mine_claims_release.source_kind', lower(regexp_replace(source_kind, '^\s+|\s+$', '', 'g')), CAST(record_id AS VARCHAR) FROM mine_claims_release WHERE record_id IS NOT NULL),
n AS (SELECT field_name, category, count(*) AS n FROM leaf GROUP BY ALL)
"""
ORACLE = {
    "p4_found": _LEAVES + """SELECT DISTINCT m.mix_name, m.category FROM mix_target m LEFT JOIN n ON n.field_name = m.field_name AND n.category = m.category
WHERE coalesce(n.n, 0) < greatest(ceil(CAST(m.target_share AS DECIMAL(18, 9)) * m.sample_rows), m.min_rows)""",
    "p4_totals": _LEAVES + """, c AS (SELECT m.mix_name, m.category, max(m.sample_rows) AS sample_rows, max(coalesce(n.n, 0)) AS have, least(max(m.min_rows), max(coalesce(n.n, 0))) AS least_rows
  FROM mix_target m LEFT JOIN n ON n.field_name = m.field_name AND n.category = m.category GROUP BY 1, 2)
SELECT mix_name, max(sample_rows) AS sample_rows, CAST(least(sum(have), greatest(max(sample_rows), sum(least_rows))) AS BIGINT) AS n_drawn, CAST(greatest(0, sum(least_rows) - max(sample_rows)) AS BIGINT) AS over FROM c GROUP BY 1""",
}

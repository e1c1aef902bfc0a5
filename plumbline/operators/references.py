"""References to records that do not exist: which references dangle, and which records hang on a dangling one.

A *record* lives in a table, has a key, and is there during one or more lifetimes ``[start_at, end_at)`` (a null end is open, a null
start means since ever). A *reference* is a record's statement, made at a time, that a key of another table is there. The operator

1. normalises the spelling of the keys,
2. decides every reference against the lifetimes of its key (``held``, ``missing``, ``deleted`` or ``late``),
3. and runs the cascade: what makes a reference that is not held is a *direct* orphan; what refers to an orphan is an *inherited*
   one, found by semi-joins down the reference graph until nothing new turns up. A record is one lifetime of a key, so an orphaned
   lifetime says nothing of references that rest on another lifetime of the same key.

Defined cases: a null or blank key, a key that is blank once its annotations are gone, or a null time makes no case; repeated rows count
once; of several deliveries of one edge the last ingested counts (ties: the greatest row); empty tables give no rows where they refer and
only ``missing`` where they are referred to; other columns of the inputs, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut

#: Blanks at the outside of a key: white space, separators, invisible format characters.
BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0xAD, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]))
_QUOTES = "[\"'`“”‘’]"


def _asset(c: Column) -> Column:
    return F.lower(F.btrim(F.when(c.rlike(_QUOTES), F.regexp_replace(c, _QUOTES, "")).otherwise(c), F.lit(BLANKS)))


def asset_key(c: Column) -> Column:
    """Canonical spelling of an asset name: outer blanks, quotes and letter case are spelling, all parts of the name are kept."""
    return F.nullif(_asset(c), F.lit(""))


def field_key(c: Column) -> Column:
    """Canonical spelling of a field path: as for assets, and bracketed annotations with their dots are dropped."""
    return F.nullif(_field(c), F.lit(""))


def _field(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(_asset(c), r"\[[^\]]*\]", ""), r"\.{2,}", ".")
    return F.btrim(F.btrim(bare, F.lit(".")), F.lit(BLANKS))


def has_key(c: Column) -> Column:
    """Whether ``asset_key`` gives a key: there is a character besides blanks and quotes. Costs a look at the first one and no spelling."""
    return F.coalesce(c.rlike(f"[^{BLANKS}{_QUOTES[1:-1]}]"), F.lit(False))


def life_id(key: Column, start: Column) -> Column:
    """A record is one lifetime of its key."""
    return F.concat(key, F.lit("@"), F.coalesce(start.cast("string"), F.lit("-")))


def reference_states(refs: DataFrame, lifetimes: DataFrame) -> DataFrame:
    """Decide references against lifetimes.

    refs(table_name, record_id, ref_name, parent_key, at), lifetimes(parent_key, start_at, end_at, usable) ->
    refs plus state, ``usable`` (true if a lifetime that covers ``at`` is marked so) and ``parent_id``, the record referred to: of the
    lifetimes that cover ``at`` the one that began last. One equi-join on the key, which the adaptive planner splits where one asset is
    referred to very often, then one partial aggregation per reference.
    """
    life = lifetimes.where(F.col("parent_key").isNotNull()).select("parent_key", "start_at", "end_at", "usable").distinct()
    covers = (F.col("start_at").isNull() | (F.col("start_at") <= F.col("at"))) & (F.col("end_at").isNull() | (F.col("at") < F.col("end_at")))
    there = F.col("_there").isNotNull()
    joined = refs.join(life.withColumn("_there", F.lit(True)), "parent_key", "left").select(
        "table_name", "record_id", "ref_name", "parent_key", "at", there.alias("_there"),
        F.coalesce(F.col("end_at") <= F.col("at"), F.lit(False)).alias("_ended"),
        F.coalesce(covers & there & F.col("usable"), F.lit(False)).alias("_usable"),
        F.when(covers & there, life_id(F.col("parent_key"), F.col("start_at"))).alias("_life"),
    )
    one = joined.groupBy("table_name", "record_id", "ref_name", "parent_key", "at").agg(
        F.max("_there").alias("_there"), F.max("_ended").alias("_ended"), F.max("_usable").alias("usable"), F.max("_life").alias("parent_id")
    )
    state = F.when(F.col("parent_id").isNotNull(), "held").when(~F.col("_there"), "missing").when(F.col("_ended"), "deleted").otherwise("late")
    return one.select("table_name", "record_id", "ref_name", "parent_key", "at", state.alias("state"), "usable", "parent_id")


def cascade(direct: DataFrame, links: DataFrame) -> DataFrame:
    """Fixpoint over the reference graph.

    direct(node_type, node_id), links(node_type, node_id, parent_type, parent_id) -> (node_type, node_id, depth): depth 0 for the direct
    orphans, n for nodes whose shortest way to one takes n references. Each round is a semi-join of the links with the last round's finds
    and an anti-join with all finds, so a cycle ends; it runs until a round finds nothing. A round's result is written out, and all finds
    are brought together every few rounds, so plans stay short and a long chain reads nothing over and over.
    """
    known = cut(direct.select("node_type", "node_id").distinct().withColumn("depth", F.lit(0)))
    frontier, total, depth = known, known, 0
    while True:
        depth += 1
        parents = frontier.select(F.col("node_type").alias("parent_type"), F.col("node_id").alias("parent_id"))
        found = cut(
            links.join(parents, ["parent_type", "parent_id"], "left_semi")
            .select("node_type", "node_id")
            .distinct()
            .join(total, ["node_type", "node_id"], "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        if found.isEmpty():
            return total
        frontier, total = found, total.unionByName(found)
        if depth % 8 == 0:
            total = cut(total)


def catalog_orphans(entity: DataFrame, field: DataFrame, edge: DataFrame) -> DataFrame:
    """All orphan references of a catalog, direct and inherited.

    The reference graph has these nodes and goes on until nothing new turns up:

    * the references of an edge, each for itself: ``source_urn`` and ``target_urn`` to an asset, ``target_field`` to a field. A
      ``target_field`` hangs on its ``target_urn``: it is judged only where that is held (and the schema available), else it inherits;
    * lifetimes of fields (``cat_field``), which refer to the asset they belong to (``urn``);
    * lifetimes of assets (``cat_entity``), which are derived by the edges that lead to them: an asset whose source does not exist is an
      orphan itself, and so are its fields, the references to it, and what is derived from it.

    Result: table_name, record_id, ref_name, parent_key, at, state, kind, depth. ``kind`` is 'direct' with state missing, deleted or late;
    or 'inherited' with state 'held' (the reference holds, what it refers to is an orphan) or 'unjudged' (a field of an orphan reference).
    """
    assets = entity.select(asset_key(F.col("urn")).alias("parent_key"), F.col("registered_at").alias("start_at"), F.col("removed_at").alias("end_at"), F.col("schema_available").alias("usable"))
    fields = field.select(asset_key(F.col("urn")).alias("_urn"), field_key(F.col("field_path")).alias("_path"), F.col("added_at").alias("start_at"), F.col("dropped_at").alias("end_at"))
    fields = fields.where(F.col("_urn").isNotNull() & F.col("_path").isNotNull()).withColumn("parent_key", F.concat_ws("#", "_urn", "_path"))
    last = (
        edge.where(F.col("edge_id").isNotNull())
        .groupBy("edge_id")
        .agg(F.max(F.struct("ingested_at", "asserted_at", "source_urn", "target_urn", "target_field")).alias("_e"))
        .select(
            F.col("edge_id").cast("string").alias("record_id"), F.col("_e.asserted_at").alias("at"), asset_key(F.col("_e.source_urn")).alias("source_urn"),
            asset_key(F.col("_e.target_urn")).alias("target_urn"), field_key(F.col("_e.target_field")).alias("target_field"),
        )
        .where(F.col("at").isNotNull())
    )
    last = cut(last)
    to_assets = last.select(
        F.lit("cat_edge").alias("table_name"), "record_id", "at",
        F.explode(F.array(*(F.struct(F.lit(n).alias("ref_name"), F.col(n).alias("parent_key")) for n in ("source_urn", "target_urn")))).alias("_r"),
    ).select("table_name", "record_id", "_r.ref_name", "_r.parent_key", "at").where(F.col("parent_key").isNotNull())
    of_life = fields.where(F.col("start_at").isNotNull()).select(
        F.lit("cat_field").alias("table_name"), life_id(F.col("parent_key"), F.col("start_at")).alias("record_id"), F.lit("urn").alias("ref_name"), F.col("_urn").alias("parent_key"), F.col("start_at").alias("at")
    )
    of_assets = cut(reference_states(to_assets.unionByName(of_life.distinct()), assets))
    # the next level of the graph: fields of an orphan reference inherit, the rest is judged
    target = of_assets.where(F.col("ref_name") == "target_urn").select("record_id", "state", "usable", F.col("parent_id").alias("_asset"))
    named = last.where(F.col("target_urn").isNotNull() & F.col("target_field").isNotNull()).join(target, "record_id").select(
        F.lit("cat_edge").alias("table_name"), "record_id", F.lit("target_field").alias("ref_name"), F.concat_ws("#", "target_urn", "target_field").alias("parent_key"), "at", "state", "usable"
    )
    judged = named.where((F.col("state") == "held") & F.col("usable")).drop("state", "usable")
    of_fields = cut(reference_states(judged, fields.withColumn("usable", F.lit(True))))
    states = of_assets.withColumn("parent_type", F.lit("cat_entity")).unionByName(of_fields.withColumn("parent_type", F.lit("cat_field")))
    node = F.when(F.col("table_name") == "cat_edge", F.concat_ws(".", "table_name", "ref_name")).otherwise(F.col("table_name"))
    states = states.select(node.alias("node_type"), F.col("record_id").alias("node_id"), "table_name", "record_id", "ref_name", "parent_key", "at", "state", "parent_type", "parent_id")
    orphan = states.where(F.col("state") != "held")
    unjudged = named.where(F.col("state") != "held").select(
        F.lit("cat_edge.target_field").alias("node_type"), F.col("record_id").alias("node_id"), "table_name", "record_id", "ref_name", "parent_key", "at", F.lit("unjudged").alias("state"),
        F.lit("cat_edge.target_urn").alias("parent_type"), F.col("record_id").alias("parent_id"),
    )
    source = last.where(F.col("source_urn").isNotNull()).select("record_id", "at")
    derived = target.where(F.col("state") == "held").select("record_id", "_asset").join(source, "record_id").select(
        F.lit("cat_entity").alias("node_type"), F.col("_asset").alias("node_id"), F.lit("cat_entity").alias("table_name"), F.col("_asset").alias("record_id"), F.lit("derived_by").alias("ref_name"),
        F.col("record_id").alias("parent_key"), "at", F.lit("held").alias("state"), F.lit("cat_edge.source_urn").alias("parent_type"), F.col("record_id").alias("parent_id"),
    )
    links = cut(states.where(F.col("state") == "held").unionByName(unjudged).unionByName(derived))
    depths = cascade(orphan, links)
    row = ("table_name", "record_id", "ref_name", "parent_key", "at", "state")
    direct = orphan.join(depths.where("depth = 0").select("node_type", "node_id"), ["node_type", "node_id"], "left_semi").select(*row, F.lit("direct").alias("kind"), F.lit(0).alias("depth"))
    inherited = links.join(depths.select(F.col("node_type").alias("parent_type"), F.col("node_id").alias("parent_id"), "depth"), ["parent_type", "parent_id"])
    return direct.unionByName(inherited.select(*row, F.lit("inherited").alias("kind"), (F.col("depth") + 1).alias("depth")))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, referring column, month of the statement, kind and state."""
    month = F.date_format(F.date_trunc("month", "at"), "yyyy-MM")
    return orphans.groupBy("table_name", "ref_name", month.alias("month"), "kind", "state").agg(F.count("*").alias("n_references"), F.countDistinct("parent_key").alias("n_keys"))

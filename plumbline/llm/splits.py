"""Splits that keep related records together.

1. Origins. The documents that records name are brought to one spelling; documents that stand for one origin are linked; the connected
   components of the links are found by large-star / small-star contraction, which halves distances each round and touches only the
   distinct document names, never the records.
2. Placement: grouped iterative stratification. A component carries a vector of label counts; components with the same vector are
   interchangeable, so the driver only sees one row per distinct vector with the number of its components. The label with the fewest
   outstanding records goes first: the vectors that have it, those with most of it first, are dealt to the splits that need it most, and
   the needs are brought up to date. Of a vector's many components each split gets a part in proportion to its need; what does not
   divide, and every vector of a single component, goes to the split with the greatest need. Which components they are is decided by a
   random order within the vector.

Defined cases: records without a source_document (or source_kind) are an origin each, by record id; blank documents are one document per
source kind (the blank spelling); repeated rows count as they come; empty tables give an empty result;
targets without a name or a positive share are ignored, and without any target all records have a null split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.ranking import global_position
from plumbline.session import cut, discard, table

REPO_KINDS = ("dbt", "github_clone")
#: A value is a label of its own if it has at least this part of all records; the rest of its column is one label.
LABEL_SHARE = 0.001
#: Rows up to which the plan of the placement is sent to all executors.
SMALL_PLAN = 100_000
_OUTER = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"


def _tidy(c: Column) -> Column:
    """Lower case, no outer blanks, forward slashes, one slash at a time, no './' steps and no slash at the end."""
    c = F.regexp_replace(F.lower(F.regexp_replace(c, _OUTER, "")), r"\\", "/")
    c = F.regexp_replace(c, r"(?<!:)/{2,}", "/")
    c = F.regexp_replace(c, r"(^|/)(?:\./)++", "$1")
    return F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/+$", "")


def repo_key(c: Column) -> Column:
    """owner/name of a repository address in any of its forms; the tidied string if it is none."""
    bare = F.regexp_replace(_tidy(c), r"\.git$", "")
    rest = F.regexp_replace(bare, r"^(?:git\+)?(?:[a-z][a-z0-9+.-]*://)", "")
    rest = F.regexp_replace(rest, r"^[^/@\s]+@", "")
    # host:owner/name, host:port/owner/name, host/owner/name
    rest = F.regexp_replace(rest, r"^[^/:\s]+:(?:\d+/)?(?=[^/]+/[^/]+)", "")
    return F.regexp_replace(rest, r"^[^/\s]+\.[^/\s]+/(?=[^/]+/[^/]+$)", "")


def file_key(c: Column) -> Column:
    """A path inside a repository."""
    return F.regexp_replace(_tidy(c), r"^/+", "")


def is_file(c: Column) -> Column:
    """A path to a file of a dbt project rather than the address of a repository."""
    return _tidy(c).rlike(r"\.(?:sql|ya?ml|md|json|py|csv|txt)$") & ~_tidy(c).rlike(r"://|@")


def document_key(kind: Column, doc: Column) -> Column:
    """Canonical name of a document: repositories are one name space for the two kinds that name them, all else stays with its kind."""
    repo = F.concat(F.lit("repo:"), repo_key(doc))
    path = F.concat(F.lit("file:"), file_key(doc))
    other = F.concat(kind, F.lit(":"), file_key(F.regexp_replace(_tidy(doc), r"^[a-z][a-z0-9+.-]*://", "")))
    return F.when(kind == "dbt", F.when(is_file(doc), path).otherwise(repo)).when(kind.isin(*REPO_KINDS), repo).otherwise(other)


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, root), root the smallest node of the component. Only nodes with a link to another come out.

    Large-star and small-star in turn until the links no longer change; every round is two grouped minima and two joins on the node.
    """
    edges = cut(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, cut(small.where(F.col("u") != F.col("v")).distinct())
        discard(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v"))).distinct()


def origins(documents: DataFrame, listings: DataFrame) -> DataFrame:
    """documents(source_kind, source_document), listings(repo, file_path) -> (stored, doc_key, origin) for each distinct stored value."""
    docs = documents.where(F.col("source_kind").isNotNull() & F.col("source_document").isNotNull()).select("source_kind", "source_document").distinct()
    docs = cut(docs.select(F.concat_ws("|", "source_kind", "source_document").alias("stored"), document_key(F.col("source_kind"), F.col("source_document")).alias("doc_key")).distinct())
    files = docs.where(F.col("doc_key").startswith("file:")).select(F.col("doc_key").alias("a")).distinct()
    listed = listings.where(F.col("repo").isNotNull() & F.col("file_path").isNotNull() & (F.regexp_replace("repo", _OUTER, "") != "")).select("repo", "file_path").distinct()
    listed = listed.select(F.concat(F.lit("file:"), file_key(F.col("file_path"))).alias("a"), F.concat(F.lit("repo:"), repo_key(F.col("repo"))).alias("b")).distinct()
    roots = connected_components(listed.join(files, "a", "left_semi"))
    return docs.join(roots.withColumnRenamed("node", "doc_key"), "doc_key", "left").select("stored", "doc_key", F.coalesce("root", "doc_key").alias("origin"))


def bound_pairs(origin: DataFrame) -> DataFrame:
    """(doc_a, doc_b): all pairs of different stored values of one origin, as the result of the problem is defined."""
    a, b = origin.select("origin", F.col("stored").alias("doc_a")), origin.select("origin", F.col("stored").alias("doc_b"))
    return a.join(b, "origin").where(F.col("doc_a") < F.col("doc_b")).select("doc_a", "doc_b")


# ------------------------------------------------------------------------------------------------------------------- placement


def deal(vectors: list[tuple[tuple[int, ...], int]], targets: dict[str, float]) -> list[tuple[tuple[int, ...], dict[str, int]]]:
    """vectors: (label counts with the size first, number of components) -> the number of components of each vector per split."""
    names = list(targets)
    width = len(vectors[0][0]) if vectors else 0
    total = [sum(v[c] * n for v, n in vectors) for c in range(width)]
    need = {s: [targets[s] * t for t in total] for s in names}
    outstanding, out = list(total), []
    by_label: dict[int, list[int]] = {c: [] for c in range(width)}
    for i, (v, _) in enumerate(vectors):
        for c in range(width):
            if v[c]:
                by_label[c].append(i)
    done = [False] * len(vectors)

    def give(i: int, s: str, n: int, dealt: dict) -> None:
        dealt[s] = dealt.get(s, 0) + n
        for c, x in enumerate(vectors[i][0]):
            need[s][c] -= x * n
            outstanding[c] -= x * n

    while True:
        open_labels = [c for c in range(1, width) if outstanding[c] > 0]
        label = min(open_labels, key=lambda c: (outstanding[c], c)) if open_labels else 0
        mine = [i for i in by_label.get(label, []) if not done[i]]
        for i in sorted(mine, key=lambda i: (-vectors[i][0][label], -vectors[i][0][0], vectors[i][0])):
            n, dealt = vectors[i][1], {}
            wants = {s: max(0.0, need[s][label]) for s in names}
            whole = sum(wants.values())
            if n > 1 and whole > 0:
                for s, k in {s: int(n * w / whole) for s, w in wants.items()}.items():
                    give(i, s, k, dealt)
            for _ in range(n - sum(dealt.values())):  # fewer than there are splits, unless nobody needs the label any more
                give(i, max(names, key=lambda x: (need[x][label], need[x][0], x)), 1, dealt)
            done[i] = True
            out.append((vectors[i][0], {s: k for s, k in dealt.items() if k}))
        if not open_labels:
            return out


def place(components: DataFrame, labels: list[str], targets: dict[str, float], seed: int = 7) -> DataFrame:
    """components(origin, size, one long column per label) -> (origin, split_name)."""
    spark = components.sparkSession
    if not targets:
        return components.select("origin", F.lit(None).cast("string").alias("split_name"))
    comp = components.select("origin", F.array("size", *labels).alias("vector")).withColumn("_h", F.xxhash64(F.lit(seed), "origin"))
    at = global_position(comp, F.col("vector"), F.col("_h"), F.col("origin"))
    kinds = sorted((tuple(r["vector"]), r["n"]) for r in at.groupBy("vector").agg(F.count("*").alias("n")).collect())  # a row per distinct vector
    dealt, first, rows = dict(deal(kinds, targets)), 1, []
    for v, n in kinds:
        lo = first
        for s, k in dealt[v].items():
            rows.append((list(v), lo, lo + k - 1, s))
            lo += k
        first += n
    plan = spark.createDataFrame(rows, "vector array<long>, lo long, hi long, split_name string")
    inside = F.col("position").between(F.col("lo"), F.col("hi"))
    return at.join(F.broadcast(plan) if len(rows) <= SMALL_PLAN else plan, "vector").where(inside).select("origin", "split_name")


def record_origins(records: DataFrame, origin: DataFrame) -> DataFrame:
    """records(record_id, source_kind, source_document, ...) plus ``origin``; a record without a document is one by itself."""
    stored = F.when(F.col("source_kind").isNotNull() & F.col("source_document").isNotNull(), F.concat_ws("|", "source_kind", "source_document"))
    found = records.withColumn("stored", stored).join(origin.select("stored", "origin"), "stored", "left").drop("stored")
    return found.withColumn("origin", F.coalesce("origin", F.concat(F.lit("record:"), F.col("record_id").cast("string"))))


#: Columns whose values are kept in proportion.
LABEL_COLUMNS = ("record_class", "claim_type", "source_kind")


def record_labels(records: DataFrame, columns: tuple[str, ...] = LABEL_COLUMNS) -> list[tuple[str, tuple[str, ...], bool]]:
    """(column, values, rest): the labels of the data. A value with LABEL_SHARE of the records is a label; all others of its column,
    if there are any, are one label together. At most 1 / LABEL_SHARE values per column come to the driver."""
    pairs = records.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.lower(F.trim(F.col(c))).alias("v")) for c in columns))).alias("p")).select("p.*").where("v is not null")
    per = pairs.groupBy("c", "v").agg(F.count("*").alias("n"))
    least = max(1.0, LABEL_SHARE * records.count())
    kept = per.where(F.col("n") >= least).select("c", "v").collect()
    rest = {r["c"] for r in per.where(F.col("n") < least).select("c").distinct().collect()}
    return [(c, tuple(sorted(r["v"] for r in kept if r["c"] == c)), c in rest) for c in columns]


def label_flags(labels: list[tuple[str, tuple[str, ...], bool]]) -> dict[str, Column]:
    """Label name -> does a record have it?"""
    out = {}
    for c, values, rest in labels:
        v = F.lower(F.trim(F.col(c)))
        out |= {f"{c}={x}": v.eqNullSafe(x) for x in values}
        if rest:
            out[f"{c}=(rest)"] = v.isNotNull() & ~v.isin(*values) if values else v.isNotNull()
    return out


def stratified_splits(records: DataFrame, listings: DataFrame, targets: DataFrame) -> DataFrame:
    """(record_id, origin, split_name): one split per origin, shares as in targets(split_name, target_share)."""
    goal = {r["split_name"]: r["target_share"] for r in targets.where("split_name is not null and target_share > 0 and not isnan(target_share)").collect()}  # a handful of splits
    whole = sum(goal.values()) or 1.0
    goal = {k: v / whole for k, v in sorted(goal.items())}
    base = records.select("record_id", *dict.fromkeys(("source_kind", "source_document", *LABEL_COLUMNS)))
    tagged = cut(record_origins(base, origins(base, listings)))
    flags = list(label_flags(record_labels(tagged)).values())
    comp = tagged.groupBy("origin").agg(F.count("*").alias("size"), *(F.count_if(x).alias(f"l{i}") for i, x in enumerate(flags)))
    return tagged.select("record_id", "origin").join(place(comp, [f"l{i}" for i in range(len(flags))], goal), "origin")


def _sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "mine_claims_release"), table(spark, d, "mine_dbt_claims").select("repo", "file_path")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of stored documents that must share a split."""
    claims, listed = _sources(spark, d)
    return bound_pairs(origins(claims.select("source_kind", "source_document"), listed))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """The split of every record."""
    claims, listed = _sources(spark, d)
    return stratified_splits(claims, listed, table(spark, d, "split_target"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Records, origins and share of each split, beside its target."""
    got = p2_splits(spark, d)
    n = got.count()
    per = got.groupBy("split_name").agg(F.count("*").alias("n_records"), F.countDistinct("origin").alias("n_origins"))
    goal = table(spark, d, "split_target").select("split_name", "target_share")
    share = F.coalesce("n_records", F.lit(0)) / F.lit(max(1, n))
    return goal.join(per, "split_name", "left").select("split_name", "target_share", F.coalesce("n_records", F.lit(0)).alias("n_records"), F.coalesce("n_origins", F.lit(0)).alias("n_origins"), share.alias("share"))


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    """Share of each label's records in each split, and how far it is from the target."""
    claims, _ = _sources(spark, d)
    flags = label_flags(record_labels(claims))
    named = F.array(*(F.struct(F.lit(k).alias("label"), F.coalesce(x, F.lit(False)).alias("has")) for k, x in flags.items())).cast("array<struct<label:string,has:boolean>>")
    tagged = claims.select("record_id", F.explode(named).alias("_l")).where("_l.has").select("record_id", "_l.label")
    split = p2_splits(spark, d).select("record_id", "split_name")
    n = tagged.join(split, "record_id").groupBy("label", "split_name").agg(F.count("*").alias("n_records"))
    share = F.col("n_records") / F.sum("n_records").over(Window.partitionBy("label"))
    goal = F.broadcast(table(spark, d, "split_target").select("split_name", "target_share"))
    return n.withColumn("share", share).join(goal, "split_name").select("label", "split_name", "n_records", "share", "target_share", F.abs(F.col("share") - F.col("target_share")).alias("error"))


def p2_origins(spark: SparkSession, d: str) -> DataFrame:
    """Every stored document with the representative of its origin, the least stored document: what p2_found lists as pairs."""
    claims, listed = _sources(spark, d)
    o = cut(origins(claims.select("source_kind", "source_document"), listed))
    rep = o.groupBy("origin").agg(F.min("stored").alias("representative"), F.count("*").alias("n_documents"))
    return o.join(rep, "origin").select(F.col("stored").alias("document"), "representative", "n_documents")


QUERIES = {"p2_found": p2_found, "p2_splits": p2_splits, "p2_report": p2_report, "p2_labels": p2_labels, "p2_origins": p2_origins}


def _sql_tidy(c: str) -> str:
    outer = rf"lower(regexp_replace({c}, '^[\s\p{{Z}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cf}}]+$', '', 'g'))"
    slashes = rf"regexp_replace(replace({outer}, '\', '/'), '([^:])/{{2,}}', '\1/', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({slashes}, '(^|/)(\./)+', '\1', 'g'), '[?#].*$', ''), '/+$', '')"


def _sql_repo(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace({_sql_tidy(c)}, '\.git$', ''), '^(git\+)?[a-z][a-z0-9+.-]*://', '')"
    scp = rf"regexp_replace(regexp_replace({bare}, '^[^/@\s]+@', ''), '^[^/:\s]+:(?:\d+/)?([^/]+/[^/]+)', '\1')"
    return rf"regexp_replace({scp}, '^[^/\s]+\.[^/\s]+/([^/]+/[^/]+)$', '\1')"


def _sql_file(c: str) -> str:
    return f"regexp_replace({_sql_tidy(c)}, '^/+', '')"


_BOUND = rf"""
WITH RECURSIVE raw AS (SELECT DISTINCT source_kind AS k, source_document AS d FROM mine_claims_release WHERE source_kind IS NOT NULL AND source_document IS NOT NULL),
doc AS (SELECT concat(k, '|', d) AS stored, CASE WHEN k = 'dbt' AND regexp_matches({_sql_tidy("d")}, '\.(sql|ya?ml|md|json|py|csv|txt)$') AND NOT regexp_matches({_sql_tidy("d")}, '://|@') THEN concat('file:', {_sql_file("d")})
  WHEN k IN ('dbt', 'github_clone') THEN concat('repo:', {_sql_repo("d")}) ELSE concat(k, ':', regexp_replace(regexp_replace({_sql_tidy("d")}, '^[a-z][a-z0-9+.-]*://', ''), '^/+', '')) END AS n FROM raw),
ls AS (SELECT DISTINCT concat('file:', {_sql_file("file_path")}) AS f, concat('repo:', {_sql_repo("repo")}) AS r FROM mine_dbt_claims WHERE repo IS NOT NULL AND trim(repo) <> '' AND file_path IS NOT NULL),
li AS (SELECT * FROM ls WHERE f IN (SELECT n FROM doc)), both_ways AS (SELECT f AS a, r AS b FROM li UNION SELECT r, f FROM li),
re AS (SELECT n AS x, n AS y FROM (SELECT DISTINCT n FROM doc) UNION SELECT re.x, both_ways.b FROM re JOIN both_ways ON both_ways.a = re.y)
"""
ORACLE = {
    "p2_found": _BOUND + "SELECT DISTINCT a.stored AS doc_a, b.stored AS doc_b FROM re JOIN doc a ON a.n = re.x JOIN doc b ON b.n = re.y WHERE a.stored < b.stored",
    "p2_origins": _BOUND + "SELECT a.stored AS document, min(b.stored) AS representative, count(DISTINCT b.stored) AS n_documents FROM re JOIN doc a ON a.n = re.x JOIN doc b ON b.n = re.y GROUP BY 1",
}

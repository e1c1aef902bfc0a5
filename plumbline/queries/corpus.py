"""Queries of corpus building, benchmark metrics, embedding screens, constraints, sources, SQL analysis and streaming."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import expresses
from plumbline.operators import benchmark as bm
from plumbline.operators import constraints as cn
from plumbline.operators import corpus as co
from plumbline.operators import screens
from plumbline.plans import mutators, predicates, sqlscan
from plumbline.session import cut, scratch, table
from plumbline.sources import files, live, miners
from plumbline.streaming import receipts as stream

# ------------------------------------------------------------------------------------------------------------------------ corpus


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mine_claims_release").select("record_id", "record_class", "sentence", "column_name", "table_name", "claim_type", "source_kind", "source_document", "split")


def pair_dedupe(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d).where("sentence is not null")
    return co.first_seen(c.select("sentence", "column_name", "claim_type", "record_id"), ["sentence", "column_name", "claim_type"], "record_id").select("record_id")


def sentence_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most three records of the same whole sentence."""
    c = _claims(spark, d).where("sentence is not null")
    return co.sentence_cap(c.select("record_id", "record_class", "claim_type", "sentence")).select("record_id", F.col("rn").cast("long").alias("rn"))


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d).where("source_document is not null")
    return co.hash_split(c, F.col("source_document")).groupBy("bucket").agg(F.count("*").alias("n"), F.count_distinct("source_document").alias("n_documents"))


def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    return co.split_overlap(_claims(spark, d).where("source_document is not null"), "source_document", "split", "train", "test")


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: 200 records in turns over the source kinds."""
    c = _claims(spark, d).select("record_id", "source_kind")
    return co.round_robin(c, "source_kind", [F.sha2(F.col("record_id").cast("string"), 256)], 200).select("record_id", "source_kind", F.col("rn").cast("long").alias("rn"))


def class_balance(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d).select("record_id", "record_class")
    got = co.class_balance(c, "record_class", [F.sha2(F.col("record_id").cast("string"), 256)], {"positive": 0.5, "negative": 0.35, "hard_negative": 0.15})
    return got.groupBy("record_class").agg(F.count("*").alias("n"))


def screening_sample(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d).select("record_id", "claim_type")
    return co.per_type_head(c, "claim_type", [F.col("record_id")], 16, 40).select("record_id", "claim_type")


def datasheet_lanes(spark: SparkSession, d: str) -> DataFrame:
    return co.datasheet(_claims(spark, d))


def distinct_ratio(spark: SparkSession, d: str) -> DataFrame:
    return co.distinct_ratio(_claims(spark, d).where("sentence is not null"), "split", "sentence")


def miner_survival(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d).where("claim_type is not null")
    return co.survival(c, expresses(F.col("claim_type"), F.col("sentence")))


def label_join(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "doc_label").distinct()
    return labels.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("subject", "source").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------------------------------------------------- benchmark


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Records with a prediction made from their id: right for most, an abstention for some."""
    i = F.col("record_id")
    predicted = F.when(i % 11 == 0, F.lit(None)).when(i % 7 == 0, "unique").otherwise(F.col("claim_type"))
    return _claims(spark, d).select("record_id", "record_class", "source_kind", "claim_type", predicted.alias("predicted"), ((i * 37) % 1000 / 1000).alias("score"), ((i * 13) % 997 / 100).alias("latency"))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return bm.confusion(_judged(spark, d).withColumn("claim_type", F.coalesce("claim_type", F.lit("none"))), "claim_type", "predicted", ["unique", "not_null", "accepted_values", "relationships", "expression"])


def family_rates(spark: SparkSession, d: str) -> DataFrame:
    return bm.family_rates(_judged(spark, d), "source_kind", F.col("record_class") == "positive", F.col("predicted").isNotNull())


def ladder_score(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d)
    return bm.ladder_score(j, F.col("record_class") == "positive", F.when(F.col("record_id") % 10 != 0, F.col("score") > 0.3))


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return bm.label_distribution(_claims(spark, d), ["record_class", "claim_type", "source_kind"])


def operating_point(spark: SparkSession, d: str) -> DataFrame:
    return bm.operating_point(_judged(spark, d).withColumn("ok", (F.col("score") > 0.5) | (F.col("record_id") % 2 == 0)), "score", "ok", 0.9)


def extractor_metrics(spark: SparkSession, d: str) -> DataFrame:
    return bm.extractor_metrics(_judged(spark, d), "source_kind", "claim_type", "predicted", F.col("record_id") % 3 != 0, "latency")


def every_third(spark: SparkSession, d: str) -> DataFrame:
    c = _claims(spark, d).where("source_document is not null")
    return bm.every_third(c, "source_document").groupBy("held_out").agg(F.count("*").alias("n"), F.count_distinct("source_document").alias("n_documents"))


def ladder_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Logistic regression on text features, scored on held-out documents."""
    c = _claims(spark, d).where("sentence is not null and source_document is not null and record_class is not null").withColumn("label", (F.col("record_class") == "positive").cast("double"))
    parts = cut(bm.every_third(bm.features(c, "sentence"), "source_document").select("record_id", "label", "features", "held_out"))
    if parts.where("not held_out").isEmpty():
        return bm.ladder_score(parts, F.col("label") == 1, F.lit(None).cast("boolean"))
    model, prepare = bm.classifier(parts.where("not held_out"), "features", "label")
    got = model.transform(prepare(parts.where("held_out")))
    return bm.ladder_score(got, F.col("label") == 1, F.col("prediction") == 1)


# ----------------------------------------------------------------------------------------------------------------------- vectors


def cosine_screen(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    pairs = e.select("vec_id", "label", "embedding").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return screens.drift(pairs, "embedding", "other", 0.1).select("vec_id", F.round("similarity", 6).alias("similarity"), "drifted")


_W = [[1.0 if i % 10 == k else -0.1 for i in range(64)] for k in range(10)]


def linear_head(spark: SparkSession, d: str) -> DataFrame:
    got = screens.linear_head(table(spark, d, "embeddings"), "embedding", _W, [0.01 * k for k in range(10)], 0.15)
    return got.select("vec_id", F.round("probability", 6).alias("probability"), "predicted")


# ------------------------------------------------------------------------------------------------------------------- constraints

_LIVE = [
    ("orders", "orders_status", "check", ("o_orderstatus",), "CHECK ((o_orderstatus = ANY (ARRAY['F'::text, 'O'::text, 'P'::text])))", False),
    ("orders", "orders_price", "check", ("o_totalprice",), "CHECK (((o_totalprice >= (0)::numeric) AND (o_totalprice <= (600000)::numeric)))", False),
    ("orders", "orders_pk", "primary_key", ("o_orderkey",), "PRIMARY KEY (o_orderkey)", False),
    ("orders", "orders_cust", "foreign_key", ("o_custkey",), "FOREIGN KEY (o_custkey) REFERENCES customer(c_custkey)", False),
    ("orders", "orders_prio", "check", ("o_orderpriority",), "CHECK ((o_orderpriority = ANY (ARRAY['1-URGENT'::text, '2-HIGH'::text])))", False),
    ("orders", "orders_open", "unique", ("o_custkey",), "UNIQUE (o_custkey) WHERE (o_orderstatus = 'O')", True),
    ("orders", "orders_date_nn", "not_null", ("o_orderdate",), "NOT NULL", False),
    ("lineitem", "line_disc", "check", ("l_discount", "l_tax"), "CHECK ((l_discount + l_tax) < (1)::numeric)", False),
    ("lineitem", "line_odd", "check", ("l_returnflag",), "CHECK (l_returnflag @@ to_tsquery('x'))", False),
    ("customer", "cust_seg", "check", ("c_mktsegment",), "CHECK ((c_mktsegment)::text ~ '^[A-Z]+$'::text)", False),
]
_DOCS = [
    ("orders", "doc_status", "check", ("o_orderstatus",), "o_orderstatus in ('P', 'O', 'F')", False),
    ("orders", "doc_price", "check", ("o_totalprice",), "o_totalprice between 0 and 600000", False),
    ("orders", "doc_key", "unique", ("o_orderkey",), None, False),
    ("orders", "doc_prio", "check", ("o_orderpriority",), "o_orderpriority in ('1-URGENT', '3-MEDIUM')", False),
    ("orders", "doc_date", "not_null", ("o_orderdate",), None, False),
    ("lineitem", "doc_flag", "check", ("l_returnflag",), "l_returnflag in ('A', 'N', 'R')", False),
    ("lineitem", "doc_qty", "check", ("l_quantity",), "l_quantity > 0", False),
]


def constraint_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return cn.reconcile(cn.normalize(spark, _LIVE), cn.normalize(spark, _DOCS))


def reconcile_coverage(spark: SparkSession, d: str) -> DataFrame:
    lives = cn.normalize(spark, _LIVE)
    return cn.coverage(lives, cn.reconcile(lives, cn.normalize(spark, _DOCS)))


_PAIRS = [
    ("a > 1", "A>1"), ("a > 1", "1 < a"), ("a in (1, 2)", "a IN (2, 1)"), ("a = 1 or a = 2", "a in (1, 2)"), ("a >= 1 and a <= 5", "a between 1 and 5"), ("a > 1", "a > 2"),
    ("not (not (a > 1))", "a > 1"), ("(a = 1 or b = 2) and c = 3", "a = 1 or (b = 2 and c = 3)"), ("a > 1 and b < 2", "b < 2 and a > 1"), ("(s = ANY (ARRAY['x'::text, 'y'::text]))", "s in ('y', 'x')"),
]


def constraint_tiers(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i, predicates.tier(a, b)) for i, (a, b) in enumerate(_PAIRS)], "pair int, tier string")


def constraint_shapes(spark: SparkSession, d: str) -> DataFrame:
    return cn.normalize(spark, _LIVE).select("name", "kind", "shape", "opaque")


# ----------------------------------------------------------------------------------------------------------------------- sources


def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Claims written as JSON lines and read back."""
    path = scratch(spark)
    files.write_jsonl(table(spark, d, "mine_claims_release").select("record_id", "sentence", "split"), path, "record_id")
    back = files.read_jsonl(spark, path, "record_id long, sentence string, split string")
    return back.agg(F.count("*").alias("n"), F.count("sentence").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"), F.count("_corrupt").alias("n_corrupt"))


def resolve_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest made of the orders' customers."""
    node = F.struct(
        F.concat(F.lit("models/marts/c"), F.col("c_custkey").cast("string"), F.lit(".sql")).alias("original_file_path"), F.lit("marts").alias("schema"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"),
        F.struct(F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("urn:own:"), F.col("c_custkey").cast("string"))).alias("dataset_urn")).alias("meta"),
    )
    text = F.to_json(F.struct(F.create_map(F.concat(F.lit("model."), F.col("c_custkey").cast("string")), node).alias("nodes")))
    return files.manifest_assets(table(spark, d, "customer").where("c_custkey is not null").select(text.alias("text")), "lake").select("path", "urn", "strategy")


def resolve_naming(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "mine_dbt_claims").select(F.col("file_path").alias("path")).where("path is not null").distinct()
    return files.by_naming(paths, "lake")


def schema_profile(spark: SparkSession, d: str) -> DataFrame:
    return live.profile(table(spark, d, "progress"), "progress").unionByName(live.profile(table(spark, d, "orders"), "orders")).select("relation", "path", "native_type")


_DDL = [
    ("orders", "CREATE TABLE orders (o_orderkey bigint PRIMARY KEY, o_custkey bigint NOT NULL REFERENCES customer(c_custkey), o_orderstatus text, CONSTRAINT ok_status CHECK (o_orderstatus IN ('F', 'O', 'P')), UNIQUE (o_custkey, o_orderkey));"),
    ("part", "CREATE TABLE part (p_partkey bigint UNIQUE, p_size int CHECK (p_size > 0), p_name text NOT NULL)"),
]


def live_constraints_union(spark: SparkSession, d: str) -> DataFrame:
    got = live.from_ddl(spark, spark.createDataFrame(_DDL, "relation string, text string"))
    return got.select("relation", "kind", F.array_join("columns", ",").alias("columns"))


def ddl_constraint_extract(spark: SparkSession, d: str) -> DataFrame:
    texts = [
        ("a.yml", "models:\n  - name: t\n    columns:\n      - name: id\n        description: The id is unique.\n        tests: [unique, not_null]\n"),
        ("b.json", '{"properties": {"size": {"description": "Size of the thing", "enum": ["s", "m"]}, "n": {"description": "How many", "minimum": 0}}}'),
        ("c.sql", "CREATE TABLE t (\n  id bigint not null, -- never empty id\n  x text -- free text here\n);"),
        ("d.yml", "models: [unclosed"),
        ("e.py", 'raise ValueError("order_id is required here")'),
    ]
    return miners.mine(spark.createDataFrame(texts, "path string, text string")).select("path", "column_name", "claim_type", "problem")


# ------------------------------------------------------------------------------------------------------------------ SQL analysis

_SCHEMAS = {"orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"], "customer": ["c_custkey", "c_name", "c_mktsegment"]}
_SQL = {
    "plain": "select o_orderkey as k, o_totalprice from orders",
    "join": "select c.c_name, sum(cast(o.o_totalprice as double)) as total from orders o join customer c on o.o_custkey = c.c_custkey group by c.c_name",
    "cte": "with x as (select o_custkey as ck, o_totalprice as p from orders) select ck, max(p) as top from x group by ck",
    "union": "select o_custkey as id from orders union all select c_custkey from customer",
    "star": "select * from customer",
    "broken": "select nothing from orders",
}


def column_lineage(spark: SparkSession, d: str) -> DataFrame:
    rows = []
    for name, sql in _SQL.items():
        got = sqlscan.scan(spark, sql, _SCHEMAS)
        rows += [(name, t, c, o, got.problem) for t, c, o in sorted(got.lineage)] or [(name, None, None, None, got.problem)]
    return spark.createDataFrame(rows, "model string, source_table string, source_column string, output string, problem string")


def sql_mutants(spark: SparkSession, d: str) -> DataFrame:
    models = spark.createDataFrame([(k, v) for k, v in _SQL.items()], "path string, sql string")
    return mutators.mutants(models).groupBy("intent", "family").agg(F.count("*").alias("n"))


_MODELS = {
    "model_customer_revenue": "SELECT c_custkey, c_name, count(DISTINCT o_orderkey) AS n_orders, CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS revenue_cents, max(o_orderdate) AS last_order FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY c_custkey, c_name",
    "model_order_enriched": "WITH li AS (SELECT l_orderkey, count(*) AS n_lines, CAST(round(sum(l_extendedprice * (1 - l_discount)) * 10000) AS BIGINT) AS net FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey, c_mktsegment, n_name, coalesce(n_lines, 0) AS n_lines, coalesce(net, 0) AS net, CASE WHEN net > 1000000000 THEN 'large' WHEN net > 100000000 THEN 'medium' ELSE 'small' END AS size_class FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey LEFT JOIN li ON l_orderkey = o_orderkey",
    "model_revenue_daily": "SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS day, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_closed, CAST(round(sum(o_totalprice) * 100) AS BIGINT) AS revenue_cents FROM orders GROUP BY CAST(o_orderdate AS DATE)",
    "model_funnel": "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id",
    "model_customer_lifetime": "SELECT c_mktsegment, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT CASE WHEN o_totalprice > 200000 THEN c_custkey END) AS n_big, CAST(round(avg(o_totalprice) * 100) AS BIGINT) AS mean_cents FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "model_supplier_parts": "SELECT s_suppkey, s_name, count(DISTINCT l_partkey) AS n_parts, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name HAVING count(DISTINCT l_partkey) > 1",
    "model_region_rollup": "SELECT r_name, n_name, count(*) AS n_customers FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name",
    "model_return_flags": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(round(sum(l_extendedprice * (1 - l_discount)), 0) AS BIGINT) AS net FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "model_open_orders": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "model_new_users": "SELECT day, count(*) AS n FROM (SELECT user_id, CAST(CAST(min(ts) AS DATE) AS STRING) AS day FROM events GROUP BY user_id) x GROUP BY day",
}


def _model(sql: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        tables = {t: table(spark, d, t) for t in ("customer", "orders", "lineitem", "nation", "region", "supplier", "events") if t in sql}
        text = sql
        for t in tables:
            import re

            text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
        return spark.sql(text, **tables)

    return run


# --------------------------------------------------------------------------------------------------------------------- streaming


def stream_verdicts_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Events as a stream of receipts, run to its end into files."""
    src = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    log = src.select(F.col("ts").cast("timestamp").alias("checked_at"), F.when(F.col("event_type") == "purchase", "PASS").when(F.col("event_type") == "error", "BLOCK").otherwise("WARN").alias("verdict"))
    name = scratch(spark)
    q = stream.verdicts_per_day(log).writeStream.outputMode("complete").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(name)).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(name).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "verdict", "n")


def stream_latest_receipts(spark: SparkSession, d: str) -> DataFrame:
    src = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    log = src.select(F.col("user_id").cast("string").alias("urn"), F.col("ts").alias("checked_at"), "event_type", "event_id")
    name = scratch(spark)
    q = stream.keep_latest(log, name, scratch(spark))
    q.awaitTermination()
    last = (q.lastProgress or {}).get("batchId", 0)
    return spark.read.parquet(f"{name}/{last}").select("urn", "event_type", "event_id")


_FUNCS = (
    pair_dedupe, sentence_cap, hash_split, split_overlap, stratified_sample, class_balance, screening_sample, datasheet_lanes, distinct_ratio, miner_survival, label_join, confusion_matrix, family_rates, ladder_score, label_distribution,
    operating_point, extractor_metrics, every_third, ladder_classifier, cosine_screen, linear_head, constraint_reconcile, reconcile_coverage, constraint_tiers, constraint_shapes, jsonl_roundtrip, resolve_manifest, resolve_naming,
    schema_profile, live_constraints_union, ddl_constraint_extract, column_lineage, sql_mutants, stream_verdicts_per_day, stream_latest_receipts,
)
QUERIES = {f.__name__: f for f in _FUNCS} | {k: _model(v) for k, v in _MODELS.items()}

_H = "sha256(CAST(record_id AS VARCHAR))"
_JUDGED = "WITH j AS (SELECT record_id, record_class, source_kind, claim_type, CASE WHEN record_id % 11 = 0 THEN NULL WHEN record_id % 7 = 0 THEN 'unique' ELSE claim_type END AS predicted, ((record_id * 37) % 1000) / 1000 AS score, ((record_id * 13) % 997) / 100 AS latency FROM mine_claims_release) "
_EXPRESSED = r"""(NOT regexp_matches(s, '\b(?:need not|may not be unique|not necessarily|optional(?:ly)?|can be null|nullable)\b') AND CASE claim_type
  WHEN 'unique' THEN regexp_matches(s, '\bunique\b|\bprimary key\b|\bone row per\b|\bidentif(?:y|ies)\b|\bnever repeats\b|\bkeyed by\b') WHEN 'not_null' THEN regexp_matches(s, '\bnot null\b|\brequired\b|\bmust be (?:present|set)\b|\bnever (?:be )?(?:null|empty|blank)\b|\bmandatory\b')
  WHEN 'accepted_values' THEN regexp_matches(s, '\bone of\b|\ballowed values?\b|\beither\b|\benum') WHEN 'relationships' THEN regexp_matches(s, '\brefer(?:s|ences)?\b|\bforeign key\b|\bmust match\b|\blinks?\b')
  WHEN 'expression' THEN regexp_matches(s, '[<>]=?|\bat least\b|\bat most\b|\bgreater\b|\bless\b|\bexceed\b|\bbetween\b') ELSE false END)"""
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
_SCORES = "[" + ", ".join(f"{_DOT.format(a='embedding', b='[' + ', '.join(map(str, w)) + ']')} + {0.01 * k}" for k, w in enumerate(_W)) + "]"

ORACLE = {
    "pair_dedupe": "SELECT min(record_id) AS record_id FROM mine_claims_release WHERE sentence IS NOT NULL GROUP BY sentence, column_name, claim_type",
    "sentence_cap": f"""WITH c AS (SELECT record_id, record_class, claim_type, sentence AS s FROM mine_claims_release WHERE sentence IS NOT NULL), t AS (SELECT claim_type, count(*) AS n FROM c GROUP BY 1)
SELECT record_id, rn FROM (SELECT c.record_id, row_number() OVER (PARTITION BY s ORDER BY CASE WHEN record_class = 'positive' THEN 0 ELSE 1 END, t.n, {_H.replace("record_id", "c.record_id")}) AS rn FROM c JOIN t ON t.claim_type IS NOT DISTINCT FROM c.claim_type) WHERE rn <= 3""",
    "hash_split": "SELECT ('0x' || substr(sha256(source_document), 1, 8))::BIGINT % 5 AS bucket, count(*) AS n, count(DISTINCT source_document) AS n_documents FROM mine_claims_release WHERE source_document IS NOT NULL GROUP BY 1",
    "split_overlap": "SELECT source_document FROM mine_claims_release WHERE split = 'train' AND source_document IS NOT NULL INTERSECT SELECT source_document FROM mine_claims_release WHERE split = 'test'",
    "stratified_sample": f"SELECT record_id, source_kind, rn FROM (SELECT record_id, source_kind, row_number() OVER (PARTITION BY source_kind ORDER BY {_H}) AS rn FROM mine_claims_release) ORDER BY rn, sha256(source_kind) LIMIT 200",
    "class_balance": "WITH c AS (SELECT record_class, count(*) AS n FROM mine_claims_release GROUP BY 1), s AS (SELECT * FROM (VALUES ('positive', 0.5::DOUBLE), ('negative', 0.35::DOUBLE), ('hard_negative', 0.15::DOUBLE)) v(k, sh)) SELECT k AS record_class, floor((SELECT min(n / sh) FROM s JOIN c ON c.record_class = k) * sh)::BIGINT AS n FROM s",
    "screening_sample": "SELECT record_id, claim_type FROM (SELECT record_id, claim_type, row_number() OVER (PARTITION BY claim_type ORDER BY record_id) AS rn FROM mine_claims_release) WHERE rn <= CASE WHEN claim_type IS NULL THEN 40 ELSE 16 END",
    "datasheet_lanes": "SELECT source_kind, count(*) AS n_rows, count(DISTINCT source_document) AS n_documents, count(DISTINCT sentence) AS n_sentences, count(*) FILTER (WHERE record_class = 'positive') AS n_positive, count(*) FILTER (WHERE record_class = 'negative') AS n_negative, count(*) FILTER (WHERE record_class = 'hard_negative') AS n_hard_negative FROM mine_claims_release GROUP BY 1",
    "distinct_ratio": "SELECT split, count(*) AS n, count(DISTINCT sha256(sentence)) AS n_distinct FROM mine_claims_release WHERE sentence IS NOT NULL GROUP BY 1",
    "miner_survival": f"SELECT source_kind, count(*) AS n_candidates, count(*) FILTER (WHERE coalesce({_EXPRESSED}, false)) AS n_survived, count(*) FILTER (WHERE NOT coalesce({_EXPRESSED}, false)) AS n_rejected FROM (SELECT *, lower(sentence) AS s FROM mine_claims_release WHERE claim_type IS NOT NULL) GROUP BY 1",
    "label_join": "SELECT subject, source, count(*) AS n FROM (SELECT DISTINCT doc_id, subject FROM doc_label) l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1, 2",
    "confusion_matrix": _JUDGED + "SELECT coalesce(claim_type, 'none') AS claim_type, " + ", ".join(f"count(*) FILTER (WHERE predicted = '{v}') AS n_{v}" for v in ("unique", "not_null", "accepted_values", "relationships", "expression")) + " FROM j GROUP BY 1",
    "family_rates": _JUDGED + "SELECT source_kind, count(*) FILTER (WHERE record_class = 'positive') AS n_harmful, count(*) FILTER (WHERE record_class = 'positive' AND predicted IS NULL) AS n_missed, count(*) FILTER (WHERE NOT (record_class = 'positive')) AS n_harmless, count(*) FILTER (WHERE NOT (record_class = 'positive') AND predicted IS NOT NULL) AS n_false_alarms FROM j GROUP BY 1",
    "ladder_score": _JUDGED + "SELECT count(*) AS n, count(*) FILTER (WHERE t AND NOT a) AS false_negatives, count(*) FILTER (WHERE NOT t AND a) AS false_positives, count(*) FILTER (WHERE a IS NULL) AS abstained, round(count(*) FILTER (WHERE t = a) / nullif(count(*) FILTER (WHERE a IS NOT NULL), 0), 6) AS accuracy FROM (SELECT record_class = 'positive' AS t, CASE WHEN record_id % 10 <> 0 THEN score > 0.3 END AS a FROM j)",
    "label_distribution": " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n FROM mine_claims_release GROUP BY 2" for c in ("record_class", "claim_type", "source_kind")),
    "operating_point": _JUDGED
    + """, s AS (SELECT least(99, floor(round(score * 100, 6)))::INTEGER AS s, (score > 0.5 OR record_id % 2 = 0) AS ok FROM j), g AS (SELECT t::INTEGER AS t, count(*) AS n, count(*) FILTER (WHERE ok) AS k FROM range(30, 100) r(t) JOIN s ON s.s >= r.t GROUP BY 1), h AS (SELECT *, k / n AS p FROM g),
x AS (SELECT * FROM h WHERE p >= 0.9 ORDER BY t LIMIT 1), y AS (SELECT * FROM h ORDER BY p DESC, t LIMIT 1) SELECT t AS threshold, n, round(p, 6) AS precision, EXISTS (SELECT 1 FROM x) AS reached FROM (SELECT * FROM x UNION ALL SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM x))""",
    "extractor_metrics": _JUDGED + "SELECT source_kind, count(*) AS n, count(*) FILTER (WHERE record_id % 3 <> 0 AND claim_type = predicted) AS n_exact, count(*) FILTER (WHERE claim_type = predicted) AS n_type, count(*) FILTER (WHERE claim_type IS NULL AND predicted IS NULL) AS n_abstained, count(*) FILTER (WHERE claim_type IS NULL AND predicted IS NOT NULL) AS n_hallucinated, round(median(latency), 6) AS median_latency FROM j GROUP BY 1",
    "every_third": "WITH r AS (SELECT source_document, row_number() OVER (ORDER BY source_document) % 3 = 0 AS held_out FROM (SELECT DISTINCT source_document FROM mine_claims_release WHERE source_document IS NOT NULL)) SELECT held_out, count(*) AS n, count(DISTINCT r.source_document) AS n_documents FROM mine_claims_release m JOIN r ON r.source_document = m.source_document GROUP BY 1",
    "cosine_screen": f"WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), s AS (SELECT vec_id, {_DOT.format(a='x', b='y')} / (sqrt({_DOT.format(a='x', b='x')}) * sqrt({_DOT.format(a='y', b='y')})) AS c FROM p) SELECT vec_id, round(c, 6) AS similarity, c < 0.1 AS drifted FROM s",
    "linear_head": f"WITH s AS (SELECT vec_id, {_SCORES} AS sc FROM embeddings), e AS (SELECT vec_id, list_transform(sc, lambda x: exp(x - list_max(sc))) AS ex FROM s), p AS (SELECT vec_id, list_transform(ex, lambda x: x / list_sum(ex)) AS pr FROM e) SELECT vec_id, round(list_max(pr), 6) AS probability, (CASE WHEN list_max(pr) >= 0.15 THEN list_position(pr, list_max(pr)) - 1 ELSE 0 END)::INTEGER AS predicted FROM p",
    "jsonl_roundtrip": "SELECT count(*) AS n, count(sentence) AS n_sentences, sum(length(sentence))::BIGINT AS n_chars, 0::BIGINT AS n_corrupt FROM mine_claims_release",
    "resolve_manifest": "SELECT concat('models/marts/c', CAST(c_custkey AS VARCHAR), '.sql') AS path, CASE WHEN c_custkey % 5 = 0 THEN concat('urn:own:', CAST(c_custkey AS VARCHAR)) ELSE concat('urn:li:dataset:(urn:li:dataPlatform:lake,marts.c', CAST(c_custkey AS VARCHAR), ',PROD)') END AS urn, CASE WHEN c_custkey % 5 = 0 THEN 'explicit' ELSE 'manifest' END AS strategy FROM customer WHERE c_custkey IS NOT NULL",
    "resolve_naming": r"""SELECT path, CASE WHEN s <> '' THEN concat('urn:li:dataset:(urn:li:dataPlatform:lake,', s, '.', t, ',PROD)') END AS urn, CASE WHEN s <> '' THEN 'naming' ELSE 'unresolved' END AS strategy FROM (SELECT DISTINCT file_path AS path, regexp_extract(file_path, '(?:^|/)models/([\w-]+)/(?:.*/)?([\w-]+)\.sql$', 1) AS s, regexp_extract(file_path, '(?:^|/)models/([\w-]+)/(?:.*/)?([\w-]+)\.sql$', 2) AS t FROM mine_dbt_claims WHERE file_path IS NOT NULL)""",
    "stream_verdicts_per_day": "SELECT strftime(ts, '%Y-%m-%d') AS day, CASE event_type WHEN 'purchase' THEN 'PASS' WHEN 'error' THEN 'BLOCK' ELSE 'WARN' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_latest_receipts": "SELECT urn, event_type, event_id FROM (SELECT CAST(user_id AS VARCHAR) AS urn, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS rn FROM events) WHERE rn = 1",
} | _MODELS

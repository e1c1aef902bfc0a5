import hashlib
import hmac

from pyspark.sql import functions as F

from plumbline.functions import hashing, names, text, vectors


def _one(spark, col, **values):
    schema = ", ".join(f"{k} {'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(col.alias("x")).first().x


def test_names(spark):
    assert _one(spark, names.leaf(F.col("p")), p="[version=2.0].[type=x].a.Bc") == "bc"
    assert _one(spark, names.is_pii_tag(F.col("t")), t="urn:li:tag:PersonallyIdentifiable") and not _one(spark, names.is_pii_tag(F.col("t")), t="non-pii")
    assert _one(spark, names.type_token(F.col("t")), t="VARCHAR (255)") == "charactervarying(255)"
    assert _one(spark, names.dataset_urn(F.lit("p"), F.col("r"), F.lit("PROD")), r='"S"."T"') == "urn:li:dataset:(urn:li:dataPlatform:p,S.T,PROD)"


def test_references(spark):
    assert _one(spark, text.strict_references(F.col("t")), t="the column user_id, 'größe_x' field and table other_name") == ["größe_x", "user_id"]
    assert _one(spark, text.loose_references(F.col("t")), t="`Any Run` and snake_case") == ["Any Run", "snake_case"]
    assert _one(spark, text.plain_sentences(F.col("t")), t="First one here. Second one there.  no") == ["First one here.", "Second one there.  no".replace("  ", " ")]


def test_claim_wording(spark):
    cases = [("This is unique", "a", "unique"), ("may be unique", "a", None), ("is the primary key of it", "a", "unique"), ("one row per user", "user_id", "unique"), ("one row per user", "id", None), ("One of: a, b", "c", "accepted_values"), ("one of: a", "c", None), ("must not be null", "c", "not_null"), ("", "c", None)]
    for s, c, want in cases:
        assert _one(spark, text.claim_type(F.col("s"), F.col("c")), s=s, c=c) == want, s


def test_hashing(spark):
    assert hashing.canonical_json({"b": [2, 1], "a": {"y": None, "x": "é"}}) == '{"a":{"x":"é","y":null},"b":[1,2]}'.encode()
    assert _one(spark, hashing.hash_number(F.col("t")), t="x") == int(hashlib.sha256(b"x").hexdigest()[:8], 16)
    assert _one(spark, hashing.signature(b"k")(F.col("t")), t="x") == hmac.new(b"k", b"x", hashlib.sha256).hexdigest()


def test_vectors(spark):
    assert _one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 0.0]) == 1.0
    assert _one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[0.0, 0.0], b=[1.0, 0.0]) is None
    assert _one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[1.0], b=[1.0, 0.0]) is None
    assert _one(spark, vectors.cosine(F.col("a"), F.col("b")), a=[float("nan")], b=[1.0]) is None
    assert abs(sum(_one(spark, vectors.softmax(F.col("a")), a=[1000.0, 999.0])) - 1) < 1e-12

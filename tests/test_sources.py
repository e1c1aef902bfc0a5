import json

import pytest

from plumbline.plans import mutators, predicates, sqlscan
from plumbline.sources import catalog_source, files, live


def test_predicates(spark):
    cases = [("a > 1", "A>1", "T0"), ("a > 1", "1 < a", "T1"), ("a = 1 or a = 2", "a in (2, 1)", "T2"), ("a >= 1 and a <= 5", "a between 1 and 5", "T2"), ("a > 1", "a >= 1", ""), ("a > 1", "b > 1", ""), ("(a = 1 or b = 2) and c = 3", "a = 1 or (b = 2 and c = 3)", "")]
    for a, b, want in cases:
        assert predicates.tier(a, b) == want, (a, b)
    assert predicates.shape("check", "CHECK ((x)::text ~ '^[a-z]+$'::text)") == "pattern"
    assert predicates.allowed_expression("a + 1 > b and c is not null") and not predicates.allowed_expression("lower(a) = 'x'") and not predicates.allowed_expression("a in (select 1)")
    assert predicates.parse("a @@ b") is None


def test_sqlscan(spark):
    schemas = {"t": ["a", "b"], "u": ["a", "c"]}
    got = sqlscan.scan(spark, "with x as (select a, b as z from t) select x.z, count(*) n, max(u.c) m from x join u on x.a = u.a where x.a > 'k' group by x.z", schemas)
    assert got.problem is None and got.lineage == {("t", "b", "z"), ("u", "c", "m")} and got.outputs == ["z", "n", "m"]
    assert sqlscan.scan(spark, "select * from t", schemas, strict=True).problem == "star"
    assert sqlscan.scan(spark, "select a from t union select a from u", schemas, strict=True).problem == "set operation"
    assert sqlscan.scan(spark, "select {{ x }} from t", schemas).problem == "template syntax"
    assert sqlscan.scan(spark, "select a from {{ ref('t') }}", schemas).lineage == {("t", "a", "a")}
    assert sqlscan.scan(spark, "select nope from t", schemas).problem
    assert sqlscan.references(spark, "with x as (select * from s.t) select * from x join u") == ["s.t", "u"]


def test_mutators():
    sql = "select distinct a, sum(b) as c from t where a > 3"
    got = {f: (i, s) for f, i, s in mutators.mutate(sql)}
    assert got["flip_comparison"][1].endswith("a < 3") and got["drop_distinct"][0] == "harmful" and got["upper_keywords"][0] == "benign"
    assert mutators.diff("a\n", "b\n").count("\n") == 5


def test_patch():
    old, new = "a\nb\nc\nd\n", "a\nB\nc\nd\ne\n"
    patch = mutators.diff(old, new)
    assert files.apply_patch(old, patch) == new
    with pytest.raises(files.PatchError):
        files.apply_patch("a\nx\nc\nd\n", patch)


def test_recorder_and_pages(spark, tmp_path):
    r = files.Recorder(tmp_path / "rec")
    r.record("get", {"urn": "x", "n": 1}, {"a": 1})
    assert r.replay("get", {"n": 1, "urn": "x"}) == {"a": 1} and r.frame(spark, "get").count() == 1
    with pytest.raises(LookupError):
        r.replay("get", {"urn": "y"})
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "1.json").write_text(json.dumps({"entities": [{"urn": "a", "kind": "dataset", "fields": ["x"]}, {"kind": "chart"}]}))
    (pages / "2.json").write_text("{broken")
    catalog_source.register(spark)
    got = spark.read.format("catalog_pages").load(str(pages)).collect()
    assert sorted(str(x.problem) for x in got) == ["2.json: JSONDecodeError", "None", "no urn"]


def test_jsonl_and_ddl(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "id int, s string")
    files.write_jsonl(df, str(tmp_path / "j"), "id")
    (tmp_path / "j" / "bad.json").write_text("{oops\n")
    got = files.read_jsonl(spark, str(tmp_path / "j"), "id int, s string").collect()
    assert len(got) == 3 and sum(r._corrupt is not None for r in got) == 1
    ddl = spark.createDataFrame([("t", "create table t (a int not null, b text, constraint ok check (a > 0 and (b is null or length(b) < 5)), primary key (a, b))")], "relation string, text string")
    assert {(r.kind, tuple(r.columns)) for r in live.from_ddl(spark, ddl).collect()} == {("not_null", ("a",)), ("check", ()), ("primary_key", ("a", "b"))}

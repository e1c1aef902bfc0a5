import random

from pyspark.sql import functions as F

from plumbline.llm import splits


def test_spellings(spark):
    forms = ["Own/Na-me", " own/na-me ", "own/na-me.git", "own/na-me/", "https://host.example/own/na-me", "https://host.example/own/na-me.git/", "git@host.example:own/na-me.git", "host.example/own/Na-me", "ssh://git@host.example:22/own/na-me", "HTTP://HOST.EXAMPLE/OWN/NA-ME"]
    df = spark.createDataFrame([(f,) for f in forms], "s string")
    assert {r.k for r in df.select(splits.repo_key(F.col("s")).alias("k")).collect()} == {"own/na-me"}
    files = spark.createDataFrame([("./Models/a.sql",), ("models//a.sql",), (" models\\a.sql",), ("models/./a.sql",)], "s string")
    assert {r.k for r in files.select(splits.file_key(F.col("s")).alias("k")).collect()} == {"models/a.sql"}


def _found(spark, docs, listed):
    d = spark.createDataFrame(docs, "source_kind string, source_document string, origin string")
    o = splits.origins(d, spark.createDataFrame(listed, "repo string, file_path string, b string"))
    return {tuple(r) for r in splits.bound_pairs(o).collect()}


def test_what_binds(spark):
    docs = [(k, d, "clash") for k, d in [
        ("dbt", "o/r"), ("github_clone", "https://h.example/O/R.git"), ("dbt", "models/x.sql"), ("dbt", "models/y.yml"), ("dbt", "p/q"), ("dbt", "o/other"), ("dbt", "z/r"), ("schemastore", "o/r"), ("fhir_r5", "Name"), ("fhir_r5", "NAME "), ("schemastore", "Name"), ("dbt", None), (None, "o/r"), ("dbt", "models/lone.sql"),
    ]]
    listed = [("o/r", "./models/x.sql", ""), ("p/q", "models/x.sql", ""), (None, "models/y.yml", ""), ("far/away", "models/y.yml", ""), ("far/away.git", "models/x.sql", ""), ("o/other", "models/none.sql", ""), ("  ", "models/lone.sql", "")]
    one = ["dbt|models/x.sql", "dbt|models/y.yml", "dbt|o/r", "dbt|p/q", "github_clone|https://h.example/O/R.git"]
    assert _found(spark, docs, listed) == {(a, b) for a in one for b in one if a < b} | {("fhir_r5|NAME ", "fhir_r5|Name")}
    assert _found(spark, [], []) == set()


def test_components_against_a_model(spark):
    for seed in range(2):
        r = random.Random(seed)
        links = [(f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(45)] + [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("h", f"s{i}") for i in range(40)]
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        got = {x.node: x.root for x in splits.connected_components(spark.createDataFrame(links, "a string, b string")).collect()}
        assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in links)}


def test_shares_hold_and_origins_stay_together(spark):
    r = random.Random(1)
    rows = []
    for i in range(3000):
        doc = "big/one" if i % 3 == 0 else f"o/r{int(r.paretovariate(0.8)) % 400}"
        rows.append((i, r.choice(["dbt", "github_clone"]), doc, r.choice(["positive", "negative", None]), r.choice(["unique", "not_null", None, "rare"]), "train"))
    rows += [(5000 + i, None, None, None, None, None) for i in range(30)]
    claims = spark.createDataFrame(rows, "record_id long, source_kind string, source_document string, record_class string, claim_type string, split_name string")
    target = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    none = spark.createDataFrame([], "repo string, file_path string")
    got = splits.stratified_splits(claims.drop("split_name"), none, target).collect()
    assert len(got) == len(rows) and len({(x.origin, x.split_name) for x in got}) == len({x.origin for x in got})
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(sum(x.split_name == name for x in got) / len(got) - share) < 0.03
    assert splits.stratified_splits(claims.drop("split_name").where("false"), none, target).count() == 0


def test_dealing_keeps_every_label_in_proportion():
    r = random.Random(3)
    kinds = {}
    for _ in range(400):
        size = int(r.paretovariate(1.1))
        v = [size, *(sum(r.random() < p for _ in range(size)) for p in (0.5, 0.2, 0.02))]
        kinds[tuple(v)] = kinds.get(tuple(v), 0) + r.choice([1, 1, 5, 1000])
    targets = {"train": 0.8, "validation": 0.1, "test": 0.1}
    got = dict(splits.deal(sorted(kinds.items()), targets))
    assert {v: sum(d.values()) for v, d in got.items()} == kinds
    for c in range(4):
        whole = sum(v[c] * n for v, n in kinds.items())
        for s, t in targets.items():
            assert abs(sum(v[c] * d.get(s, 0) for v, d in got.items()) / whole - t) < 0.005
    assert splits.deal([], targets) == [] and splits.deal([((3, 0), 2)], {"all": 1.0}) == [((3, 0), {"all": 2})]


def test_labels_come_from_the_data(spark):
    rows = [("Positive ", "unique", "k")] * 2000 + [(None, "rare", "k"), ("negative", "unique", None)]
    df = spark.createDataFrame(rows, "record_class string, claim_type string, source_kind string")
    assert splits.record_labels(df) == [("record_class", ("positive",), True), ("claim_type", ("unique",), True), ("source_kind", ("k",), False)]
    assert splits.record_labels(df.where("false")) == [(c, (), False) for c in splits.LABEL_COLUMNS]

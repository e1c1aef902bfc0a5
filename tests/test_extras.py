from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.cli import main
from plumbline.functions import text
from plumbline.functions.names import is_deprecated
from plumbline.operators import receipts, repair
from plumbline.sources import files
from tests.test_checks import EDG, ENT, FLD  # noqa: F401
from tests.test_checks import snap  # noqa: F401


def test_times(spark):
    rows = [("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05",), ("1704164645000",), ("2024-01-02T05:04:05+02:00",), ("yesterday",), (None,), ("99999999999999999999",)]
    got = [r.t for r in spark.createDataFrame(rows, "s string").select(text.parse_time(F.col("s")).alias("t")).collect()]
    at = datetime(2024, 1, 2, 3, 4, 5)
    shown = [None if g is None else g.isoformat() for g in got]
    assert shown == [spark.sql("select timestamp_seconds(1704164645) t").first().t.isoformat()] * 4 + [None] * 3 and at.year == 2024


def test_thresholds():
    assert text.threshold(None, 0.3) == 0.3 and text.threshold(" ", 0.3) == 0.3 and text.threshold("0.5", 0.3) == 0.5
    for bad in ("2", "x", "nan"):
        with pytest.raises(ValueError):
            text.threshold(bad, 0.3)


def test_deprecated_flag(spark):
    df = spark.createDataFrame([(True, {}), (False, {"deprecated": "Yes"}), (None, {"deprecated": "no"}), (None, None)], "f boolean, p map<string,string>")
    assert [r.d for r in df.select(is_deprecated(F.col("f"), F.col("p")).alias("d")).collect()] == [True, True, False, False]


def test_signatures(spark):
    signed = receipts.sign(spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "urn string, n int, z string"), b"k")
    changed = signed.withColumn("n", F.when(F.col("urn") == "b", 3).otherwise(F.col("n")))
    assert {r.urn: r.intact for r in receipts.check_signatures(changed, b"k").collect()} == {"a": True, "b": False}
    assert not receipts.check_signatures(signed, b"other").where("intact").count()


def test_repairs_are_written_and_read_back(spark, snap, tmp_path):  # noqa: F811
    _, dry = repair.apply(snap, str(tmp_path / "no"), tags=repair.propose_tags(snap))
    assert not (tmp_path / "no").exists()
    new, proof = repair.apply(snap, str(tmp_path / "v2"), repair.propose_owners(snap), repair.propose_tags(snap), dry_run=False)
    assert sorted(map(tuple, dry.where("kind like 'pii%'").collect())) == sorted(map(tuple, proof.where("kind like 'pii%'").collect()))
    assert {(r.subject, r.outcome) for r in proof.where("kind = 'unowned_consumed'").collect()} == {("a", "unresolved"), ("e", "resolved")}
    assert (tmp_path / "v2" / "entity").exists() and new.entity.count() == 5


def test_resolution_order(spark):
    paths = spark.createDataFrame([("models/s/a.sql",), ("models/s/b.sql",), ("models/s/c.sql",), ("other.txt",)], "path string")
    m = spark.createDataFrame([("models/s/a.sql", "m:a", "explicit")], "path string, urn string, strategy string")
    e = spark.createDataFrame([("models/s/a.sql", "e:a"), ("models/s/b.sql", "e:b")], "path string, urn string")
    got = {r.path: (r.urn, r.strategy) for r in files.resolve(paths, e, m, "p").collect()}
    assert got["models/s/a.sql"] == ("m:a", "explicit") and got["models/s/b.sql"] == ("e:b", "map") and got["models/s/c.sql"][1] == "naming" and got["other.txt"] == (None, "unresolved")


def test_explain(capsys):
    assert main(["explain"]) == 0 and "unknown_dataset" in capsys.readouterr().out

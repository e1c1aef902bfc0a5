"""Session settings, table loading and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "plumbline", cores: str = "*", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` overrides (dots as ``__``)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python functions find it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline.zip"
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in (".py", ".yaml"):
                z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(at))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a folder of this machine serves a local
    master; on a cluster that would lose rows without an error, so it is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jsc.get() if jsc.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession) -> str:
    """A path in the shared folder that nobody else uses; what is written there goes when the JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/plumbline-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends there, so an executor lost later costs a re-read and not
    a recomputation, and the planner knows the true size."""
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, what a query shuffles is deleted when that query ends, and not when the driver happens to collect its garbage. For jobs of
    many steps, whose shuffles together are a multiple of their input."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Delete what ``cut`` wrote for ``df``; for loops that are done with a round's result."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/plumbline-" in name:
            at = spark._jvm.org.apache.hadoop.fs.Path(name)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

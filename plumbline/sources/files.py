"""Files: JSON lines, manifests, recorded answers, unified diffs."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.names import dataset_urn


def write_jsonl(df: DataFrame, path: str, key: str) -> None:
    """JSON lines sorted by key within range partitions; the committer makes the write atomic."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows that do not parse come with their text in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def manifest_assets(manifest: DataFrame, platform: str) -> DataFrame:
    """manifest(text) of project manifests -> (path, urn, strategy): an explicit urn wins over the one made from schema and name."""
    node = "struct<original_file_path:string,schema:string,name:string,config:struct<meta:struct<env:string>>,meta:struct<dataset_urn:string>,columns:map<string,struct<name:string>>>"
    n = manifest.select(F.explode(F.from_json(F.get_json_object("text", "$.nodes"), f"map<string,{node}>")).alias("id", "n"))
    made = dataset_urn(F.lit(platform), F.concat_ws(".", "n.schema", "n.name"), F.coalesce("n.config.meta.env", F.lit("PROD")))
    urn = F.coalesce("n.meta.dataset_urn", made)
    return n.select(F.col("n.original_file_path").alias("path"), urn.alias("urn"), F.when(F.col("n.meta.dataset_urn").isNotNull(), "explicit").otherwise("manifest").alias("strategy"), F.array_sort(F.map_keys("n.columns")).alias("known"))


def by_naming(paths: DataFrame, platform: str, env: str = "PROD") -> DataFrame:
    """(path) -> urn by the convention models/<schema>/<table>.sql; null urn if the path does not follow it."""
    schema, name = F.regexp_extract("path", r"(?:^|/)models/([\w-]+)/(?:.*/)?([\w-]+)\.sql$", 1), F.regexp_extract("path", r"(?:^|/)models/([\w-]+)/(?:.*/)?([\w-]+)\.sql$", 2)
    ok = schema != ""
    return paths.select("path", F.when(ok, dataset_urn(F.lit(platform), F.concat_ws(".", schema, name), F.lit(env))).alias("urn"), F.when(ok, "naming").otherwise("unresolved").alias("strategy"))


def resolve(paths: DataFrame, explicit: DataFrame, manifest: DataFrame, platform: str) -> DataFrame:
    """paths(path) -> (path, urn, strategy): the manifest first, then an explicit map(path, urn), then the naming convention, else unresolved."""
    m = manifest.select("path", F.struct("urn", "strategy").alias("_m"))
    e = explicit.select("path", F.struct("urn", F.lit("map").alias("strategy")).alias("_e"))
    n = by_naming(paths, platform).select("path", F.struct("urn", "strategy").alias("_n"))
    j = paths.select("path").distinct().join(m, "path", "left").join(e, "path", "left").join(n.distinct(), "path", "left")
    best = F.coalesce("_m", "_e", "_n")
    return j.select("path", best["urn"].alias("urn"), best["strategy"].alias("strategy"))


class Recorder:
    """Answers of a catalog by method and arguments, one file each, so that a run can be replayed without it."""

    def __init__(self, folder: str | Path) -> None:
        self.folder = Path(folder)

    def _path(self, method: str, args: dict) -> Path:
        text = json.dumps(args, sort_keys=True, separators=(",", ":"))
        return self.folder / f"{method}-{hashlib.sha256(text.encode()).hexdigest()[:16]}.json"

    def record(self, method: str, args: dict, answer: object) -> Path:
        self.folder.mkdir(parents=True, exist_ok=True)
        p = self._path(method, args)
        p.write_text(json.dumps(answer, sort_keys=True))
        return p

    def replay(self, method: str, args: dict) -> object:
        p = self._path(method, args)
        if not p.exists():
            raise LookupError(f"not recorded: {method} {args}")
        return json.loads(p.read_text())

    def frame(self, spark: SparkSession, method: str) -> DataFrame:
        """All answers of a method as (file, text)."""
        return spark.read.option("wholetext", True).text(str(self.folder / f"{method}-*.json")).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


class PatchError(ValueError):
    pass


def apply_patch(text: str, patch: str) -> str:
    """A unified diff applied strictly: every context and removed line must be where the hunk says."""
    lines, out, at = text.splitlines(True), [], 0
    hunk = re.compile(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@")
    body = patch.splitlines(True)
    i = 0
    while i < len(body):
        m = hunk.match(body[i])
        if not m:
            if body[i].startswith(("---", "+++", "diff ", "index ", "\\")) or not body[i].strip():
                i += 1
                continue
            raise PatchError(f"unexpected line: {body[i]!r}")
        start = max(0, int(m[1]) - (1 if m[2] != "0" else 0))
        if start < at:
            raise PatchError("hunks overlap")
        out += lines[at:start]
        at, i = start, i + 1
        while i < len(body) and body[i][:1] in " +-\\" and not body[i].startswith(("--- ", "+++ ")):
            mark, rest = body[i][0], body[i][1:]
            i += 1
            if mark == "\\":
                continue
            if mark == "+":
                out.append(rest)
                continue
            if at >= len(lines) or lines[at].rstrip("\n") != rest.rstrip("\n"):
                raise PatchError(f"line {at + 1} is not {rest!r}")
            if mark == " ":
                out.append(lines[at])
            at += 1
    return "".join(out + lines[at:])

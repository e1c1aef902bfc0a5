"""python -m plumbline COMMAND ...: checks from the command line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _show(df: DataFrame, n: int) -> None:
    df.show(n, False)


def main(argv: list[str] | None = None) -> int:
    """Exit code 0 for clean, 1 for findings, 2 for a blocked change."""
    p = argparse.ArgumentParser(prog="plumbline")
    p.add_argument("--rows", type=int, default=50, help="rows to print")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("self-check", "contradictions inside a catalog"), ("references", "references to what does not exist"), ("audit", "a budgeted audit"), ("explain", "the rule table"), ("check", "a change that refers to fields")):
        s = sub.add_parser(name, help=text)
        if name != "explain":
            s.add_argument("catalog", help="folder with cat_entity, cat_field and cat_edge")
        if name == "audit":
            s.add_argument("--budget", type=int, default=50)
        if name == "check":
            s.add_argument("ref", nargs="+", help="urn#field")
    q = sub.add_parser("query", help="a registered query")
    q.add_argument("name")
    q.add_argument("folder")
    a = p.parse_args(argv)

    from plumbline import api
    from plumbline.operators import policy, self_check
    from plumbline.operators.references import asset_key, catalog_orphans, field_key, orphan_report
    from plumbline.operators.snapshot import load
    from plumbline.queries.registry import collect
    from plumbline.session import build_session, table

    if a.command == "explain":
        for r in policy.load().rules:
            print(f"{r.severity:5} {r.id}: {r.message}" + (f" [{r.reason_code}]" if r.reason_code else ""))
        return 0
    spark = build_session("plumbline")
    spark.sparkContext.setLogLevel("ERROR")
    if a.command == "query":
        _show(collect()[0][a.name](spark, a.folder), a.rows)
        return 0
    if a.command == "references":
        found = orphan_report(catalog_orphans(*(table(spark, a.catalog, t) for t in ("cat_entity", "cat_field", "cat_edge"))))
    elif a.command == "self-check":
        found = self_check.run_all(load(spark, a.catalog))
    elif a.command == "audit":
        found = api.audit(load(spark, a.catalog), a.budget).where("outcome <> 'clean'")
    else:
        refs = spark.createDataFrame([(r.partition("#")[0], r.partition("#")[2] or None) for r in a.ref], "urn string, path string").select(asset_key(F.col("urn")).alias("urn"), field_key(F.col("path")).alias("path"))
        found, verdict = api.check(load(spark, a.catalog), refs)
        _show(found, a.rows)
        decision = verdict.first()["decision"]
        print(decision)
        return 2 if decision == "BLOCK" else int(decision == "WARN")
    _show(found, a.rows)
    return int(not found.isEmpty())


if __name__ == "__main__":
    sys.exit(main())

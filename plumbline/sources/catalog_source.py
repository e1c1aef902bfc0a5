"""A Spark data source for catalogs that are read page by page from a folder of JSON pages: one input partition a page."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.session import ship


class CatalogPages(DataSource):
    """``spark.read.format("catalog_pages").load(folder)``: entities with their fields and upstreams; a page that does not parse gives a row with its problem."""

    @classmethod
    def name(cls) -> str:
        return "catalog_pages"

    def schema(self) -> str:
        return "urn string, kind string, owner string, deprecated boolean, fields array<string>, upstreams array<string>, problem string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options.get("path", "."))


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.path).glob("*.json"))] or [InputPartition("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        try:
            page = json.loads(Path(partition.value).read_text())
            entities = page["entities"]
        except (ValueError, KeyError, TypeError) as e:
            yield (None, None, None, None, None, None, f"{Path(partition.value).name}: {type(e).__name__}")
            return
        for e in entities:
            yield (e.get("urn"), e.get("kind"), e.get("owner"), bool(e.get("deprecated")), e.get("fields"), e.get("upstreams"), None if e.get("urn") else "no urn")


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(CatalogPages)

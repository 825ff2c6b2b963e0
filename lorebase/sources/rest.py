"""Paged REST and GraphQL sources as a Python data source; the transport is a function, so recorded replies serve too.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").schema(...).option("fetch", "package.module:function").load("name")

``fetch(resource, cursor)`` returns (list of records, next cursor or None). Each resource is one partition.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Resource(InputPartition):
    def __init__(self, name: str):
        self.name = name


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        module, _, name = options["fetch"].partition(":")
        self.module, self.function = module, name
        self.resources = [r for r in options.get("path", "").split(",") if r]
        self.most = int(options.get("maxpages", "10000"))

    def partitions(self) -> list[InputPartition]:
        return [_Resource(r) for r in self.resources]

    def read(self, partition: _Resource) -> Iterator[tuple]:
        fetch = getattr(importlib.import_module(self.module), self.function)
        cursor = None
        for _ in range(self.most):
            records, cursor = fetch(partition.name, cursor)
            for r in records:
                yield partition.name, str(r.get("id", "")), json.dumps(r)
            if cursor is None:
                return


class PagedSource(DataSource):
    """Rows ``resource, id, value``; the value is JSON, to be parsed with the schema of the service."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "resource string, id string, value string"

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()})

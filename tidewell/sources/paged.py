"""A paged JSON source: pages linked by a token, as an HTTP service gives them, read from files by Spark's own readers' side API.

Options: path (a folder that Python can open), items (the field of a page that holds the rows). Each series is a folder of
files `page-<token>.json`, the first `page-first.json`; a page's `next_page_token` names the next one. Each
series is read by one task, as tokens only lead forward; series are read side by side.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Series(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class PagedReader(DataSourceReader):
    def __init__(self, schema, options):
        self.names = schema.names
        self.root, self.items = options["path"], options.get("items", "bars")

    def partitions(self) -> list[InputPartition]:
        return [Series(os.path.join(self.root, f)) for f in sorted(os.listdir(self.root)) if os.path.isdir(os.path.join(self.root, f))]

    def read(self, partition: Series) -> Iterator[tuple]:
        token = "first"
        symbol = os.path.basename(partition.folder)
        while token:
            with open(os.path.join(partition.folder, f"page-{token}.json"), encoding="utf-8") as f:
                page = json.load(f)
            for row in page.get(self.items) or []:
                row = {"symbol": symbol, **row}
                yield tuple(row.get(n) for n in self.names)
            token = page.get("next_page_token")


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidewell_paged"

    def schema(self) -> str:
        return "symbol string, t string, o double, h double, l double, c double, v long, n long"

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)

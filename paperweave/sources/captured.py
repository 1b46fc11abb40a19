"""A data source of captured search pages: folders <path>/<source>/<yyyy-mm-dd>/<n>.json, read in batch and as a stream.

    register(spark)
    spark.read.format("captured_pages").option("path", folder).load()

Sources and days are in the folder names, so filters on `source` and `captured`
choose folders, and what they leave out is never listed or opened. Scans of one load() share what
was pushed down, so take a load() for each set of filters. A stream's
offset names the last file of each source; a restart goes on after it.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "source string, captured date, page string, body string"
#: Files of one partition at most.
FILES = 64


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def _listed(folder: str) -> list[str]:
    return sorted(os.listdir(folder)) if os.path.isdir(folder) else []


def _read(paths):
    import datetime

    for path in paths:
        day = os.path.basename(os.path.dirname(path))
        with open(path, encoding="utf-8") as f:
            yield os.path.basename(os.path.dirname(os.path.dirname(path))), datetime.date.fromisoformat(day), os.path.basename(path), f.read()


#: Filters that folder names can answer.
_TESTS = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}


class _Batch(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.tests = path, {"source": [], "captured": []}

    def pushFilters(self, filters: list[Filter]):
        """Takes what sources and days decide; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and column in self.tests:
                value = tuple(map(str, f.value)) if isinstance(f, In) else str(f.value)
                self.tests[column].append((type(f), value))
            else:
                yield f

    def _fits(self, column: str, name: str) -> bool:
        return all(_TESTS[kind](name, value) for kind, value in self.tests[column])

    def partitions(self):
        out = []
        for source in (s for s in _listed(self.path) if self._fits("source", s)):
            paths = [f"{self.path}/{source}/{day}/{f}" for day in _listed(f"{self.path}/{source}") if self._fits("captured", day) for f in _listed(f"{self.path}/{source}/{day}") if f.endswith(".json")]
            out += [Files(tuple(paths[i : i + FILES])) for i in range(0, len(paths), FILES)]
        return out

    def read(self, partition):
        return _read(partition.paths if isinstance(partition, Files) else ())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def _after(self, source: str, last: str, upto: str | None = None) -> list[str]:
        names = (f"{day}/{f}" for day in _listed(f"{self.path}/{source}") for f in _listed(f"{self.path}/{source}/{day}") if f.endswith(".json"))
        return [n for n in names if n > last and (upto is None or n <= upto)]

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {s: names[-1] for s in _listed(self.path) if (names := self._after(s, ""))}

    def partitions(self, start: dict, end: dict):
        out = []
        for source, upto in sorted(end.items()):
            names = self._after(source, start.get(source, ""), upto)
            out += [Files(tuple(f"{self.path}/{source}/{n}" for n in names[i : i + FILES])) for i in range(0, len(names), FILES)]
        return out

    def read(self, partition):
        return _read(partition.paths)

    def commit(self, end: dict) -> None:
        """Files stay where they are; the query's checkpoint holds the offset."""


class CapturedPages(DataSource):
    """The option `path` names a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "captured_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"].removeprefix("file://").rstrip("/"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"].removeprefix("file://").rstrip("/"))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed down, which Spark leaves off for Python sources by default."""
    spark.dataSource.register(CapturedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_page(folder: str, source: str, day: str, page: int, body) -> str:
    """Stores a captured page where the source finds it, under its final name only when it is whole."""
    path = f"{folder}/{source}/{day}/{page:08d}.json"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(body if isinstance(body, str) else json.dumps(body))
    os.replace(f"{path}.part", path)
    return path

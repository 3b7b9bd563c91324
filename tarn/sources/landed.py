"""Fetch attempts as a data source: `spark.read.format("landed_attempts").load(folder)`.

What fetchers write is one file of JSON lines for each strategy and stretch of time, in folders strategy=<name>. Each file is a
partition; a filter on the strategy or on the attempt's number is pushed into the reader, and files of other strategies are not
opened. Files are opened through Arrow's file systems, so a folder may be in any store that these know. A line that is no
JSON, or has no page_id, is no attempt and is left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "landed_attempts"
SCHEMA = "page_id bigint, attempt_no int, strategy string, content string, n_links int, link_bearing boolean, error string"
_FIELDS = pa.schema([("page_id", pa.int64()), ("attempt_no", pa.int32()), ("strategy", pa.string()), ("content", pa.string()), ("n_links", pa.int32()), ("link_bearing", pa.bool_()), ("error", pa.string())])
_KINDS = {"page_id": int, "attempt_no": int, "content": str, "n_links": int, "link_bearing": bool, "error": str}
#: Rows of a batch, and characters of their contents.
ROWS, CHARS = 1000, 2 << 20
_COMPARED = {GreaterThan: int.__gt__, GreaterThanOrEqual: int.__ge__, LessThan: int.__lt__, LessThanOrEqual: int.__le__}


@dataclass
class LandedFile(InputPartition):
    strategy: str
    path: str


class LandedReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.strategies: set[str] | None = None
        self.numbers: list[tuple[str, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes what narrows the strategies or the attempts' numbers, and gives back the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("strategy",):
                some = set(f.value) if isinstance(f, In) else {f.value}
                self.strategies = some if self.strategies is None else self.strategies & some
            elif type(f) in _COMPARED and f.attribute == ("attempt_no",) and isinstance(f.value, int):
                self.numbers.append((type(f).__name__, f.value))
            else:
                yield f

    def partitions(self) -> list[LandedFile]:
        store, root = fs.FileSystem.from_uri(self.folder)
        out = []
        for entry in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            folder, _, name = entry.path.rpartition("/")
            strategy = unquote(folder.rpartition("strategy=")[2])
            if entry.type == fs.FileType.File and name.endswith(".jsonl") and "strategy=" in folder and (self.strategies is None or strategy in self.strategies):
                out.append(LandedFile(strategy, entry.path))
        return sorted(out, key=lambda x: x.path) or [LandedFile("", "")]

    def _wanted(self, number: int | None) -> bool:
        by_name = {kind.__name__: test for kind, test in _COMPARED.items()}
        return all(number is not None and by_name[kind](number, value) for kind, value in self.numbers)

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        held: list[dict] = []
        size = 0
        with store.open_input_stream(partition.path) as stream:
            for row in _attempts(stream):
                if not self._wanted(row["attempt_no"]):
                    continue
                held.append(row | {"strategy": partition.strategy})
                size += len(row["content"] or "")
                if len(held) >= ROWS or size >= CHARS:
                    yield pa.RecordBatch.from_pylist(held, schema=_FIELDS)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_FIELDS)


def _attempts(stream) -> Iterator[dict]:
    """The attempts in a stream of JSON lines; values of another kind than their field's are null."""
    rest = b""
    while True:
        block = stream.read(1 << 20)
        *lines, rest = (rest + block).split(b"\n") if block else (rest, b"")
        for line in lines:
            try:
                got = json.loads(line)
            except ValueError:
                continue
            if isinstance(got, dict) and type(got.get("page_id")) is int:
                yield {k: got[k] if type(got.get(k)) is kind else None for k, kind in _KINDS.items()}
        if not block:
            return


class LandedAttempts(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(self.options["path"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The attempts landed in a folder (a URI or an absolute path)."""
    spark.dataSource.register(LandedAttempts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(NAME).load(folder)

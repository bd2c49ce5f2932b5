"""Parsed results as a data source of Spark: `spark.read.format("parsed_results").load(path)`.

A write puts its files beside each other, in the folder and in its mirror if one is named, and counts
once its manifest stands there: a job that fails leaves no file and a batch that is not committed is
seen in neither copy. A manifest names the batch's files with their rows, states and least and greatest
source_file, by which a read skips files before it opens any; the filters are applied to rows too.

`read_results` lets filters reach the source where `spark.sql.python.filterPushdown.enabled` is on; else
Spark applies them to what is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.types import StructType

from quarry.sources.parse import RESULT

#: Rows that a reader hands over, and a writer has as objects, at a time.
BATCH = 512
_PAGE = pa.struct([("page", pa.int32()), ("text", pa.string()), ("method", pa.string()), ("ocr_confidence", pa.float64()), ("flagged", pa.bool_())])
_ARROW = pa.schema([("source_file", pa.string()), ("status", pa.string()), ("error", pa.string()), ("pages", pa.list_(_PAGE))])


def _at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" in path or path.startswith("file:"):
        found, inner = fs.FileSystem.from_uri(path)
        return found, inner.rstrip("/")
    return fs.LocalFileSystem(), path.rstrip("/")


def _manifests(path: str) -> list[dict]:
    system, base = _at(path)
    found = system.get_file_info(fs.FileSelector(f"{base}/_batches", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda i: i.base_name):
        if info.base_name.endswith(".json"):
            with system.open_input_stream(info.path) as f:
                out.append(json.loads(f.read()))
    return out


def _lines(raw: pa.NativeFile) -> Iterator[bytes]:
    rest = b""
    while block := raw.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


@dataclass
class FilePart(InputPartition):
    name: str


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int
    states: list[str]
    least: str
    greatest: str


class ParsedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.equal: dict[str, set] = {}
        self.known: set[str] = set()

    def _only(self, column: str, values: set) -> None:
        self.equal[column] = self.equal[column] & values if column in self.equal else values

    def _may_hold(self, file: dict) -> bool:
        names, states = self.equal.get("source_file"), self.equal.get("status")
        return (names is None or any(file["least"] <= n <= file["greatest"] for n in names)) and (states is None or bool(states & set(file["states"])))

    def partitions(self) -> list[FilePart]:
        return [FilePart(f["name"]) for m in _manifests(self.path) for f in m["files"] if f["rows"] and self._may_hold(f)]

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left to read
            return
        system, base = _at(self.path)
        rows: list[dict] = []
        with system.open_input_stream(f"{base}/{partition.name}") as raw:
            for line in _lines(raw):
                row = json.loads(line)
                if all(row[c] in values for c, values in self.equal.items()) and all(row[c] is not None for c in self.known):
                    rows.append(row)
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class FilteredReader(ParsedReader):
    """The reader for sessions that hand filters to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership and presence of source_file and status; the others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if column not in ("source_file", "status"):
                yield f
            elif isinstance(f, IsNotNull):
                self.known.add(column)
            else:
                self._only(column, {f.value} if isinstance(f, EqualTo) else set(f.value))


class ParsedWriter(DataSourceArrowWriter):
    def __init__(self, paths: list[str], overwrite: bool):
        self.paths, self.overwrite = paths, overwrite
        self.batch = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"{self.batch}/part-{uuid.uuid4().hex}.jsonl"
        rows, states, least, greatest = 0, set(), None, None
        outs = []
        try:
            for path in self.paths:
                system, base = _at(path)
                system.create_dir(f"{base}/{self.batch}", recursive=True)
                outs.append(system.open_output_stream(f"{base}/{name}"))
            for made in (row for batch in iterator for at in range(0, batch.num_rows, BATCH) for row in batch.slice(at, BATCH).to_pylist()):
                line = json.dumps({c: made.get(c) for c in _ARROW.names}, ensure_ascii=False).encode() + b"\n"
                for out in outs:
                    out.write(line)
                rows += 1
                states.add(made["status"])
                least = made["source_file"] if least is None else min(least, made["source_file"])
                greatest = made["source_file"] if greatest is None else max(greatest, made["source_file"])
        finally:
            for out in outs:
                out.close()
        return Written(name, rows, sorted(states), least or "", greatest or "")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """The mirror's manifest first: the folder itself never has a batch that its mirror lacks."""
        files = [vars(m) for m in messages if isinstance(m, Written) and m.rows]
        kept = {m.name for m in messages if isinstance(m, Written) and m.rows}
        for path in reversed(self.paths):
            system, base = _at(path)
            old = [i.path for i in system.get_file_info(fs.FileSelector(f"{base}/_batches", allow_not_found=True))] if self.overwrite else []
            # Files of tasks that ran twice or had no rows are in no message.
            for info in system.get_file_info(fs.FileSelector(f"{base}/{self.batch}", allow_not_found=True)):
                if f"{self.batch}/{info.base_name}" not in kept:
                    system.delete_file(info.path)
            system.create_dir(f"{base}/_batches", recursive=True)
            with system.open_output_stream(f"{base}/_batches/.{self.batch}") as out:
                out.write(json.dumps({"batch": self.batch, "files": files}).encode())
            system.move(f"{base}/_batches/.{self.batch}", f"{base}/_batches/{self.batch}.json")
            for name in old:
                system.delete_file(name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for path in self.paths:
            system, base = _at(path)
            for name in (f"{base}/_batches/.{self.batch}", f"{base}/_batches/{self.batch}.json"):
                if system.get_file_info(name).type == fs.FileType.File:
                    system.delete_file(name)
            if system.get_file_info(f"{base}/{self.batch}").type == fs.FileType.Directory:
                system.delete_dir(f"{base}/{self.batch}")


class ParsedResults(DataSource):
    """Options: path, for reads pushdown (true where the session hands filters on), for writes mirror."""

    @classmethod
    def name(cls) -> str:
        return "parsed_results"

    def schema(self) -> str:
        return RESULT

    def reader(self, schema: StructType) -> DataSourceReader:
        return (FilteredReader if self.options.get("pushdown") == "true" else ParsedReader)(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ParsedWriter([self.options["path"], *([self.options["mirror"]] if self.options.get("mirror") else [])], overwrite)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The committed results under path; registers the source in the session."""
    spark.dataSource.register(ParsedResults)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("parsed_results").option("pushdown", push).load(path)


def write_results(results: DataFrame, path: str, mirror: str | None = None, mode: str = "append") -> None:
    """One batch of results, in the folder and its mirror or in neither."""
    results.sparkSession.dataSource.register(ParsedResults)
    writer = results.write.format("parsed_results").mode(mode)
    (writer.option("mirror", mirror) if mirror else writer).save(path)

"""Pulled pages as a Spark source: ``spark.read.format("paged_logs")`` and ``spark.readStream``.

A pull lands the vendor's answers as they came, page by page:

    <path>/pull=<end of the window in ms>/<instance keys, such as instanceId=es-7>/page=<n from 1>/<files of one answer each>

Files whose names begin with a dot or an underscore don't count. An answer is a JSON object with the records in one field. Each instance of each pull is a partition of its own. Its pages are read in
order until one has fewer records than a page holds, or there is no further one, as the pull itself ends. A page that cannot be
read after some attempts, does not parse, has records that do not fit the schema, or is missing before a later one breaks its
instance: of that instance and pull comes a single row, which names page and reason in ``error``; all others go on. Records are handed on
once their instance is known to be whole; until then they wait in an unnamed temporary file of the task, so a task holds one page and reads it once.

Options: ``path``; ``pageSize`` (50); ``records``, the field of the records (Result); ``begin`` and ``end``, the window on ``timeField`` (timestamp), in
milliseconds, both ends included; ``attempts`` (3). A schema of the records may be given, else it is vendor A's. Added columns: the
instance keys as they are in the schema, ``pull``, ``page`` and ``error``. Rows outside the window are left out, rows that report
an error never. Comparisons with timeField in a filter are looked at while reading, where Spark hands them over.

As a stream the offset is the newest pull; a micro-batch holds the pulls after the last one, all instances side by side. A pull counts
as landed once it has a file ``_DONE``. Files are reached through Arrow's file systems, so path may be a URI.
"""

from __future__ import annotations

import json
import sys
import tempfile
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from logharbor.schemas import VENDOR_A_RAW

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The vendor's page size, and attempts at a page.
PAGE_SIZE, ATTEMPTS = 50, 3
ADDED = "pull BIGINT, page INT, error STRING"
DONE = "_DONE"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme, uri, rest = path.partition(":/")
    if not uri:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if rest.startswith("/") else f"{scheme}:///{rest}")


@dataclass
class Instance(InputPartition):
    """One instance of one pull."""

    folder: str
    pull: int
    keys: dict


class Broken(Exception):
    """An instance that cannot be read to its end."""


class Pages:
    """Pages below a folder."""

    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.path = options["path"]
        self.size = int(options.get("pagesize", PAGE_SIZE))
        self.field = options.get("records", "Result")
        self.time = options.get("timefield", "timestamp")
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.low, self.high = (int(options[k]) if k in options else None for k in ("begin", "end"))

    def files(self) -> tuple[fs.FileSystem, str]:
        return file_system(self.path)

    def pulls(self) -> list[int]:
        """The pulls that have landed as a whole, oldest first."""
        files, root = self.files()
        found = []
        for info in files.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            name = info.base_name
            if name.startswith("pull=") and files.get_file_info(f"{info.path}/{DONE}").type == fs.FileType.File:
                found.append(int(name.removeprefix("pull=")))
        return sorted(found)

    def instances(self, pulls: list[int]) -> list[Instance]:
        files, root = self.files()
        found = {}
        for pull in pulls:
            above = [f"{root}/pull={pull}"]
            while above:
                folder = above.pop()
                # A folder with a first page is not listed here: that is up to the task that reads it.
                if files.get_file_info(f"{folder}/page=1").type != fs.FileType.Directory:
                    below = [i for i in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.type == fs.FileType.Directory]
                    above += [i.path for i in below if not i.base_name.startswith("page=")]
                    if not any(i.base_name.startswith("page=") for i in below):
                        continue
                inside = folder.partition(f"/pull={pull}/")[2]
                found[folder] = Instance(folder, pull, dict(part.split("=", 1) for part in inside.split("/") if part))
        return [found[k] for k in sorted(found)]

    def _answer(self, files: fs.FileSystem, folder: str) -> list[dict]:
        for attempt in range(self.attempts):
            try:
                parts = files.get_file_info(fs.FileSelector(folder))
                records = []
                for part in sorted(p.path for p in parts if p.type == fs.FileType.File and p.base_name[0] not in "._"):
                    with files.open_input_stream(part) as body:
                        got = json.loads(body.read())[self.field]
                    if not isinstance(got, list):
                        raise Broken("no list of records")
                    records += got
                return records
            except OSError as reason:
                if attempt + 1 == self.attempts:
                    raise Broken(str(reason)) from reason
                time.sleep(min(0.1 * 2**attempt, 10))
            except (ValueError, KeyError, TypeError) as reason:
                raise Broken(f"{type(reason).__name__}: {reason}") from reason
        raise Broken("no attempt")

    def _read(self, part: Instance) -> Iterator[tuple[int, pa.RecordBatch]]:
        """(page, its records) of an instance; Broken names the page."""
        files, _ = self.files()
        there = {int(i.base_name[5:]) for i in files.get_file_info(fs.FileSelector(part.folder)) if i.base_name.startswith("page=")}
        page = 1
        while True:
            try:
                if page not in there:
                    if any(p > page for p in there):
                        raise Broken("missing")
                    return
                records = self._answer(files, f"{part.folder}/page={page}")
                yield page, self._batch(records, part, page)
            except Broken as reason:
                raise Broken(f"page {page}: {reason}") from reason
            if len(records) < self.size:
                return
            page += 1

    def _batch(self, records: list[dict], part: Instance, page: int) -> pa.RecordBatch:
        kind = to_arrow_schema(self.schema)
        added = {"pull": part.pull, "page": page, "error": None} | {k: v for k, v in part.keys.items() if k in kind.names}
        try:
            return pa.RecordBatch.from_pylist([{**r, **added} for r in records], kind)
        except (pa.ArrowInvalid, pa.ArrowTypeError, TypeError) as reason:
            raise Broken(f"{type(reason).__name__}: {reason}") from reason

    def rows(self, part: Instance) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as held:
            try:
                with pa.ipc.new_stream(held, to_arrow_schema(self.schema)) as out:
                    for _, batch in self._read(part):
                        out.write_batch(self._inside(batch))
            except Broken as reason:
                row = {k: v for k, v in part.keys.items() if k in self.schema.names} | {"pull": part.pull, "error": str(reason)}
                yield pa.RecordBatch.from_pylist([row], to_arrow_schema(self.schema))
                return
            held.seek(0)
            yield from pa.ipc.open_stream(held)

    def _inside(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of a page that are inside the window."""
        if self.time not in batch.schema.names or (self.low is None and self.high is None):
            return batch
        at = batch.column(self.time).to_pylist()
        keep = [a is not None and (self.low is None or a >= self.low) and (self.high is None or a <= self.high) for a in at]
        return batch.filter(pa.array(keep, pa.bool_()))

    def narrow(self, low: int | None = None, high: int | None = None) -> None:
        if low is not None:
            self.low = low if self.low is None else max(self.low, low)
        if high is not None:
            self.high = high if self.high is None else min(self.high, high)


class PagedReader(DataSourceReader):
    def __init__(self, pages: Pages):
        self.pages = pages

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the time are looked at while reading. Spark checks them again, so all are handed back."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.pages.time,) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.pages.narrow(low=f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.pages.narrow(high=f.value)
            yield f

    def partitions(self) -> list[InputPartition]:
        return self.pages.instances(self.pages.pulls())

    def read(self, partition: Instance) -> Iterator[pa.RecordBatch]:
        return self.pages.rows(partition)


class PagedStreamReader(DataSourceStreamReader):
    def __init__(self, pages: Pages):
        self.pages = pages

    def initialOffset(self) -> dict:
        return {"pull": -1}

    def latestOffset(self) -> dict:
        return {"pull": max(self.pages.pulls(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.pages.instances([p for p in self.pages.pulls() if start["pull"] < p <= end["pull"]])

    def read(self, partition: Instance) -> Iterator[pa.RecordBatch]:
        return self.pages.rows(partition)


class PagedLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_logs"

    def schema(self) -> str:
        return f"{VENDOR_A_RAW}, {ADDED}"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(Pages(schema, self._given()))

    def streamReader(self, schema: StructType) -> PagedStreamReader:
        return PagedStreamReader(Pages(schema, self._given()))

    def _given(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}


def register(spark: SparkSession) -> SparkSession:
    """Make the source known to a session, which hands filters to it from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedLogs)
    return spark


def mark_done(path: str, pull: int) -> None:
    """Say that a pull has landed as a whole."""
    files, root = file_system(path)
    with files.open_output_stream(f"{root}/pull={pull}/{DONE}") as out:
        out.write(b"")

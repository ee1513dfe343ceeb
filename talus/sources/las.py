"""LAS files as a data source: ``spark.read.format("las")`` and ``df.write.format("las")``.

A partition is a range of bytes of one file, so a large file feeds many tasks
and the driver only lists names and sizes. The columns come from the header of
the first file (all headers with the option ``mergeSchema``); a schema that the
reader names itself decodes those columns only. With the option
``skipByBounds``, comparisons of x, y and z with numbers skip files by the
bounds in their headers; Spark hands them over if
``spark.sql.python.filterPushdown.enabled`` is set.

Paths are what Arrow can open: local and shared folders, HDFS, object stores.
``read_whole`` goes through Spark's own file reader for any other store, at the
price of holding each file in memory.
"""

from __future__ import annotations

import re
import sys
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from talus.functions import las_records

SPLIT_BYTES = 64 << 20
FILE_RECORDS = 1_000_000
BATCH = 1 << 16


def opened(path: str):
    """A seekable input of a path or address."""
    store, inside = _store(path)
    return store.open_input_file(inside)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """Addresses and sizes of the files at or below a path, by name."""
    store, inside = _store(path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inside, recursive=True))
    scheme = re.match(r"^[a-z][a-z0-9+.-]*://[^/]*(?=/)", path)
    prefix = scheme.group() if scheme else ""
    files = [(prefix + f.path if f.path.startswith("/") else f.path, f.size) for f in found if f.type == fs.FileType.File]
    return sorted(f for f in files if fnmatch(f[0].rsplit("/", 1)[-1], pattern))


@dataclass
class Bytes(InputPartition):
    path: str
    start: int
    stop: int


class LasReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: StructType) -> None:
        self.files = _listed(options["path"], options.get("pathGlobFilter", "*.las"))
        self.split = int(options.get("splitBytes", SPLIT_BYTES))
        self.schema = schema
        self.limits = {a: [-np.inf, np.inf] for a in "xyz"}

    def partitions(self) -> list[Bytes]:
        return [Bytes(p, at, min(at + self.split, size)) for p, size in self.files for at in range(0, size, self.split)]

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema)
        with opened(partition.path) as f:
            head = las_records.read_header(f)
            for i, axis in enumerate("xyz"):
                high, low = head["bounds"][2 * i : 2 * i + 2]
                if high >= low and (high < self.limits[axis][0] or low > self.limits[axis][1]):
                    return
            size = head["dtype"].itemsize
            # records that begin in the range of bytes
            first, last = (min(max(0, -(-(b - head["start"]) // size)), head["count"]) for b in (partition.start, partition.stop))
            wanted = [c for c in self.schema.names if c not in ("path", "point_number")]
            for at in range(first, last, BATCH):
                cols = las_records.read_range(f, head, at, min(BATCH, last - at), wanted, exact=True)
                number = cols.pop("point_id") if "point_id" not in wanted else np.arange(at, min(at + BATCH, last))
                cols |= {"path": np.full(len(number), partition.path, object), "point_number": number}
                yield pa.RecordBatch.from_arrays([_array(cols[t.name], t.type) for t in target], schema=target)


class BoundedLasReader(LasReader):
    """Skips files by the bounds in their headers."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute[-1] in self.limits:
                own, value = self.limits[f.attribute[-1]], float(f.value)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    own[0] = max(own[0], value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    own[1] = min(own[1], value)
            yield f  # bounds only skip files, rows are compared by Spark


def _array(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """NaN stands for what a file does not have."""
    return pa.array(values, from_pandas=True).cast(kind)


def _plain(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    if column.null_count and not pa.types.is_floating(column.type):
        raise ValueError(f"column {name} has nulls, for which LAS has no value")
    values = column.to_numpy(zero_copy_only=False)
    return values.astype(np.uint8) if values.dtype == bool else values


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class LasWriter(DataSourceArrowWriter):
    """Files of at most ``recordsPerFile`` points; coordinates are rounded to multiples of ``scale``."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.path = options["path"].rstrip("/")
        self.scale = float(options.get("scale", 0.001))
        self.most = int(options.get("recordsPerFile", FILE_RECORDS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: list[str] = []
        held: list[pa.RecordBatch] = []
        for batch in iterator:
            for at in range(0, batch.num_rows, self.most):
                part = batch.slice(at, self.most)
                if sum(b.num_rows for b in held) + part.num_rows > self.most:
                    done.append(self._file(held))
                    held = []
                held.append(part)
        if held:
            done.append(self._file(held))
        return Written(done)

    def _file(self, batches: list[pa.RecordBatch]) -> str:
        """Batches are encoded and written one at a time, so only what has been read is held."""
        axes = [{a: _plain(b, a) for a in "xyz"} for b in batches]
        low = {a: min((float(x[a].min()) for x in axes if len(x[a])), default=0.0) for a in "xyz"}
        high = {a: max((float(x[a].max()) for x in axes if len(x[a])), default=0.0) for a in "xyz"}
        kinds = {name: _plain(batches[0].slice(0, 0), name).dtype for name in batches[0].schema.names}
        layout = las_records.Layout(kinds, low, high, self.scale)
        store, inside = _store(f"{self.path}/part-{uuid.uuid4().hex}.las")
        store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(inside) as f:
            f.write(layout.header(sum(b.num_rows for b in batches)))
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    part = batch.slice(at, BATCH)
                    f.write(layout.records({name: _plain(part, name) for name in part.schema.names}))
        return inside

    def commit(self, messages: list[Written | None]) -> None:
        pass

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = _store(self.path)
        for message in messages:
            for path in message.paths if message else []:
                store.delete_file(path)


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        files = _listed(self.options["path"], self.options.get("pathGlobFilter", "*.las"))
        if not files:
            raise FileNotFoundError(f"no LAS file below {self.options['path']}")
        columns: dict[str, str] = {"path": "string", "point_number": "bigint"}
        for path, _ in files if self.options.get("mergeSchema", "false").lower() == "true" else files[:1]:
            with opened(path) as f:
                for name, kind in las_records.columns_of(las_records.read_header(f)):
                    columns[name] = kind if columns.get(name, kind) == kind else "double"
        return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())

    def reader(self, schema: StructType) -> LasReader:
        bounded = self.options.get("skipByBounds", "false").lower() == "true"
        return (BoundedLasReader if bounded else LasReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> LasWriter:
        if overwrite:
            raise ValueError("LAS folders are appended to; write to a new one instead")
        return LasWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session; the code travels to executors with it."""
    for module in (las_records, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)
    spark.dataSource.register(LasSource)


def read_whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of a schema from files in any store that Spark reads; a file is decoded in one task."""
    wanted = [f.name for f in StructType.fromDDL(schema)]
    target = to_arrow_schema(StructType.fromDDL(schema))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch["content"]:
                f = pa.BufferReader(content.as_buffer())  # reads in place
                head = las_records.read_header(f)
                for at in range(0, head["count"], BATCH):
                    cols = las_records.read_range(f, head, at, min(BATCH, head["count"] - at), wanted, exact=True)
                    yield pa.RecordBatch.from_arrays([_array(cols[t.name], t.type) for t in target], schema=target)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path)
    return files.select("content").mapInArrow(decode, schema)

"""Files in labelled folders as a Spark data source, planned from their metadata.

Planning lists the files below a root once; it decides which are read (by extension, newest N) and packs them into
partitions of about the same bytes, so tasks open only files that are wanted, and of these each once. As a stream the
source hands out files in the order of time and path, at most `per_batch` to a micro-batch.

Options: path; pattern (extensions, without case), default (the label of files that lie at the top), newest (0: all), bytes (of
a partition), per_batch, progress (streams: a folder for the source's place, beside the query's checkpoint).
Columns: path, modificationTime, length, label (the first folder below the root), content (null if a file cannot be
read any more). Paths are those of any store that pyarrow knows (local, hdfs, s3, gs); for others there are `files`'s readers.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modificationTime timestamp, length long, label string, content binary"
ARROW = pa.schema([("path", pa.string()), ("modificationTime", pa.timestamp("us", tz="UTC")), ("length", pa.int64()), ("label", pa.string()), ("content", pa.binary())])
EXTENSIONS = "jpg,jpeg,png"
#: Bytes of contents that a batch of rows holds, about.
BATCH = 32 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass(frozen=True, order=True)
class Entry:
    time: int  # nanoseconds
    path: str
    size: int
    label: str


@dataclass
class Files(InputPartition):
    entries: list[Entry]


class Listing:
    """The wanted files below a root."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.suffixes = tuple(f".{x.strip().lower()}" for x in options.get("pattern", EXTENSIONS).split(","))
        self.default = options.get("default", "text_document")
        self.bytes = int(options.get("bytes", 64 << 20))

    def entries(self) -> list[Entry]:
        store, root = opened(self.root)
        root, out = root.rstrip("/"), []
        for f in store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
            if f.type == pafs.FileType.File and f.path.lower().endswith(self.suffixes):
                below = f.path[len(root) + 1 :].split("/")
                out.append(Entry(f.mtime_ns, f.path, f.size, below[0] if len(below) > 1 else self.default))
        return out

    def packed(self, entries: list[Entry]) -> list[Files]:
        """Partitions of about `bytes`; a larger file is one of its own."""
        parts, size = [], 0
        for e in sorted(entries, key=lambda e: e.path):
            if not parts or size + e.size > self.bytes:
                parts.append(Files([]))
                size = 0
            parts[-1].entries.append(e)
            size += e.size
        return parts

    def read(self, part: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.root)
        rows, size = [], 0
        for e in part.entries:
            try:
                with store.open_input_stream(e.path) as f:
                    content = f.read()
            except OSError:
                content = None
            rows.append((e.path, datetime.fromtimestamp(e.time / 1e9, timezone.utc), e.size, e.label, content))
            size += e.size
            if size >= BATCH:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.listing, self.newest = Listing(options), int(options.get("newest", 0))

    def partitions(self) -> list[Files]:
        entries = self.listing.entries()
        if self.newest:  # of equal times the first path
            entries = heapq.nsmallest(self.newest, entries, key=lambda e: (-e.time, e.path))
        return self.listing.packed(entries) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.listing.read(partition)


class _StreamReader(DataSourceStreamReader):
    """Its place is the time and path of the last file handed out. Spark asks for the latest place without saying where it stands; so
    the place that was committed last is kept in `progress`."""

    def __init__(self, options: dict[str, str]) -> None:
        if "progress" not in options:
            raise ValueError("a stream needs the option progress")
        self.listing, self.per_batch, self.progress = Listing(options), int(options.get("per_batch", 100)), options["progress"]
        self.at = self._kept()

    def _kept(self) -> dict:
        store, path = opened(f"{self.progress}/place.json")
        if store.get_file_info(path).type == pafs.FileType.NotFound:
            return self.initialOffset()
        with store.open_input_stream(path) as f:
            return json.loads(f.read())

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"time": -1, "path": ""}

    def _between(self, start: dict, end: dict | None) -> list[Entry]:
        low = (start["time"], start["path"])
        return [e for e in self.listing.entries() if (e.time, e.path) > low and (end is None or (e.time, e.path) <= (end["time"], end["path"]))]

    def latestOffset(self) -> dict:  # noqa: N802
        new = heapq.nsmallest(self.per_batch, self._between(self.at, None))
        if new:
            self.at = {"time": new[-1].time, "path": new[-1].path}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.listing.packed(self._between(start, end))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.listing.read(partition)

    def commit(self, end: dict) -> None:
        store, folder = opened(self.progress)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/place.new") as f:
            f.write(json.dumps(end).encode())
        store.move(f"{folder}/place.new", f"{folder}/place.json")


class LabelledFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "labelled_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


def labelled(spark: SparkSession, root: str, **options: object) -> DataFrame:
    """The files below root, as rows of SCHEMA."""
    spark.dataSource.register(LabelledFiles)
    return spark.read.format("labelled_files").options(**{k: str(v) for k, v in options.items()}).load(root)


def labelled_stream(spark: SparkSession, root: str, progress: str, **options: object) -> DataFrame:
    spark.dataSource.register(LabelledFiles)
    return spark.readStream.format("labelled_files").options(**{k: str(v) for k, v in options.items()}, progress=progress).load(root)


def write_files(rows: DataFrame, root: str, name: str = "name", content: str = "content") -> int:
    """Writes a file below root for each row; a task that runs again writes the same files. The number of rows."""
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = opened(root)
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{folder.rstrip('/')}/{at}"
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(path) as f:
                    f.write(data or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return sum(r.n for r in rows.select(name, content).mapInArrow(put, "n long").groupBy().sum("n").withColumnRenamed("sum(n)", "n").collect() if r.n)

"""A sink of several parts with one commit, and its reader.

Rows (part, name, content) go to Parquet files in a folder for each part; what counts is a manifest that names
the files of a whole write, made in one step when all tasks have ended. Until then, after a failed task, or
after a lost driver, nothing is to be seen; files that no manifest names are never read. A write that carries a batch
which has a manifest already changes nothing, so a batch that comes again after a restart is harmless; streams
carry their batch numbers.

Options: path; batch (a name of the write, else a new one). mode("overwrite") hides what was
written before. A task that is killed may leave a file; `sweep` deletes old ones that no manifest names. Reading takes part (one of them) if given; null parts, names and contents stay.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

from .labelled import opened

SCHEMA = "part string, name string, content binary"
ARROW = pa.schema([("part", pa.string()), ("name", pa.string()), ("content", pa.binary())])
MANIFESTS = "_manifests"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, int]]  # part, path below the root, rows


@dataclass
class OneFile(InputPartition):
    path: str


def _folder(part: str | None) -> str:
    return "part-null" if part is None else "part-" + "".join(c if c.isascii() and (c.isalnum() or c in "-_") else f"~{ord(c):x}~" for c in part)


class _Parts:
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def put(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """One file for each part that the task has."""
        store, root = opened(self.path)
        made: dict[str | None, tuple[str, pq.ParquetWriter]] = {}
        rows: dict[str | None, int] = {}
        try:
            for batch in batches:
                table = pa.Table.from_batches([batch]).select(ARROW.names).cast(ARROW)
                for part in pc.unique(table["part"]).to_pylist():
                    own = table.filter(pc.is_null(table["part"]) if part is None else pc.equal(table["part"], part))
                    if part not in made:
                        store.create_dir(f"{root}/{_folder(part)}", recursive=True)
                        file = f"{_folder(part)}/{uuid.uuid4().hex}.parquet"
                        made[part] = (file, pq.ParquetWriter(f"{root}/{file}", ARROW, filesystem=store, compression="zstd"))
                    made[part][1].write_table(own)
                    rows[part] = rows.get(part, 0) + own.num_rows
            for _, writer in made.values():
                writer.close()
        except BaseException:
            for file, writer in made.values():
                writer.close()
                store.delete_file(f"{root}/{file}")
            raise
        return Written([(part, file, rows[part]) for part, (file, _) in made.items()])

    def drop(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        for m in messages:
            for _, file, _ in m.files if m is not None else ():
                store.delete_file(f"{root}/{file}")

    def seal(self, messages: list[Written | None], batch: str) -> None:
        store, root = opened(self.path)
        folder = f"{root}/{MANIFESTS}"
        store.create_dir(folder, recursive=True)
        if any(f.path.endswith(f"-{batch}.json") for f in store.get_file_info(pafs.FileSelector(folder))):
            self.drop(messages)
            return
        files = [f for m in messages if m is not None for f in m.files]
        name = f"{time.time_ns():020d}-{batch}"
        with store.open_output_stream(f"{folder}/{name}.new") as f:
            f.write(json.dumps({"files": files, "overwrite": self.overwrite}).encode())
        store.move(f"{folder}/{name}.new", f"{folder}/{name}.json")


def _token(batch: str) -> str:
    return "".join(c if c.isascii() and (c.isalnum() or c == "_") else f"~{ord(c):x}~" for c in batch)


class _Writer(DataSourceArrowWriter):
    def __init__(self, parts: _Parts, batch: str) -> None:
        self.parts, self.batch = parts, batch

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.parts.put(iterator)

    def commit(self, messages: list[Written | None]) -> None:
        self.parts.seal(messages, self.batch)

    def abort(self, messages: list[Written | None]) -> None:
        self.parts.drop(messages)


class _StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, parts: _Parts, query: str) -> None:
        self.parts, self.query = parts, query

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        return self.parts.put(iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803  Spark's name
        self.parts.seal(messages, f"{self.query}_{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.parts.drop(messages)


class _Reader(DataSourceReader):
    def __init__(self, path: str, part: str | None) -> None:
        self.path, self.part = path, part

    def partitions(self) -> list[OneFile]:
        store, root = opened(self.path)
        found = store.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
        files: list[list] = []
        for f in sorted((f for f in found if f.path.endswith(".json")), key=lambda f: f.path):
            with store.open_input_stream(f.path) as s:
                told = json.loads(s.read())
            files = told["files"] if told["overwrite"] else files + told["files"]
        return [OneFile(file) for part, file, _ in files if self.part is None or part == self.part] or [OneFile("")]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        if partition.path:
            store, root = opened(self.path)
            yield from pq.ParquetFile(store.open_input_file(f"{root}/{partition.path}")).iter_batches(batch_size=1000)


class CommittedParts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed_parts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("part"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(_Parts(self.options["path"], overwrite), _token(self.options.get("batch") or uuid.uuid4().hex))

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return _StreamWriter(_Parts(self.options["path"], False), _token(self.options.get("batch", "batch")))


def write_parts(rows: DataFrame, path: str, batch: str | None = None, overwrite: bool = False) -> None:
    """Writes rows (part, name, content) as one."""
    spark = rows.sparkSession
    spark.dataSource.register(CommittedParts)
    writer = rows.select("part", "name", "content").write.format("committed_parts").mode("overwrite" if overwrite else "append").option("path", path)
    (writer.option("batch", batch) if batch else writer).save()


def read_parts(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    """part, name, content of what has been committed."""
    spark.dataSource.register(CommittedParts)
    reader = spark.read.format("committed_parts").option("path", path)
    return (reader.option("part", part) if part else reader).load()


def sweep(path: str, seconds: float = 86_400.0) -> int:
    """Deletes files of at least this age that no manifest names; how many."""
    store, root = opened(path)
    named, old = set(), []
    for f in store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        if f.path.endswith(".json"):
            with store.open_input_stream(f.path) as s:
                named |= {f"{root}/{file}" for _, file, _ in json.loads(s.read())["files"]}
        elif f.path.endswith(".parquet") and f.mtime_ns <= time.time_ns() - seconds * 1e9:
            old.append(f.path)
    stale = [p for p in old if p not in named]
    for p in stale:
        store.delete_file(p)
    return len(stale)

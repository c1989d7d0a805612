"""Files with their sha256 beside them, as a data source: written by executors, all or none of them.

    rows.write.format("digested_files").mode("append").save(folder)     rows: file, content (binary)
    spark.read.format("digested_files").load(folder)                    file, content, told, ok

A task writes into a folder of its own attempt; when all tasks are done, the driver moves what the tasks that count have
named into place, a digest before its file, and removes the rest. A job that fails leaves nothing. Folders are paths or
addresses that pyarrow's file systems reach from every executor.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "file string, content binary, told string, ok boolean"
#: Files that one task reads, about; there are as many tasks as this makes.
FILES_A_TASK = 200
STAGING = "_staging-"


def _place(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def _put(store, path: str, data: bytes) -> None:
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


def _get(store, path: str) -> bytes:
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


@dataclass
class Named(WriterCommitMessage):
    """What a task wrote: (folder of its attempt, names)."""

    folder: str
    names: list[str] = field(default_factory=list)


class Writer(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]):
        missing = {"file", "content"} - set(columns)
        if missing:
            raise ValueError(f"digested_files needs the columns file and content; there is no {sorted(missing)}")
        self.path = options["path"].rstrip("/")
        self.staging = f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = _place(self.path)
        task = TaskContext.get()
        own = Named(f"{self.staging}/{task.partitionId()}-{task.taskAttemptId()}")
        store.create_dir(f"{root}/{own.folder}")
        for row in iterator:
            name, data = row["file"], row["content"]
            if not name or "/" in name or name.startswith((".", "_")) or data is None:
                raise ValueError(f"not a file: {name!r}")
            data = data.encode() if isinstance(data, str) else bytes(data)
            _put(store, f"{root}/{own.folder}/{name}", data)
            _put(store, f"{root}/{own.folder}/{name}.sha256", (hashlib.sha256(data).hexdigest() + "\n").encode())
            own.names.append(name)
        return own

    def commit(self, messages: list) -> None:
        store, root = _place(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same file")
        for m in done:
            for n in m.names:
                for x in (f"{n}.sha256", n):
                    store.move(f"{root}/{m.folder}/{x}", f"{root}/{x}")
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*_place(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]

    def __init__(self, names: tuple[str, ...]):
        super().__init__(names)
        self.names = names


class Reader(DataSourceReader):
    """Every file but digests and what begins with a dot or an underscore; told is the digest beside it, ok whether it is right, null without one."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _place(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(f.base_name for f in found if f.is_file and not f.base_name.endswith(".sha256") and f.base_name[0] not in "._")
        return [Files(tuple(names[i : i + FILES_A_TASK])) for i in range(0, len(names), FILES_A_TASK)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = _place(self.path)
        for name in partition.names:
            data = _get(store, f"{root}/{name}")
            beside = store.get_file_info(f"{root}/{name}.sha256").type != fs.FileType.NotFound
            told = _get(store, f"{root}/{name}.sha256").decode("utf-8", "replace").strip()[:64].lower() if beside else None
            yield name, data, told, None if told is None else told == hashlib.sha256(data).hexdigest()


class DigestedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "digested_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("digested_files appends; equal names are replaced")
        return Writer(dict(self.options), schema.names)


def write(files: DataFrame, folder: str) -> None:
    """Files (file, content) into a folder, each with its digest; equal names of a former job are replaced."""
    files.sparkSession.dataSource.register(DigestedFiles)
    files.select("file", "content").write.format("digested_files").mode("append").save(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(DigestedFiles)
    return spark.read.format("digested_files").load(folder)

"""Files in a folder that tasks and the driver share, by URI or path, through pyarrow's file systems.

A file is written under a temporary name of its own attempt and then moved to
its final name. Content and final name follow from the input alone, so a task
that runs twice leaves the same file; only manifests say which files count.
Tasks write manifests too: each its own lines, as JSON, in the folder MANIFESTS,
which Spark marks as whole when all are there. A folder that holds anything is
never written to.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "manifest"


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("s3a://"):
        uri = f"s3://{uri.removeprefix('s3a://')}"
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class Pending:
    """Writes to a temporary name; commit() moves it."""

    def __init__(self, system: fs.FileSystem, folder: str, name: str):
        system.create_dir(folder, recursive=True)
        self.system, self.final = system, f"{folder}/{name}"
        self.temporary = f"{folder}/_tmp-{uuid.uuid4().hex}-{name}"
        self.out = system.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        if self.system.get_file_info(self.final).type == fs.FileType.NotFound:
            self.system.move(self.temporary, self.final)
        else:  # another attempt at the task was first, with the same content; not every store moves over a file
            self.system.delete_file(self.temporary)

    def drop(self) -> None:
        with contextlib.suppress(Exception):
            self.out.close()
            self.system.delete_file(self.temporary)


def refuse_if_used(uri: str) -> None:
    """Raises where the folder holds anything: files of another run would count as this one's."""
    system, folder = open_fs(uri)
    if system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        raise FileExistsError(f"{uri} is not empty")


def write_manifest(made: DataFrame, folder: str) -> None:
    """Runs `made`, whose tasks write files and give a row for each, and has each task write its rows."""
    made.write.mode("error").json(f"{folder}/{MANIFESTS}")


def read_manifest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    system, base = open_fs(folder)
    if system.get_file_info(f"{base}/{MANIFESTS}/_SUCCESS").type == fs.FileType.NotFound:
        raise FileNotFoundError(f"{folder} has no whole manifest")
    return spark.read.schema(schema).json(f"{folder}/{MANIFESTS}")


def blocks(system: fs.FileSystem, path: str, size: int = 1 << 20) -> Iterator[bytes]:
    with system.open_input_stream(path, compression=None) as f:
        while data := f.read(size):
            yield data


def read_whole(uri_folder: str, name: str) -> bytes:
    system, folder = open_fs(uri_folder)
    with system.open_input_stream(f"{folder}/{name}", compression=None) as f:
        return f.read()


def as_rows(names: list[str], kinds: list[Any], rows: list[tuple]) -> Any:
    import pyarrow as pa

    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

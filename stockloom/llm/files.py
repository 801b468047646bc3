"""Binary files written and read by tasks, in any store that pyarrow knows (file, hdfs, s3, gs).

A task writes each file under a name of its own and only then reports it in the
manifest that Spark stores. A task that is tried again, or twice at once, leaves
files that no manifest names, so readers never meet them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a bare path is a local one."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (fs.LocalFileSystem(), uri)


def put(folder: str, suffix: str, write: Callable[[pa.NativeFile], None]) -> str:
    """Write one file of a fresh name into a shared folder and return its whole name."""
    store, path = located(folder)
    store.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        write(out)
    return f"{folder}/{name}"


def opened(uri: str) -> pa.NativeFile:
    store, path = located(uri)
    return store.open_input_stream(path, compression=None)


def whole(uri: str) -> bytes:
    with opened(uri) as stream:
        return stream.read()


def per_file(manifest: DataFrame, read: Callable[[str], Iterator[pa.RecordBatch]], schema: str, columns: int = 1) -> DataFrame:
    """Read the files that a manifest names, spread over tasks; `read` gets the row's values, the file first."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(columns))):
                yield from read(*row)

    return manifest.repartition(parts).mapInArrow(run, schema)

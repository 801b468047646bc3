"""Stored tables made of parts, of which a new version replaces only some.

A part is a folder of Parquet files. A version's list says which folder holds each part of each
table; one small file, replaced in one step, names the current list. Readers open what the list
names, so they see all tables of one version, whole, while the next is written, and
files of a writer that failed are named by no list. Parts that a version does not replace
stay where they are. There is one writer at a time; a version number is published once,
so a batch that is delivered again changes nothing.

Lists hold one entry for each part, of which there are as many as buckets or months: they are read on the driver.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; a bare path is a local one, s3a is s3."""
    scheme = uri.split("/", 1)[0]
    if ":" not in scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("s3" + uri[3:] if scheme == "s3a:" else uri)


class Pointer:
    """A small JSON file that is replaced in one step: written under another name, then renamed."""

    def __init__(self, root: str, name: str):
        self._fs, path = located(root)
        self._folder, self._path = path, f"{path}/{name}"

    def read(self) -> dict | None:
        if self._fs.get_file_info(self._path).type != fs.FileType.File:
            return None
        with self._fs.open_input_stream(self._path) as f:
            return json.loads(f.read())

    def write(self, content: dict) -> None:
        self._fs.create_dir(self._folder, recursive=True)
        fresh = f"{self._path}.{uuid.uuid4().hex}"
        with self._fs.open_output_stream(fresh) as f:
            f.write(json.dumps(content).encode())
        self._fs.move(fresh, self._path)


def bucket_of(key: str, buckets: int) -> Column:
    """The part that holds a key, when parts are hash buckets."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string")


class PartStore:
    """Tables of parts under a root; `schemas` gives the columns of each, without the part."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root = spark, root.rstrip("/")
        self.schemas = {t: StructType.fromDDL(ddl) for t, ddl in schemas.items()}
        self._pointer = Pointer(f"{self.root}/_versions", "current.json")

    def current(self) -> dict:
        """{"version", "tables": {table: {part: folder}}, "notes"} of the published version; version 0 holds nothing."""
        return self._pointer.read() or {"version": 0, "tables": {t: {} for t in self.schemas}, "notes": {}}

    def write(self, table: str, rows: DataFrame, spread: str, sort: list[str] | None = None) -> dict[str, str]:
        """Write rows, which have a column `part`, into fresh folders; returns the folder of each part. Not published yet.

        `spread` is a column that splits a part over several writers where it is large; `sort` orders the rows of a file.
        """
        fresh = f"{table}/{uuid.uuid4().hex}"
        typed = rows.select("part", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[table]])
        dealt = typed.repartition("part", spread)
        if sort:
            dealt = dealt.sortWithinPartitions("part", *sort)
        dealt.write.partitionBy("part").parquet(f"{self.root}/{fresh}")
        store, path = located(f"{self.root}/{fresh}")
        found = store.get_file_info(fs.FileSelector(path))
        return {i.base_name.split("=", 1)[1]: f"{fresh}/{i.base_name}" for i in found if i.type == fs.FileType.Directory and i.base_name.startswith("part=")}

    def publish(self, version: int, replaced: dict[str, tuple[list[str], dict[str, str]]], notes: dict | None = None) -> None:
        """Make a version current: for each table the parts it replaces and the folders they have now; the rest is kept."""
        now = self.current()
        if version <= now["version"]:
            raise ValueError(f"version {version} is not after the published {now['version']}")
        tables = {t: dict(parts) for t, parts in now["tables"].items()}
        for table, (parts, folders) in replaced.items():
            for p in parts:
                tables[table].pop(p, None)
            tables[table].update(folders)
        content = {"version": version, "tables": tables, "notes": {**now["notes"], **(notes or {})}}
        Pointer(f"{self.root}/_versions", f"{version}.json").write(content)
        self._pointer.write(content)

    def read(self, table: str, parts: list[str] | None = None, folders: dict[str, str] | None = None) -> DataFrame:
        """Rows of a table, or of some of its parts; `folders` reads what is written but not published."""
        known = self.current()["tables"].get(table, {}) if folders is None else folders
        wanted = sorted(known) if parts is None else [p for p in parts if p in known]
        if not wanted:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*[f"{self.root}/{known[p]}" for p in wanted])

    def drop_old(self, keep: int = 2) -> int:
        """Delete folders that none of the newest `keep` versions names, and older lists; returns the number of folders.

        For the writer, between two versions: readers of older versions lose their files.
        """
        store, lists = located(f"{self.root}/_versions")
        numbers = sorted((int(i.base_name[:-5]) for i in store.get_file_info(fs.FileSelector(lists)) if i.base_name[:-5].isdigit()), reverse=True)
        kept = [Pointer(f"{self.root}/_versions", f"{n}.json").read() for n in numbers[:keep]]
        named = {folder for version in kept for parts in version["tables"].values() for folder in parts.values()}
        gone = 0
        _, root = located(self.root)
        for table in self.schemas:
            for run in store.get_file_info(fs.FileSelector(f"{root}/{table}", allow_not_found=True)):
                parts = store.get_file_info(fs.FileSelector(run.path)) if run.type == fs.FileType.Directory else []
                for part in parts:
                    if part.type == fs.FileType.Directory and f"{table}/{run.base_name}/{part.base_name}" not in named:
                        store.delete_dir(part.path)
                        gone += 1
        for n in numbers[keep:]:
            store.delete_file(f"{lists}/{n}.json")
        return gone

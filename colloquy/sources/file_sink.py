"""A sink of named files: one file for each name, whole or not there at all.

    spark.dataSource.register(NamedFiles)
    rows.write.format("named_files").mode("append").option("path", folder).save()

Rows have ``name`` (a path below the folder) and ``content`` (binary or string).
Consecutive rows of one name in a task are pieces of one file, so a large file never
is one row: deal the rows by name and sort them by name and piece before.  A task
writes to a staging folder beside the files and takes length and SHA-256 while it
writes; what it wrote is listed in a manifest there.  The commit renames the files of
all tasks to their names and leaves the manifests under ``_manifests``; a task or job
that fails leaves nothing.  A name that is there already is replaced.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

STAGING, MANIFESTS = "_staging", "_manifests"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    manifest: str
    files: int


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = opened(self.path)
        # each attempt of a task has a folder of its own
        own = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        name, out, digest, size, files = None, None, None, 0, 0
        with store.open_output_stream(f"{own}/manifest") as manifest:

            def close() -> None:
                if out is not None:
                    out.close()
                    manifest.write((json.dumps({"name": name, "staged": f"{own}/{files}", "bytes": size, "sha256": digest.hexdigest()}) + "\n").encode())

            for row in rows:
                if row["name"] != name:
                    close()
                    parts = (row["name"] or "").split("/")
                    if any(p in ("", ".", "..") or p.startswith("_") for p in parts):
                        raise ValueError(f"not a name of a file: {row['name']!r}")
                    name, digest, size, files = row["name"], hashlib.sha256(), 0, files + 1
                    out = store.open_output_stream(f"{own}/{files}")
                content = row["content"]
                content = content.encode() if isinstance(content, str) else bytes(content or b"")
                out.write(content)
                digest.update(content)
                size += len(content)
            close()
        return Written(f"{own}/manifest", files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        folders = set()
        store.create_dir(f"{root}/{MANIFESTS}", recursive=True)
        for i, message in enumerate(m for m in messages if m is not None):
            # one manifest at a time
            with store.open_input_stream(message.manifest) as f:
                listed = f.read().decode().splitlines()
            for line in listed:
                entry = json.loads(line)
                folder = f"{root}/{entry['name']}".rsplit("/", 1)[0]
                if folder not in folders:
                    store.create_dir(folder, recursive=True)
                    folders.add(folder)
                store.move(entry["staged"], f"{root}/{entry['name']}")
            if listed:
                store.move(message.manifest, f"{root}/{MANIFESTS}/{self.job}-{i:05}.json")
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        self._clear(store, root)

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        for folder in (f"{root}/{STAGING}/{self.job}", f"{root}/{STAGING}"):
            info = store.get_file_info(folder)
            if info.type == fs.FileType.Directory and (folder.endswith(self.job) or not store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        if overwrite:
            raise ValueError("named files are added and replaced by name; use mode append")
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("rows need name and content")
        return NamedFilesWriter(self.options["path"])


def write_files(rows: DataFrame, path: str, piece: str | None = None) -> None:
    """Write ``name, content`` to files below ``path``, pieces of one name in order of ``piece``."""
    rows.sparkSession.dataSource.register(NamedFiles)
    order = ["name"] if piece is None else ["name", piece]
    rows.repartition("name").sortWithinPartitions(*order).select("name", "content").write.format("named_files").mode("append").option("path", path).save()


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """``name, bytes, sha256`` of all files that were written below ``path``, of each name the last."""
    listed = spark.read.schema("name string, bytes long, sha256 string").json(f"{path}/{MANIFESTS}")
    rows = listed.select("*", "_metadata.file_modification_time", "_metadata.file_name")
    return rows.groupBy("name").agg(F.max_by(F.struct("bytes", "sha256"), F.struct("file_modification_time", "file_name")).alias("x")).select("name", "x.*")

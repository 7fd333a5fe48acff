"""Data source "backupzip": the files inside ZIP backups with a manifest.json, each checked against it.

Schema: (archive, path, type, size, state, content), state valid, corrupt, missing or extra. Options: path, pattern
(default *.zip), contents (true to fill content). Names that leave the archive are refused. One partition for each archive.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from convoloom.sources.kvsqlite import FilePartition, files_below

SCHEMA = "archive string, path string, type string, size bigint, state string, content binary"
MANIFEST = "manifest.json"


def safe_name(name: str) -> str:
    """The entry's name with forward slashes; names that are absolute or climb are refused."""
    n = posixpath.normpath(name.replace("\\", "/"))
    if n.startswith(("/", "../")) or n == ".." or ":" in n.split("/")[0] or "\0" in n:
        raise ValueError(f"unsafe name in archive: {name!r}")
    return n


def write_backup(target: str, files: dict[str, tuple[str, bytes]], **facts) -> None:
    """Writes files {path: (type, bytes)} and their manifest; the target must not exist."""
    entries = [{"path": p, "size": len(b), "checksum": "sha256:" + hashlib.sha256(b).hexdigest(), "type": t} for p, (t, b) in sorted(files.items())]
    manifest = {"version": "1.0.0", **facts, "files": entries, "stats": {"totalSize": sum(e["size"] for e in entries)}}
    with zipfile.ZipFile(target, "x", zipfile.ZIP_DEFLATED) as z:
        z.writestr(MANIFEST, json.dumps(manifest, indent=2))
        for p, (_, b) in sorted(files.items()):
            z.writestr(safe_name(p), b)


class ZipReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.options = options

    def partitions(self):
        return [FilePartition(p) for p in files_below(self.options["path"], self.options.get("pattern", "*.zip"))]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if partition is None or not partition.value:
            return
        fill = self.options.get("contents", "false") == "true"
        try:
            z = zipfile.ZipFile(partition.value)
        except zipfile.BadZipFile:
            yield partition.value, MANIFEST, "manifest", None, "corrupt", None
            return
        with z:
            names = {}
            for info in z.infolist():
                if not info.is_dir():
                    n = safe_name(info.filename)
                    if n in names:
                        raise ValueError(f"{partition.value}: {n} is there twice")
                    names[n] = info
            try:
                listed = {e["path"]: e for e in json.loads(z.read(MANIFEST))["files"]}
            except (KeyError, ValueError, TypeError):
                yield partition.value, MANIFEST, "manifest", None, "missing" if MANIFEST not in names else "corrupt", None
                return
            for path, e in listed.items():
                info = names.pop(path, None)
                if info is None:
                    yield partition.value, path, e.get("type"), e.get("size"), "missing", None
                    continue
                try:
                    data = z.read(info)
                except (zipfile.BadZipFile, OSError, ValueError):
                    data = None
                good = data is not None and len(data) == e.get("size") and "sha256:" + hashlib.sha256(data).hexdigest() == e.get("checksum")
                yield partition.value, path, e.get("type"), info.file_size, "valid" if good else "corrupt", data if fill and good else None
            for path, info in names.items():
                if path != MANIFEST:
                    yield partition.value, path, None, info.file_size, "extra", None


class BackupZip(DataSource):
    @classmethod
    def name(cls) -> str:
        return "backupzip"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ZipReader:
        return ZipReader(schema, dict(self.options))


def read_backups(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(BackupZip)
    return spark.read.format("backupzip").options(path=path, **options).load()

"""Data source "kvsqlite": two-column key-value tables of SQLite files.

Options: path (a file or a folder, searched for pattern, default *.vscdb), table (default ItemTable), pageRows. The
schema is (file, rowid, key, byte_length, value), or the columns of it that are asked for. Filters on key (equal, prefix) and on nulls go into the SQL. One partition for each file; rows come in pages
by rowid. Files are opened read-only; undecodable values are an error that names file and key.
"""

from __future__ import annotations

import glob
import os
import re
import sqlite3
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, IsNotNull, IsNull, StringStartsWith
from pyspark.sql.types import StructType

SCHEMA = "file string, rowid bigint, key string, byte_length bigint, value string"
TYPES = {"file": pa.string(), "rowid": pa.int64(), "key": pa.string(), "byte_length": pa.int64(), "value": pa.string()}


def local_path(path: str) -> str:
    """A path of a mounted file system; SQLite and ZIP need one, so other schemes are refused."""
    if re.match(r"(?i)^file:", path):
        return re.sub(r"(?i)^file:/+", "/", path)
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+:", path):
        raise ValueError(f"not a mounted path: {path}")
    return path


def files_below(path: str, pattern: str) -> list[str]:
    path = local_path(path)
    return [path] if os.path.isfile(path) else sorted(glob.glob(os.path.join(glob.escape(path), "**", pattern), recursive=True))


def open_read_only(path: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.text_factory = bytes
    return con


class FilePartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class KvReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.options, self.where = options, []
        self.page = int(options.get("pagerows", options.get("pageRows", 256)))
        self.table = options.get("table", "ItemTable")
        if not self.table.replace("_", "").isalnum():
            raise ValueError(f"no table name: {self.table}")

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if isinstance(f, EqualTo) and name == "key":
                self.where.append(("CAST(key AS BLOB) = ?", str(f.value).encode()))
            elif isinstance(f, StringStartsWith) and name == "key":
                raw = f.value.encode()
                self.where.append((f"substr(CAST(key AS BLOB), 1, {len(raw)}) = ?", raw))
            elif isinstance(f, (IsNull, IsNotNull)) and name == "value":
                self.where.append((f"value IS {'NOT ' * isinstance(f, IsNotNull)}NULL", None))
            else:
                yield f

    def partitions(self):
        found = files_below(self.options["path"], self.options.get("pattern", "*.vscdb"))
        return [FilePartition(p) for p in found]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.value:
            return
        want = {"rowid": "rowid", "key": "key", "byte_length": "length(CAST(value AS BLOB))", "value": "CAST(value AS BLOB)"}
        columns = [c for c in self.columns if c in want]
        con = open_read_only(partition.value)
        try:
            if not con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (self.table,)).fetchone():
                return
            conditions = "".join(f" AND {sql}" for sql, _ in self.where)
            values = [v for _, v in self.where if v is not None]
            last = -(2**63)
            while True:
                sql = f"SELECT rowid, {', '.join(want[c] for c in columns) or '1'} FROM {self.table} WHERE rowid > ?{conditions} ORDER BY rowid LIMIT {self.page}"
                rows = con.execute(sql, (last, *values)).fetchall()
                if not rows:
                    return
                last = rows[-1][0]
                data = {"file": [partition.value] * len(rows)} | {c: [self._text(r[i + 1], partition.value) for r in rows] for i, c in enumerate(columns)}
                yield pa.RecordBatch.from_arrays([pa.array(data[c], TYPES[c]) for c in self.columns], names=self.columns)
        finally:
            con.close()

    @staticmethod
    def _text(v, path):
        if isinstance(v, bytes):
            try:
                return v.decode("utf8")
            except UnicodeDecodeError as e:
                raise ValueError(f"{path}: a value is not UTF-8") from e
        return v


class KvSqlite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvsqlite"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> KvReader:
        return KvReader(schema, dict(self.options))


def write_kv(df: DataFrame, folder: str, table: str = "ItemTable") -> None:
    """Writes key, value rows as SQLite files below a shared folder, one for each partition. Rows keep their order inside a partition."""
    path = local_path(folder)

    def go(batches):
        # each partition fills a file of its own in the shared folder and renames it when it is whole
        os.makedirs(path, exist_ok=True)
        part, n = os.path.join(path, f"part-{uuid.uuid4().hex}"), 0
        con = sqlite3.connect(part + ".tmp")
        try:
            con.execute("PRAGMA journal_mode = OFF")
            con.execute("PRAGMA synchronous = OFF")
            con.execute(f"CREATE TABLE {table} (key TEXT, value BLOB)")
            for b in batches:
                con.executemany(f"INSERT INTO {table} VALUES (?, ?)", zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
                n += b.num_rows
            con.commit()
        finally:
            con.close()
        if n:
            os.replace(part + ".tmp", part + ".vscdb")
        else:
            os.remove(part + ".tmp")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    df.select("key", "value").mapInArrow(go, "n bigint").write.format("noop").mode("overwrite").save()


def read_kv(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """A load of a store. columns limits what is read from the files (Spark doesn't tell a Python source which columns a plan needs), so a listing asks for key and byte_length and leaves the values alone."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters on keys
    spark.dataSource.register(KvSqlite)
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    reader = spark.read.format("kvsqlite").options(path=path, **options)
    return (reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns)) if columns else reader).load()

"""Data source "storedb": conversations kept as content-addressed trees of blobs in SQLite files.

meta holds JSON as hexadecimal text with the id of the latest root; a node's bytes list children as a tag (leaf or
subtree), the length 32 and a 32-byte id. Trees are walked in order, each subtree once, leaves as often as they are
referred to. A leaf is JSON, or a record whose field 4 holds JSON. Missing and damaged blobs make a file partial.
Options: path, pattern (default store.db). One partition for each file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.types import StructType

from convoloom.sources.kvsqlite import FilePartition, files_below, open_read_only

SCHEMA = "file string, ordinal int, leaf_hash string, role string, content string, tools string, complete boolean, name string, created_at bigint"
LEAF, SUBTREE, ID_SIZE = 0x0A, 0x12, 32


def references(node: bytes) -> Iterator[tuple[int, str]]:
    """(tag, id) of a node's children in order; bytes that are none are stepped over."""
    i = 0
    while i + 2 <= len(node):
        if node[i] in (LEAF, SUBTREE) and node[i + 1] == ID_SIZE and i + 2 + ID_SIZE <= len(node):
            yield node[i], node[i + 2 : i + 2 + ID_SIZE].hex()
            i += 2 + ID_SIZE
        else:
            i += 1


def varint(data: bytes, i: int) -> tuple[int, int] | None:
    value = shift = 0
    while i < len(data) and shift < 56:
        value |= (data[i] & 0x7F) << shift
        i += 1
        if not data[i - 1] & 0x80:
            return value, i
        shift += 7
    return None


def leaf_object(data: bytes) -> dict | None:
    """The object of a leaf, None if it is damaged."""

    def as_json(raw):
        raw = raw.removeprefix(b"\xef\xbb\xbf")
        if raw[:1] not in (b"{", b"["):
            return None
        try:
            v = json.loads(raw.decode("utf8"))
        except (ValueError, RecursionError):
            return None
        return v if isinstance(v, dict) else None

    direct, i = as_json(data), 0
    while direct is None and i < len(data):
        head = varint(data, i)
        if head is None:
            return None
        tag, i = head
        wire = tag & 7
        if wire == 0:
            skipped = varint(data, i)
            if skipped is None:
                return None
            i = skipped[1]
        elif wire in (1, 5):
            i += 8 if wire == 1 else 4
        elif wire == 2:
            size = varint(data, i)
            if size is None or size[1] + size[0] > len(data):
                return None
            n, i = size
            if tag >> 3 == 4:
                direct = as_json(data[i : i + n])
            i += n
        else:
            return None
    return direct


def as_text(v) -> str:
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))


def tool_results(leaf: dict) -> list[tuple[str, dict]]:
    """(call id, {status, result or error}) of a tool's leaf."""
    if leaf.get("role") != "tool":
        return []
    blocks = [b for b in leaf["content"] if isinstance(b, dict) and b.get("type") in ("tool-result", "tool_result")] if isinstance(leaf.get("content"), list) else []
    out = []
    for call, b, bodies in [(leaf.get("tool_call_id"), leaf, ("content",)), *((b.get("toolCallId") or b.get("tool_call_id"), b, ("result", "output", "experimental_content")) for b in blocks)]:
        if not isinstance(call, str) or not call:
            continue
        body = next((b[k] for k in bodies if b.get(k) is not None), None)
        if b.get("isError") is True or "error" in b:
            out.append((call, {"status": "error", "error": as_text(b.get("error") or body or "error")}))
        else:
            out.append((call, {"status": "completed", **({"result": as_text(body)} if body is not None else {})}))
    return out


def call_params(v) -> dict | None:
    if isinstance(v, str):
        try:
            got = json.loads(v)
        except ValueError:
            got = None
        return got if isinstance(got, dict) else {"_raw": v}
    return v if isinstance(v, dict) else None


def leaf_message(leaf: dict, results: dict, used: set) -> tuple[str, list, bool] | None:
    """(content, tool calls, complete) of a user's or assistant's leaf; None if it holds neither."""
    texts, calls, complete = [], [], True

    def call(name, params, call_id, result=None):
        c = {"name": name, "status": "completed", **({"params": params} if params else {}), **({"result": as_text(result)} if result is not None else {})}
        if isinstance(call_id, str) and call_id in results:
            used.add(call_id)
            c |= results[call_id]
        calls.append(c)

    content = leaf.get("content")
    if isinstance(content, str):
        texts.append(content)
    elif isinstance(content, list):
        for b in content:
            name = isinstance(b, dict) and (b.get("toolName") if b.get("toolName") is not None else b.get("name"))
            if isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str):
                texts.append(b["text"])
            elif isinstance(b, dict) and b.get("type") in ("tool_use", "tool-call", "tool_call") and isinstance(name, str):
                call(name, call_params(next((b[k] for k in ("args", "input", "arguments") if b.get(k) is not None), None)), b.get("toolCallId"), b.get("result"))
            else:
                complete = False
    elif content is not None:
        complete = False
    more = leaf.get("tool_calls")
    for c in more if isinstance(more, list) else []:
        f = c.get("function") if isinstance(c, dict) else None
        if isinstance(f, dict) and isinstance(f.get("name"), str):
            call(f["name"], call_params(f.get("arguments") or None), c.get("id"))
        else:
            complete = False
    complete &= more is None or isinstance(more, list)
    text = "".join(texts)
    return (text, calls, complete) if text or calls else None


def read_conversation(meta: dict, blob) -> tuple[list[tuple], bool]:
    """((leaf id, role, content, tool calls), ...) in order, and whether nothing was missing. blob(id) gives bytes or None."""
    leaves, seen, whole = [], set(), True
    stack = [(SUBTREE, meta.get("latestRootBlobId") or "")]
    while stack:
        tag, id_ = stack.pop()
        if tag == SUBTREE and id_ in seen:
            continue
        data = blob(id_)
        if data is None:
            whole = False
        elif tag == SUBTREE:
            seen.add(id_)
            stack.extend(reversed(list(references(data))))
        elif (obj := leaf_object(data)) is None:
            whole = False
        else:
            leaves.append((id_, obj))
    results, used, out = {k: r for _, leaf in leaves for k, r in tool_results(leaf)}, set(), []
    for id_, leaf in leaves:
        role = leaf.get("role")
        if role in ("user", "assistant"):
            got = leaf_message(leaf, results, used)
            whole &= got is not None and got[2]
            if got:
                out.append((id_, role, got[0], got[1]))
        elif role == "tool":
            whole &= bool(tool_results(leaf))
        elif role != "system":
            whole = False
    return out, whole and used == set(results)


class StoreReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.options = options

    def partitions(self):
        return [FilePartition(p) for p in files_below(self.options["path"], self.options.get("pattern", "store.db"))]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        if partition is None or not partition.value:
            return
        con = open_read_only(partition.value)
        try:
            meta = {}
            for _, v in con.execute("SELECT key, value FROM meta"):
                try:
                    got = json.loads(bytes.fromhex(v.decode() if isinstance(v, bytes) else v))
                except (ValueError, AttributeError):
                    continue
                meta |= got if isinstance(got, dict) else {}

            def blob(id_):
                row = con.execute("SELECT data FROM blobs WHERE id = ?", (id_,)).fetchone()
                return row[0] if row else None

            rows, whole = read_conversation(meta, blob)
        finally:
            con.close()
        for n, (id_, role, content, calls) in enumerate(rows):
            yield partition.value, n, id_, role, content, json.dumps(calls, ensure_ascii=False) if calls else None, whole, meta.get("name"), meta.get("createdAt") if isinstance(meta.get("createdAt"), int) else None


class StoreDb(DataSource):
    @classmethod
    def name(cls) -> str:
        return "storedb"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> StoreReader:
        return StoreReader(schema, dict(self.options))


def read_store(spark: SparkSession, path: str, **options) -> DataFrame:
    spark.dataSource.register(StoreDb)
    return spark.read.format("storedb").options(path=path, **options).load()

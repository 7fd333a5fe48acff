"""Conversations in key-value stores: key shapes, counts by prefix, records, workspace predicates, path rewriting."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoloom.functions.bubbles import read_bubbles
from convoloom.operators.messages import messages
from convoloom.operators.usage import bubbles, token_usage
from convoloom.session import scratch, table
from convoloom.sources.kvsqlite import read_kv, write_kv


def key_part(key: Column, n: int) -> Column:
    """The n-th part of a key, from 0; parts are split by colons."""
    return F.get(F.split(key, ":"), F.lit(n))


def bubble_counts(kv: DataFrame) -> DataFrame:
    """session_id, n_bubbles by the second part of keys bubbleId:session:bubble. Keys only, values stay unread."""
    return kv.where(F.startswith("key", F.lit("bubbleId:"))).groupBy(key_part(F.col("key"), 1).alias("session_id")).agg(F.count("*").alias("n_bubbles"))


def composer_records(kv: DataFrame) -> DataFrame:
    """session_id, v of keys composerData:session whose value is a JSON object; others are dropped."""
    got = kv.where(F.startswith("key", F.lit("composerData:")) & F.col("value").isNotNull()).select(F.expr("substring(key, 14)").alias("session_id"), F.try_parse_json("value").alias("v"))
    return got.where(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))


def live_sessions(kv: DataFrame, again: DataFrame) -> DataFrame:
    """session_id, title, n_bubbles of the records that have bubbles. kv and again are two loads of one store: a Python source keeps one set of pushed filters for each load."""
    return composer_records(kv).join(bubble_counts(again), "session_id").select("session_id", F.try_variant_get("v", "$.name", "string").alias("title"), "n_bubbles")


def belongs_to(v: Column, workspace_id: str, path: str) -> Column:
    """Whether a composer record names a workspace by id, path or URI."""
    get = lambda p: F.try_variant_get(v, p, "string")
    at = "$.workspaceIdentifier"
    uri = F.lit(f"file://{path}")
    return F.coalesce((get(f"{at}.id") == workspace_id) | (get(f"{at}.uri.fsPath") == path) | (get(f"{at}.uri.path") == path) | (get(f"{at}.uri.external") == uri) | (get("$.workspaceUri") == uri), F.lit(False))


def richest_payload(kv: DataFrame, keys: list[str], count: Column) -> DataFrame:
    """file, key, value of the candidate key with most entries in each file, of equals the first in the list."""
    rank = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    best = F.min(F.struct((-F.coalesce(count, F.lit(0))).alias("n"), rank.alias("rank"), "key", "value"))
    return kv.where(F.col("key").isin(*keys)).groupBy("file").agg(best.alias("b")).where("b.n < 0").select("file", "b.key", "b.value")


PATH_PARAMS = ("relativeWorkspacePath", "targetFile", "filePath", "path")  # fixed values


def rebased(path: str, source: str, target: str) -> str | None:
    source = source.rstrip("/")
    return target + path[len(source) :] if path == source or path.startswith(source + "/") else None


def rewrite_paths(value: str, source: str, target: str) -> tuple[str, int, int]:
    """(value, moved, kept) of a stored message: paths in its tool's parameters and its code blocks' URIs that lie below source are moved below target."""
    data, moved, kept = json.loads(value), 0, 0

    def fix(holder, key, head=""):
        nonlocal moved, kept
        v = holder.get(key)
        if isinstance(v, str) and v.startswith(head):
            new = rebased(v[len(head) :], source, target)
            if new is None:
                kept += 1
            else:
                holder[key], moved = head + new, moved + 1

    tool = data.get("toolFormerData")
    if isinstance(tool, dict) and isinstance(tool.get("params"), str):
        try:
            params = json.loads(tool["params"])
        except ValueError:
            params = None
        if isinstance(params, dict):
            before = moved
            for k in PATH_PARAMS:
                fix(params, k)
            if moved > before:
                tool["params"] = json.dumps(params, ensure_ascii=False, separators=(",", ":"))
    for block in data.get("codeBlocks") or []:
        if isinstance(block, dict) and isinstance(block.get("uri"), dict):
            fix(block["uri"], "path")
            fix(block["uri"], "_fsPath")
            fix(block["uri"], "_formatted", "file://")
    return json.dumps(data, ensure_ascii=False, separators=(",", ":")), moved, kept


def move_bubbles(df: DataFrame, key: str, value: str, source: str, target: str) -> DataFrame:
    """key, value, moved, kept; values that aren't JSON objects stay as they are."""

    def one(v):
        try:
            return rewrite_paths(v, source, target) if v is not None and isinstance(json.loads(v), dict) else (v, 0, 0)
        except ValueError:
            return v, 0, 0

    def go(batches):
        for b in batches:
            rows = [one(v) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=[key, value, "moved", "kept"])

    return df.select(key, value).mapInArrow(go, f"{key} {dict(df.dtypes)[key]}, {value} string, moved int, kept int")


def archive_kv(spark, sf_dir: str) -> DataFrame:
    """The archive's messages and sessions as key-value rows."""
    b = bubbles(messages(spark, sf_dir)).select(F.concat_ws(":", F.lit("bubbleId"), "session_id", F.col("msg_id").cast("string")).alias("key"), F.col("bubble").alias("value"))
    s = table(spark, sf_dir, "sessions").where("id is not null").groupBy("id").agg(F.min(F.struct("session_row_id", "title")).alias("s"))
    return b.unionByName(s.select(F.concat(F.lit("composerData:"), "id").alias("key"), F.to_json(F.struct(F.col("s.title").alias("name"), F.col("id").alias("composerId"))).alias("value")))


def stored_kv(spark, sf_dir: str) -> str:
    """The folder of archive_kv, written as SQLite files to the shared folder."""
    folder = scratch(spark, "kv")
    write_kv(archive_kv(spark, sf_dir), folder)
    return folder


def q51_kv_live_sessions(spark, d):
    folder = stored_kv(spark, d)
    return live_sessions(read_kv(spark, folder, ["key", "value"]), read_kv(spark, folder, ["key"]))


def q60_kv_bubbles(spark, d):
    kv = read_kv(spark, stored_kv(spark, d)).where(F.startswith("key", F.lit("bubbleId:"))).select("key", "value")
    usage = kv.select("key", token_usage(F.try_parse_json("value")).alias("u"))
    got = read_bubbles(kv, "key", "value").join(usage, "key")
    return got.select(key_part(F.col("key"), 2).cast("bigint").alias("msg_id"), F.length("content").alias("n_chars"), "corrupted", F.col("u.input").alias("input"))

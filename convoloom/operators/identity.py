"""Stable identities of messages and tool calls, and links that follow them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoloom.functions.canonical import canonical_hash, canonical_json, loads_doubles
from convoloom.functions.ordered import place_in_key
from convoloom.operators.messages import composer_ids, messages
from convoloom.operators.nested import transcript_parts
from convoloom.session import table


def collision_free(candidates: list[str], taken: set[str]) -> list[str]:
    """The candidates in order, each with :collision:n behind it where it is taken, n the smallest that isn't."""
    used, following, out = set(taken), {}, []
    for c in candidates:
        v = c
        if v in used:
            n = following.get(c, 1)
            while f"{c}:collision:{n}" in used:
                n += 1
            v, following[c] = f"{c}:collision:{n}", n + 1
        used.add(v)
        out.append(v)
    return out


def resolve_collisions(rows: DataFrame, key: str, order: list[str], candidate: str, name: str = "identity") -> DataFrame:
    """rows with an identity of its own for each row of a key: the first of equal candidates keeps it, the others get :collision:n by their place. Equal candidates are spread over pieces; candidates that look like another one's collision are left to collision_free."""
    spread = rows.withColumn("__kc", F.concat_ws("\x01", F.coalesce(F.col(key).cast("string"), F.lit("")), candidate))
    placed = place_in_key(spread, "__kc", order, "__n").drop("__kc")
    return placed.withColumn(name, F.when(F.col("__n") == 1, F.col(candidate)).otherwise(F.concat(F.col(candidate), F.lit(":collision:"), (F.col("__n") - 1).cast("string")))).drop("__n")


def tool_identities(message_id: str, calls: list[dict], with_files: bool = True) -> list[str]:
    """Ids of a message's tool calls: their own, else tool:v1, the message, a hash of name and parameters (and files), and which of equal calls it is."""
    seen: dict[str, int] = {}
    out = []
    for c in calls:
        if c.get("id"):
            out.append(c["id"])
            continue
        known = {"name": c["name"], **({"params": c["params"]} if c.get("params") is not None else {}), **({"files": list(c["files"])} if with_files and c.get("files") is not None else {})}
        h = canonical_hash(known)
        seen[h] = seen.get(h, 0) + 1
        out.append(f"tool:v1:{message_id}:{h}:{seen[h]}")
    return out


def tool_fingerprints(parts: DataFrame) -> DataFrame:
    """line_id, part_path, name, fingerprint of each tool call among transcript parts."""
    get = lambda p: F.try_variant_get("part", p, "string")
    calls = parts.where(get("$.type") == "tool_use").select("line_id", "part_path", get("$.name").alias("name"), F.to_json(F.try_variant_get("part", "$.input", "variant")).alias("input"))

    def go(batches):
        for b in batches:
            out = []
            for name, raw in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                params = loads_doubles(raw) if raw and raw != "null" else None
                known = {"name": name or "", **({"params": params} if params is not None else {})}
                out.append(hashlib.sha256(canonical_json(known).encode("utf8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.string())], names=["line_id", "part_path", "name", "fingerprint"])

    return calls.mapInArrow(go, "line_id bigint, part_path string, name string, fingerprint string")


def rewrite_links(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """msg_id, parent_id, unresolved of rows (session_id, msg_id, parent_key): the parent under its new identity (ids: session_id, old, new). unresolved where a parent is named that isn't there."""
    got = rows.join(ids.select("session_id", F.col("old").alias("parent_key"), F.col("new").alias("parent_id")), ["session_id", "parent_key"], "left")
    named = F.coalesce(F.col("parent_key"), F.lit("")) != ""
    return got.select("session_id", "msg_id", "parent_id", (named & F.col("parent_id").isNull()).alias("unresolved"))


def link_states(links: DataFrame) -> DataFrame:
    """session_id, state: partial where any link is unresolved."""
    got = links.groupBy("session_id").agg(F.max(F.col("unresolved").cast("int")).alias("u"), F.sum(F.col("unresolved").cast("bigint")).alias("n_unresolved"))
    return got.select("session_id", F.when(F.col("u") == 1, "partial").otherwise("complete").alias("state"), "n_unresolved")


def message_links(spark, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    rows = table(spark, sf_dir, "messages").where("session_id is not null").select("session_id", "msg_id", "parent_key")
    named = m.where("message_key <> ''").select("session_id", "msg_id", F.col("message_key").alias("old"))
    ids = named.join(composer_ids(m), "msg_id").groupBy("session_id", "old").agg(F.min_by("message_id", "msg_id").alias("new"))
    return rewrite_links(rows, ids)


def q69_collision_ids(spark, d):
    m = messages(spark, d).where("message_key <> ''").select("session_id", "msg_id", "message_key")
    return resolve_collisions(m, "session_id", ["msg_id"], "message_key").select("msg_id", "identity")


def q70_tool_identities(spark, d):
    got = place_in_key(tool_fingerprints(transcript_parts(spark, d)).withColumn("k", F.concat_ws("/", F.col("line_id").cast("string"), "fingerprint")), "k", ["part_path"], "occurrence")
    return got.select("line_id", "part_path", F.concat_ws(":", F.lit("tool:v1"), F.col("line_id").cast("string"), "fingerprint", F.col("occurrence").cast("string")).alias("tool_id"))


def q71_link_rewrite(spark, d):
    return message_links(spark, d).select("msg_id", "parent_id", "unresolved")


def q72_link_states(spark, d):
    return link_states(message_links(spark, d))

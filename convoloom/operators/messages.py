"""Messages of sessions: classes, roles, titles, previews, identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.functions import text
from convoloom.functions.ordered import place_in_key, with_next
from convoloom.session import table

MESSAGE_TYPES = ("user", "assistant", "tool", "thinking", "error")


def legacy_role(role: Column) -> Column:
    """assistant, ai, bot and system are the assistant, all others the user."""
    return F.when(F.lower(role).isin("assistant", "ai", "bot", "system"), "assistant").otherwise("user")


def bubble_role(kind: Column) -> Column:
    return F.when(kind == 2, "assistant").otherwise("user")


def store_role(role: Column) -> Column:
    """user and assistant as they are, system and anything else null: such rows are ignored."""
    return F.when(role.isin("user", "assistant"), role)


def message_type(role: Column, content: Column, n_tools: Column) -> Column:
    """One of MESSAGE_TYPES: the user's role first, then marks at the start of the content, then tool calls."""
    kind = F.when(role == "user", "user").when(content.startswith("[Tool:"), "tool").when(content.startswith("[Thinking]"), "thinking").when(content.startswith("[Error]"), "error")
    return kind.when(n_tools > 0, "tool").otherwise("assistant")


def filter_types(df: DataFrame, types: list[str] | None, column: str = "type") -> DataFrame:
    """Rows of the given types; none or all of them keep everything; unknown ones are an error."""
    unknown = set(types or ()) - set(MESSAGE_TYPES)
    if unknown:
        raise ValueError(f"unknown message types: {sorted(unknown)}")
    return df if not types or set(types) == set(MESSAGE_TYPES) else df.where(F.col(column).isin(*types))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, msg_id (the order), role (legacy), raw_role, content, stack and the rest of messages."""
    m = table(spark, sf_dir, "messages").where("session_id is not null")
    return m.withColumn("raw_role", F.col("role")).withColumn("role", legacy_role(F.col("role")))


def session_heads(m: DataFrame) -> DataFrame:
    """session_id, n_messages, title and preview (of the first user message), listing_preview (of the first message)."""
    user = F.col("role") == "user"
    first = F.min_by("content", F.when(user, F.col("msg_id")))
    heads = m.groupBy("session_id").agg(F.count("*").alias("n_messages"), first.alias("user_text"), F.min_by("content", "msg_id").alias("first_text"))
    return heads.select("session_id", "n_messages", text.title_of(F.col("user_text")).alias("title"), text.preview_of(F.col("user_text")).alias("preview"), text.listing_preview(F.col("first_text")).alias("listing_preview"))


def typed(m: DataFrame) -> DataFrame:
    """msg_id and type; a message of the store stack that names a tool counts as one with a tool call."""
    tools = F.when((F.col("stack") == "store") & F.contains("content", F.lit("[Tool:")), 1).otherwise(0)
    return m.select("msg_id", "session_id", message_type(F.col("role"), F.coalesce("content", F.lit("")), tools).alias("type"))


def composer_ids(m: DataFrame) -> DataFrame:
    """msg_id and message_id: the native key, or msg: and the 0-based place in the session."""
    placed = place_in_key(m.select("session_id", "msg_id", "message_key"), "session_id", ["msg_id"])
    return placed.select("msg_id", F.coalesce(F.when(F.col("message_key") != "", F.col("message_key")), F.concat(F.lit("msg:"), (F.col("place") - 1).cast("string"))).alias("message_id"))


def occurrence_ids(rows: DataFrame, key: str, order: list[str], payload: Column, kind: str) -> DataFrame:
    """rows with store_id: kind, hash of the payload, and the how-manieth of equal payloads in its key this one is. Equal payloads of one key are spread over pieces like a key of their own."""
    hashed = rows.withColumn("fingerprint", F.sha2(payload, 256)).withColumn("__kf", F.concat_ws("/", F.coalesce(F.col(key).cast("string"), F.lit("")), "fingerprint"))
    placed = place_in_key(hashed, "__kf", order, "occurrence").drop("__kf")
    return placed.withColumn("store_id", F.concat_ws(":", F.lit("store:v1"), F.lit(kind), "fingerprint", F.col("occurrence").cast("string")))


def sequential_parents(m: DataFrame) -> DataFrame:
    """msg_id and parent_id: the message before it in its session, null for the first."""
    got = with_next(m.select("session_id", "msg_id"), ["session_id", "msg_id"], ["session_id", "msg_id"], "parents")
    child = got.where(F.col("next.session_id") == F.col("session_id")).select(F.col("next.msg_id").alias("msg_id"), F.col("msg_id").alias("parent_id"))
    return m.select("msg_id").join(child, "msg_id", "left")


def active_branch(m: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, msg_id, parent_id of the messages whose key the session's branch lists, parents rebuilt along what is left."""
    listed = sessions.where("id is not null and size(active_branch_bubble_ids) > 0").select(F.col("id").alias("session_id"), F.explode("active_branch_bubble_ids").alias("message_key")).where("message_key <> ''").distinct()
    kept = m.join(listed, ["session_id", "message_key"], "left_semi").select("session_id", "msg_id")
    return kept.join(sequential_parents(kept), "msg_id").select("session_id", "msg_id", "parent_id")


def blocks(m: DataFrame) -> DataFrame:
    rows = m.where(F.contains("content", F.lit(text.FENCE))).select("msg_id", F.posexplode(text.code_blocks(F.col("content"))).alias("block_no", "b"))
    return rows.select("msg_id", "block_no", "b.language", "b.content", "b.start_line")


def q01_session_summary(spark, d):
    return session_heads(messages(spark, d))


def q09_derive_title(spark, d):
    return session_heads(messages(spark, d)).select("session_id", "title")


def q05_message_type(spark, d):
    return typed(messages(spark, d)).groupBy("type").agg(F.count("*").alias("n"))


def q06_message_filter(spark, d):
    return filter_types(typed(messages(spark, d)), ["tool", "user"]).select("msg_id", "type")


def q07_role_normalize(spark, d):
    return messages(spark, d).select("msg_id", "role")


def q08_store_roles(spark, d):
    got = messages(spark, d).select("msg_id", store_role(F.col("raw_role")).alias("role"))
    return got.where("role is not null")


def q14_code_blocks(spark, d):
    return blocks(messages(spark, d))


def q15_normalize_text(spark, d):
    return messages(spark, d).select("msg_id", text.normalize_text(text.unwrap_query(F.col("content"))).alias("text"), text.content_class(F.col("content")).alias("class"))


def q16_composer_ids(spark, d):
    return composer_ids(messages(spark, d))


def q17_store_ids(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return occurrence_ids(docs.select("doc_id", "source", "text"), "source", ["doc_id"], F.col("text"), "db").select("doc_id", "store_id")


def q18_parent_chain(spark, d):
    return sequential_parents(messages(spark, d))


def q19_active_branch(spark, d):
    return active_branch(messages(spark, d), table(spark, d, "sessions"))

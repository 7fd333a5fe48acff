"""Sessions as JSON and Markdown, in blocks of rows that never need a whole session in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.functions import paths, text
from convoloom.operators.messages import messages, session_heads
from convoloom.operators.timeline import DIRECT, fill_times, metadata_times, session_times, timed_messages
from convoloom.session import table

ATTACHMENT = "convoloom-attachment-v1"


def iso(ms: Column) -> Column:
    """Milliseconds as ISO 8601 in UTC, always with three digits of a second."""
    at = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_millis(ms).cast("timestamp_ntz"))
    year = F.when(F.year(at) > 9999, F.concat(F.lit("+"), F.lpad(F.year(at).cast("string"), 6, "0"))).otherwise(F.lpad(F.year(at).cast("string"), 4, "0"))
    return F.concat(year, F.date_format(at, "-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def source_line(resolved: Column, sources: Column, preferred: Column, state: Column) -> Column:
    """A readable line on where a session is from; null where that goes without saying."""
    db = F.concat(F.lit("Store stack (store.db — "), F.coalesce(state, F.lit("complete")), F.lit(")"))
    transcript = F.concat(F.lit("Store stack (transcript"), F.when(state == "partial", " — partial").otherwise(""), F.lit(")"))
    merged = F.concat(F.lit("merged from "), F.coalesce(F.array_join(sources, " + "), F.lit("composer + store")), F.lit(" (backbone: "), F.coalesce(preferred, F.lit("composer")), F.lit(")"))
    return F.when(resolved == "merged", merged).when(resolved == "store-db", db).when(resolved == "store-transcript", transcript).when(resolved == "store-metadata", F.lit("Store stack (metadata only)"))


def export_messages(spark: SparkSession, sf_dir: str, session: str | None = None) -> DataFrame:
    """session_id, msg_id, role, content, message_key, resolved_ms, resolved_source of all messages, or of one session's, which is picked before anything is sorted."""
    own = lambda df: df if session is None else df.where(F.col("session_id") == session)
    anchors = metadata_times(spark, sf_dir).select("session_id", "meta_created")
    timed = fill_times(own(timed_messages(spark, sf_dir)).join(anchors, "session_id", "left"), "session_id", ["msg_id"], "ms", "source", F.col("meta_created"))
    m = own(messages(spark, sf_dir)).select("session_id", "msg_id", "role", "message_key", F.coalesce("content", F.lit("")).alias("content"))
    return m.join(timed.select("msg_id", "resolved_ms", "resolved_source"), "msg_id")


def export_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, title, created_ms, updated_ms, n_messages, workspace (of the first copy)."""
    s = table(spark, sf_dir, "sessions").where("id is not null").groupBy(F.col("id").alias("session_id")).agg(F.min(F.struct("session_row_id", "workspace")).alias("s")).select("session_id", paths.public_path(F.col("s.workspace")).alias("workspace"))
    heads = session_heads(messages(spark, sf_dir)).select("session_id", "title", "n_messages")
    return heads.join(session_times(timed_messages(spark, sf_dir), metadata_times(spark, sf_dir)), "session_id").join(s, "session_id", "left")


def markdown_head() -> Column:
    lines = [F.concat(F.lit("# "), F.coalesce("title", F.lit("Untitled Chat"))), F.lit(""), F.concat(F.lit("**Date**: "), F.substring(iso(F.col("created_ms")), 1, 10)), F.concat(F.lit("**Last Updated**: "), iso(F.col("updated_ms")))]
    lines += [F.when(F.col("workspace").isNotNull(), F.concat(F.lit("**Workspace**: "), F.col("workspace"))), F.concat(F.lit("**Messages**: "), F.col("n_messages").cast("string")), F.lit(""), F.lit("---"), F.lit("")]
    return F.concat_ws("\n", *lines)


def markdown_message() -> Column:
    approximate = F.when(F.col("resolved_source").isin(*DIRECT), "").otherwise("≈ ")
    has_id = F.col("message_key") != ""
    lines = [F.concat(F.lit("### "), F.when(F.col("role") == "user", "**User**").otherwise("**Assistant**")), F.lit(""), F.when(has_id, F.concat(F.lit("**ID**: `"), F.col("message_key"), F.lit("`"))), F.when(has_id, F.lit(""))]
    lines += [F.concat(F.lit("**Time**: "), approximate, iso(F.col("resolved_ms"))), F.concat(F.lit("**Time Source**: "), F.col("resolved_source")), F.lit(""), F.col("content"), F.lit("")]
    return F.concat_ws("\n", *lines)


def markdown(heads: DataFrame, rows: DataFrame) -> DataFrame:
    """session_id, msg_id (0 for the head), block: the lines of a session's file in order of msg_id."""
    return heads.select("session_id", F.lit(0).cast("bigint").alias("msg_id"), markdown_head().alias("block")).unionByName(rows.select("session_id", "msg_id", markdown_message().alias("block")))


def json_messages(rows: DataFrame) -> DataFrame:
    """session_id, msg_id, json: each message as an object; absent members are left out."""
    obj = F.struct(F.when(F.col("message_key") != "", F.col("message_key")).alias("id"), "role", "content", F.size(text.code_blocks(F.col("content"))).alias("codeBlocks"), F.col("resolved_ms").alias("timestamp"), F.col("resolved_source").alias("timestampSource"))
    return rows.select("session_id", "msg_id", F.to_json(obj).alias("json"))


def write_blocks(blocks: DataFrame, path: str, column: str = "block") -> None:
    """One folder for each session, its lines in order; a session above a file's worth of rows makes several files, named in order."""
    out = blocks.repartitionByRange("session_id", "msg_id").sortWithinPartitions("session_id", "msg_id")
    out.select("session_id", F.col(column).alias("value")).write.partitionBy("session_id").text(path)


def encode_attachment(payload: Column) -> Column:
    """A payload as a fenced block of Base64 inside a message."""
    coded = F.regexp_replace(F.base64(F.encode(payload, "UTF-8")), r"\s", "")
    return F.concat(F.lit(f"```{ATTACHMENT}\n"), coded, F.lit("\n```"))


def decode_attachments(content: Column) -> Column:
    """array<string> of the payloads in a message; blocks that don't come back to the same text when encoded again aren't attachments."""
    coded = F.regexp_extract_all(content, F.lit(rf"(?m)^```{ATTACHMENT}\n([A-Za-z0-9+/=]+)\n```$"), F.lit(1))
    got = F.transform(coded, lambda c: F.when(F.regexp_replace(F.base64(F.unbase64(c)), r"\s", "") == c, F.decode(F.unbase64(c), "UTF-8")))
    return F.filter(got, lambda x: x.isNotNull())


def without_attachments(content: Column) -> Column:
    return F.regexp_replace(content, rf"(?m)\n?^```{ATTACHMENT}\n[A-Za-z0-9+/=]+\n```$", "")


def q43_export_json(spark, d):
    return json_messages(export_messages(spark, d))


def q44_export_markdown(spark, d):
    return markdown(export_heads(spark, d), export_messages(spark, d))


def q47_attachments(spark, d):
    docs = table(spark, d, "documents").where("text <> ''").select("doc_id", "text", F.concat(F.lit("before\n"), encode_attachment(F.col("text")), F.lit("\nafter")).alias("content"))
    back = decode_attachments(F.col("content"))
    return docs.select("doc_id", F.size(back).alias("n"), (F.get(back, F.lit(0)) == F.col("text")).alias("same"), F.length(without_attachments(F.col("content"))).alias("rest"))

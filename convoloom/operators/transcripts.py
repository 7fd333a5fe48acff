"""Transcript lines: what each one is, the messages they hold, and the state of a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoloom.functions import paths, text
from convoloom.functions.canonical import canonical_column
from convoloom.operators.nested import LIST, kind, record, transcript_parts, whole_json
from convoloom.session import table


def _string(v: Column, path: str) -> Column:
    return F.when(kind(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))


def line_facts(lines: DataFrame, key: list[str]) -> DataFrame:
    """key, kind (blank, malformed, error, ignored, message, skip), complete, role, content, tools of each line. A message is a line of user or assistant whose content, a list, has text or a tool call; complete if all of its parts are one of both."""
    v = F.col("v")
    got = lines.select(*key, F.col("raw"), whole_json(F.col("raw")).alias("v"))
    parts = F.try_variant_get(v, "$.message.content", LIST)
    texts = F.transform(parts, lambda p: F.when(_string(p, "$.type") == "text", _string(p, "$.text")))
    calls = F.transform(parts, lambda p: F.when(_string(p, "$.type") == "tool_use", _string(p, "$.name")))
    got = got.select(*key, "raw", "v", kind(v).alias("top"), _string(v, "$.type").alias("type"), _string(v, "$.role").alias("role"), texts.alias("texts"), calls.alias("calls"))
    content, tools = F.array_join("texts", ""), F.filter("calls", lambda x: x.isNotNull())
    is_message = F.col("role").isin("user", "assistant") & F.col("texts").isNotNull() & ((F.length(content) > 0) | (F.size(tools) > 0))
    blank = text.trim_space(F.coalesce("raw", F.lit(""))) == ""
    what = F.when(blank, "blank").when(F.col("v").isNull(), "malformed").when(F.col("top") != "OBJECT", "skip").when(F.col("type") == "error", "error").when(F.col("role") == "system", "ignored").when(is_message, "message").otherwise("skip")
    complete = F.forall(F.zip_with("texts", "calls", lambda a, b: a.isNotNull() | b.isNotNull()), lambda x: x)
    return got.select(*key, what.alias("kind"), F.coalesce(complete, F.lit(False)).alias("complete"), "role", content.alias("content"), tools.alias("tools"))


def transcript_states(facts: DataFrame, key: str) -> DataFrame:
    """key, state and counts: parsed or partial with messages, else error-only, unsupported or empty."""
    n = lambda cond: F.count_if(cond)
    k = F.col("kind")
    got = facts.groupBy(key).agg(n(k == "message").alias("messages"), n(k == "error").alias("errors"), n(k == "malformed").alias("malformed"), n((k == "skip") | ((k == "message") & ~F.col("complete"))).alias("unsupported"), n(k == "ignored").alias("ignored"), n(k != "blank").alias("nonempty"))
    flawed = (F.col("malformed") > 0) | (F.col("unsupported") > 0) | (F.col("errors") > 0)
    state = F.when(F.col("messages") > 0, F.when(flawed, "partial").otherwise("parsed")).when((F.col("errors") > 0) & (F.col("malformed") == 0) & (F.col("unsupported") == 0), "error-only").when(F.col("nonempty") > F.col("ignored"), "unsupported").otherwise("empty")
    return got.select(key, state.alias("state"), "messages", "errors", "malformed", "unsupported", "ignored")


def tool_links(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tool calls and tool results of all transcript parts, with session and call id."""
    lines = table(spark, sf_dir, "transcript_lines").select("line_id", "session_id")
    p = transcript_parts(spark, sf_dir).join(lines, "line_id")
    get = lambda path: F.try_variant_get("part", path, "string")
    calls = p.where(get("$.type") == "tool_use").select("session_id", "line_id", "part_path", get("$.id").alias("call_id"), get("$.name").alias("name"))
    results = p.where(get("$.type") == "tool_result").select("session_id", "line_id", "part_path", get("$.tool_use_id").alias("call_id"))
    return calls, results


def q50_transcript_states(spark, d):
    lines = table(spark, d, "transcript_lines").select("session_id", "line_id", "raw")
    return transcript_states(line_facts(lines, ["session_id", "line_id"]), "session_id")


def q49_transcript_messages(spark, d):
    lines = table(spark, d, "transcript_lines").select("session_id", "line_id", "raw")
    got = line_facts(lines, ["session_id", "line_id"]).where("kind = 'message'")
    return got.select("line_id", "role", F.length("content").alias("n_chars"), F.size("tools").alias("n_tools"), "complete")


def q58_tool_usage(spark, d):
    calls, results = tool_links(spark, d)
    n = results.groupBy("call_id").agg(F.count("*").alias("n_results"))
    got = calls.join(n, "call_id", "left")
    return got.groupBy("name").agg(F.count("*").alias("n_calls"), F.count("n_results").alias("n_answered"), F.count_distinct("session_id").alias("n_sessions"))


def q59_canonical_json(spark, d):
    return canonical_column(table(spark, d, "transcript_lines").where("raw is not null"), "line_id", "raw").select("line_id", "hash")


def q62_dashed_ids(spark, d):
    return table(spark, d, "workspaces").select("workspace_id", paths.dashed_uuid(F.col("workspace_id")).alias("uuid"))


def q64_guid_harvest(spark, d):
    got = table(spark, d, "transcript_lines").select("session_id", F.explode(paths.guids(F.col("raw"))).alias("guid")).distinct()
    return got.where("guid <> session_id")


def q67_compact_numbers(spark, d):
    docs = table(spark, d, "documents").where("n_chars is not null")
    return docs.select("doc_id", text.compact_count(F.col("n_chars") * 37).alias("count"), text.compact_size(F.col("n_chars") * 1000).alias("size"), text.shorten(F.col("session_id"), 12).alias("cut"), text.shorten_start(F.col("session_id"), 12).alias("cut_start"))


def q68_record_wrappers(spark, d):
    """How lines hold their record: plain, wrapped in a JSON string, none."""
    lines = table(spark, d, "transcript_lines").select("line_id", record(F.col("raw")).alias("r"), kind(whole_json(F.col("raw"))).alias("k"))
    return lines.groupBy(F.when(F.col("r").isNull(), "none").when(F.col("k") == "STRING", "wrapped").otherwise("plain").alias("how")).agg(F.count("*").alias("n"))

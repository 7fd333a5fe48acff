"""Tokens, models and other facts inside JSON values of messages and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoloom.operators.messages import messages
from convoloom.operators.nested import record
from convoloom.session import table


def number(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "bigint")


def text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def token_usage(v: Column) -> Column:
    """struct<input, output> of a message's VARIANT: exact counts, else usage, else the context window, else the estimate inside a nested JSON text; each only where above 0; null for none."""
    pair = lambda a, b: F.struct(F.coalesce(a, F.lit(0)).cast("bigint").alias("input"), F.coalesce(b, F.lit(0)).cast("bigint").alias("output"))
    some = lambda a, b: (F.coalesce(a, F.lit(0)) > 0) | (F.coalesce(b, F.lit(0)) > 0)
    a, b = number(v, "$.tokenCount.inputTokens"), number(v, "$.tokenCount.outputTokens")
    c, d = number(v, "$.usage.input_tokens"), number(v, "$.usage.output_tokens")
    w = number(v, "$.contextWindowStatusAtCreation.tokensUsed")
    dry = F.try_parse_json(text(v, "$.promptDryRunInfo"))
    full, user = number(dry, "$.fullConversationTokenCount.numTokens"), number(dry, "$.userMessageTokenCount.numTokens")
    none = F.lit(None).cast("bigint")
    return F.when(some(a, b), pair(a, b)).when(some(c, d), pair(c, d)).when(w > 0, pair(w, none)).when(full > 0, pair(full, none)).when(user > 0, pair(user, none))


def model_name(v: Column) -> Column:
    m = text(v, "$.modelInfo.modelName")
    return F.when(F.trim(m) != "", m)


def duration_ms(v: Column) -> Column:
    d = F.try_variant_get(v, "$.timingInfo.clientEndTime", "double") - F.try_variant_get(v, "$.timingInfo.clientStartTime", "double")
    return F.when(d > 0, d)


def context_window(v: Column) -> Column:
    """struct<used, limit, percent>; null unless all three are numbers."""
    at = "$.contextWindowStatusAtCreation."
    used, limit = number(v, at + "tokensUsed"), number(v, at + "tokenLimit")
    percent = F.coalesce(F.try_variant_get(v, at + "percentageRemainingFloat", "double"), F.try_variant_get(v, at + "percentageRemaining", "double"))
    return F.when(used.isNotNull() & limit.isNotNull() & percent.isNotNull(), F.struct(used.alias("used"), limit.alias("limit"), percent.alias("percent")))


def bubbles(m: DataFrame) -> DataFrame:
    """msg_id, session_id, bubble: message rows as the JSON values their stacks write, one form of token counts each."""
    inp, out = F.col("token_count.input_tokens"), F.col("token_count.output_tokens")
    exact = F.when(F.col("stack") == "composer", F.struct(inp.alias("inputTokens"), out.alias("outputTokens")))
    usage = F.when(F.col("stack") == "both", F.struct(inp.alias("input_tokens"), out.alias("output_tokens")))
    window = F.when(F.col("stack") == "store", F.struct(inp.alias("tokensUsed"), F.lit(200000).alias("tokenLimit"), F.lit(50).alias("percentageRemaining")))
    dry = F.when(F.col("role") == "user", F.to_json(F.struct(F.struct(F.length("content").alias("numTokens")).alias("userMessageTokenCount"))))
    model = F.when(F.col("model").isNotNull(), F.struct(F.col("model").alias("modelName")))
    return m.select("msg_id", "session_id", F.to_json(F.struct(F.coalesce("message_key", F.lit("")).alias("bubbleId"), F.when(F.col("role") == "user", 1).otherwise(2).alias("type"), F.col("content").alias("text"), exact.alias("tokenCount"), usage.alias("usage"), window.alias("contextWindowStatusAtCreation"), dry.alias("promptDryRunInfo"), model.alias("modelInfo"))).alias("bubble"))


def message_usage(m: DataFrame) -> DataFrame:
    v = bubbles(m).select("msg_id", "session_id", F.try_parse_json("bubble").alias("v"))
    return v.select("msg_id", "session_id", token_usage(F.col("v")).alias("u"), model_name(F.col("v")).alias("model"), context_window(F.col("v")).alias("w"))


def session_usage(usage: DataFrame) -> DataFrame:
    """session_id, total_input, total_output (null where no message has counts), n_counted."""
    return usage.groupBy("session_id").agg(F.sum("u.input").alias("total_input"), F.sum("u.output").alias("total_output"), F.count("u").alias("n_counted"))


def q27_json_cascade(spark, d):
    v = table(spark, d, "transcript_lines").select("line_id", record(F.col("raw")).alias("v")).where("v is not null")
    parent = F.coalesce(text(F.col("v"), "$.parentMessageId"), text(F.col("v"), "$.parentId"), text(F.col("v"), "$.message.parentMessageId"))
    return v.select("line_id", F.coalesce(text(F.col("v"), "$.role"), text(F.col("v"), "$.type")).alias("role"), parent.alias("parent"), text(F.col("v"), "$.message.content[0].text").alias("first_text"))


def q28_token_usage(spark, d):
    return message_usage(messages(spark, d)).where("u is not null").select("msg_id", F.col("u.input").alias("input"), F.col("u.output").alias("output"))


def q29_session_usage(spark, d):
    return session_usage(message_usage(messages(spark, d)))


def q57_model_rollup(spark, d):
    return message_usage(messages(spark, d)).where("model is not null").groupBy("model").agg(F.count("*").alias("n_messages"), F.sum("u.output").alias("output_tokens"), F.count("w").alias("n_windows"))

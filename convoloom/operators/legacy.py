"""Older chat payloads: several layouts under alternative names, read into sessions and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoloom.functions import paths
from convoloom.operators.messages import legacy_role
from convoloom.operators.nested import LIST, kind

CHAT_KEYS = ("composer.composerData", "workbench.panel.aichat.view.aichat.chatdata", "workbench.panel.chat.view.chat.chatdata")  # fixed values


def _text(v: Column, *names: str) -> Column:
    """The first of the members that is there, as text."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "string") for n in names])


def _list(v: Column, *names: str) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", LIST) for n in names])


def stored_ms(v: Column) -> Column:
    """Milliseconds of a stored time: a number, digits or ISO 8601; null for anything else."""
    return F.coalesce(F.when(v.rlike(r"^-?\d{1,18}(\.\d+)?$"), v.try_cast("double").cast("bigint")), F.unix_millis(F.try_to_timestamp(v)))


def layout(v: Column) -> Column:
    """composer, heads, sessions or null of a chat payload."""
    is_list = kind(v) == "ARRAY"
    return F.when(F.try_variant_get(v, "$.allComposers", LIST).isNotNull() | is_list, F.when(is_list, "heads").otherwise("composer")).when(_list(v, "chatSessions", "tabs").isNotNull(), "sessions")


def legacy_sessions(payloads: DataFrame, key: str, raw: str) -> DataFrame:
    """key, session_no, session_id, title, created_ms, updated_ms, v of the sessions in payloads with chatSessions or tabs. Sessions without messages are dropped; texts that aren't JSON hold none."""
    got = payloads.select(key, F.posexplode(_list(F.try_parse_json(raw), "chatSessions", "tabs")).alias("session_no", "v"))
    rows = got.where(F.size(F.coalesce(_list(F.col("v"), "messages", "bubbles"), F.array().cast(LIST))) > 0)
    v = F.col("v")
    return rows.select(key, "session_no", _text(v, "id").alias("session_id"), _text(v, "title").alias("title"), stored_ms(_text(v, "createdAt")).alias("created_ms"), stored_ms(_text(v, "lastUpdatedAt", "lastSendTime")).alias("updated_ms"), "v")


def legacy_messages(sessions: DataFrame, key: str) -> DataFrame:
    """key, session_no, message_no, message_id, role, content, ms of their messages; a missing or empty id is msg: and the message's place."""
    got = sessions.select(key, "session_no", F.posexplode(_list(F.col("v"), "messages", "bubbles")).alias("message_no", "m"))
    m, own = F.col("m"), _text(F.col("m"), "id")
    return got.select(key, "session_no", "message_no", F.when(own != "", own).otherwise(F.concat(F.lit("msg:"), F.col("message_no").cast("string"))).alias("message_id"), legacy_role(_text(m, "role", "type")).alias("role"), F.coalesce(_text(m, "content", "text"), F.lit("")).alias("content"), stored_ms(_text(m, "timestamp", "createdAt")).alias("ms"))


def composer_heads(payloads: DataFrame, key: str, raw: str) -> DataFrame:
    """key, composer_id, name, created_ms, updated_ms of payloads with allComposers or a bare list of heads; without either, the ids under selectedComposerIds."""
    v = F.try_parse_json(raw)
    heads = F.coalesce(F.try_variant_get(v, "$.allComposers", LIST), F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", LIST)))
    chosen = F.transform(F.try_variant_get(v, "$.selectedComposerIds", "array<string>"), lambda i: F.to_variant_object(F.struct(i.alias("composerId"))))
    got = payloads.select(key, F.explode(F.coalesce(heads, chosen)).alias("h"))
    h = F.col("h")
    return got.select(key, _text(h, "composerId").alias("composer_id"), _text(h, "name").alias("name"), stored_ms(_text(h, "createdAt")).alias("created_ms"), stored_ms(_text(h, "lastUpdatedAt")).alias("updated_ms")).where("composer_id <> ''").dropDuplicates([key, "composer_id"])


def attach_generations(heads: DataFrame, generations: DataFrame, key: str, slack: int = 60_000) -> DataFrame:
    """heads with the generations (key, ms, text) of their span; open ends hold everything, the end is loose by slack."""
    inside = (F.col("ms") >= F.coalesce("created_ms", F.lit(-(2**62)))) & (F.col("ms") <= F.coalesce("updated_ms", F.lit(2**61)) + slack)
    return heads.join(generations, key).where(inside)


def descriptor_path(raw: Column) -> Column:
    """The path a workspace descriptor names: its folder, workspace or configuration."""
    return paths.public_path(_text(F.try_parse_json(raw), "folder", "workspace", "configuration"))

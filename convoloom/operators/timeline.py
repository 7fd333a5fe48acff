"""Times of messages and sessions: cascades, provenance, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.functions.ordered import nearest_values
from convoloom.operators.replicas import valid_ms
from convoloom.session import table

# Where a message's time can come from; the first three are direct.
DIRECT = ("composer-created-at", "composer-timing", "store-turn-timing")
INFERRED = ("inferred-next", "inferred-previous", "session-fallback", "unknown")


def stored_ms(value: Column) -> Column:
    """A stored date: digits are milliseconds, else ISO 8601 in UTC with milliseconds; anything else null."""
    iso = F.when(value.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"), F.unix_millis(F.try_to_timestamp(value)))
    return F.coalesce(F.when(value.rlike(r"^\d{1,18}$"), value.try_cast("bigint")), iso)


def timing_cascade(created: Column, rpc: Column, settle: Column, end: Column) -> tuple[Column, Column]:
    """(milliseconds, source) of a message: its creation, else the first timing after September 2001."""
    late = lambda c: F.when(c > 1_000_000_000_000, c)
    timing = F.coalesce(late(rpc), late(settle), late(end))
    return F.coalesce(created, timing), F.when(created.isNotNull(), DIRECT[0]).when(timing.isNotNull(), DIRECT[1])


def fill_times(rows: DataFrame, key: str, order: list[str], ms: str, source: str, anchor: Column) -> DataFrame:
    """rows with resolved_ms and resolved_source. Direct times stay; known times of unknown source stay and never help others; the rest take the next direct time of their key, else the previous one, else the anchor, else 1970."""
    direct = F.when(F.col(ms).isNotNull() & F.col(source).isin(*DIRECT), F.col(ms))
    got = nearest_values(rows.withColumn("__d", direct), key, order, "__d", "__prev", "__next")
    kept = F.col(ms).isNotNull() & (F.col(source).isNull() | (F.col(source) == "unknown"))
    d, p, n = F.col("__d"), F.col("__prev"), F.col("__next")
    value = F.when(d.isNotNull(), d).when(kept, F.col(ms)).otherwise(F.coalesce(n, p, anchor, F.lit(0)))
    label = F.when(d.isNotNull(), F.col(source)).when(kept, "unknown").when(n.isNotNull(), "inferred-next").when(p.isNotNull(), "inferred-previous").when(anchor.isNotNull(), "session-fallback").otherwise("unknown")
    return got.withColumns({"resolved_ms": value, "resolved_source": label}).drop("__d", "__prev", "__next")


def session_times(m: DataFrame, meta: DataFrame) -> DataFrame:
    """session_id, created_ms, created_source, updated_ms, updated_source: metadata, else the extremes of the direct message times, else 1970. meta: session_id, meta_created, meta_updated, one row each."""
    direct = F.when(F.col("source").isin(*DIRECT), F.col("ms"))
    spans = m.groupBy("session_id").agg(F.min(direct).alias("low"), F.max(direct).alias("high"))
    got = spans.join(meta, "session_id", "left")
    label = lambda a, b: F.when(a.isNotNull(), "composer-metadata").when(b.isNotNull(), "direct-message").otherwise("epoch-unknown")
    c, u, low, high = (F.col(x) for x in ("meta_created", "meta_updated", "low", "high"))
    return got.select("session_id", F.coalesce(c, low, F.lit(0)).alias("created_ms"), label(c, low).alias("created_source"), F.coalesce(u, high, F.lit(0)).alias("updated_ms"), label(u, high).alias("updated_source"))


def timed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, msg_id, ms and source: composer messages are timed by their creation; times of store messages have no known source."""
    m = table(spark, sf_dir, "messages").where("session_id is not null")
    ms = stored_ms(F.col("msg_time"))
    return m.select("session_id", "msg_id", ms.alias("ms"), F.when(ms.isNotNull() & F.col("stack").isin("composer", "both"), DIRECT[0]).alias("source"))


def metadata_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "store_meta").where("session_id is not null")
    return meta.groupBy("session_id").agg(F.min(valid_ms(F.col("created_at_ms"))).alias("meta_created"), F.max(F.coalesce(valid_ms(F.col("updated_at_ms")), valid_ms(F.col("created_at_ms")))).alias("meta_updated"))


def q24_timestamp_gap_fill(spark, d):
    rows = timed_messages(spark, d).join(metadata_times(spark, d).select("session_id", "meta_created"), "session_id", "left")
    return fill_times(rows, "session_id", ["msg_id"], "ms", "source", F.col("meta_created")).select("msg_id", "resolved_ms", "resolved_source")


def q25_session_timestamps(spark, d):
    return session_times(timed_messages(spark, d), metadata_times(spark, d))


def q26_timestamp_cascade(spark, d):
    e = table(spark, d, "events")
    at = F.unix_millis(F.to_timestamp("ts"))
    ms, source = timing_cascade(F.when(F.col("event_type") == "click", at), F.when(F.col("event_type") == "view", at), F.when(F.col("value") > 50, F.lit(5).cast("bigint")), F.when(F.col("value") < 10, at + 1))
    return e.select("event_id", ms.alias("ms"), source.alias("source"))

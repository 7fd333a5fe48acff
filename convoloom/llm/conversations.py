"""Whole conversations out of message rows.

A stream of messages is kept in keyed state: one small row for each (window of arrival, session, message), the smallest
msg_id winning, with the arrival as event time under a watermark, so state leaves the store when the watermark passes
its window. Keying by message, not by session, splits sessions of any size over all state partitions. Each micro-batch
lays the state rows it changed over the table of open messages, which buffers late arrivals. A conversation is closed
and emitted by the micro-batch in which its last arrival falls a timeout behind the watermark, or by the end of the
input; a message that comes later still makes it anew at the end. Closed conversations are ordered by one range sort
over all of them, and pieces of a conversation that fall into several ranges are joined by their counts and end roles;
no task needs a whole one.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoloom.functions import times
from convoloom.operators.time_queries import zones
from convoloom.session import scratch, settle, ship, table

USER, ASSISTANT, UNREADABLE = 1, 2, 0
# Spellings of the two speakers, compared without case and blanks around them.
USERS = ("user", "human", "1", "usr", "person", "prompter")
ASSISTANTS = ("assistant", "ai", "model", "2", "bot", "asst", "gpt", "agent")
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
OPEN = "session_id string, ident binary, msg_id bigint, message_key binary, parent_key binary, role int, blank boolean, ms bigint, arrived_ms bigint, last_ms bigint"
STATE = ["msg_id", "message_key", "parent_key", "role", "blank", "ms", "arrived_ms"]


def speaker(role: Column) -> Column:
    """1 for the user, 2 for the assistant, 0 if the role can't be read."""
    r = F.lower(F.regexp_replace(role, r"[\s ​﻿]+", ""))
    return F.when(r.isin(*USERS), USER).when(r.isin(*ASSISTANTS), ASSISTANT).otherwise(UNREADABLE)


def key_of(key: Column) -> Column:
    """A message key as the 16 bytes of its digest: keys are long, and travel often. Null for null and empty ones."""
    return F.when(key != "", F.unhex(F.md5(key)))


def prepare(messages: DataFrame, zone: DataFrame) -> DataFrame:
    """The narrow rows that go into state; texts stay behind."""
    m = messages.select("workspace_id", "session_id", "message_key", "parent_key", "role", "content", "msg_id", "msg_time", "received_at").join(zone, "workspace_id", "left").where("session_id is not null")
    ident = F.coalesce(key_of(F.col("message_key")), key_of(F.concat(F.lit("\x01"), F.col("msg_id").cast("string"))))
    blank = ~F.coalesce("content", F.lit("")).rlike(r"[^\s ​﻿]")
    ms = times.utc_ms(F.col("msg_time"), F.col("tz"))
    # a message without time of arrival counts as arrived when it was sent, or else in 1970
    arrived = F.coalesce(F.to_timestamp("received_at"), F.timestamp_millis(ms), F.timestamp_millis(F.lit(0)))
    return m.select("session_id", ident.alias("ident"), arrived.alias("arrived"), "msg_id", key_of(F.col("message_key")).alias("message_key"), key_of(F.col("parent_key")).alias("parent_key"), speaker(F.col("role")).alias("role"), blank.alias("blank"), ms.alias("ms"))


def _stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over a parquet table, be it one file or a folder of them."""
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))


def latest(rows: DataFrame) -> DataFrame:
    """OPEN with each message once: the smallest msg_id, and the last arrival of any copy."""
    return rows.groupBy("session_id", "ident").agg(F.min(F.struct(*STATE)).alias("m"), F.max("last_ms").alias("last_ms")).select("session_id", "ident", "m.*", "last_ms")


class ConversationStream:
    """Closed conversations out of a stream of messages.

    delay is how far the watermark stays behind the latest arrival: what comes later than that after its window has
    left the state store is dropped by the stream. timeout is how far behind the watermark a conversation's last arrival
    must be for it to be closed. listed is what active_branches gives. The folder holds, for each micro-batch, the
    messages that are open (parts/batch=n/done=false), those of conversations it closed (done=true) and the
    conversations (out/batch=n); a batch that is run again writes the same again.
    """

    def __init__(self, zone: DataFrame, listed: DataFrame, delay: str = "7 days", timeout: str = "30 days", width: str = "1 day", folder: str | None = None):
        self.spark = zone.sparkSession
        self.zone, self.listed, self.delay, self.width = zone, listed, delay, width
        self.folder = folder or scratch(self.spark, "conversations")
        in_ms = lambda span: int(self.spark.range(1).select(F.expr(f"unix_millis(timestamp_millis(0) + interval {span})")).first()[0])
        self.behind = in_ms(delay) + in_ms(timeout)
        self.batches = self._there()
        if not self.batches:
            self._write(self.spark.createDataFrame([], OPEN).withColumn("done", F.lit(False)), -1)

    def _there(self) -> list[int]:
        """The micro-batches that were written, those of earlier runs over this folder included."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/parts")
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(p)) if fs.exists(p) else []

    def _write(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").partitionBy("done").parquet(f"{self.folder}/parts/batch={batch}")
        self.batches = sorted({*getattr(self, "batches", []), batch})

    def _rows(self, done: bool, batch: int | None = None) -> DataFrame:
        """Rows of one batch, or, with their batch, of all."""
        path = f"{self.folder}/parts" if batch is None else f"{self.folder}/parts/batch={batch}"
        schema = f"{OPEN}, {'batch int, ' if batch is None else ''}done boolean"
        return self.spark.read.schema(schema).parquet(path).where(F.col("done") == done).drop("done")

    def close(self, changed: DataFrame, batch: int) -> None:
        """One micro-batch: changed state rows over the open messages; what is due is closed and emitted. Without changes nothing falls due."""
        if changed.isEmpty():
            return
        fresh = changed.select("session_id", "ident", "m.*", F.col("m.arrived_ms").alias("last_ms"))
        before = max(b for b in self.batches if b < batch)
        rows = settle(latest(self._rows(False, before).unionByName(fresh)), "open")
        ends = rows.groupBy("session_id").agg(F.max("last_ms").alias("end"))
        due = (rows.agg(F.max("last_ms")).first()[0] or 0) - self.behind
        over = ends.where(F.col("end") <= due).select("session_id", F.lit(True).alias("over"))
        self._write(rows.join(over, "session_id", "left").withColumn("done", F.coalesce("over", F.lit(False))).drop("over"), batch)
        closed = self._rows(True, batch)
        if not closed.isEmpty():
            rebuild(closed, self.listed).write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch}")

    def start(self, stream: DataFrame, trigger: dict | None = None):
        """The running query over a stream of messages; trigger defaults to all that is available."""
        m = prepare(stream, self.zone).withWatermark("arrived", self.delay)
        row = F.struct("msg_id", "message_key", "parent_key", "role", "blank", "ms", F.unix_millis("arrived").alias("arrived_ms"))
        kept = m.groupBy(F.window("arrived", self.width), "session_id", "ident").agg(F.min(row).alias("m"))
        # state on disk, so that it may outgrow the executors' memory; the query takes the settings with it when it starts
        before = {k: self.spark.conf.get(k, None) for k in STATE_STORE}
        for k, v in STATE_STORE.items():
            self.spark.conf.set(k, v)
        try:
            return kept.writeStream.outputMode("update").foreachBatch(self.close).option("checkpointLocation", f"{self.folder}/state").trigger(**(trigger or {"availableNow": True})).start()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def emitted(self) -> DataFrame:
        """session_id, pos, msg_id of the conversations closed so far, with the batch that closed them."""
        schema, p = "session_id string, pos int, msg_id bigint, batch int", self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/out")
        there = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/out") if there else self.spark.createDataFrame([], schema)

    def finish(self) -> DataFrame:
        """session_id, pos, msg_id of all conversations, the end of the input closing those still open. One that got messages after it was closed is made anew, of all its messages."""
        rows, open_ = self._rows(True), self._rows(False, max(self.batches))
        closed = rows.select("session_id", "batch").distinct()
        again = closed.join(open_.select("session_id").distinct(), "session_id", "left_semi").select("session_id")
        again = settle(again.unionByName(closed.groupBy("session_id").count().where("count > 1").select("session_id")).distinct(), "again")
        rest = open_
        if not again.isEmpty():
            rest = settle(latest(open_.unionByName(rows.drop("batch").join(again, "session_id", "left_semi"))), "rest")
        return self.emitted().drop("batch").join(again, "session_id", "left_anti").unionByName(rebuild(rest, self.listed))


def place_untimed(rows: DataFrame) -> DataFrame:
    """rows with anchor_ms, anchor_id and path, by which they sort: a message without readable time follows its parent, of several the smaller msg_id first.

    Chains of such messages are shortened by doubling, so their length costs its logarithm in rounds. Without a parent
    in the session, or in a circle, a message counts as sent when it arrived.
    """
    none = F.array().cast("array<bigint>")
    placed = rows.where("ms is not null").withColumns({"anchor_ms": F.col("ms"), "anchor_id": F.col("msg_id"), "path": none})
    at = settle(rows.where("ms is null").withColumns({"pointer": F.col("parent_key"), "path": F.array("msg_id"), "root_ms": F.col("arrived_ms")}), "untimed")
    # how far each of them has come: the message above the first of its path, the path from there, and when its first arrived
    step = lambda df: df.where("message_key is not null").select("session_id", F.col("message_key").alias("pointer"), F.struct("pointer", "path", "root_ms").alias("h"))
    done, left = step(at.limit(0)), at.count()
    for _ in range(max(1, left).bit_length() + 1):
        if not left:
            return placed
        targets = rows.where("message_key is not null").join(at.select("session_id", F.col("pointer").alias("message_key")).distinct(), ["session_id", "message_key"], "left_semi").select("session_id", F.col("message_key").alias("pointer"), F.struct("ms", F.col("msg_id").alias("id")).alias("p"))
        got = at.join(targets, ["session_id", "pointer"], "left").join(done.unionByName(step(at)), ["session_id", "pointer"], "left")
        got = settle(got, "untimed")
        ready = got.where("p is null or p.ms is not null")
        lost = F.col("p").isNull()
        placed = placed.unionByName(ready.select(*rows.columns, F.when(lost, F.col("root_ms")).otherwise(F.col("p.ms")).alias("anchor_ms"), F.when(lost, F.get("path", F.lit(0))).otherwise(F.col("p.id")).alias("anchor_id"), F.when(lost, F.slice("path", 2, 1 << 30)).otherwise(F.col("path")).alias("path")))
        done = done.unionByName(step(ready))
        at = got.where("p is not null and p.ms is null").select(*rows.columns, F.col("h.pointer").alias("pointer"), F.concat("h.path", "path").alias("path"), F.col("h.root_ms").alias("root_ms"))
        left = at.count()
    return placed.unionByName(at.select(*rows.columns, F.col("arrived_ms").alias("anchor_ms"), F.col("msg_id").alias("anchor_id"), none.alias("path")))


def active_branches(sessions: DataFrame) -> DataFrame:
    """session_id and message_key (as key_of gives it) of each key that a copy of the session lists; null and empty elements and empty lists don't count."""
    keys = sessions.where("id is not null and size(active_branch_bubble_ids) > 0").select(F.col("id").alias("session_id"), F.explode("active_branch_bubble_ids").alias("message_key"))
    return keys.withColumn("message_key", key_of(F.col("message_key"))).where("message_key is not null").distinct()


def rebuild(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """session_id, pos, msg_id of the whole conversations among the given message rows.

    rows has the columns of STATE and session_id, each message once; listed is what active_branches gives. Blank
    messages and messages with a key outside their session's list are left out before the rules on roles apply; no
    rows, no conversations. Ties of time go by msg_id.
    """
    order = ["session_id", "anchor_ms", "anchor_id", "path"]
    listed = listed.withColumn("listed", F.lit(True))
    with_list = listed.groupBy("session_id").agg(F.first("listed").alias("has_list"))
    there = place_untimed(rows).join(listed, ["session_id", "message_key"], "left").join(with_list, "session_id", "left")
    kept = there.where("not blank and (message_key is null or has_list is null or listed)").select(*order, "msg_id", "role")
    # the plan's range sort: rows of one conversation are neighbours, in ranges of equal size
    sorted_ = settle(kept.repartitionByRange(*order).sortWithinPartitions(*order).select("session_id", "msg_id", "role", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("g")), "ordered")
    w = Window.partitionBy("session_id", "piece").orderBy("g")
    double = (F.col("role") == USER) & (F.lag("role").over(w) == USER)
    pieces = sorted_.select("session_id", "piece", "role", "g", double.alias("double")).groupBy("session_id", "piece").agg(F.min("g").alias("first_g"), F.count("*").alias("n"), F.min_by("role", "g").alias("first_role"), F.max_by("role", "g").alias("last_role"), F.max(F.coalesce("double", F.lit(False)) | (F.col("role") == UNREADABLE)).alias("bad"))
    s = Window.partitionBy("session_id").orderBy("piece")
    joint = F.lag("last_role").over(s)
    pieces = pieces.withColumns({"offset": F.coalesce(F.sum("n").over(s.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "bad": F.col("bad") | F.coalesce((F.col("first_role") == USER) & (joint == USER), F.lit(False)) | (joint.isNull() & (F.col("first_role") == ASSISTANT)) | (F.lead("piece").over(s).isNull() & (F.col("last_role") == USER))})
    pieces = pieces.withColumn("broken", F.max("bad").over(Window.partitionBy("session_id"))).where("not broken")
    missing = listed.join(rows.where("message_key is not null").select("session_id", "message_key"), ["session_id", "message_key"], "left_anti").select("session_id").distinct()
    pieces = pieces.join(missing, "session_id", "left_anti").select("session_id", "piece", "first_g", "offset")
    return sorted_.join(pieces, ["session_id", "piece"]).select("session_id", (F.col("offset") + F.col("g") - F.col("first_g") + 1).cast("int").alias("pos"), "msg_id")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of messages through the stream; what is still open is closed by the end of the input."""
    ship(spark)
    stream = ConversationStream(zones(spark, sf_dir), settle(active_branches(table(spark, sf_dir, "sessions")), "listed"))
    stream.start(_stream_of(spark, f"{sf_dir}/messages.parquet")).awaitTermination()
    return stream.finish()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir)


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kept messages with speaker and text."""
    texts = table(spark, sf_dir, "messages").select("msg_id", speaker(F.col("role")).alias("role"), "content")
    return conversations(spark, sf_dir).join(texts, "msg_id").select("session_id", "pos", "msg_id", F.when(F.col("role") == USER, "user").otherwise("assistant").alias("speaker"), "content")

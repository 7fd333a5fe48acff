"""The library: one archive, its sessions listed, opened, searched, exported, moved and backed up.

An Archive binds a Spark session, a folder of tables and read options. Everything that can be large is a DataFrame.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.config import Options, ReadLimits
from convoloom.functions import paths, text
from convoloom.operators import export, listing, search, snapshots
from convoloom.operators.merge import merged_messages
from convoloom.operators.messages import composer_ids, filter_types, message_type, messages, session_heads
from convoloom.operators.replicas import ambiguous_rows, instances, memberships, replica_groups
from convoloom.operators.timeline import timed_messages
from convoloom.operators.usage import message_usage, session_usage
from convoloom.operators.workspaces import resolve_scope, rollup
from convoloom.session import SNAPSHOTS, table
from convoloom.sources.archive import read_backups


TABLES = ("workspaces", "sessions", "messages", "store_meta", "transcript_lines")


class SessionNotFound(KeyError):
    """No session has this id or index."""


class SessionAmbiguous(ValueError):
    """The copies of a session differ, so it can be listed but not opened."""


@dataclass(frozen=True)
class Archive:
    spark: SparkSession
    path: str
    options: Options = field(default_factory=Options)
    limits: ReadLimits = field(default_factory=ReadLimits)

    def _scope(self) -> str | None:
        """The normalised path of the requested workspace; None for all, an error if it fits several."""
        if self.options.workspace is None:
            return None
        got = resolve_scope(table(self.spark, self.path, "workspaces").select("path"), "path", self.options.workspace).first()
        return got["path"] if got else ""

    def _in_scope(self, rows: DataFrame, key: str = "session_id") -> DataFrame:
        scope = self._scope()
        if scope is None:
            return rows
        ids = memberships(instances(self.spark, self.path)).where(F.col("workspace") == scope).select(F.col("id").alias(key)).distinct()
        return rows.join(ids, key, "left_semi")

    def catalog(self) -> DataFrame:
        """session_id, created_ms, index (from 1), state (ambiguous rows keep their index), of all sessions in scope."""
        cat = self._in_scope(listing.catalog(self.spark, self.path))
        rows = instances(self.spark, self.path)
        unsure = ambiguous_rows(rows, replica_groups(rows)).select(F.col("id").alias("session_id"), F.lit("ambiguous").alias("s"))
        got = listing.index_sessions(cat).join(unsure, "session_id", "left")
        return got.select("session_id", "created_ms", "index", F.coalesce("s", F.lit("resolved")).alias("state"))

    def list_session_summaries(self) -> DataFrame:
        """The page of options: catalog rows with title, preview and counts. Ambiguous rows count and are shown."""
        o = self.options
        page = self.catalog().orderBy("index").offset(o.offset)
        page = page.limit(o.limit) if o.limit else page
        return page.join(session_heads(messages(self.spark, self.path)), "session_id").orderBy("index")

    def list_sessions(self) -> DataFrame:
        """The same page without ambiguous rows; indexes keep their gaps."""
        return self.list_session_summaries().where("state = 'resolved'")

    def pagination(self) -> dict:
        total, o = self.catalog().count(), self.options
        end = total if o.limit is None else min(total, o.offset + o.limit)
        return {"total": total, "limit": o.limit, "offset": o.offset, "has_more": end < total}

    def resolve(self, identifier: str | int) -> str:
        """The id of a session given by id or by its 0-based index; digits alone are an index."""
        if isinstance(identifier, int) or re.fullmatch(r"\d+", identifier):
            row = self.catalog().where(F.col("index") == int(identifier) + 1).first()
        else:
            row = self._row(identifier)
        if row is None:
            raise SessionNotFound(str(identifier))
        if row["state"] == "ambiguous":
            raise SessionAmbiguous(row["session_id"])
        return row["session_id"]

    def _row(self, sid: str):
        """session_id and state of one session in scope, or None; only its own rows are looked at."""
        row = self._in_scope(listing.catalog(self.spark, self.path).where(F.col("session_id") == sid)).first()
        copies = instances(self.spark, self.path).where(F.col("id") == sid)
        unsure = row is not None and ambiguous_rows(copies, replica_groups(copies)).first() is not None
        return row and {"session_id": sid, "state": "ambiguous" if unsure else "resolved"}

    def get_session(self, identifier: str | int) -> DataFrame:
        """The messages of a session in order, both recordings merged, with type, identity, times and code blocks; options may limit the types.

        What both recordings hold is one row (source both) under the composer's msg_id, with the content, key and model
        of merged_messages; rows of neither recording stay, at the end.
        """
        sid = self.resolve(identifier)
        own = lambda df: df.where(F.col("session_id") == sid)
        m = own(messages(self.spark, self.path))
        merged = merged_messages(m, own(timed_messages(self.spark, self.path)))
        merged = merged.select(F.coalesce("composer_msg", "store_msg").alias("msg_id"), "pos", "source", "composer_msg", "store_msg", F.coalesce("content", F.lit("")).alias("merged"), "model")
        inside = merged.where("composer_msg <> store_msg").select(F.col("store_msg").alias("msg_id"))
        rows = export.export_messages(self.spark, self.path, sid).join(inside, "msg_id", "left_anti").join(merged, "msg_id", "left")
        got = rows.withColumn("content", F.coalesce("merged", "content")).drop("merged").join(composer_ids(m), "msg_id")
        got = got.withColumns({"type": message_type(F.col("role"), F.col("content"), F.lit(0)), "code_blocks": text.code_blocks(F.col("content"))})
        return filter_types(got, list(self.options.message_types)).orderBy(F.asc_nulls_last("pos"), "msg_id")

    def session_usage(self) -> DataFrame:
        return self._in_scope(session_usage(message_usage(messages(self.spark, self.path))))

    def search(self, query: str, characters: int | None = None) -> DataFrame:
        """Messages that hold the query, best sessions first, with the line of the first match and options.context lines around it; snippets reach as many characters to both sides, by default 80 for each line."""
        k, m = self.options.context, self._in_scope(messages(self.spark, self.path))
        found = search.matches(m, query)
        snips = search.snippets(found, query, k * 80 if characters is None else characters)
        ranked = search.rank_sessions(snips, listing.catalog(self.spark, self.path), self.options.limit)
        lines = found.select("msg_id", text.line_context(F.col("content"), F.get("positions", F.lit(0)), k).alias("line"))
        return snips.join(ranked.select("session_id", "match_count", "created_ms"), "session_id").join(lines, "msg_id").orderBy(F.desc("match_count"), F.desc("created_ms"), "session_id", "msg_id")

    def list_workspaces(self) -> DataFrame:
        """workspace, n_sessions of the sessions that have messages, most first."""
        live = messages(self.spark, self.path).select("session_id").distinct()
        s = table(self.spark, self.path, "sessions").select(paths.public_path(F.col("workspace")).alias("workspace"), F.col("id").alias("session_id")).join(live, "session_id", "left_semi")
        return rollup(s).orderBy(F.desc("n_sessions"), "workspace")

    def export_json(self, target: str, identifier: str | int | None = None) -> None:
        """Writes sessions as JSON lines below target, one folder each; ambiguous ones are left out."""
        self._export(export.json_messages(export.export_messages(self.spark, self.path)), target, identifier, "json")

    def export_markdown(self, target: str, identifier: str | int | None = None) -> None:
        self._export(export.markdown(export.export_heads(self.spark, self.path), export.export_messages(self.spark, self.path)), target, identifier, "block")

    def _export(self, blocks: DataFrame, target: str, identifier, column: str) -> None:
        """Filters go down to the tables, so one session is picked before its texts are made."""
        if identifier is not None:
            blocks = blocks.where(F.col("session_id") == self.resolve(identifier))
        else:
            blocks = blocks.join(self.catalog().where("state = 'resolved'").select("session_id"), "session_id", "left_semi")
        export.write_blocks(blocks, target, column)

    def migrate_workspace(self, source: str, target: str, dry_run: bool = True, copy: bool = False) -> DataFrame:
        """What would move from source to target, or, without dry_run, the new version of the table of sessions; eligibility is decided over all copies first."""
        rows = instances(self.spark, self.path)
        plan = snapshots.migrate_preview(rows, source, target)
        if dry_run:
            return plan
        return snapshots.migrate(table(self.spark, self.path, "sessions"), plan.select("id").distinct(), "workspace", source, target, copy)

    def migrate_sessions(self, ids: list[str], target: str, dry_run: bool = True, copy: bool = False, expected: str | None = None) -> tuple[DataFrame, str]:
        """(what would move, or without dry_run the new version of the table of sessions; the state it rests on). All ids move or none. With expected, the state an earlier call gave, sessions that changed since refuse the request."""
        rows = instances(self.spark, self.path)
        plan = snapshots.bind_sessions(rows, ids, target)
        state = snapshots.state_of(rows, plan)
        if expected is not None and expected != state:
            raise snapshots.MigrationRefused(f"the sessions changed: {expected} is now {state}")
        if dry_run:
            return plan, state
        return snapshots.migrate(table(self.spark, self.path, "sessions"), plan.select("id"), "workspace", None, target.rstrip("/"), copy), state

    def backup(self, target: str, overwrite: bool = False) -> list[dict]:
        """Every table as a snapshot with a manifest."""
        return [snapshots.publish(table(self.spark, self.path, t), f"{target}/{t}", overwrite) for t in TABLES]


def open_backup(spark: SparkSession, path: str, options: Options | None = None) -> Archive:
    """An archive read out of what Archive.backup wrote; a snapshot with missing or damaged files isn't opened."""
    for t in TABLES:
        status = validate_backup(spark, path, t).first()["status"]
        if status != "valid":
            raise snapshots.SnapshotInvalid(f"{path}/{t}: {status}")
    return Archive(spark, SNAPSHOTS + path, options or Options())


def validate_backup(spark: SparkSession, path: str, name: str) -> DataFrame:
    return snapshots.verdict(snapshots.validate(spark, f"{path}/{name}"))


def restore_backup(spark: SparkSession, path: str, name: str, target: str) -> DataFrame:
    return snapshots.restore(spark, f"{path}/{name}", target)


def list_backups(spark: SparkSession, path: str) -> DataFrame:
    """archive, modified, files, size, status of the ZIP backups below path, newest first, of equal times by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    when = files.select(F.regexp_replace("path", "^file:/+", "/").alias("archive"), F.col("modificationTime").alias("modified"))
    states = read_backups(spark, path).groupBy("archive").agg(F.count("*").alias("files"), F.sum("size").alias("size"), F.count_if(F.col("state") == "missing").alias("m"), F.count_if(F.col("state") == "corrupt").alias("c"), F.count_if(F.col("state") == "valid").alias("v"))
    return states.join(when, "archive", "left").select("archive", "modified", "files", "size", F.when((F.col("m") > 0) | (F.col("v") == 0), "invalid").when(F.col("c") > 0, "warnings").otherwise("valid").alias("status")).orderBy(F.desc_nulls_last("modified"), "archive")

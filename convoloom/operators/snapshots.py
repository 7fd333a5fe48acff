"""Snapshots of tables: manifests, validation, restore, incremental replacement, migration of paths."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.functions import paths
from convoloom.functions.ordered import running_sum
from convoloom.operators.messages import messages
from convoloom.operators.replicas import instances, replica_groups
from convoloom.session import table


class SnapshotInvalid(ValueError):
    """A snapshot whose manifest doesn't fit its files."""


def checksum(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def compare_manifest(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """path, state of manifest (path, size, checksum) against what is there: valid, corrupt (size or checksum differ), missing, extra."""
    a = actual.select("path", F.col("size").alias("s2"), F.col("checksum").alias("c2"), F.lit(True).alias("there"))
    got = manifest.withColumn("listed", F.lit(True)).join(a, "path", "full")
    state = F.when(F.col("listed").isNull(), "extra").when(F.col("there").isNull(), "missing").when(~F.col("size").eqNullSafe(F.col("s2")) | ~F.col("checksum").eqNullSafe(F.col("c2")), "corrupt").otherwise("valid")
    return got.select("path", state.alias("state"))


def verdict(states: DataFrame) -> DataFrame:
    """One row: counts by state, and status invalid (missing files, or none valid), warnings (corrupt ones) or valid."""
    n = {s: F.count_if(F.col("state") == s) for s in ("valid", "corrupt", "missing", "extra")}
    got = states.agg(*[v.alias(k) for k, v in n.items()])
    return got.withColumn("status", F.when((F.col("missing") > 0) | (F.col("valid") == 0), "invalid").when(F.col("corrupt") > 0, "warnings").otherwise("valid"))


def first_excess(df: DataFrame, order: list[str], value: str, limit: int) -> DataFrame:
    """At most one row: the first at which the running sum of value is strictly above the limit."""
    return running_sum(df, order, value).where(F.col("total") > limit).orderBy(*order).limit(1)


def distinct_diagnostics(rows: DataFrame, key: list[str]) -> DataFrame:
    """Each diagnostic once, with its number."""
    return rows.groupBy(*key).agg(F.count("*").alias("n"))


def replacements(old: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """key, action of whole-session replacement: new, changed or gone; unchanged ones aren't there, so a second run writes nothing."""
    o, n = old.select(key, F.col(fingerprint).alias("fo")), new.select(key, F.col(fingerprint).alias("fn"))
    got = o.join(n, key, "full").where(~F.col("fo").eqNullSafe(F.col("fn")))
    return got.select(key, F.when(F.col("fo").isNull(), "new").when(F.col("fn").isNull(), "gone").otherwise("changed").alias("action"))


def session_fingerprints(m: DataFrame) -> DataFrame:
    """session_id, fingerprint of all its messages: sums of hashes in two moduli and the count, combined map-side, so order doesn't matter and no session is collected."""
    h = F.xxhash64("msg_id", "role", "content")
    parts = [F.sum(F.pmod(h, F.lit(2147483647)).cast("bigint")), F.sum(F.pmod(h, F.lit(2147483629)).cast("bigint")), F.count("*")]
    return m.groupBy("session_id").agg(F.concat_ws("-", *[p.cast("string") for p in parts]).alias("fingerprint"))


def publish(df: DataFrame, path: str, overwrite: bool = False) -> dict:
    """Writes a snapshot: data, then its manifest as the last file, so that a snapshot without manifest is none. Gives the manifest's facts."""
    spark = df.sparkSession
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/data")
    files = spark.read.format("binaryFile").load(f"{path}/data").where("length > 0")
    manifest = files.select(F.regexp_extract("path", r"/data/(.*)$", 1).alias("path"), F.col("length").alias("size"), checksum(F.col("content")).alias("checksum"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    total = spark.read.schema("path string, size bigint, checksum string").json(f"{path}/manifest").agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    return {"path": path, "total_size": total["s"] or 0, "files": total["n"]}


def validate(spark: SparkSession, path: str) -> DataFrame:
    manifest = spark.read.schema("path string, size bigint, checksum string").json(f"{path}/manifest")
    files = spark.read.format("binaryFile").load(f"{path}/data")
    return compare_manifest(manifest, files.select(F.regexp_extract("path", r"/data/(.*)$", 1).alias("path"), F.col("length").alias("size"), checksum(F.col("content")).alias("checksum")))


def restore(spark: SparkSession, path: str, target: str, partial: bool = False) -> DataFrame:
    """Reads the valid files of a snapshot, and no others, and writes them to a target that doesn't exist yet.

    Files that are corrupt or missing are refused (SnapshotInvalid names up to ten), unless partial says to do without
    them; without any valid file nothing is restored. Files that the manifest doesn't list are never read. A target
    that exists fails before anything is written.
    """
    states = validate(spark, path)
    found = verdict(states).first()
    bad = [(r["path"], r["state"]) for r in states.where("state in ('corrupt', 'missing')").orderBy("path").limit(10).collect()]
    if bad and not partial or not found["valid"]:
        raise SnapshotInvalid(json.dumps({"path": path, "status": found["status"], "files": bad}))
    good = [f"{path}/data/{r['path']}" for r in states.where("state = 'valid'").select("path").toLocalIterator()]
    df = spark.read.option("basePath", f"{path}/data").parquet(*good)
    df.write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target)


# migration ---------------------------------------------------------------------------------------------------------

def eligibility(rows: DataFrame) -> DataFrame:
    """id, eligibility, n_copies of every session; the first that holds: store-only, merged, ambiguous, shared-membership, multiple-occurrences, unbound, eligible."""
    groups = replica_groups(rows).where("role = 'composer'").groupBy("id").agg(F.max((F.col("state") == "divergent").cast("int")).alias("divergent"), F.sum("n_copies").alias("n_copies"))
    facts = rows.groupBy("id").agg(F.max((F.col("role") == "composer").cast("int")).alias("c"), F.max((F.col("role") == "store").cast("int")).alias("s"), F.count_distinct("workspace").alias("n_workspaces"))
    got = facts.join(groups, "id", "left")
    why = F.when(F.col("c") == 0, "store-only").when(F.col("s") == 1, F.when(F.col("divergent") == 1, "ambiguous").otherwise("merged")).when(F.col("n_workspaces") > 1, "shared-membership")
    why = why.when(F.col("divergent") == 1, "ambiguous").when(F.col("n_copies") > 1, "multiple-occurrences").when(F.col("n_workspaces") == 0, "unbound").otherwise("eligible")
    return got.select("id", why.alias("eligibility"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"))


def migrate_preview(rows: DataFrame, source: str, target: str) -> DataFrame:
    """id, workspace, moved of the eligible sessions below the source path. Equal and nested paths are refused."""
    if source.rstrip("/") == target.rstrip("/") or target.startswith(source.rstrip("/") + "/"):
        raise ValueError("target is the source or lies inside it")
    ok = eligibility(rows).where("eligibility = 'eligible'").select("id")
    moved = paths.rebase(F.col("workspace"), F.lit(source), F.lit(target))
    return rows.join(ok, "id").where("workspace is not null").select("id", "workspace", moved.alias("moved")).where("moved is not null").distinct()


class MigrationRefused(ValueError):
    """Sessions that can't be moved, or that changed since they were looked at."""


def bind_sessions(rows: DataFrame, ids: list[str], target: str) -> DataFrame:
    """id, workspace, moved of the given sessions, all of them or none: eligibility is decided over the whole catalog, and unknown or ineligible ones, and those that are below the target already, refuse the whole request."""
    wanted = rows.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")
    got = wanted.join(eligibility(rows), "id", "left").join(rows.groupBy("id").agg(F.min("workspace").alias("workspace")), "id", "left")
    there = F.col("workspace").startswith(target.rstrip("/") + "/") | (F.col("workspace") == target.rstrip("/"))
    why = F.when(F.col("eligibility").isNull(), "unknown").when(F.col("eligibility") != "eligible", F.col("eligibility")).when(there, "already there")
    bad = got.withColumn("why", why).where("why is not null").select("id", "why").orderBy("id").limit(10).collect()
    if bad:
        raise MigrationRefused(json.dumps([r.asDict() for r in bad]))
    return got.select("id", "workspace", F.lit(target.rstrip("/")).alias("moved"))


def state_of(rows: DataFrame, ids: DataFrame) -> str:
    """A fingerprint of all copies of the given sessions, by which a later write can tell that nothing changed meanwhile."""
    h = F.xxhash64("id", "session_row_id", "workspace", "fingerprint")
    r = rows.join(ids.select("id"), "id", "left_semi").agg(F.sum(F.pmod(h, F.lit(2147483647))).alias("a"), F.sum(F.pmod(h, F.lit(2147483629))).alias("b"), F.count("*").alias("n")).first()
    return f"{r['a'] or 0}-{r['b'] or 0}-{r['n']}"


def migrate(df: DataFrame, ids: DataFrame, column: str, source: str | None, target: str, copy: bool = False) -> DataFrame:
    """A new version of a table of sessions: rows of the given ids move from below source to below target, or, without source, to target itself, or are copied there under ids of their own (a hash of the old id and the target, so a repeat gives the same)."""
    mark = df.join(ids.select("id").withColumn("__m", F.lit(True)), "id", "left")
    moved = F.lit(target) if source is None else F.coalesce(paths.rebase(F.col(column), F.lit(source), F.lit(target)), F.col(column))
    if not copy:
        return mark.withColumn(column, F.when(F.col("__m"), moved).otherwise(F.col(column))).drop("__m").select(*df.columns)
    fresh = paths.dashed_uuid(F.md5(F.concat_ws("\x01", F.col("id"), F.lit(target))))
    copies = mark.where("__m").withColumn(column, moved).withColumn("id", fresh).select(*df.columns)
    return df.unionByName(copies)


# queries -----------------------------------------------------------------------------------------------------------

def document_manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    listed = d.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), checksum(F.coalesce("text", F.lit(""))).alias("checksum"))
    there = d.where("text is not null").select(F.col("doc_id").alias("path"), F.length("text").cast("bigint").alias("size"), checksum(F.col("text")).alias("checksum"))
    return listed, there


def q40_manifest_validate(spark, d):
    return compare_manifest(*document_manifest(spark, d))


def q52_manifest_verdict(spark, d):
    return verdict(compare_manifest(*document_manifest(spark, d)))


def q41_budget_excess(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    return first_excess(docs, ["doc_id"], "n", 200_000).select("doc_id", "total")


def q42_diagnostics(spark, d):
    from convoloom.operators.nested import whole_json

    lines = table(spark, d, "transcript_lines").select("session_id", F.when(F.trim("raw") == "", "blank-line").when(whole_json(F.col("raw")).isNull(), "damaged-line").alias("code")).where("code is not null")
    return distinct_diagnostics(lines, ["code", "session_id"])


def q48_incremental_replace(spark, d):
    m = messages(spark, d).withColumn("received_at", F.to_timestamp("received_at"))
    # what had arrived by the start of 2024, against everything
    old = session_fingerprints(m.where(F.unix_millis("received_at") < 1704067200000))
    return replacements(old, session_fingerprints(m), "session_id", "fingerprint")


def q53_migrate_eligibility(spark, d):
    return eligibility(instances(spark, d))


def q61_migrate_preview(spark, d):
    return migrate_preview(instances(spark, d), "/srv", "/data/moved")

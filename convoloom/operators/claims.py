"""Who a session belongs to, what of it was left out, and how complete it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoloom.functions import paths
from convoloom.operators.messages import messages
from convoloom.operators.nested import transcript_parts
from convoloom.operators.replicas import REASONS, declared, instances
from convoloom.session import table

NOWHERE = "(global)"


def first_claims(sources: list[DataFrame]) -> DataFrame:
    """id, workspace, source of each id once: the first source in the list that names it, there the smallest row. sources: id, workspace, row."""
    every = reduce(DataFrame.unionByName, [s.select("id", F.coalesce("workspace", F.lit(NOWHERE)).alias("workspace"), F.col("row").cast("bigint").alias("row"), F.lit(n).alias("source")) for n, s in enumerate(sources)])
    got = every.where("id is not null").groupBy("id").agg(F.min(F.struct("source", "row", "workspace")).alias("c"))
    return got.select("id", F.col("c.workspace").alias("workspace"), F.col("c.source").alias("source"))


def scope_states(rows: DataFrame, scope: str) -> DataFrame:
    """id, state, n_omitted, reasons of the sessions with a copy in a workspace: partial where copies elsewhere were left out."""
    got = rows.groupBy("id").agg(F.count_if(F.col("workspace") == scope).alias("inside"), F.count_if(F.col("workspace") != scope).alias("n_omitted")).where("inside > 0")
    return got.select("id", F.when(F.col("n_omitted") > 0, "partial").otherwise("complete").alias("state"), "n_omitted", F.when(F.col("n_omitted") > 0, "workspace-scope-omitted").otherwise("").alias("reasons"))


def contributions(expected: DataFrame, loaded: DataFrame) -> DataFrame:
    """id, state, roles, reasons of sessions by the roles expected (id, role, complete) and the ones whose messages could be read (id, role)."""
    got = expected.join(loaded.select("id", "role", F.lit(True).alias("there")), ["id", "role"], "left")
    why = F.when(F.col("there").isNull(), "source-unavailable").when(~F.col("complete"), "source-partial")
    sums = got.groupBy("id").agg(F.collect_set(F.when(F.col("there"), F.col("role"))).alias("r"), F.collect_set(why).alias("w"))
    return sums.select("id", F.when(F.size("w") == 0, "complete").otherwise("partial").alias("state"), F.array_join(F.array_sort("r"), ",").alias("roles"), F.array_join(declared(REASONS, F.col("w")), ",").alias("reasons"))


def block_evidence(parts: DataFrame) -> DataFrame:
    """line_id, part_path, disposition of top parts: projected-text, projected-tool or unsupported."""
    get = lambda p: F.try_variant_get("part", p, "string")
    what = F.when((get("$.type") == "text") & get("$.text").isNotNull(), "projected-text").when((get("$.type") == "tool_use") & get("$.name").isNotNull(), "projected-tool").otherwise("unsupported")
    return parts.where("level = 0").select("line_id", "part_path", what.alias("disposition"))


def q76_first_claims(spark, d):
    s = table(spark, d, "sessions")
    mine = s.where("source <> 'global' and workspace is not null").select("id", paths.public_path(F.col("workspace")).alias("workspace"), F.col("session_row_id").alias("row"))
    stored = table(spark, d, "store_meta").select(F.col("session_id").alias("id"), paths.public_path(F.col("cwd")).alias("workspace"), F.col("meta_id").alias("row"))
    rest = messages(spark, d).select(F.col("session_id").alias("id"), F.lit(None).cast("string").alias("workspace"), F.col("msg_id").alias("row"))
    return first_claims([mine, stored, rest])


def q77_scope_states(spark, d):
    rows = instances(spark, d).where("workspace is not null")
    scope = table(spark, d, "workspaces").agg(F.min("path").alias("p")).first()["p"]
    return scope_states(rows, scope)


def q78_contributions(spark, d):
    rows = instances(spark, d).groupBy("id", "role").agg(F.max((F.col("tier") == "complete").cast("int")).cast("boolean").alias("complete"))
    m = messages(spark, d).where("stack is not null").select(F.col("session_id").alias("id"), F.explode(F.when(F.col("stack") == "both", F.array(F.lit("composer"), F.lit("store"))).otherwise(F.array("stack"))).alias("role")).distinct()
    return contributions(rows, m)


def q79_block_evidence(spark, d):
    return block_evidence(transcript_parts(spark, d)).groupBy("line_id").agg(F.count("*").alias("n_parts"), F.count_if(F.col("disposition") == "unsupported").alias("n_unsupported"), F.count_if(F.col("disposition") == "projected-tool").alias("n_tools"))

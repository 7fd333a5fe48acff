"""Physical copies of sessions: groups, equivalence, arbitration of tiers, memberships, canonical paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.functions import paths
from convoloom.session import table

# Fixed values, in their declared order.
ROLES = ("composer", "store")
REPRESENTATIONS = ("composer-global", "composer-workspace", "store-db", "store-transcript", "store-metadata")
PATH_KINDS = ("composer-configuration", "composer-folder", "store-cwd")
REASONS = ("source-unavailable", "source-partial", "source-ambiguous", "workspace-scope-omitted", "source-limit-exceeded", "store-conversation-unavailable", "unsupported-content")


def declared(values: tuple[str, ...], found: Column) -> Column:
    """The values found, without repeats, in declared order."""
    return F.filter(F.array(*[F.lit(v) for v in values]), lambda x: F.array_contains(found, x))


def rank_in(values: tuple[str, ...], c: Column) -> Column:
    """Place of a value in declared order; unknown and null last."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(values) for x in (v, i)]), c), F.lit(len(values)))


def representation_of(source: Column) -> Column:
    """How a copy is stored, by its source label."""
    return F.when(source == "global", "composer-global").when(source.isin("workspace", "workspace-fallback"), "composer-workspace").when(source.isin("store-complete", "store-partial", "store"), "store-db").when(source == "transcript", "store-transcript").when(source == "merged", "composer-global").otherwise("store-metadata")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each copy: id, session_row_id, role, representation, tier, workspace (normalised), fingerprint of its payload."""
    s = table(spark, sf_dir, "sessions").where("id is not null")
    rep = representation_of(F.coalesce("source", F.lit("")))
    payload = F.to_json(F.struct("title", "created_at", "message_count"), {"ignoreNullFields": "false"})
    tier = F.when(F.col("transcript_state") == "parsed", "complete").otherwise("partial")
    return s.select("id", "session_row_id", F.substring_index(rep, "-", 1).alias("role"), rep.alias("representation"), tier.alias("tier"), paths.public_path(F.col("workspace")).alias("workspace"), F.sha2(payload, 256).alias("fingerprint"))


def replica_groups(rows: DataFrame) -> DataFrame:
    """Groups of copies with equal id, role, representation and tier: state single, equivalent or divergent, the row first in source order, its fingerprints counted. Counts distinct fingerprints through a first aggregate on them, so a group of any size is spread."""
    key = ["id", "role", "representation", "tier"]
    by_print = rows.groupBy(*key, "fingerprint").agg(F.count("*").alias("n"), F.min("session_row_id").alias("first"))
    got = by_print.groupBy(*key).agg(F.sum("n").alias("n_copies"), F.count("*").alias("n_fingerprints"), F.min("first").alias("first"))
    state = F.when(F.col("n_copies") == 1, "single").when(F.col("n_fingerprints") == 1, "equivalent").otherwise("divergent")
    return got.select(*key, "n_copies", "n_fingerprints", state.alias("state"), F.when(state != "divergent", F.col("first")).alias("selected"))


def arbitrate(groups: DataFrame, role: str) -> DataFrame:
    """Per id the best group of a role: representations in declared order, complete before partial. state selected, or ambiguous where the best group is divergent; a composer copy of a workspace is partial at best; the other groups are superseded."""
    best = F.min(F.struct(rank_in(REPRESENTATIONS, F.col("representation")).alias("r"), F.when(F.col("tier") == "complete", 0).otherwise(1).alias("t"), "representation", "tier", "state", "selected", "n_copies"))
    got = groups.where(F.col("role") == role).groupBy("id").agg(best.alias("b"), F.count("*").alias("n_groups"), F.sum("n_copies").alias("n_all"))
    b = F.col("b")
    state = F.when(b["state"] == "divergent", "ambiguous").otherwise("selected")
    resolution = F.when(b["representation"] == "composer-workspace", "partial").otherwise(b["tier"])
    return got.select("id", b["representation"].alias("representation"), b["tier"].alias("tier"), state.alias("state"), F.when(state == "selected", resolution).alias("resolution"), b["selected"].alias("selected"), (F.col("n_all") - b["n_copies"]).alias("n_superseded"))


def memberships(rows: DataFrame) -> DataFrame:
    """id, workspace, roles (declared order), n_copies."""
    got = rows.where("workspace is not null").groupBy("id", "workspace").agg(F.collect_set("role").alias("r"), F.count("*").alias("n_copies"))
    return got.select("id", "workspace", F.array_join(declared(ROLES, F.col("r")), ",").alias("roles"), "n_copies")


def canonical_paths(rows: DataFrame) -> DataFrame:
    """id, workspace: of composer copies if there are any, configurations before folders before store directories, then by code points."""
    kind = F.when(F.col("role") == "store", 2).when(F.lower("workspace").endswith(".code-workspace"), 0).otherwise(1)
    got = rows.groupBy("id").agg(F.max(F.when(F.col("role") == "composer", 1).otherwise(0)).alias("has"), F.min(F.when(F.col("workspace").isNotNull() & (F.col("role") == "composer"), F.struct(kind.alias("k"), "workspace"))).alias("c"), F.min(F.when(F.col("workspace").isNotNull(), F.struct(kind.alias("k"), "workspace"))).alias("a"))
    return got.select("id", F.when(F.col("has") == 1, F.col("c.workspace")).otherwise(F.col("a.workspace")).alias("workspace")).where("workspace is not null")


def occurrence_ref(context: str, *fields: Column) -> Column:
    """An opaque reference to a copy that tells nothing of it."""
    return F.concat(F.lit("occurrence:v1:"), F.sha2(F.to_json(F.struct(F.lit(context).alias("c"), *[f.alias(f"f{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false"}), 256))


def ambiguous_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """id, roles, n_copies, n_refs of the ids that have a divergent group: they are listed, but can't be opened."""
    divergent = groups.where("state = 'divergent'").select("id", "role", "representation", "tier")
    copies = rows.join(divergent, ["id", "role", "representation", "tier"], "left_semi")
    refs = copies.select("id", "role", occurrence_ref("list", F.col("id"), F.col("session_row_id"), F.col("fingerprint")).alias("ref"))
    got = refs.groupBy("id", "ref").agg(F.collect_set("role").alias("r")).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("r"))).alias("r"), F.count("*").alias("n_refs"))
    return got.select("id", F.array_join(declared(ROLES, F.col("r")), ",").alias("roles"), "n_refs")


def latest_metadata(rows: DataFrame, key: str, updated: Column, created: Column, path: Column, row: str) -> DataFrame:
    """key and row of the metadata file that counts: updated last, then created last, then the smallest path, then the smallest row. Null times are before all others."""
    best = F.min(F.struct(F.coalesce(-updated, F.lit(2**62)).alias("u"), F.coalesce(-created, F.lit(2**62)).alias("c"), F.coalesce(path, F.lit("")).alias("p"), F.col(row).alias("row")))
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("b")).select(key, F.col("b.row").alias(row))


def valid_ms(text: Column) -> Column:
    """Milliseconds of a number after September 2001, else null."""
    n = F.when(text.rlike(r"^\d{1,18}$"), text.try_cast("bigint"))
    return F.when(n > 1_000_000_000_000, n)


def q20_replica_state(spark, d):
    return replica_groups(instances(spark, d)).select("id", "representation", "tier", "state", "n_copies", "n_fingerprints")


def q21_replica_pick(spark, d):
    return replica_groups(instances(spark, d)).where("selected is not null").select("id", "representation", "tier", "selected")


def q22_latest_metadata(spark, d):
    updated = F.coalesce(valid_ms(F.col("updated_at_ms")), valid_ms(F.col("created_at_ms")))
    return latest_metadata(table(spark, d, "store_meta"), "session_id", updated, valid_ms(F.col("created_at_ms")), F.col("cwd"), "meta_id")


def q23_tier_arbitration(spark, d):
    return arbitrate(replica_groups(instances(spark, d)), "composer").unionByName(arbitrate(replica_groups(instances(spark, d)), "store"))


def q36_ordered_role_union(spark, d):
    got = table(spark, d, "sessions").where("id is not null").select("id", F.explode_outer("sources").alias("role")).groupBy("id").agg(F.collect_set("role").alias("r"))
    return got.select("id", F.array_join(declared(ROLES, F.col("r")), ",").alias("roles"))


def q54_memberships(spark, d):
    return memberships(instances(spark, d))


def q55_canonical_workspace(spark, d):
    return canonical_paths(instances(spark, d))


def q56_ambiguous_sessions(spark, d):
    rows = instances(spark, d)
    return ambiguous_rows(rows, replica_groups(rows))

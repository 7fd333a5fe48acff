"""Workspaces: roll-up, scopes, paths, sessions that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoloom.functions import paths
from convoloom.operators.messages import messages
from convoloom.session import table


class ScopeAmbiguous(ValueError):
    """A requested workspace fits several known ones."""


def resolve_scope(known: DataFrame, column: str, request: str) -> DataFrame:
    """At most one row (path, kind) for a requested workspace: the equal path, else the only one that ends with its components. Several such paths are an error; none gives no row. Looks at distinct paths, which the caller knows to be few."""
    want = paths.normalize_path(F.lit(request))
    got = known.select(paths.normalize_path(F.col(column)).alias("path")).where("path is not null").distinct()
    fits = got.where((F.col("path") == want) | paths.ends_with_components(F.col("path"), want)).select("path", (F.col("path") == want).alias("exact"))
    rows = fits.orderBy(F.desc("exact"), "path").limit(2).collect()
    if len(rows) == 2 and not rows[0]["exact"]:
        raise ScopeAmbiguous(f"{request} fits {rows[0]['path']} and {rows[1]['path']}")
    return fits.orderBy(F.desc("exact"), "path").limit(1).select("path", F.when(F.col("exact"), "exact").otherwise("unique-suffix").alias("kind"))


def suffix_matches(known: DataFrame, requests: DataFrame) -> DataFrame:
    """request, n_exact, n_suffix, kind for many requests at once. A path is exploded into all its suffixes, so matching is an equality join, not a comparison of all pairs."""
    p = known.select(paths.normalize_path(F.col("path")).alias("path")).where("path is not null").distinct()
    parts = paths.components(F.col("path"))
    suffixes = p.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, i, 10_000), "/"))).alias("suffix"))
    r = requests.select("request", paths.normalize_path(F.col("request")).alias("want")).withColumn("suffix", F.array_join(paths.components(F.col("want")), "/"))
    hit = r.join(suffixes, "suffix", "left").groupBy("request").agg(F.count_if(F.col("path") == F.col("want")).alias("n_exact"), F.count("path").alias("n_suffix"))
    kind = F.when(F.col("n_exact") > 0, "exact").when(F.col("n_suffix") == 1, "unique-suffix").when(F.col("n_suffix") > 1, "ambiguous").otherwise("not-found")
    return hit.select("request", "n_exact", "n_suffix", kind.alias("kind"))


def rollup(members: DataFrame) -> DataFrame:
    """workspace, n_sessions (distinct ids, exact), most first; members: workspace, session_id. Repeats go in a first aggregate, so a workspace of any size is spread."""
    return members.where("workspace is not null and session_id is not null").groupBy("workspace", "session_id").agg(F.lit(1).alias("one")).groupBy("workspace").agg(F.count("*").alias("n_sessions"))


def q30_workspace_rollup(spark, d):
    nonempty = messages(spark, d).select("session_id").distinct()
    s = table(spark, d, "sessions").select(paths.public_path(F.col("workspace")).alias("workspace"), F.col("id").alias("session_id")).join(nonempty, "session_id", "left_semi")
    return rollup(s).orderBy(F.desc("n_sessions"), "workspace")


def q31_nonempty_sessions(spark, d):
    ids = table(spark, d, "sessions").select(F.col("id").alias("session_id")).where("session_id is not null").distinct()
    return ids.join(messages(spark, d), "session_id", "left_semi")


def q32_orphan_messages(spark, d):
    ids = table(spark, d, "sessions").select(F.col("id").alias("session_id")).distinct()
    return messages(spark, d).join(ids, "session_id", "left_anti").select("msg_id", "session_id")


def q37_workspace_paths(spark, d):
    w = table(spark, d, "workspaces")
    forms = F.array(F.col("path"), F.concat(F.col("path"), F.lit("/./x/..")), F.concat(F.col("path"), F.lit("//")))
    got = w.select("workspace_id", F.posexplode(forms).alias("form", "raw"))
    return got.select("workspace_id", "form", paths.normalize_path(F.col("raw")).alias("path"), paths.project_slug(F.col("raw")).alias("slug"), F.md5("raw").alias("hash"))


def q38_scope_suffix_match(spark, d):
    w = table(spark, d, "workspaces")
    last = F.element_at(F.split("path", "/"), -1)
    requests = w.select(last.alias("request")).unionByName(w.select(F.col("path").alias("request"))).unionByName(w.select(F.concat(F.lit("absent-"), last).alias("request"))).distinct()
    return suffix_matches(w.select("path"), requests)


def q39_path_rebase(spark, d):
    w = table(spark, d, "workspaces")
    base = F.regexp_replace("path", "/[^/]*$", "")
    return w.select("workspace_id", paths.rebase(F.col("path"), base, F.lit("/new/home")).alias("moved"), paths.rebase(F.col("path"), F.concat(F.col("path"), F.lit("x")), F.lit("/new")).alias("outside"), paths.is_nested(F.col("path"), base).alias("nested"))


def slug_attribution(lines: DataFrame, known: DataFrame) -> DataFrame:
    """dir, path: directory names that the slug of exactly one known path equals."""
    slugs = known.select(F.col("path"), paths.project_slug(F.col("path")).alias("dir")).distinct().groupBy("dir").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1")
    return lines.join(slugs.select("dir", "path"), "dir")


def q63_slug_attribution(spark, d):
    dirs = table(spark, d, "store_meta").where("cwd is not null").select(paths.project_slug(F.col("cwd")).alias("dir")).distinct()
    return slug_attribution(dirs, table(spark, d, "workspaces").select("path"))

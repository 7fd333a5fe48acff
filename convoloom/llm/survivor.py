"""One surviving record for each group of duplicates, chosen by bundles of fields that belong together.

Every bundle takes all its values from one row. Rows are ranked; among a group's rows that have a value for a bundle
the best-ranked one gives it. Functional dependencies couple bundles: a choice must pair a determinant with the
dependent value that the whole table pairs it with most often. Groups whose unconstrained choice breaks a dependency
go through branch and bound over their distinct bundle values, bounded by the best trust still reachable.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoloom.functions import times
from convoloom.operators.time_queries import zones
from convoloom.session import settle, table


@dataclass(frozen=True)
class Bundle:
    """name, the fields that go together, and the condition that a row has a value for them."""

    name: str
    fields: tuple[str, ...]
    valid: Column = field(compare=False)


def branch_and_bound(candidates: list[list[tuple[float, tuple]]], allowed) -> list[int]:
    """Index of the candidate of each bundle (-1: none fits) with the greatest sum of trust.

    candidates: per bundle (trust, values), best first. allowed(choice so far, bundle, values) says whether values may
    join the choice {bundle: values}. Leaving a bundle out costs all its trust. Of equal sums the first found, in
    order of rank, stays.
    """
    best: list = [-1.0, [-1] * len(candidates)]
    reach = [0.0] * (len(candidates) + 1)
    for i in range(len(candidates) - 1, -1, -1):
        reach[i] = reach[i + 1] + max((t for t, _ in candidates[i]), default=0.0)

    stack = [(0, 0.0, (), {})]
    while stack:
        i, trust, picks, chosen = stack.pop()
        if trust + reach[i] <= best[0]:
            continue
        if i == len(candidates):
            best = [trust, list(picks)]
            continue
        branches = [(i + 1, trust, (*picks, -1), chosen)]
        for k in range(len(candidates[i]) - 1, -1, -1):
            t, values = candidates[i][k]
            if allowed(chosen, i, values):
                branches.append((i + 1, trust + t, (*picks, k), chosen | {i: values}))
        stack += branches
    return best[1]


def survivors(df: DataFrame, key: str, row_id: str, rank: list[Column], bundles: list[Bundle], at_least: int = 2) -> DataFrame:
    """key, bundle, row_id and values (fields as strings) of the row each bundle of a group survives from.

    rank: columns by which rows are compared, smallest first, nulls not allowed; row_id breaks ties, smaller first.
    Groups of fewer than at_least rows give nothing, bundles without a valid row give no row, null keys are no group.
    All choices are minima with map-side combining: a group of any size never meets in one task.
    """
    place = F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], F.col(row_id).alias("row_id"))
    got = df.where(F.col(key).isNotNull()).withColumn("__p", place)
    best = [F.min(F.when(b.valid, F.struct(F.col("__p").alias("p"), F.array(*[F.col(f).cast("string") for f in b.fields]).alias("v")))).alias(f"b{i}") for i, b in enumerate(bundles)]
    picked = got.groupBy(key).agg(F.count("*").alias("__n"), *best).where(F.col("__n") >= at_least)
    rows = F.array(*[F.struct(F.lit(b.name).alias("bundle"), F.col(f"b{i}.p.row_id").alias("row_id"), F.col(f"b{i}.v").alias("values")) for i, b in enumerate(bundles)])
    return picked.select(key, F.inline(rows)).where("row_id is not null")


def dependency(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """det, dep: for each determinant value the dependent value most rows pair it with, of equals the smaller. Counted over all rows."""
    pairs = df.where(f"{determinant} is not null and {dependent} is not null").groupBy(F.col(determinant).cast("string").alias("det"), F.col(dependent).cast("string").alias("dep")).count()
    return pairs.groupBy("det").agg(F.min(F.struct((-F.col("count")).alias("n"), "dep")).alias("m")).select("det", F.col("m.dep").alias("dep"))


def consistent_survivors(df: DataFrame, key: str, row_id: str, rank: list[Column], bundles: list[Bundle], dependencies: list[tuple[str, str]], at_least: int = 2, trust: Column | None = None, weights: dict[str, int] | None = None) -> DataFrame:
    """As survivors, but every dependency (determinant, dependent) between single-field bundles holds in the result.

    Groups whose best choice breaks none keep it. The others choose among their distinct values, each with its best row,
    by branch and bound: the sum of trust is greatest over all consistent choices, a bundle without a fitting value is
    left out. trust is a column above 0; without it trust follows the rank, and weights say which fields go first: no
    gain in a field of smaller weight makes up for a lower rank in one of greater. Of determinant values that ask for
    one and the same dependent value only the best is a candidate, so what reaches Python for a group is bounded by the
    distinct dependent values, however many rows it has.
    """
    first = settle(survivors(df, key, row_id, rank, bundles, at_least), "survivors")
    single = {b.fields[0]: i for i, b in enumerate(bundles) if len(b.fields) == 1}
    coupled = sorted({f for d in dependencies for f in d})
    broken, facts = None, []
    for det, dep in dependencies:
        fact = settle(dependency(df, det, dep), "dependency")
        facts.append(fact)
        a = first.where(F.col("bundle") == bundles[single[det]].name).select(key, F.get("values", F.lit(0)).alias("det"))
        b = first.where(F.col("bundle") == bundles[single[dep]].name).select(key, F.get("values", F.lit(0)).alias("got"))
        bad = a.join(b, key).join(fact, "det").where("got <> dep").select(key)
        broken = bad if broken is None else broken.unionByName(bad)
    broken = settle(broken.distinct(), "broken")
    rows = df.join(broken, key, "left_semi")
    wanted = F.array(*[F.struct(F.lit(f).alias("field"), F.when(bundles[single[f]].valid, F.col(f).cast("string")).alias("value")) for f in coupled])
    place = [-trust] if trust is not None else rank
    at = [f"p{i}" for i in range(len(place))]
    options = rows.select(key, *[c.alias(n) for c, n in zip(place, at)], F.col(row_id).alias("row_id"), F.inline(wanted)).where("value is not null")
    options = options.groupBy(key, "field", "value").agg(F.min(F.struct(*at, "row_id")).alias("b")).select(key, "field", "value", "b.*")
    for i, ((det, _), fact) in enumerate(zip(dependencies, facts)):
        options = options.join(fact.select(F.col("det").alias("value"), F.lit(det).alias("field"), F.col("dep").alias(f"dep{i}")), ["value", "field"], "left")
    deps, asked = list(dependencies), [f"dep{i}" for i in range(len(dependencies))]
    free = [f for f in coupled if f not in {d for _, d in deps}]  # nothing asks for a certain value of these
    alike = F.when(F.col("field").isin(free), F.lit(None).cast("string")).otherwise(F.col("value"))
    options = options.withColumn("alike", alike).groupBy(key, "field", "alike", *asked).agg(F.min(F.struct(*at, "row_id", "value")).alias("b")).select(key, "field", *asked, "b.*")

    by_trust = trust is not None

    def choose(pdf):
        pdf = pdf.sort_values([*at, "row_id"])
        fields = [f for f in coupled if (pdf["field"] == f).any()]
        size = len(pdf) + 1
        order = {f: n for n, f in enumerate(sorted(coupled, key=lambda f: (weights or {}).get(f, 0)))}
        worth = lambda r, f, k: -float(r.p0) if by_trust else (size - k) * (size + 1) ** order[f]
        cand = [[(worth(r, f, k), (r.value, tuple(getattr(r, d) for d in asked), r.row_id)) for k, r in enumerate(pdf[pdf["field"] == f].itertuples(index=False))] for f in fields]

        def allowed(chosen, i, values):
            for n, (det, dep) in enumerate(deps):
                for j, other in chosen.items():
                    if fields[j] == det and fields[i] == dep and other[1][n] not in (None, values[0]):
                        return False
                    if fields[i] == det and fields[j] == dep and values[1][n] not in (None, other[0]):
                        return False
            return True

        picks = [(f, cand[i][k][1]) for i, (f, k) in enumerate(zip(fields, branch_and_bound(cand, allowed))) if k >= 0]
        out = pdf.iloc[[0] * len(picks)][[key]].reset_index(drop=True)
        out["field"], out["row_id"], out["value"] = [f for f, _ in picks], [v[2] for _, v in picks], [v[0] for _, v in picks]
        return out

    names = F.create_map(*[F.lit(x) for f in coupled for x in (f, bundles[single[f]].name)])
    mended = options.groupBy(key).applyInPandas(choose, f"{key} string, field string, row_id bigint, value string")
    mended = mended.select(key, F.element_at(names, F.col("field")).alias("bundle"), "row_id", F.array("value").alias("values"))
    touched = [bundles[single[f]].name for f in coupled]
    kept = first.where(~F.col("bundle").isin(touched)).unionByName(first.where(F.col("bundle").isin(touched)).join(broken, key, "left_anti"))
    return kept.unionByName(mended)


STATES = ("parsed", "partial", "empty", "error-only", "unsupported", "unreadable", "missing")  # fixed values, best first
BLANK = r"[\s ​﻿　]+"


def session_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sessions with the parts of its rank and what has a value."""
    wanted = ["id", "session_row_id", "workspace_id", "title", "workspace", "created_at", "message_count", "transcript_state", "sources", "preferred_source", "metadata"]
    s = table(spark, sf_dir, "sessions").select(*wanted).join(zones(spark, sf_dir), "workspace_id", "left")
    state = F.lower(F.regexp_replace(F.coalesce("transcript_state", F.lit("missing")), BLANK, ""))
    place = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(STATES) for x in (k, i)]), state), F.lit(len(STATES) - 1))
    n = F.size(F.array_distinct(F.filter(F.coalesce("sources", F.array().cast("array<string>")), lambda x: x.isNotNull())))
    prefers = F.when(F.col("preferred_source") == "composer", 0).when(F.col("preferred_source") == "store", 1).otherwise(2)
    modified = times.utc_ms(F.col("metadata.last_modified"), F.col("tz"))
    return s.select("id", "session_row_id", "workspace_id", "preferred_source", F.col("metadata.last_modified").alias("last_modified"), "title", "workspace", "created_at", "message_count", place.alias("state"), (-n).alias("sources"), prefers.alias("prefers"), F.coalesce(-modified, F.lit(2**62)).alias("modified"), times.utc_ms(F.col("created_at"), F.col("tz")).alias("created_ms"))


RANK = ["state", "sources", "prefers", "modified"]


def has_text(name: str) -> Column:
    return F.col(name).isNotNull() & (F.regexp_replace(name, BLANK, "") != "")


def session_bundles() -> list[Bundle]:
    return [Bundle("title", ("title",), has_text("title")), Bundle("workspace", ("workspace",), has_text("workspace")), Bundle("created_at", ("created_at",), F.col("created_ms").isNotNull()), Bundle("message_count", ("message_count",), F.col("message_count").isNotNull())]


#: Beside the four fields: the workspace's id, which must be the one that goes with the path, and the pair of what wrote a copy and when.
def all_bundles() -> list[Bundle]:
    return [*session_bundles(), Bundle("workspace_id", ("workspace_id",), has_text("workspace_id")), Bundle("origin", ("preferred_source", "last_modified"), has_text("preferred_source") & has_text("last_modified"))]


def consistent_sessions(spark: SparkSession, sf_dir: str, at_least: int, **more) -> DataFrame:
    return consistent_survivors(session_copies(spark, sf_dir), "id", "session_row_id", [F.col(c) for c in RANK], all_bundles(), [("workspace", "workspace_id")], at_least, **more)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated rank decides on each of the four fields, so the path weighs more than the id that must go with it: where both can't be had, another id is taken, never another path."""
    got = consistent_sessions(spark, sf_dir, 2, weights={"workspace": 2, "workspace_id": 1})
    return got.where(F.col("bundle").isin([b.name for b in session_bundles()])).select("id", F.col("bundle").alias("field"), F.col("row_id").alias("session_row_id"))


def p4_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survivors of every session in all bundles, by the greatest sum of trust; origin takes both its fields from one copy."""
    trust = (F.lit(7) - F.col("state")) * 100 + F.least(-F.col("sources"), F.lit(9)) * 10 + (3 - F.col("prefers")) + 1 / (1 + F.exp(F.col("modified") / 1e11 + 16))
    got = consistent_sessions(spark, sf_dir, 1, trust=trust)
    return got.select("id", F.col("bundle").alias("field"), F.col("row_id").alias("session_row_id"), F.concat_ws(" | ", "values").alias("value"))

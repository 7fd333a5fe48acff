"""Schemas that drift between the drops of a feed: one consistent table and a report of each change.

Files are flattened to (entity, path, type, hash of the value) in one Arrow pass. Each path of each drop is profiled:
its types and a theta sketch of its (entity, value) pairs. Between neighbouring drops, a path that went and one that came
are a candidate rename if their sketches overlap; there are as many as fields ask for, never as files. An exact join on
the entity, over the values of candidates only, confirms that values are equal. Candidates are weighed by the overlap of
their sketches and the likeness of their names, and a bipartite matching of greatest weight picks the renames.
"""

from __future__ import annotations

import difflib
import json
import re
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from convoloom.session import settle, table

DROP = ["install_id", "feed", "drop_no"]
FLAT = "install_id string, feed string, drop_no int, entity_id string, file_id bigint, path string, type string, vhash bigint, value string"


#: Sketches with an estimate below this, a little under their nominal 4096 entries, hold every pair.
EXACT = 4000


def _refuse(name):
    raise ValueError(name)


def _kind(v) -> str:
    return "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "fraction" if isinstance(v, float) else "array" if isinstance(v, list) else "string"


def compact(v) -> str:
    """A value as compact JSON."""
    return str(v) if type(v) is int else json.dumps(v, sort_keys=True, separators=(",", ":"))


def hash_of(t: str, v) -> int:
    """A hash of a value with its type, as a bigint."""
    return xxhash.xxh64_intdigest(f"{t}:{v if t == 'string' else compact(v)}".encode("utf8", "surrogatepass")) - 2**63


@lru_cache(10_000)
def readable(path: str) -> str:
    """A path without lone surrogates."""
    return path.encode("utf8", "replace").decode()


def flatten_json(text: str | None) -> list[tuple[str, str, object]] | None:
    """(path, type, value) of each value that is neither object nor null; None if text isn't one whole JSON object. Arrays aren't opened. Of a member that occurs twice the last counts."""
    try:
        top = json.loads(text, parse_constant=_refuse)
    except (ValueError, TypeError, RecursionError):
        return None
    if not isinstance(top, dict):
        return None
    out, stack = [], [("", top)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}" if path else k, x) for k, x in reversed(v.items()))
        elif v is not None:
            out.append((path, _kind(v), v))
    return out


def flatten_files(df: DataFrame, keep_values: bool = True) -> DataFrame:
    """A row for each value of each whole file, and one with null path for the file itself; damaged files give none. Without keep_values, value is null and only its hash stays."""

    def go(batches):
        for b in batches:
            which, paths, types, hashes, values = [], [], [], [], []
            for n, payload in enumerate(b.column(5).to_pylist()):
                got = flatten_json(payload)
                if got is not None:
                    got.append((None, None, None))
                    which += [n] * len(got)
                    paths += [p and readable(p) for p, _, _ in got]
                    types += [t for _, t, _ in got]
                    hashes += [hash_of(t, v) if t else 0 for _, t, v in got]
                    values += [compact(v) if t and keep_values else None for _, t, v in got]
            # what all values of a file share is repeated by Arrow
            head = [b.column(k).take(pa.array(which, pa.int64())) for k in range(5)]
            tail = [pa.array(paths, pa.string()), pa.array(types, pa.string()), pa.array(hashes, pa.int64()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays([*head, *tail], names=[f.split()[0] for f in FLAT.split(", ")])

    return df.select("install_id", "feed", "drop_no", "entity_id", "file_id", "payload").mapInArrow(go, FLAT)


def name_likeness(a: str, b: str) -> float:
    """0 to 1: likeness of two paths without case and separators; equal last parts count half at least."""
    flat = [re.sub(r"[^a-z0-9]", "", x.lower()) for x in (a, b)]
    last = [re.sub(r"[^a-z0-9]", "", x.lower().rpartition(".")[2]) for x in (a, b)]
    return max(difflib.SequenceMatcher(None, *flat).ratio(), 0.5 + difflib.SequenceMatcher(None, *last).ratio() / 2 if last[0] == last[1] else 0)


def best_matching(weights: list[list[float]]) -> list[int]:
    """Column of each row in a matching of greatest total weight, -1 for none; weights of 0 or less aren't edges. Hungarian method, cubic in the number of fields."""
    n, m = len(weights), max(map(len, weights), default=0)
    size = max(n, m)
    cost = [[-max(0.0, weights[i][j]) if i < n and j < len(weights[i]) else 0.0 for j in range(size)] for i in range(size)]
    u, v, match = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        match[0], col, low, way, used = i, 0, [float("inf")] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        while match[col]:
            used[col], row, delta, nxt = True, match[col], float("inf"), 0
            for j in range(1, size + 1):
                if not used[j]:
                    c = cost[row - 1][j - 1] - u[row] - v[j]
                    if c < low[j]:
                        low[j], way[j] = c, col
                    if low[j] < delta:
                        delta, nxt = low[j], j
            for j in range(size + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            col = nxt
        while col:
            match[col], col = match[way[col]], way[col]
    out = [-1] * n
    for j in range(1, size + 1):
        i = match[j] - 1
        if i < n and j <= m and j - 1 < len(weights[i]) and weights[i][j - 1] > 0:
            out[i] = j - 1
    return out


def schema_changes(flat: DataFrame) -> DataFrame:
    """install_id, feed, drop_no, field, change_type, new_field, of each change between neighbouring drops.

    flat is what flatten_files gives, once written. A drop exists if it has a whole file, even one without values.
    Types of a path are compared as sets. A rename needs an entity that has both paths; without any, or with unequal
    values, the paths are removed and added. Entities with several files in a drop compare the sets of their values.
    Files with a null install, feed or drop can't be compared and have no changes. An empty table has no changes.
    """
    pair = F.xxhash64("entity_id", "vhash")
    # the files themselves are in it too, under a null path
    everything = settle(flat.groupBy(*DROP, "path").agg(F.array_sort(F.collect_set("type")).alias("types"), F.theta_sketch_agg(pair).alias("sketch")), "drift-profile")
    profile = everything.where("path is not null")
    drops = everything.where("path is null").select(*DROP).withColumn("before", F.lag("drop_no").over(Window.partitionBy("install_id", "feed").orderBy("drop_no"))).where("before is not null")
    drops = settle(drops, "drift-drops")
    now = drops.join(profile, DROP).select(*DROP, "path", F.col("types").alias("t2"), F.col("sketch").alias("s2"))
    old = drops.join(profile.withColumnRenamed("drop_no", "before"), ["install_id", "feed", "before"]).select(*DROP, "path", F.col("types").alias("t1"), F.col("sketch").alias("s1"))
    both = settle(old.join(now, [*DROP, "path"], "full"), "drift-both")
    typed = both.where("t1 is not null and t2 is not null and t1 <> t2").select(*DROP, F.col("path").alias("field"), F.lit("type").alias("change_type"), F.lit("").alias("new_field"))
    gone, new = both.where("t2 is null"), both.where("t1 is null")

    overlap = F.theta_sketch_estimate(F.theta_intersection("s1", "s2"))
    small = F.least(F.theta_sketch_estimate("s1"), F.theta_sketch_estimate("s2"))
    # below EXACT a sketch holds all its pairs, so without overlap no entity has the same value under both paths
    unsure = F.greatest(F.theta_sketch_estimate("s1"), F.theta_sketch_estimate("s2")) >= EXACT
    edges = gone.select(*DROP, F.col("path").alias("field"), "s1").join(new.select(*DROP, F.col("path").alias("new_field"), "s2"), DROP)
    edges = edges.where((overlap > 0) | unsure).select(*DROP, "field", "new_field", (overlap / F.greatest(F.lit(1), small)).cast("double").alias("overlap"))
    edges = settle(edges, "drift-candidates")

    # exact equality of values on the entities that have both, only over the paths of candidates
    def values(d, at, out):
        wanted = edges.select(*DROP, F.col(out).alias("path")).distinct().join(drops, DROP).select("install_id", "feed", F.col(at).alias("at"), F.col("drop_no").alias("later"), "path")
        kept = d.withColumnRenamed("drop_no", "at").join(wanted, ["install_id", "feed", "at", "path"])
        return kept.groupBy("install_id", "feed", "later", F.col("path").alias(out), "entity_id").agg(F.min("vhash").alias(f"{out}_low"), F.max("vhash").alias(f"{out}_high"))

    real = flat.where("path is not null").select(*DROP, "entity_id", "path", "vhash")
    joined = values(real, "before", "field").join(values(real, "drop_no", "new_field"), ["install_id", "feed", "later", "entity_id"])
    equal = (F.col("field_low") == F.col("new_field_low")) & (F.col("field_high") == F.col("new_field_high"))
    exact = joined.groupBy("install_id", "feed", F.col("later").alias("drop_no"), "field", "new_field").agg(F.count("*").alias("n"), F.sum(equal.cast("bigint")).alias("n_equal")).where("n = n_equal")
    confirmed = exact.join(edges, [*DROP, "field", "new_field"])

    def match(batches):
        # rows come sorted, so a drop is a run of rows; only one drop's edges are held at a time
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out = []
        for drop, group in groupby(rows, key=lambda r: r[:3]):
            weight = {(f, g): 1.0 + o + name_likeness(f, g) for _, _, _, f, g, o in group}
            old_, new_ = sorted({f for f, _ in weight}), sorted({g for _, g in weight})
            got = best_matching([[weight.get((f, g), 0.0) for g in new_] for f in old_])
            out += [(*drop, old_[i], new_[j]) for i, j in enumerate(got) if j >= 0]
            if len(out) > 5000:
                yield as_batch(out)
                out = []
        yield as_batch(out)

    def as_batch(rows):
        types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[*DROP, "field", "new_field"])

    parts = int(flat.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = confirmed.repartition(parts, *DROP).sortWithinPartitions(*DROP).select(*DROP, "field", "new_field", "overlap")
    renamed = settle(runs.mapInArrow(match, "install_id string, feed string, drop_no int, field string, new_field string"), "drift-renamed")
    key = [*DROP, "path"]
    removed = gone.select(*key).join(renamed.withColumnRenamed("field", "path").select(*key), key, "left_anti")
    added = new.select(*key).join(renamed.withColumnRenamed("new_field", "path").select(*key), key, "left_anti")
    row = lambda d, what: d.select(*DROP, F.col("path").alias("field"), F.lit(what).alias("change_type"), F.lit("").alias("new_field"))
    return renamed.select(*DROP, "field", F.lit("renamed").alias("change_type"), "new_field").unionByName(row(removed, "removed")).unionByName(row(added, "added")).unionByName(typed)


def canonical_names(changes: DataFrame, flat: DataFrame) -> DataFrame:
    """install_id, feed, drop_no, path, name: the first name a field had, along its renames. Rows are fields of drops, so a group is as large as its schema's history."""
    fields = flat.where("path is not null").select(*DROP, "path").distinct().withColumn("new_field", F.lit(None).cast("string"))
    steps = changes.where("change_type = 'renamed'").select(*DROP, F.col("field").alias("path"), "new_field")

    def follow(pdf):
        pdf = pdf.sort_values("drop_no")
        name, out = {}, []
        for drop, part in pdf.groupby("drop_no", sort=True):
            step = {g: name.get(f, f) for f, g in part.loc[part["new_field"].notna(), ["path", "new_field"]].itertuples(index=False)}
            here = part.loc[part["new_field"].isna(), "path"]
            name = {**name, **step, **{p: step.get(p, name.get(p, p)) for p in here}}
            out += [(drop, p, name[p]) for p in here]
        got = pdf.iloc[[0] * len(out)][["install_id", "feed"]].reset_index(drop=True)
        got["drop_no"], got["path"], got["name"] = [x[0] for x in out], [x[1] for x in out], [x[2] for x in out]
        return got

    return fields.unionByName(steps).groupBy("install_id", "feed").applyInPandas(follow, "install_id string, feed string, drop_no int, path string, name string")


def carrier_flat(spark: SparkSession, sf_dir: str, keep_values: bool = True) -> DataFrame:
    return settle(flatten_files(table(spark, sf_dir, "carrier_files"), keep_values), "drift-flat")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(carrier_flat(spark, sf_dir, keep_values=False)).select("install_id", "feed", "drop_no", "field", "change_type", "new_field")


def unified_type(types: Column) -> Column:
    """The one type of a field in all its drops: its own, number for integers and fractions together, else string."""
    numbers = F.size(F.array_except(types, F.array(F.lit("integer"), F.lit("fraction")))) == 0
    return F.when(F.size(types) == 1, F.element_at(types, 1)).when(numbers, "number").otherwise("string")


def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole files as one table of values under the first name of each field.

    Each field of a feed has one type: value_number holds integers, fractions and numbers, value_boolean booleans, and
    value_text all values as text (arrays as JSON), so that whatever changed its type stays comparable. value is the
    JSON text the file had.
    """
    flat = carrier_flat(spark, sf_dir)
    names = canonical_names(schema_changes(flat), flat)
    named = flat.where("path is not null").join(names, [*DROP, "path"]).withColumnRenamed("name", "field")
    # as many rows as there are fields
    kinds = named.groupBy("feed", "field").agg(unified_type(F.array_sort(F.collect_set("type"))).alias("field_type"))
    v = F.try_parse_json("value")
    numeric = F.col("field_type").isin("integer", "fraction", "number")
    typed = {"value_text": F.coalesce(F.try_variant_get(v, "$", "string"), F.col("value")), "value_number": F.when(numeric, F.try_variant_get(v, "$", "double")), "value_boolean": F.when(F.col("field_type") == "boolean", F.try_variant_get(v, "$", "boolean"))}
    return named.join(kinds, ["feed", "field"]).select("install_id", "feed", "drop_no", "entity_id", "file_id", "field", "field_type", "type", *[c.alias(n) for n, c in typed.items()], "value")

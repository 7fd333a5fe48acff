import itertools
import json
import random

from convoloom.operators.schema_drift import best_matching, canonical_names, compact, flatten_files, flatten_json, name_likeness, p1_unified, schema_changes, unified_type
from convoloom.session import settle

SCHEMA = "install_id string, feed string, drop_no int, entity_id string, file_id bigint, payload string, path string, type int"


def changes(spark, files):
    rows = [(i, f, d, e, n, p if p is None or isinstance(p, str) else json.dumps(p), "clash", 1) for n, (i, f, d, e, p) in enumerate(files)]
    flat = settle(flatten_files(spark.createDataFrame(rows, SCHEMA)), "t")
    return sorted(tuple(r) for r in schema_changes(flat).select("install_id", "feed", "drop_no", "field", "change_type", "new_field").collect()), flat


def test_flatten():
    assert [(p, t, compact(v)) for p, t, v in flatten_json('{"a":{"b":1,"c":[{"d":2}]},"e":null,"f":1.0,"g":true,"h":"x"}')] == [("a.b", "integer", "1"), ("a.c", "array", '[{"d":2}]'), ("f", "fraction", "1.0"), ("g", "boolean", "true"), ("h", "string", '"x"')]
    assert flatten_json("[1]") is None and flatten_json('{"a":1') is None and flatten_json(None) is None and flatten_json('{"a":NaN}') is None and flatten_json("{}") == []


def test_each_change(spark):
    got, _ = changes(
        spark,
        [
            ("i", "f", 1, "e1", {"old": "v1", "gone": 1, "t": 1, "same": True}),
            ("i", "f", 1, "e2", {"old": "v2", "gone": 2, "t": 2, "same": True}),
            ("i", "f", 3, "e2", {"new": "v2", "came": 9, "t": "2", "same": True}),
            ("i", "f", 3, "e3", {"new": "v3", "came": 8, "t": "3", "same": False}),
            ("i", "f", 3, "e3", {"new": "v3", "came": 8, "t": "3", "same": False}),  # the file twice
            ("i", "f", 2, "e1", '{"broken": '),  # a drop of damaged files only is none
            ("j", "f", 1, "e1", {"x": 1}),
            ("i", "f", 4, "e2", {}),  # a drop without values
            (None, "f", 1, "e", {"x": 1}),
            ("i", "g", 1, None, None),
        ],
    )
    assert got == sorted(
        [("i", "f", 3, "came", "added", ""), ("i", "f", 3, "gone", "removed", ""), ("i", "f", 3, "old", "renamed", "new"), ("i", "f", 3, "t", "type", "")]
        + [("i", "f", 4, f, "removed", "") for f in ("came", "new", "same", "t")]
    )


def test_unequal_or_unseen_values_are_no_rename(spark):
    got, _ = changes(spark, [("i", "f", 1, "a", {"x": 1}), ("i", "f", 2, "b", {"y": 1})])
    assert got == [("i", "f", 2, "x", "removed", ""), ("i", "f", 2, "y", "added", "")]
    got, _ = changes(spark, [("i", "f", 1, "a", {"x": 1}), ("i", "f", 1, "b", {"x": 1}), ("i", "f", 2, "a", {"y": 1}), ("i", "f", 2, "b", {"y": 2})])
    assert got == [("i", "f", 2, "x", "removed", ""), ("i", "f", 2, "y", "added", "")]


def test_ties_go_by_name(spark):
    got, _ = changes(spark, [("i", "f", 1, "a", {"createdAt": 5, "size": 5}), ("i", "f", 2, "a", {"sizeValue": 5, "created_at": 5})])
    assert got == [("i", "f", 2, "createdAt", "renamed", "created_at"), ("i", "f", 2, "size", "renamed", "sizeValue")]


def test_names_follow_renames(spark):
    _, flat = changes(spark, [("i", "f", 1, "a", {"x": 1}), ("i", "f", 2, "a", {"y": 1}), ("i", "f", 3, "a", {"z": 1, "w": 2})])
    got = {(r["drop_no"], r["path"]): r["name"] for r in canonical_names(schema_changes(flat), flat).collect()}
    assert got == {(1, "x"): "x", (2, "y"): "x", (3, "z"): "x", (3, "w"): "w"}


def test_sketches_never_lose_a_rename(spark):
    """One entity of ten thousand has both paths, which sketches in estimation mode mostly miss."""
    n = 10_000
    files = [("i", "f", 1, f"a{k}", {"old": k}) for k in range(n)] + [("i", "f", 2, f"b{k}", {"new": k}) for k in range(n)] + [("i", "f", 1, "both", {"old": -1}), ("i", "f", 2, "both", {"new": -1})]
    assert changes(spark, files)[0] == [("i", "f", 2, "old", "renamed", "new")]


def test_one_type_for_a_field(spark):
    from pyspark.sql import functions as F

    rows = [(["integer"],), (["fraction", "integer"],), (["array", "string"],), (["boolean"],), (["boolean", "integer"],)]
    got = [r[0] for r in spark.createDataFrame(rows, "t array<string>").select(unified_type(F.col("t"))).collect()]
    assert got == ["integer", "number", "string", "boolean", "string"]


def test_unified_table(spark, sf):
    got = p1_unified(spark, sf).cache()
    assert got.groupBy("feed", "field").agg({"field_type": "count"}).count() == got.select("feed", "field", "field_type").distinct().count()
    bad = got.where("(field_type in ('integer', 'fraction', 'number')) <> (value_number is not null) or (field_type = 'boolean') <> (value_boolean is not null) or value_text is null")
    assert got.count() > 0 and bad.count() == 0


def test_empty(spark):
    assert changes(spark, [])[0] == []


def test_matching_against_all_permutations():
    rng = random.Random(5)
    for _ in range(200):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        w = [[rng.choice([0, 0, 1, 2, 3]) for _ in range(m)] for _ in range(n)]
        got = sum(w[i][j] for i, j in enumerate(best_matching(w)) if j >= 0)
        size = max(n, m)
        best = max(sum(w[i][p[i]] for i in range(n) if p[i] < m) for p in itertools.permutations(range(size)))
        assert got == best


def test_likeness():
    assert name_likeness("createdAt", "created_at") == 1 > name_likeness("createdAt", "title")

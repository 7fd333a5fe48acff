import itertools
import random

from pyspark.sql import functions as F

from convoloom.llm.survivor import Bundle, branch_and_bound, consistent_survivors, dependency, p4_found, survivors

SCHEMA = "id string, row bigint, rank int, a string, b string, c string, row_id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def bundles():
    return [Bundle("ab", ("a", "b"), F.col("a").isNotNull() & F.col("b").isNotNull()), Bundle("c", ("c",), F.trim("c") != "")]


def test_whole_bundles_by_rank(spark):
    rows = [("x", 1, 2, "a1", "b1", "c1"), ("x", 2, 1, "a2", None, " "), ("x", 3, 2, "a3", "b3", "c3"), ("y", 4, 1, "a", "b", "c"), (None, 5, 1, "a", "b", "c"), (None, 6, 1, "a", "b", "c"), ("z", 7, 1, None, None, None), ("z", 8, 1, None, "b", "")]
    got = {(r["id"], r["bundle"]): (r["row_id"], list(r["values"])) for r in survivors(frame(spark, rows), "id", "row", [F.col("rank")], bundles()).collect()}
    assert got == {("x", "ab"): (1, ["a1", "b1"]), ("x", "c"): (1, ["c1"])}
    assert survivors(frame(spark, []), "id", "row", [F.col("rank")], bundles()).count() == 0


def test_repeated_rows_and_ties(spark):
    rows = [("x", 9, 1, "a9", "b", "c9"), ("x", 3, 1, "a3", "b", "c3"), ("x", 3, 1, "a3", "b", "c3")]
    got = {r["bundle"]: r["row_id"] for r in survivors(frame(spark, rows), "id", "row", [F.col("rank")], bundles()).collect()}
    assert got == {"ab": 3, "c": 3}


def test_branch_and_bound_against_all_choices():
    rng = random.Random(7)
    for _ in range(200):
        cand = [[(rng.random(), (rng.randrange(3),)) for _ in range(rng.randrange(4))] for _ in range(3)]
        pairs = {(rng.randrange(3), rng.randrange(3)) for _ in range(5)}
        allowed = lambda chosen, i, v: all((o[0], v[0]) in pairs for j, o in chosen.items() if j + 1 == i)

        def value(picks):
            chosen, total = {}, 0.0
            for i, k in enumerate(picks):
                if k >= 0:
                    t, v = cand[i][k]
                    if not allowed(chosen, i, v):
                        return -1
                    chosen[i], total = v, total + t
            return total

        best = max(value(p) for p in itertools.product(*[range(-1, len(c)) for c in cand]))
        assert abs(value(branch_and_bound(cand, allowed)) - best) < 1e-9


def test_dependencies_hold(spark):
    # w1 goes with /p1 and w2 with /p2; in x the best rows disagree
    rows = [("x", 1, 1, "w1", None, None), ("x", 2, 2, None, "/p2", None), ("x", 3, 3, "w1", "/p1", "t"), ("y", 4, 1, "w1", "/p1", "t"), ("z", 5, 1, "w2", "/p2", None)]
    df = frame(spark, rows)
    assert {tuple(r) for r in dependency(df, "a", "b").collect()} == {("w1", "/p1"), ("w2", "/p2")}
    bs = [Bundle("a", ("a",), F.col("a").isNotNull()), Bundle("b", ("b",), F.col("b").isNotNull()), Bundle("c", ("c",), F.col("c").isNotNull())]
    got = {(r["id"], r["bundle"]): r["values"][0] for r in consistent_survivors(df, "id", "row", [F.col("rank")], bs, [("a", "b")], 1, trust=1.0 / F.col("rank")).collect()}
    assert got == {("x", "a"): "w1", ("x", "b"): "/p1", ("x", "c"): "t", ("y", "a"): "w1", ("y", "b"): "/p1", ("y", "c"): "t", ("z", "a"): "w2", ("z", "b"): "/p2"}


def test_weights_say_which_field_goes_first(spark):
    # in x the best copy has w1 without a path, the next /p2, which goes with w2; w2 comes last
    rows = [("x", 1, 1, "w1", None, None), ("x", 2, 2, None, "/p2", None), ("x", 3, 3, "w2", "/p9", None)]
    rows += [(f"k{i}", 10 + i, 1, f"w{1 + i % 2}", f"/p{1 + i % 2}", None) for i in range(6)]
    df = frame(spark, rows)
    bs = [Bundle("a", ("a",), F.col("a").isNotNull()), Bundle("b", ("b",), F.col("b").isNotNull()), Bundle("bc", ("b", "c"), F.col("b").isNotNull())]
    run = lambda weights: {r["bundle"]: (r["row_id"], r["values"][0]) for r in consistent_survivors(df, "id", "row", [F.col("rank")], bs, [("b", "a")], 2, weights=weights).where("id = 'x'").collect()}
    assert run({"b": 2, "a": 1}) == {"a": (3, "w2"), "b": (2, "/p2"), "bc": (2, "/p2")}
    got = run({"a": 2, "b": 1})
    # /p9 is paired with w2 as often as /p2 isn't, so no path fits w1
    assert got["a"] == (1, "w1") and "b" not in got


def test_archive(spark, sf):
    got = p4_found(spark, sf)
    assert got.dtypes == [("id", "string"), ("field", "string"), ("session_row_id", "bigint")]
    assert got.groupBy("id", "field").count().where("count > 1").count() == 0

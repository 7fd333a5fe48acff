import random

from convoloom.functions.ordered import nearest_values, place_in_key, running_sum, with_index, with_next


def rows(spark, n=400):
    rng = random.Random(3)
    # one key holds half of all rows
    data = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), i, rng.choice([None, None, rng.randrange(100)])) for i in range(n)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "k string, i bigint, v int")


def test_next_and_index(spark):
    data, df = rows(spark)
    got = {r["i"]: r["next"] and r["next"]["i"] for r in with_next(df, ["i"], ["i"]).collect()}
    assert got == {i: i + 1 if i < 399 else None for i in range(400)}
    assert {r["i"]: r["index"] for r in with_index(df, ["i"]).collect()} == {i: i + 1 for i in range(400)}


def test_nearest_and_places(spark):
    data, df = rows(spark)
    by = {}
    for k, i, v in sorted(data, key=lambda r: r[1]):
        by.setdefault(k, []).append((i, v))
    want, places = {}, {}
    for k, xs in by.items():
        for n, (i, _) in enumerate(xs):
            want[i] = (next((v for _, v in reversed(xs[:n]) if v is not None), None), next((v for _, v in xs[n + 1 :] if v is not None), None))
            places[i] = n + 1
    assert {r["i"]: (r["previous"], r["following"]) for r in nearest_values(df, "k", ["i"], "v").collect()} == want
    assert {r["i"]: r["place"] for r in place_in_key(df, "k", ["i"]).collect()} == places


def test_running_sum_and_empty(spark):
    data, df = rows(spark)
    total, want = 0, {}
    for _, i, v in sorted(data, key=lambda r: r[1]):
        total += v or 0
        want[i] = total
    assert {r["i"]: r["total"] for r in running_sum(df, ["i"], "v").collect()} == want
    none = spark.createDataFrame([], "k string, i bigint, v int")
    assert with_next(none, ["i"], ["i"]).count() == with_index(none, ["i"]).count() == place_in_key(none, "k", ["i"]).count() == 0

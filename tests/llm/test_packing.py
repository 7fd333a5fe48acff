import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from convoloom.llm.packing import best_fit_plan, pack, places


def brute(sizes, capacity):
    """Best-fit decreasing, item by item."""
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            g = min(fits)
            gaps.remove(g)
        else:
            g = capacity
        gaps.append(g - s)
    return sorted(gaps)


@given(st.lists(st.integers(1, 30), min_size=1, max_size=80))
def test_plan_is_best_fit_decreasing(sizes):
    counts = Counter(sizes)
    plan = best_fit_plan(counts, 30)
    size = np.array([s for s, n in counts.items() for _ in range(n)])
    rank = np.array([r for _, n in counts.items() for r in range(n)])
    box, at = places(plan, size, rank)
    used = defaultdict(list)
    for b, a, s in zip(box.tolist(), at.tolist(), size.tolist()):
        used[b].append((a, s))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + s == b for (a, s), (b, _) in zip(spans, spans[1:])) and sum(s for _, s in spans) <= 30
    assert sorted(used) == list(range(len(used)))
    assert sorted(30 - sum(s for _, s in spans) for spans in used.values()) == brute(sizes, 30)


def test_large_counts_stay_small_plans():
    plan = best_fit_plan({1: 10**9, 7: 10**9, 333: 10**8}, 1000)
    assert len(plan) < 40


def check(rows, sizes, limits):
    by = defaultdict(list)
    pieces = defaultdict(list)
    for r in rows:
        if r["window_no"] is not None:
            by[r["window_id"], r["window_no"]].append((r["start_pos"], r["n_tokens"]))
        pieces[r["window_id"], r["doc_id"]].append((r["piece_no"], r["n_tokens"]))
    for (w, _), spans in by.items():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= limits[w]
    for w, c in limits.items():
        for d, n in sizes.items():
            got = sorted(pieces[w, d])
            assert sum(x for _, x in got) == (n or 0) and len(got) == max(1, -(-(n or 0) // c))


def test_frame_with_hot_sizes(spark):
    rng = random.Random(1)
    sizes = {i: 5 if i % 3 == 0 else rng.choice([0, None, 1, 9, 10, 11, 33, rng.randrange(40)]) for i in range(600)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")
    limits = {1: 10, 2: 32}
    rows = pack(df, limits, chunks=4).collect()
    check(rows, sizes, limits)
    none = [r for r in rows if not sizes[r["doc_id"]]]
    assert none and all(r["window_no"] is None and r["start_pos"] == 0 for r in none)
    again = pack(df.repartition(3), limits, chunks=4).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert pack(df, {1: 10}).count() == 0


@pytest.mark.parametrize("capacity", [8192, 32_768, 131_072])
def test_no_window_is_over_full_at_large_capacities(capacity):
    rng = np.random.default_rng(capacity)
    size = np.minimum(capacity, (rng.pareto(0.8, 20_000) * 300 + 1).astype(np.int64))
    counts = Counter(size.tolist())
    rank = np.zeros(len(size), np.int64)
    for s in counts:
        rank[size == s] = np.arange(counts[s])
    box, at = places(best_fit_plan(counts, capacity), size, rank)
    order = np.lexsort((at, box))
    b, a, n = box[order], at[order], size[order]
    same = b[1:] == b[:-1]
    # in a window each item begins where the one before it ends, the first at 0
    assert (a[1:][same] == (a + n)[:-1][same]).all() and (a[1:][~same] == 0).all() and a[0] == 0
    assert np.bincount(box, size).max() <= capacity and len(np.unique(box)) == box.max() + 1


def test_ranks_above_what_a_float_holds():
    plan = np.array([[131_072, 0, 5, 0, 1], [131_072, 2**52 + 1, 9, 3, 1]], np.int64)
    box, at = places(plan, np.array([131_072, 131_072]), np.array([2**52, 2**52 + 1]))
    assert box.tolist() == [5 + 2**52, 9] and at.tolist() == [0, 3]

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from helpers import ODD, WORDS, folder, frame

from assayer.llm import packing


def brute(lengths, capacities, cost=packing.bin_cost):
    """Sequential best-fit decreasing: the tightest bin that fits, or a new one of the least cost a token."""
    rooms, opened = [], []
    rest = sum(lengths)
    left = Counter(lengths)
    for n in sorted(lengths, reverse=True):
        fits = [(r, k) for k, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits)[1]] -= n
        else:
            smaller = sum(m * c for m, c in left.items() if m < n)
            best = min((c for c in capacities if c >= n), key=lambda c: (cost(c) / min(c, min(c // n, left[n]) * n + smaller), c))
            rooms.append(best - n)
            opened.append(best)
        left[n] -= 1
        rest -= n
    content = [c - r for c, r in zip(opened, rooms, strict=True)]
    return Counter(min(c for c in capacities if c >= x) for x in content), sorted(content)


def check(rows, capacities):
    """Bins hold what they say, without overlap, and no smaller size would do."""
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin"]].append((r["offset"], r["n_tokens"], r["capacity"]))
    for items in bins.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(items, items[1:], strict=False))
        content = items[-1][0] + items[-1][1]
        (capacity,) = {c for _, _, c in items}
        assert capacity == min(c for c in capacities if c >= content)
    return Counter(items[0][2] for items in bins.values()), sorted(sum(n for _, n, _ in items) for items in bins.values())


@pytest.mark.parametrize("seed", range(4))
def test_equals_sequential_best_fit(spark, seed):
    rng = random.Random(seed)
    lengths = [min(64, int(rng.expovariate(0.08)) + 1) for _ in range(rng.randrange(1, 400))]
    capacities = (8, 16, 32, 64)
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, n int")
    from pyspark.sql import functions as F

    found = packing.pack(df, capacities, length=F.col("n"), salts=5).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in found) == list(enumerate(lengths))
    assert check(found, capacities) == brute(lengths, capacities)


def test_one_size_is_classical_best_fit():
    lengths = [6, 5, 5, 4, 3, 3, 2, 2]
    plan = packing.plan(dict(Counter(lengths)), [10])
    assert plan.bins == 3 and plan.used == {10: 3}


def test_joint_sizes_cost_no_more_than_the_largest_alone():
    rng = random.Random(3)
    histogram = Counter(rng.randrange(1, 2049) for _ in range(3000))
    cost = lambda p: sum(packing.bin_cost(c) * n for c, n in p.used.items())
    assert cost(packing.plan(histogram)) <= cost(packing.plan(histogram, [2048]))


def test_long_documents_and_odd_texts(spark, tmp_path):
    texts = [*ODD, "w " * 5000, "w " * 2047, "w " * 2048]
    found = packing.op2_variable_best_fit(spark, folder(spark, tmp_path, texts)).collect()
    check(found, packing.CAPACITIES)
    pieces = defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["n_tokens"]))
    for i, t in enumerate(texts):
        n = len(WORDS(t or "")) + 1
        p = sorted(pieces[i])
        assert sum(x[2] for x in p) == n and [x[0] for x in p] == list(range(len(p))) and p[-1][1] + p[-1][2] == n
        assert all(x[2] == max(packing.CAPACITIES) for x in p[:-1])


def test_null_ids_repeated_rows_and_empty_tables(spark):
    found = packing.pack(frame(spark, ["a b"] * 50, [1] * 20 + [None] * 30)).collect()
    assert len(found) == 50 and len({(r["bin"], r["offset"]) for r in found}) == 50
    assert packing.pack(frame(spark, ["a"]).limit(0)).count() == 0
    assert packing.pack(frame(spark, ["a", "b"]).withColumnRenamed("lang", "salt").withColumnRenamed("source", "bin")).count() == 2

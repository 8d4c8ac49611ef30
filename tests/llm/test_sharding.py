from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import ODD, folder, frame

from assayer.llm import sharding


def brute_capacity(sizes, shards):
    """The least capacity by trying all."""
    for capacity in range(max(sizes), sum(sizes) + 1):
        used, free = 1, capacity
        for s in sizes:
            if s > free:
                used, free = used + 1, capacity
            free -= s
        if used <= shards:
            return capacity
    return sum(sizes)


@pytest.mark.parametrize("seed", range(5))
def test_least_capacity(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 60))]
    assert sharding.least_capacity(np.array(sizes), 7) == brute_capacity(sizes, 7)


@pytest.mark.parametrize("seed", range(3))
def test_cuts_over_ranges_equal_those_over_all_groups(spark, seed):
    rng = random.Random(seed)
    groups = sorted((rng.randrange(-(1 << 63), 1 << 63), rng.choice([1, 5, 30, 500])) for _ in range(400))
    df = spark.createDataFrame(groups, "h bigint, size bigint")
    capacity, cuts = sharding.plan_cuts(df, 16)
    assert capacity == sharding.least_capacity(np.array([s for _, s in groups]), 16)
    loads = defaultdict(int)
    for h, s in groups:
        loads[sum(h >= c for c in cuts)] += s
    assert len(cuts) <= 15 and max(loads.values()) <= capacity


@pytest.mark.parametrize("share", [3, 6, 10, 30])
@pytest.mark.parametrize("place", [0.02, 0.4, 0.97])
def test_one_very_large_group(spark, share, place):
    """Capacity as over all groups, few ranges refined, no shard empty, and the others near equal."""
    rng = np.random.default_rng(share)
    n = 3000
    h, sizes = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, n)), rng.integers(1, 200, n)
    sizes[int(place * n)] = share * sizes.sum() // (100 - share)
    df = spark.createDataFrame(list(zip(h.tolist(), sizes.tolist(), strict=True)), "h bigint, size bigint")
    capacity, cuts = sharding.plan_cuts(df, 16)
    assert capacity == sharding.least_capacity(sizes, 16)
    loads = np.bincount(np.searchsorted(np.array(cuts), h, side="right"), sizes, 16)
    assert len(cuts) == 15 and loads.max() <= capacity and loads.min() > 0
    if share >= 10:  # it stands alone; a stretch beside it has at most one shard less than would suit it
        others = np.sort(loads)[:-1]
        assert others.max() < 1.35 * (loads.sum() - loads.max()) / 15


def test_no_more_than_a_few_ranges_are_refined(monkeypatch):
    """However many groups there are: what reaches the driver has a bound."""
    rng = np.random.default_rng(5)
    n, seen = 500_000, []
    h, sizes = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, n)), rng.integers(1, 3000, n)
    sizes[n // 3] = 0.06 * sizes.sum()

    def ranges(part, bits):
        first, at = np.unique(h[part] >> (64 - bits) << (64 - bits), return_inverse=True)
        largest = np.zeros(len(first), np.int64)
        np.maximum.at(largest, at, sizes[part])
        return np.stack([first, np.full(len(first), bits), np.bincount(at, sizes[part]).astype(np.int64), largest, np.bincount(at)], axis=1)

    def refined(groups, atoms, wanted):
        seen.append(int(wanted.sum()))
        parts = [atoms.rows(~wanted)]
        for bits in np.unique(atoms.bits[wanted]).tolist():
            inside = np.isin(h >> (64 - bits), atoms.first[wanted & (atoms.bits == bits)] >> (64 - bits))
            parts.append(ranges(np.flatnonzero(inside), min(64, bits + sharding.MORE_BITS)))
        return sharding._Atoms(np.concatenate(parts))

    monkeypatch.setattr(sharding, "_ranges", lambda groups, bits: ranges(groups, bits))
    monkeypatch.setattr(sharding, "_refined", refined)
    capacity, _ = sharding.plan_cuts(np.arange(n), 16)
    assert capacity == sharding.least_capacity(sizes, 16)
    assert max(seen) < 1000 and len(seen) < 20


def test_equal_hashes_and_cut_ties(spark):
    df = spark.createDataFrame([(h, 10) for h in (-5, -5, 0, 0, 7, 8, 9, 10)], "h bigint, size bigint")
    capacity, cuts = sharding.plan_cuts(df, 3)
    assert capacity == 30 and all(c in (-5, 0, 7, 8, 9, 10) for c in cuts)


def check(rows, texts):
    groups, shards = defaultdict(set), defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["size"] == (0 if t is None else len(t.encode())) + 1
        assert r["text_crc32"] == (None if t is None else zlib.crc32(t.encode())) and r["law"] == "bytes" and r["grown_shard"] is None
        groups[t].add(r["shard"])
        shards[r["shard"]].append((r["slot"], r["size"]))
    assert all(len(s) == 1 for s in groups.values())
    for s in shards.values():
        assert sorted(x for x, _ in s) == list(range(len(s)))
    assert set(shards) <= set(range(16))
    return {k: sum(n for _, n in s) for k, s in shards.items()}


def test_query(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc é", k=rng.randrange(200))) for _ in range(900)] + ["copy " * 20] * 40 + ODD
    df = sharding.op5_minimax_shards(spark, folder(spark, tmp_path, texts))
    assert df.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = df.collect()
    assert len(rows) == len(texts)
    loads = check(rows, texts)
    order = defaultdict(int)
    for r in spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("xxhash64(text) h", "coalesce(octet_length(text), 0) + 1 size").collect():
        order[r["h"]] += r["size"]
    assert max(loads.values()) == sharding.least_capacity(np.array([order[h] for h in sorted(order)]), 16)
    assert len(loads) == 16


def test_very_long_texts_and_one_group_of_a_third(spark):
    texts = ["x" * 3_000_000, "y" * 2_500_000, *[f"text {k} " * 20 for k in range(600)], *["the same " * 900] * 300]
    rows = sharding.shard(frame(spark, texts)).collect()
    check(rows, texts)


def test_it_runs_no_python(spark, tmp_path):
    plan = sharding.op5_minimax_shards(spark, folder(spark, tmp_path, ["a", "b"]))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_null_ids_repeated_rows_and_empty_tables(spark):
    out = sharding.shard(frame(spark, ["a", "a", "a", None, None], [None, 1, 1, None, 2])).collect()
    assert len(out) == 5 and len({r["shard"] for r in out}) <= 2
    assert sharding.shard(frame(spark, ["a"]).limit(0)).count() == 0
    assert sharding.shard(frame(spark, ["a", "b"]).withColumnRenamed("lang", "shard").withColumnRenamed("source", "h")).count() == 2

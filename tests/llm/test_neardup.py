from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, WORDS, edited, folder, frame, prose

from assayer.llm import neardup
from assayer.llm.common import Workspace
from assayer.llm.components import components


def brute(rows, threshold=85):
    """(n_shingles, component_id, kept) by row, from all pairs of full sets."""
    sets = []
    for _, t in rows:
        w = WORDS("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    lowest = list(range(len(rows)))

    def find(k):
        while lowest[k] != k:
            k = lowest[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= threshold * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                lowest[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(rows):
        known = [x for x in least[find(k)] if x is not None]
        c = min(known) if known and sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=repr)


def of(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def groups(seed):
    """Groups of copies with few and many edits, chains, exact copies, and others."""
    rng = random.Random(seed)
    texts = []
    for size in (2, 3, 12, 60):
        source = prose(rng, 150)
        texts += [source] + [edited(rng, source, rng.randrange(7)) for _ in range(size - 1)]
    chain = prose(rng, 200)
    for _ in range(8):
        texts.append(chain)
        chain = edited(rng, chain, 2)
    texts += [prose(rng, rng.randrange(1, 80)) for _ in range(60)] + [texts[0]] * 5
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    texts = groups(seed)
    assert of(neardup.near_duplicates(frame(spark, texts))) == brute(list(enumerate(texts)))


def test_odd_texts(spark):
    texts = [*ODD, *ODD]
    assert of(neardup.near_duplicates(frame(spark, texts))) == brute(list(enumerate(texts)))


def test_null_and_repeated_ids(spark):
    texts = ["a b c d e f"] * 4 + ["p q r s t u"] * 2 + [None, "x"]
    ids = [5, None, 5, 7, None, None, None, 9]
    assert of(neardup.near_duplicates(frame(spark, texts, ids))) == brute(list(zip(ids, texts, strict=True)))


def test_empty_table_and_clashing_columns(spark):
    assert neardup.near_duplicates(frame(spark, ["a"]).limit(0)).count() == 0
    df = frame(spark, ["a b", "a b"]).withColumnRenamed("lang", "node").withColumnRenamed("source", "component_id")
    assert [r["component_id"] for r in neardup.near_duplicates(df).collect()] == [0, 0]


def test_query(spark, tmp_path):
    texts = [*groups(9), *ODD]
    path = folder(spark, tmp_path, texts)
    df = neardup.op8_bayes_neardup(spark, path)
    assert df.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    assert of(df) == brute(list(enumerate(texts)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    assert of(df) == sorted(con.execute(neardup.OP8_SQL).fetchall(), key=repr)


def test_the_bayesian_bound_is_the_posterior():
    least = neardup.least_matches()
    assert len(least) == neardup.BANDS * neardup.ROWS // neardup.BATCH and list(least) == sorted(least)
    x = np.linspace(0, 1, 200_001)
    for n, m in zip(range(neardup.BATCH, 200, neardup.BATCH), least, strict=False):
        for k, above in ((m, True), (m - 1, False)):
            if k >= 0:
                density = x**k * (1 - x) ** (n - k)
                tail = density[x >= 0.85].sum() / density.sum()
                assert bool(tail >= neardup.MISS) is above


def test_signatures_estimate_similarity():
    rng = random.Random(4)
    a = prose(rng, 400)
    b = edited(rng, a, 8)
    x, y = neardup.shingle_sets(pa.array([a, b]))
    similar = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    assert abs((neardup.signature(x) == neardup.signature(y)).mean() - similar) < 0.15


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components(links, Workspace(spark)).collect()}
    assert {found[k] for k in range(41)} == {0} and {found[k] for k in (100, 101, 102)} == {100}


def test_thresholds_besides_that_of_op8(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        # One word of 50 to 64 replaced in the middle: a similarity of 0.8 or more, but below 0.85.
        w = [f"t{rng.randrange(10**9)}" for _ in range(rng.randrange(50, 65))]
        texts += [" ".join(w), " ".join([*w[:20], "other", *w[21:]])]
    sets = neardup.shingle_sets(pa.array(texts))
    near = [len(np.intersect1d(x, y)) / len(np.union1d(x, y)) for x, y in zip(sets[::2], sets[1::2], strict=True)]
    assert all(0.8 <= s < 0.85 for s in near)
    for threshold, kept in ((80, 40), (85, 80)):
        assert neardup.near_duplicates(frame(spark, texts), threshold=threshold).where("kept").count() == kept


def test_bands_follow_from_the_threshold():
    assert neardup.bands_for(85) == neardup.BANDS == 24
    for threshold in (70, 80, 85, 90):
        bands = neardup.bands_for(threshold)
        assert (1 - (threshold / 100) ** neardup.ROWS) ** bands <= neardup.UNMET
        assert len(neardup.band_keys(neardup.signature(np.arange(9, dtype=np.uint64), bands))) == bands


def test_one_row_of_each_component_stays(spark):
    rng = random.Random(12)
    base = prose(rng, 80)
    other = prose(rng, 80)
    rows = [(3, base), (5, base), (5, other), (7, other + " more"), (8, prose(rng, 60)), (8, prose(rng, 60)), (9, other), (9, other), (9, other), (None, base), (None, prose(rng, 50)), (None, None), (1, None), (1, None), (2, "")]
    docs = spark.createDataFrame([(i, t, f"s{k % 2}") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, node string").repartition(3)
    left = sorted(((r["doc_id"], r["text"]) for r in neardup.distinct_documents(docs).collect()), key=str)
    want = [(3, base), (5, other), rows[4], rows[5], rows[10], (None, None), (1, None), (1, None), (2, "")]
    assert left == sorted(want, key=str) and neardup.distinct_documents(docs).columns == docs.columns
    # Rows that repeat an id and a text: one stays.
    only = frame(spark, [base] * 5 + [prose(rng, 30)], [4, 4, 4, 4, 4, 4])
    assert neardup.distinct_documents(only).count() == 2
    assert neardup.distinct_documents(only.limit(0)).count() == 0


def test_many_null_ids_and_one_shingle_in_every_text(spark):
    """Null ids meet no other row by their id; a passage that all open nodes share is dealt into blocks."""
    rng = random.Random(13)
    common = prose(rng, 30)
    texts = [f"{common} {prose(rng, 12, 10**6)}" for _ in range(700)]
    texts += [edited(rng, t, 1) for t in texts[:80]]
    ids = [None] * 300 + list(range(300, len(texts)))
    out = neardup.near_duplicates(frame(spark, texts, ids)).collect()
    assert len(out) == len(texts)
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in out)
    assert found == sorted((str(i), n, str(c), k) for i, n, c, k in brute(list(zip(ids, texts, strict=True))))


def test_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3)
    rng = random.Random(14)
    common = prose(rng, 40)
    texts = [" ".join([*common.split(), f"x{rng.randrange(9)}", f"y{rng.randrange(9)}", f"z{rng.randrange(9)}"]) for _ in range(60)]
    rows = list(enumerate(texts))
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert out == {i: (n, c) for i, n, c, _ in brute(rows)}


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are written, as text."""
    found, write = [], Workspace.write

    def noted(self, df, name):
        found.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name)

    monkeypatch.setattr(Workspace, "write", noted)
    return found


def copies(spark, seed):
    rng = random.Random(seed)
    texts = [prose(rng, 60) for _ in range(12)]
    return frame(spark, [*texts, *(edited(rng, t, 1) for t in texts), *texts[:4]])


def test_distinct_documents_send_no_table_to_the_driver(spark, plans):
    left = neardup.distinct_documents(copies(spark, 41), threshold=80)
    plans.append(left._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 10
    assert not [p for p in plans if "Broadcast" in p]


def test_the_drivers_heap_is_collected_when_it_is_half_full():
    from types import SimpleNamespace as Fake

    heap = Fake(total=0, most=1000, collected=0, shrinks_to=300)

    def collect():
        heap.collected += 1
        heap.total = heap.shrinks_to

    runtime = Fake(totalMemory=lambda: heap.total, maxMemory=lambda: heap.most)
    work = Workspace.__new__(Workspace)
    work.spark = Fake(_jvm=Fake(java=Fake(lang=Fake(Runtime=Fake(getRuntime=lambda: runtime))), System=Fake(gc=collect)))
    before = Workspace.left
    try:
        Workspace.left = 0
        collected = []
        for total, shrinks_to in [(400, 300), (600, 300), (400, 300), (900, 700), (800, 700), (900, 700)]:
            heap.total, heap.shrinks_to = total, shrinks_to
            work.tidy()
            collected.append(heap.collected)
        assert collected == [0, 1, 1, 2, 2, 3]
    finally:
        Workspace.left = before


def test_components_ids_send_no_table_to_the_driver(spark, plans):
    found = neardup.near_duplicates(copies(spark, 42))
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert not [p for p in plans if "Broadcast" in p]

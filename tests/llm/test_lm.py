from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, WORDS, folder, frame
from pyspark.sql import functions as F

from assayer.llm import attention, lm


def texts_of(seed, n=200):
    rng = random.Random(seed)
    nouns = ["".join(rng.choices(["ba", "ne", "to", "ri", "su"], k=3)) for _ in range(60)]
    return [" ".join(f"the {rng.choice(nouns)} is {rng.choice(nouns)}." for _ in range(rng.randrange(2, 30))) for _ in range(n)]


def tokens(t):
    return WORDS("".join(c.lower() if c.isascii() else c for c in t or "")) + ["\n"]


def test_query(spark, tmp_path):
    texts = [*texts_of(1), *ODD, "The The THE"]
    df = lm.op6_attention_lm(spark, folder(spark, tmp_path, texts))
    assert df.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = {r["doc_id"]: r for r in df.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    counts = Counter(w for i, t in enumerate(texts) if not held[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r, w = rows[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(x in counts for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0
    known = [i for i in range(200) if held[i]]
    assert sum(rows[i]["score"] for i in known) > sum(rows[i]["base_score"] for i in known)


@pytest.mark.parametrize("most", [0, 7])
def test_words_beyond_the_table_are_joined(spark, monkeypatch, most):
    df = frame(spark, [*texts_of(6, 40), *ODD])
    whole = {r["doc_id"]: r for r in lm.score(df).collect()}
    monkeypatch.setattr(lm, "WORDS", most)
    for r in lm.score(df).collect():
        w = whole[r["doc_id"]]
        assert tuple(r)[:5] == tuple(w)[:5]
        assert math.isclose(r["base_score"], w["base_score"], rel_tol=1e-9) and math.isclose(r["score"], w["score"], rel_tol=1e-3)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    p = {k: x.astype(np.float64) for k, x in attention.init(20, 6, 7, 4, 5).items()}
    inputs, targets = rng.integers(0, 20, (3, 7)), rng.integers(0, 6, (3, 7))
    before, prior, weight = rng.integers(0, 6, (3, 7)), rng.standard_normal((6, 6)), rng.integers(0, 2, (3, 7)).astype(float)

    def loss(q):
        logp, _ = attention.forward(q, inputs, prior[before])
        return -(np.take_along_axis(logp, targets[..., None], -1)[..., 0] * weight).sum() / weight.sum()

    g = attention.gradients(p, inputs, before, prior, targets, weight)
    for name, x in p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in x.shape)
            moved = [{k: y.copy() for k, y in p.items()} for _ in range(2)]
            moved[0][name][at] += 1e-5
            moved[1][name][at] -= 1e-5
            assert math.isclose((loss(moved[0]) - loss(moved[1])) / 2e-5, g[name][at], rel_tol=1e-3, abs_tol=1e-6)


def test_scoring_equals_the_forward_pass_and_looks_at_no_later_token():
    rng = np.random.default_rng(2)
    p = attention.init(50, 8, 16)
    inputs, before, wanted = rng.integers(0, 50, (5, 16)), rng.integers(0, 8, (5, 16)), rng.integers(0, 8, (5, 16))
    prior = np.log(rng.dirichlet(np.ones(8), 8)).astype(np.float32)
    logp, _ = attention.forward(p, inputs, prior[before])
    found = attention.score(p, inputs, before, prior, wanted)
    assert np.allclose(found, np.take_along_axis(logp, wanted[..., None], -1)[..., 0], atol=1e-4)
    other = inputs.copy()
    other[:, 9:] = 0
    assert np.allclose(attention.score(p, other, before, prior, wanted)[:, :9], found[:, :9], atol=1e-5)


def model_of(ids, sizes, width):
    counts = np.bincount(ids, minlength=width).astype(float) + 1
    class_of, input_of, within = lm._classes(counts)
    before = np.append(width - 1, ids[:-1])
    keys, n = np.unique(before.astype(np.int64) * width + ids, return_counts=True)
    mass = np.bincount(class_of, counts, lm.CLASSES)  # with so few ids some classes are empty
    with np.errstate(divide="ignore"):
        prior = np.tile(np.log(mass / mass.sum()).astype(np.float32), (lm.CLASSES, 1))
    return lm.Model(class_of, input_of, within, prior, attention.init(lm.OWN_INPUTS + lm.SHARED_INPUTS, lm.CLASSES, lm.WINDOW), lm.Pairs(keys, n.astype(float), counts))


def test_windows_score_every_subword_once():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 5, 31, 32, 33, 57, 58, 59, 200])
    ids = rng.integers(0, 99, sizes.sum()).astype(np.uint16)
    model = model_of(ids, sizes, 100)
    places = np.concatenate([place[scored] for _, _, place, scored in model.windows(ids, sizes)])
    assert sorted(places.tolist()) == list(range(len(ids)))
    batched = model.score(ids, sizes)
    ends = np.cumsum(sizes)
    alone = np.concatenate([model.score(ids[a:b], np.array([b - a])) for a, b in zip(ends - sizes, ends, strict=True)])
    assert np.allclose(batched, alone, atol=1e-4)


def test_the_next_subword_is_a_distribution():
    rng = np.random.default_rng(4)
    width = 60
    ids = rng.integers(0, width, 500)
    model = model_of(ids, np.array([500]), width)
    for before in (0, 7, 59):
        own, left = model.pairs.shares(np.full(width, before), np.arange(width))
        inputs, classes = model.input_of[[[before]]], model.class_of[[[before]]]
        logp, _ = attention.forward(model.params, inputs, model.prior[classes])
        rest = np.exp(logp[0, 0, model.class_of] + model.within)
        assert math.isclose((own + left * rest).sum(), 1, rel_tol=1e-4)


@pytest.mark.parametrize("most", [0, 1, 3, 5, 6, 100])
def test_frequent_pairs_fit_the_table(spark, most):
    pairs = spark.createDataFrame([(k, n) for k, n in enumerate([9, 5, 5, 2, 2, 1, 70_000, 90_000])], "key bigint, n bigint")
    kept, rest = (df.collect() for df in lm.frequent(pairs, most))
    assert len(kept) <= most and (most < 8 or len(kept) == 8) and len(kept) + len(rest) == 8
    assert min((r["n"] for r in kept), default=1 << 20) > max((r["n"] for r in rest), default=0)


def test_subwords_do_not_cross_words():
    s = lm.Subwords.load()
    words = ["the", "a ", " b", "don't", "x" * 300, "日本"]
    ids, sizes = s.encode(words)
    encoding, _ = s._encoding()
    at = np.cumsum(sizes) - sizes
    for w, a, n in zip(words, at, sizes, strict=True):
        assert encoding.decode([int(i) for i in ids[a : a + n]]) == " " + w
    assert [x.tolist() for x in s.encode([])] == [[], []]


def test_null_ids_repeated_rows_and_empty_tables(spark):
    rows = lm.score(frame(spark, ["a b", "a b", "a b"], [None, 3, 3])).collect()
    assert len(rows) == 3 and {r["held_out"] for r in rows if r["doc_id"] is None} == {True}
    assert lm.score(frame(spark, ["a"]).limit(0)).count() == 0
    alone = lm.score(frame(spark, ["a b", None], [None, None])).collect()
    assert all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in alone)
    assert lm.score(frame(spark, ["a", "b"]).withColumnRenamed("lang", "row").withColumnRenamed("source", "words")).agg(F.count("*")).first()[0] == 2


def modelled(spark, monkeypatch, texts):
    """The rows of lm.score by id, and the model behind them."""
    made, real = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a, **b: made.append(real(*a, **b)) or made[-1])
    rows = {r["doc_id"]: r for r in lm.score(frame(spark, texts)).collect()}
    return rows, made[-1]


def test_the_score_is_that_of_the_subwords_in_context(spark, monkeypatch):
    texts = texts_of(8, 60)
    rows, model = modelled(spark, monkeypatch, texts)
    subwords = lm.Subwords.load()
    for i, t in enumerate(texts):
        ids = np.append(subwords.encode(tokens(t)[:-1])[0], subwords.end)
        assert math.isclose(rows[i]["score"], float(model.score(ids, np.array([len(ids)])).sum(dtype=np.float64)), rel_tol=1e-4)


def test_every_training_document_teaches_the_network_once(spark):
    taught = []

    class Coded(lm.Coded):
        def lessons(self, number):
            found = super().lessons(number)
            taught.extend(int(x) for x in found[1])
            return found

    texts = [f"w{k} " * (k + 1) for k in range(50)]
    ids = [*range(49), None]
    held = [i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    rounds = spark.createDataFrame([(i, t, h, 7 * k) for k, (i, t, h) in enumerate(zip(ids, texts, held, strict=True))], "doc_id bigint, text string, held_out boolean, order bigint")
    subwords = lm.Subwords.load()
    for b in lm.code(rounds, subwords).toArrow().to_batches():
        for k in range(b.num_rows):
            c = Coded({n: b.column(at)[k] for at, n in enumerate(b.schema.names)})
            for number in range(lm.ROUNDS):
                c.lessons(number)
    sizes = [len(subwords.encode(tokens(t)[:-1])[0]) + 1 for t, h in zip(texts, held, strict=True) if not h]
    assert sorted(taught) == sorted(sizes)


def test_a_few_documents_train_the_network(spark, monkeypatch):
    _, model = modelled(spark, monkeypatch, texts_of(9, 12))
    first = attention.init(lm.OWN_INPUTS + lm.SHARED_INPUTS, lm.CLASSES, lm.WINDOW)
    assert not np.allclose(model.params["out"], first["out"])
    assert first["q"].shape == (16, 16) and first["w1"].shape == (16, 32)


@pytest.mark.parametrize("most", [0, 20])
def test_pairs_beyond_the_table_are_joined(spark, monkeypatch, most):
    df = frame(spark, [*texts_of(6, 40), *ODD], partitions=1)
    whole = {r["doc_id"]: r["score"] for r in lm.score(df).collect()}
    monkeypatch.setattr(lm, "PAIRS", most)
    for r in lm.score(df).collect():
        assert math.isclose(r["score"], whole[r["doc_id"]], rel_tol=1e-3)


def test_pairs_that_fall_together_are_all_kept():
    rng = np.random.default_rng(5)
    width = 2000
    keys = np.unique(rng.integers(0, width * width, 50_000))
    counts = rng.integers(1, 9, len(keys))
    before = np.bincount(keys // width, counts, width) + 1
    pairs = lm.Pairs(keys, counts, before)
    own, left = pairs.shares(keys // width, keys % width)
    assert np.allclose(own, (counts - lm.DISCOUNT) / before[keys // width], rtol=1e-5)
    assert np.allclose(left + np.bincount(keys // width, own, width)[keys // width], 1, atol=1e-4)
    assert not pairs.shares(np.full(width, 7), np.setdiff1d(np.arange(width), keys[keys // width == 7] % width)[:1].repeat(width))[0].any()


def test_scores_do_not_depend_on_how_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(lm, "GROUP", 1000)
    texts = [*texts_of(10, 150), *ODD]
    found = [{r["doc_id"]: r["score"] for r in lm.score(frame(spark, texts, partitions=n)).collect()} for n in (2, 40)]
    assert all(math.isclose(found[0][i], found[1][i], rel_tol=1e-5) for i in range(len(texts)))
    assert sum(abs(a) for a in found[0].values()) > 1000


def test_groups_learn_window_after_window():
    """Steps are the same whatever portions documents come in, and each subword teaches once."""
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 99, 9000).astype(np.uint16)
    model = model_of(ids, np.array([len(ids)]), 100)
    docs = [(g, 0, ids[a : a + n]) for g, a, n in ((0, 0, 5000), (0, 5000, 1), (0, 5001, 64), (1, 6000, 3000))]
    found = list(lm.learn(model, iter(docs), 1e-2))
    assert [seen for _, seen in found] == [5065, 3000]
    for group, (p, _) in enumerate(found):
        windows = np.concatenate([model.taught(x) for g, _, x in docs if g == group], axis=1)
        q, adam = {k: x.copy() for k, x in model.params.items()}, attention.Adam(1e-2)
        for at in range(0, windows.shape[1], lm.BATCH):
            inputs, classes, wanted = windows[:, at : at + lm.BATCH]
            adam.step(q, attention.gradients(q, inputs, np.maximum(classes, 0), model.prior, wanted, (classes >= 0).astype(np.float32)))
        assert all(np.allclose(p[k], q[k], atol=1e-6) for k in q)
        assert (windows[1] >= 0).sum() == found[group][1]


def test_learning_from_context_lowers_the_loss():
    rng = np.random.default_rng(7)
    ids = np.tile(rng.permutation(40), 800).astype(np.uint16)  # the next one is always told by the one before
    model = model_of(ids, np.array([len(ids)]), 100)
    model.pairs = lm.Pairs(np.zeros(0, np.int64), np.zeros(0), np.ones(100))
    first = model.score(ids[:2000], np.array([2000])).mean()
    ((model.params, _),) = lm.learn(model, iter([(0, 0, ids)]), 5e-3)
    assert model.score(ids[:2000], np.array([2000])).mean() > first + 0.05


def token_by_token(model, ids):
    """log10 of each subword's probability, one after the other, with full sums over ids."""
    width, out, pairs = len(model.class_of), [], {}
    keys, n, counts = model.raw
    for k, c in zip(keys.tolist(), n.tolist(), strict=True):
        pairs[k] = c
    p = model.params
    for j in range(len(ids)):
        window = 0 if j < lm.WINDOW else 1 + (j - lm.WINDOW) // lm.STRIDE
        start = window * lm.STRIDE
        before = [width - 1 if k == 0 else int(ids[k - 1]) for k in range(start, j + 1)]
        x = p["emb"][model.input_of[before]].astype(float) + p["pos"][: len(before)]
        q, keys_, v = x[-1] @ p["q"], x @ p["k"], x @ p["v"]
        a = np.exp(keys_ @ q / math.sqrt(len(q)))
        h = x[-1] + (a / a.sum()) @ v @ p["o"]
        y = h + np.maximum(h @ p["w1"], 0) @ p["w2"]
        z = np.exp(y @ p["out"] + model.prior[model.class_of[before[-1]]])
        each = (z / z.sum())[model.class_of] * np.exp(model.within)
        seen = np.array([pairs.get(before[-1] * width + i, 0) for i in range(width)], float)
        own = np.maximum(seen - lm.DISCOUNT, 0) / counts[before[-1]]
        each = own + (1 - own.sum()) * each
        out.append(math.log10(each[ids[j]]))
    return out


def test_scores_equal_a_token_by_token_model():
    rng = np.random.default_rng(8)
    ids = rng.integers(0, 50, 120)
    model = model_of(ids, np.array([120]), 51)
    counts = np.bincount(np.append(50, ids[:-1]), minlength=51) + 1.0
    keys, n = np.unique(np.append(50, ids[:-1]) * 51 + ids, return_counts=True)
    model.pairs, model.raw = lm.Pairs(keys, n.astype(float), counts), (keys, n, counts)
    model.params = {k: x + rng.standard_normal(x.shape).astype(np.float32) * 0.1 for k, x in model.params.items()}
    assert np.allclose(model.score(ids, np.array([120])), token_by_token(model, ids), atol=2e-4)


def test_the_table_of_pairs_takes_four_bytes_a_slot():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 300 * 300, 20_000))
    pairs = lm.Pairs(keys, rng.integers(1, 50, len(keys)).astype(float), np.full(300, 10_000.0))
    ask = np.arange(300 * 300)
    key, own, may = pairs.find(ask // 300, ask % 300)
    assert np.array_equal(key[own > 0], keys) and not may.any()
    assert pairs._table.nbytes == 4 << pairs.bits


def test_coded_rows_are_read_one_at_a_time(spark, tmp_path, monkeypatch):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    at, read, before = {}, [], spark.conf.get(key)
    write, gathered = lm.Workspace.write, lm.arrays
    monkeypatch.setattr(lm.Workspace, "write", lambda self, df, name: (at.update({name: spark.conf.get(key)}), write(self, df, name))[1])
    monkeypatch.setattr(lm, "arrays", lambda df, *names: (read.append((names, spark.conf.get(key))), gathered(df, *names))[1])
    texts = texts_of(6, 60)
    n = lm.op6_attention_lm(spark, folder(spark, tmp_path, texts)).count()
    assert n == len(texts) and spark.conf.get(key) == before
    assert (at["counts"], at["scored"]) == ("1", "1")
    # The class pairs, the network's rounds, and the tables of pairs and words.
    assert [x for names, x in read if names == ("i", "x")] == [before, *["1"] * lm.ROUNDS]
    assert [x for names, x in read if names == ("key", "n")] == [before, before]


def test_places_of_context_alone_get_no_output():
    rng = np.random.default_rng(9)
    p = attention.init(50, 8, 16)
    inputs, before, wanted = rng.integers(0, 50, (5, 16)), rng.integers(0, 8, (5, 16)), rng.integers(0, 8, (5, 16))
    prior = np.log(rng.dirichlet(np.ones(8), 8)).astype(np.float32)
    whole = attention.score(p, inputs, before, prior, wanted)
    assert np.allclose(attention.Scorer(p, prior)(inputs, before[:, 6:], wanted[:, 6:]), whole[:, 6:], atol=1e-6)
    ids = rng.integers(0, 99, 32 + 24 * 9)
    many = [place.size for _, _, place, _ in model_of(ids, None, 100).windows(ids, np.array([len(ids)]))]
    assert sum(many) == len(ids)


def test_batches_use_the_same_memory_again():
    """With equal results, whatever was in it."""
    rng = np.random.default_rng(10)
    p, room = attention.init(50, 8, 32), attention.Room()
    prior = np.log(rng.dirichlet(np.ones(8), 8)).astype(np.float32)
    for n in (40, 3, 40, 17):
        inputs, before, wanted = rng.integers(0, 50, (n, 32)), rng.integers(0, 8, (n, 32)), rng.integers(0, 8, (n, 32))
        weight = rng.integers(0, 2, (n, 32)).astype(np.float32)
        held = sorted(id(x) for x in room._held.values())
        found = attention.gradients(p, inputs, before, prior, wanted, weight, room)
        alone = attention.gradients(p, inputs, before, prior, wanted, weight)
        assert all(np.array_equal(found[k], alone[k]) for k in p)
        assert not held or held == sorted(id(x) for x in room._held.values())


@pytest.mark.parametrize("rows", [0, 5, 256, 700])
def test_products_in_blocks(rows):
    rng = np.random.default_rng(11)
    a, b, c = rng.standard_normal((rows, 7)), rng.standard_normal((rows, 4)), rng.standard_normal((7, 3))
    assert np.allclose(attention._outer(a, b), a.T @ b)
    assert np.allclose(attention.Room().product("x", a, c), a @ c)


def test_scores_are_the_same_in_any_portions(monkeypatch):
    rng = np.random.default_rng(12)
    sizes = np.array([1, 70, 5, 300, 1, 24, 33])
    ids = rng.integers(0, 99, sizes.sum())
    model = model_of(ids, sizes, 100)
    keys, n = np.unique(rng.integers(0, 100 * 100, 2000), return_counts=True)
    model.pairs = lm.Pairs(keys[::2], n[::2], np.full(100, 400.0), np.zeros(100), lm.HashFilter(np.full(lm.HashFilter.BITS >> 6, ~np.uint64(0))))
    monkeypatch.setattr(lm, "PORTION", 1 << 16)
    whole = model.parts(ids, sizes)
    assert len(whole[1])
    for most in (1, 64, 100):
        monkeypatch.setattr(lm, "PORTION", most)
        found = model.parts(ids, sizes)
        assert np.allclose(found[0], whole[0], atol=1e-4) and np.array_equal(found[1], whole[1])
        assert all(np.allclose(a, b, rtol=1e-4) for a, b in zip(found[2], whole[2], strict=True))


@pytest.mark.parametrize(("low", "high"), [(-9, 9), (0, 9), ((1 << 32) - 9, 1 << 32), (1 << 62, (1 << 62) + 9)])
def test_a_tasks_counts_are_merged(low, high):
    rng = np.random.default_rng(13)
    keys, counts = [rng.integers(low, high, n) for n in (0, 30, 1)], [rng.integers(1, 1 << 30, n) for n in (0, 30, 1)]
    wanted = Counter()
    for k, n in zip(np.concatenate(keys).tolist(), np.concatenate(counts).tolist(), strict=True):
        wanted[k] += n
    key, n = lm._merged(keys, counts)
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == wanted
    assert [len(x) for x in lm._merged(keys[:1], counts[:1])] == [0, 0]

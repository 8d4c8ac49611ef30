from __future__ import annotations

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from helpers import ODD, WORDS, edited, folder, frame

import corpus_pipeline
from assayer.llm import langid, packing, secrets, substrings

SYLLABLES = {"aa": ["ka", "to", "mi", "ru", "sha"], "bb": ["ent", "ord", "ist", "und", "ge"], "cc": ["ção", "es", "um", "que", "nha"]}
SECRET = "password: hunter2222"


def corpus():
    rng = random.Random(8)
    word = lambda lang: "".join(rng.choices(SYLLABLES[lang], k=4)) + str(rng.randrange(10**6))
    passage = " ".join(word("aa") for _ in range(70))
    texts, langs = [], []
    for k in range(120):
        lang = rng.choice(list(SYLLABLES))
        own = " ".join(word(lang) for _ in range(rng.randrange(30, 150)))
        texts.append(own + (f" {passage} " + " ".join(word(lang) for _ in range(20)) if k % 10 == 3 else "") + (f" {SECRET}" if k % 15 == 4 else ""))
        langs.append(lang)
    copies = [edited(rng, texts[k], 1) for k in range(0, 30, 3)] + texts[:5]
    return [*texts, *copies, *ODD], [*langs, *[None] * (len(copies) + len(ODD))], passage


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    texts, langs, passage = corpus()
    path = folder(spark, tmp_path_factory.mktemp("pipeline"), texts, langs=langs)
    docs, after = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.mode("overwrite").parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        after.append(docs)
    return texts, passage, path, after


def texts_in(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(spark, made):
    _, _, path, after = made
    columns = spark.read.parquet(f"{path}/documents.parquet").dtypes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "secret_scan", "best_fit_packing"]
    assert all(df.dtypes == columns for df in after[:-1])


def test_language_stage(spark, made):
    texts, _, path, after = made
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.train(langid.split(docs).where("not held_out"))
    want = {i for i, t in enumerate(texts) if (p := model.predict(t))[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE}
    assert set(texts_in(after[0])) == want and set(range(120)) <= want


def test_each_group_of_near_duplicates_keeps_one(made):
    from test_neardup import brute

    before = sorted(texts_in(made[3][0]).items())
    want = {i for i, _, component, _ in brute(before, corpus_pipeline.SIMILAR) if i == component}
    assert set(texts_in(made[3][1])) == want
    # Short copies with an edit may fall below the threshold; exact ones can't.
    assert sum(120 + k not in want for k in range(10)) >= 5 and not any(130 + k in want for k in range(5))


def test_repeated_passages_stay_once(made):
    _, passage, _, after = made
    before, out = texts_in(after[1]), texts_in(after[2])
    middle = " ".join(passage.split()[15:-15])
    assert sum(middle in t for t in before.values()) > 5 and sum(middle in t for t in out.values()) == 1
    seen: set = set()
    for i, t in sorted(before.items()):
        c = substrings.Chunks(pa.array([t]))
        if not set(c.digest.tolist()) & seen:
            assert out[i] == t
        seen |= set(c.digest.tolist())


def test_no_secret_is_left(made):
    before, out = texts_in(made[3][2]), texts_in(made[3][3])
    assert set(before) == set(out) and sum(SECRET in t for t in before.values()) > 3
    for i, t in before.items():
        assert out[i] == secrets.redact(t, secrets.brute_force(t)) and not secrets.brute_force(out[i])


def test_all_that_is_left_is_packed(made):
    left, bins, tokens = texts_in(made[3][3]), defaultdict(list), defaultdict(int)
    for r in made[3][4].collect():
        bins[r["bin"]].append((r["offset"], r["n_tokens"], r["capacity"]))
        tokens[r["doc_id"]] += r["n_tokens"]
    assert tokens == {i: len(WORDS(t or "")) + 1 for i, t in left.items()}
    for items in bins.values():
        items.sort()
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(items, items[1:], strict=False))
        assert items[-1][0] + items[-1][1] <= items[0][2] and items[0][2] in packing.CAPACITIES


def test_run_equals_its_stages(spark, made):
    key = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "n_tokens").collect()))
    assert key(corpus_pipeline.run(spark, made[2])) == key(made[3][4])


def test_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [None, ""])).count() == 0


def test_near_copies_from_four_fifths_on_go(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(10):
        w = [f"t{rng.randrange(10**9)}" for _ in range(55)]  # 46 of 56 shingles stay: 0.82
        texts += [" ".join(w), " ".join([*w[:20], "other", *w[21:]])]
    left = corpus_pipeline.drop_near_duplicates(spark, frame(spark, texts), "")
    assert sorted(r["doc_id"] for r in left.collect()) == list(range(0, 20, 2))


def test_a_unique_text_stays_though_its_id_has_a_copy_too(spark):
    rng = random.Random(4)
    a, b = (" ".join(f"t{rng.randrange(10**9)}" for _ in range(55)) for _ in range(2))
    left = corpus_pipeline.drop_near_duplicates(spark, frame(spark, [a, a, b, b], [3, 5, 5, 5]), "")
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(3, a), (5, b)]

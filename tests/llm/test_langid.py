from __future__ import annotations

import math
import random
import zlib
from fractions import Fraction
from itertools import product

import numpy as np
from helpers import ODD, folder, frame

from assayer.llm import langid

SYLLABLES = {"aa": ["ka", "to", "mi", "ru", "sha"], "bb": ["ent", "ord", "ist", "und", "ge"], "cc": ["ção", "es", "um", "que", "nha"], "dd": ["zyk", "wie", "prz", "czy", "ów"]}


def corpus(rng, n):
    texts, langs = [], []
    for _ in range(n):
        lang = rng.choice(list(SYLLABLES))
        texts.append(" ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))))
        langs.append(lang)
    return texts, langs


def test_held_out_accuracy(spark, tmp_path):
    rng = random.Random(1)
    texts, langs = corpus(rng, 400)
    langs[::7] = [None] * len(langs[::7])
    true = list(langs)
    df = langid.op4_piece_unigrams(spark, folder(spark, tmp_path, [*texts, *ODD], langs=[*langs, *[None] * len(ODD)]))
    assert df.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = {r["doc_id"]: r for r in df.collect()}
    assert len(rows) == len(texts) + len(ODD)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    judged = [i for i, lang in enumerate(true) if lang and rows[i]["held_out"]]
    assert sum(rows[i]["lang_pred"] == true[i] for i in judged) >= 0.97 * len(judged)
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    for k, t in enumerate(ODD):
        letters = any(c.isalpha() for c in t or "")
        assert (rows[len(texts) + k]["lang_pred"] == "und") is (not letters)


def test_training_ignores_held_out_rows(spark):
    rng = random.Random(2)
    texts, langs = corpus(rng, 120)
    rows = langid.split(frame(spark, texts, langs=langs))
    model = langid.train(rows.where("not held_out"))
    wrong = [("xx" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, lang in enumerate(langs)]
    other = langid.train(langid.split(frame(spark, texts, langs=wrong)).where("not held_out"))
    assert other.languages == model.languages == sorted(SYLLABLES)
    for t in texts[:10]:
        (a, x), (b, y) = model.predict(t), other.predict(t)
        assert a == b and math.isclose(x, y, rel_tol=1e-9)


PARTS = ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
CHANCES = [0.1, 0.2, 0.15, 0.2, 0.05, 0.2, 0.1, 1e-4]


def segmentations(word):
    """All ways to write a word in pieces and unknown characters, as numbers."""
    text = "▁" + word
    for cuts in product([False, True], repeat=len(text) - 1):
        parts, part = [], text[0]
        for c, cut in zip(text[1:], cuts, strict=True):
            if cut:
                parts.append(part)
                part = c
            else:
                part += c
        parts.append(part)
        if all(x in PARTS or len(x) == 1 for x in parts):
            yield [PARTS.index(x) if x in PARTS else len(PARTS) for x in parts]


WORDS = ["abab", "a", "b", "bb", "cab", "abcba", "aaaaaaaa", "babababab"]


def test_the_forward_sum_is_over_all_segmentations():
    model = langid.LanguageModel(["x"], langid._Prefixes(PARTS), np.array([CHANCES]).T)
    together = model.words(WORDS)[:, 0]
    for word, found in zip(WORDS, together, strict=True):
        total = sum(math.prod(CHANCES[k] for k in s) for s in segmentations(word))
        assert math.isclose(model.word(word)[0], math.log(total)) and math.isclose(found, math.log(total))


def test_expected_counts_are_over_all_segmentations():
    n = np.arange(1, len(WORDS) + 1)
    want = np.zeros(len(CHANCES))
    for word, times in zip(WORDS, n, strict=True):
        chances = [(math.prod(CHANCES[k] for k in s), s) for s in segmentations(word)]
        total = sum(c for c, _ in chances)
        for c, s in chances:
            for k in s:
                want[k] += times * c / total
    lattice = langid._Lattice(langid._Prefixes(PARTS), WORDS, len(PARTS))
    assert np.allclose(lattice.expected(np.array(CHANCES), n), want)


def exact_counts(word, chances):
    """Expected counts by sums of fractions over prefixes and suffixes."""
    text, size, p = "▁" + word, len(word) + 1, [Fraction(c) for c in chances]
    edges = []
    for j in range(size):
        found = [(j, j + n, PARTS.index(text[j : j + n])) for n in (1, 2, 3) if text[j : j + n] in PARTS and j + n <= size]
        edges += found if any(b == j + 1 for _, b, _ in found) else [*found, (j, j + 1, len(PARTS))]
    ahead, back = [Fraction(1)] + [Fraction(0)] * size, [Fraction(0)] * size + [Fraction(1)]
    for a, b, k in edges:
        ahead[b] += ahead[a] * p[k]
    for a, b, k in reversed(edges):
        back[a] += p[k] * back[b]
    out = [0.0] * len(p)
    for a, b, k in edges:
        out[k] += float(ahead[a] * p[k] * back[b] / ahead[-1])
    return np.array(out)


def test_words_of_any_length_teach():
    rng = random.Random(9)
    words = ["".join(rng.choices("abc", k=n)) for n in (1, 14, 15, 16, 17, 31, 32, 33, 64, 65, 150, 400)]
    small = [c * 1e-4 for c in CHANCES]
    lattice = langid._Lattice(langid._Prefixes(PARTS), words, len(PARTS))
    want = sum((k + 1) * exact_counts(w, small) for k, w in enumerate(words))
    assert np.allclose(lattice.expected(np.array(small), np.arange(1, len(words) + 1)), want)


def test_words_pass_together_as_they_pass_alone():
    rng = random.Random(4)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 90))) for _ in range(200)]
    model = langid.LanguageModel(["x", "y"], langid._Prefixes(PARTS), np.array([CHANCES, CHANCES[::-1]]).T)
    assert np.allclose(model.words(words), [model.word(w) for w in words])


def test_long_words_do_not_underflow():
    pieces = ["a", "b"]
    model = langid.LanguageModel(["x", "y"], langid._Prefixes(pieces), np.array([[0.01, 0.02, 1e-7], [0.02, 0.01, 1e-7]]).T)
    text = "a" * 5000
    assert model.predict(text) == ("y", 1.0)
    assert math.isclose(model.word("a" * 64)[0], 64 * math.log(0.01) + math.log(1e-7), rel_tol=1e-9)


def test_nothing_to_learn_from_and_clashing_columns(spark):
    df = frame(spark, ["some text", None])
    model = langid.train(langid.split(df).where("not held_out"))
    out = langid.predict(df, model)
    assert [r["lang_pred"] for r in out.collect()] == ["und", "und"] and out.columns == [*df.columns, "lang_pred", "score"]
    again = langid.predict(out, model)
    assert again.columns == out.columns and langid.predict(df.limit(0), model).count() == 0

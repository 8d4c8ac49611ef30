from __future__ import annotations

import random
from functools import lru_cache

from helpers import ODD, folder, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import pieceencoder
from assayer.llm.pieces import Automaton, vocabulary


@lru_cache
def codec():
    return pieceencoder.PieceCodec(vocabulary())


def best_score(text):
    """The best summed score over all segmentations, by a table over all substrings."""
    c = codec()
    score = {c.vocab.pieces[i]: c.scores[i] for i in c.vocab.normal}
    text = "▁" + text.replace(" ", "▁")
    longest = 40
    best = [0.0] + [float("-inf")] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - longest), j):
            p = text[i:j]
            s = score.get(p, c.unknown if len(p) == 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


def score_of(ids):
    c = codec()
    total, pending = 0.0, b""
    for i in ids:
        if i in c.byte_of:
            pending += bytes([c.byte_of[i]])
            try:
                pending.decode()
            except UnicodeDecodeError:
                continue
            total, pending = total + c.unknown, b""
        else:
            total += c.scores[i]
    return total


TEXT = st.text(st.sampled_from("the quick ,.\nABCéç日😀12345-_xzΩ"), max_size=60) | st.text(st.characters(exclude_categories=["Cs"]), max_size=30)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_round_trip(text):
    assert codec().decode(codec().encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("the quick brown.,;:\nABCéç日12345-_x"), min_size=1, max_size=40))
def test_segmentation_is_the_best(text):
    assert abs(score_of(codec().encode(text)) - best_score(text)) < 1e-6 * max(1, abs(best_score(text)))


def test_the_automaton_finds_all_pieces():
    rng = random.Random(3)
    pieces = {"".join(rng.choices("abc", k=rng.randrange(1, 5))) for _ in range(30)}
    numbers = {p: k for k, p in enumerate(sorted(pieces))}
    auto = Automaton(numbers)
    for _ in range(50):
        text = "".join(rng.choices("abcd", k=30))
        for j, found in enumerate(auto.matches(text), 1):
            assert sorted(found) == sorted((n, numbers[text[j - n : j]]) for n in range(1, 6) if text[max(0, j - n) : j] in numbers and n <= j)
            assert [n for n, _ in found] == sorted((n for n, _ in found), reverse=True)


def test_query(spark, tmp_path):
    texts = [*ODD, "The cat sat on the mat.", "a  b", " lead", "trail ", "x" * 70 + "é" * 70]
    df = pieceencoder.op10_piece_viterbi(spark, folder(spark, tmp_path, texts))
    rows = {r["doc_id"]: r for r in df.collect()}
    assert len(rows) == len(texts) and all(r["exact"] for r in rows.values())
    for i, t in enumerate(texts):
        assert rows[i]["ids"] == codec().encode(t) and rows[i]["n_ids"] == len(rows[i]["ids"])
    back = {r["doc_id"]: r["text"] for r in pieceencoder.decode(df).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    assert pieceencoder.encode(frame(spark, ["a"] * 3, [None, 1, 1])).count() == 3
    assert pieceencoder.encode(frame(spark, ["a"]).limit(0)).count() == 0
    assert pieceencoder.encode(frame(spark, ["a"]).withColumnRenamed("lang", "ids").withColumnRenamed("source", "exact")).columns == ["doc_id", "ids", "n_ids", "exact"]

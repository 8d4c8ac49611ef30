from __future__ import annotations

import random

import pyarrow as pa
from helpers import ODD, folder, frame, prose

from assayer.llm import substrings


def planted(seed, words=60):
    """Texts of their own with passages that several have."""
    rng = random.Random(seed)
    passages = [" ".join(f"p{k}x{j}" for j in range(words)) for k in range(6)]
    texts = []
    for _ in range(40):
        parts = [prose(rng, rng.randrange(30, 120), 10**9)]
        for p in rng.sample(range(6), rng.randrange(3)):
            parts += [passages[p], prose(rng, rng.randrange(30, 90), 10**9)]
        texts.append(" ".join(parts))
    return texts, passages


def test_planted_passages_are_cut_in_all_but_one(spark):
    texts, passages = planted(1)
    rows = {r["doc_id"]: r for r in substrings.deduplicate(frame(spark, texts)).collect()}
    for p in passages:
        have = [i for i, t in enumerate(texts) if p in t]
        assert len(have) > 2 and p in rows[have[0]]["text"]
        middle = " ".join(p.split()[15:-15])
        assert not any(middle in rows[i]["text"] for i in have[1:])
    for i, t in enumerate(texts):
        own = [w for w in t.split() if w[0] == "w"]
        # A chunk at a passage's edge is the text's own: no word of its own goes.
        assert [w for w in rows[i]["text"].split() if w[0] == "w"] == own
        removed = len(t.split()) - len(rows[i]["text"].split())
        assert rows[i]["removed_words"] == removed and (removed > 0) == bool(rows[i]["removed"])
    clean = [i for i, t in enumerate(texts) if not any(p in t for p in passages)]
    assert clean and all(rows[i]["text"] == texts[i] for i in clean)


def test_spans_say_what_went(spark, tmp_path):
    texts, _ = planted(2)
    df = substrings.op9_chunk_dedup(spark, folder(spark, tmp_path, [*texts, *ODD, *ODD]))
    rows = {r["doc_id"]: r for r in df.collect()}
    for i, t in enumerate([*texts, *ODD, *ODD]):
        spans = [tuple(map(int, s.split(":"))) for s in rows[i]["removed"].split(",") if s]
        data, at, kept = (t or "").encode(), 0, b""
        for a, b in spans:
            kept += data[at:a]
            at = b
        kept += data[at:]
        assert kept.decode() == (rows[i]["text"] or "") and (t is None) == (rows[i]["text"] is None)


def test_brute_force_over_chunks(spark):
    texts, _ = planted(3)
    chunks = [substrings.Chunks(pa.array([t])) for t in texts]
    seen, gone = set(), []
    for c in chunks:
        repeated = [d in seen for d in c.digest.tolist()]
        total, run = 0, 0
        for r, n in zip([*repeated, False], [*c.words.tolist(), 0], strict=True):
            if r:
                run += n
            else:
                total += run if run >= substrings.MIN_WORDS else 0
                run = 0
        gone.append(total)
        seen |= set(c.digest.tolist())
    rows = substrings.deduplicate(frame(spark, texts)).collect()
    assert [r["removed_words"] for r in sorted(rows, key=lambda r: r["doc_id"])] == gone and sum(gone) > 500


def test_boundaries_resist_insertions():
    rng = random.Random(7)
    words = prose(rng, 3000).split()
    moved = [*words[:10], "an", "insertion", *words[10:1500], "another", *words[1500:]]
    a, b = (substrings.Chunks(pa.array([" ".join(w)])) for w in (words, moved))
    assert len(set(a.digest.tolist()) - set(b.digest.tolist())) <= 8
    assert sum(a.words) == 3000 and 3 < 3000 / len(a.digest) < 8


def test_one_word_over_and_over(spark):
    rng = random.Random(9)
    texts = [f"{prose(rng, 40, 10**9)} {'and ' * n}{prose(rng, 40, 10**9)}" for n in (300, 200, 90)]
    rows = {r["doc_id"]: r["text"] for r in substrings.deduplicate(frame(spark, texts)).collect()}
    assert all(len(rows[k].split()) < 160 for k in range(3)) and "and" in rows[0].split()
    assert all([w for w in rows[k].split() if w != "and"] == [w for w in texts[k].split() if w != "and"] for k in range(3))
    assert max(substrings.Chunks(pa.array(texts)).words) <= substrings.MOST_WORDS


def test_copies_null_ids_and_repeated_rows(spark):
    long = " ".join(f"k{j}" for j in range(200))
    rows = substrings.deduplicate(frame(spark, [long, long, None, "", "short one", "short one"])).collect()
    out = {r["doc_id"]: r["text"] for r in rows}
    assert out == {0: long, 1: "", 2: None, 3: "", 4: "short one", 5: "short one"}
    same = substrings.deduplicate(frame(spark, [long, long], [4, 4])).collect()
    assert [r["text"] for r in same] == [long, long]
    # One id, other texts: documents of their own.
    shared = sorted(len(r["text"].split()) for r in substrings.deduplicate(frame(spark, ["first " + long, "second " + long], [4, 4])).collect())
    assert shared[0] < 30 and shared[1] == 201
    unknown = sorted(len(r["text"].split()) for r in substrings.deduplicate(frame(spark, [f"row {k} {long}" for k in range(40)], [None] * 40)).collect())
    assert unknown[-1] == 202 and unknown[-2] < 30
    nulls = sorted((r["doc_id"] is None, r["text"]) for r in substrings.deduplicate(frame(spark, [long, long, "own " + long], [None, 3, None])).collect())
    assert nulls[0] == (False, long) and nulls[1] == (True, "") and nulls[2][1].startswith("own ") and len(nulls[2][1]) < 200


def test_empty_tables_and_clashing_columns(spark):
    df = frame(spark, ["a b"]).withColumnRenamed("lang", "removed").withColumnRenamed("source", "digest")
    out = substrings.deduplicate(df)
    assert out.columns == ["doc_id", "text", "digest", "n_chars", "removed_words", "removed"] and out.count() == 1
    assert substrings.deduplicate(df.limit(0)).count() == 0


def test_chunks_of_different_documents_make_no_passage(spark):
    rng = random.Random(12)
    w = prose(rng, 60, 10**9).split()
    parts = [" ".join([prose(rng, 30, 10**9), *w[a : a + 15], prose(rng, 30, 10**9)]) for a in range(0, 46, 3)]
    texts = [*parts, " ".join(w)]
    # Each chunk of the last text is in an earlier one, but no 20 words of it together.
    seen = set(substrings.Chunks(pa.array(parts)).digest.tolist())
    last = substrings.Chunks(pa.array(texts[-1:]))
    common = [d in seen for d in last.digest.tolist()]
    assert sum(n for n, c in zip(last.words, common, strict=True) if c) > 40
    rows = substrings.deduplicate(frame(spark, texts)).collect()
    assert {r["doc_id"]: r["text"] for r in rows} == dict(enumerate(texts))


def test_brute_force_over_passages(spark):
    rng = random.Random(13)
    # So few words that most chunks are repeated by chance, and stretches of earlier texts.
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randrange(5, 90), 12)]
        for t in rng.sample(texts, min(len(texts), rng.randrange(3))):
            w = t.split()
            a = rng.randrange(len(w))
            parts += [" ".join(w[a : a + rng.randrange(1, 60)]), prose(rng, rng.randrange(5, 60), 12)]
        if rng.random() < 0.3:
            parts += [parts[0], prose(rng, 20, 12)]  # a passage that comes twice in one text
        texts.append(" ".join(parts))
    seen, want, inside = set(), [], 0
    for t in texts:
        c = substrings.Chunks(pa.array([t]))
        n, digests = c.words.tolist(), c.digest.tolist()
        own = {(a, z): tuple(digests[a:z]) for a in range(len(n)) for z in range(a + 1, len(n) + 1) if sum(n[a:z]) >= substrings.MIN_WORDS}
        gone = {k for (a, z), x in own.items() if x in seen for k in range(a, z)}
        ends = {}
        for (a, z), x in sorted(own.items()):
            ends.setdefault(x, z)
        further = {k for (a, z), x in own.items() if a >= ends[x] for k in range(a, z)}
        inside += len(further - gone)
        gone |= further
        want.append(sum(n[k] for k in gone))
        seen |= set(own.values())
    rows = substrings.deduplicate(frame(spark, texts)).collect()
    assert [r["removed_words"] for r in sorted(rows, key=lambda r: r["doc_id"])] == want and sum(want) > 500 and inside > 20


def test_a_passage_repeated_inside_one_document_stays_once(spark):
    rng = random.Random(15)
    passage, own = prose(rng, 80, 10**9), [prose(rng, 30, 10**9) for _ in range(4)]
    text = " ".join([own[0], passage, own[1], passage, own[2], passage, own[3]])
    (row,) = substrings.deduplicate(frame(spark, [text])).collect()
    middle = " ".join(passage.split()[15:-15])
    assert row["text"].count(middle) == 1 and row["text"].startswith(f"{own[0]} {passage} {own[1]}") and row["text"].endswith(own[3])

"""Small tables of documents for the tests of this folder."""

from __future__ import annotations

import random
import re

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def frame(spark, texts, ids=None, langs=None, partitions=3):
    """texts: of documents with ids 0, 1, ... or those given."""
    ids = range(len(texts)) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    rows = [(i, t, lang, f"src{k % 3}", None if t is None else len(t)) for k, (i, t, lang) in enumerate(zip(ids, texts, langs, strict=True))]
    return spark.createDataFrame(rows, DDL).repartition(partitions)


def folder(spark, tmp_path, texts, **more):
    frame(spark, texts, **more).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{min(rng.randrange(vocabulary), rng.randrange(vocabulary))}" for _ in range(n))


def edited(rng: random.Random, text: str, changes: int) -> str:
    """With so many words replaced, dropped or added."""
    w = text.split(" ")
    for _ in range(changes):
        k = rng.randrange(len(w))
        how = rng.randrange(3)
        w[k : k + (how != 2)] = [] if how == 1 else [f"e{rng.randrange(40)}"]
    return " ".join(w)


#: Texts that every operator has to bear.
ODD = [None, "", " ", "\n\t\r\x0b\x0c", "a", "A", "é", "▁x", "日本語のテキスト", "😀 😀", "½ ²", "a\x00b", "tab\tline\nline\r\nend ", "x" * 30_000, "one two three four", "one two three four five", "ONE two three four five"]

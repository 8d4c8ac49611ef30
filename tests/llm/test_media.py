from __future__ import annotations

import hashlib
import random
import zlib

import pytest
import zstandard
from helpers import ODD, folder, frame, prose

from pyspark.sql import functions as F

from assayer.llm import media
from assayer.llm.common import Workspace


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def shared_texts():
    rng = random.Random(5)
    common = prose(rng, 4000)
    return [common, "x " + common, common + prose(rng, 50), prose(rng, 3000), "a" * 575, "a" * 576, "a" * 577, "é" * 288, *ODD, common]


def test_what_is_read_back_is_what_was_stored(spark, tmp_path):
    texts = shared_texts()
    found = rows_of(media.op1_chunked_media(spark, folder(spark, tmp_path, texts)))
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["feature"] == media.describe(payload, media.chunks(payload))
    for column in ("payload_sha256", "media_sha256", "feature"):
        assert found[0][column] == found[len(texts) - 1][column]


def test_shared_chunks_are_stored_once(spark):
    packs, store = media.write_media(frame(spark, shared_texts()), Workspace(spark))
    assert store.count() == store.select("digest").distinct().count() > 10
    whole = sum(len(media.padded(t)) for t in shared_texts())
    kept = sum(len(r["chunk"]) for r in store.collect()) + sum(len(r["own"]) for r in packs.collect())
    assert kept < whole / 2


def test_chunks_resist_shifts():
    rng = random.Random(6)
    a = prose(rng, 20_000).encode()
    b = b"inserted " + a[:50_000] + b"more" + a[50_000:]
    x, y = set(media.chunks(a)), set(media.chunks(b))
    assert len(x & y) > 0.9 * len(x)
    sizes = [len(c) for c in media.chunks(a)]
    assert b"".join(media.chunks(a)) == a and max(sizes) <= media.MOST and min(sizes[:-1]) >= media.LEAST


def naive_cuts(data):
    """The ends of the chunks, byte by byte with one rolling hash."""
    ends, last, h = [], 0, 0
    bits = media.MEAN.bit_length() - 1
    for k, byte in enumerate(data, 1):
        # A byte's number leaves the counted bits by itself after WINDOW shifts.
        h = ((h << 1) + int(media.GEAR[byte])) & 0xFFFFFFFF
        wanted = (h & ((1 << media.WINDOW) - 1)) >> (media.WINDOW - bits) == 0
        if k - last == media.MOST or (wanted and k - last >= media.LEAST) or k == len(data):
            ends.append(k)
            last = k
    return ends


@pytest.mark.parametrize("seed", range(4))
def test_cuts_equal_a_naive_rolling_hash(seed):
    rng = random.Random(seed)
    for data in (prose(rng, 6000).encode(), rng.randbytes(30_000), b"a" * 20_000, rng.randbytes(3), b"\xff" * 576):
        assert media.cuts(data) == naive_cuts(data)


def test_media_columns_are_of_the_stored_bytes(spark):
    texts = shared_texts()
    packs, store = media.write_media(frame(spark, texts), Workspace(spark))
    chunks = {bytes(r["digest"]): bytes(r["chunk"]) for r in store.collect()}
    found = rows_of(media.read_media(packs, store))
    for r in packs.collect():
        stored, at = bytes(r["head"]) + bytes(r["own"]), 8
        while at < len(r["head"]):
            entry = bytes(r["head"][at : at + media.ENTRY])
            stored += chunks[entry[5:]] if entry[4] else b""
            at += media.ENTRY
        assert (found[r["doc_id"]]["media_bytes"], found[r["doc_id"]]["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_damage_is_found(spark):
    parts = media.chunks(random.Random(1).randbytes(9000))
    names, pressed = [media.digest(p) for p in parts], zstandard.ZstdCompressor().compress
    away = [k % 2 == 1 for k in range(len(parts))]
    start, own = media.head(parts, names, away), pressed(b"".join(parts[::2]))
    store = {n: pressed(p) for n, p in zip(names[1::2], parts[1::2], strict=True)}
    assert media.opened(start, own, store) == (start + own + b"".join(store.values()), parts)
    swapped = dict(zip(store, reversed(list(store.values())), strict=True))
    for bad in ((start[:-1], own, store), (b"no" + start[2:], own, store), (start, own[:-1], store), (start, pressed(b"".join(parts[::2]) + b"x"), store), (start, own, {}), (start, own, swapped)):
        with pytest.raises(ValueError):
            media.opened(*bad)
    packs, store = media.write_media(frame(spark, shared_texts()), Workspace(spark))
    for less in (store.limit(1), store.limit(0), store.withColumn("chunk", F.lit(b"x"))):
        with pytest.raises(Exception, match="missing|damaged"):
            media.read_media(packs, less).count()


def test_null_ids_repeated_rows_and_empty_tables(spark):
    work = Workspace(spark)
    df = media.read_media(*media.write_media(frame(spark, ["a b c"] * 4, [1, 1, None, None]), work))
    assert df.count() == 4 and df.select("payload_sha256").distinct().count() == 1
    assert media.read_media(*media.write_media(frame(spark, ["a"]).limit(0), Workspace(spark))).count() == 0
    clash = frame(spark, ["a", "a"]).withColumnRenamed("lang", "digest").withColumnRenamed("source", "pack")
    assert media.read_media(*media.write_media(clash, Workspace(spark))).count() == 2

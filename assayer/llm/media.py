"""Media columns: content-defined chunks of binary payloads in a deduplicated store.

A payload is cut where a gear rolling hash over its last bytes says so.  A
chunk that several payloads (or several places) have is stored once, keyed by
its digest, and found again by a Spark join; a chunk of one place only stays in
the pack of its payload, so most bytes are written once and never shuffled.

A medium's stored form is its pack (a head that lists lengths and digests of its
chunks in order, and its own chunks, compressed) and then the shared chunks of
its list, compressed, as the store has them.  Reading joins the shared chunks
back, puts the payload together from these bytes, verifies every digest and the
payload's, and only then serves the medium; media_bytes and media_sha256 are of
the bytes that were read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import Workspace, mapped, slices, table
from assayer.llm.gear import GEAR, HashFilter

#: Chunks have so many bytes on average (a power of two), and bounds.
MEAN, LEAST, MOST = 1024, 256, 4096
WINDOW = 24
UNIT = 576
PAD = b"\xff"
MAGIC = b"CHNK"
#: Bytes of a chunk in a head: length, whether it is shared, digest.
ENTRY = 4 + 1 + 16


def padded(text: str | None) -> bytes:
    """The text as UTF-8 with bytes 255 up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + PAD * (-len(data) % UNIT if data else UNIT)


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks."""
    raw = np.frombuffer(data, np.uint8)
    h = np.zeros(len(raw), np.uint32)
    gear = GEAR[raw]
    for j in range(min(WINDOW, len(raw))):
        h[j:] += gear[: len(raw) - j] << np.uint32(j)
    bits = MEAN.bit_length() - 1
    # The highest of WINDOW bits depend on all bytes in the window.
    wanted = (np.flatnonzero((h >> np.uint32(WINDOW - bits)) & np.uint32(MEAN - 1) == 0) + 1).tolist()
    ends, last = [], 0
    for end in [*wanted, len(data)]:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST or end == len(data):
            if end > last:
                ends.append(end)
            last = end
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def short(digests: list[bytes]) -> np.ndarray:
    """64 bits of each digest, for the fixed-size filter."""
    return np.frombuffer(b"".join(digests), ">i8")[::2].astype(np.int64)


def head(parts: list[bytes], names: list[bytes], away: list[bool]) -> bytes:
    """What a pack begins with: for each chunk its length, whether the store has it, and its digest."""
    return MAGIC + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I?", len(p), a) + n for p, n, a in zip(parts, names, away, strict=True))


def opened(start: bytes, own: bytes, store: dict[bytes, bytes]) -> tuple[bytes, list[bytes]]:
    """The stored bytes of a medium, from its pack's head and own chunks and from shared chunks by digest, and its chunks; ValueError if anything is missing or doesn't fit."""
    unzip = zstandard.ZstdDecompressor()
    if start[:4] != MAGIC or (len(start) - 8) % ENTRY or len(start) != 8 + ENTRY * struct.unpack_from("<I", start, 4)[0]:
        raise ValueError("not a pack")
    try:
        rest, at, parts, shared = unzip.decompress(own), 0, [], []
        for k in range(8, len(start), ENTRY):
            size, away = struct.unpack_from("<I?", start, k)
            name = start[k + 5 : k + ENTRY]
            if away:
                if name not in store:
                    raise ValueError(f"chunk {name.hex()} is missing")
                shared.append(store[name])
                part = unzip.decompress(store[name])
            else:
                part = rest[at : at + size]
                at += size
            if len(part) != size or digest(part) != name:
                raise ValueError(f"chunk {name.hex()} is damaged")
            parts.append(part)
    except zstandard.ZstdError as e:
        raise ValueError("damaged bytes") from e
    if at != len(rest):
        raise ValueError("bytes after the last chunk")
    return start + own + b"".join(shared), parts


def _digests(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [digest(c) for t in b.column(0).to_pylist() for c in chunks(padded(t))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["digest"])

    return mapped(docs.select("text"), run, "digest binary")


def _packs(docs: DataFrame, shared: HashFilter) -> DataFrame:
    """A pack for each row: the head, the chunks that surely no other place has, and which it finds in the store; `new`: chunks for the store that this task hasn't sent yet."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, sent = zstandard.ZstdCompressor(level=3), set()
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = padded(text)
                parts = chunks(data)
                names = [digest(p) for p in parts]
                away = shared.may_have(short(names)).tolist()
                wants = dict.fromkeys(n for n, a in zip(names, away, strict=True) if a)
                new = {n: p for n, p in zip(names, parts, strict=True) if n in wants and n not in sent}
                sent.update(new)
                rows.append(
                    {
                        "doc_id": doc_id,
                        "n_bytes": len((text or "").encode("utf-8", "surrogatepass")),
                        "sha256": hashlib.sha256(data).digest(),
                        "head": head(parts, names, away),
                        "own": zip_.compress(b"".join(p for p, a in zip(parts, away, strict=True) if not a)),
                        "wants": list(wants),
                        "new": [{"digest": n, "chunk": zip_.compress(p)} for n, p in new.items()],
                    }
                )
            if len(sent) > 1 << 18:
                sent.clear()  # repeats are harmless: the store takes one of each
            yield pa.RecordBatch.from_pylist(rows, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"doc_id {kind}, n_bytes bigint, sha256 binary, head binary, own binary, wants array<binary>, new array<struct<digest: binary, chunk: binary>>"
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return mapped(docs.select("doc_id", "text"), run, ddl).withColumn("pack", F.monotonically_increasing_id())


def write_media(docs: DataFrame, work: Workspace, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Stores every row's payload.  Returns the packs and the shared chunks, both written.

    Null and empty texts have a payload of padding alone; null ids and repeated
    rows have packs of their own, whose chunks are shared.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    again = work.write(_digests(docs).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "again")
    hashed = again.select(F.expr("cast(conv(hex(substring(digest, 1, 8)), 16, -10) as bigint)").alias("h"))
    packs = work.write(_packs(docs, HashFilter.of(hashed, "h")), "packs")
    store = work.write(packs.select(F.explode("new").alias("x")).select("x.*").dropDuplicates(["digest"]), "store")
    work.drop("again")
    return packs.drop("new"), store


def _assembled(rows: DataFrame, features: Callable[[bytes, list[bytes]], str]) -> DataFrame:
    """rows: packs with an array `parts` of (digest, chunk), or null, for the chunks that lie in the store."""
    kind = dict(rows.dtypes)["doc_id"]
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for row in b.to_pylist():
                medium, parts = opened(row["head"], row["own"], {p["digest"]: p["chunk"] for p in row["parts"] or () if p["chunk"] is not None})
                data = b"".join(parts)
                if hashlib.sha256(data).digest() != row["sha256"]:
                    raise ValueError(f"the medium of {row['doc_id']} is damaged")
                values = (row["doc_id"], row["n_bytes"], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(medium), hashlib.sha256(medium).hexdigest(), features(data, parts))
                out.append(dict(zip(names, values, strict=True)))
            yield pa.RecordBatch.from_pylist(out, schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return mapped(rows.select("doc_id", "n_bytes", "sha256", "head", "own", "parts"), run, ddl)


def describe(data: bytes, parts: list[bytes]) -> str:
    """Chunk count, mean sample and entropy (bits a sample)."""
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    return f"chunks={len(parts)};mean={float((counts * np.arange(256)).sum()) / len(data):.4f};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def read_media(packs: DataFrame, store: DataFrame, features: Callable[[bytes, list[bytes]], str] = describe) -> DataFrame:
    """Reads and verifies all media, of every pack.  Only packs with chunks in the store pass through joins.

    A damaged or missing chunk fails the job, also if all of a pack's are missing.
    """
    split = packs.withColumn("sharing", F.size("wants") > 0)
    alone = split.where(~F.col("sharing")).withColumn("parts", F.lit(None).cast("array<struct<digest: binary, chunk: binary>>"))
    sharing = split.where("sharing")
    named = sharing.select("pack", F.explode("wants").alias("digest"))
    parts = named.join(store, "digest", "left").groupBy("pack").agg(F.collect_list(F.struct("digest", "chunk")).alias("parts"))
    return _assembled(alone, features).union(_assembled(sharing.join(parts, "pack", "left"), features))


def op1_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(*write_media(table(spark, sf_dir, "documents"), Workspace(spark)))

"""Substring dedup by content-defined chunks.

A gear rolling hash over the bytes before each word start decides, from content
alone, where chunks end, so an insertion moves no boundary but those next to it;
where nothing ends a chunk, as in one word over and over, its length does.
A passage is a sequence of neighbouring chunks with min_words words or more.
Passages that come several times are found by the digests of the shortest such
sequences; all but the first in the document of the smallest id are taken out,
in other documents and further on in that one.  Chunks that are repeated one by
one, in different places, make no passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import Workspace, columns, mapped, slices, table
from assayer.llm.gear import SPACE, HashFilter, gear_at, payload

#: A chunk ends at a word start with this chance: so many words on average.
MEAN_WORDS = 4
WINDOW = 16
#: A chunk has so many words at most.
MOST_WORDS = 24
#: Repeated passages shorter than this stay: phrases, licence lines, names.
MIN_WORDS = 20
#: Of the polynomial in chunk digests, modulo 2^64.
_BASE = 0x9E3779B97F4A7C13
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Chunks:
    """The chunks of an array of texts: doc (row), start and end (bytes in the row's text, end after the last word's space), words, digest."""

    def __init__(self, texts: pa.Array, mean_words: int = MEAN_WORDS):
        data, begins = payload(texts)
        space = SPACE[data]
        first = np.ones(len(data), bool)
        first[1:] = space[:-1]
        first[begins[:-1][begins[:-1] < len(data)]] = True
        starts = np.flatnonzero(first & ~space)
        doc = np.searchsorted(begins, starts, side="right") - 1
        h = gear_at(data, starts, begins[doc], WINDOW) & np.uint32(0xFFFF)
        cut = h < 65536 // mean_words
        cut[1:] |= doc[1:] != doc[:-1]
        cut[:1] = True
        at = np.flatnonzero(cut)
        more = (np.diff(np.append(at, len(starts))) - 1) // MOST_WORDS
        step = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        at = np.sort(np.concatenate([at, np.repeat(at, more) + step * MOST_WORDS]))
        self.doc = doc[at]
        begin = starts[at]
        end = np.append(begin[1:], len(data))
        end = np.minimum(end, begins[self.doc + 1])
        self.words = np.diff(np.append(at, len(starts)))
        # The digest leaves out the space after the last word, which differs at a text's end.
        whole = data.tobytes()
        digest = xxhash.xxh3_64_intdigest
        self.digest = np.array([digest(whole[a:b].rstrip()) for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.uint64).view(np.int64)
        self.start, self.end = begin - begins[self.doc], end - begins[self.doc]

    def passages(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last chunk, and digest, of the sequences that reach min_words and don't without their last chunk, or without their first.

        They lie in one row.  Every chunk of a longer sequence lies in one of
        these that is part of it.
        """
        n = len(self.doc)
        total = np.concatenate([[0], np.cumsum(self.words)])
        each = np.arange(n)
        # Shortest from each chunk on, and shortest up to each chunk.
        last = np.searchsorted(total, total[:-1] + min_words) - 1
        first = np.searchsorted(total, total[1:] - min_words, side="right") - 1
        ahead = last < n
        ahead[ahead] = self.doc[last[ahead]] == self.doc[ahead]
        back = first >= 0
        back[back] = self.doc[first[back]] == self.doc[back]
        back[back] = last[first[back]] != each[back]  # the others are there already
        a, z = np.concatenate([each[ahead], first[back]]), np.concatenate([last[ahead], each[back]])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.digest.view(np.uint64) * _powers(_BASE, n), dtype=np.uint64)])
        h = (sums[z + 1] - sums[a]) * _powers(_BACK, n)[a] + (z - a).astype(np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return a, z, (h ^ (h >> np.uint64(29))).view(np.int64)


def _further(first: np.ndarray, last: np.ndarray, digest: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which sequences of a row come after its first one of the same digest, without overlapping it."""
    order = np.lexsort((first, digest, doc))
    d, h = doc[order], digest[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    start = np.flatnonzero(new)
    own = order[start][np.cumsum(new) - 1]  # each one's first
    out = np.zeros(len(order), bool)
    out[order] = first[order] > last[own]
    return out


def _occurrences(docs: DataFrame, mean_words: int, min_words: int, only: HashFilter | None = None) -> DataFrame:
    """docs(doc_id, k, text) -> (digest, doc_id, k, inner) of passages, once for each row; inner: the row has it again further on."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            c = Chunks(b.column(2), mean_words)
            first, last, digest = c.passages(min_words)
            if only is not None:
                may = only.may_have(digest)
                first, last, digest = first[may], last[may], digest[may]
            doc = c.doc[first]
            inner = _further(first, last, digest, doc)
            order = np.lexsort((~inner, digest, doc))  # of one digest's in a row, one that says there are further ones
            doc, digest, inner = doc[order], digest[order], inner[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1])
            row = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays([pa.array(digest[new]), b.column(0).take(row), b.column(1).take(row), pa.array(inner[new])], ["digest", "doc_id", "k", "inner"])

    return mapped(docs.select("doc_id", "k", "text"), run, f"digest bigint, doc_id {kind}, k bigint, inner boolean")


def repeated_passages(docs: DataFrame, work: Workspace, mean_words: int = MEAN_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """docs(doc_id, k, text) -> doc_id, k, and digests of passages: `gone`, that an earlier document has, and `inner`, that the row itself has before.

    Documents are ordered by id, null ids last, and then by k, the text's hash.
    """
    counted = _occurrences(docs, mean_words, min_words).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.col("inner").cast("int")).alias("inner"))
    again = work.write(counted.where("n > 1 or inner = 1").select("digest"), "again")
    # The filter keeps most passages that come once out of what follows; those it lets through have one owner and go no further.
    some = work.write(_occurrences(docs, mean_words, min_words, HashFilter.of(again, "digest")), "some")
    rank = F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "k")
    owners = some.groupBy("digest").agg(F.min(rank).alias("owner"))
    found = some.join(owners, "digest").select("doc_id", "k", "digest", "inner", (rank != F.col("owner")).alias("later")).where("later or inner")
    listed = lambda which: F.collect_set(F.when(which, F.col("digest")))
    return found.groupBy("doc_id", "k").agg(listed(F.col("later")).alias("gone"), listed(~F.col("later")).alias("inner"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, mean_words: int = MEAN_WORDS) -> DataFrame:
    """All columns of docs, the text without repeated passages, with removed_words and removed (array of (start, end) in bytes of the old text) at the end.

    64-bit digests do: a passage is taken for repeated by chance once in 2^64 pairs.
    A null text stays null, an empty one empty.  A passage stays where it comes
    first, in the document of the smallest id; null ids come last, and documents
    of one id go by a hash of their texts.  Rows that repeat an id and a text
    are one document and lose the same.  A text that is repeated whole becomes
    empty.  Columns named like ours are replaced.
    """
    work = Workspace(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("removed_words", "removed")]
    docs = docs.select(*rest)
    hashed = columns(docs, doc_id=doc_id, text=text).withColumn("k", F.xxhash64("text"))
    found = work.write(repeated_passages(hashed, work, mean_words, min_words), "found")
    work.drop("again", "some")
    ours = ["_assayer_id", "_assayer_k", "_assayer_gone", "_assayer_inner"]
    same = docs[doc_id].eqNullSafe(F.col(ours[0])) & (F.xxhash64(docs[text]) == F.col(ours[1]))
    joined = docs.join(found.toDF(*ours), same, "left").select(*rest, *ours[2:])
    at = rest.index(text)

    def cut(texts: pa.Array, gone: pa.Array, inner: pa.Array) -> Iterator[tuple[str, int, list[dict]]]:
        c = Chunks(texts, mean_words)
        first, last, digest = c.passages(min_words)
        order = np.argsort(first, kind="stable")
        first, last, digest = first[order], last[order], digest[order]
        further = _further(first, last, digest, c.doc[first])
        bounds = np.searchsorted(c.doc, np.arange(len(texts) + 1))
        within = np.searchsorted(first, bounds)
        for j, text_ in enumerate(texts.to_pylist()):
            own, mine = slice(bounds[j], bounds[j + 1]), slice(within[j], within[j + 1])
            goes = np.isin(digest[mine], gone[j].values.to_numpy()) | (further[mine] & np.isin(digest[mine], inner[j].values.to_numpy()))
            cover = np.zeros(bounds[j + 1] - bounds[j] + 1, np.int64)
            np.add.at(cover, first[mine][goes] - bounds[j], 1)
            np.add.at(cover, last[mine][goes] + 1 - bounds[j], -1)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]])))
            data, kept, done, n, spans = text_.encode("utf-8", "surrogatepass"), [], 0, 0, []
            for a, z in edges.reshape(-1, 2):
                begin, end = int(c.start[own][a]), int(c.end[own][z - 1])
                kept.append(data[done:begin])
                done = end
                n += int(c.words[own][a:z].sum())
                spans.append({"start": begin, "end": end})
            yield b"".join([*kept, data[done:]]).decode("utf-8", "surrogatepass"), n, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            gone, inner = b.column(len(rest)), b.column(len(rest) + 1)
            out, words, spans = b.column(at).to_pylist(), [0] * b.num_rows, [[] for _ in range(b.num_rows)]
            hit = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                rows = pa.array(hit)
                for k, (new, n, where) in zip(hit.tolist(), cut(b.column(at).take(rows), gone.take(rows), inner.take(rows)), strict=True):
                    out[k], words[k], spans[k] = new, n, where
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            new = [*b.columns[: len(rest)], pa.array(words, pa.int64()), pa.array(spans, kind)]
            new[at] = pa.array(out, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(new, [*rest, "removed_words", "removed"])

    from pyspark.sql.types import StructType

    schema = StructType([*docs.schema.fields])
    tail = docs.sparkSession.createDataFrame([], "removed_words bigint, removed array<struct<start: bigint, end: bigint>>").schema
    return mapped(joined, run, StructType([*schema.fields, *tail.fields]))


def op9_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return deduplicate(docs).select("doc_id", "removed_words", F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("removed"), "text")

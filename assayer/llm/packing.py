"""Variable-capacity best-fit packing of documents into training sequences.

Best-fit decreasing depends on lengths alone, so it runs on their histogram:
bins that hold the same lengths are one group with a count, and a step moves a
whole group.  The state is bounded by the largest capacity, whatever the number
of documents, and the result is that of the sequential algorithm over all
documents at once.  A new bin takes the size that costs least for each token
that can still fill it; in the end each bin shrinks to the smallest permitted
size that holds its contents.  Documents learn their places from their rank
among those of equal length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.common import Workspace, arrays, columns, mapped, slices, table, words

CAPACITIES = (256, 512, 1024, 2048)
#: A bin of c tokens costs BIN_COST + c + c * c / QUADRATIC: overhead, linear layers, attention.
BIN_COST = 16.0
QUADRATIC = 8192.0


def bin_cost(capacity: int) -> float:
    return BIN_COST + capacity + capacity * capacity / QUADRATIC


@dataclass
class _Bins:
    """count equal bins; items: (length, number in each bin, rank of the first)."""

    count: int
    capacity: int
    items: tuple[tuple[int, int, int], ...]


@dataclass
class Plan:
    """Runs of ranks by (length, first rank): where they go.  bins: the total number."""

    length: np.ndarray
    rank: np.ndarray
    first_bin: np.ndarray
    in_bin: np.ndarray
    offset: np.ndarray
    capacity: np.ndarray
    bins: int
    used: dict[int, int]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """bin, capacity of the bin and offset in it."""
        starts = np.searchsorted(self.length, length, side="left"), np.searchsorted(self.length, length, side="right")
        low, high = (x.copy() for x in starts)
        while (wide := high - low > 1).any():  # by halves, within the length's runs
            middle = (low + high) // 2
            right = wide & (self.rank[np.minimum(middle, len(self.rank) - 1)] <= rank)
            low = np.where(right, middle, low)
            high = np.where(wide & ~right, middle, high)
        at = rank - self.rank[low]
        return self.first_bin[low] + at // self.in_bin[low], self.capacity[low], self.offset[low] + at % self.in_bin[low] * length


def plan(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = bin_cost) -> Plan:
    """histogram: number of pieces by length; no length is above the largest capacity."""
    capacities = sorted(capacities)
    by_room: dict[int, list[_Bins]] = {}
    rooms: list[int] = []

    def keep(room: int, bins: _Bins) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(bins)

    smaller = sum(n * length for length, n in histogram.items())
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        smaller -= left * length
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):

                def per_token(c: int) -> tuple[float, int]:
                    held = min(c // length, left) * length  # noqa: B023
                    return (cost(c) / min(c, held + smaller), c)  # noqa: B023

                c = min((c for c in capacities if c >= length), key=per_token)
                keep(c, _Bins(max(1, left // (c // length)), c, ()))
                continue
            room = rooms[k]
            bins = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
            fits = room // length
            full = min(bins.count, left // fits)
            number, each = (full, fits) if full else (1, left)
            keep(room - each * length, _Bins(number, bins.capacity, (*bins.items, (length, each, rank))))
            if bins.count > number:
                rest = tuple((a, b, r + number * b) for a, b, r in bins.items)
                keep(room, _Bins(bins.count - number, bins.capacity, rest))
            rank += number * each
            left -= number * each
    rows, total, used = [], 0, {}
    for room in rooms:
        for bins in by_room[room]:
            content = bins.capacity - room
            if not content:
                continue  # opened, but earlier bins took everything
            final = capacities[bisect_left(capacities, content)]
            used[final] = used.get(final, 0) + bins.count
            offset = 0
            for length, each, rank in bins.items:
                rows.append((length, rank, total, each, offset, final))
                offset += length * each
            total += bins.count
    cols = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6).T
    return Plan(*cols, bins=total, used=used)


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, cost: Callable[[int], float] = bin_cost, doc_id: str = "doc_id", length=None, salts: int = 64) -> DataFrame:
    """Packs every document.  length: a Column of its tokens (default: the words of `text` and an end).

    Documents longer than the largest capacity become several pieces.  Returns
    doc_id, piece, start (first token of the piece in its document), n_tokens,
    bin, capacity and offset (place in the bin).  A document without tokens has
    no piece; by default a null or empty text has its end alone.  Null ids and
    repeated rows are packed like others; an empty table gives an empty result.
    Ranks are counted in `salts` buckets of a length, so one very common length
    is many tasks' work; a histogram row for each bucket and length comes to the
    driver, at most salts times the largest capacity.
    """
    most = max(capacities)
    spark = docs.sparkSession
    tokens = F.size(words(F.col("text"))) + 1 if length is None else length
    lengths = docs.select(F.col(doc_id).alias("doc_id"), tokens.cast("long").alias("n"))
    lengths = lengths.where(F.col("n") > 0)
    last = ((F.col("n") - 1) / most).cast("int")
    pieces = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0), last))).select(
        "doc_id", "piece", (F.col("piece").cast("long") * most).alias("start"), F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece").cast("long") * most).cast("int").alias("n_tokens")
    )
    work = Workspace(spark)
    pieces = work.write(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")), "pieces")
    tokens, salt, n = arrays(pieces.groupBy("n_tokens", "salt").agg(F.count("*").alias("n")), "n_tokens", "salt", "n")
    counts = np.zeros((most + 1, salts), np.int64)
    counts[tokens, salt] = n
    before = np.cumsum(counts, axis=1) - counts
    sums = counts.sum(axis=1)
    found = plan({int(n): int(sums[n]) for n in np.flatnonzero(sums)}, capacities, cost)
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, salt, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n_tokens", "salt", "rank"))
            number, capacity, offset = found.place(n, before[n, salt] + rank - 1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(number), pa.array(capacity, pa.int64()).cast(pa.int32()), pa.array(offset, pa.int64()).cast(pa.int32())],
                ["doc_id", "piece", "start", "n_tokens", "bin", "capacity", "offset"],
            )

    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "piece")))
    return mapped(ranked.select("doc_id", "piece", "start", "n_tokens", "salt", "rank"), run, f"doc_id {kind}, piece int, start bigint, n_tokens int, bin bigint, capacity int, offset int")


def op2_variable_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))

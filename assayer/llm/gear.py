"""Gear rolling hashes over Arrow strings, and filters of a fixed size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import arrays

#: One number a byte value, from a fixed seed.
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def payload(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each begins (one more entry: the end).  Null is empty."""
    array = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    ends = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[int(ends[0]) : int(ends[-1])]
    return data, ends - ends[0]


def gear_at(data: np.ndarray, places: np.ndarray, begins: np.ndarray, window: int) -> np.ndarray:
    """At each place, the gear hash of up to `window` bytes before it, from `begins` on: sum of GEAR[byte] << distance."""
    h = np.zeros(len(places), np.uint32)
    for j in range(window):
        at = places - 1 - j
        inside = at >= begins
        h += np.where(inside, GEAR[data[np.where(inside, at, 0)]], np.uint32(0)) << np.uint32(j)
    return h


class HashFilter:
    """Tells which 64-bit hashes are surely not in a set.  Its size is fixed; a fuller one lets more others through."""

    BITS = 1 << 25

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, df: DataFrame, h: str) -> HashFilter:
        """Of a column of 64-bit hashes.  At most BITS / 64 rows come to the driver."""
        place = lambda s: F.shiftrightunsigned(F.col(h), s).bitwiseAND(F.lit(cls.BITS - 1))
        both: Column = F.explode(F.array(place(0), place(32)))
        rows = df.select(both.alias("p")).groupBy((F.shiftright("p", 6)).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
        place, bits = arrays(rows, "w", "b")
        words = np.zeros(cls.BITS >> 6, np.int64)
        words[place] = bits
        return cls(words.view(np.uint64))

    def may_have(self, h: np.ndarray) -> np.ndarray:
        h = h.view(np.uint64)
        found = np.ones(len(h), bool)
        for s in (0, 32):
            p = (h >> np.uint64(s)) & np.uint64(self.BITS - 1)
            found &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found

"""Minimax contiguous sharding over atomic groups, in DataFrame functions only.

Documents with equal texts form an atomic group.  Groups are ordered by the
64-bit hash of their text, and the ordered sequence is cut into contiguous
shards whose largest holds as few bytes as any such partition can.

The search needs no list of all groups.  Hash ranges (65,536 at first) carry
their summed size and their largest group.  Two greedy fillings over them bound
everything: one may cut a range of several groups at any byte, the other not at
all.  The least capacities with which they end lie below and above the wanted
one, and the places of their cuts below and above its cuts.  Only ranges between
such places are refined, the widest first, to 64 parts each, until all of them
are single groups and the bounds meet.  Bounds are no further apart than a few
times the widest of those ranges, so the ranges refined in a pass, and what
reaches the driver, have a bound that doesn't grow with the data.

The least capacity leaves room for many partitions if one group is large.  Among
them cuts are moved so that the other shards share the rest evenly; no shard
exceeds the capacity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.common import Workspace, columns, table

#: Bits of the hash that tell ranges apart at first, and how many more in each pass.
FIRST_BITS, MORE_BITS = 16, 6
#: Of the ranges between bounds, those of this share of the widest one or more are refined in a pass.
WIDE = 1 / 16
#: Rows numbered by one task.
SLOT_ROWS = 1 << 20


class _Atoms:
    """Ordered hash ranges: first hash, bits that tell it apart, size, largest group, number of groups."""

    def __init__(self, rows: np.ndarray):
        self.first, self.bits, self.size, self.largest, self.groups = rows[np.argsort(rows[:, 0], kind="stable")].T
        self.ends = np.cumsum(self.size)
        self.begins = self.ends - self.size
        self.open = (self.groups > 1) & (self.bits < 64)

    def rows(self, keep: np.ndarray) -> np.ndarray:
        return np.stack([x[keep] for x in (self.first, self.bits, self.size, self.largest, self.groups)], axis=1)

    def whole(self, capacity: int, shards: int, at: int = 0) -> list[int]:
        """Filling with ranges that can't be cut, from range `at` on: how many ranges lie before the end of each shard."""
        cuts = []
        for _ in range(shards):
            begun = int(self.ends[at - 1]) if at else 0
            at = max(at, int(np.searchsorted(self.ends, begun + capacity, side="right")))
            cuts.append(at)
        return cuts

    def loose(self, capacity: int, shards: int) -> list[int]:
        """Filling with open ranges that may be cut at any byte: the bytes before the end of each shard."""
        cuts, begun = [], 0
        for _ in range(shards):
            to = begun + capacity
            k = int(np.searchsorted(self.ends, to, side="right"))
            begun = int(self.ends[-1]) if k == len(self.ends) else to if self.open[k] else max(begun, int(self.begins[k]))
            cuts.append(begun)
        return cuts

    def least(self, shards: int) -> tuple[int, int]:
        """The least capacities with which loose() and whole() place everything."""
        total = int(self.ends[-1])
        low = max(-(-total // shards), int(self.largest.max()))
        loose = _smallest(low, total, lambda c: self.loose(c, shards)[-1] == total)
        return loose, _smallest(loose, total, lambda c: self.whole(c, shards)[-1] == len(self.ends))


def _smallest(low: int, high: int, fits) -> int:
    """The smallest number from low to high that fits; all larger ones do, too."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def least_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity with which greedy filling places all groups."""
    if not len(sizes):
        return 0
    ones = np.ones(len(sizes), np.int64)
    return _Atoms(np.stack([np.arange(len(sizes)), 64 * ones, sizes, sizes, ones], axis=1)).least(shards)[1]


def _ranges(groups: DataFrame, bits: int) -> np.ndarray:
    """The ranges of hashes with the same first bits, as rows of _Atoms."""
    shift = 64 - bits
    first = F.shiftleft(F.shiftright("h", shift), shift) if shift else F.col("h")
    found = groups.groupBy(first.alias("first")).agg(F.sum("size").alias("size"), F.max("size").alias("largest"), F.count("*").alias("groups"))
    return np.array([(r["first"], bits, r["size"], r["largest"], r["groups"]) for r in found.collect()], np.int64).reshape(-1, 5)


def _refined(groups: DataFrame, atoms: _Atoms, wanted: np.ndarray) -> _Atoms:
    """The atoms with the wanted ranges in parts."""
    parts = [atoms.rows(~wanted)]
    for bits in np.unique(atoms.bits[wanted]).tolist():
        shift = 64 - bits
        prefixes = (atoms.first[wanted & (atoms.bits == bits)] >> shift).tolist()
        inside = groups.where(f"shiftright(h, {shift}) in ({','.join(map(str, prefixes))})")  # a hash set, not a chain of terms
        parts.append(_ranges(inside, min(64, bits + MORE_BITS)))
    return _Atoms(np.concatenate(parts))


def _undecided(atoms: _Atoms, shards: int, loose: int, whole: int) -> np.ndarray:
    """The open ranges in which cuts may fall if the least capacity is `loose`, and those up to `whole` if it is little more.

    A range is left out behind a cut that may lie before or after a very large
    group: what comes before decides that first.
    """
    found = np.zeros(len(atoms.size), bool)
    low, high, further = atoms.whole(loose, shards)[:-1], atoms.loose(loose, shards)[:-1], atoms.loose(whole, shards)[:-1]
    step = (int(atoms.ends[-1]) >> FIRST_BITS) + 1
    for k, (cut, to, beyond) in enumerate(zip(low, high, further, strict=True), 1):
        begun = int(atoms.ends[cut - 1]) if cut else 0
        if to - begun > 8 * k * step and found.any():
            break
        last = beyond if beyond - begun <= 8 * k * (step + whole - loose) else to
        part = slice(cut, int(np.searchsorted(atoms.begins, last, side="left")))
        found[part] = atoms.open[part]
        step = max(step, int(atoms.size[part][atoms.open[part]].max(initial=0)))
    return found


def plan_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """groups(h, size): one row a group.  Returns the least capacity and the first hash of each shard but the first."""
    atoms = _Atoms(_ranges(groups, FIRST_BITS))
    if not len(atoms.size):
        return 0, []
    while True:
        # Ranges with a very large group come first: they would set all bounds wide apart, and spreading wants them alone.
        need = atoms.open & (atoms.size > int(atoms.ends[-1]) // (64 * shards))
        if not need.any():
            loose, whole = atoms.least(shards)
            need = _undecided(atoms, shards, loose, whole)
        if not need.any():
            return whole, [int(atoms.first[c]) for c in spread_cuts(atoms, shards, whole)]
        need &= atoms.size >= atoms.size[need].max() * WIDE
        atoms = _refined(groups, atoms, need)


def spread_cuts(atoms: _Atoms, shards: int, capacity: int) -> list[int]:
    """Cuts between ranges (their numbers) with which no shard exceeds the capacity and the loads are near equal.

    Groups larger than an equal share stand alone where they can; each stretch
    between them gets its number of shards, of equal shares.
    """
    n, total, cuts, at = len(atoms.size), int(atoms.ends[-1]), [], 0
    for left in range(shards, 1, -1):
        if at >= n:
            break
        begun = int(atoms.begins[at])
        sizes = np.sort(atoms.size[at:])[::-1][:left]
        rest, alone = total - begun, 0
        while alone < left - 1 and alone < len(sizes) and sizes[alone] * (left - alone) > rest:
            rest -= int(sizes[alone])
            alone += 1
        share = max(1.0, rest / (left - alone))
        giants = np.flatnonzero(atoms.size[at:] > share) + at if alone else np.zeros(0, np.int64)
        if len(giants) and giants[0] == at:
            cut = at + 1
        else:
            end = int(atoms.begins[giants[0]]) if len(giants) else total
            later = len(giants) + int((np.diff(np.append(giants, n)) > 1).sum())  # each of these and of the stretches behind them wants a shard
            mine = max(1, min(round((end - begun) / share), left - later)) if len(giants) else left
            goal = begun + (end - begun) / mine
            cut = int(np.searchsorted(atoms.ends, goal, side="left"))
            # The nearer of the two ends around the goal, and one range at least.
            cut += bool(cut < n and abs(atoms.ends[cut] - goal) <= abs(goal - atoms.begins[cut]))
            cut = max(cut, at + 1)
        most = atoms.whole(capacity, 1, at)[0]
        cut = _smallest(min(cut, most), most, lambda c, left=left: atoms.whole(capacity, left - 1, c)[-1] == n)
        if cut >= n:
            break
        cuts.append(cut)
        at = cut
    return cuts


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Puts every row into one of the shards, by the law `bytes`.

    Returns doc_id, size (UTF-8 bytes of the text and 1), text_crc32 (null for a
    null text), law, shard, slot (gapless from 0 in a shard) and grown_shard
    (null).  A null text has size 1 and forms one group with other null texts; a
    null id is kept.  Repeated rows are rows.  A very long text is a group like
    others: if it exceeds an equal share, it has a shard for itself where it can.
    An empty table gives an empty result.  Slots follow buckets of the id, one
    for each slot_rows rows and 64 more, so a group of copies with a third of
    all rows is numbered by many tasks.
    """
    work = Workspace(docs.sparkSession)
    rows = columns(docs, doc_id=doc_id, text=text).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("h"),
    )
    rows = work.write(rows, "rows")
    groups = work.write(rows.groupBy("h").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "groups")
    _, cuts = plan_cuts(groups, shards)
    salts = 64 + (groups.agg(F.sum("n").alias("n")).first()["n"] or 0) // slot_rows
    number = F.lit(0)
    for cut in cuts:
        number = number + (F.col("h") >= F.lit(cut)).cast("int")
    dealt = rows.withColumn("shard", number).withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(salts)).cast("int"))
    counts = dealt.groupBy("shard", "salt").agg(F.count("*").alias("n"))  # shards x salts rows at most
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("h", "doc_id"))
    return (
        dealt.withColumn("place", place)
        .join(offsets, ["shard", "salt"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("offset") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))

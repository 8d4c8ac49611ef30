"""MinHash near-duplicate detection with sequential Bayesian verification.

Documents become sets of 5-word shingles.  Equal sets are one node.  Nodes whose
signatures agree in a whole band are candidates.  Candidates are compared batch
by batch of their signatures: after each batch the posterior chance that the
similarity reaches the threshold is looked up, and a pair is dropped once it
falls below the chosen miss probability.  Survivors are verified on full sets.

A bucket's members are compared with one of them, the pivot: that which meets
most others in all its buckets, as the source of a group of copies does.  So a
group costs its size, not its square.  Nodes of buckets in which several
components remain are open, and get an exact second search, by prefixes: with
shingles ordered from rare to common, two sets can only reach the threshold if
they share one among the first few of each.  A copy with many edits has new
shingles there, which nobody shares, and is done; others meet the few that have
the same edits.  No link between components is lost, however large a group is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.common import Workspace, columns, mapped, slices, sorted_join, table
from assayer.llm.components import components
from assayer.llm.gear import HashFilter

SHINGLE = 5
#: intersection * 100 >= union * THRESHOLD: the contract of op8.
THRESHOLD = 85
ROWS = 5
#: Two documents at the threshold meet in no band with this chance at most.
UNMET = 8e-7
BATCH = 24
#: Entries of one shingle that one task compares, on either side.
BLOCK = 256
#: Tasks that share a component's nodes.
SPREAD = 16
#: A candidate is dropped when its similarity reaches the threshold with less than this chance.
MISS = 1e-6


def bands_for(threshold: int) -> int:
    """The fewest bands in which documents at the threshold (in hundredths) miss each other with UNMET at most."""
    return ceil(log(UNMET) / log(1 - (threshold / 100) ** ROWS))


BANDS = bands_for(THRESHOLD)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles; empty for null and for no words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat = lists.flatten()
    parents = pc.list_parent_indices(lists).to_numpy()
    used = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    parents = parents[used]
    coded = flat.filter(pa.array(used)).dictionary_encode()
    words = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    w = words[coded.indices.to_numpy()] if len(words) else words
    bounds = np.searchsorted(parents, np.arange(len(texts) + 1))
    whole = np.zeros(max(0, len(w) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        whole = whole * _STEP + w[k : len(w) - SHINGLE + 1 + k]
    whole = _mix(whole)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(whole[a : b - SHINGLE + 1]))
        elif b > a:
            h = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in w[a:b]:
                    h = h * _STEP + x
            out.append(_mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache
def _hashes(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1201)
    a = (rng.integers(1, 1 << 63, bands * ROWS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    return a, rng.integers(0, 1 << 63, bands * ROWS, dtype=np.uint64)


def node_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signature(shingles: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """32-bit minima under bands * ROWS hashes."""
    times, plus = _hashes(bands)
    out = np.full(bands * ROWS, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(shingles), 2048):
        out = np.minimum(out, ((shingles[a : a + 2048, None] * times + plus) >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32)


def band_keys(sig: np.ndarray) -> list[int]:
    """One 64-bit key for each band; the band's number is part of it."""
    rows = sig.reshape(-1, ROWS)
    h = np.arange(1, len(rows) + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = _mix(h * _STEP + rows[:, k])
    return h.view(np.int64).tolist()


@lru_cache
def least_matches(batch: int = BATCH, most: int = BANDS * ROWS, threshold: float = THRESHOLD / 100, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the fewest equal minima with which P(similarity >= threshold | matches) is still `miss` or more.

    Under a flat prior the posterior after m of n matches is Beta(m + 1, n - m + 1);
    its tail above the threshold is a sum of binomials.
    """
    out = []
    for n in [*range(batch, most, batch), most]:
        tail = lambda m, n=n: sum(comb(n + 1, i) * threshold**i * (1 - threshold) ** (n + 1 - i) for i in range(m + 1))
        out.append(next(m for m in range(n + 1) if tail(m) >= miss))
    return tuple(out)


def _features(docs: DataFrame, bands: int) -> DataFrame:
    """docs(doc_id, text, ...) with n_shingles, node and sig in place of the text."""
    rest = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column(0))
            sigs = [signature(s, bands) if len(s) else None for s in sets]
            found = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([None if s is None else s.tobytes() for s in sigs], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *found], [*rest, "n_shingles", "node", "sig"])

    kinds = dict(docs.dtypes)
    return mapped(docs.select("text", *rest), run, ", ".join(f"{c} {kinds[c]}" for c in rest) + ", n_shingles bigint, node binary, sig binary")


def _keys(nodes: DataFrame, bands: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = [k for s in b.column(1).to_pylist() for k in band_keys(np.frombuffer(s, np.uint32))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), bands)))], ["key", "node"])

    return mapped(nodes.select("node", "sig"), run, "key bigint, node binary")


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """node and shingles of the nodes of members(node).

    A filter of a fixed size keeps most other texts' sets out of the shuffle;
    the join decides.  A task sends a set once, however many copies it meets.
    """
    wanted = HashFilter.of(members.select(F.expr("cast(conv(hex(substring(node, 1, 8)), 16, -10) as bigint)").alias("h")), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for b in slices(batches, 2 << 20):
            sets = [x for x in shingle_sets(b.column(0)) if len(x)]
            named = list(zip([node_of(x) for x in sets], sets, strict=True))
            may = wanted.may_have(np.frombuffer(b"".join(n for n, _ in named), ">i8")[::2].astype(np.int64)).tolist()
            found = {n: x for (n, x), m in zip(named, may, strict=True) if m and n not in sent}
            if len(sent) > 1 << 18:
                sent.clear()  # repeats are harmless: the next step takes one of each
            sent.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([x.view(np.int64) for x in found.values()], pa.list_(pa.int64()))], ["node", "shingles"])

    return mapped(docs.select("text"), run, "node binary, shingles array<bigint>").join(sorted_join(members), "node", "left_semi").dropDuplicates(["node"])


def _likely(pairs: DataFrame, nodes: DataFrame, threshold: int) -> DataFrame:
    """pairs(a, b) that the signatures and the sizes don't rule out."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("n_shingles").alias(f"n_{s}"))
    sized = pairs.join(sorted_join(side("a")), "a").join(sorted_join(side("b")), "b").where(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = bands_for(threshold) * ROWS
        least = least_matches(most=width, threshold=threshold / 100)
        for b in slices(batches):
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint32).reshape(-1, width) for k in (2, 3))
            at, equal = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64)
            for k, m in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                equal = equal + (x[at, part] == y[at, part]).sum(axis=1)
                keep = equal >= m
                at, equal = at[keep], equal[keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at))], ["a", "b"])

    return mapped(sized.select("a", "b", "sig_a", "sig_b"), run, "a binary, b binary")


def _links(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"s_{s}"))
    both = _likely(pairs, nodes, threshold).join(sorted_join(side("a")), "a").join(sorted_join(side("b")), "b")
    common = F.size(F.array_intersect("s_a", "s_b"))
    union = F.size("s_a") + F.size("s_b") - common
    return both.where(100 * common >= threshold * union).select("a", "b")


def _stars(buckets: DataFrame, work: Workspace) -> DataFrame:
    """buckets(key, n, node) -> pairs (a, b): each bucket's pivot and every other member."""
    degrees = buckets.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = buckets.select("key", "node").join(sorted_join(degrees), "node")
    pivots = work.write(ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("top")).select("key", F.col("top.node").alias("a")), "pivots")
    return buckets.select("key", F.col("node").alias("b")).join(sorted_join(pivots), "key").where("a <> b").select("a", "b").distinct()


def _across(buckets: DataFrame, labels: DataFrame, sets: DataFrame, work: Workspace, threshold: int) -> DataFrame:
    """Pairs (a, b) of different components that lie in open buckets and may reach the threshold.

    A node's entries are its rarest shingles, with their places in its order.
    Shingles that no other open node has count as places but need no entry.
    Entries of a shingle's largest component meet only those of others.
    """
    named = buckets.select("key", "node").join(sorted_join(labels), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    named = work.write(named, "named")
    several = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_ = named.join(sorted_join(several), "key").select("node", "component").distinct()
    held = work.write(sets.join(sorted_join(open_), "node"), "open")
    each = held.select("node", F.explode("shingles").alias("token"))
    frequency = work.write(each.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "frequency")
    ordered = each.join(sorted_join(frequency), "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("order"))
    size, alone = F.size("shingles"), F.col("size") - F.size("order")
    rows = held.select("node", "component", size.alias("size")).join(sorted_join(ordered), "node").select("node", "component", "size", "order", alone.alias("alone"))
    first = F.col("size") - F.ceil(F.col("size") * threshold / 100).cast("int") + 1 - F.col("alone")
    rare = F.slice("order", F.lit(1), F.greatest(first, F.lit(0)))
    entries = rows.select("node", "component", "size", "alone", F.posexplode(rare).alias("at", "x")).select(F.col("x.token").alias("token"), "node", "component", "size", (F.col("alone") + F.col("at")).alias("place"))
    entries = work.write(entries, "entries")
    counts = entries.groupBy("token", "component").agg(F.count("*").alias("n"))
    found = counts.groupBy("token").agg(F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("m")).where("parts > 1")
    # A common shingle's row is sent to SPREAD tasks.  Its entries are dealt into blocks, and every block of the one side meets every block of the other in a task of its own.
    sizes = found.select("token", F.col("top.component").alias("largest"), ((F.col("m") - F.col("top.n") - 1) / BLOCK).cast("int").alias("last_x"), ((F.col("m") - 1) / BLOCK).cast("int").alias("last_y"))
    sizes = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    blocked = entries.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int")).join(sorted_join(sizes), ["token", "salt"])
    own = lambda last: F.pmod(F.xxhash64("node"), F.col(last) + 1).cast("int")
    sent = ["token", "node", "component", "size", "place"]
    x = blocked.where(F.col("component") != F.col("largest")).select(*sent, own("last_x").alias("bx"), F.explode(F.sequence(F.lit(0), "last_y")).alias("by")).alias("x")
    y = blocked.select(*sent, own("last_y").alias("by"), F.explode(F.sequence(F.lit(0), "last_x")).alias("bx")).alias("y")
    common = F.ceil((F.col("x.size") + F.col("y.size")) * threshold / (100 + threshold))
    fits = (F.col("x.place") + common <= F.col("x.size")) & (F.col("y.place") + common <= F.col("y.size"))
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.bx") == F.col("y.bx")) & (F.col("x.by") == F.col("y.by"))
    met = x.join(sorted_join(y), same & (F.col("x.component") != F.col("y.component")) & fits)
    return work.write(met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "across")


def _linked(docs: DataFrame, work: Workspace, threshold: int) -> tuple[DataFrame, DataFrame]:
    """docs(doc_id, text, ...) -> features, of every row, and (node, first, component, linked) of every node; first is its smallest id."""
    bands = bands_for(threshold)
    features = work.write(_features(docs, bands), "features")
    nodes = work.write(features.where("node is not null").select("node", "n_shingles", "sig").dropDuplicates(["node"]), "nodes")
    keyed = _keys(nodes, bands)
    shared = work.write(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    buckets = work.write(keyed.join(sorted_join(shared), "key"), "buckets")
    members = work.write(buckets.select("node").distinct(), "members")
    sets = work.write(_sets(docs, members), "sets")
    links = work.write(_links(_stars(buckets, work), nodes, sets, threshold), "links")
    labels = components(links, work, "first")
    more = work.write(_links(_across(buckets, labels, sets, work, threshold), nodes, sets, threshold), "more")
    work.drop("nodes", "shared", "buckets", "members", "sets", "pivots", "named", "open", "frequency", "entries", "across")
    labels = components(links.union(more), work, "labels")
    least = features.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    return features, least.join(sorted_join(labels), "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"), F.col("component").isNotNull().alias("linked"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row for each row of docs.

    Texts are linked from a similarity of threshold hundredths on; the bands, the
    posterior test and the prefixes follow from it.
    A null, empty or blank text has no shingles and is linked with nothing: its
    component is its own id.  A null id counts as none when a component's
    smallest id is sought; a component of null ids alone has a null
    component_id.  kept: the id is the component's (null ids: likewise), so
    repeated rows of one id in a component are kept or dropped together;
    distinct_documents() goes by rows.  An empty table gives an empty result.
    """
    work = Workspace(docs.sparkSession)
    features, named = _linked(columns(docs, doc_id=doc_id, text=text), work, threshold)
    named = work.write(named, "components")
    lowest = named.where("linked").groupBy("component").agg(F.min("first").alias("component_id"))
    # A component may hold a third of all nodes: its row is sent to SPREAD tasks, which share its nodes.
    lowest = lowest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    linked = named.where("linked").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SPREAD)).cast("int")).join(sorted_join(lowest), ["component", "salt"])
    result = work.write(linked.select("node", "component_id").union(named.where("not linked").select("node", "first")), "result")
    own = features.join(sorted_join(result), "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return own.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row stays, that of the smallest id.

    Ties of ids are broken by the text's hash and then by the other columns, so
    of rows that repeat an id, or an id and a text, one stays, too, and rows
    that share an id with a duplicate but not its text are no duplicates.  Null
    ids come last.  Rows whose text is null, empty or blank all stay.
    """
    work = Workspace(docs.sparkSession)
    hashed = columns(docs, doc_id=doc_id, text=text).select("doc_id", "text", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    features, named = _linked(hashed, work, threshold)
    rank = F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "h", "g").alias("rank")
    rows = features.where("node is not null").groupBy("node", "doc_id", "h", "g").agg(F.count("*").alias("n"))
    rows = work.write(rows.join(sorted_join(named.select("node", "component")), "node").select("component", rank, "n"), "rows")
    first = rows.groupBy("component").agg(F.min("rank").alias("first"))
    # Joined by row, not by component, which may hold a third of all rows.
    same = F.col("first.doc_id").eqNullSafe(F.col("rank.doc_id")) & (F.col("first.h") == F.col("rank.h")) & (F.col("first.g") == F.col("rank.g"))
    judged = rows.join(sorted_join(first.select("first")), same, "left").select("rank.*", "n", F.col("first").isNotNull().alias("stays"))
    keys = F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"), F.col("g").alias("_g")
    gone = work.write(judged.where(~F.col("stays")).select(*keys), "gone")
    again = work.write(judged.where(F.col("stays") & (F.col("n") > 1)).select(*keys), "again")
    is_row = lambda t: (F.col("_own_h") == t["_h"]) & (F.col("_own_g") == t["_g"]) & docs[doc_id].eqNullSafe(t["_doc_id"])
    named_rows = docs.withColumn("_own_h", F.xxhash64(docs[text])).withColumn("_own_g", F.xxhash64(F.lit(1), docs[text]))
    left = named_rows.join(sorted_join(gone), is_row(gone), "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    one = left.join(sorted_join(again), is_row(again), "left_semi")
    place = F.row_number().over(Window.partitionBy("_own_h", "_own_g", doc_id).orderBy(F.to_json(F.struct(*docs.columns))))
    one = one.withColumn("_place", place).where("_place = 1")
    return left.join(sorted_join(again), is_row(again), "left_anti").select(*docs.columns).union(one.select(*docs.columns))


def op8_bayes_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, and the closure of their links: for small tables.
OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS start, a AS node FROM e UNION SELECT start, b FROM r JOIN e ON a = node),
c AS (SELECT start, min(node) AS least FROM r GROUP BY start)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id, coalesce(least, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON start = doc_id
"""

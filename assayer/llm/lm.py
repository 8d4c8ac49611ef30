"""Language-model scoring: a unigram base and a causal self-attention model on subword ids.

The texts are read once and coded: a row for a few megabytes of documents, with
its distinct words (as 64-bit hashes), their subword ids and the documents as
numbers of words.  Everything else works on the coded rows.

The network draws the next subword in two steps.  Its class (the most frequent
ids are classes of their own, the others share classes of equal mass) comes from
a prior of class pairs to which a small causal self-attention network adds its
logits; the id within the class has its corpus frequency.  Counts of id pairs
over all training text, discounted, take a share before that: what the discounts
leave goes to the network.  So it is a distribution over all ids and an end.
The network is trained in numpy on all training documents, in one pass: each
teaches in the round and the group that a hash of its id and text gives it.  In
a round every group starts from the same parameters and goes through its
documents in the order of that hash, window after window; Spark averages the
groups' parameters.  So training doesn't depend on how rows lie in files.

Texts are scored in overlapping windows: a window's first places only give
context, so each subword is scored once, under a batched causal mask.  A token's
probability is that of its subwords in their context, whether training text has
the word or not; the unigram base is a score of its own beside it.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import attention
from assayer.llm.common import TOKENIZERS, Workspace, arrays, columns, id_fold, mapped, row_by_row, slices, table
from assayer.llm.gear import HashFilter

RANKS = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: Splits letters, digits and other marks, each with a space before it.
PATTERN = r""" ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+"""
FOLDS, HELD_OUT = 7, 2
END_WORD = "\n"
#: Text coded in one row.
CODED_BYTES = 4 << 20
CLASSES, SINGLE = 48, 32
#: Ids with embeddings of their own; others share by a hash.
OWN_INPUTS, SHARED_INPUTS = 960, 64
WINDOW, STRIDE = 32, 24
ROUNDS, LEARNING, BATCH = 3, 5e-3, 128
#: Training subwords of a group, on average: groups grow in number with the text.
GROUP = 1 << 20
#: Windows scored at once.
AT_ONCE = 64
#: Subwords scored at once, so that what is known of each stays in the processor's memory (a longer document is a portion of its own).
PORTION = 1 << 16
#: Tasks get so many of the most frequent id pairs at most, others are joined; and what is taken off the counts of all.
PAIRS, DISCOUNT = 1 << 20, 0.75
#: Tasks get the counts of so many of the most frequent words at most; those of other words are joined.
WORDS = 1 << 20
LEAST = 1e-37
_LIVE: dict[int, object] = {}


def narrow(n: int) -> type:
    """The unsigned type of numbers below n."""
    return np.uint16 if n <= 1 << 16 else np.uint32


@dataclass
class Subwords:
    ranks: dict[bytes, int]

    @classmethod
    def load(cls, path: str = RANKS) -> Subwords:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    @property
    def end(self) -> int:
        return len(self.ranks)

    def _encoding(self):
        """The encoding and the bytes of each id, one a worker process."""
        key = hash((len(self.ranks), b"".join(list(self.ranks)[-50:])))
        if key not in _LIVE:
            import tiktoken

            sizes = np.zeros(len(self.ranks), np.int64)
            for piece, rank in self.ranks.items():
                sizes[rank] = len(piece)
            # Without a special token tiktoken looks for the empty string, at each place; this one has white space, as no word does, and isn't allowed either.
            _LIVE[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={"\n<none>\n": self.end}), sizes
        return _LIVE[key]

    def encode(self, words: list[str], lengths: np.ndarray | None = None, joined: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each with a space before it, and how many each word has.  lengths: the words' bytes.  joined: the words with a space between them."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        encoding, sizes = self._encoding()
        ids = encoding.encode_to_numpy(" " + (" ".join(words) if joined is None else joined), disallowed_special=())
        wanted = np.cumsum((np.array([len(w.encode()) for w in words]) if lengths is None else lengths) + 1)
        ends = np.cumsum(sizes[ids])
        at = np.searchsorted(ends, wanted)
        if (ends[at] == wanted).all():
            return ids, np.diff(at + 1, prepend=0)
        # A word with a space of another kind: no id may run across words.
        each = [encoding.encode_ordinary(" " + w) for w in words]
        return np.array([i for e in each for i in e], np.int64), np.array([len(e) for e in each], np.int64)


class Coded:
    """One coded row: held_out, order (a hash) and lengths (tokens with the end) of its documents, words (hashes), number (of each token's word), and subwords."""

    def __init__(self, row: dict[str, pa.Scalar]):
        read = lambda name, kind: np.frombuffer(row[name].as_buffer(), kind) if row[name].is_valid else np.zeros(0, kind)
        self.held_out, self.lengths = read("held_out", bool), read("lengths", np.int32).astype(np.int64)
        self.number = np.frombuffer(row["number"].as_buffer(), np.dtype(f"u{row['number'].as_buffer().size // int(self.lengths.sum())}"))
        self.sub_lengths = read("sub_lengths", np.int32).astype(np.int64)
        self.sub = np.frombuffer(row["sub"].as_buffer(), np.dtype(f"u{row['sub'].as_buffer().size // int(self.sub_lengths.sum())}"))
        self.order = read("order", np.int64) if "order" in row else None
        self.words = row["words"].values.to_numpy() if "words" in row else None

    def counts(self) -> np.ndarray:
        """How often each word is a training token."""
        training = np.repeat(~self.held_out, self.lengths)
        return np.bincount(self.number[training], minlength=len(self.sub_lengths))

    def subwords(self) -> tuple[np.ndarray, np.ndarray]:
        """All subword ids, document after document, and each document's number of them."""
        return expand(self.number, self.lengths, self.sub, self.sub_lengths)

    def lessons(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The subword ids of the training documents of a round, each one's number of them, and its order."""
        taught = ~self.held_out & (self.order % ROUNDS == number)
        return *expand(self.number[np.repeat(taught, self.lengths)], self.lengths[taught], self.sub, self.sub_lengths), self.order[taught]

    def pairs(self, end: int) -> tuple[np.ndarray, np.ndarray]:
        """before * (end + 1) + id for the neighbours in training text, and how often they are; the end comes before a text's first id."""
        last = np.cumsum(self.sub_lengths) - 1
        first = last - self.sub_lengths + 1
        sub, width = self.sub.astype(np.int64), end + 1
        # Within words: once for each distinct word.
        inside = np.ones(len(sub), bool)
        inside[first] = False
        at = np.flatnonzero(inside)
        n = np.repeat(self.counts(), self.sub_lengths)[at]
        # Between words.
        before = np.empty(len(self.number), np.int64)
        before[1:] = sub[last[self.number[:-1]]]
        before[np.cumsum(self.lengths) - self.lengths] = end
        training = np.repeat(~self.held_out, self.lengths)
        across = (before * width + sub[first[self.number]])[training]
        across.sort()
        new = np.flatnonzero(np.diff(across, prepend=-1))
        return np.concatenate([sub[at - 1] * width + sub[at], across[new]]), np.concatenate([n, np.diff(new, append=len(across))])


def expand(number: np.ndarray, lengths: np.ndarray, sub: np.ndarray, sub_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of texts given as numbers of words, and each text's number of them."""
    sizes = sub_lengths[number]
    first = (np.cumsum(sub_lengths) - sub_lengths)[number]
    total = np.cumsum(sizes)
    at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first - total + sizes, sizes)
    ends = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(lengths)])]
    return sub[at], np.diff(ends)


def code(docs: DataFrame, subwords: Subwords) -> DataFrame:
    """docs(doc_id, text, held_out, order) -> coded rows."""
    kind = dict(docs.dtypes)["doc_id"]
    ddl = f"ids array<{kind}>, held_out binary, lengths binary, words array<bigint>, number binary, sub binary, sub_lengths binary, order binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for b in slices(batches, CODED_BYTES):
            if not b.num_rows:
                continue
            lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(b.column(1), "").cast(pa.large_string())))
            flat = lists.flatten()
            used = pc.not_equal(flat, "")
            doc = pc.list_parent_indices(lists).filter(used).to_numpy()
            coded = flat.filter(used).dictionary_encode()
            spaced = pc.binary_join_element_wise(coded.dictionary, *(pa.scalar(x, coded.dictionary.type) for x in ("", " ")))  # a space behind each word; one string of them is made faster than each
            joined = spaced.buffers()[2].to_pybytes()[: pc.sum(pc.binary_length(spaced)).as_py() - 1].decode() if len(spaced) else ""
            words = joined.split(" ") if joined else []  # no word has a space
            lengths = np.bincount(doc, minlength=b.num_rows) + 1
            number = np.full(int(lengths.sum()), len(words), narrow(len(words) + 1))
            number[np.arange(len(doc)) + doc] = coded.indices.to_numpy()
            sub, sizes = subwords.encode(words, pc.binary_length(coded.dictionary).to_numpy(), joined)
            hashes = np.fromiter(map(digest, [*words, END_WORD]), np.uint64, len(words) + 1).view(np.int64)
            held = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            kind_ = narrow(subwords.end + 1)
            sub, sizes = np.append(sub, subwords.end).astype(kind_), np.append(sizes, 1)
            row = [
                pa.array([b.column(0).to_pylist()], schema.field("ids").type),
                held.tobytes(),
                lengths.astype(np.int32).tobytes(),
                pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), pa.array(hashes)),
                number.tobytes(),
                sub.tobytes(),
                sizes.astype(np.int32).tobytes(),
                b.column(3).to_numpy().astype(np.int64).tobytes(),
            ]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array([x], pa.binary()) for x in row], schema.names)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return mapped(docs, run, ddl)


FIELDS = ["held_out", "lengths", "number", "sub", "sub_lengths"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Coded, dict]]:
    for b in batches:
        for k in range(b.num_rows):
            row = {name: b.column(at)[k] for at, name in enumerate(b.schema.names)}
            yield Coded(row), row


def _over(df: DataFrame, ddl: str, gather: Callable[[Iterator], Iterator[list]]) -> DataFrame:
    """Batches of arrays that gather() makes of a task's coded rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in gather(c for c, _ in _rows(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(arrays, schema, strict=True)], names=schema.names)

    return mapped(df, run, ddl)


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    if len(key) and key.min() >= 0 and int(key.max()) >> 32 == 0 and int(n.max()) >> 31 == 0:
        # Both in one number: sorting it is faster than sorting an order.
        both = key << 31 | n
        both.sort()
        key, n = both >> 31, both & (1 << 31) - 1
    else:
        order = np.argsort(key)
        key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1))
    return key[first], np.add.reduceat(n, first)


def tally(coded: DataFrame, end: int) -> DataFrame:
    """kind (0: words by hash, 1: subword ids, 2: pairs of them), key and n, over all training text."""

    def gather(rows: Iterator[Coded]) -> Iterator[list]:
        held, size, ids = {0: [], 2: []}, 0, np.zeros(end + 1)

        def out() -> Iterator[list]:
            for kind, found in held.items():
                for key, n in found:
                    yield [np.full(len(key), kind, np.int32), key, n]
                found.clear()

        def merge() -> int:
            for found in held.values():
                found[:] = [_merged(*zip(*found, strict=True))] if found else []
            return sum(len(key) for found in held.values() for key, _ in found)

        for c in rows:
            n = c.counts()
            ids += np.bincount(c.sub, np.repeat(n, c.sub_lengths), end + 1)
            for kind, key, m in ((0, c.words, n), (2, *c.pairs(end))):
                held[kind].append((key[m > 0], m[m > 0]))
                size += len(m)
            if size > 1 << 21:
                size = merge()
                if size > 1 << 20:
                    yield from out()
                    size = 0
        merge()
        yield from out()
        seen = np.flatnonzero(ids)
        yield [np.ones(len(seen), np.int32), seen, ids[seen].astype(np.int64)]

    return _over(coded.select(*FIELDS, "words"), "kind int, key bigint, n bigint", gather).groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Pairs:
    """Discounted frequencies of id pairs, and what each id's discounts leave to others.

    Tasks get the pairs and lay out a hash table of them, each in one slot; of
    pairs that fall together the most frequent has it, the others are searched
    for in order.  Pairs of the corpus that aren't among them are `others`.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, before: np.ndarray, taken: np.ndarray | None = None, others: HashFilter | None = None):
        """keys: before * len(before) + id.  before: how often each id precedes another.  taken: each id's sum of discounted counts over all pairs, if there are others."""
        self.width = len(before)
        self.bits = max(10, len(keys).bit_length() + 2)
        order = np.argsort(counts, kind="stable")
        keys, counts = keys[order], counts[order]
        at = np.zeros(1 << self.bits, np.int64)
        at[self.slot(keys)] = np.arange(len(keys))  # the last one stays
        stays = at[self.slot(keys)] == np.arange(len(keys))
        taken = np.bincount(keys // self.width, counts - DISCOUNT, self.width) if taken is None else taken
        self.left = (1 - taken / before).astype(np.float32)
        share = ((counts - DISCOUNT) / before[keys // self.width]).astype(np.float32)
        self.pairs, self.share = keys[stays], share[stays]
        order = np.argsort(keys[~stays])
        self.met, self.met_share = keys[~stays][order], share[~stays][order]
        self.before, self.others = before, others
        self._table = None

    def __getstate__(self):
        return self.__dict__ | {"_table": None}

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs' keys, own probability (0 if they aren't here), and whether they may be among the others."""
        if self._table is None:
            # A slot has its pair's place; empty ones have the first, whose key tells.
            self._table = np.zeros(1 << self.bits, np.int32)
            self._table[self.slot(self.pairs)] = np.arange(len(self.pairs), dtype=np.int32)
        key = before.astype(np.int64) * self.width + ids
        share, here = np.zeros(len(key), np.float32), np.zeros(len(key), bool)
        if len(self.pairs):
            at = self._table[self.slot(key)]
            here = self.pairs[at] == key
            share = np.where(here, self.share[at], np.float32(0))
        if len(self.met):
            ask = np.flatnonzero(~here)
            at = np.minimum(np.searchsorted(self.met, key[ask]), len(self.met) - 1)
            found = self.met[at] == key[ask]
            share[ask[found]] = self.met_share[at[found]]
            here[ask[found]] = True
        may = np.zeros(len(key), bool)
        if self.others is not None:
            ask = np.flatnonzero(~here)
            may[ask] = self.others.may_have(spread(key[ask]))
        return key, share, may

    def shares(self, before: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The own probability of pairs that are here, and the factor of any other source's."""
        return self.find(before, ids)[1], self.left[before]


def spread(keys: np.ndarray) -> np.ndarray:
    """Pairs' keys as 64-bit hashes."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def sums_of_pairs(pairs: DataFrame, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over all pairs(key, n): counts of class pairs, and each id's sum of discounted counts as the one before."""
    width, cells = len(class_of), CLASSES * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells + width)
        for b in batches:
            key, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            total[:cells] += np.bincount(class_of[key // width].astype(np.int64) * CLASSES + class_of[key % width], n, cells)
            total[cells:] += np.bincount(key // width, n - DISCOUNT, width)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["i", "x"])

    place, found = arrays(mapped(pairs.select("key", "n"), run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")), "i", "x")  # a row for each cell and id at most
    total = np.zeros(cells + width)
    total[place] = found
    return total[:cells].reshape(CLASSES, CLASSES), total[cells:]


def hashed(pairs: DataFrame) -> HashFilter:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(spread(b.column(0).to_numpy()))], ["h"])

    return HashFilter.of(mapped(pairs.select("key"), run, "h bigint"), "h")


def frequent(counted: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Splits (key, n): the highest counts, of so many grades of n from the top that there are `most` rows at most; and the others."""
    grade = F.floor(F.log2(F.col("n").cast("double")) * 64)
    least, total = 0, 0
    for r in sorted(counted.groupBy(grade.alias("g")).agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["g"]):  # 4,032 grades at most
        total += r["rows"]
        if total > most:
            least = r["g"] + 1
            break
    return counted.where(grade >= least), counted.where(grade < least)


@dataclass
class Model:
    """class_of, input_of and within (log of the frequency within the class) by id; the last id is the end."""

    class_of: np.ndarray
    input_of: np.ndarray
    within: np.ndarray
    prior: np.ndarray
    params: attention.Params
    pairs: Pairs | None = None

    def before(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What precedes each subword; the end of a text precedes its first."""
        out = np.empty_like(ids)
        out[1:] = ids[:-1]
        out[np.cumsum(sizes) - sizes] = len(self.class_of) - 1
        return out

    def windows(self, ids: np.ndarray, sizes: np.ndarray, size: int = AT_ONCE):
        """Of the windows over all documents, in batches: inputs, and of the places that aren't context alone the classes before them, places in ids, and what the window scores.  Places behind a document's end may be anyone's, or none."""
        many = np.where(sizes > WINDOW, 1 + -(-(sizes - WINDOW) // STRIDE), 1)
        doc = np.repeat(np.arange(len(sizes)), many)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        before = self.before(ids, sizes)
        begin, left = (np.cumsum(sizes) - sizes)[doc] + k * STRIDE, sizes[doc] - k * STRIDE
        inputs, classes = (np.append(np.take(x, before, mode="clip"), np.zeros(WINDOW, x.dtype)) for x in (self.input_of, self.class_of))
        for which, context in ((np.flatnonzero(k == 0), 0), (np.flatnonzero(k), WINDOW - STRIDE)):
            step = np.arange(context, WINDOW)
            each, own = (np.lib.stride_tricks.sliding_window_view(x, n) for x, n in ((inputs, WINDOW), (classes, WINDOW - context)))
            for a in range(0, len(which), size):
                at = which[a : a + size]
                first = begin[at]
                yield each[first], own[first + context], first[:, None] + step, step < left[at, None]

    def taught(self, ids: np.ndarray) -> np.ndarray:
        """One document's windows to learn from, side by side: inputs, classes before (-1 behind the text's end) and wanted classes, as int32."""
        many, n = -(-len(ids) // WINDOW), len(ids)
        end = len(self.class_of) - 1
        out = np.empty((3, many * WINDOW), np.int32)
        out[0, 0], out[1, 0] = self.input_of[end], self.class_of[end]
        np.take(self.input_of, ids[:-1], out=out[0, 1:n], mode="clip")
        np.take(self.class_of, ids, out=out[2, :n], mode="clip")
        out[1, 1:n] = out[2, : n - 1]
        out[:, n:] = [[0], [-1], [0]]
        return out.reshape(3, many, WINDOW)

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of each subword's probability, where its pair is in the table or nowhere."""
        return self.parts(ids, sizes)[0]

    def parts(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """log10 of each subword's probability but for pairs that have to be asked for; whose these are; their keys, the first ids' counts and what else the probability has."""
        scorer, ends = attention.Scorer(self.params, self.prior), np.cumsum(sizes)
        last = np.flatnonzero(np.diff((ends - 1) // PORTION, append=-1))  # of each portion's documents
        found, asked, keys, counts, others = [], [], [], [], []
        for a, b in zip([0, *(last[:-1] + 1)], last + 1, strict=True):
            start = ends[a] - sizes[a]
            x, at, (key, count, other) = self._parts(ids[start : ends[b - 1]], sizes[a:b], scorer)
            for whole, part in ((found, x), (asked, at + start), (keys, key), (counts, count), (others, other)):
                whole.append(part)
        return np.concatenate(found), np.concatenate(asked), (np.concatenate(keys), np.concatenate(counts), np.concatenate(others))

    def _parts(self, ids: np.ndarray, sizes: np.ndarray, scorer: attention.Scorer) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        before = self.before(ids, sizes)
        key, own, may = self.pairs.find(before, ids)
        left = self.pairs.left[before]
        each, wanted = np.take(self.within, ids, mode="clip"), np.append(np.take(self.class_of, ids, mode="clip"), np.zeros(WINDOW, self.class_of.dtype))
        for inputs, classes, place, scored in self.windows(ids, sizes):
            found = scorer(inputs, classes, wanted[place])
            each[place[scored]] += found[scored]
        other = left * np.exp(each)
        asked = np.flatnonzero(may)
        found = np.log10(np.maximum(own + other, np.float32(LEAST)))
        found[asked] = 0
        return found, asked, (key[asked], self.pairs.before[before[asked]], other[asked].astype(np.float64))


def _classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """class_of, input_of and within: the most frequent ids are classes of their own, the others share classes of equal mass; the end has the last."""
    end = len(counts) - 1
    order = np.append(np.argsort(-counts[:end], kind="stable"), end)
    rank = np.empty(end + 1, np.int64)
    rank[order] = np.arange(end + 1)
    rest = counts[order[SINGLE:-1]]
    class_of = np.full(end + 1, CLASSES - 1, np.int32)
    class_of[order[:SINGLE]] = np.arange(SINGLE)
    shared = CLASSES - SINGLE - 1
    class_of[order[SINGLE:-1]] = SINGLE + np.minimum((np.cumsum(rest) - rest) * shared // rest.sum(), shared - 1).astype(np.int32)
    mass = np.bincount(class_of, counts, CLASSES)
    within = np.log(counts / mass[class_of]).astype(np.float32)
    spread = OWN_INPUTS + rank * 2654435761 % (1 << 32) * SHARED_INPUTS // (1 << 32)
    inputs = np.where(rank < OWN_INPUTS, rank, spread)
    inputs[end] = OWN_INPUTS - 1  # as every text begins after it
    return class_of, inputs.astype(np.int32), within


def lessons(coded: DataFrame, number: int, groups: int) -> DataFrame:
    """A round's documents, dealt by group and in order: g, key and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, _ in _rows(batches):
            ids, sizes, order = c.lessons(number)
            data, at = ids.tobytes(), np.concatenate([[0], np.cumsum(sizes)]) * ids.itemsize
            each = [data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            wide = np.full(len(order), ids.itemsize, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array((order // ROUNDS % groups).astype(np.int32)), pa.array(order), pa.array(wide), pa.array(each, pa.binary())], ["g", "key", "wide", "ids"])

    return mapped(coded.select(*FIELDS, "order"), run, "g int, key bigint, wide int, ids binary").repartition("g").sortWithinPartitions("g", "key")


def learn(model: Model, docs: Iterator[tuple[int, int, np.ndarray]], rate: float) -> Iterator[tuple[attention.Params, float]]:
    """docs: group, any number and ids, by group.  Each group's parameters, from the model's on, and how many subwords taught it."""
    p, adam, group, seen = {}, None, None, 0
    waiting: list[np.ndarray] = []
    rows, room = 0, attention.Room()

    def step(windows: np.ndarray) -> None:
        inputs, classes, wanted = windows
        adam.step(p, attention.gradients(p, inputs, np.maximum(classes, 0), model.prior, wanted, (classes >= 0).astype(np.float32), room))

    def steps(least: int) -> int:
        """In portions of BATCH windows, whatever batches they came in."""
        windows = np.concatenate(waiting, axis=1)
        at = 0
        while windows.shape[1] - at >= least and at < windows.shape[1]:
            step(windows[:, at : at + BATCH])
            at += BATCH
        waiting[:] = [windows[:, at:]]
        return max(0, windows.shape[1] - at)

    for g, _, ids in docs:
        if g != group:
            if group is not None:
                rows = steps(1) if waiting else 0
                yield p, seen
            p, adam, group, seen = {k: x.copy() for k, x in model.params.items()}, attention.Adam(rate), g, 0
            waiting.clear()
            rows = 0
        windows = model.taught(ids)
        waiting.append(windows)
        rows += windows.shape[1]
        seen += len(ids)
        if rows >= 16 * BATCH:
            rows = steps(BATCH)
    if group is not None:
        if waiting:
            steps(1)
        yield p, seen


def train(coded: DataFrame, id_counts: np.ndarray, pairs: DataFrame, rounds: int = ROUNDS) -> Model:
    """From the counts of all training documents, and the network from all of them, too."""
    class_of, input_of, within = _classes(id_counts)
    width = len(id_counts)
    joint, taken = sums_of_pairs(pairs, class_of)
    mass = np.bincount(class_of, id_counts, CLASSES)
    joint = joint + mass / mass.sum()
    prior = np.log(joint / joint.sum(axis=1, keepdims=True)).astype(np.float32)
    model = Model(class_of, input_of, within, prior, attention.init(OWN_INPUTS + SHARED_INPUTS, CLASSES, WINDOW))
    groups = 1 + int(id_counts.sum() - width) // GROUP
    for number in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], rate=LEARNING / (1 + number)) -> Iterator[pa.RecordBatch]:
            docs = ((g, key, np.frombuffer(ids, f"u{wide}")) for b in batches for g, key, wide, ids in zip(*(b.column(k).to_numpy().tolist() for k in range(3)), b.column(3).to_pylist(), strict=True))
            total = None
            for p, seen in learn(model, docs, rate):
                flat = np.append(attention.pack(p), 1.0) * seen
                total = flat if total is None else total + flat
            if total is not None:
                # The last entry adds up the weights.
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "x"])

        with row_by_row(coded.sparkSession):
            place, found = arrays(mapped(lessons(coded, number, groups), run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")), "i", "x")  # a row a parameter
        found = found[np.argsort(place)]
        if len(found) and found[-1] > 0:
            model.params = attention.unpack(model.params, found[:-1] / found[-1])
    # An id comes before another as often as it comes, and the end, too: before a text's first.
    common, others = frequent(pairs, PAIRS)
    keys, counts = arrays(common, "key", "n")  # PAIRS rows at most
    model.pairs = Pairs(keys, counts, id_counts, taken, None if others.isEmpty() else hashed(others))
    return model


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = RANKS) -> DataFrame:
    """The base and the model's score of every row; rows whose fold is HELD_OUT teach nothing.

    A null, empty or blank text is its end alone.  A null id is held out.
    Repeated rows count and are scored as often as they come.  An empty table
    gives an empty result.
    """
    work = Workspace(docs.sparkSession)
    subwords = Subwords.load(path)
    own = columns(docs, doc_id=doc_id, text=text)
    held = F.coalesce(id_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(True))
    order = F.xxhash64(F.col("doc_id").cast("string"), "text").bitwiseAND(F.lit((1 << 62) - 1))
    kind = dict(own.dtypes)["doc_id"]
    coded = work.write(code(own.withColumn("held_out", held).withColumn("order", order), subwords), "coded")
    with row_by_row(work.spark):
        counted = work.write(tally(coded, subwords.end), "counts")
    words = counted.where("kind = 0").select("key", "n")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, denominator = total["n"] or 0, (total["n"] or 0) + total["v"] + 1
    id_counts = np.ones(subwords.end + 1)
    for r in counted.where("kind = 1").select("key", "n").collect():  # a row for each id of the tokenizer at most
        id_counts[r["key"]] += r["n"]
    pairs = counted.where("kind = 2").select("key", "n")
    model = train(coded, id_counts, pairs)
    common, others = frequent(words, WORDS)
    keys, counts = arrays(common, "key", "n")  # WORDS rows at most
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    ddl = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<bigint>, pairs array<struct<key: bigint, mass: double, other: double>>"

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, row in _rows(batches):
            order = np.argsort(c.words)  # a sorted search stays in one place of memory
            at = np.empty(len(order), np.int64)
            at[order] = np.minimum(np.searchsorted(keys, c.words[order]), max(0, len(keys) - 1))
            is_common = keys[at] == c.words if len(keys) else np.zeros(len(c.words), bool)
            n = np.where(is_common, counts[at] if len(keys) else 0, 0)
            base = np.where(is_common, np.log10((n + 1) / denominator), 0.0)
            ids, sizes = c.subwords()
            known = is_common[c.number]
            sums = lambda x, n: (y := np.concatenate([[0], np.cumsum(x)]))[ends := np.cumsum(n)] - y[ends - n]
            each, at, parts = model.parts(ids, sizes)
            scores = sums(each.astype(np.float64), sizes)
            by_pair = pa.array(np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)])), pa.int32())
            open_pairs = pa.StructArray.from_arrays([pa.array(x) for x in parts], ["key", "mass", "other"])
            rare = np.flatnonzero(~known)
            offsets = np.concatenate([[0], np.cumsum(~known)])[np.concatenate([[0], np.cumsum(c.lengths)])]
            asked = pa.array(c.words[c.number[rare]])
            values = [row["ids"].values, c.held_out, c.lengths, sums(known.astype(np.int64), c.lengths), sums(base[c.number], c.lengths), scores, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), asked), pa.ListArray.from_arrays(by_pair, open_pairs)]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in values], ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "pairs"])

    with row_by_row(work.spark):
        scored = work.write(mapped(coded.select("ids", *FIELDS, "words"), finish, ddl).withColumn("doc", F.monotonically_increasing_id()), "scored")
    work.drop("coded")
    asked = scored.select("doc", F.explode("rare").alias("key"))
    c = F.coalesce(F.col("n"), F.lit(0))
    base = F.log10((c + 1) / denominator)
    sums = asked.join(others, "key", "left").groupBy("doc").agg(F.sum(base).alias("more_base"), F.count_if(c > 0).alias("more_known"))
    result = scored.join(sums, "doc", "left")
    if model.pairs.others is not None:
        met = scored.select("doc", F.explode("pairs").alias("x")).select("doc", "x.*").join(frequent(pairs, PAIRS)[1], "key", "left")
        own = F.coalesce((F.col("n") - DISCOUNT) / F.col("mass"), F.lit(0.0))
        result = result.join(met.groupBy("doc").agg(F.sum(F.log10(F.greatest(own + F.col("other"), F.lit(LEAST)))).alias("more_score")), "doc", "left")
    else:
        result = result.withColumn("more_score", F.lit(0.0))
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0)))
    return result.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), plus("base", "more_base").alias("base_score"), plus("score", "more_score").alias("score")
    )


def op6_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))

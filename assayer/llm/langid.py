"""Language identification by segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary.  The
probability of a word sums over all its segmentations into pieces, by a forward
pass over the lattice of pieces; a text's is the product over its words.  The
distinct words of a batch pass together, all languages at once.  The piece
probabilities are learnt by expectation maximisation: the forward and
backward sums give every piece's expected count, and Spark adds the counts up
by language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import Workspace, arrays, columns, id_fold, mapped, slices, table
from assayer.llm.pieces import PIECES, SPACE, vocabulary

#: The piece probabilities are fitted on about so many labelled rows of each language.
TRAIN_DOCS = 400
ROUNDS = 2
FOLDS = 5
UNDETERMINED = "und"
#: Of a character outside the vocabulary, in any language.
UNKNOWN = 1e-7
SMOOTHING = 0.5
#: Characters of a word after which the forward sums are rescaled: as many as the longest piece has, or more.
RESCALE = 16
#: Longer words pass one by one, others so many at once.
TOGETHER, AT_ONCE = 64, 8_000
#: Text looked at together.
SLICE = 4 << 20


def letter_runs(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct runs of letters in lower case; and of each in the texts, in order, which one it is and its text."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), "\\PL+")
    flat = lists.flatten()
    used = pc.not_equal(flat, "")
    coded = flat.filter(used).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), pc.list_parent_indices(lists).filter(used).to_numpy()


def _forward(edges: list[list[tuple[int, int]]], p: list[float], longest: int) -> tuple[list[float], float]:
    """The sums of all segmentations of each prefix, and the log of the factors taken out of them on the way.

    edges: for each character, (length, piece) of what may end there.
    """
    sums, log = [1.0], 0.0
    for j, found in enumerate(edges, 1):
        s = 0.0
        for length, k in found:
            s += sums[j - length] * p[k]
        sums.append(s)
        if j % RESCALE == 0 and s:
            scale = 1 / s
            log += math.log(s)
            for i in range(max(0, j - longest), j + 1):
                sums[i] *= scale
    return sums, log


class _Prefixes:
    """All prefixes of pieces by a rolling hash, so that many places of many words are followed at once."""

    STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, pieces: list[str]):
        known: dict[int, int] = {}
        for k, piece in enumerate(pieces):
            h = 0
            for c in piece:
                h = (h * int(self.STEP) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                known.setdefault(h, -1)
            known[h] = k
        self.hashes = np.array(sorted(known), np.uint64)
        self.piece = np.array([known[h] for h in sorted(known)], np.int32)
        self._marks()

    def _marks(self) -> None:
        self.may = np.zeros(1 << 22, bool)
        self.may[self.slot(self.hashes)] = True

    def __getstate__(self):
        return self.hashes, self.piece

    def __setstate__(self, state):
        self.hashes, self.piece = state
        self._marks()

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h * self.SPREAD >> np.uint64(42)).view(np.int64)

    def edges(self, codes: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """length, places and pieces, for pieces of each length that begin at a place.  room: characters left in the word."""
        at, h, length = np.arange(len(codes)), np.zeros(len(codes), np.uint64), 0
        while len(at):
            h = h * self.STEP + codes[at + length] + np.uint64(1)
            length += 1
            on = np.flatnonzero(self.may[self.slot(h)])
            at, h = at[on], h[on]
            found = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            on = np.flatnonzero(self.hashes[found] == h)
            at, h, found = at[on], h[on], found[on]
            whole = self.piece[found] >= 0
            yield length, at[whole], self.piece[found[whole]]
            on = np.flatnonzero(room[at] > length)
            at, h = at[on], h[on]


class _Lattice:
    """What pieces may stand where in words, sorted by their ends and lengths: a word has one of an end and a length at most.

    A word's sums are before each of its characters and after the last, so a
    word has a row more than characters; the first is the space before it.
    """

    def __init__(self, prefixes: _Prefixes, words: list[str], unknown: int):
        self.size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        text = "".join(SPACE + w for w in words)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        first = np.cumsum(self.size) - self.size
        place = np.arange(len(codes)) - np.repeat(first, self.size)
        row = np.arange(len(codes)) + np.repeat(np.arange(len(words)), self.size)
        self.begin, self.rows = first + np.arange(len(words)), len(codes) + len(words)
        keys, starts, pieces, lone = [], [], [], np.ones(len(codes), bool)

        def add(at: np.ndarray, length: int, piece: np.ndarray) -> None:
            keys.append((place[at] + length) * 64 + length)
            starts.append(row[at])
            pieces.append(piece)

        for length, at, piece in prefixes.edges(codes, np.repeat(self.size, self.size) - place):
            add(at, length, piece)
            if length == 1:
                lone[at] = False
        at = np.flatnonzero(lone)
        add(at, 1, np.full(len(at), unknown, np.int32))
        key = np.concatenate(keys)
        order = np.argsort(key.astype(np.int16) if key.max() < 1 << 15 else key, kind="stable")
        key, self.starts, self.pieces = key[order], np.concatenate(starts)[order], np.concatenate(pieces)[order]
        bounds = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
        #: (end, length, from, to) of the runs of one end and length.
        self.groups = [(k // 64, k % 64, a, b) for k, a, b in zip(key[bounds[:-1]].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def forward(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sums over all segmentations by row, and the logs of the factors taken out of a word's.  table: by piece, then by language."""
        sums, log = np.zeros((self.rows, table.shape[1])), np.zeros((len(self.size), table.shape[1]))
        sums[self.begin] = 1
        done = 0
        for end, length, a, b in self.groups:
            if end > done and done and done % RESCALE == 0:
                self._rescale(sums, log, done)
            done = end
            at = self.starts[a:b]
            sums[at + length] += sums[at] * table[self.pieces[a:b]]
        return sums, log

    def _rescale(self, sums: np.ndarray, log: np.ndarray, end: int) -> None:
        long = np.flatnonzero(self.size > end)
        at = self.begin[long] + end
        scale = np.maximum(sums[at], 1e-300)
        log[long] += np.log(scale)
        for back in range(RESCALE):
            sums[at - back] /= scale

    def expected(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each piece's expected count over all segmentations of the words, of any length, which come n times.

        After every RESCALE characters the forward sums of the last ones are
        divided by a factor of the word; the backward sums are multiplied by it,
        so that an edge over such a place is divided by it once.
        """
        sums, rest, gain = np.zeros(self.rows), np.zeros(self.rows), np.zeros(len(self.starts))
        word = np.repeat(np.arange(len(self.size)), self.size + 1)
        factors: dict[int, np.ndarray] = {}
        sums[self.begin] = 1
        done = 0
        for end, length, a, b in self.groups:
            if end > done and done and done % RESCALE == 0:
                long = np.flatnonzero(self.size > done)
                at = self.begin[long] + done
                factor = factors[done // RESCALE] = np.ones(len(self.size))
                factor[long] = np.maximum(sums[at], 1e-300)
                for back in range(RESCALE):
                    sums[at - back] /= factor[long]
            done = end
            at = self.starts[a:b]
            sums[at + length] += sums[at] * p[self.pieces[a:b]]
        last = self.begin + self.size
        rest[last] = np.where(sums[last] > 0, n / np.maximum(sums[last], 1e-300), 0)
        for end, length, a, b in reversed(self.groups):
            at = self.starts[a:b]
            flow = p[self.pieces[a:b]] * rest[at + length]
            block = -(-end // RESCALE)
            if block in factors and -(-(end - length) // RESCALE) < block:
                flow /= factors[block][word[at]]
            gain[a:b] = sums[at] * flow
            rest[at] += flow
        return np.bincount(self.pieces, gain, len(p))


@dataclass
class LanguageModel:
    """table: by piece and, last, for an unknown character, its probability in each language."""

    languages: list[str]
    prefixes: _Prefixes
    table: np.ndarray

    @property
    def unknown(self) -> int:
        return len(self.table) - 1

    def word(self, word: str) -> list[float]:
        """The log-probability of a word of any length in each language."""
        codes = np.array([ord(c) for c in SPACE + word], np.uint64)
        edges: list[list[tuple[int, int]]] = [[] for _ in codes]
        for length, at, piece in self.prefixes.edges(codes, len(codes) - np.arange(len(codes))):
            for k, n in zip(at.tolist(), piece.tolist(), strict=True):
                edges[k + length - 1].append((length, n))
        for found in edges:
            if not any(length == 1 for length, _ in found):
                found.append((1, self.unknown))
        out = []
        for p in self.table.T.tolist():
            sums, log = _forward(edges, p, RESCALE)
            out.append(math.log(sums[-1] or 1e-300) + log)
        return out

    def words(self, words: list[str]) -> np.ndarray:
        """The log-probability of each word in each language."""
        out = np.zeros((len(words), len(self.languages)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(sizes > TOGETHER):
            out[k] = self.word(words[k])
        together = np.flatnonzero(sizes <= TOGETHER)
        for a in range(0, len(together), AT_ONCE):
            some = together[a : a + AT_ONCE]
            lattice = _Lattice(self.prefixes, [words[k] for k in some], self.unknown)
            sums, log = lattice.forward(self.table)
            out[some] = np.log(np.maximum(sums[lattice.begin + lattice.size], 1e-300)) + log
        return out

    def predict_all(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Of each text the likeliest language and its posterior; `und` and 0 for a text without a letter."""
        words, which, doc = letter_runs(texts)
        if not words or not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        by_word = self.words(words)
        rows = np.stack([np.bincount(doc, by_word[which, k], len(texts)) for k in range(len(self.languages))], axis=1)
        best = rows.argmax(axis=1)
        score = 1 / np.exp(rows - rows[np.arange(len(rows)), best][:, None]).sum(axis=1)
        some = np.bincount(doc, minlength=len(texts)) > 0
        return [self.languages[k] if s else UNDETERMINED for k, s in zip(best, some, strict=True)], np.where(some, score, 0.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        lang, score = self.predict_all(pa.array([text], pa.string()))
        return lang[0], float(score[0])


def train(labelled: DataFrame, path: str = PIECES, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS) -> LanguageModel:
    """labelled(key, text, lang).  Rows with a null text or language teach nothing.

    About train_docs rows of each language, chosen by a hash of the key, are
    used; what comes to the driver is one number for each language and piece.
    """
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # the model has a column for each
    languages = sorted(counts)
    vocab = vocabulary(path)
    # Upper case is folded in the texts, so those pieces never occur.
    pieces = [p for i in vocab.normal if (p := vocab.pieces[i]) == p.lower()]
    prefixes, n_pieces = _Prefixes(pieces), len(pieces)
    probabilities = np.full((n_pieces + 1, len(languages)), 1 / n_pieces)
    probabilities[-1] = UNKNOWN
    if not languages:
        return LanguageModel([], prefixes, probabilities)
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, train_docs / counts[lang]))])
    work = Workspace(labelled.sparkSession)
    chosen = F.pmod(F.xxhash64("key", F.lit("fit")), F.lit(1_000_003)) < F.element_at(share, F.col("lang")) * 1_000_003
    sample = work.write(usable.where(chosen).select("text", "lang").repartition(16), "sample")
    number = {lang: k for k, lang in enumerate(languages)}
    for _ in range(rounds):

        def expect(batches: Iterator[pa.RecordBatch], now=probabilities) -> Iterator[pa.RecordBatch]:
            total = np.zeros((now.shape[1], n_pieces + 1))
            for b in slices(batches, SLICE):
                words, which, doc = letter_runs(b.column(0))
                langs = np.array([number[x] for x in b.column(1).to_pylist()], np.int64)[doc]
                for a in range(0, len(words), AT_ONCE):
                    some = slice(a, a + AT_ONCE)
                    lattice = _Lattice(prefixes, words[some], n_pieces)
                    for k in range(now.shape[1]):
                        total[k] += lattice.expected(now[:, k], np.bincount(which[langs == k], minlength=len(words))[some])
            k, piece = np.nonzero(total[:, :-1])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[k, piece])], ["k", "piece", "n"])

        k, piece, n = arrays(mapped(sample, expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")), "k", "piece", "n")  # a row for each cell of the model
        probabilities = np.full((n_pieces + 1, len(languages)), SMOOTHING)
        probabilities[piece, k] += n
        probabilities[:-1] /= probabilities[:-1].sum(axis=0)
        probabilities[-1] = UNKNOWN
    work.drop("sample")
    return LanguageModel(languages, prefixes, probabilities)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The rows of docs with lang_pred and score as further columns, in place of columns of those names.

    Only the text is looked at.  A text that is null, empty or without a letter
    gets `und` and score 0.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    own = docs.select(*rest)
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, SLICE):
            langs, scores = model.predict_all(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores)], [*rest, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*own.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return mapped(own, run, schema)


def split(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, text, lang and held_out; a null id is held out."""
    return columns(docs, key=doc_id, text=text, lang=lang).withColumn("held_out", F.coalesce(id_fold(F.col("key"), FOLDS) == 0, F.lit(True)))


def op4_piece_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split(table(spark, sf_dir, "documents"))
    model = train(rows.where(~F.col("held_out")))
    return predict(rows.select(F.col("key").alias("doc_id"), "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")

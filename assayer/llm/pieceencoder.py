"""SentencePiece encoding and decoding by an Aho-Corasick-driven Viterbi.

One pass over a text's characters keeps the automaton's state; at each position
the output links give every piece that ends there, and each relaxes the best
score of the position.  The result is the segmentation of the highest summed
piece score (unigram encoding), with UTF-8 byte pieces for characters outside
the vocabulary; for a vocabulary that was made for merges its ids may differ
from those that merging in order gives, and decoding is exact all the same.  No piece continues across a space or a newline, so the pass is
cut there, and the segments of recurring words are remembered (bounded).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.common import mapped, slices, table
from assayer.llm.pieces import PIECES, SPACE, Automaton, Vocabulary, vocabulary

#: An unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Words of 64 characters at most that a worker remembers, and units of them as well: some 120 MB each at most.
REMEMBERED = 400_000
_LIVE: dict[str, PieceCodec] = {}


LETTER = "[^\\W\\d_²³¹]"


def _units(pieces: list[str]) -> str:
    """A regex of the units between which no piece runs on.

    A unit ends before a space, around a newline, and where letters meet a stop:
    a mark that follows a letter in no piece.
    """
    letter = re.compile(LETTER).match
    marks = {c for p in pieces for c in p if not c.isalnum() and c != SPACE}
    stops = re.escape("".join(sorted(marks - {b for p in pieces for a, b in zip(p, p[1:], strict=False) if letter(a)} - {"\n"})))
    line = "" if any("\n" in p and len(p) > 1 for p in pieces) else "\n"
    return f"[{SPACE}]*{LETTER}++(?=[{SPACE}{line}{stops}]|\\Z)|[{SPACE}]*[^{SPACE}{line}]+|[{SPACE}]+" + (f"|{line}" if line else "")


class PieceCodec:
    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.automaton = Automaton({vocab.pieces[i]: i for i in vocab.normal if SPACE not in vocab.pieces[i].lstrip(SPACE)})
        self.scores = vocab.scores
        self.unknown = min(vocab.scores[i] for i in vocab.normal) - UNKNOWN_PENALTY
        self.units = re.compile(_units([vocab.pieces[i] for i in vocab.normal])).findall
        self.edges: list[list | None] = [None] * len(self.automaton.steps)
        self.known: dict[str, tuple[int, ...]] = {}
        self.known_units: dict[str, tuple[int, ...]] = {}
        self.byte_of = {i: b for b, i in vocab.bytes_.items()}
        self.shown = [p.replace(SPACE, " ") for p in vocab.pieces]

    def _relaxed(self, state: int) -> list[tuple[int, float, int]]:
        """(length, score, piece) of what may end in a state, longest first; piece -1 is an unknown character."""
        found = [(length, self.scores[piece], piece) for length, piece in self.automaton.outputs(state)]
        if not found or found[-1][0] > 1:  # no piece is this character alone
            found.append((1, self.unknown, -1))
        self.edges[state] = found
        return found

    def viterbi(self, unit: str) -> list[int]:
        follow, nexts, edges, state = self.automaton.follow, self.automaton.nexts, self.edges, 0
        best, back = [0.0], []
        for c in unit:
            n = nexts[state].get(c)
            state = follow(state, c) if n is None else n
            found = edges[state] or self._relaxed(state)
            choice = found[0]
            top = best[-choice[0]] + choice[1]
            for edge in found:
                score = best[-edge[0]] + edge[1]
                if score > top:
                    top, choice = score, edge
            best.append(top)
            back.append(choice)
        out, j = [], len(unit)
        while j:
            length, _, piece = back[j - 1]
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.vocab.bytes_[b] for b in reversed(unit[j - 1].encode("utf-8", "surrogatepass"))]
            j -= length
        out.reverse()
        return out

    def _remember(self, cache: dict, key: str, ids: list[int]) -> None:
        if len(cache) >= REMEMBERED:
            cache.clear()
        if len(key) <= 64:
            cache[key] = tuple(ids)

    def run(self, text: str) -> list[int]:
        """The ids of a text whose spaces are written as pieces write them."""
        units, out = self.known_units, []
        for unit in self.units(text):
            ids = units.get(unit)
            if ids is None:
                ids = self.viterbi(unit)
                self._remember(units, unit, ids)
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        """The ids; none for null or an empty text."""
        if not text:
            return []
        if SPACE in text:
            # A literal U+2581 isn't a space: it is written as bytes, so that decoding is exact.
            mark = [self.vocab.bytes_[b] for b in SPACE.encode()]
            out = []
            for k, part in enumerate(text.split(SPACE)):
                out += mark if k else []
                part = ("" if k else SPACE) + part.replace(" ", SPACE)
                out += self.run(part) if part else []
            return out
        if "  " in text or text[0] == " " or text[-1] == " ":
            return self.run(SPACE + text.replace(" ", SPACE))
        known, out = self.known, []
        for word in text.split(" "):
            ids = known.get(word)
            if ids is None:
                ids = self.run(SPACE + word)
                if "\n" not in word:
                    self._remember(known, word, ids)
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        if not ids:
            return ""
        byte_of = self.byte_of
        if byte_of.keys().isdisjoint(ids):
            return "".join([self.shown[i] for i in ids])[1:]
        out = b"".join(bytes([byte_of[i]]) if i in byte_of else self.shown[i].encode() for i in ids)
        return out.decode("utf-8", "surrogatepass")[1:]


def codec(path: str, vocab: Vocabulary) -> PieceCodec:
    """One codec a worker process, with what it remembers."""
    if path not in _LIVE:
        _LIVE[path] = PieceCodec(vocab)
    return _LIVE[path]


def encode(docs: DataFrame, path: str = PIECES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_ids and exact: whether decoding the ids gives the text again.

    Null and empty texts have no ids; both decode to the empty text.  Null ids
    and repeated rows are rows; further columns are left out; an empty table
    gives an empty result.
    """
    vocab = vocabulary(path)
    kind = dict(docs.dtypes)[doc_id]
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, vocab)
        for b in slices(batches, 4 << 20):
            texts = b.column(1).to_pylist()
            ids = [c.encode(t) for t in texts]
            exact = [c.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([len(i) for i in ids], pa.int64()), pa.array(exact)], ["doc_id", "ids", "n_ids", "exact"])

    return mapped(own, run, f"doc_id {kind}, ids array<int>, n_ids bigint, exact boolean")


def decode(encoded: DataFrame, path: str = PIECES, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and the text of the ids; the empty text for null or no ids."""
    vocab = vocabulary(path)
    kind = dict(encoded.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, vocab)
        for b in slices(batches, 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return mapped(encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")), run, f"doc_id {kind}, text string")


def op10_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))

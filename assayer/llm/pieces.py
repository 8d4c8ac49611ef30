"""A public piece vocabulary and an Aho-Corasick automaton over it."""

from __future__ import annotations

from collections import deque
from functools import lru_cache

from assayer.llm.common import TOKENIZERS

SPACE = "▁"
PIECES = f"{TOKENIZERS}/piece_bpe_32k.model"


class Vocabulary:
    """Pieces, their scores, and which ids stand for single bytes.  Ids below `first` are special."""

    def __init__(self, path: str = PIECES):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.scores = [model.get_score(i) for i in ids]
        self.bytes_ = {int(self.pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


@lru_cache(maxsize=2)
def vocabulary(path: str = PIECES) -> Vocabulary:
    """Read on the driver; tasks get the object, so executors need no file."""
    return Vocabulary(path)


class Automaton:
    """Finds all pieces that end at each character.

    steps: for each state, its children by character.  fail: the state of the
    longest proper suffix.  ends: (length, piece) of the piece that the state
    spells, or None.  link: the next state along the failure path that spells a
    piece, 0 if none: following it from a state yields the pieces from the
    longest to the shortest.
    """

    def __init__(self, pieces: dict[str, int]):
        self.steps, self.ends = [{}], [None]
        for text, number in pieces.items():
            at = 0
            for c in text:
                nxt = self.steps[at].get(c)
                if nxt is None:
                    nxt = self.steps[at][c] = len(self.steps)
                    self.steps.append({})
                    self.ends.append(None)
                at = nxt
            self.ends[at] = (len(text), number)
        self.fail, self.link = [0] * len(self.steps), [0] * len(self.steps)
        todo = deque(self.steps[0].values())
        while todo:
            s = todo.popleft()
            for c, t in self.steps[s].items():
                f = self.fail[s]
                while f and c not in self.steps[f]:
                    f = self.fail[f]
                self.fail[t] = self.steps[f].get(c, 0)
                todo.append(t)
            f = self.fail[s]
            self.link[s] = f if self.ends[f] else self.link[f]

        self.nexts: list[dict[str, int]] = [dict(x) for x in self.steps]
        self._found: list[list[tuple[int, int]] | None] = [None] * len(self.steps)

    def follow(self, s: int, c: str) -> int:
        """A step that leaves the trie: along the failure links.  It is remembered."""
        at = s
        while at and c not in self.steps[at]:
            at = self.fail[at]
        self.nexts[s][c] = at = self.steps[at].get(c, 0)
        return at

    def outputs(self, s: int) -> list[tuple[int, int]]:
        """What the output links of a state lead to.  It is remembered."""
        found, o = [], s if self.ends[s] else self.link[s]
        while o:
            found.append(self.ends[o])
            o = self.link[o]
        self._found[s] = found
        return found

    def matches(self, text: str) -> list[list[tuple[int, int]]]:
        """For each character, the (length, piece) pairs that end there, longest first.  Not to be changed."""
        nexts, known, s, out = self.nexts, self._found, 0, []
        for c in text:
            n = nexts[s].get(c)
            s = self.follow(s, c) if n is None else n
            found = known[s]
            out.append(self.outputs(s) if found is None else found)
        return out

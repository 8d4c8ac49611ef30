"""Byte regexes to deterministic automata: parsing, subset construction, minimisation.

The regex subset is literals, escapes, classes, groups, ``(?i:...)``,
alternation and the quantifiers ``? * + {m} {m,} {m,n}``.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

EMPTY = ("cat", [])


class _Parser:
    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def choice(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", options)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.quantified())
        return ("cat", parts)

    def quantified(self):
        atom = self.atom()
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.p.index("}", self.i)
                low, _, high = self.p[self.i : end].partition(",")
                bounds = (int(low), (int(high) if high else None) if "," in self.p[self.i : end] else int(low))
                self.i = end + 1
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            atom = ("rep", atom, *bounds)
        return atom

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.p[self.i - 2 : self.i], 16)
        return {"n": 10, "t": 9, "r": 13}.get(c, ord(c))

    def atom(self):
        c = self.take()
        if c == "(":
            fold = self.fold
            if self.p.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.p.startswith("?:", self.i):
                self.i += 2
            inner = self.choice()
            if self.take() != ")":
                raise ValueError(f"unclosed group in {self.p!r}")
            self.fold = fold
            return inner
        if c == "[":
            return ("set", self.folded(self.bracket()))
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        if c == "\\":
            return ("set", self.folded({self.escape()}))
        return ("cat", [("set", self.folded({b})) for b in c.encode()])

    def bracket(self) -> set[int]:
        negated, found = self.peek() == "^", set()
        if negated:
            self.take()
        first = True
        while first or self.peek() != "]":
            first = False
            low = self.escape() if (c := self.take()) == "\\" else ord(c)
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] != "]":
                self.take()
                high = self.escape() if (c := self.take()) == "\\" else ord(c)
                found.update(range(low, high + 1))
            else:
                found.add(low)
        self.take()
        return set(range(256)) - found if negated else found

    def folded(self, found: set[int]) -> frozenset[int]:
        if self.fold:
            found = found | {b ^ 32 for b in found if 65 <= (b & ~32) <= 90}
        return frozenset(found)


def parse(pattern: str):
    parser = _Parser(pattern)
    tree = parser.choice()
    if parser.peek():
        raise ValueError(f"unexpected {parser.peek()!r} in {pattern!r}")
    return tree


def reverse(tree):
    """The tree of the reversed language."""
    kind = tree[0]
    if kind == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [reverse(x) for x in tree[1]])
    if kind == "rep":
        return ("rep", reverse(tree[1]), *tree[2:])
    return tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.byte: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.byte.append(None)
        return len(self.empty) - 1

    def add(self, tree, start: int) -> int:
        """Adds the tree from a state on and returns its end."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.byte[start] = (tree[1], end)
            return end
        if kind == "cat":
            for x in tree[1]:
                inner = self.state()
                self.empty[start].append(inner)
                start = self.add(x, inner)
            return start
        if kind == "alt":
            end = self.state()
            for x in tree[1]:
                inner = self.state()
                self.empty[start].append(inner)
                self.empty[self.add(x, inner)].append(end)
            return end
        _, inner_tree, low, high = tree
        for _ in range(low):
            start = self.add(("cat", [inner_tree]), start)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[start] += [loop]
            self.empty[loop].append(end)
            self.empty[self.add(("cat", [inner_tree]), loop)].append(loop)
            return end
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            inner = self.state()
            self.empty[start].append(inner)
            start = self.add(("cat", [inner_tree]), inner)
        self.empty[start].append(end)
        return end


class Dfa:
    """Transition arrays of a minimal automaton; state 0 starts, `dead` (or -1) never accepts.

    table: int32 of states x 256.  accepts: for each state, the numbers of the
    rules that end there.
    """

    def __init__(self, table: np.ndarray, accepts: list[tuple[int, ...]]):
        self.table, self.accepts = table, accepts
        own = [s for s in range(len(accepts)) if not accepts[s] and (table[s] == s).all()]
        self.dead = own[0] if own else -1

    def longest(self, data: bytes, start: int, stop: int) -> int:
        """The end of the longest match from start on; -1 without one."""
        state, best, table, accepts, dead = 0, start if self.accepts[0] else -1, self.table, self.accepts, self.dead
        for i in range(start, stop):
            state = table[state, data[i]]
            if state == dead:
                break
            if accepts[state]:
                best = i + 1
        return best

    def shortest(self, data: bytes, start: int, stop: int) -> int:
        """The end of the shortest match from start on; -1 without one."""
        state, table, accepts = 0, self.table, self.accepts
        for i in range(start, stop):
            if accepts[state]:
                return i
            state = table[state, data[i]]
        return stop if accepts[state] else -1


def build(trees: list, search: bool = False) -> Dfa:
    """One minimal automaton for all trees.  search: a match may begin at any byte."""
    nfa = _Nfa()
    root, ends = nfa.state(), {}
    for k, tree in enumerate(trees):
        inner = nfa.state()
        nfa.empty[root].append(inner)
        ends[nfa.add(tree, inner)] = k

    def closed(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.byte[s] or s in ends)

    # Bytes that no set tells apart share a class.
    sets = {b[0] for b in nfa.byte if b}
    classes: dict[tuple, list[int]] = defaultdict(list)
    for byte in range(256):
        classes[tuple(byte in s for s in sets)].append(byte)
    groups = list(classes.values())
    first = closed([root])
    numbers, order, moves = {first: 0}, [first], []
    for states in order:
        row = []
        for group in groups:
            reached = {b[1] for s in states if (b := nfa.byte[s]) and group[0] in b[0]}
            target = closed(reached | ({root} if search else set()))
            if target not in numbers:
                numbers[target] = len(order)
                order.append(target)
            row.append(numbers[target])
        moves.append(row)
    accepts = [tuple(sorted({ends[s] for s in states if s in ends})) for states in order]

    # Moore's refinement: states stay together while no step tells them apart.
    table = np.array(moves)
    _, part = np.unique(np.array([hash(a) for a in accepts]), return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)
        if finer.max() == part.max():
            break
        part = finer
    renamed, states = {}, []
    todo = [0]
    while todo:  # breadth first, so state 0 starts
        s = todo.pop(0)
        if part[s] not in renamed:
            renamed[part[s]] = len(states)
            states.append(s)
            todo += table[s].tolist()
    full = np.zeros((len(states), 256), np.int32)
    for k, s in enumerate(states):
        for group, target in zip(groups, table[s], strict=True):
            full[k, group] = renamed[part[target]]
    return Dfa(full, [accepts[s] for s in states])

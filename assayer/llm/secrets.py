"""Secret scans with one deterministic automaton for all rules.

The reversed regexes of all rules are compiled together by subset construction
and minimised into one transition array.  A text's bytes pass through it once,
from the last to the first: at a byte where it accepts, matches of the accepted
rules begin, whole ones, so nothing is ever begun in vain and time is linear in
the text, whatever it holds.  From the leftmost beginning that a rule's earlier
match leaves free, the rule's own transition array runs to the longest end,
over the match's bytes alone; a match that is too short is dropped but still
takes its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import automata
from assayer.llm.common import mapped, slices, table


@dataclass(frozen=True)
class SecretRule:
    """length: characters of a match at least.  lead: what a match begins with, up to its value's first character; value_length: the value's characters at least."""

    kind: str
    pattern: str
    length: int = 0
    lead: str = ""
    value_length: int = 0


_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]"
BASE = (
    SecretRule("assign", f"{_ASSIGN}{_VALUE}+", lead=_ASSIGN + _VALUE, value_length=6),
    SecretRule("access", r"AKIA[A-Z0-9]+", length=20),
    SecretRule("hex", r"[0-9a-f]{24,}"),  # a shorter run of its own would be dropped whole
)
#: Public formats that the base rules don't cover.
MORE = (
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", length=30),
    SecretRule("pem", r"-----BEGIN\x20([A-Z0-9]+\x20)*PRIVATE\x20KEY-----"),
    SecretRule("git_token", r"gh[pousr]_[A-Za-z0-9]+", length=40),
    SecretRule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", length=15),
)
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: tuple[SecretRule, ...] = RULES):
        self.rules = rules
        self.combined = automata.build([automata.reverse(automata.parse(r.pattern)) for r in rules], search=True)
        self.ahead = [automata.build([automata.parse(r.pattern)]) for r in rules]
        self.lead = [automata.build([automata.parse(r.lead)]) if r.lead else None for r in rules]
        self._rows: list | None = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    def _linked(self) -> list:
        """The start state; a state is a list of its 256 successors and, last, the rules whose matches begin in it."""
        if self._rows is None:
            rows: list[list] = [[] for _ in self.combined.accepts]
            for row, targets, ends in zip(rows, self.combined.table.tolist(), self.combined.accepts, strict=True):
                row += [rows[t] for t in targets]
                row.append(ends)
            self._rows = rows[0]
        return self._rows

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and then by rule."""
        row, last, begins = self._linked(), len(data) - 1, []
        for back, byte in enumerate(reversed(data)):
            row = row[byte]
            if row[256]:
                begins.append((last - back, row[256]))
        found, free = [], [0] * len(self.rules)
        for at, rules in reversed(begins):
            for k in rules:
                if at < free[k]:
                    continue
                rule, end = self.rules[k], self.ahead[k].longest(data, at, len(data))
                free[k] = end
                if end - at < rule.length or (rule.value_length and end - self.lead[k].shortest(data, at, end) + 1 < rule.value_length):
                    continue
                found.append((at, k, end))
        return found

    def scan(self, text: str | None) -> list[tuple[int, str, int]]:
        """(start, kind, end) in code points."""
        data = (text or "").encode("utf-8", "surrogatepass")
        found = self.spans(data)
        if len(data) != len(text or ""):
            points = sorted({p for s, _, e in found for p in (s, e)})
            at, number, code = 0, 0, {}
            for p in points:
                number += len(data[at:p].decode("utf-8", "surrogatepass"))
                at, code[p] = p, number
            found = [(code[s], k, code[e]) for s, k, e in found]
        return [(s, self.rules[k].kind, e) for s, k, e in found]


def _mapped(df: DataFrame, scanner: Scanner, schema: str, one: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [one(r, scanner) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    return mapped(df, run, schema)


def find_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and secrets, an array of (kind, start, end) by start and then by the rules' order.

    Places are code points and ends exclusive.  A null or empty text has no
    secrets; null ids, repeated rows and further columns are kept apart; an
    empty table gives an empty result.  Very long texts take time in proportion.
    """

    def one(row: dict, scanner: Scanner) -> dict:
        return {"doc_id": row["doc_id"], "secrets": [{"kind": k, "start": s, "end": e} for s, k, e in scanner.scan(row["text"])]}

    kind = dict(docs.dtypes)[doc_id]
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _mapped(own, Scanner(rules), f"doc_id {kind}, secrets array<struct<kind: string, start: bigint, end: bigint>>", one)


def redact(text: str | None, found: list[tuple[int, str, int]]) -> str | None:
    """The text with every span, overlapping ones together, replaced by its first kind in brackets."""
    if not found:
        return text
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, text: str = "text") -> DataFrame:
    """All rows and columns, with the secrets of the text replaced."""
    scanner = Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            k = b.schema.get_field_index(text)
            texts = b.column(k).to_pylist()
            new = [redact(t, scanner.scan(t)) for t in texts]
            yield b.set_column(k, b.schema.field(k), pa.array(new, b.schema.field(k).type))

    return mapped(docs, run, docs.schema)


def op3_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"].isin([r.kind for r in BASE]))
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed("secrets").alias("spans")
    )


def brute_force(text: str | None, rules=RULES) -> list[tuple[int, str, int]]:
    """The same spans by Python's re, one rule after the other; for tests."""
    import re

    found = []
    for n, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or ""):
            value = m.end() - re.match(r.lead, m[0]).end() - m.start() + 1 if r.lead else 0
            if m.end() - m.start() >= r.length and value >= r.value_length:
                found.append((m.start(), n, m.end()))
    return [(s, rules[n].kind, e) for s, n, e in sorted(found)]


def digest(found: list[tuple[int, str, int]]) -> str:
    kinds = [r.kind for r in BASE]
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, k, e in found if k in kinds).encode()).hexdigest()

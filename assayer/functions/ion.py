"""Ion text: values, reader, writer and equivalence.

A value is an Element: its type, its Python value and its annotations.

==============  =======================================================
type            value (None for a null of the type)
==============  =======================================================
null            None
bool, int       bool, int
float           float
decimal         Decimal (keeps trailing zeros and the sign of zero)
timestamp       Timestamp
string, symbol  str
blob, clob      bytes
list, sexp      list of Element
struct          list of (name, Element); names may repeat
==============  =======================================================
"""

from __future__ import annotations

import base64
import datetime as dt
import math
import re
import sys
import threading
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Context, Decimal

TYPES = ("null", "bool", "int", "float", "decimal", "timestamp", "string", "symbol", "blob", "clob", "list", "sexp", "struct")
EXACT = Context(prec=100_000, Emax=999_999_999, Emin=-999_999_999)


class IonError(ValueError):
    """A text that isn't Ion."""


@dataclass(frozen=True)
class Timestamp:
    """precision: year, month, day, minute, second or fraction.  offset: minutes, None if unknown."""

    year: int
    month: int = 1
    day: int = 1
    hour: int = 0
    minute: int = 0
    second: int = 0
    fraction: str = ""
    offset: int | None = None
    precision: str = "year"

    def __post_init__(self):
        if self.precision not in ("year", "month", "day", "minute", "second", "fraction"):
            raise IonError(f"no such precision: {self.precision}")
        try:
            dt.datetime(self.year, self.month, self.day, self.hour, self.minute, self.second)
        except ValueError as e:
            raise IonError(str(e)) from e
        if self.offset is not None and abs(self.offset) >= 1440:
            raise IonError("offset of a day or more")

    def instant(self) -> tuple[int, Decimal]:
        """(seconds from year 1 in UTC, fraction): orders timestamps."""
        base = dt.datetime(self.year, self.month, self.day, self.hour, self.minute, self.second) - dt.datetime(1, 1, 1)
        return base.days * 86400 + base.seconds - 60 * (self.offset or 0), Decimal("0." + (self.fraction or "0"))

    def digits(self) -> int:
        """The precision as a number: year -4, month -3, day -2, minute -1, second 0, then the fraction's digits."""
        return {"year": -4, "month": -3, "day": -2, "minute": -1, "second": 0}.get(self.precision, len(self.fraction))

    def __str__(self) -> str:
        out = f"{self.year:04}"
        if self.precision == "year":
            return out + "T"
        out += f"-{self.month:02}"
        if self.precision == "month":
            return out + "T"
        out += f"-{self.day:02}"
        if self.precision == "day":
            return out
        out += f"T{self.hour:02}:{self.minute:02}"
        if self.precision in ("second", "fraction"):
            out += f":{self.second:02}" + (f".{self.fraction}" if self.fraction else "")
        if self.offset is None:
            return out + "-00:00"
        if self.offset == 0:
            return out + "Z"
        return out + f"{'-' if self.offset < 0 else '+'}{abs(self.offset) // 60:02}:{abs(self.offset) % 60:02}"


_STAMP = re.compile(r"(\d{4})(?:T|-(\d\d)(?:T|-(\d\d)(?:T?$|T(?:(\d\d):(\d\d)(?::(\d\d)(?:\.(\d+))?)?(Z|[+-]\d\d:\d\d))?$)))")


def parse_timestamp(text: str) -> Timestamp:
    m = _STAMP.match(text)
    if not m or m.end() != len(text):
        raise IonError(f"not a timestamp: {text}")
    year, month, day, hour, minute, second, fraction, zone = m.groups()
    precision = "fraction" if fraction else "second" if second else "minute" if hour else "day" if day else "month" if month else "year"
    offset = None
    if zone == "Z":
        offset = 0
    elif zone and zone != "-00:00":
        h, mi = int(zone[1:3]), int(zone[4:6])
        if mi > 59:
            raise IonError(f"not an offset: {zone}")
        offset = (h * 60 + mi) * (-1 if zone[0] == "-" else 1)
    if not int(year):
        raise IonError("year 0")
    return Timestamp(int(year), int(month or 1), int(day or 1), int(hour or 0), int(minute or 0), int(second or 0), fraction or "", offset, precision)


@dataclass(frozen=True)
class Element:
    type: str
    value: object = None
    annotations: tuple[str, ...] = ()

    @property
    def is_null(self) -> bool:
        return self.value is None

    def plain(self) -> Element:
        return Element(self.type, self.value) if self.annotations else self

    def get(self, name: str) -> Element | None:
        """The last field of the name, of a struct."""
        return next((v for k, v in reversed(self.value or []) if k == name), None)

    def fields(self, name: str) -> list[Element]:
        return [v for k, v in self.value or [] if k == name]

    def key(self) -> tuple:
        """Equal for equivalent values, annotations included."""
        return (self.annotations, *self.data())

    def data(self) -> tuple:
        """Equal for values that are equivalent but for their own annotations."""
        v = self.value
        if v is None:
            return (self.type, None)
        if self.type == "float":
            return ("float", "nan") if math.isnan(v) else ("float", v, math.copysign(1, v))
        if self.type == "decimal":
            return ("decimal", *v.as_tuple())
        if self.type in ("list", "sexp"):
            return (self.type, tuple(x.key() for x in v))
        if self.type == "struct":
            return ("struct", tuple(sorted(((k, x.key()) for k, x in v), key=repr)))
        return (self.type, v)

    def __str__(self) -> str:
        return write(self)


# ---- reading

_SPACE = re.compile(r"(?:[ \t\n\r\v\f]|//[^\n\r]*|/\*(?s:.*?)\*/)*")
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*")
_OPERATOR = re.compile(r"[!#%&*+\-./;<=>?@^`|~]+")
_NUMBER = re.compile(r"[+-]?[0-9][0-9A-Za-z_.:+-]*")
_INT = re.compile(r"-?(?:0|[1-9](?:_?[0-9])*)$")
_HEX = re.compile(r"-?0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*$")
_BITS = re.compile(r"-?0[bB][01](?:_?[01])*$")
_REAL = re.compile(r"(-?(?:0|[1-9](?:_?[0-9])*))(?:\.((?:[0-9](?:_?[0-9])*)?))?(?:([eEdD])([+-]?[0-9]+))?$")
_ESCAPE = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "f": "\f", "r": "\r", "v": "\v", '"': '"', "'": "'", "?": "?", "\\": "\\", "/": "/"}
_DELIMITER = set(" \t\n\r\v\f{}[](),\"'/")
_SYMBOL_ID = re.compile(r"\$[0-9]+$")
_VERSION = re.compile(r"\$ion_[0-9]+_[0-9]+$")


class _Reader:
    def __init__(self, text: str):
        self.s, self.i = text, 0

    def fail(self, what: str) -> IonError:
        line = self.s.count("\n", 0, self.i) + 1
        return IonError(f"{what} at line {line}: {self.s[self.i : self.i + 20]!r}")

    def skip(self) -> str:
        self.i = _SPACE.match(self.s, self.i).end()
        return self.s[self.i : self.i + 1]

    def all(self) -> list[Element]:
        out = []
        while self.skip():
            e = self.value()
            if not (e.type == "symbol" and not e.annotations and e.value and _VERSION.match(e.value)):
                out.append(e)
        return out

    def escaped(self, clob: bool) -> str:
        c = self.s[self.i : self.i + 1]
        self.i += 1
        if c in "xuU" and c:
            n = {"x": 2, "u": 4, "U": 8}[c]
            digits = self.s[self.i : self.i + n]
            if clob and c != "x" or not re.fullmatch(f"[0-9a-fA-F]{{{n}}}", digits):
                raise self.fail("bad escape")
            self.i += n
            return chr(int(digits, 16))
        if c == "\n":
            return ""
        if c == "\r":
            self.i += self.s[self.i : self.i + 1] == "\n"
            return ""
        if c not in _ESCAPE or not c:
            raise self.fail("bad escape")
        return _ESCAPE[c]

    def quoted(self, end: str, clob: bool = False) -> str:
        out, s = [], self.s
        while True:
            if self.i >= len(s):
                raise self.fail("unclosed text")
            if s.startswith(end, self.i):
                self.i += len(end)
                return re.sub("[\ud800-\udbff][\udc00-\udfff]", lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), "".join(out))
            c = s[self.i]
            self.i += 1
            if c == "\\":
                out.append(self.escaped(clob))
            elif c in "\n\r" and len(end) == 1:
                raise self.fail("line end in a text")
            elif c == "\r":  # line ends in long texts are \n
                self.i += s[self.i : self.i + 1] == "\n"
                out.append("\n")
            elif clob and ord(c) > 127:
                raise self.fail("character outside ASCII in a clob")
            else:
                out.append(c)

    def long(self, clob: bool = False) -> str:
        """One or more '''texts''' in a row."""
        out = []
        while self.s.startswith("'''", self.i):
            self.i += 3
            out.append(self.quoted("'''", clob))
            here = self.i
            self.skip()
            if not self.s.startswith("'''", self.i):
                self.i = here
        return "".join(out)

    def value(self, sexp: bool = False) -> Element:
        notes: list[str] = []
        while True:
            c = self.skip()
            if not c:
                raise self.fail("a value is missing")
            if c == "'" and not self.s.startswith("'''", self.i):
                self.i += 1
                name, bare = self.quoted("'"), False
            elif m := _NAME.match(self.s, self.i):
                if self.s.startswith(("nan", "null", "true", "false"), self.i) and not self.mark(m.end()):
                    break
                self.i = m.end()
                name, bare = m[0], True
            else:
                break
            after = self.i
            if self.mark(self.i):
                self.i = self.s.index("::", self.i) + 2
                notes.append(self.symbol(name, bare))
                continue
            self.i = after
            return Element("symbol", self.symbol(name, bare), tuple(notes))
        return Element(*self.bare(c, sexp), tuple(notes))

    def symbol(self, name: str, bare: bool) -> str:
        if bare and _SYMBOL_ID.match(name) and name != "$0":
            raise self.fail(f"unknown symbol {name}")
        return name

    def mark(self, at: int) -> bool:
        return self.s.startswith("::", _SPACE.match(self.s, at).end())

    def bare(self, c: str, sexp: bool) -> tuple[str, object]:
        s = self.s
        if c == '"':
            self.i += 1
            return "string", self.quoted('"')
        if c == "'":
            return "string", self.long()
        if s.startswith("{{", self.i):
            self.i += 2
            return self.lob()
        if c in "[(":
            self.i += 1
            return ("list", self.items("]", ",")) if c == "[" else ("sexp", self.items(")", ""))
        if c == "{":
            self.i += 1
            return "struct", self.struct()
        if m := _NAME.match(s, self.i):
            self.i = m.end()
            if m[0] == "null":
                if s.startswith(".", self.i) and (t := _NAME.match(s, self.i + 1)):
                    if t[0] not in TYPES:
                        raise self.fail("no such null")
                    self.i = t.end()
                    return t[0], None
                return "null", None
            if m[0] in ("true", "false"):
                return "bool", m[0] == "true"
            if m[0] == "nan":
                return "float", math.nan
            return "symbol", m[0]
        if m := re.compile(r"[+-]inf(?![A-Za-z0-9_$])").match(s, self.i):
            self.i = m.end()
            return "float", math.inf if m[0][0] == "+" else -math.inf
        if (m := _NUMBER.match(s, self.i)) and m[0][0] != "+":
            return self.number(m)
        if sexp and (m := _OPERATOR.match(s, self.i)):
            self.i = m.end()
            return "symbol", m[0]
        raise self.fail("unexpected text")

    def number(self, m: re.Match) -> tuple[str, object]:
        text = m[0]
        end = m.end()
        if end < len(self.s) and self.s[end] not in _DELIMITER:
            raise self.fail("bad number")
        if _INT.match(text):
            out = "int", int(text.replace("_", ""))
        elif _HEX.match(text):
            out = "int", int(text.replace("_", ""), 16)
        elif _BITS.match(text):
            out = "int", int(text.replace("_", ""), 2)
        elif r := _REAL.match(text):
            whole, part, mark, power = r.groups()
            digits = whole.replace("_", "") + (f".{part.replace('_', '')}" if part else "")
            if mark and mark in "eE":
                out = "float", float(f"{digits}e{power}")
            else:
                out = "decimal", EXACT.create_decimal(f"{digits}E{power or 0}")
        else:
            out = "timestamp", parse_timestamp(text)
        self.i = end
        return out

    def lob(self) -> tuple[str, object]:
        c = self.skip()
        if c == '"' or self.s.startswith("'''", self.i):
            if c == '"':
                self.i += 1
                text = self.quoted('"', clob=True)
            else:
                text = self.long(clob=True)
            kind, value = "clob", text.encode("latin-1")
        else:
            end = self.s.find("}}", self.i)
            if end < 0:
                raise self.fail("unclosed blob")
            try:
                value = base64.b64decode(re.sub(r"\s", "", self.s[self.i : end]), validate=True)
            except ValueError as e:
                raise self.fail("bad base64") from e
            kind, self.i = "blob", end
        self.skip()
        if not self.s.startswith("}}", self.i):
            raise self.fail("unclosed lob")
        self.i += 2
        return kind, value

    def items(self, end: str, comma: str) -> list[Element]:
        out = []
        while True:
            c = self.skip()
            if c == end:
                self.i += 1
                return out
            out.append(self.value(sexp=not comma))
            c = self.skip()
            if comma and c == comma:
                self.i += 1
            elif comma and c != end:
                raise self.fail("a comma is missing")

    def struct(self) -> list[tuple[str, Element]]:
        out = []
        while True:
            c = self.skip()
            if c == "}":
                self.i += 1
                return out
            if c == '"':
                self.i += 1
                name = self.quoted('"')
            elif self.s.startswith("'''", self.i):
                name = self.long()
            elif c == "'":
                self.i += 1
                name = self.quoted("'")
            elif m := _NAME.match(self.s, self.i):
                self.i = m.end()
                name = self.symbol(m[0], True)
            else:
                raise self.fail("a field name is missing")
            if self.skip() != ":" or self.s.startswith("::", self.i):
                raise self.fail("a colon is missing")
            self.i += 1
            out.append((name, self.value()))
            c = self.skip()
            if c == ",":
                self.i += 1
            elif c != "}":
                raise self.fail("a comma is missing")


#: Containers in each other that are read, validated and written at most.
DEEPEST = 100_000
#: Bytes of such a stack; only what is used is taken.
STACK = 1 << 30
_LOCK = threading.Lock()
_deep = threading.local()


def deeply(f):
    """f(), which may recurse a few frames for each of DEEPEST levels: if the usual stack is too small, in a thread with a large one.  IonError beyond that."""
    try:
        return f()
    except RecursionError:
        if getattr(_deep, "inside", False):
            raise
    out: list = []

    def run() -> None:
        _deep.inside = True
        try:
            out.append((f(), None))
        except RecursionError:
            out.append((None, IonError(f"nested deeper than {DEEPEST}")))
        except BaseException as e:  # noqa: BLE001
            out.append((None, e))

    with _LOCK:
        limit, size = sys.getrecursionlimit(), threading.stack_size(STACK)
        sys.setrecursionlimit(12 * DEEPEST)
        try:
            thread = threading.Thread(target=run)
            thread.start()
            thread.join()
        finally:
            threading.stack_size(size)
            sys.setrecursionlimit(limit)
    value, error = out[0]
    if error is not None:
        raise error
    return value


def read_all(text: str) -> list[Element]:
    """The top-level values of an Ion text."""
    return deeply(lambda: _Reader(text).all())


def read_one(text: str) -> Element:
    found = read_all(text)
    if len(found) != 1:
        raise IonError(f"expected a single value, found {len(found)}")
    return found[0]


# ---- writing

_WORDS = {"null", "true", "false", "nan"}


def _escape(text: str, quote: str) -> str:
    names = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": "\\\\", quote: "\\" + quote}
    return "".join(names.get(c) or (c if c.isprintable() else f"\\U{ord(c):08x}" if ord(c) > 0xFFFF else f"\\u{ord(c):04x}") for c in text)


def symbol(text: str) -> str:
    return text if _NAME.fullmatch(text) and text not in _WORDS and not _SYMBOL_ID.match(text) else f"'{_escape(text, chr(39))}'"


def _decimal(d: Decimal) -> str:
    sign, digits, power = d.as_tuple()
    text = "".join(map(str, digits))
    if power == 0:
        text += "."
    elif -40 <= power < 0:
        text = text.rjust(1 - power, "0")
        text = f"{text[:power]}.{text[power:]}"
    else:
        text += f"d{power}"
    return "-" * sign + text


def write(e: Element) -> str:
    """The value as Ion text."""
    return deeply(lambda: _write(e))


def _write(e: Element) -> str:
    notes = "".join(f"{symbol(a)}::" for a in e.annotations)
    v = e.value
    if v is None:
        return notes + ("null" if e.type == "null" else f"null.{e.type}")
    if e.type == "bool":
        text = "true" if v else "false"
    elif e.type == "float":
        text = "nan" if math.isnan(v) else ("+inf" if v > 0 else "-inf") if math.isinf(v) else repr(v) if "e" in repr(v) else f"{v!r}e0"
    elif e.type == "decimal":
        text = _decimal(v)
    elif e.type == "string":
        text = f'"{_escape(v, chr(34))}"'
    elif e.type == "symbol":
        text = symbol(v)
    elif e.type == "blob":
        text = f"{{{{{base64.b64encode(v).decode()}}}}}"
    elif e.type == "clob":
        body = "".join(chr(b) if 32 <= b < 127 and b not in (34, 92) else f"\\x{b:02x}" for b in v)
        text = f'{{{{"{body}"}}}}'
    elif e.type == "list":
        text = "[" + ", ".join(map(_write, v)) + "]"
    elif e.type == "sexp":
        text = "(" + " ".join(map(_write, v)) + ")"
    elif e.type == "struct":
        text = "{" + ", ".join(f"{symbol(k)}: {_write(x)}" for k, x in v) + "}"
    else:
        text = str(v)
    return notes + text


def from_python(value: object) -> Element:
    """An Element of a Python value, as builders take them."""
    if isinstance(value, Element):
        return value
    if value is None:
        return Element("null")
    if isinstance(value, bool):
        return Element("bool", value)
    if isinstance(value, int):
        return Element("int", value)
    if isinstance(value, float):
        return Element("float", value)
    if isinstance(value, Decimal):
        return Element("decimal", value)
    if isinstance(value, Timestamp):
        return Element("timestamp", value)
    if isinstance(value, str):
        return Element("string", value)
    if isinstance(value, bytes):
        return Element("blob", value)
    if isinstance(value, dict):
        return Element("struct", [(k, from_python(v)) for k, v in value.items()])
    if isinstance(value, Iterable):
        return Element("list", [from_python(v) for v in value])
    raise TypeError(f"no Ion value for {type(value)}")

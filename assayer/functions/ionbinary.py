"""Ion's binary form: reader and writer of whole streams.

Local symbol tables are read and written; symbols of shared tables that a stream
imports have no text here and are shown by their numbers.
"""

from __future__ import annotations

import math
import struct
from datetime import datetime, timedelta
from decimal import Decimal

from assayer.functions.ion import EXACT, Element, IonError, Timestamp, read_all

MARKER = b"\xe0\x01\x00\xea"
#: Fixed by the format: symbols 1 to 9, and the type codes of descriptors.
SYSTEM = ("$ion", "$ion_1_0", "$ion_symbol_table", "name", "version", "imports", "symbols", "max_id", "$ion_shared_symbol_table")
KINDS = ("null", "bool", "int", "int", "float", "decimal", "timestamp", "symbol", "string", "clob", "blob", "list", "sexp", "struct")


def read_any(data: bytes | str) -> list[Element]:
    """The values of a stream in either form."""
    if isinstance(data, str):
        return read_all(data)
    if data[:4] == MARKER:
        return _Reader(data).stream()
    try:
        return read_all(data.decode())
    except UnicodeDecodeError as e:
        raise IonError(str(e)) from e


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.symbols = data, list(SYSTEM)

    def stream(self) -> list[Element]:
        out, at = [], 0
        while at < len(self.data):
            if self.data[at] == 0xE0:
                if self.data[at : at + 4] != MARKER:
                    raise IonError("another version of the binary form")
                self.symbols, at = list(SYSTEM), at + 4
                continue
            value, at = self.value(at, len(self.data))
            if value is None:
                continue
            if value.type == "struct" and value.annotations[:1] == ("$ion_symbol_table",):
                self.table(value)
            else:
                out.append(value)
        return out

    def table(self, e: Element) -> None:
        imports, symbols = e.get("imports"), e.get("symbols")
        if not (imports and imports.type == "symbol" and imports.value == "$ion_symbol_table"):
            self.symbols = list(SYSTEM)
        for one in imports.value if imports and imports.type == "list" and imports.value else []:
            size = one.get("max_id")
            self.symbols += [None] * (size.value if size and size.type == "int" and size.value else 0)
        for s in symbols.value if symbols and symbols.type == "list" and symbols.value else []:
            self.symbols.append(s.value if s.type == "string" else None)

    def text(self, number: int) -> str:
        if number > len(self.symbols):
            raise IonError(f"no symbol {number}")
        found = self.symbols[number - 1] if number else None
        return f"${number}" if found is None else found

    def unsigned(self, at: int) -> tuple[int, int]:
        out = 0
        while True:
            if at >= len(self.data):
                raise IonError("the stream ends within a value")
            byte = self.data[at]
            out, at = out << 7 | byte & 0x7F, at + 1
            if byte & 0x80:
                return out, at

    def signed(self, at: int) -> tuple[int, bool, int]:
        """Magnitude, whether it is negative (so is -0), and where it ends."""
        if at >= len(self.data):
            raise IonError("the stream ends within a value")
        first = self.data[at]
        out, at, more = first & 0x3F, at + 1, not first & 0x80
        while more:
            if at >= len(self.data):
                raise IonError("the stream ends within a value")
            out, more, at = out << 7 | self.data[at] & 0x7F, not self.data[at] & 0x80, at + 1
        return out, bool(first & 0x40), at

    def decimal(self, at: int, end: int) -> Decimal:
        if at == end:
            return Decimal(0)
        size, negative, at = self.signed(at)
        raw = self.data[at:end]
        sign, number = (raw[0] >> 7, int.from_bytes(bytes([raw[0] & 0x7F]) + raw[1:])) if raw else (0, 0)
        return EXACT.create_decimal((sign, tuple(map(int, str(number))), -size if negative else size))

    def timestamp(self, at: int, end: int) -> Timestamp:
        minutes, negative, at = self.signed(at)
        offset = None if negative and not minutes else -minutes if negative else minutes
        parts = []
        while at < end and len(parts) < 6:
            x, at = self.unsigned(at)
            parts.append(x)
        fraction = ""
        if at < end:
            d = self.decimal(at, end)
            if d.as_tuple().exponent < 0:
                fraction = f"{int(d.scaleb(-d.as_tuple().exponent, EXACT)):0{-d.as_tuple().exponent}}"
        precision = "fraction" if fraction else {1: "year", 2: "month", 3: "day", 5: "minute", 6: "second"}.get(len(parts))
        if precision is None:
            raise IonError("a timestamp of an odd number of parts")
        if len(parts) > 3 and offset:
            try:
                local = datetime(*parts) + timedelta(minutes=offset)
            except (ValueError, OverflowError) as e:
                raise IonError(str(e)) from e
            parts = [local.year, local.month, local.day, local.hour, local.minute, local.second][: len(parts)]
        names = ("year", "month", "day", "hour", "minute", "second")
        return Timestamp(**dict(zip(names, parts, strict=False)), fraction=fraction, offset=offset if len(parts) > 3 else None, precision=precision)

    def value(self, at: int, stop: int) -> tuple[Element | None, int]:
        """The value, or None for padding, and where it ends."""
        kind, size = self.data[at] >> 4, self.data[at] & 15
        at += 1
        if kind == 15:
            raise IonError("a reserved type code")
        if size == 15 and kind != 14:
            return Element(KINDS[kind]), at
        if kind == 1:
            if size > 1:
                raise IonError("a bool is 0 or 1")
            return Element("bool", bool(size)), at
        if size == 14 or kind == 13 and size == 1:
            size, at = self.unsigned(at)
        end = at + size
        if end > stop:
            raise IonError("a value is longer than what holds it")
        raw = self.data[at:end]
        if kind == 0:
            return None, end
        if kind in (2, 3):
            return Element("int", int.from_bytes(raw) * (1 if kind == 2 else -1)), end
        if kind == 4:
            if size not in (0, 4, 8):
                raise IonError("a float has 0, 4 or 8 bytes")
            return Element("float", struct.unpack(">f" if size == 4 else ">d", raw)[0] if size else 0.0), end
        if kind == 5:
            return Element("decimal", self.decimal(at, end)), end
        if kind == 6:
            return Element("timestamp", self.timestamp(at, end)), end
        if kind == 7:
            return Element("symbol", self.text(int.from_bytes(raw))), end
        if kind == 8:
            try:
                return Element("string", raw.decode()), end
            except UnicodeDecodeError as e:
                raise IonError(str(e)) from e
        if kind in (9, 10):
            return Element(KINDS[kind], raw), end
        if kind == 14:
            length, at = self.unsigned(at)
            notes, last = [], at + length
            while at < last:
                number, at = self.unsigned(at)
                notes.append(self.text(number))
            inner, at = self.value(at, end)
            if inner is None or at != end or inner.annotations:
                raise IonError("annotations stand before one value")
            return Element(inner.type, inner.value, tuple(notes)), end
        items: list = []
        while at < end:
            if kind == 13:
                number, at = self.unsigned(at)
            inner, at = self.value(at, end)
            if inner is not None:
                items.append((self.text(number), inner) if kind == 13 else inner)
        return Element(KINDS[kind], items), end


class _Writer:
    def __init__(self):
        self.symbols = {s: k for k, s in enumerate(SYSTEM, 1)}

    def number(self, text: str) -> int:
        return self.symbols.setdefault(text, len(self.symbols) + 1)

    def unsigned(self, x: int) -> bytes:
        out = [x & 0x7F | 0x80]
        while x := x >> 7:
            out.append(x & 0x7F)
        return bytes(reversed(out))

    def signed(self, x: int, negative: bool) -> bytes:
        groups = [x & 0x7F]
        while x := x >> 7:
            groups.append(x & 0x7F)
        if groups[-1] > 0x3F:
            groups.append(0)
        groups[-1] |= 0x40 * negative
        groups[0] |= 0x80
        return bytes(reversed(groups))

    def integer(self, x: int, negative: bool) -> bytes:
        if not x and not negative:
            return b""
        raw = x.to_bytes(x.bit_length() // 8 + 1)
        return bytes([raw[0] | 0x80 * negative]) + raw[1:]

    def sized(self, kind: int, body: bytes) -> bytes:
        if len(body) < 14 and not (kind == 13 and len(body) == 1):
            return bytes([kind << 4 | len(body)]) + body
        return bytes([kind << 4 | 14]) + self.unsigned(len(body)) + body

    def decimal(self, d: Decimal) -> bytes:
        sign, digits, exponent = d.as_tuple()
        return self.signed(abs(exponent), exponent < 0) + self.integer(int("".join(map(str, digits))), bool(sign))

    def timestamp(self, t: Timestamp) -> bytes:
        fields = {"year": 1, "month": 2, "day": 3, "minute": 5}.get(t.precision, 6)
        moment = datetime(t.year, t.month, t.day, t.hour, t.minute, t.second)
        if fields > 3 and t.offset:
            moment -= timedelta(minutes=t.offset)
        parts = (moment.year, moment.month, moment.day, moment.hour, moment.minute, moment.second)[:fields]
        out = self.signed(abs(t.offset or 0), t.offset is None or t.offset < 0) + b"".join(map(self.unsigned, parts))
        return out + (self.signed(len(t.fraction), True) + self.integer(int(t.fraction), False) if t.fraction else b"")

    def value(self, e: Element) -> bytes:
        if e.annotations:
            notes = b"".join(self.unsigned(self.number(a)) for a in e.annotations)
            return self.sized(14, self.unsigned(len(notes)) + notes + self.value(e.plain()))
        kind = KINDS.index(e.type)
        if e.is_null:
            return bytes([kind << 4 | 15])
        v = e.value
        if e.type == "bool":
            return bytes([0x10 | v])
        if e.type == "int":
            return self.sized(3 if v < 0 else 2, abs(v).to_bytes((abs(v).bit_length() + 7) // 8))
        if e.type == "float":
            return self.sized(4, b"" if v == 0 and math.copysign(1, v) > 0 else struct.pack(">d", v))
        if e.type == "decimal":
            return self.sized(5, self.decimal(v))
        if e.type == "timestamp":
            return self.sized(6, self.timestamp(v))
        if e.type == "symbol":
            n = self.number(v)
            return self.sized(7, n.to_bytes((n.bit_length() + 7) // 8))
        if e.type == "string":
            return self.sized(8, v.encode("utf-8", "surrogatepass"))
        if e.type in ("clob", "blob"):
            return self.sized(kind, v)
        if e.type == "struct":
            return self.sized(13, b"".join(self.unsigned(self.number(k)) + self.value(x) for k, x in v))
        return self.sized(kind, b"".join(map(self.value, v)))


def write_binary(values: list[Element]) -> bytes:
    """A stream of the values, with one local symbol table."""
    writer = _Writer()
    body = b"".join(map(writer.value, values))
    own = [Element("string", s) for s in list(writer.symbols)[len(SYSTEM) :]]
    table = Element("struct", [("symbols", Element("list", own))], ("$ion_symbol_table",))
    return MARKER + (_Writer().value(table) if own else b"") + body

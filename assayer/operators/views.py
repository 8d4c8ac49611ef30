"""How a constraint sees a value: a typed column, a whole row, a VARIANT, or a text that stands for a timestamp.

Truths are Python bools where the data type decides, else non-null boolean
Columns; ``both``, ``either`` and ``negated`` fold the former away, so a check
that a schema's types already decide leaves no trace in the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.ion import Element, Timestamp

Truth = bool | Column


def both(*parts: Truth) -> Truth:
    if any(p is False for p in parts):
        return False
    rest = [p for p in parts if p is not True]
    return reduce(lambda a, b: a & b, rest) if rest else True


def either(*parts: Truth) -> Truth:
    if any(p is True for p in parts):
        return True
    rest = [p for p in parts if p is not False]
    return reduce(lambda a, b: a | b, rest) if rest else False


def negated(p: Truth) -> Truth:
    return (not p) if isinstance(p, bool) else ~p


def column(p: Truth) -> Column:
    return F.lit(p) if isinstance(p, bool) else p


_PLAIN: ContextVar[bool] = ContextVar("plain", default=False)


def sure(c: Column) -> Column:
    """A predicate with NULL as false: results of constraints are never unknown."""
    return c if _PLAIN.get() else F.coalesce(c, F.lit(False))


@contextmanager
def plainly() -> Iterator[None]:
    """Within it predicates may be NULL: for conjunctions of a filter, which sources can then take."""
    token = _PLAIN.set(True)
    try:
        yield
    finally:
        _PLAIN.reset(token)


@dataclass(frozen=True)
class Options:
    """null_as: what NULL is for a value that is validated itself or is an element.

    typed_null (of the column's type), untyped_null, or absent.  NULL fields of
    structs and rows are absent unless null_fields says otherwise.
    decimal_scale: declared (the column's) or minimal (without trailing zeros).
    symbols, timestamps, entries: columns or fields, by name, that hold symbols,
    timestamps as text, and structs as arrays of (k, v).
    """

    null_as: str = "typed_null"
    null_fields: str = "absent"
    decimal_scale: str = "declared"
    symbols: frozenset[str] = frozenset()
    timestamps: frozenset[str] = frozenset()
    entries: frozenset[str] = frozenset()
    annotations: Column | None = field(default=None, compare=False)


_STATIC = {T.BooleanType: "bool", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "int", T.FloatType: "float", T.DoubleType: "float", T.DateType: "timestamp", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp", T.StringType: "string", T.BinaryType: "blob", T.ArrayType: "list", T.StructType: "struct", T.MapType: "struct", T.NullType: "null"}


class View:
    """annotations: an array of strings, or None where there are none."""

    annotations: Column | None = None

    def is_type(self, ion_type: str) -> Truth:
        """Of the type, nulls of it included."""
        raise NotImplementedError

    def is_null(self) -> Truth:
        raise NotImplementedError

    def is_untyped_null(self) -> Truth:
        raise NotImplementedError

    def of(self, *ion_types: str) -> Truth:
        """One of the types and not null."""
        return both(either(*[self.is_type(t) for t in ion_types]), negated(self.is_null()))


class Typed(View):
    def __init__(self, col: Column, dtype: T.DataType, options: Options, name: str = "", null_as: str | None = None):
        self.col, self.dtype, self.options, self.name = col, dtype, options, name
        self.null_as = null_as or options.null_as
        kind = _STATIC.get(type(dtype))
        if isinstance(dtype, T.DecimalType):
            kind = "decimal" if dtype.scale else "int"
        if kind is None:
            raise TypeError(f"no Ion type for {dtype.simpleString()}")
        if kind == "string" and name in options.symbols:
            kind = "symbol"
        if kind == "string" and name in options.timestamps:
            kind = "timestamp"
        if kind == "list" and name in options.entries:
            kind = "struct"
        self.kind = kind

    def is_type(self, ion_type: str) -> Truth:
        if ion_type == "null":
            return self.is_untyped_null()
        if self.kind != ion_type:
            return False
        return self.col.isNotNull() if self.null_as == "untyped_null" else True

    def is_null(self) -> Truth:
        return True if self.kind == "null" else self.col.isNull()

    def is_untyped_null(self) -> Truth:
        if self.kind == "null":
            return True
        return self.col.isNull() if self.null_as == "untyped_null" else False

    # ---- containers

    def element(self, x: Column) -> Typed:
        inner = self.dtype.elementType if isinstance(self.dtype, T.ArrayType) else self.dtype.valueType
        return Typed(x, inner, self.options)

    def size(self) -> Column:
        if isinstance(self.dtype, T.StructType):
            return reduce(lambda a, b: a + b, [column(negated(v.absent())).cast("int") for v in self.members().values()], F.lit(0))
        return F.size(self.col)

    def members(self) -> dict[str, Typed]:
        """The fields of a struct."""
        return {f.name: Typed(self.col.getField(f.name), f.dataType, self.options, f.name, self.options.null_fields) for f in self.dtype.fields}

    def absent(self) -> Truth:
        return self.is_null() if self.null_as == "absent" else False

    def sequence(self) -> Column | None:
        """The children as an array, where they are one."""
        if isinstance(self.dtype, T.MapType):
            return F.map_values(self.col)
        if self.name in self.options.entries:
            return F.transform(self.col, lambda e: e["v"])
        return self.col if isinstance(self.dtype, T.ArrayType) else None

    def child(self, x: Column) -> Typed:
        if self.name in self.options.entries:
            return Typed(x, self.dtype.elementType["v"].dataType, self.options)
        return self.element(x)

    def keys(self) -> Column | None:
        if isinstance(self.dtype, T.MapType):
            return F.map_keys(self.col)
        return F.transform(self.col, lambda e: e["k"]) if self.name in self.options.entries else None

    def field(self, name: str) -> tuple[Column | int, Callable[[Callable[[View], Truth]], Truth]]:
        """How often a field occurs, and a function that says whether all of its values pass a test."""
        if isinstance(self.dtype, T.StructType):
            v = self.members().get(name)
            if v is None:
                return 0, lambda test: True
            gone = v.absent()
            return (1 if gone is False else F.when(column(gone), 0).otherwise(1)), lambda test: either(gone, test(v))
        if isinstance(self.dtype, T.MapType):
            there = sure(F.map_contains_key(self.col, F.lit(name)))
            v = Typed(F.try_element_at(self.col, F.lit(name)), self.dtype.valueType, self.options)
            return there.cast("int"), lambda test: either(~there, test(v))
        values = F.transform(F.filter(self.col, lambda e: e["k"] == name), lambda e: e["v"])
        return F.size(values), lambda test: sure(F.forall(values, lambda x: column(test(self.child(x)))))

    def undeclared(self, names: list[str]) -> Truth:
        """Whether it has fields of other names."""
        if isinstance(self.dtype, T.StructType):
            return either(*[negated(v.absent()) for k, v in self.members().items() if k not in names])
        return sure(F.size(F.array_except(self.keys(), F.array(*[F.lit(n) for n in names]).cast("array<string>"))) > 0)

    # ---- scalars

    def text(self) -> Column:
        return self.col

    def bytes(self) -> Column:
        return self.col

    def equals(self, e: Element) -> Truth:
        """Whether it is the literal's value; nulls are handled before."""
        v, kind = e.value, self.kind
        if kind in ("int", "float", "decimal") and e.type in ("int", "float", "decimal") and not isinstance(v, bool):
            # An exact number equals a column of any number type that holds it.
            return sure(self.col == F.lit(float(v) if kind == "float" else v))
        if kind == "bool" and e.type == "bool":
            return sure(self.col == F.lit(v))
        if kind in ("string", "symbol") and e.type in ("string", "symbol"):
            return sure(self.col == F.lit(v))
        if kind == "blob" and e.type in ("blob", "clob"):
            return sure(self.col == F.lit(bytearray(v)))
        if kind == "timestamp" and e.type == "timestamp":
            return sure(self.instant() == self.at(v))
        if kind == "list" and e.type in ("list", "sexp"):
            parts = [either(self.child(F.get(self.col, F.lit(k))).equals(x)) for k, x in enumerate(v)]
            return both(sure(F.size(self.col) == len(v)), *parts)
        return False

    def number(self, text: str) -> Column:
        """A limit of a number range, in the column's own arithmetic."""
        return F.lit(text).cast("double" if self.kind == "float" else "decimal(38,18)")

    def finite(self) -> Truth:
        return ~(F.isnan(self.col) | self.col.isin(float("inf"), float("-inf"))) if self.kind == "float" else True

    def instant(self) -> Column:
        """A moment in UTC, as the column has it if it can; without an offset the local time is taken for it."""
        if self.name in self.options.timestamps:
            return F.unix_micros(F.try_to_timestamp(self.col))
        return self.col.cast("timestamp_ntz") if isinstance(self.dtype, T.DateType) else self.col

    def at(self, t: Timestamp) -> Column:
        """A moment in the type of instant()."""
        if self.name in self.options.timestamps:
            return F.lit(_micros(t))
        moment = F.timestamp_micros(F.lit(_micros(t)))
        return moment if isinstance(self.dtype, T.TimestampType) else F.to_timestamp_ntz(F.lit(_shown(t)))

    def stamp_digits(self) -> Column | int:
        if self.name in self.options.timestamps:
            part = F.regexp_extract(self.col, r"T\d\d:\d\d:\d\d\.(\d+)", 1)
            plain = F.when(self.col.rlike(r"T\d\d:\d\d:\d\d"), 0).when(self.col.rlike(r"T\d\d:\d\d"), -1).when(self.col.rlike(r"^\d{4}-\d\d-\d\d"), -2).when(self.col.rlike(r"^\d{4}-\d\d"), -3).otherwise(-4)
            return F.when(F.length(part) > 0, F.length(part)).otherwise(plain)
        if isinstance(self.dtype, T.DateType):
            return -2
        micros = (F.date_part(F.lit("SECOND"), self.col) * 1000000).cast("int") % 1000000
        out = F
        for n in range(6, 0, -1):
            out = out.when(micros % 10 ** (7 - n) != 0, n)
        return out.otherwise(0)

    def offset(self, minutes: int | None) -> Truth:
        """Whether it has the offset; NTZ columns have none, others UTC's."""
        if self.name in self.options.timestamps:
            zone = F.regexp_extract(self.col, r"(Z|[+-]\d\d:\d\d)$", 1)
            if minutes is None:
                return sure((zone == "") | (zone == "-00:00"))
            sign = "-" if minutes < 0 else "+"
            shown = [f"{sign}{abs(minutes) // 60:02}:{abs(minutes) % 60:02}"]
            return sure(zone.isin(*shown, "Z") if minutes == 0 else zone.isin(*shown))
        return minutes == (0 if isinstance(self.dtype, T.TimestampType) else None)

    def digits(self) -> Column:
        """The number of digits of the coefficient."""
        if self.options.decimal_scale == "minimal":
            text = F.regexp_replace(F.regexp_replace(self.col.cast("string"), r"(\.\d*?)0+$", "$1"), r"[-.]", "")
        else:
            text = F.regexp_replace(self.col.cast("string"), r"[-.]", "")
        return F.greatest(F.length(F.ltrim(text, F.lit("0"))), F.lit(1))

    def scale(self) -> Column | int:
        if self.options.decimal_scale == "declared":
            return self.dtype.scale
        return F.length(F.regexp_replace(F.regexp_extract(self.col.cast("string"), r"\.(\d*)$", 1), "0+$", ""))

    def float_(self) -> Column:
        return self.col.cast("double")


def _micros(t: Timestamp) -> int:
    """Microseconds from 1970 in UTC."""
    seconds, part = t.instant()
    return (seconds - 62135596800) * 1_000_000 + int(part * 1_000_000)


def _shown(t: Timestamp) -> str:
    moment = datetime(1970, 1, 1) + timedelta(microseconds=_micros(t))
    return moment.isoformat(sep=" ", timespec="microseconds")


class Row(Typed):
    """A whole row as a struct."""

    def __init__(self, schema: T.StructType, options: Options):
        super().__init__(F.lit(True), schema, options)

    def is_null(self) -> Truth:
        return False

    def members(self) -> dict[str, Typed]:
        return {f.name: Typed(F.col(f"`{f.name}`"), f.dataType, self.options, f.name, self.options.null_fields) for f in self.dtype.fields if type(f.dataType) in _STATIC or isinstance(f.dataType, T.DecimalType)}


class Variant(View):
    """A VARIANT: JSON's types, with null and absent told apart."""

    _NAMES = {"bool": "^BOOLEAN$", "int": r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))$", "decimal": r"^DECIMAL\(\d+,[1-9]\d*\)$", "float": "^(DOUBLE|FLOAT)$", "string": "^STRING$", "blob": "^BINARY$", "timestamp": "^(TIMESTAMP|TIMESTAMP_NTZ|DATE)$", "list": "^ARRAY<", "struct": "^OBJECT<"}

    def __init__(self, col: Column, options: Options):
        self.col, self.options = col, options

    def is_type(self, ion_type: str) -> Truth:
        if ion_type == "null":
            return self.is_untyped_null()
        pattern = self._NAMES.get(ion_type)
        return sure(F.schema_of_variant(self.col).rlike(pattern)) if pattern else False

    def is_null(self) -> Truth:
        return self.is_untyped_null()

    def is_untyped_null(self) -> Truth:
        return F.coalesce(F.is_variant_null(self.col), F.lit(True)) | self.col.isNull()

    def get(self, kind: str) -> Column:
        return F.try_variant_get(self.col, "$", kind)

    def _map(self) -> Column:
        return self.get("map<string,variant>")

    def size(self) -> Column:
        return F.when(column(self.is_type("list")), F.size(self.get("array<variant>"))).otherwise(F.size(self._map()))

    def sequence(self) -> Column:
        return F.when(column(self.is_type("list")), self.get("array<variant>")).otherwise(F.map_values(self._map()))

    def child(self, x: Column) -> Variant:
        return Variant(x, self.options)

    def keys(self) -> Column:
        return F.map_keys(self._map())

    def field(self, name: str):
        v = F.try_variant_get(self.col, "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")
        there = v.isNotNull()
        return there.cast("int"), lambda test: either(~there, test(Variant(v, self.options)))

    def undeclared(self, names: list[str]) -> Truth:
        return sure(F.size(F.array_except(self.keys(), F.array(*[F.lit(n) for n in names]).cast("array<string>"))) > 0)

    def text(self) -> Column:
        return self.get("string")

    def bytes(self) -> Column:
        return self.get("binary")

    def equals(self, e: Element) -> Truth:
        v = e.value
        if e.type == "bool":
            return both(self.is_type("bool"), sure(self.get("boolean") == F.lit(v)))
        if e.type in ("int", "decimal"):
            return both(either(self.is_type("int"), self.is_type("decimal")), sure(self.get("decimal(38,18)") == F.lit(v).cast("decimal(38,18)")))
        if e.type == "float":
            return both(self.is_type("float"), sure(self.get("double") == F.lit(v)))
        if e.type in ("string", "symbol"):
            return both(self.is_type("string"), sure(self.text() == F.lit(v)))
        return False

    def number(self, text: str) -> Column:
        return F.lit(text).cast("decimal(38,18)")

    def finite(self) -> Truth:
        return True

    def digits(self) -> Column:
        return F.greatest(F.length(F.ltrim(F.regexp_replace(self.text(), r"[-.]", ""), F.lit("0"))), F.lit(1))

    def scale(self) -> Column:
        return F.length(F.regexp_extract(self.text(), r"\.(\d*)$", 1))

    def float_(self) -> Column:
        return self.get("double")

    def offset(self, minutes: int | None) -> Truth:
        return minutes == 0

    def instant(self) -> Column:
        return F.unix_micros(self.get("timestamp"))

    def at(self, t: Timestamp) -> Column:
        return F.lit(_micros(t))

    def stamp_digits(self) -> Column:
        return F.lit(6)


class Symbol(View):
    """A text that is a symbol: an annotation or a field's name."""

    def __init__(self, col: Column, options: Options):
        self.inner = Typed(col, T.StringType(), Options(symbols=frozenset(["s"])), "s")

    def __getattr__(self, name: str):
        return getattr(self.inner, name)

    def is_type(self, ion_type: str) -> Truth:
        return ion_type == "symbol"

    def is_null(self) -> Truth:
        return False

    def is_untyped_null(self) -> Truth:
        return False

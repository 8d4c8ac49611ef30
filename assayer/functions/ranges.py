"""Ranges over whole numbers, decimals, timestamps and timestamp precisions."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from assayer.functions.ion import EXACT, Element, Timestamp, write

PRECISIONS = {"year": -4, "month": -3, "day": -2, "minute": -1, "second": 0, "millisecond": 3, "microsecond": 6, "nanosecond": 9}


class InvalidSchemaError(ValueError):
    """A schema that breaks a rule of the language."""


@dataclass(frozen=True)
class Limit:
    """value None: no limit on this side."""

    value: Any = None
    exclusive: bool = False


@dataclass(frozen=True)
class Range:
    """kind: count (0 or more), whole, number, timestamp or precision."""

    kind: str
    lower: Limit = Limit()
    upper: Limit = Limit()

    def __post_init__(self):
        low, high = self.lower, self.upper
        if low.value is None and high.value is None:
            raise InvalidSchemaError("a range needs a limit")
        if low.value is not None and high.value is not None:
            a, b = _ordered(low.value), _ordered(high.value)
            either = low.exclusive or high.exclusive
            empty = a > b or a == b and either
            if not empty and self.kind in ("count", "whole", "precision") and low.exclusive and high.exclusive:
                empty = b - a < 2
            if empty:
                raise InvalidSchemaError(f"the range {self} is empty")

    @classmethod
    def single(cls, kind: str, value) -> Range:
        return cls(kind, Limit(value), Limit(value))

    def __contains__(self, value) -> bool:
        x = _ordered(value)
        if self.lower.value is not None:
            a = _ordered(self.lower.value)
            if x < a or self.lower.exclusive and x == a:
                return False
        if self.upper.value is not None:
            b = _ordered(self.upper.value)
            if x > b or self.upper.exclusive and x == b:
                return False
        return True

    def whole(self) -> tuple[int | None, int | None]:
        """Inclusive bounds, for kinds of whole numbers."""
        low, high = self.lower.value, self.upper.value
        return (None if low is None else low + self.lower.exclusive), (None if high is None else high - self.upper.exclusive)

    def __str__(self) -> str:
        if self.lower == self.upper and not self.lower.exclusive and self.lower.value is not None:
            return self._shown(self.lower.value)
        sides = [("min", self.lower), ("max", self.upper)]
        return "range::[" + ", ".join(name if x.value is None else ("exclusive::" if x.exclusive else "") + self._shown(x.value) for name, x in sides) + "]"

    def _shown(self, value) -> str:
        if self.kind == "precision":
            return next((k for k, v in PRECISIONS.items() if v == value), str(value))
        if isinstance(value, Decimal):
            return write(Element("decimal", value))
        return str(value)


def _ordered(value):
    return value.instant() if isinstance(value, Timestamp) else value


def _limit(kind: str, e: Element, what: str) -> Any:
    bad = InvalidSchemaError(f"{what}: {e} can't limit a {kind} range")
    if e.is_null:
        raise bad
    if kind in ("count", "whole"):
        if e.type != "int" or kind == "count" and e.value < 0:
            raise bad
        return e.value
    if kind == "number":
        if e.type == "int":
            return Decimal(e.value)
        if e.type == "decimal":
            return e.value
        if e.type == "float" and e.value - e.value == 0:
            return EXACT.create_decimal(repr(e.value))
        raise bad
    if kind == "timestamp":
        if e.type != "timestamp":
            raise bad
        return e.value
    if e.type != "symbol" or e.value not in PRECISIONS:
        raise bad
    return PRECISIONS[e.value]


def parse(kind: str, e: Element, what: str = "range") -> Range:
    """`range::[a, b]`, with min, max and exclusive::, or a single value."""
    if e.annotations:
        if e.annotations != ("range",) or e.type != "list" or e.is_null or len(e.value) != 2:
            raise InvalidSchemaError(f"{what}: {e} is not a range of two limits")
        limits = []
        for name, x in zip(("min", "max"), e.value, strict=True):
            if x.type == "symbol" and not x.annotations and x.value in ("min", "max"):
                if x.value != name:
                    raise InvalidSchemaError(f"{what}: {x.value} stands on the wrong side of {e}")
                limits.append(Limit())
                continue
            if x.annotations not in ((), ("exclusive",)):
                raise InvalidSchemaError(f"{what}: unexpected annotations in {e}")
            limits.append(Limit(_limit(kind, x, what), bool(x.annotations)))
        return Range(kind, *limits)
    return Range.single(kind, _limit(kind, e, what))


def number_of(e: Element) -> Decimal | None:
    """A number as an exact decimal; None for others and for what isn't finite."""
    if e.is_null:
        return None
    if e.type == "int":
        return Decimal(e.value)
    if e.type == "decimal":
        return e.value
    if e.type == "float" and e.value - e.value == 0:
        return Decimal(e.value)
    return None

"""Compiles a resolved type to Columns: a truth, or the leaves of the tree of violations."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from assayer.functions.ion import Element
from assayer.functions.ranges import Range
from assayer.operators.interpret import show_path
from assayer.operators.views import Options, Symbol, Truth, Typed, View, both, column, either, negated, plainly, sure
from assayer.plans.model import SimpleAnnotations, show_offset
from assayer.plans.system import BUILTINS, Ref, Type

LEAF = "array<struct<constraint: string, code: string, message: string, path: string>>"
#: Positions of an ordered_elements automaton that fit a BIGINT.
MOST_POSITIONS = 62


class NotCompilable(Exception):
    """What expressions can't say: recursion, or an automaton beyond MOST_POSITIONS.  The interpreter can."""


class Automaton:
    """The positions of ordered_elements as bits of a BIGINT: bit 0 is the start, bit k + 1 position k.

    A reference that occurs 2 to 4 times has four positions, the last two of
    which may be left out; without an upper bound its last position repeats.
    refs: the distinct references.  ref: for each position, its number there.
    before: for each position, the bits from which a step reaches it.
    accepting: the bits in which a sequence may end.
    """

    def __init__(self, refs: list[Ref]):
        self.refs = refs
        self.ref: list[int] = []
        optional: list[bool] = []
        repeats: list[bool] = []
        for number, r in enumerate(refs):
            low, high = r.occurs.whole()
            low = low or 0
            many = max(low, 1) if high is None else min(high, MOST_POSITIONS + 1)
            self.ref += [number] * many
            optional += [k >= low for k in range(many)]
            repeats += [high is None and k == many - 1 for k in range(many)]
        if len(self.ref) > MOST_POSITIONS:
            raise NotCompilable("ordered_elements has too many positions")

        def reached_from(k: int) -> int:
            """The bit before position k, and those before it that may be left out."""
            mask = 1 << k
            while k and optional[k - 1]:
                k -= 1
                mask |= 1 << k
            return mask

        self.before = [reached_from(k) | (repeats[k] << (k + 1)) for k in range(len(self.ref))]
        self.accepting = reached_from(len(self.ref))

    def step(self, state: Column, truths: list[Column]) -> Column:
        """The bits after a value of which truths say what references it matches."""
        zero = F.lit(0).cast("long")
        parts = [F.when((state.bitwiseAND(F.lit(m).cast("long")) != 0) & truths[r], F.lit(1 << (k + 1)).cast("long")).otherwise(zero) for k, (r, m) in enumerate(zip(self.ref, self.before, strict=True))]
        return reduce(lambda a, b: a.bitwiseOR(b), parts, zero)

    def after(self, state: int, matched: int) -> int:
        """step() of numbers; matched has a bit for each reference."""
        out = 0
        for k, (r, m) in enumerate(zip(self.ref, self.before, strict=True)):
            if state & m and matched >> r & 1:
                out |= 1 << (k + 1)
        return out

    def accepts(self, state: Column) -> Column:
        return state.bitwiseAND(F.lit(self.accepting).cast("long")) != 0


def _comparable(a: T.DataType, b: T.DataType) -> bool:
    """Whether values of both types may be the same Ion value; SQL widens the narrower one."""
    for kinds in ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), (T.FloatType, T.DoubleType), (T.DecimalType,), (T.TimestampType, T.TimestampNTZType, T.DateType), (T.StringType, T.VarcharType, T.CharType)):
        if isinstance(a, kinds) and isinstance(b, kinds):
            return True
    return a == b


class Compiler:
    def __init__(self, options: Options | None = None):
        self.options = options or Options()
        self._stack: list[Type] = []

    # ---- truths

    def valid(self, t: Type, v: View) -> Truth:
        if t.kind == "document":
            return False
        if t.kind == "atom":
            return v.is_type(t.ion_type) if t.nullable else both(v.is_type(t.ion_type), negated(v.is_null()))
        self._enter(t)
        try:
            return both(*[self.constraint(name, arg, v) for name, arg in t.constraints])
        finally:
            self._stack.pop()

    def _enter(self, t: Type) -> None:
        # A typed column's own types end a recursion; a VARIANT's don't.
        if sum(x is t for x in self._stack) > 16:
            raise NotCompilable(f"{t.label} is recursive")
        self._stack.append(t)

    def ref(self, r: Ref, v: View) -> Truth:
        p = self.valid(r.type, v)
        if r.nullability:
            p = either(v.is_untyped_null(), p)
        if r.nullability == "nullable":
            wide = BUILTINS.get("$" + self._base(r.type))
            p = either(p, both(v.is_null(), self.valid(wide, v)) if wide is not None else False)
        return p

    def _base(self, t: Type) -> str:
        if t.name is None:
            named = [a.type.name for n, a in t.constraints if n == "type" and a.type.name]
            return (named[0] if named else "").removeprefix("$")
        return t.name.removeprefix("$")

    def constraint(self, name: str, arg, v: View) -> Truth:
        return getattr(self, f"_{name}")(arg, v)

    def _type(self, r: Ref, v: View) -> Truth:
        return self.ref(r, v)

    def _all_of(self, refs: list[Ref], v: View) -> Truth:
        return both(*[self.ref(r, v) for r in refs])

    def _any_of(self, refs: list[Ref], v: View) -> Truth:
        return either(*[self.ref(r, v) for r in refs])

    def _one_of(self, refs: list[Ref], v: View) -> Truth:
        parts = [self.ref(r, v) for r in refs]
        always = sum(p is True for p in parts)
        open_ = [p for p in parts if not isinstance(p, bool)]
        if not open_ or always > 1:
            return always == 1
        if len(open_) == 1:
            return open_[0] if not always else ~open_[0]
        return reduce(lambda a, b: a + b, [p.cast("int") for p in open_]) == 1 - always

    def _not(self, r: Ref, v: View) -> Truth:
        return negated(self.ref(r, v))

    def _valid_values(self, values: tuple, v: View) -> Truth:
        options: list[Truth] = []
        alike: dict[str, list] = {}
        for x in values:
            if isinstance(x, Range):
                options.append(self._in_range(x, v))
            elif x.is_null:
                options.append(both(v.is_null(), v.is_untyped_null() if x.type == "null" else v.is_type(x.type)))
            elif x.type in ("string", "symbol") and getattr(v, "kind", "") in ("string", "symbol"):
                alike.setdefault("text", []).append(x.value)
            else:
                options.append(v.equals(x))
        if alike:
            options.append(sure(v.text().isin(*alike["text"])))
        return either(*options)

    def _in_range(self, r: Range, v: View) -> Truth:
        if r.kind == "timestamp":
            x, kinds = (lambda: v.instant()), ("timestamp",)
        else:
            x, kinds = (lambda: v.col if hasattr(v, "kind") else v.get("decimal(38,18)")), ("int", "decimal", "float")
        kind = v.of(*kinds)
        if kind is False:
            return False
        parts: list[Truth] = [kind, v.finite()] if r.kind == "number" else [kind]
        for limit, inclusive, exclusive in ((r.lower, "__ge__", "__gt__"), (r.upper, "__le__", "__lt__")):
            if limit.value is not None:
                bound = v.at(limit.value) if r.kind == "timestamp" else v.number(format(Decimal(limit.value), "f"))
                parts.append(sure(getattr(x(), exclusive if limit.exclusive else inclusive)(bound)))
        return both(*parts)

    def _counted(self, found: Column | int, r: Range) -> Truth:
        if isinstance(found, int):
            return found in r
        low, high = r.whole()
        if low is not None and low == high:
            return sure(found == low)
        return both(True if low is None or r.kind == "count" and low == 0 else sure(found >= low), True if high is None else sure(found <= high))

    def _regex(self, regex, v: View) -> Truth:
        kind = v.of("string", "symbol")
        return kind if kind is False else both(kind, sure(F.translate(v.text(), "\r", "\n").rlike(regex.java())))

    def _measured(self, r: Range, v: View, kinds: tuple[str, ...], measure) -> Truth:
        kind = v.of(*kinds)
        return kind if kind is False else both(kind, self._counted(measure(v), r))

    def _codepoint_length(self, r: Range, v: View) -> Truth:
        return self._measured(r, v, ("string", "symbol"), lambda v: F.char_length(v.text()))

    def _utf8_byte_length(self, r: Range, v: View) -> Truth:
        return self._measured(r, v, ("string", "symbol"), lambda v: F.octet_length(v.text()))

    def _byte_length(self, r: Range, v: View) -> Truth:
        return self._measured(r, v, ("blob", "clob"), lambda v: F.octet_length(v.bytes()))

    def _container_length(self, r: Range, v: View) -> Truth:
        return self._measured(r, v, ("list", "sexp", "struct"), lambda v: v.size())

    def _precision(self, r: Range, v: View) -> Truth:
        return self._measured(r, v, ("decimal",), lambda v: v.digits())

    def _scale(self, r: Range, v: View) -> Truth:
        return self._measured(r, v, ("decimal",), lambda v: v.scale())

    def _exponent(self, r: Range, v: View) -> Truth:
        return self._measured(r, v, ("decimal",), lambda v: -v.scale())

    def _timestamp_precision(self, r: Range, v: View) -> Truth:
        return self._measured(r, v, ("timestamp",), lambda v: v.stamp_digits())

    def _timestamp_offset(self, offsets: tuple, v: View) -> Truth:
        kind = v.of("timestamp")
        return kind if kind is False else both(kind, either(*[v.offset(o) for o in offsets]))

    def _ieee754_float(self, form: str, v: View) -> Truth:
        kind = v.of("float")
        if kind is False or form == "binary64":
            return kind
        x = v.float_()
        special = F.isnan(x) | x.isin(float("inf"), float("-inf"))
        if form == "binary32":
            fits = x.cast("float").cast("double") == x
        else:
            # 11 significant bits down to 2^-14, and multiples of 2^-24 below.
            unit = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
            fits = (x == 0) | ((F.abs(x) <= 65504) & (x / unit == F.floor(x / unit)))
        return both(kind, sure(special | fits))

    def _contains(self, values: tuple[Element, ...], v: View) -> Truth:
        kind = v.of("list", "sexp", "struct")
        if kind is False:
            return False
        items = v.sequence()
        if items is None:
            return both(kind, *[either(*[m.equals(x) for m in v.members().values()]) for x in values])

        def has(x: Element):
            return sure(F.exists(items, lambda i: column(either(both(v.child(i).is_null(), self._valid_values((x,), v.child(i))) if x.is_null else v.child(i).equals(x)))))

        return both(kind, *[has(x) for x in values])

    def _element(self, arg: tuple[Ref, bool], v: View) -> Truth:
        r, distinct = arg
        kind = v.of("list", "sexp", "struct")
        if kind is False:
            return False
        items = v.sequence()
        if items is None:
            members = list(v.members().values())
            parts = [either(m.absent(), self.ref(r, m)) for m in members]
            if distinct:
                # Members of one Ion type are compared, whatever their SQL types: 1 and 1L are the same int.
                parts += [negated(sure(a.col == b.col)) for k, a in enumerate(members) for b in members[:k] if _comparable(a.dtype, b.dtype)]
            return both(kind, *parts)
        # Whether the elements' data type decides shows on any element.
        parts = [sure(F.forall(items, lambda x: column(self.ref(r, v.child(x)))))]
        if distinct:
            comparable = F.transform(items, lambda x: F.to_json(x)) if not hasattr(v, "kind") else items
            parts.append(sure(F.size(F.array_distinct(comparable)) == F.size(items)))
        return both(kind, *parts)

    def _field_names(self, arg: tuple[Ref, bool], v: View) -> Truth:
        r, distinct = arg
        kind = v.of("struct")
        if kind is False:
            return False
        keys = v.keys()
        if keys is None:  # names are known now, but absent fields have none
            return both(kind, *[either(m.absent(), self.ref(r, Symbol(F.lit(k), self.options))) for k, m in v.members().items()])
        parts = [sure(F.forall(keys, lambda k: column(self.ref(r, Symbol(k, self.options)))))]
        if distinct:
            parts.append(sure(F.size(F.array_distinct(keys)) == F.size(keys)))
        return both(kind, *parts)

    def _fields(self, arg: tuple[dict[str, Ref], bool], v: View) -> Truth:
        fields, closed = arg
        kind = v.of("struct")
        if kind is False:
            return False
        parts: list[Truth] = [kind]
        for name, r in fields.items():
            count, every = v.field(name)
            parts += [self._counted(count, r.occurs), every(lambda x, r=r: self.ref(r, x))]
        if closed:
            parts.append(negated(v.undeclared(list(fields))))
        return both(*parts)

    def _ordered_elements(self, refs: list[Ref], v: View) -> Truth:
        """The automaton of the references folded over the array."""
        kind = v.of("list", "sexp")
        if kind is False:
            return False
        auto = Automaton(refs)

        def step(state: Column, x: Column) -> Column:
            truths = [column(self.ref(r, v.child(x))) for r in auto.refs]
            return auto.step(state, truths)

        last = F.aggregate(v.sequence(), F.lit(1).cast("long"), step)
        return both(kind, sure(auto.accepts(last)))

    def _annotations(self, arg, v: View) -> Truth:
        notes = self.options.annotations if self.options.annotations is not None else F.array().cast("array<string>")
        notes = F.coalesce(notes, F.array().cast("array<string>"))
        if isinstance(arg, Ref):
            return self.ref(arg, _Notes(notes, self.options))
        return both(*[column(p) for _, p in self._simple(arg, notes)])

    def _simple(self, arg: SimpleAnnotations, notes: Column) -> list[tuple[str, Truth]]:
        """(code, truth) pairs."""
        names = F.array(*[F.lit(n) for n, _ in arg.names]).cast("array<string>")
        if not arg.ordered:
            needed = [F.array_contains(notes, n) for n, required in arg.names if required]
            out: list[tuple[str, Truth]] = [("missing_annotation", both(*needed))]
            if arg.closed:
                out.append(("unexpected_annotation", F.size(F.array_except(notes, names)) == 0))
            return out
        at, ok = F.lit(1), F.lit(True)
        for n, required in arg.names:
            here = F.coalesce(F.get(notes, at - 1) == n, F.lit(False))
            if required and not arg.closed:
                ahead = F.array_position(F.slice(notes, at, F.greatest(F.size(notes) - at + 1, F.lit(0))), n).cast("int")
                ok, at = ok & (here | (ahead > 0)), F.when(here, at + 1).when(ahead > 0, at + ahead).otherwise(at)
            elif required:
                ok, at = ok & here, F.when(here, at + 1).otherwise(at)
            else:
                at = F.when(here, at + 1).otherwise(at)
        return [("annotation_mismatched", ok)] + ([("unexpected_annotation", negated(ok) | (at > F.size(notes)))] if arg.closed else [])

    # ---- what a filter can push down

    def implied(self, t: Type, v: View) -> Truth:
        """A plain predicate that holds for every valid value; sources can take it, as no coalesce hides it."""
        if not isinstance(v, Typed) or t.kind == "document":
            return True
        if t.kind == "atom":
            return both(v.kind == t.ion_type, v.col.isNotNull()) if not t.nullable and v.kind not in ("struct", "list") else True
        self._enter(t)
        try:
            return both(*[self._implied(name, arg, v) for name, arg in t.constraints])
        finally:
            self._stack.pop()

    def _implied(self, name: str, arg, v: Typed) -> Truth:
        below = lambda r, x: True if r.nullability else self.implied(r.type, x)
        if name == "type":
            return below(arg, v)
        if name == "all_of":
            return both(*[below(r, v) for r in arg])
        if name in ("any_of", "one_of"):
            return either(*[below(r, v) for r in arg])
        if name == "fields" and isinstance(v.dtype, StructType):
            members = v.members()
            needed = [(members[k], r) for k, r in arg[0].items() if (r.occurs.whole()[0] or 0) >= 1 and k in members]
            return both(*[both(negated(m.absent()), below(r, m)) for m, r in needed])
        if name == "valid_values" and v.kind in ("int", "float", "decimal", "string", "symbol", "timestamp") and not any(getattr(x, "is_null", False) for x in arg):
            with plainly():
                return self._valid_values(arg, v)
        return True

    # ---- violations

    def leaves(self, t: Type, v: View, path: list | None = None) -> Column:
        """Leaves of the violations: constraint, code, message and path, an array without order."""
        path = path or []
        if t.kind == "document":
            return self._leaf(False, "type_constraint", "type_mismatched", "expected type document", path)
        if t.kind == "atom":
            null = both(v.is_null(), not t.nullable)
            right = v.is_type(t.ion_type)
            return self._all(
                self._leaf(negated(null), "type_constraint", "invalid_null", f"expected type {t.ion_type} but found a null", path),
                self._leaf(either(null, right), "type_constraint", "type_mismatched", f"expected type {t.ion_type}", path),
            )
        self._enter(t)
        try:
            return self._all(*[self._violated(name, arg, v, path) for name, arg in t.constraints])
        finally:
            self._stack.pop()

    def _leaf(self, ok: Truth, constraint: str, code: str, message: str, path: list) -> Column | None:
        if ok is True:
            return None
        leaf = F.array(F.struct(F.lit(constraint).alias("constraint"), F.lit(code).alias("code"), F.lit(message).alias("message"), self._path(path).alias("path")))
        return (leaf if ok is False else F.when(~ok, leaf).otherwise(F.array().cast(LEAF))).cast(LEAF)

    def _path(self, path: list) -> Column:
        if not any(isinstance(p, Column) for p in path):
            return F.lit(show_path(tuple(path)))
        parts = [p.cast("string") if isinstance(p, Column) else F.lit(show_path((p,))[2:-2]) for p in path]
        return F.concat(F.lit("( "), F.concat_ws(" ", *parts), F.lit(" )"))

    def _all(self, *parts: Column | None) -> Column:
        rest = [p for p in parts if p is not None]
        if not rest:
            return F.array().cast(LEAF)
        return rest[0] if len(rest) == 1 else F.concat(*rest)

    def _unless(self, ok: Truth, leaves: Column) -> Column | None:
        if isinstance(ok, bool):
            return None if ok else leaves
        return F.when(ok, F.array().cast(LEAF)).otherwise(leaves)

    def _ref_leaves(self, r: Ref, v: View, path: list) -> Column:
        if r.nullability:
            return self._all(self._unless(self.ref(r, v), self.leaves(r.type, v, path)))
        return self.leaves(r.type, v, path)

    def _violated(self, name: str, arg, v: View, path: list) -> Column | None:
        if name == "type":
            return self._ref_leaves(arg, v, path)
        if name == "all_of":
            return self._all(*[self._ref_leaves(r, v, path) for r in arg])
        if name in ("any_of", "one_of"):
            ok = self.constraint(name, arg, v)
            below = self._all(*[self._ref_leaves(r, v, path) for r in arg])
            if name == "any_of":
                own = self._leaf(False, name, "no_types_matched", "value matches none of the types", path)
                return self._unless(ok, F.when(F.size(below) == 0, own).otherwise(below))
            none = negated(either(*[self.ref(r, v) for r in arg]))
            own = F.when(column(none), self._leaf(False, name, "no_types_matched", "value matches none of the types", path)).otherwise(self._leaf(False, name, "more_than_one_type_matched", "value matches more than one type, expected 1", path))
            return self._unless(ok, F.when(F.size(below) == 0, own).otherwise(below))
        if name == "fields":
            return self._fields_leaves(arg, v, path)
        if name in ("element", "field_names"):
            return self._each_leaves(name, arg, v, path)
        if name == "annotations":
            if isinstance(arg, Ref):
                notes = _Notes(F.coalesce(self.options.annotations, F.array().cast("array<string>")) if self.options.annotations is not None else F.array().cast("array<string>"), self.options)
                return self._ref_leaves(arg, notes, path)
            notes = F.coalesce(self.options.annotations, F.array().cast("array<string>")) if self.options.annotations is not None else F.array().cast("array<string>")
            return self._all(*[self._leaf(p, name, code, "annotations don't match expectations", path) for code, p in self._simple(arg, notes)])
        code, message, kinds = _SINGLE[name]
        said = f"{message} {_shown(arg)}".strip()
        guard = v.of(*kinds) if kinds else True
        return self._all(
            self._leaf(guard, name, "type_mismatched", f"expected {list(kinds)}", path) if kinds else None,
            self._leaf(either(negated(guard), self.constraint(name, arg, v)), name, code, said, path),
        )

    def _fields_leaves(self, arg, v: View, path: list) -> Column | None:
        fields, closed = arg
        guard = v.of("struct")
        parts = [self._leaf(negated(v.undeclared(list(fields))), "fields", "invalid_open_content", "Found open content in the struct", path)] if closed and guard is not False else []
        for name in sorted(fields) if guard is not False else ():
            r, below = fields[name], [*path, name]
            count, every = v.field(name)
            parts.append(self._leaf(self._counted(count, r.occurs), "fields", "type_mismatched", f"Expected {r.occurs} of field {name}", below))
            found: list[tuple[Truth, Column]] = []

            def gather(x: View, r=r, below=below, found=found) -> Truth:
                ok = self.ref(r, x)
                found.append((ok, self._ref_leaves(r, x, below)))
                return ok

            ok = every(gather)
            if found and ok is not True:
                parts.append(self._unless(ok, found[-1][1]))
        own = self._leaf(guard, "fields", "type_mismatched", "expected ['struct']", path)
        return own if guard is False else self._all(own, *[self._unless(negated(guard), p) for p in parts if p is not None])

    def _each_leaves(self, name: str, arg, v: View, path: list) -> Column | None:
        r, distinct = arg
        guard = v.of("struct") if name == "field_names" else v.of("list", "sexp", "struct")
        own = self._leaf(guard, name, "type_mismatched", "expected a container", path)
        if guard is False:
            return own
        items = v.sequence() if name == "element" else v.keys()
        if items is None:
            below = self._all(*[self._unless(m.absent(), self._ref_leaves(r, m if name == "element" else Symbol(F.lit(k), self.options), [*path, k])) for k, m in v.members().items()])
        else:
            inner = (lambda x: v.child(x)) if name == "element" else (lambda x: Symbol(x, self.options))
            below = F.flatten(F.transform(items, lambda x, i: self._ref_leaves(r, inner(x), [*path, i])))
        again = None
        if distinct:
            code = "element_not_distinct" if name == "element" else "field_names_not_distinct"
            again = self._leaf(sure(F.size(F.array_distinct(items)) == F.size(items)), name, code, "expected distinct values", path) if items is not None else None
        return self._all(own, self._unless(negated(guard), self._all(below, again)))


class _Notes(View):
    """A value's annotations as a list of symbols."""

    def __init__(self, col: Column, options: Options):
        self.col, self.options, self.kind = col, options, "list"

    def is_type(self, ion_type: str) -> Truth:
        return ion_type == "list"

    def is_null(self) -> Truth:
        return False

    def is_untyped_null(self) -> Truth:
        return False

    def sequence(self) -> Column:
        return self.col

    def child(self, x: Column) -> Symbol:
        return Symbol(x, self.options)

    def size(self) -> Column:
        return F.size(self.col)


_TEXT, _ANY = ("string", "symbol"), ()
_SINGLE = {
    "not": ("type_matched", "value unexpectedly matches type", _ANY),
    "valid_values": ("invalid_value", "expected valid_values to be from", _ANY),
    "regex": ("regex_mismatched", "value doesn't match regex", _TEXT),
    "codepoint_length": ("invalid_length", "expected codepoint length", _TEXT),
    "utf8_byte_length": ("invalid_length", "expected utf8 byte length", _TEXT),
    "byte_length": ("invalid_length", "expected byte length", ("blob", "clob")),
    "container_length": ("invalid_length", "expected container length", ("list", "sexp", "struct")),
    "contains": ("missing_value", "value has missing value(s) of", ("list", "sexp", "struct")),
    "ordered_elements": ("element_mismatched", "one or more ordered elements don't match", ("list", "sexp")),
    "precision": ("invalid_length", "expected precision", ("decimal",)),
    "scale": ("invalid_length", "expected scale", ("decimal",)),
    "exponent": ("invalid_length", "expected exponent", ("decimal",)),
    "timestamp_precision": ("invalid_length", "expected precision", ("timestamp",)),
    "timestamp_offset": ("invalid_length", "expected timestamp offset from", ("timestamp",)),
    "ieee754_float": ("invalid_ieee754_float", "value cannot be losslessly represented by", ("float",)),
}


def _shown(arg) -> str:
    if isinstance(arg, Ref):
        return arg.type.label
    if isinstance(arg, tuple):
        return "[" + ", ".join(show_offset(x) if x is None or isinstance(x, int) else str(x) for x in arg) + "]"
    return getattr(arg, "expression", "" if isinstance(arg, list) else str(arg))

"""Programmatic models: ``v1`` and ``v2`` build types, references and constraints of each version."""

from __future__ import annotations

from collections.abc import Iterable

from assayer.functions import ranges
from assayer.functions.ion import Element, from_python, read_one
from assayer.functions.ranges import InvalidSchemaError, Range
from assayer.functions.regexes import Regex
from assayer.plans import model
from assayer.plans.model import Constraint, Import, IslSchema, IslType, SimpleAnnotations, TypeRef


def _range(kind: str, r) -> Range:
    if isinstance(r, Range):
        return r
    if isinstance(r, str):
        return ranges.parse(kind, read_one(r))
    return Range.single(kind, r)


class _Builders:
    def __init__(self, version: int):
        self.version = version
        self.parser = model.Parser(version)

    # types and references
    def named_type(self, name: str, constraints: Iterable[Constraint]) -> IslType:
        return IslType(name, tuple(constraints), self.version)

    def anonymous_type(self, constraints: Iterable[Constraint]) -> IslType:
        return IslType(None, tuple(constraints), self.version)

    def load_isl_type(self, text: str | bytes) -> IslType:
        e = read_one(text.decode() if isinstance(text, bytes) else text)
        return self.parser.named_type(e) if e.fields("name") else self.parser.type(e)

    def named_type_ref(self, name: str, nullability: str = "") -> TypeRef:
        return TypeRef(name=name, nullability=nullability)

    def nullable(self, name: str) -> TypeRef:
        return TypeRef(name=name, nullability="nullable" if self.version == 1 else "$null_or")

    def anonymous_type_ref(self, constraints: Iterable[Constraint]) -> TypeRef:
        return TypeRef(inline=self.anonymous_type(constraints))

    def import_type_ref(self, schema: str, name: str) -> TypeRef:
        return TypeRef(name=name, schema=schema)

    def occurring(self, ref: TypeRef | str, occurs) -> TypeRef:
        from dataclasses import replace

        return replace(self._ref(ref), occurs=_range("count", occurs))

    def _ref(self, r: TypeRef | str) -> TypeRef:
        return r if isinstance(r, TypeRef) else TypeRef(name=r)

    def _occurring(self, r: TypeRef | str, default: Range) -> TypeRef:
        r = self._ref(r)
        return r if r.occurs is not None else self.occurring(r, default)

    # constraints
    def type(self, ref) -> Constraint:
        return Constraint("type", self._ref(ref))

    def not_(self, ref) -> Constraint:
        return Constraint("not", self._ref(ref))

    def all_of(self, refs) -> Constraint:
        return Constraint("all_of", tuple(map(self._ref, refs)))

    def any_of(self, refs) -> Constraint:
        return Constraint("any_of", tuple(map(self._ref, refs)))

    def one_of(self, refs) -> Constraint:
        return Constraint("one_of", tuple(map(self._ref, refs)))

    def ordered_elements(self, refs) -> Constraint:
        return Constraint("ordered_elements", tuple(self._occurring(r, model.REQUIRED) for r in refs))

    def fields(self, fields: dict, closed: bool = False) -> Constraint:
        return Constraint("fields", ({k: self._occurring(r, model.OPTIONAL) for k, r in fields.items()}, closed))

    def element(self, ref, distinct: bool = False) -> Constraint:
        if distinct and self.version == 1:
            raise InvalidSchemaError("distinct elements need version 2")
        return Constraint("element", (self._ref(ref), distinct))

    def contains(self, values) -> Constraint:
        return Constraint("contains", tuple(map(from_python, values)))

    def valid_values(self, values) -> Constraint:
        return Constraint("valid_values", tuple(v if isinstance(v, Range) else from_python(v) for v in values))

    def number_range(self, text: str) -> Range:
        return ranges.parse("number", read_one(text))

    def timestamp_range(self, text: str) -> Range:
        return ranges.parse("timestamp", read_one(text))

    def regex(self, expression: str, ignore_case: bool = False, multi_line: bool = False) -> Constraint:
        return Constraint("regex", Regex(expression, ignore_case, multi_line, self.version))

    def timestamp_offset(self, offsets) -> Constraint:
        return Constraint("timestamp_offset", tuple(model.parse_offset(x) if isinstance(x, str) else x for x in offsets))

    def ieee754_float(self, form: str) -> Constraint:
        return Constraint("ieee754_float", form)

    def annotations(self, value, ordered: bool = False, closed: bool = False, required: bool = False) -> Constraint:
        """value: names or (name, required) pairs; or, for version 2, a type over the list of annotations."""
        if isinstance(value, TypeRef):
            if self.version == 1:
                raise InvalidSchemaError("a type over annotations needs version 2")
            return Constraint("annotations", value)
        if self.version == 2 and (ordered or not (closed or required)):
            raise InvalidSchemaError("annotations needs required or closed")
        simple = SimpleAnnotations(tuple(x if isinstance(x, tuple) else (x, required) for x in value), ordered, closed)
        return Constraint("annotations", simple if self.version == 1 else model.standard_annotations(simple))

    def open_content(self, name: str, value) -> Constraint:
        return Constraint("unknown", (name, from_python(value)))

    def schema(self, schema_id: str, types: Iterable[IslType], imports: Iterable[Import] = (), open_content: Iterable[Element] = (), user_reserved_fields: dict | None = None) -> IslSchema:
        types, imports = list(types), list(imports)
        if any(t.version != self.version for t in types):
            raise InvalidSchemaError("types of another version")
        return IslSchema(schema_id, self.version, imports, types, list(open_content), user_reserved_fields or {}, bool(imports))


def _ranged(name: str):
    def build(self, r) -> Constraint:
        return Constraint(name, _range(model.RANGED[name], r))

    build.__name__ = name
    return build


for _name in model.RANGED:
    if _name not in model.ONLY:
        setattr(_Builders, _name, _ranged(_name))


class _V1(_Builders):
    scale = _ranged("scale")

    def content_closed(self) -> Constraint:
        return Constraint("content", "closed")


class _V2(_Builders):
    exponent = _ranged("exponent")

    def field_names(self, ref, distinct: bool = False) -> Constraint:
        return Constraint("field_names", (self._ref(ref), distinct))


v1, v2 = _V1(1), _V2(2)

"""The unresolved model: what a schema document says, checked against the language's rules.

Versions are 1 and 2.  ``parse_schema`` reads a document, ``to_element`` writes
the model back; ``v1`` and ``v2`` in ``assayer.plans.builders`` build it in code.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from assayer.functions import ranges
from assayer.functions.ion import Element
from assayer.functions.ranges import InvalidSchemaError, Range
from assayer.functions.regexes import Regex

ATOMS = ("bool", "int", "float", "decimal", "timestamp", "string", "symbol", "blob", "clob", "list", "sexp", "struct")
DERIVED = {"lob": ("blob", "clob"), "number": ("decimal", "float", "int"), "text": ("string", "symbol")}
#: What nullable:: may stand before in version 1.
NULLABLE = {*ATOMS, *DERIVED, "any", "nothing", "document"}
RANGED = {"codepoint_length": "count", "utf8_byte_length": "count", "byte_length": "count", "container_length": "count", "precision": "count", "scale": "whole", "exponent": "whole", "timestamp_precision": "precision"}
ONLY = {"field_names": 2, "exponent": 2, "scale": 1}
OPTIONAL, REQUIRED = Range("count", ranges.Limit(0), ranges.Limit(1)), Range.single("count", 1)
_RESERVED = re.compile(r"\$ion_schema(_.*)?|[a-z][a-z0-9]*(_[a-z0-9]+)*$")
_MARKER = re.compile(r"\$ion_schema_\d.*")


@dataclass(frozen=True)
class TypeRef:
    """A named type, an inline type or a type of another schema.  nullability: '', 'nullable' or '$null_or'."""

    name: str | None = None
    inline: IslType | None = None
    schema: str | None = None
    nullability: str = ""
    occurs: Range | None = None


@dataclass(frozen=True)
class SimpleAnnotations:
    """names: (annotation, whether it is required)."""

    names: tuple[tuple[str, bool], ...]
    ordered: bool = False
    closed: bool = False


@dataclass(frozen=True)
class Constraint:
    name: str
    value: Any

    def refs(self) -> tuple[TypeRef, ...]:
        v = self.value
        if isinstance(v, TypeRef):
            return (v,)
        if self.name in ("element", "field_names"):
            return (v[0],)
        if self.name in ("all_of", "any_of", "one_of", "ordered_elements"):
            return tuple(v)
        if self.name == "fields":
            return tuple(v[0].values())
        return ()


@dataclass(frozen=True, eq=False)
class IslType:
    name: str | None
    constraints: tuple[Constraint, ...]
    version: int = 1
    open_content: tuple[tuple[str, Element], ...] = ()

    def __eq__(self, other):
        same = isinstance(other, IslType) and self.name == other.name and len(self.constraints) == len(other.constraints)
        return same and all(c in other.constraints for c in self.constraints) and all(c in self.constraints for c in other.constraints)

    __hash__ = None


@dataclass(frozen=True)
class Import:
    schema: str
    type: str | None = None
    alias: str | None = None


@dataclass
class IslSchema:
    id: str
    version: int = 1
    imports: list[Import] = field(default_factory=list)
    types: list[IslType] = field(default_factory=list)
    open_content: list[Element] = field(default_factory=list)
    user_reserved_fields: dict[str, list[str]] = field(default_factory=dict)
    header: bool = False

    def inline_imports(self) -> list[TypeRef]:
        """References to types of other schemas anywhere in the types."""
        out, todo = [], [r for t in self.types for c in t.constraints for r in c.refs()]
        while todo:
            r = todo.pop(0)
            if r.schema is not None:
                out.append(r)
            if r.inline is not None:
                todo += [x for c in r.inline.constraints for x in c.refs()]
        return out


def _bad(what: str) -> InvalidSchemaError:
    return InvalidSchemaError(what)


def _list(e: Element, what: str, annotated: Sequence[str] = ()) -> list[Element]:
    if e.type != "list" or e.is_null or any(a not in annotated for a in e.annotations):
        raise _bad(f"{what} needs a list, found {e}")
    return e.value


class Parser:
    """version and, for version 2, the fields that the user reserved."""

    def __init__(self, version: int, reserved: dict[str, list[str]] | None = None):
        self.version, self.reserved = version, reserved or {}

    # ---- types

    def named_type(self, e: Element) -> IslType:
        if "type" not in e.annotations or e.type != "struct" or e.is_null:
            raise _bad("a top-level type is an annotated struct")
        if self.version == 2 and e.annotations != ("type",):
            raise _bad("unexpected annotations on a type")
        names = e.fields("name")
        if len(names) != 1 or names[0].type != "symbol" or names[0].is_null or names[0].annotations:
            raise _bad(f"a top-level type needs one name, an unannotated symbol: {e}")
        if e.fields("occurs"):
            raise _bad("a top-level type can't have occurs")
        return self.type(e, names[0].value)

    def type(self, e: Element, name: str | None = None) -> IslType:
        if e.type != "struct" or e.is_null:
            raise _bad(f"a type is a struct, found {e}")
        constraints, rest = [], []
        for key, value in e.value:
            if key == "name" and name is not None or key == "occurs":
                continue
            found = self.constraint(key, value)
            if found.name == "unknown":
                if self.version == 2 and key not in self.reserved.get("type", ()) and _RESERVED.match(key):
                    raise _bad(f"{key} is no constraint, and not a reserved field of the user's")
                rest.append((key, value))
            constraints.append(found)
        if self.version == 1 and any(c.name == "content" for c in constraints):
            constraints = [replace(c, value=(c.value[0], True)) if c.name == "fields" else c for c in constraints]
        return IslType(name, tuple(constraints), self.version, tuple(rest))

    def ref(self, e: Element, occurs: bool = False, default: Range | None = None) -> TypeRef:
        notes = [a for a in e.annotations]
        nullability = ""
        if self.version == 1 and "nullable" in notes:
            nullability = "nullable"
        elif self.version == 2 and "$null_or" in notes:
            nullability = "$null_or"
        elif self.version == 1 and "$null_or" in notes:
            raise _bad(f"$null_or needs version 2: {e}")
        if self.version == 2 and any(a != "$null_or" for a in notes):
            raise _bad(f"unexpected annotations on a type reference: {e}")
        if e.is_null or e.type not in ("symbol", "struct"):
            raise _bad(f"a type reference is a symbol or a struct, found {e}")
        found = OPTIONAL if default is None else default
        if e.type == "symbol":
            if nullability == "nullable" and e.value.removeprefix("$") not in NULLABLE:
                raise _bad(f"nullable:: stands before built-in types, not {e.value}")
            return TypeRef(name=e.value, nullability=nullability, occurs=found if occurs else None)
        stated = e.fields("occurs")
        if len(stated) > 1:
            raise _bad("occurs stands twice")
        if stated:
            if not occurs and self.version == 2:
                raise _bad("occurs belongs to fields and ordered_elements")
            if nullability and occurs:
                raise _bad(f"{nullability}:: can't stand on a reference with occurs")
            found = self.occurs(stated[0])
        rest = [(k, v) for k, v in e.value if k != "occurs"]
        ids = [v for k, v in rest if k == "id"]
        if ids:
            types = [v for k, v in rest if k == "type"]
            if len(ids) != 1 or ids[0].type not in ("string", "symbol") or ids[0].is_null or len(types) != 1 or types[0].type != "symbol" or types[0].is_null:
                raise _bad(f"an inline import needs an id and a type: {e}")
            if self.version == 2 and {k for k, _ in rest} != {"id", "type"}:
                raise _bad("an inline import has an id and a type only")
            return TypeRef(name=types[0].value, schema=ids[0].value, nullability=nullability, occurs=found if occurs else None)
        if nullability == "nullable" and not (len(rest) == 1 and rest[0][0] == "type" and rest[0][1].type == "symbol" and rest[0][1].value in NULLABLE):
            raise _bad("nullable:: stands before built-in types")
        return TypeRef(inline=self.type(Element("struct", rest)), nullability=nullability, occurs=found if occurs else None)

    def occurs(self, e: Element) -> Range:
        if e.is_null:
            raise _bad("occurs can't be null")
        if e.type == "symbol" and not e.annotations:
            if e.value not in ("optional", "required"):
                raise _bad(f"occurs can't be {e.value}")
            return OPTIONAL if e.value == "optional" else REQUIRED
        found = ranges.parse("count", e, "occurs")
        if found.whole()[1] == 0:
            raise _bad("occurs can't be 0")
        return found

    # ---- constraints

    def constraint(self, key: str, e: Element) -> Constraint:
        if ONLY.get(key, self.version) != self.version:
            return Constraint("unknown", (key, e))
        if key in RANGED:
            found = ranges.parse(RANGED[key], e, key)
            if key == "precision" and (found.whole()[0] or 0) < 1:
                raise _bad("precision starts at 1")
            return Constraint(key, found)
        method = getattr(self, f"_{key}", None)
        if key in ("all_of", "any_of", "one_of"):
            return Constraint(key, tuple(self.ref(x) for x in _list(e, key)))
        if key in ("type", "not"):
            return Constraint(key, self.ref(e))
        return Constraint(key, method(e)) if method and key in _METHODS else Constraint("unknown", (key, e))

    def _distinct(self, e: Element, what: str) -> tuple[TypeRef, bool]:
        distinct = self.version == 2 and "distinct" in e.annotations
        rest = tuple(a for a in e.annotations if not (distinct and a == "distinct"))
        if self.version == 2 and any(a != "$null_or" for a in rest):
            raise _bad(f"unexpected annotations on {what}")
        return self.ref(replace(e, annotations=rest)), distinct

    def _element(self, e: Element):
        return self._distinct(e, "element")

    def _field_names(self, e: Element):
        if any(a != "distinct" for a in e.annotations):
            raise _bad("unexpected annotations on field_names")
        return self._distinct(e, "field_names")

    def _fields(self, e: Element):
        if e.type != "struct" or e.is_null or not e.value:
            raise _bad("fields needs a struct with fields")
        closed = False
        if self.version == 2:
            if e.annotations not in ((), ("closed",)):
                raise _bad("unexpected annotations on fields")
            closed = bool(e.annotations)
        names = [k for k, _ in e.value]
        if len(set(names)) != len(names):
            raise _bad("fields names a field twice")
        return {k: self.ref(v, occurs=True) for k, v in e.value}, closed

    def _ordered_elements(self, e: Element):
        return tuple(self.ref(x, occurs=True, default=REQUIRED) for x in _list(e, "ordered_elements"))

    def _contains(self, e: Element):
        return tuple(_list(e, "contains"))

    def _content(self, e: Element):
        if e.type != "symbol" or e.value != "closed" or e.annotations:
            raise _bad("content can only be closed")
        return "closed"

    def _annotations(self, e: Element):
        if e.type == "list" and not e.is_null:
            allowed = ("required", "ordered", "closed") if self.version == 1 else ("required", "closed")
            if any(a not in allowed for a in e.annotations):
                if self.version == 2:
                    raise _bad("unexpected annotations on annotations")
            if self.version == 2 and not e.annotations:
                raise _bad("annotations needs required:: or closed::")
            names = []
            for x in e.value:
                if x.type != "symbol" or x.is_null or self.version == 2 and x.annotations:
                    raise _bad(f"annotations lists symbols, found {x}")
                required = "required" in x.annotations or "required" in e.annotations and "optional" not in x.annotations
                names.append((x.value, required))
            simple = SimpleAnnotations(tuple(names), "ordered" in e.annotations, "closed" in e.annotations)
            return simple if self.version == 1 else standard_annotations(simple)
        if self.version == 1 or e.is_null:
            raise _bad("annotations needs a list")
        return self.ref(e)

    def _regex(self, e: Element):
        if e.type != "string" or not e.value or any(a not in ("i", "m") for a in e.annotations):
            raise _bad(f"regex needs a string, found {e}")
        return Regex(e.value, "i" in e.annotations, "m" in e.annotations, self.version)

    def _timestamp_offset(self, e: Element):
        found = []
        for x in _list(e, "timestamp_offset"):
            if x.type != "string" or x.is_null or x.annotations:
                raise _bad("timestamp_offset lists strings")
            found.append(parse_offset(x.value))
        if not found:
            raise _bad("timestamp_offset needs an offset")
        return tuple(found)

    def _valid_values(self, e: Element):
        if "range" in e.annotations:
            return (self._range(e),)
        return tuple(self._range(x) if x.annotations == ("range",) else self._literal(x) for x in _list(e, "valid_values"))

    def _literal(self, e: Element) -> Element:
        if e.annotations:
            raise _bad(f"valid_values can't have annotations: {e}")
        return e

    def _range(self, e: Element) -> Range:
        stamps = e.type == "list" and not e.is_null and any(x.type == "timestamp" for x in e.value)
        found = ranges.parse("timestamp" if stamps else "number", e, "valid_values")
        if stamps and self.version == 1 and any(x.value is not None and x.value.offset is None for x in (found.lower, found.upper)):
            raise _bad("a timestamp range needs known offsets")
        return found

    def _ieee754_float(self, e: Element):
        if e.type != "symbol" or e.annotations or e.value not in ("binary16", "binary32", "binary64"):
            raise _bad(f"ieee754_float can't be {e}")
        return e.value


_METHODS = {"element", "field_names", "fields", "ordered_elements", "contains", "content", "annotations", "regex", "timestamp_offset", "valid_values", "ieee754_float"}


def parse_offset(text: str) -> int | None:
    m = re.fullmatch(r"([+-])(\d\d):(\d\d)", text)
    if not m or int(m[2]) > 23 or int(m[3]) > 59:
        raise _bad(f"{text} is no offset")
    return None if text == "-00:00" else (int(m[2]) * 60 + int(m[3])) * (-1 if m[1] == "-" else 1)


def show_offset(minutes: int | None) -> str:
    return "-00:00" if minutes is None else f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02}:{abs(minutes) % 60:02}"


def standard_annotations(simple: SimpleAnnotations) -> TypeRef:
    """The type over the list of a value's annotations that means the same (version 2)."""
    names = tuple(Element("symbol", n) for n, _ in simple.names)
    constraints = []
    if simple.closed:
        constraints.append(Constraint("element", (TypeRef(inline=IslType(None, (Constraint("valid_values", names),), 2)), False)))
    if needed := tuple(Element("symbol", n) for n, required in simple.names if required):
        constraints.append(Constraint("contains", needed))
    return TypeRef(inline=IslType(None, tuple(constraints), 2))


# ---- documents


def parse_schema(elements: list[Element], schema_id: str) -> IslSchema:
    """The model of a schema document's top-level values."""
    schema = IslSchema(schema_id)
    version, parser, header, footer, types = None, Parser(1), False, False, False
    for e in elements:
        marker = e.type == "symbol" and not e.annotations and e.value is not None and _MARKER.match(e.value)
        if marker:
            if e.value not in ("$ion_schema_1_0", "$ion_schema_2_0"):
                raise _bad(f"unknown version {e.value}")
            if version is not None:
                raise _bad("a version marker stands after others or after content")
            version = schema.version = int(e.value[12])
            parser = Parser(version)
            continue
        first = e.annotations[:1]
        if "schema_header" in e.annotations if schema.version == 1 else first == ("schema_header",):
            version = version or 1
            if header or schema.version == 2 and (types or len(e.annotations) > 1) or e.type != "struct" or e.is_null:
                raise _bad("one header, an unannotated struct, stands before all types")
            header = schema.header = True
            _header(schema, e)
            parser.reserved = schema.user_reserved_fields
        elif "type" in e.annotations if schema.version == 1 else first == ("type",):
            version, types = version or 1, True
            found = parser.named_type(e)
            if schema.version == 2 and any(t.name == found.name for t in schema.types):
                raise _bad(f"two types are named {found.name}")
            schema.types.append(found)
        elif "schema_footer" in e.annotations if schema.version == 1 else first == ("schema_footer",):
            if footer or e.type != "struct" or e.is_null or schema.version == 2 and len(e.annotations) > 1:
                raise _bad("one footer, an unannotated struct")
            footer = True
            _undeclared(schema, e, "schema_footer", ())
        else:
            if schema.version == 2 and any(_RESERVED.fullmatch(a) for a in e.annotations):
                raise _bad(f"open content has a reserved annotation: {e}")
            schema.open_content.append(e)
    if header != footer:
        raise _bad("a header needs a footer, and a footer a header")
    return schema


def _undeclared(schema: IslSchema, e: Element, where: str, known: tuple[str, ...]) -> None:
    if schema.version == 2:
        for key, _ in e.value:
            if key not in known and key not in schema.user_reserved_fields.get(where, ()) and _RESERVED.match(key):
                raise _bad(f"{key} isn't declared for {where}")


def _header(schema: IslSchema, e: Element) -> None:
    for x in e.fields("user_reserved_fields") if schema.version == 2 else ():
        if x.type != "struct" or x.is_null or x.annotations:
            raise _bad("user_reserved_fields is an unannotated struct")
        for key, names in x.value:
            if key not in ("schema_header", "schema_footer", "type"):
                raise _bad(f"user_reserved_fields can't have {key}")
            for n in _list(names, "user_reserved_fields"):
                if n.type != "symbol" or n.is_null or n.annotations or n.value in _METHODS or n.value in RANGED or n.value in ("name", "type", "not", "all_of", "any_of", "one_of", "occurs", "imports", "user_reserved_fields", "id"):
                    raise _bad(f"{n} can't be reserved")
                schema.user_reserved_fields.setdefault(key, []).append(n.value)
    for x in e.fields("imports"):
        for one in _list(x, "imports"):
            if one.type != "struct" or one.is_null:
                raise _bad("an import is a struct")
            get = {k: v for k, v in one.value}
            if "id" not in get or get["id"].type not in ("string", "symbol") or get["id"].is_null:
                raise _bad("an import needs an id")
            if "as" in get and "type" not in get:
                raise _bad("an alias needs a type")
            for k in ("type", "as"):
                if k in get and (get[k].type != "symbol" or get[k].is_null):
                    raise _bad(f"{k} of an import is a symbol")
            schema.imports.append(Import(get["id"].value, get["type"].value if "type" in get else None, get["as"].value if "as" in get else None))
    _undeclared(schema, e, "schema_header", ("imports", "user_reserved_fields"))


# ---- writing


def _symbol(text: str, *notes: str) -> Element:
    return Element("symbol", text, tuple(notes))


def range_element(r: Range) -> Element:
    from assayer.functions.ion import read_one

    return read_one(str(r))


def ref_element(r: TypeRef, implied: Range | None = None) -> Element:
    if r.schema is not None:
        e = Element("struct", [("id", Element("string", r.schema)), ("type", _symbol(r.name))])
    elif r.inline is not None:
        e = Element("struct", [*type_element(r.inline).value])
    else:
        e = _symbol(r.name)
    if r.nullability:
        e = replace(e, annotations=(r.nullability,))
    if r.occurs is not None and r.occurs != implied:
        body = e.value if e.type == "struct" else [("type", e)]
        occurs = {OPTIONAL: _symbol("optional"), REQUIRED: _symbol("required")}.get(r.occurs) or range_element(r.occurs)
        e = Element("struct", [*body, ("occurs", occurs)])
    return e


def constraint_field(c: Constraint) -> tuple[str, Element]:
    v, name = c.value, c.name
    if name == "unknown":
        return v
    if name in RANGED:
        e = range_element(v)
    elif isinstance(v, TypeRef):
        e = ref_element(v)
    elif name in ("element", "field_names"):
        e = ref_element(v[0])
        e = replace(e, annotations=("distinct", *e.annotations)) if v[1] else e
    elif name in ("all_of", "any_of", "one_of"):
        e = Element("list", [ref_element(r) for r in v])
    elif name == "ordered_elements":
        e = Element("list", [ref_element(r, REQUIRED) for r in v])
    elif name == "fields":
        e = Element("struct", [(k, ref_element(r, OPTIONAL)) for k, r in v[0].items()])
    elif name == "annotations":
        notes = ("ordered",) * v.ordered + ("closed",) * v.closed
        e = Element("list", [_symbol(n, "required" if q else "optional") for n, q in v.names], notes)
    elif name == "contains":
        e = Element("list", list(v))
    elif name == "valid_values":
        items = [range_element(x) if isinstance(x, Range) else x for x in v]
        e = items[0] if len(items) == 1 and items[0].annotations == ("range",) else Element("list", items)
    elif name == "regex":
        e = Element("string", v.expression, ("i",) * v.ignore_case + ("m",) * v.multi_line)
    elif name == "timestamp_offset":
        e = Element("list", [Element("string", show_offset(x)) for x in v])
    else:
        e = _symbol(v)
    return name, e


def type_element(t: IslType) -> Element:
    closed = t.version == 2
    body = [("name", _symbol(t.name))] if t.name is not None else []
    for c in t.constraints:
        name, e = constraint_field(c)
        body.append((name, replace(e, annotations=("closed",)) if name == "fields" and closed and c.value[1] else e))
    return Element("struct", body, ("type",) if t.name is not None else ())


def schema_elements(s: IslSchema) -> list[Element]:
    out = [_symbol(f"$ion_schema_{s.version}_0")]
    header = s.header or s.imports or s.user_reserved_fields
    if header:
        body = []
        if s.imports:
            rows = [[("id", Element("string", i.schema))] + [("type", _symbol(i.type))] * (i.type is not None) + [("as", _symbol(i.alias))] * (i.alias is not None) if i.type else [("id", Element("string", i.schema))] for i in s.imports]
            body.append(("imports", Element("list", [Element("struct", r) for r in rows])))
        if s.user_reserved_fields:
            body.append(("user_reserved_fields", Element("struct", [(k, Element("list", [_symbol(n) for n in v])) for k, v in s.user_reserved_fields.items()])))
        out.append(Element("struct", body, ("schema_header",)))
    out += [type_element(t) for t in s.types] + s.open_content
    return [*out, Element("struct", [], ("schema_footer",))] if header else out


def to_isl(s: IslSchema | IslType | TypeRef) -> str:
    """The text of a schema, a type or a reference."""
    from assayer.functions.ion import write

    if isinstance(s, IslSchema):
        return "\n".join(map(write, schema_elements(s)))
    return write(type_element(s) if isinstance(s, IslType) else ref_element(s))

"""Authorities, the schema system, and the resolved graph of types."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any, Protocol

from assayer.functions.ion import TYPES, Element, IonError
from assayer.functions.ionbinary import read_any
from assayer.functions.ranges import InvalidSchemaError, Range
from assayer.plans import model
from assayer.plans.model import IslSchema, IslType, TypeRef


class UnresolvableSchemaError(LookupError):
    """A schema or a type that no authority or schema has."""


class Authority(Protocol):
    def elements(self, schema_id: str) -> list[Element]:
        """The document's top-level values; FileNotFoundError if this authority hasn't the id."""


class FileAuthority:
    """Documents below a local folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def elements(self, schema_id: str) -> list[Element]:
        with open(os.path.join(self.folder, schema_id), "rb") as f:
            return read_any(f.read())


class MapAuthority:
    """Documents in a dict of id to text, or to binary Ion."""

    def __init__(self, documents: dict[str, str | bytes]):
        self.documents = documents

    def elements(self, schema_id: str) -> list[Element]:
        if schema_id not in self.documents:
            raise FileNotFoundError(schema_id)
        return read_any(self.documents[schema_id])


@dataclass(eq=False)
class Ref:
    """A resolved reference."""

    type: Type
    nullability: str = ""
    occurs: Range | None = None


@dataclass(eq=False)
class Type:
    """kind: atom (ion_type, nullable), document, or user (constraints: (name, value with Refs))."""

    name: str | None
    kind: str = "user"
    ion_type: str | None = None
    nullable: bool = False
    constraints: list[tuple[str, Any]] = field(default_factory=list)
    version: int = 1
    text: str = ""

    @property
    def label(self) -> str:
        return self.name if self.name is not None else self.text


def _builtins() -> dict[str, Type]:
    out: dict[str, Type] = {}
    for t in model.ATOMS:
        out[t] = Type(t, "atom", t)
        out[f"${t}"] = Type(f"${t}", "atom", t, True)
    out["$null"] = Type("$null", "atom", "null", True)
    out["document"] = Type("document", "document")

    def one_of(name: str, members: Iterable[str]) -> None:
        out[name] = Type(name, constraints=[("one_of", [Ref(out[m]) for m in members])])

    for name, members in model.DERIVED.items():
        one_of(name, members)
        one_of(f"${name}", [f"${m}" for m in members])
    one_of("$any", [*(f"${t}" for t in model.ATOMS), "$null", "document"])
    one_of("any", [*model.ATOMS, "document"])
    out["nothing"] = Type("nothing", constraints=[("not", Ref(out["$any"]))])
    return out


BUILTINS = _builtins()


class Schema:
    """A resolved schema.  own: the types it defines; imported: those it sees by other names or from others."""

    def __init__(self, isl: IslSchema):
        self.isl, self.id, self.version = isl, isl.id, isl.version
        self.own: dict[str, Type] = {}
        self.imported: dict[str, Type] = {}
        self.imports: list[Schema] = []

    def get_type(self, name: str) -> Type | None:
        return self.own.get(name) or self.imported.get(name)

    def get_types(self) -> Iterator[Type]:
        return iter(self.own.values())

    def get_imported_type(self, name: str) -> Type | None:
        return self.imported.get(name)

    def get_built_in_or_defined_type(self, name: str) -> Type | None:
        return BUILTINS.get(name) or self.own.get(name)

    def __getitem__(self, name: str) -> Type:
        found = self.get_type(name) or BUILTINS.get(name)
        if found is None:
            raise UnresolvableSchemaError(f"schema {self.id} has no type {name}")
        return found

    @cached_property
    def rows(self) -> list[tuple[str, str, str, str]]:
        """(schema, type, origin, text) of every type, for a catalogue."""
        own = [(self.id, t.name, "defined", t.text) for t in self.own.values()]
        return own + [(self.id, n, "imported", t.text) for n, t in self.imported.items()]


class SchemaSystem:
    """Loads schemas through authorities: the first that has an id answers for it."""

    def __init__(self, authorities: Iterable[Authority] = ()):
        self.authorities = list(authorities)
        self._loaded: dict[str, Schema] = {}
        self._loading: list[str] = []

    def add_authority(self, authority: Authority) -> None:
        self.authorities.append(authority)

    def with_authorities(self, *authorities: Authority) -> SchemaSystem:
        return SchemaSystem([*authorities])

    def _elements(self, schema_id: str) -> list[Element]:
        for a in self.authorities:
            try:
                return a.elements(schema_id)
            except (FileNotFoundError, NotADirectoryError):
                continue
            except IonError as e:
                raise IonError(f"{schema_id}: {e}") from e
        raise UnresolvableSchemaError(f"no authority has {schema_id}")

    def load_isl_schema(self, schema_id: str) -> IslSchema:
        return model.parse_schema(self._elements(schema_id), schema_id)

    def new_isl_schema(self, text: str | bytes, schema_id: str) -> IslSchema:
        return model.parse_schema(read_any(text), schema_id)

    def load_schema(self, schema_id: str) -> Schema:
        if schema_id not in self._loaded:
            if schema_id in self._loading:
                raise InvalidSchemaError("schemas import each other: " + ", ".join([*self._loading, schema_id]))
            self._loading.append(schema_id)
            try:
                self._loaded[schema_id] = self.resolve(self.load_isl_schema(schema_id))
            finally:
                self._loading.pop()
        return self._loaded[schema_id]

    def new_schema(self, text: str | bytes, schema_id: str) -> Schema:
        return self.resolve(self.new_isl_schema(text, schema_id))

    def load_schema_from_isl_schema(self, isl: IslSchema, version: int) -> Schema:
        if isl.version != version or any(t.version != version for t in isl.types):
            raise InvalidSchemaError(f"{isl.id} isn't of version {version}")
        return self.resolve(isl)

    def schema_from_isl_types(self, schema_id: str, types: Iterable[IslType], version: int) -> Schema:
        types = list(types)
        if any(t.name is None for t in types):
            raise InvalidSchemaError("a top-level type needs a name")
        return self.load_schema_from_isl_schema(IslSchema(schema_id, version, types=types), version)

    def resolve(self, isl: IslSchema) -> Schema:
        schema = Schema(isl)
        for i in isl.imports:
            other = self.load_schema(i.schema)
            schema.imports.append(other)
            if i.type is None:
                schema.imported |= other.own
            else:
                found = other.own.get(i.type)
                if found is None:
                    raise UnresolvableSchemaError(f"schema {i.schema} has no type {i.type}")
                schema.imported[i.alias or i.type] = found
        for t in isl.types:
            schema.own[t.name] = Type(t.name, version=t.version, text=model.to_isl(t))
        for t in isl.types:
            self._fill(schema, schema.own[t.name], t)
        for t in schema.own.values():
            _productive(t)
        return schema

    def _ref(self, schema: Schema, r: TypeRef) -> Ref:
        if r.schema is not None:
            found = self.load_schema(r.schema).own.get(r.name) or BUILTINS.get(r.name)
        elif r.inline is not None:
            found = Type(None, version=r.inline.version, text=model.to_isl(r.inline))
            self._fill(schema, found, r.inline)
        else:
            found = BUILTINS.get(r.name) or schema.own.get(r.name) or schema.imported.get(r.name)
        if found is None:
            raise InvalidSchemaError(f"schema {schema.id} refers to {r.name}, which is no type")
        return Ref(found, r.nullability, r.occurs)

    def _fill(self, schema: Schema, t: Type, isl: IslType) -> None:
        ref: Callable[[TypeRef], Ref] = lambda r: self._ref(schema, r)
        for c in isl.constraints:
            v = c.value
            if isinstance(v, TypeRef):
                v = ref(v)
            elif c.name in ("element", "field_names"):
                v = (ref(v[0]), v[1])
            elif c.name in ("all_of", "any_of", "one_of", "ordered_elements"):
                v = [ref(r) for r in v]
            elif c.name == "fields":
                v = ({k: ref(r) for k, r in v[0].items()}, v[1])
            elif c.name in ("unknown", "content"):
                continue
            t.constraints.append((c.name, v))
        if isl.version == 1 and not any(c.name == "type" for c in isl.constraints):
            t.constraints.append(("type", Ref(BUILTINS["any"])))


def _productive(start: Type) -> None:
    """A type that is checked again on the same value, with nothing consumed, has no meaning."""
    path: list[Type] = []
    done: set[int] = set()

    def visit(t: Type) -> None:
        if any(t is p for p in path):
            raise InvalidSchemaError(f"type {t.label} is defined by itself")
        if id(t) in done:
            return
        path.append(t)
        for name, v in t.constraints:
            for r in [v] if isinstance(v, Ref) and name != "annotations" else v if name in ("all_of", "any_of", "one_of") else []:
                visit(r.type)
        path.pop()
        done.add(id(t))

    visit(start)


__all__ = ["BUILTINS", "TYPES", "FileAuthority", "InvalidSchemaError", "MapAuthority", "Ref", "Schema", "SchemaSystem", "Type", "UnresolvableSchemaError"]

"""Schema documents: what loads, what doesn't, imports, writing, builders."""

from __future__ import annotations

import pytest

from assayer.functions.ion import read_all, read_one
from assayer.functions.ranges import InvalidSchemaError, Range, parse
from assayer.operators.interpret import is_valid
from assayer.plans import model
from assayer.plans.builders import v1, v2
from assayer.plans.system import FileAuthority, MapAuthority, SchemaSystem, UnresolvableSchemaError

BAD = [
    "$ion_schema_4_5", "$ion_schema_2_1", "$ion_schema_1_0 $ion_schema_2_0",
    "schema_header::{}", "type::{name: t} schema_footer::{}", "type::{type: int}", "type::{name: a, name: b}", 'type::{name: "t"}', "type::{name: x::t}", "type::{name: t, occurs: 1}",
    "type::{name: t, type: nowhere}", "type::{name: t, type: null}", "type::{name: t, type: 5}", "type::{name: t, all_of: int}", "type::{name: t, any_of: null.list}",
    "type::{name: t, fields: {}}", "type::{name: t, fields: {a: int, a: int}}", "type::{name: t, fields: []}", "type::{name: t, content: open}",
    "type::{name: t, fields: {a: {type: int, occurs: 0}}}", "type::{name: t, fields: {a: {type: int, occurs: often}}}", "type::{name: t, fields: {a: {type: int, occurs: null}}}", "type::{name: t, ordered_elements: [{type: int, occurs: range::[0, 0]}]}",
    "type::{name: t, valid_values: range::[5, 1]}", "type::{name: t, valid_values: range::[1, exclusive::1]}", "type::{name: t, valid_values: range::[min, max]}", "type::{name: t, valid_values: range::[max, 5]}", "type::{name: t, valid_values: range::[1]}", "type::{name: t, valid_values: [x::5]}", "type::{name: t, valid_values: 5}", "type::{name: t, valid_values: range::[2000T, 2001T]}",
    "type::{name: t, codepoint_length: -1}", "type::{name: t, codepoint_length: 1.5}", "type::{name: t, byte_length: range::[exclusive::1, exclusive::2]}", "type::{name: t, precision: 0}", "type::{name: t, timestamp_precision: range::[second, month]}", "type::{name: t, timestamp_precision: hour}",
    'type::{name: t, timestamp_offset: []}', 'type::{name: t, timestamp_offset: ["+24:00"]}', 'type::{name: t, timestamp_offset: ["1:00"]}', "type::{name: t, ieee754_float: binary8}",
    'type::{name: t, regex: ""}', 'type::{name: t, regex: x::"a"}', 'type::{name: t, regex: "(?=a)"}', 'type::{name: t, regex: "a+?"}', 'type::{name: t, regex: "[a&&b]"}', 'type::{name: t, regex: "[a"}', 'type::{name: t, regex: "[\\\\d]"}', 'type::{name: t, regex: "a{,}"}', 'type::{name: t, regex: "\\\\b"}',
    "type::{name: t, type: nullable::u} type::{name: u, type: int}", "type::{name: t, type: t}", "type::{name: t, all_of: [u]} type::{name: u, type: t}",
    "$ion_schema_2_0 type::{name: t} type::{name: t}", "$ion_schema_2_0 type::{name: t, type: nullable::int}", "$ion_schema_2_0 type::{name: t, type: {type: int, occurs: 1}}", "$ion_schema_2_0 type::{name: t, not_a_constraint: 5}",
    "$ion_schema_2_0 type::{name: t, fields: x::{a: int}}", "$ion_schema_2_0 type::{name: t, element: x::int}", "$ion_schema_2_0 type::{name: t, annotations: [a]}", "$ion_schema_2_0 type::{name: t, annotations: closed::[required::a]}",
    "$ion_schema_2_0 type::{name: t} schema_header::{} schema_footer::{}", "$ion_schema_2_0 schema_header::{whatever: 1} schema_footer::{}", "$ion_schema_2_0 x::type::{name: t} type::x::{name: u}", "$ion_schema_2_0 schema_header::{} schema_footer::{whatever: 1}",
    "$ion_schema_2_0 schema_header::{user_reserved_fields: {types: [a]}} schema_footer::{}", "$ion_schema_2_0 schema_header::{user_reserved_fields: {type: [regex]}} schema_footer::{}", "schema_header::{imports: [{type: int}]} schema_footer::{}", 'schema_header::{imports: [{id: "gone"}]} schema_footer::{}',
]

GOOD = [
    "", "$ion_schema_1_0", "$ion_schema_2_0", "schema_header::{} schema_footer::{}", "type::{name: t}", "type::{name: t, type: int, open: 5}", "type::{name: t, type: u} type::{name: u, type: int}",
    "type::{name: t, one_of: [int, {type: list, element: t}]}", "type::{name: a, fields: {b: b}} type::{name: b, fields: {a: a}}", "$ion_schema_2_0 type::{name: t, element: distinct::int}", "$ion_schema_2_0 type::{name: t, annotations: closed::[a]}",
    "$ion_schema_2_0 schema_header::{user_reserved_fields: {type: [note], schema_header: [by], schema_footer: [end]}, by: me} type::{name: t, note: 5} schema_footer::{end: 1}", "some::thing type::{name: t} other", 'type::{name: t, regex: "[a-z\\\\]]{2,3}x?"}',
    "type::{name: t, type: nullable::number}", "type::{name: t, valid_values: range::[2000T, 2001T]}".replace("2000T, 2001T", "2000-01-01T00:00Z, max"),
]


@pytest.mark.parametrize("text", BAD)
def test_bad_documents(text):
    with pytest.raises((InvalidSchemaError, UnresolvableSchemaError)):
        SchemaSystem().new_schema(text, "bad")


@pytest.mark.parametrize("text", GOOD)
def test_good_documents_and_their_writing(text):
    isl = SchemaSystem().new_isl_schema(text, "good")
    again = model.parse_schema(read_all(model.to_isl(isl)), "good")
    assert again.types == isl.types and again.version == isl.version and [e.key() for e in again.open_content] == [e.key() for e in isl.open_content]
    SchemaSystem().resolve(isl)


DOCS = {
    "base": "type::{name: small, valid_values: range::[0, 9]} type::{name: hidden, type: int}",
    "whole": 'schema_header::{imports: [{id: "base"}]} type::{name: t, type: small} schema_footer::{}',
    "one": 'schema_header::{imports: [{id: "base", type: small}]} type::{name: t, type: small} schema_footer::{}',
    "alias": 'schema_header::{imports: [{id: "base", type: small, as: tiny}]} type::{name: t, type: tiny} schema_footer::{}',
    "inline": 'type::{name: t, type: {id: "base", type: small}}',
    "unseen": 'schema_header::{imports: [{id: "base", type: small}]} type::{name: t, type: hidden} schema_footer::{}',
    "transitive": 'schema_header::{imports: [{id: "one", type: t}]} type::{name: u, type: small} schema_footer::{}',
    "through": 'schema_header::{imports: [{id: "one", type: t, as: x}]} type::{name: u, type: x} schema_footer::{}',
    "no_type": 'schema_header::{imports: [{id: "base", type: gone}]} schema_footer::{}',
    "diamond": 'schema_header::{imports: [{id: "whole"}, {id: "alias", type: t, as: other}, {id: "base"}]} type::{name: u, all_of: [small, other, t]} schema_footer::{}',
    "circle": 'schema_header::{imports: [{id: "circle2"}]} schema_footer::{}',
    "circle2": 'schema_header::{imports: [{id: "circle"}]} schema_footer::{}',
    "bad_inline": '$ion_schema_2_0 type::{name: t, type: {id: "base", type: small, as: x}}',
}


@pytest.mark.parametrize("name", ["whole", "one", "alias", "inline"])
def test_imports(name):
    t = SchemaSystem([MapAuthority(DOCS)]).load_schema(name)["t"]
    assert is_valid(read_one("5"), t) and not is_valid(read_one("10"), t)


@pytest.mark.parametrize("name", ["unseen", "transitive", "no_type", "circle", "bad_inline", "gone"])
def test_imports_that_fail(name):
    with pytest.raises((InvalidSchemaError, UnresolvableSchemaError)):
        SchemaSystem([MapAuthority(DOCS)]).load_schema(name)


def test_imports_of_imports():
    system = SchemaSystem([MapAuthority(DOCS)])
    assert is_valid(read_one("5"), system.load_schema("through")["u"])
    u = system.load_schema("diamond")["u"]
    assert is_valid(read_one("5"), u) and not is_valid(read_one("50"), u)
    assert system.load_schema("base") is system.load_schema("base")


def test_authorities_are_asked_in_turn(tmp_path):
    (tmp_path / "local").write_text("type::{name: t, type: bool}")
    system = SchemaSystem([MapAuthority({"base": DOCS["base"]}), FileAuthority(str(tmp_path))])
    assert is_valid(read_one("true"), system.load_schema("local")["t"])
    system.add_authority(MapAuthority({"late": "type::{name: t}"}))
    assert system.load_schema("late").get_type("t") is not None
    with pytest.raises(UnresolvableSchemaError):
        system.load_schema("nowhere")


def test_accessors():
    s = SchemaSystem([MapAuthority(DOCS)]).load_schema("alias")
    assert s.id == "alias" and [t.name for t in s.get_types()] == ["t"]
    assert s.get_imported_type("tiny") is not None and s.get_type("small") is None
    assert s.get_built_in_or_defined_type("int") is not None and s.get_built_in_or_defined_type("tiny") is None


@pytest.mark.parametrize(
    ("text", "built"),
    [
        ("{type: int}", v1.anonymous_type([v1.type("int")])),
        ("{type: nullable::int}", v1.anonymous_type([v1.type(v1.nullable("int"))])),
        ("type::{name: t, fields: {a: {type: int, occurs: required}, b: string}}", v1.named_type("t", [v1.fields({"a": v1.occurring(v1.anonymous_type_ref([v1.type("int")]), 1), "b": "string"})])),
        ("{all_of: [int, {precision: range::[1, 3]}]}", v1.anonymous_type([v1.all_of(["int", v1.anonymous_type_ref([v1.precision("range::[1, 3]")])])])),
        ("{not: int, codepoint_length: 5}", v1.anonymous_type([v1.codepoint_length(5), v1.not_("int")])),
        ("{valid_values: [1, range::[5, 7]]}", v1.anonymous_type([v1.valid_values([1, v1.number_range("range::[5, 7]")])])),
        ("{ordered_elements: [bool, {type: int, occurs: range::[0, max]}]}", v1.anonymous_type([v1.ordered_elements(["bool", v1.occurring(v1.anonymous_type_ref([v1.type("int")]), "range::[0, max]")])])),
        ('{annotations: ordered::[required::a, optional::b], timestamp_offset: ["+01:00"]}', v1.anonymous_type([v1.annotations([("a", True), ("b", False)], ordered=True), v1.timestamp_offset(["+01:00"])])),
        ("{scale: 2, contains: [1, [2]]}", v1.anonymous_type([v1.scale(2), v1.contains([1, [2]])])),
    ],
)
def test_builders_equal_texts_of_version_1(text, built):
    assert v1.load_isl_type(text) == built


@pytest.mark.parametrize(
    ("text", "built"),
    [
        ("{element: distinct::int}", v2.anonymous_type([v2.element("int", distinct=True)])),
        ("{fields: closed::{a: int}}", v2.anonymous_type([v2.fields({"a": "int"}, closed=True)])),
        ("{field_names: distinct::symbol, exponent: 3}", v2.anonymous_type([v2.exponent(3), v2.field_names("symbol", distinct=True)])),
        ('{regex: i::"a|b"}', v2.anonymous_type([v2.regex("a|b", ignore_case=True)])),
        ("{annotations: closed::required::[a]}", v2.anonymous_type([v2.annotations(["a"], closed=True, required=True)])),
        ("{ieee754_float: binary32, type: $null_or::float}", v2.anonymous_type([v2.ieee754_float("binary32"), v2.type(v2.nullable("float"))])),
        ("{utf8_byte_length: range::[1, 2], timestamp_precision: day}", v2.anonymous_type([v2.utf8_byte_length("range::[1, 2]"), v2.timestamp_precision("day")])),
    ],
)
def test_builders_equal_texts_of_version_2(text, built):
    assert v2.load_isl_type(text) == built


def test_programmatic_schemas():
    system = SchemaSystem()
    s = system.schema_from_isl_types("made", [v2.named_type("t", [v2.type("int")])], 2)
    assert is_valid(read_one("5"), s["t"])
    with pytest.raises(InvalidSchemaError):
        system.schema_from_isl_types("made", [v2.named_type("t", []), v1.named_type("u", [])], 2)
    with pytest.raises(InvalidSchemaError):
        system.schema_from_isl_types("made", [v2.anonymous_type([])], 2)
    with pytest.raises(InvalidSchemaError):
        system.load_schema_from_isl_schema(v1.schema("made", []), 2)


def test_equality_ignores_the_order_of_constraints():
    assert v1.load_isl_type("{type: int, precision: 1}") == v1.load_isl_type("{precision: 1, type: int}")
    assert v1.load_isl_type("{type: int}") != v1.load_isl_type("{type: int, type: int}")


@pytest.mark.parametrize(
    ("kind", "text", "inside", "outside"),
    [
        ("count", "range::[1, exclusive::4]", [1, 3], [0, 4]),
        ("count", "5", [5], [4, 6]),
        ("whole", "range::[-3, max]", [-3, 100], [-4]),
        ("precision", "range::[exclusive::day, second]", [-1, 0], [-2, 3]),
    ],
)
def test_ranges(kind, text, inside, outside):
    r = parse(kind, read_one(text))
    assert all(x in r for x in inside) and not any(x in r for x in outside)
    assert parse(kind, read_one(str(r))) == r
    assert isinstance(r, Range)


def test_a_single_value_prints_bare():
    assert str(parse("count", read_one("5"))) == "5"
    assert str(parse("count", read_one("range::[min, 5]"))) == "range::[min, 5]"
    assert str(parse("precision", read_one("month"))) == "month"

from __future__ import annotations

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.functions.ion import Element, IonError, from_python, read_all, read_one, write
from assayer.functions.ionbinary import MARKER, read_any, write_binary

TEXTS = [
    "null", "null.int", "true", "5", "-5", "0x1F", "0b101", "1_000", "5.", "5.0", "-0.0", "5d3", "5e0", "nan", "+inf", "-inf",
    "2000T", "2000-01T", "2000-01-01", "2000-01-01T00:00Z", "2000-01-01T00:00:00.5-08:00", "2000-01-01T00:00:00-00:00",
    '"a\\nb\\u00e9"', "'a b'", "abc", "$a", "{{ aGVsbG8= }}", '{{ "hello" }}', "[1, 2, [3]]", "(a + b)", "{a: 1, a: 2, 'b c': x::y::3}", "a::b::5", "'''a''' '''b'''", "[]", "{}", "()",
]


@pytest.mark.parametrize("text", TEXTS)
def test_written_text_reads_the_same(text):
    e = read_one(text)
    assert read_one(write(e)).key() == e.key()


def test_types_and_values():
    assert [e.type for e in read_all("1 1.0 1e0 a \"a\" [a] (a) {a: 1} {{}} {{\"\"}} 2000T true null")] == ["int", "decimal", "float", "symbol", "string", "list", "sexp", "struct", "blob", "clob", "timestamp", "bool", "null"]
    assert read_one("a::b::5").annotations == ("a", "b")
    assert read_one("42.0").value.as_tuple().exponent == -1
    assert read_one("'''a''' '''b'''").value == "ab"
    assert [e.value for e in read_all("1 // one\n /* two */ 3")] == [1, 3]
    assert read_one("{a: 1, a: 2}").fields("a")[1].value == 2
    assert read_one("1_000").value == 1000 and read_one("0xff").value == 255


@pytest.mark.parametrize("text", ["[1, 2", "{a 1}", '"abc', "{a: 1", "1 2", "2000-13-01", "2000-01-32T", "a::", "]", "{{ a", "1__0"])
def test_what_is_no_ion_is_told(text):
    with pytest.raises((IonError, ValueError)):
        read_one(text)


def test_equality_of_values():
    key = lambda t: read_one(t).key()
    assert key("2.0") != key("2.00") and key("5") != key("5.") and key("nan") == key("nan")
    assert key("{a: 1, b: 2}") == key("{b: 2, a: 1}")
    assert key("[1, 2]") != key("[2, 1]") and key("[1]") != key("(1)")
    assert key("a::5") != key("5") and read_one("a::5").data() == read_one("5").data()


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(st.characters(exclude_categories=["Cs"])) | st.decimals(allow_nan=False, allow_infinity=False), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=5), x, max_size=4), max_leaves=12))
def test_round_trip_of_anything(value):
    e = from_python(value)
    assert isinstance(e, Element)
    assert read_one(write(e)).key() == e.key()


def test_decimals_keep_their_digits():
    assert read_one(write(from_python(Decimal("1.500")))).value.as_tuple() == Decimal("1.500").as_tuple()


@pytest.mark.parametrize("text", TEXTS)
def test_binary_round_trip(text):
    values = read_all(text) + read_all("then::[x, $y, {then: 1}]")
    assert [e.key() for e in read_any(write_binary(values))] == [e.key() for e in values]


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats() | st.binary() | st.text(st.characters(exclude_categories=["Cs"])) | st.decimals(allow_nan=False, allow_infinity=False), lambda x: st.lists(x, max_size=20) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=5), x, max_size=4), max_leaves=30))
def test_binary_round_trip_of_anything(value):
    e = from_python(value)
    assert [x.key() for x in read_any(write_binary([e, e]))] == [e.key()] * 2


def test_known_bytes():
    of = lambda h: [write(e) for e in read_any(MARKER + bytes.fromhex(h.replace(" ", "")))]
    assert of("0F 1F 10 11 20 21 05 31 05 22 01 00") == ["null", "null.bool", "false", "true", "0", "5", "-5", "256"]
    assert of("40 48 3F F8 00 00 00 00 00 00 44 3F C0 00 00") == [write(read_one(x)) for x in ("0e0", "1.5e0", "1.5e0")]
    assert of("52 C1 05 50 52 C1 85") == [write(read_one(x)) for x in ("0.5", "0d0", "-0.5")]
    assert of("63 C0 0F D0") == ["2000T"] and of("68 80 0F D0 81 81 80 80 80") == ["2000-01-01T00:00:00Z"]
    assert of("71 04 82 68 69 B2 21 01 C0 D2 84 20") == ["name", '"hi"', "[1]", "()", "{name: 0}"]
    assert of("E4 81 84 21 05") == ["name::5"] and of("02 00 00 21 05") == ["5"]
    assert of("EB 81 83 D8 87 B6 83 61 62 63 81 64 71 0A 71 0B") == ["abc", "d"]


@pytest.mark.parametrize("data", ["e0020 0ea", "e00100ea 8f f0", "e00100ea 85 61", "e00100ea 13", "e00100ea 71 63", "e00100ea 43 00 00 00", "e00100ea 81 ff", "ff fe 00", "e00100ea e3 81 84 00", "e00100ea be"])
def test_broken_binary(data):
    with pytest.raises(IonError):
        read_any(bytes.fromhex(data.replace(" ", "")))


def test_values_nested_deeply():
    from assayer.operators.interpret import validate
    from assayer.plans.system import BUILTINS, SchemaSystem

    t = SchemaSystem().new_schema("$ion_schema_2_0 type::{name: t, one_of: [int, {type: list, element: t}]}", "s")["t"]
    for n in (10, 900, 3000):
        text = "[" * n + "5" + "]" * n
        value = read_all(text)[0]
        assert write(value) == text and validate(value, BUILTINS["any"]) is None and validate(value, t) is None
        found = validate(read_all(text.replace("5", "a"))[0], t)
        assert len(found.leaves()) >= 1 and found.tree().count("\n") >= n

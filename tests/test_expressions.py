"""Expressions over typed columns and VARIANTs against the interpreter over Ion text."""

from __future__ import annotations

import random
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.functions.ion import Element, IonError, read_one
from assayer.operators import api, interpret
from assayer.operators.api import Options, is_valid, validate, validate_document, violations
from assayer.plans.system import SchemaSystem

BODIES = [
    (1, "fields: {i: {type: int, valid_values: range::[0, exclusive::5], occurs: required}}"),
    (1, "fields: {i: {valid_values: [1, 2, 3]}, s: {codepoint_length: range::[1, 3]}}"),
    (2, "fields: {s: {regex: \"^a|b$\", occurs: required}, f: {ieee754_float: binary16}}"),
    (2, "fields: {s: {not: {valid_values: [\"a\", \"ab\"]}}, l: {element: {valid_values: range::[min, 3]}}}"),
    (2, "fields: {l: {element: distinct::int, container_length: range::[0, 3], occurs: required}}"),
    (2, "fields: {l: {contains: [1, 2]}}"),
    (1, "fields: {l: {ordered_elements: [{valid_values: [1, 2], occurs: optional}, {type: int, occurs: range::[1, 2]}, {valid_values: [3], occurs: range::[0, max]}], occurs: required}}"),
    (2, "fields: {b: {type: bool, valid_values: [true], occurs: required}, m: {fields: closed::{x: int, y: {valid_values: [1]}}}}"),
    (2, "fields: {m: {fields: {x: {occurs: required, valid_values: range::[2, max]}}, element: int, field_names: {codepoint_length: 1}}}"),
    (2, "any_of: [{fields: {i: {valid_values: [1], occurs: required}}}, {fields: {s: {valid_values: [\"a\"], occurs: required}}}]"),
    (2, "one_of: [{fields: {i: {valid_values: range::[2, max], occurs: required}}}, {fields: {s: {utf8_byte_length: 2, occurs: required}}}]"),
    (2, "not: {fields: {i: {valid_values: range::[2, max], occurs: required}}}"),
    (1, "fields: {d: {precision: range::[1, 3], scale: 2, occurs: required}}"),
    (1, "fields: {f: {valid_values: range::[exclusive::0.5, 2], occurs: required}, n: {fields: {k: {type: int, occurs: required}, t: string}}}"),
    (2, "fields: closed::{i: int, s: string, f: float, b: bool, l: list, m: struct, d: decimal, n: struct}"),
    (2, "container_length: range::[4, 6]"),
]


def some(rng: random.Random) -> dict:
    maybe = lambda x: x if rng.random() < 0.8 else None
    return {
        "i": maybe(rng.randint(-1, 6)),
        "s": maybe(rng.choice(["", "a", "ab", "b", "é", "éa", "abcd", "xb\n"])),
        "f": maybe(rng.choice([0.0, 0.5, 1.0, 1.5, 0.1, 65504.0, 65505.0, float("nan"), float("inf"), -2.0])),
        "b": maybe(rng.random() < 0.5),
        "l": maybe([rng.randint(1, 4) for _ in range(rng.randint(0, 4))]),
        "m": maybe({k: rng.randint(1, 3) for k in rng.sample(["x", "y", "zz"], rng.randint(0, 3))}),
        "d": maybe(rng.choice([Decimal("0.00"), Decimal("1.50"), Decimal("12.34"), Decimal("-0.07")])),
        "n": maybe({"k": maybe(rng.randint(0, 3)), "t": maybe(rng.choice(["p", "q"]))}),
    }


def ion(x) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, dict):
        return "{" + ", ".join(f"{k}: {ion(v)}" for k, v in x.items() if v is not None) + "}"
    if isinstance(x, list):
        return "[" + ", ".join(map(ion, x)) + "]"
    if isinstance(x, str):
        return '"' + x.replace("\n", "\\n") + '"'
    if isinstance(x, float):
        return {"nan": "nan", "inf": "+inf"}.get(str(x), f"{x!r}e0")
    return str(x)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    return [some(rng) for _ in range(300)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    ddl = "id int, i int, s string, f double, b boolean, l array<int>, m map<string, int>, d decimal(6,2), n struct<k: int, t: string>"
    return spark.createDataFrame([(k, *r.values()) for k, r in enumerate(rows)], ddl).cache()


@pytest.mark.parametrize(("version", "body"), BODIES)
def test_rows_as_structs(frame, rows, version, body):
    schema = SchemaSystem().new_schema(f"$ion_schema_{version}_0 type::{{name: t, {body}}}", "x")
    want = [interpret.is_valid(read_one(ion(r)), schema["t"]) for r in rows]
    own = frame.drop("id")
    got = [r["v"] for r in frame.select("id", is_valid(own, "t", schema).alias("v")).orderBy("id").collect()]
    assert got == want
    leaves = [r["n"] for r in frame.select("id", F.size(violations(own, "t", schema)).alias("n")).orderBy("id").collect()]
    assert [n == 0 for n in leaves] == want
    assert validate(own, "t", schema, mode="filter").count() == sum(want)
    assert validate(own, "t", schema, mode="reject").count() == len(want) - sum(want)


VARIANTS = ['{"i": 1, "s": "a"}', '{"i": null}', '{"i": "x"}', "[1, 2, 3]", '[1, "a", null]', "[]", "5", "5.25", '"a"', '"abc"', "null", "true", '{"l": [1, 2]}', '{"l": [3, 3]}', '{"l": {"x": 1}}', "{}", "12345678901234567890"]
VARIANT_BODIES = [
    "type: int", "type: decimal", "type: text", "type: $null", "type: list", "type: struct", "type: $any", "type: number", "not: int", "element: int", "element: distinct::$any", "container_length: range::[1, 3]", "contains: [1]", "contains: [1, a]",
    "fields: {i: int}", "fields: {i: {type: int, occurs: required}}", "fields: closed::{i: $any, s: text}", "fields: {l: {element: {valid_values: range::[1, 2]}, occurs: required}}", "field_names: {codepoint_length: 1}", "valid_values: [5, a, true, null]", "valid_values: range::[1, 6]",
    "regex: \"^a\"", "codepoint_length: 1", "precision: 3", "exponent: -2", "ordered_elements: [int, {type: any, occurs: range::[0, max]}]", "one_of: [int, {type: list, element: int}]", "type: $null_or::int", "any_of: [bool, {container_length: 0}]",
]


@pytest.mark.parametrize("body", VARIANT_BODIES)
def test_variants(spark, body):
    schema = SchemaSystem().new_schema(f"$ion_schema_2_0 type::{{name: t, {body}}}", "x")
    # JSON has one kind of text; a literal symbol equals a string of a VARIANT.
    as_text = body.replace("a,", '"a",').replace("a]", '"a"]')
    plain = SchemaSystem().new_schema(f"$ion_schema_2_0 type::{{name: t, {as_text}}}", "x")
    want = [interpret.is_valid(read_one(x), plain["t"]) for x in VARIANTS]
    df = spark.createDataFrame(list(enumerate(VARIANTS)), "id int, x string").withColumn("v", F.parse_json("x"))
    got = [r["ok"] for r in df.select("id", is_valid(df, "t", schema, "v").alias("ok")).orderBy("id").collect()]
    assert dict(zip(VARIANTS, got, strict=True)) == dict(zip(VARIANTS, want, strict=True))


def test_null_policies(spark):
    df = spark.createDataFrame([(1,), (None,)], "x int")
    schema = SchemaSystem().new_schema("$ion_schema_2_0 type::{name: a, type: $int} type::{name: b, type: $null_or::int} type::{name: c, type: $null} type::{name: d, type: int} type::{name: e, not: int}", "x")

    def of(t, null_as):
        return [r["v"] for r in df.select("x", is_valid(df, t, schema, "x", Options(null_as=null_as)).alias("v")).orderBy(F.col("x").asc_nulls_last()).collect()]

    assert of("a", "typed_null") == [True, True] and of("a", "untyped_null") == [True, False]
    assert of("b", "typed_null") == [True, False] and of("b", "untyped_null") == [True, True]
    assert of("c", "typed_null") == [False, False] and of("c", "untyped_null") == [False, True]
    assert of("d", "typed_null") == [True, False] and of("e", "typed_null") == [False, True]


def test_three_valued_logic_never_leaks(spark):
    df = spark.createDataFrame([(None, [1, None]), (2, [None])], "x int, l array<int>")
    for body in ("not: {valid_values: [1]}", "one_of: [{valid_values: [1]}, {valid_values: [2]}]", "any_of: [{valid_values: [1]}, {not: {valid_values: range::[1, 5]}}]"):
        schema = SchemaSystem().new_schema(f"$ion_schema_2_0 type::{{name: t, {body}}}", "x")
        assert all(r["v"] is not None for r in df.select(is_valid(df, "t", schema, "x").alias("v")).collect())
    for body in ("element: {valid_values: [1]}", "contains: [1]", "element: distinct::int", "not: {element: int}"):
        schema = SchemaSystem().new_schema(f"$ion_schema_2_0 type::{{name: t, {body}}}", "x")
        assert all(r["v"] is not None for r in df.select(is_valid(df, "t", schema, "l").alias("v")).collect())


def test_timestamps(spark):
    df = spark.sql("SELECT timestamp'2000-01-01 00:00:00.5Z' AS z, timestamp_ntz'2000-01-01 00:00:00' AS l, date'2000-01-01' AS d UNION ALL SELECT timestamp'1999-01-01 00:00:00Z', timestamp_ntz'1999-01-01 00:00:00.123', date'1999-12-31'")

    def of(col, body):
        schema = SchemaSystem().new_schema(f"$ion_schema_2_0 type::{{name: t, {body}}}", "x")
        assert validate(df, "t", schema, col, mode="filter").count() == df.where(is_valid(df, "t", schema, col)).count()
        return sorted((r["v"] for r in df.select(is_valid(df, "t", schema, col).alias("v")).collect()), reverse=True)

    for c in "zld":
        assert of(c, "valid_values: range::[2000-01-01T00:00:00Z, max]") == [True, False]
        assert of(c, "valid_values: range::[min, exclusive::2000-01-01T00:00:00-00:00]") == [True, False]
    assert of("l", "valid_values: [2000-01-01T00:00:00-00:00]") == [True, False]
    assert of("d", "timestamp_precision: day") == [True, True] and of("l", "timestamp_precision: millisecond") == [True, False]
    assert of("l", 'timestamp_offset: ["-00:00"]') == [True, True] and of("z", 'timestamp_offset: ["-00:00"]') == [False, False]


def test_timestamp_ranges_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    schema = SchemaSystem().new_schema("$ion_schema_2_0 type::{name: t, valid_values: range::[1995-01-01T00:00:00-00:00, max]}", "x")
    plan = validate(df, "t", schema, "o_orderdate", mode="filter")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan


def test_annotations(spark):
    rows = [["a", "b"], ["b"], ["b", "a"], [], None, ["x", "b"], ["b", "c"], ["b", "d"], ["a", "b", "c", "d"]]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, notes array<string>").withColumn("x", F.lit(5))
    for version, body in [(1, "annotations: [required::a, b]"), (1, "annotations: closed::[required::a, b]"), (1, "annotations: ordered::[a, required::b, c, required::d]"), (1, "annotations: closed::ordered::[a, required::b]"), (2, "annotations: closed::required::[a, b]"), (2, 'annotations: {container_length: 2, element: {regex: "^[a-c]$"}}')]:
        schema = SchemaSystem().new_schema(f"$ion_schema_{version}_0 type::{{name: t, {body}}}", "x")
        want = [interpret.is_valid(read_one("".join(f"{a}::" for a in r or []) + "5"), schema["t"]) for r in rows]
        got = [r["v"] for r in df.select("id", is_valid(df, "t", schema, "x", Options(annotations=F.col("notes"))).alias("v")).orderBy("id").collect()]
        assert got == want, body


def test_documents_by_group(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 7), (2, 0, 5), (2, 1, 5), (3, 0, None)], "g int, o int, x int")

    def of(body, **more):
        schema = SchemaSystem().new_schema(f"$ion_schema_2_0 type::{{name: t, {body}}}", "x")
        return {r["g"]: r["is_valid"] for r in validate_document(df, "t", schema, "x", by=["g"], **more).collect()}

    assert of("type: document, element: int") == {1: True, 2: True, 3: False}
    assert of("container_length: 2") == {1: True, 2: True, 3: False}
    assert of("element: distinct::$int") == {1: True, 2: False, 3: True}
    assert of("contains: [7]") == {1: True, 2: False, 3: False}
    assert of("ordered_elements: [{valid_values: [5]}, int]", order_by="o") == {1: True, 2: True, 3: False}
    assert of("any_of: [{contains: [7]}, {container_length: 1}]") == {1: True, 2: False, 3: True}
    assert of("type: int") == {1: False, 2: False, 3: False}


def test_an_empty_frame_is_an_empty_document(spark):
    df = spark.createDataFrame([], "x int")
    schema = SchemaSystem().new_schema("$ion_schema_2_0 type::{name: t, type: document, element: int} type::{name: u, contains: [1]}", "x")
    assert validate_document(df, "t", schema, "x").first()["is_valid"] is True
    assert validate_document(df, "u", schema, "x").first()["is_valid"] is False


def test_columns_with_awkward_names(spark):
    df = spark.createDataFrame([(1, "a", True)], "`a.b` int, `is valid` string, is_valid boolean")
    schema = SchemaSystem().new_schema("$ion_schema_2_0 type::{name: t, fields: {'a.b': {valid_values: [1], occurs: required}, 'is valid': string, is_valid: bool}}", "x")
    assert validate(df, "t", schema, mode="filter").count() == 1
    assert validate(df, "t", schema).first()["is_valid"] is True


def test_long_sequences_are_interpreted(spark):
    df = spark.createDataFrame([(k, [1] * k) for k in (2, 3, 70, 100, 101)], "k int, l array<int>")
    schema = SchemaSystem().new_schema("$ion_schema_2_0 type::{name: t, ordered_elements: [{type: int, occurs: range::[3, 100]}]}", "x")
    assert {r["k"]: r["is_valid"] for r in validate(df, "t", schema, "l").collect()} == {2: False, 3: True, 70: True, 100: True, 101: False}
    assert validate(df, "t", schema, "l", mode="reject").count() == 2


def test_documents_of_any_length(spark):
    """Stretches of one document in many tasks, against the interpreter."""
    rng = random.Random(5)
    body = "ordered_elements: [{valid_values: [1, 2], occurs: range::[0, max]}, {valid_values: [2, 3], occurs: range::[1, 3]}, {valid_values: [4], occurs: optional}, {type: int, occurs: range::[0, 2]}]"
    schema = SchemaSystem().new_schema(f"$ion_schema_2_0 type::{{name: t, {body}}} type::{{name: u, any_of: [t, {{container_length: 2}}]}}", "x")
    docs = {g: [rng.choice([1, 2]) for _ in range(rng.randrange(40))] + [rng.choice([2, 3]) for _ in range(rng.randrange(4))] + [rng.randint(1, 4) for _ in range(rng.randrange(4))] for g in range(60)}
    docs[60] = [1] * 3000 + [3, 4, 9, 9]
    docs[61] = [1] * 3000 + [4, 3]
    rows = [(g, k, v) for g, d in docs.items() for k, v in enumerate(d)] + [(None, 0, 1), (None, 1, 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, at int, x int").repartition(7)
    for name in "tu":
        want = {g: interpret.is_valid(interpret.Document(tuple(read_one(str(v)) for v in d)), schema[name]) for g, d in docs.items() if d} | {None: True}
        got = {r["g"]: r["is_valid"] for r in validate_document(df, name, schema, "x", by=["g"], order_by="at").collect()}
        assert got == want and len(set(want.values())) == 2
    for g in (60, 61):
        one = validate_document(df.where(f"g = {g}"), "t", schema, "x", order_by="at").collect()
        assert [r["is_valid"] for r in one] == [g == 60]
    assert validate_document(df.limit(0), "t", schema, "x", order_by="at").first()["is_valid"] is False
    plan = validate_document(df, "t", schema, "x", by=["g"], order_by="at")._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan


def test_distinct_members_of_different_sql_types(spark):
    """1 and 1L are one Ion int; an int and a double are two values."""
    t = SchemaSystem().new_schema("$ion_schema_2_0 type::{name: t, element: distinct::any}", "s")["t"]
    df = spark.sql("SELECT * FROM VALUES (named_struct('a', 1, 'b', 1L)), (named_struct('a', 1, 'b', 2L)) v(s)")
    assert [r[0] for r in df.select(is_valid(df, t, col="s")).collect()] == [False, True]
    df = spark.sql("SELECT named_struct('a', 1, 'b', 1D, 'c', '1') s")
    assert [r[0] for r in df.select(is_valid(df, t, col="s")).collect()] == [True]


@pytest.mark.parametrize("name", ["d", "s", "w"])
def test_predefined_classes_are_of_ascii(spark, name):
    """In a class and outside, in expressions and in the interpreter."""
    members = {"d": "09", "s": " \f\n\t", "w": "azAZ09_"}[name]
    chars = sorted({*"09azAZ_ \f\n\t\v-é٣  ª中"})
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    for pattern, inside in [(f"\\{name}", True), (f"\\{name.upper()}", False), (f"[\\{name}]", True), (f"[^\\{name}]", False), (f"[\\{name.upper()}]", False), (f"[^\\{name.upper()}]", True)]:
        t = SchemaSystem().new_schema(f"$ion_schema_2_0 type::{{name: t, regex: \"^{pattern}$\"}}".replace("\\", "\\\\"), "x")["t"]
        want = [(c in members) == inside for c in chars]
        assert [interpret.is_valid(Element("string", c), t) for c in chars] == want, pattern
        got = dict(df.select("c", is_valid(df, t, col="c")).collect())
        assert [got[c] for c in chars] == want, pattern


def test_texts_of_a_batch_are_checked_once(spark):
    """Rows that repeat a text cost no more, and each row gets its own text's verdict."""
    seen = []
    texts, found, at = api._once(pa.array(["5", None, "a", "5", None, "5"]), lambda x: seen.append(x) or str(x))
    assert seen == texts == ["5", None, "a"]
    assert [found[k] for k in at.to_pylist()] == ["5", "None", "a", "5", "None", "5"]

    values = ["[true, 1]", "[true, a]", None, "[", "[1, [2]]", "'''x'''", ""]
    rows = [(k, values[k * k % 11 % 7]) for k in range(500)]
    df = spark.createDataFrame(rows, "id long, ion string").coalesce(1)
    t = SchemaSystem().new_schema("$ion_schema_2_0 type::{name: t, ordered_elements: [bool, {type: int, occurs: range::[1, 2]}]}", "x")["t"]

    def of(text):
        try:
            v = interpret.validate(interpret.read_value(text), t) if text is not None else interpret.Violation("ion", "ion_error", "no text", "( )")
        except IonError as e:
            v = interpret.Violation("ion", "ion_error", str(e), "( )")
        return sorted(x.row() for x in v.leaves()) if v else [], v.tree() if v else None

    want = [(k, x, not of(x)[0], of(x)[0]) for k, x in rows]
    out = api.validate_ion(df, "ion", t, mode="violations").orderBy("id").collect()
    assert [(r.id, r.ion, r.is_valid, [tuple(v) for v in r.violations]) for r in out] == want
    assert [r.id for r in api.validate_ion(df, "ion", t, mode="filter").orderBy("id").collect()] == [k for k, _, ok, _ in want if ok]
    assert [r.id for r in api.validate_ion(df, "ion", t, mode="reject").orderBy("id").collect()] == [k for k, _, ok, _ in want if not ok]
    report = api.validate_ion(df, "ion", t, mode="report").collect()
    assert [tuple(r) for r in report] == [("Valid" if ok else "Invalid", x, "", of(x)[1]) for _, x, ok, _ in want]

"""Queries for what schemas are made of: static rules, builders, authorities, dialects, trees, files."""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.__main__ import main
from assayer.functions import ranges
from assayer.functions.ion import IonError, read_one
from assayer.operators.api import Options, is_valid, validate, validate_ion
from assayer.plans import model
from assayer.plans.builders import v1, v2
from assayer.plans.conformance import run_file
from assayer.plans.system import FileAuthority, MapAuthority, SchemaSystem, UnresolvableSchemaError
from assayer.queries import query, schema, table
from assayer.sources import TableAuthority, read_ion, schema_issues, write_ion
from assayer.streaming import windowed_validity


def values(columns: str, rows: list[tuple]) -> str:
    """A table of literals in SQL."""
    show = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({columns})"


_1, _2 = "$ion_schema_1_0 ", "$ion_schema_2_0 "


def _t(body: str) -> str:
    return f"type::{{name: t, {body}}}"


#: rule: (a document that keeps it, one that breaks it)
STATIC = {
    "version_marker": (_2 + _t("type: int"), "$ion_schema_3_1 " + _t("type: int")),
    "footer_with_header_1": (_1 + "schema_header::{} " + _t("type: int") + " schema_footer::{}", _1 + "schema_header::{} " + _t("type: int")),
    "footer_with_header_2": (_2 + "schema_header::{} schema_footer::{}", _2 + _t("type: int") + " schema_footer::{}"),
    "header_first": (_2 + "schema_header::{} " + _t("type: int") + " schema_footer::{}", _2 + _t("type: int") + " schema_header::{} schema_footer::{}"),
    "one_header": (_2 + "schema_header::{} schema_footer::{}", _2 + "schema_header::{} schema_header::{} schema_footer::{}"),
    "header_annotations": (_2 + "schema_header::{} schema_footer::{}", _2 + "extra::schema_header::{} schema_footer::{}"),
    "reserved_fields": (_2 + "schema_header::{user_reserved_fields: {schema_header: [], schema_footer: [], type: [owner]}} type::{name: t, owner: me} schema_footer::{}", _2 + "schema_header::{user_reserved_fields: {type: [element]}} schema_footer::{}"),
    "undeclared_fields": (_2 + _t("type: int"), _2 + _t("owner: me")),
    "open_content_words": (_2 + "_note::{a: 1} " + _t("type: int"), _2 + "schema_note::{a: 1} " + _t("type: int")),
    "named_types": (_1 + _t("type: int"), _1 + "type::{type: int}"),
    "one_name": (_1 + _t("type: int"), _1 + "type::{name: t, name: u, type: int}"),
    "top_level_occurs": (_1 + _t("type: int"), _1 + _t("occurs: 2")),
    "duplicate_types": (_2 + _t("type: int") + "type::{name: u}", _2 + _t("type: int") + _t("type: bool")),
    "type_reference": (_2 + _t("type: int"), _2 + _t("type: 5")),
    "null_reference": (_1 + _t("type: int"), _1 + _t("type: null.symbol")),
    "nullable_version": (_1 + _t("type: nullable::int"), _2 + _t("type: nullable::int")),
    "null_or_version": (_2 + _t("type: $null_or::int"), _1 + _t("type: $null_or::int")),
    "occurs_place": (_2 + _t("fields: {a: {type: int, occurs: 2}}"), _2 + _t("element: {type: int, occurs: 2}")),
    "occurs_bounds": (_1 + _t("fields: {a: {type: int, occurs: range::[0, 3]}}"), _1 + _t("fields: {a: {type: int, occurs: 0}}")),
    "lists": (_1 + _t("all_of: [int]"), _1 + _t("all_of: int")),
    "null_lists": (_1 + _t("contains: [1]"), _1 + _t("contains: null.list")),
    "fields_struct": (_1 + _t("fields: {a: int}"), _1 + _t("fields: {}")),
    "fields_names": (_2 + _t("fields: {a: int, b: int}"), _2 + _t("fields: {a: int, a: int}")),
    "fields_annotation": (_2 + _t("fields: closed::{a: int}"), _2 + _t("fields: shut::{a: int}")),
    "element_annotation": (_2 + _t("element: distinct::int"), _2 + _t("element: unique::int")),
    "field_names_annotation": (_2 + _t("field_names: distinct::symbol"), _2 + _t("field_names: unique::symbol")),
    "content": (_1 + _t("content: closed"), _1 + _t("content: open")),
    "annotations_list": (_1 + _t("annotations: [a]"), _1 + _t("annotations: a")),
    "annotations_modifier": (_2 + _t("annotations: closed::[a]"), _2 + _t("annotations: [a]")),
    "annotations_type": (_2 + _t("annotations: {container_length: 1}"), _1 + _t("annotations: {container_length: 1}")),
    "regex_text": (_1 + _t('regex: "x"'), _1 + _t('regex: ""')),
    "regex_flag": (_1 + _t('regex: i::m::"x"'), _1 + _t('regex: s::"x"')),
    "regex_lookahead": (_1 + _t('regex: "a(b)c"'), _1 + _t('regex: "a(?!b)c"')),
    "regex_lazy": (_1 + _t('regex: "a*b"'), _1 + _t('regex: "a*?b"')),
    "offsets": (_1 + _t('timestamp_offset: ["-08:00"]'), _1 + _t("timestamp_offset: []")),
    "offset_format": (_1 + _t('timestamp_offset: ["-00:00"]'), _1 + _t('timestamp_offset: ["8:00"]')),
    "valid_values_form": (_1 + _t("valid_values: [1, range::[5, 9]]"), _1 + _t("valid_values: 5")),
    "valid_values_annotations": (_1 + _t("valid_values: [a]"), _1 + _t("valid_values: [x::a]")),
    "ieee754_forms": (_2 + _t("ieee754_float: binary64"), _2 + _t("ieee754_float: binary80")),
    "range_order": (_1 + _t("codepoint_length: range::[2, 3]"), _1 + _t("codepoint_length: range::[3, 2]")),
    "range_open_both": (_1 + _t("container_length: range::[min, 4]"), _1 + _t("container_length: range::[min, max]")),
    "precision_bound": (_1 + _t("precision: 1"), _1 + _t("precision: 0")),
    "import_id": (_1 + "schema_header::{imports: []} schema_footer::{}", _1 + "schema_header::{imports: [{type: x}]} schema_footer::{}"),
    "import_found": (_1 + "schema_header::{} schema_footer::{}", _1 + 'schema_header::{imports: [{id: "nowhere.isl"}]} schema_footer::{}'),
    "type_found": (_2 + _t("type: u") + "type::{name: u}", _2 + _t("type: u")),
}


@query(values('"rule", follows, breaks', [(r, True, False) for r in STATIC]))
def static_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each static rule: whether a document that follows it and one that breaks it load."""
    rows = [(f"{r}/{k}", text) for r, pair in STATIC.items() for k, text in zip(("follows", "breaks"), pair, strict=True)]
    found = schema_issues(spark.createDataFrame(rows, "id string, text string"))
    split = found.select(F.substring_index("id", "/", 1).alias("rule"), F.substring_index("id", "/", -1).alias("what"), "ok")
    return split.groupBy("rule").agg(F.bool_and(F.when(F.col("what") == "follows", F.col("ok"))).alias("follows"), F.bool_and(F.when(F.col("what") == "breaks", F.col("ok"))).alias("breaks"))


_LINE = "l_orderkey, l_linenumber"


def _lines(spark: SparkSession, sf_dir: str, s, name: str = "t") -> DataFrame:
    return validate(table(spark, sf_dir, "lineitem"), name, s).select("l_orderkey", "l_linenumber", "is_valid")


@query(f"SELECT {_LINE}, l_returnflag IN ('A', 'N') AND l_quantity BETWEEN 5 AND 30 AND NOT (l_linestatus = 'O') AS is_valid FROM lineitem")
def builders_1(spark, sf_dir):
    """A schema of version 1.0 made by its builders."""
    required = lambda *c: v1.occurring(v1.anonymous_type_ref(c), 1)
    status = v1.not_(v1.anonymous_type_ref([v1.valid_values(["O"])]))
    fields = v1.fields({"l_returnflag": required(v1.valid_values(["A", "N"])), "l_quantity": required(v1.type("float"), v1.valid_values([v1.number_range("range::[5, 30]")])), "l_linestatus": required(status)})
    s = SchemaSystem().schema_from_isl_types("built", [v1.named_type("t", [fields])], 1)
    return _lines(spark, sf_dir, s)


@query(f"SELECT {_LINE}, (l_linenumber <= 3) <> (l_tax >= 0.04::DOUBLE) AND l_returnflag IN ('R', 'N') AS is_valid FROM lineitem")
def builders_2(spark, sf_dir):
    """One of version 2.0, with references to named types."""
    early = v2.named_type("early", [v2.fields({"l_linenumber": v2.occurring(v2.anonymous_type_ref([v2.type("int"), v2.valid_values([v2.number_range("range::[min, 3]")])]), 1)})])
    taxed = v2.named_type("taxed", [v2.fields({"l_tax": v2.occurring(v2.anonymous_type_ref([v2.valid_values([v2.number_range("range::[0.04, max]")])]), 1)})])
    flagged = v2.anonymous_type_ref([v2.fields({"l_returnflag": v2.occurring(v2.anonymous_type_ref([v2.any_of([v2.anonymous_type_ref([v2.valid_values([x])]) for x in ("R", "N")])]), 1)})])
    t = v2.named_type("t", [v2.all_of([v2.anonymous_type_ref([v2.one_of(["early", "taxed"])]), flagged])])
    s = SchemaSystem().load_schema_from_isl_schema(v2.schema("built", [early, taxed, t]), 2)
    return _lines(spark, sf_dir, s)


_WRITTEN = "fields: {l_discount: {type: float, valid_values: range::[exclusive::0.01, 0.07], occurs: required}, l_returnflag: {codepoint_length: 1, regex: i::\"[ar]\", occurs: required}}, container_length: range::[2, 99]"


@query(f"SELECT {_LINE}, l_discount > 0.01::DOUBLE AND l_discount <= 0.07::DOUBLE AND l_returnflag IN ('A', 'R') AS is_valid FROM lineitem")
def written_schema(spark, sf_dir):
    """A schema that was written as text and read again."""
    text = model.to_isl(schema(_WRITTEN).isl)
    return _lines(spark, sf_dir, SchemaSystem().new_schema(text, "again"))


def _equal_types() -> list[tuple[str, bool]]:
    read = lambda text, b=v2: b.load_isl_type("{" + text + "}")
    one = read("codepoint_length: 5, regex: \"a\"")
    return [
        ("other_order", one == read("regex: \"a\", codepoint_length: 5")),
        ("other_value", one == read("regex: \"b\", codepoint_length: 5")),
        ("fewer", one == read("codepoint_length: 5")),
        ("built", one == v2.anonymous_type([v2.codepoint_length(5), v2.regex("a")])),
        ("other_version", one == read("codepoint_length: 5, regex: \"a\"", v1)),
        ("written", one == v2.load_isl_type(model.to_isl(one))),
    ]


@query(values('"case", equal', [("other_order", True), ("other_value", False), ("fewer", False), ("built", True), ("other_version", False), ("written", True)]))
def type_equality(spark, sf_dir):
    """The order of constraints doesn't matter to equality."""
    return spark.createDataFrame(_equal_types(), "case string, equal boolean")


@query(values("what, result", [("built_in", "int"), ("constraints", "valid_values"), ("header", "shared.isl"), ("id", "s.isl"), ("imported", "flag"), ("missing", None), ("open_content", "1"), ("own", "t"), ("types", "t"), ("version", "2")]))
def schema_accessors(spark, sf_dir):
    """What a schema and its model tell of themselves."""
    docs = {"shared.isl": _2 + "type::{name: flag, valid_values: [A]}", "s.isl": _2 + 'schema_header::{imports: [{id: "shared.isl"}]} _note::{a: 1} type::{name: t, valid_values: [1]} schema_footer::{}'}
    s = SchemaSystem([MapAuthority(docs)]).load_schema("s.isl")
    missing = s.get_type("nowhere")
    rows = [
        ("id", s.id),
        ("version", str(s.version)),
        ("own", s.get_type("t").name),
        ("types", ",".join(t.name for t in s.get_types())),
        ("imported", s.get_imported_type("flag").name),
        ("built_in", s.get_built_in_or_defined_type("int").name),
        ("missing", missing and missing.name),
        ("header", ",".join(i.schema for i in s.isl.imports)),
        ("constraints", ",".join(c.name for c in s.isl.types[0].constraints)),
        ("open_content", str(len(s.isl.open_content))),
    ]
    return spark.createDataFrame(rows, "what string, result string")


_FILES = {"base.isl": _2 + "type::{name: small, valid_values: range::[min, 10]}", "line.isl": _2 + 'type::{name: t, fields: {l_quantity: {type: {id: "base.isl", type: small}, occurs: required}}}'}


@query(f"SELECT {_LINE}, l_quantity <= 10 AS is_valid FROM lineitem")
def file_authority(spark, sf_dir):
    """Schemas of a folder, one of which imports the other inline; the folder is read on the driver alone."""
    with tempfile.TemporaryDirectory() as folder:
        for name, text in _FILES.items():
            with open(os.path.join(folder, name), "w") as f:
                f.write(text)
        s = SchemaSystem([FileAuthority(folder)]).load_schema("line.isl")
    return _lines(spark, sf_dir, s)


@query(f"SELECT {_LINE}, l_quantity <= 10 AS is_valid FROM lineitem")
def inline_import(spark, sf_dir):
    return _lines(spark, sf_dir, SchemaSystem([MapAuthority(_FILES)]).load_schema("line.isl"))


def _asked(spark: SparkSession) -> list[tuple[str, str]]:
    first, second = MapAuthority({"a": _2 + "type::{name: one}"}), MapAuthority({"a": _2 + "type::{name: two}", "b": _2 + "type::{name: three}"})
    broken = MapAuthority({"b": "type::{name: "})
    stored = TableAuthority(spark.createDataFrame([("c", _2 + "type::{name: four}")], "id string, text string"))

    def outcome(authorities: list, schema_id: str) -> str:
        try:
            return ",".join(t.name for t in SchemaSystem(authorities).load_schema(schema_id).get_types())
        except UnresolvableSchemaError:
            return "unresolvable"
        except IonError:
            return "no ion"

    system = SchemaSystem([first])
    kept = system.load_schema("a") is system.load_schema("a")
    system.add_authority(second)
    return [
        ("first_answers", outcome([first, second], "a")),
        ("second_answers", outcome([first, second], "b")),
        ("none_answers", outcome([first, second], "c")),
        ("broken_answers", outcome([broken, second], "b")),
        ("no_authority", outcome([], "a")),
        ("table", outcome([first, stored], "c")),
        ("no_folder", outcome([FileAuthority("/nowhere/at/all"), first], "a")),
        ("kept", str(kept)),
        ("added", ",".join(t.name for t in system.load_schema("b").get_types())),
        ("replaced", ",".join(t.name for t in system.with_authorities(second).load_schema("a").get_types())),
    ]


@query(values("what, result", [("first_answers", "one"), ("second_answers", "three"), ("none_answers", "unresolvable"), ("broken_answers", "no ion"), ("no_authority", "unresolvable"), ("table", "four"), ("no_folder", "one"), ("kept", "True"), ("added", "three"), ("replaced", "two")]))
def authorities(spark, sf_dir):
    """The first authority that has an id answers, also with an error."""
    return spark.createDataFrame(_asked(spark), "what string, result string")


@query("SELECT conv_id, NOT bool_or(role = 'system') AS is_valid FROM conversations GROUP BY conv_id")
def field_names_map(spark, sf_dir):
    """Names of a MAP's fields are told by its rows."""
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    df = counts.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m"))
    return df.select("conv_id", is_valid(df, "t", schema("field_names: {valid_values: [user, assistant]}"), "m").alias("is_valid"))


@query("SELECT l_orderkey, count(*) = count(DISTINCT l_returnflag) AS is_valid, bool_and(l_returnflag IN ('A', 'N')) AS named FROM lineitem GROUP BY l_orderkey")
def field_names_distinct(spark, sf_dir):
    """A struct whose names may repeat, as an array of (k, v)."""
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("v"))).alias("e"))
    v = lambda body: is_valid(df, "t", schema(body), "e", Options(entries=frozenset(["e"])))
    return df.select("l_orderkey", v("field_names: distinct::symbol").alias("is_valid"), v("field_names: {valid_values: [A, N]}").alias("named"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 2 = 0 AS is_valid, false AS of_int FROM lineitem")
def ieee754_b64(spark, sf_dir):
    """Every double is a binary64; a null and an int are none."""
    df = table(spark, sf_dir, "lineitem").withColumn("x", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount")))
    v = lambda col: is_valid(df, "t", schema("ieee754_float: binary64"), col)
    return df.select("l_orderkey", "l_linenumber", v("x").alias("is_valid"), v("l_linenumber").alias("of_int"))


@query("SELECT p_partkey, p_size BETWEEN 10 AND 20 AS open_1, p_size BETWEEN 10 AND 20 AS reserved_2 FROM part")
def open_content(spark, sf_dir):
    """Fields of a type that are no constraints say nothing about values."""
    df = table(spark, sf_dir, "part")
    old = SchemaSystem().new_schema(_1 + _t("valid_values: range::[10, 20], owner: {team: x}, since: 2020T"), "old")
    new = SchemaSystem().new_schema(_2 + "schema_header::{user_reserved_fields: {schema_header: [], schema_footer: [], type: [owner]}} " + _t("valid_values: range::[10, 20], owner: me") + " schema_footer::{}", "new")
    return df.select("p_partkey", is_valid(df, "t", old, "p_size").alias("open_1"), is_valid(df, "t", new, "p_size").alias("reserved_2"))


@query(r"SELECT doc_id, regexp_matches(text, '[A-Za-z0-9_][ \f\n\r\t][A-Za-z0-9_]+[^A-Za-z0-9_]') AS words, regexp_matches(text, '[0-9][^0-9]') AS digits, regexp_matches(text, '[ \f\n\r\t]the[ \f\n\r\t]') AS spaces, regexp_matches(text, '^[^\n]{40,}$') AS one_line, regexp_matches(text, '(?m)^[A-Z][^\n]{20,}$') AS lines, regexp_matches(text, '(?i)data|MODEL') AS folded, regexp_matches(text, '[a-f0-9]{3}') AS classes, regexp_matches(text, 'q[^u]') AS negated, regexp_matches(text, '[.!?]$') AS ended FROM documents")
def regex_dialect(spark, sf_dir):
    r"""\w, \s, \d, classes, ., $ and both flags."""
    df = table(spark, sf_dir, "documents")
    v = lambda e, version=2: is_valid(df, "t", schema(f"regex: {e}", version), "text")
    return df.select(
        "doc_id",
        v(r'"\\w\\s\\w+\\W"', 1).alias("words"),
        v(r'"\\d\\D"', 1).alias("digits"),
        v(r'"\\sthe\\s"', 1).alias("spaces"),
        v('"^.{40,}$"').alias("one_line"),
        v('m::"^[A-Z].{20,}$"').alias("lines"),
        v('i::"data|MODEL"').alias("folded"),
        v('"[a-f0-9]{3}"').alias("classes"),
        v('"q[^u]"').alias("negated"),
        v('"[.!?]$"').alias("ended"),
    )


_SEQUENCE = "ordered_elements: [bool, {type: int, occurs: range::[1, 2]}, {type: string, occurs: optional}]"
_READ = ["[true, 1]", "[true, 1, 2, 3]", "[true]", "[true, a]", "[1, true]", '[false, 7, "x", "y"]']


def _numbered(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    at = (F.col("event_id") % len(texts) + 1).cast("int")
    return table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*map(F.lit, texts)), at).alias("ion"))


@query("SELECT event_id, event_id % 6 = 0 AS is_valid, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '( 3 )' WHEN 2 THEN '( 1 )' WHEN 3 THEN '( 1 )' WHEN 4 THEN '( 0 )' ELSE '( 3 )' END AS first_path, CASE event_id % 6 WHEN 0 THEN false ELSE event_id % 6 = 1 END AS reached FROM events")
def ordered_reasons(spark, sf_dir):
    """Where a sequence stops to fit, and whether the number of some element was the reason."""
    out = validate_ion(_numbered(spark, sf_dir, _READ), "ion", "t", schema(_SEQUENCE), mode="violations")
    return out.select(
        "event_id", "is_valid", F.coalesce(F.get("violations", F.lit(0))["path"], F.lit("")).alias("first_path"), F.exists("violations", lambda x: x["message"].contains("max occurs already reached")).alias("reached")
    )


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '- value didn''t satisfy type constraint(s)' ELSE '- value didn''t satisfy type constraint(s)' END AS head, CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 6 END AS \"lines\", CASE event_id % 3 WHEN 0 THEN 0 ELSE 3 END AS depth FROM events")
def violation_trees(spark, sf_dir):
    """The indented tree of each value's violations."""
    s = schema("fields: {a: {type: int, occurs: required}, b: {codepoint_length: 2}}")
    ids = _numbered(spark, sf_dir, ['{a: 1, b: "xy"}', "{a: x}", '{a: x, b: "xyz"}'])
    found = validate_ion(ids.select("event_id", "ion"), "ion", "t", s, mode="violations")
    texts = validate_ion(ids.select("ion").distinct(), "ion", "t", s, mode="report").select(F.col("value").alias("v"), "violation")
    lines = F.split("violation", "\n")
    depth = F.array_max(F.transform(lines, lambda x: F.length(x) - F.length(F.ltrim(x)))) / 2
    return found.join(F.broadcast(texts), F.col("ion") == F.col("v")).select("event_id", F.get(lines, F.lit(0)).alias("head"), F.coalesce(F.size(F.filter(lines, lambda x: x != "")), F.lit(0)).alias("lines"), F.coalesce(depth, F.lit(0)).cast("int").alias("depth"))


#: kind, range, and what it is: a way to write it, or why it is none
RANGES = [
    ("number", "range::[1, 5]", True),
    ("number", "range::[exclusive::1, exclusive::1]", False),
    ("number", "range::[exclusive::1, exclusive::2]", True),
    ("number", "range::[min, max]", False),
    ("number", "range::[2.50, 2.5]", True),
    ("number", "range::[max, min]", False),
    ("number", "range::[a, 5]", False),
    ("count", "range::[exclusive::1, exclusive::2]", False),
    ("count", "range::[exclusive::1, exclusive::3]", True),
    ("count", "range::[-1, 5]", False),
    ("count", "range::[0, max]", True),
    ("count", "7", True),
    ("timestamp", "range::[2001-01-01T00:00:00Z, 2001-01-01T01:00:00+01:00]", True),
    ("timestamp", "range::[2001-01-01T00:00:00Z, 2000-01-01T00:00:00Z]", False),
    ("precision", "range::[year, second]", True),
    ("precision", "range::[second, day]", False),
    ("precision", "range::[exclusive::year, exclusive::month]", False),
]


@query(values("kind, range, ok", RANGES))
def range_rules(spark, sf_dir):
    """Which ranges are legal and hold a value."""

    def ok(kind: str, text: str) -> bool:
        try:
            ranges.parse(kind, read_one(text))
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(k, t, ok(k, t)) for k, t, _ in RANGES], "kind string, range string, ok boolean")


@query("SELECT event_id, json_extract(props, '$.k')::INT BETWEEN 20 AND 70 AS is_valid FROM events")
def ion_files(spark, sf_dir):
    """Values written as a file of Ion, read back and validated."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.gettempdir()
    path = f"{top.rstrip('/')}/assayer-ion-{uuid.uuid4().hex}"
    df = table(spark, sf_dir, "events").select(F.format_string("{event_id: %d, props: %s}", "event_id", "props").alias("value"))
    write_ion(df, path)
    read = read_ion(spark, path, lines=True).where("error IS NULL")
    s = schema("fields: closed::{event_id: {type: int, occurs: required}, props: {fields: {k: {valid_values: range::[20, 70], occurs: required}}, occurs: required}}")
    return validate_ion(read, "value", "t", s).select(F.regexp_extract("value", r"event_id: ?(\d+)", 1).cast("bigint").alias("event_id"), "is_valid")


@query("SELECT date_trunc('hour', ts) AS began, count(*) FILTER (value > 20) AS n_valid, count(*) FILTER (value <= 20) AS n_invalid FROM events GROUP BY 1")
def windowed(spark, sf_dir):
    """Valid and invalid events by hour; the same plan runs on a stream."""
    s = schema("fields: {value: {valid_values: range::[exclusive::20, max], occurs: required}}")
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = windowed_validity(events, "t", s, "ts", "1 hour", "1 hour")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("began"), "n_valid", "n_invalid")


_CASES = _2 + """
type::{name: even, type: int, valid_values: [0, 2, 4]}
$test::{type: even, should_accept_as_valid: [0, 4], should_reject_as_invalid: [1, x, null.int]}
$test::{description: "bad types", invalid_types: [{regex: 5}, {codepoint_length: -1}]}
$test::{description: "schemas", valid_schemas: [($ion_schema_2_0 type::{name: a, element: even_} type::{name: even_})], invalid_schemas: [($ion_schema_2_0 type::{name: a, element: even_})]}
"""


@query(values('"case", passed', [("loads", True), ("even should_accept_as_valid[0]", True), ("even should_accept_as_valid[1]", True), *[(f"even should_reject_as_invalid[{k}]", True) for k in range(3)], *[(f"bad types invalid_types[{k}]", True) for k in range(2)], ("schemas valid_schemas[0]", True), ("schemas invalid_schemas[0]", True)]))
def conformance_cases(spark, sf_dir):
    """A conformance file's cases and whether they pass."""
    found = run_file(SchemaSystem([MapAuthority({"cases.isl": _CASES})]), "cases.isl")
    return spark.createDataFrame([(o.case, o.passed) for o in found], "case string, passed boolean")


@query(values("command, code, valid, invalid", [("load", 0, 0, 0), ("load_missing", 2, 0, 0), ("validate", 1, 2, 1), ("validate_good", 0, 1, 0), ("validate_no_type", 2, 0, 0)]))
def command_line(spark, sf_dir):
    """What the command line ends with and how many values it calls valid."""
    rows = []
    with tempfile.TemporaryDirectory() as folder:
        for name, text in {"s.isl": _2 + _t("valid_values: range::[1, 9]"), "some.ion": "1 5 12", "good.ion": "9"}.items():
            with open(os.path.join(folder, name), "w") as f:
                f.write(text)
        validate_ = lambda name, kind="t": ["validate", "-d", folder, "-s", "s.isl", "-t", kind, "-i", os.path.join(folder, name)]
        calls = {"load": ["load", "-d", folder, "-s", "s.isl"], "load_missing": ["load", "-d", folder, "-s", "no.isl"], "validate": validate_("some.ion"), "validate_good": validate_("good.ion"), "validate_no_type": validate_("good.ion", "u")}
        for command, args in calls.items():
            out = io.StringIO()
            with contextlib.redirect_stdout(out), contextlib.redirect_stderr(io.StringIO()):
                code = main(args)
            rows.append((command, code, out.getvalue().count(": Valid"), out.getvalue().count(": Invalid")))
    return spark.createDataFrame(rows, "command string, code int, valid int, invalid int")

"""A query for each operator, over the test tables, with the SQL that means the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators.api import Options, explain_violations, is_valid, sandbox_validate, validate, validate_document, validate_ion, violations
from assayer.plans.system import MapAuthority, Schema, SchemaSystem
from assayer.sources import catalogue, schema_issues

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def schema(body: str, version: int = 2) -> Schema:
    """A schema of one type t, or of whole documents that begin with type::."""
    text = body if "type::" in body else f"type::{{name: t, {body}}}"
    return SchemaSystem().new_schema(f"$ion_schema_{version}_0\n{text}", "query")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _flag(name: str, tbl: str, keys: str, body: str, sql: str, col: str | None = None, version: int = 2, options: Options | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A query that flags each row of a table; sql: the same predicate."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, tbl)
        df = prepare(df) if prepare else df
        return df.select(*keys.split(", "), is_valid(df, "t", schema(body, version), col, options).alias("is_valid"))

    run.__name__ = run.__qualname__ = name
    _QUERIES[name] = run
    _SQL[name] = f"SELECT {keys}, {sql} AS is_valid FROM {tbl}"


_LINE = "l_orderkey, l_linenumber"

_flag("type_int", "lineitem", _LINE, "fields: {l_linenumber: {type: int, occurs: required}, l_quantity: {type: float, occurs: required}, l_returnflag: {one_of: [symbol, int], occurs: required}}", "false", version=1)
_flag("type_row", "lineitem", _LINE, "fields: {l_linenumber: {type: int, occurs: required}, l_quantity: {type: float, occurs: required}, l_returnflag: {type: string, valid_values: [A], occurs: required}}", "l_returnflag = 'A'", version=1)
_flag("all_of", "lineitem", _LINE, "all_of: [{fields: {l_quantity: {valid_values: range::[1, 50], occurs: required}}}, {fields: {l_discount: {valid_values: range::[0, exclusive::0.05], occurs: required}}}]", "l_quantity BETWEEN 1 AND 50 AND l_discount >= 0 AND l_discount < 0.05::DOUBLE")
_flag("any_of", "part", "p_partkey", "any_of: [{fields: {p_size: {valid_values: range::[min, 10], occurs: required}}}, {fields: {p_brand: {valid_values: ['Brand#1', 'Brand#2'], occurs: required}}}]", "p_size <= 10 OR p_brand IN ('Brand#1', 'Brand#2')")
_flag("one_of", "customer", "c_custkey", "one_of: [{fields: {c_acctbal: {valid_values: range::[min, exclusive::0], occurs: required}}}, {fields: {c_mktsegment: {valid_values: [BUILDING], occurs: required}}}]", "(c_acctbal < 0)::INT + (c_mktsegment = 'BUILDING')::INT = 1")
_flag("not_type", "orders", "o_orderkey", "fields: {o_orderstatus: {not: {valid_values: [F]}, occurs: required}}", "NOT coalesce(o_orderstatus IN ('F'), false)")
_flag("valid_values_list", "lineitem", _LINE, "valid_values: [A, R]", "l_returnflag IN ('A', 'R')", "l_returnflag")
_flag("valid_values_number_range", "lineitem", _LINE, "valid_values: range::[exclusive::0.02, 0.06]", "l_discount > 0.02::DOUBLE AND l_discount <= 0.06::DOUBLE", "l_discount")
_flag("valid_values_ts_range", "orders", "o_orderkey", "valid_values: range::[1995-01-01T00:00:00-00:00, 1996-12-31T00:00:00-00:00]", "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'", "o_orderdate")
_flag("regex", "customer", "c_custkey", 'regex: "^Customer#[0-9]*[02468]$"', "regexp_matches(c_name, '^Customer#[0-9]*[02468]$')", "c_name")
_flag("regex_flags", "documents", "doc_id", 'regex: i::m::"^the "', "regexp_matches(text, '(?im)^the ')", "text")
_flag("codepoint_length", "documents", "doc_id", "codepoint_length: range::[100, 5000]", "length(text) BETWEEN 100 AND 5000", "text")
_flag("utf8_byte_length", "documents", "doc_id", "utf8_byte_length: range::[100, 5000]", "strlen(text) BETWEEN 100 AND 5000", "text")
_flag("byte_length", "documents", "doc_id", "byte_length: range::[100, 5000]", "octet_length(encode(text)) BETWEEN 100 AND 5000", "bytes", prepare=lambda d: d.withColumn("bytes", F.encode("text", "utf-8")))
_flag("element", "embeddings", "vec_id", "element: {valid_values: range::[-0.3, 0.3]}", "list_bool_and(list_transform(embedding, lambda x: x BETWEEN -0.3 AND 0.3))", "embedding")
_flag("fields_required", "part", "p_partkey", "fields: {p_size: {valid_values: range::[5, 40], occurs: required}, p_type: {valid_values: [ECONOMY, STANDARD], occurs: required}, p_name: {codepoint_length: range::[9, max], occurs: required}}", "p_size BETWEEN 5 AND 40 AND p_type IN ('ECONOMY', 'STANDARD') AND length(p_name) >= 9")
_flag("fields_missing", "part", "p_partkey", "fields: {p_colour: {occurs: required}}", "false")
_flag("fields_closed_row", "part", "p_partkey", "fields: closed::{p_partkey: int, p_name: string, p_brand: string, p_type: string, p_size: int}", "p_retailprice IS NULL")
_flag("ieee754_b32", "lineitem", _LINE, "ieee754_float: binary32", "l_discount::FLOAT::DOUBLE = l_discount", "l_discount")
_flag("ieee754_b16", "lineitem", _LINE, "ieee754_float: binary16", "l_discount = 0 OR (l_discount / pow(2, greatest(floor(log2(l_discount)), -14) - 10)) = floor(l_discount / pow(2, greatest(floor(log2(l_discount)), -14) - 10))", "l_discount")
_flag("precision", "lineitem", _LINE, "precision: range::[6, 7]", "length(ltrim(replace(l_extendedprice::DECIMAL(18,2)::VARCHAR, '.', ''), '0')) BETWEEN 6 AND 7", "d", prepare=lambda d: d.withColumn("d", F.col("l_extendedprice").cast("decimal(18,2)")))
_flag("scale_minimal", "lineitem", _LINE, "scale: range::[0, 1]", "length(rtrim(split_part(l_discount::DECIMAL(4,2)::VARCHAR, '.', 2), '0')) <= 1", "d", version=1, options=Options(decimal_scale="minimal"), prepare=lambda d: d.withColumn("d", F.col("l_discount").cast("decimal(4,2)")))
_flag("exponent_minimal", "lineitem", _LINE, "exponent: -1", "length(rtrim(split_part(l_discount::DECIMAL(4,2)::VARCHAR, '.', 2), '0')) = 1", "d", options=Options(decimal_scale="minimal"), prepare=lambda d: d.withColumn("d", F.col("l_discount").cast("decimal(4,2)")))
_flag("timestamp_precision", "events", "event_id", "timestamp_precision: range::[second, millisecond]", "microsecond(ts) % 1000 = 0", "ts")
_flag("timestamp_offset", "events", "event_id", 'timestamp_offset: ["+01:00", "-00:00"]', "event_id % 3 <> 1", "t", options=Options(timestamps=frozenset(["t"])), prepare=lambda d: d.withColumn("t", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(F.lit("+01:00"), F.lit("Z"), F.lit("-00:00")), (F.col("event_id") % 3 + 1).cast("int")))))


def _annotated(name: str, body: str, version: int, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "documents")
        options = Options(annotations=F.array("lang", "source"))
        return df.select("doc_id", is_valid(df, "t", schema(body, version), "text", options).alias("is_valid"))

    run.__name__ = run.__qualname__ = name
    _QUERIES[name] = run
    _SQL[name] = f"SELECT doc_id, {sql} AS is_valid FROM documents"


_annotated("annotations_unordered", "annotations: closed::[required::en, src0, src1]", 1, "lang = 'en' AND source IN ('src0', 'src1')")
_annotated("annotations_ordered", "annotations: ordered::[de, required::src1, fr]", 1, "source = 'src1'")
_annotated("annotations_ordered_closed", "annotations: closed::ordered::[de, required::src1]", 1, "lang = 'de' AND source = 'src1'")
_annotated("annotations_standard", 'annotations: {element: {regex: "^(en|fr|src[0-9])$"}, container_length: 2}', 2, "regexp_matches(lang, '^(en|fr|src[0-9])$') AND regexp_matches(source, '^(en|fr|src[0-9])$')")
_annotated("annotations_simple_2", "annotations: closed::[en, src3]", 2, "lang = 'en' AND source = 'src3'")


def _with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")


_LABELLED = "documents LEFT JOIN labels USING (doc_id)"


@query(f"SELECT doc_id, quality IS NULL OR quality = 1 AS is_valid FROM {_LABELLED}")
def type_nullable(spark, sf_dir):
    df = _with_labels(spark, sf_dir)
    return df.select("doc_id", is_valid(df, "t", schema("any_of: [{type: $int, valid_values: [1]}, {type: $int, valid_values: [null.int]}]", 2), "quality").alias("is_valid"))


@query(f"SELECT doc_id, quality IS NOT NULL AS is_valid FROM {_LABELLED}")
def type_null_rejected(spark, sf_dir):
    df = _with_labels(spark, sf_dir)
    return df.select("doc_id", is_valid(df, "t", schema("valid_values: [0, 1, null.int]", 1), "quality").alias("is_valid"))


@query(f"SELECT doc_id, quality IS NULL AS nullable_string, true AS nullable_int, quality IS NULL AS null_or_string, quality IS NOT NULL AS null_or_typed FROM {_LABELLED}")
def nullable_and_null_or(spark, sf_dir):
    """nullable:: and $null_or:: under both policies for NULL."""
    df = _with_labels(spark, sf_dir)
    untyped = Options(null_as="untyped_null")
    v = lambda body, version, o=None: is_valid(df, "t", schema(body, version), "quality", o)
    return df.select(
        "doc_id",
        v("type: nullable::string", 1, untyped).alias("nullable_string"),
        v("type: nullable::int", 1).alias("nullable_int"),
        v("type: $null_or::string", 2, untyped).alias("null_or_string"),
        v("type: $null_or::int", 2).alias("null_or_typed"),
    )


@query("SELECT event_id, json_extract(props, '$.k')::INT BETWEEN 10 AND 59 AS is_valid, true AS closed, false AS closed_other, false AS names FROM events")
def variant_fields(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("v", F.parse_json("props"))
    v = lambda body: is_valid(df, "t", schema(body), "v")
    return df.select("event_id", v("fields: {k: {type: int, valid_values: range::[10, exclusive::60], occurs: required}}").alias("is_valid"), v("fields: closed::{k: int}").alias("closed"), v("fields: closed::{j: int}").alias("closed_other"), v('field_names: distinct::{regex: "^[a-j]$"}').alias("names"))


@query("SELECT event_id, event_id % 4 = 0 AS v_int, event_id % 4 = 1 AS v_list, event_id % 4 = 2 AS v_null, event_id % 4 = 3 AS v_text FROM events")
def variant_types(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    text = F.element_at(F.array(F.get_json_object("props", "$.k"), F.lit('[1, "x", null]'), F.lit("null"), F.lit('"abc"')), (F.col("event_id") % 4 + 1).cast("int"))
    df = df.withColumn("v", F.parse_json(text))
    v = lambda body: is_valid(df, "t", schema(body), "v")
    return df.select("event_id", v("type: int").alias("v_int"), v("type: list, container_length: 3, contains: [1, x]").alias("v_list"), v("type: $null").alias("v_null"), v("type: text, codepoint_length: 3").alias("v_text"))


@query("SELECT l_orderkey, count(*) = count(DISTINCT l_suppkey) AS is_valid, count(*) BETWEEN 1 AND 4 AS few FROM lineitem GROUP BY l_orderkey")
def element_distinct(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("s"))
    return df.select("l_orderkey", is_valid(df, "t", schema("element: distinct::int"), "s").alias("is_valid"), is_valid(df, "t", schema("container_length: range::[1, 4]"), "s").alias("few"))


@query("SELECT l_orderkey, count(*) BETWEEN 1 AND 4 AS is_valid FROM lineitem GROUP BY l_orderkey")
def occurs_range(spark, sf_dir):
    """A group's rows as a document: counts are combined before the shuffle."""
    return validate_document(table(spark, sf_dir, "lineitem"), "t", schema("container_length: range::[1, 4]"), by=["l_orderkey"])


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return turns.select("conv_id", F.transform("r", lambda x: x["role"]).alias("roles"))


@query("SELECT conv_id, bool_or(role = 'system') AS is_valid FROM conversations GROUP BY conv_id")
def contains(spark, sf_dir):
    df = _roles(spark, sf_dir)
    return df.select("conv_id", is_valid(df, "t", schema("contains: [system]"), "roles").alias("is_valid"))


_TURNS = "ordered_elements: [{valid_values: [system], occurs: optional}, {valid_values: [user]}, {valid_values: [assistant]}, {type: any, occurs: range::[0, max]}]"


@query("SELECT conv_id, regexp_full_match(string_agg(role, ' ' ORDER BY turn), '(system )?user assistant( .*)?') AS is_valid, regexp_full_match(string_agg(role, ' ' ORDER BY turn) || ' ', '((user|assistant) ){2,6}(system |user |assistant )?(assistant )*') AS overlapping FROM conversations GROUP BY conv_id")
def ordered_elements(spark, sf_dir):
    df = _roles(spark, sf_dir)
    overlapping = "ordered_elements: [{valid_values: [user, assistant], occurs: range::[2, 6]}, {type: string, occurs: optional}, {valid_values: [assistant], occurs: range::[0, max]}]"
    return df.select("conv_id", is_valid(df, "t", schema(_TURNS), "roles").alias("is_valid"), is_valid(df, "t", schema(overlapping), "roles").alias("overlapping"))


@query("SELECT conv_id, regexp_full_match(string_agg(role, ' ' ORDER BY turn), '(system )?user assistant( .*)?') AS is_valid FROM conversations GROUP BY conv_id")
def document_ordered(spark, sf_dir):
    return validate_document(table(spark, sf_dir, "conversations"), "t", schema(_TURNS), "role", by=["conv_id"], order_by="turn")


@query("SELECT bool_and(c_acctbal BETWEEN -900 AND 9500) AS is_valid FROM customer")
def document_element(spark, sf_dir):
    return validate_document(table(spark, sf_dir, "customer"), "t", schema("type: document, element: {valid_values: range::[-900, 9500]}"), "c_acctbal")


@query("SELECT count(*) BETWEEN 1 AND 1000 AND bool_or(o_orderstatus = 'P') AS is_valid FROM orders")
def document_length(spark, sf_dir):
    return validate_document(table(spark, sf_dir, "orders"), "t", schema("container_length: range::[1, 1000], contains: [P]"), "o_orderstatus")


RULES = """fields: {l_returnflag: {valid_values: [A, R], occurs: required}, l_quantity: {valid_values: range::[1, 50], occurs: required},
  l_discount: {type: float, valid_values: range::[0, exclusive::0.05], occurs: required}, l_linestatus: {one_of: [{valid_values: [F]}, {codepoint_length: 1}], occurs: required}}"""


@query("SELECT l_orderkey, l_linenumber, l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 1 AND 50 AND l_discount >= 0 AND l_discount < 0.05::DOUBLE AND l_linestatus <> 'F' AS is_valid, (l_returnflag NOT IN ('A', 'R'))::INT + (l_quantity NOT BETWEEN 1 AND 50)::INT + (l_discount >= 0.05::DOUBLE)::INT + (l_linestatus = 'F')::INT AS n FROM lineitem")
def violations_rows(spark, sf_dir):
    out = validate(table(spark, sf_dir, "lineitem"), "t", schema(RULES), mode="violations")
    return out.select("l_orderkey", "l_linenumber", "is_valid", F.size("violations").alias("n"))


@query("SELECT 'valid_values' AS \"constraint\", 'invalid_value' AS code, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) + count(*) FILTER (l_discount >= 0.05::DOUBLE) + count(*) FILTER (l_quantity NOT BETWEEN 1 AND 50) AS n FROM lineitem UNION ALL SELECT 'one_of', 'more_than_one_type_matched', count(*) FROM lineitem WHERE l_linestatus = 'F'")
def violation_profile(spark, sf_dir):
    return explain_violations(validate(table(spark, sf_dir, "lineitem"), "t", schema(RULES), mode="violations"))


@query("SELECT l_orderkey, l_linenumber, list_aggregate(list_filter([CASE WHEN l_discount >= 0.05::DOUBLE THEN '( l_discount )' END, CASE WHEN l_linestatus = 'F' THEN '( l_linestatus )' END, CASE WHEN l_quantity NOT BETWEEN 1 AND 50 THEN '( l_quantity )' END, CASE WHEN l_returnflag NOT IN ('A', 'R') THEN '( l_returnflag )' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS paths FROM lineitem")
def violation_paths(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    paths = F.array_join(F.sort_array(F.transform(violations(df, "t", schema(RULES)), lambda x: x["path"])), ",")
    return df.select("l_orderkey", "l_linenumber", F.nullif(paths, F.lit("")).alias("paths"))


@query("SELECT CASE WHEN l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 1 AND 50 AND l_discount >= 0 AND l_discount < 0.05::DOUBLE AND l_linestatus <> 'F' THEN 'Valid' ELSE 'Invalid' END AS result, 'query' AS \"schema\", count(*) AS n FROM lineitem GROUP BY 1")
def validate_report(spark, sf_dir):
    return validate(table(spark, sf_dir, "lineitem"), "t", schema(RULES), mode="report").groupBy("result", "schema").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A')")
def validate_filter(spark, sf_dir):
    """Valid rows only; both predicates reach the Parquet scan."""
    out = validate(table(spark, sf_dir, "lineitem"), "t", schema("fields: {l_quantity: {valid_values: range::[10, 20], occurs: required}, l_returnflag: {valid_values: [A], occurs: required}}"), mode="filter")
    return out.select("l_orderkey", "l_linenumber")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END + CASE WHEN value > 20 THEN 1 ELSE 0 END AS matches, (event_type IN ('click', 'view')) <> (value > 20) AS exactly_one FROM events")
def multi_type_match(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    s = schema("type::{name: a, fields: {event_type: {valid_values: [click, view], occurs: required}}} type::{name: b, fields: {value: {valid_values: range::[exclusive::20, max], occurs: required}}} type::{name: t, one_of: [a, b]}")
    n = lambda t: is_valid(df, t, s).cast("int")
    return df.select("event_id", (n("a") + n("b")).alias("matches"), is_valid(df, "t", s).alias("exactly_one"))


@query("SELECT event_id, json_extract(props, '$.k')::INT < 50 AS is_valid FROM events")
def ion_text(spark, sf_dir):
    """The interpreter over Ion text: JSON is Ion."""
    df = table(spark, sf_dir, "events").select("event_id", "props")
    return validate_ion(df, "props", "t", schema("fields: closed::{k: {type: int, valid_values: range::[0, exclusive::50], occurs: required}}")).select("event_id", "is_valid")


@query("SELECT event_id, event_id % 3 <> 2 AS is_valid FROM events")
def recursive_variant(spark, sf_dir):
    """A recursive type over VARIANT is interpreted on its text."""
    s = schema("type::{name: t, one_of: [int, string, {type: list, element: t}]}")
    nested = F.element_at(F.array(F.lit('[1, ["a", [2]]]'), F.lit("5"), F.lit("[1, [true]]")), (F.col("event_id") % 3 + 1).cast("int"))
    df = table(spark, sf_dir, "events").select("event_id", F.parse_json(nested).alias("v"))
    return validate(df, "t", s, "v").select("event_id", "is_valid")


@query("SELECT conv_id, bool_or(role = 'system') AS is_valid FROM conversations GROUP BY conv_id")
def map_fields(spark, sf_dir):
    """A MAP as a struct: roles and their numbers of turns."""
    counts = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    df = counts.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "n"))).alias("m"))
    return df.select("conv_id", is_valid(df, "t", schema("fields: closed::{system: {type: int, occurs: required}, user: int, assistant: int}"), "m").alias("is_valid"))


@query("SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') BETWEEN 1 AND 2 AS is_valid FROM lineitem GROUP BY l_orderkey")
def repeated_fields(spark, sf_dir):
    """A struct with repeated names as an array of (k, v)."""
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("v"))).alias("e"))
    return df.select("l_orderkey", is_valid(df, "t", schema("fields: {R: {type: float, occurs: range::[1, 2]}}"), "e", Options(entries=frozenset(["e"]))).alias("is_valid"))


_DOCS = {
    "common.isl": "$ion_schema_2_0 schema_header::{} type::{name: flag, valid_values: [A, R]} type::{name: qty, valid_values: range::[1, 25]} schema_footer::{}",
    "line.isl": '$ion_schema_2_0 schema_header::{imports: [{id: "common.isl", type: flag, as: returned}]} type::{name: t, fields: {l_returnflag: {type: returned, occurs: required}, l_quantity: {type: {id: "common.isl", type: qty}, occurs: required}}} schema_footer::{}',
}


@query("SELECT l_orderkey, l_linenumber, l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 1 AND 25 AS is_valid FROM lineitem")
def imports(spark, sf_dir):
    s = SchemaSystem([MapAuthority(_DOCS)]).load_schema("line.isl")
    return validate(table(spark, sf_dir, "lineitem"), "t", s).select("l_orderkey", "l_linenumber", "is_valid")


@query("SELECT * FROM (VALUES ('common.isl', 'flag', 'defined'), ('common.isl', 'qty', 'defined'), ('line.isl', 't', 'defined'), ('line.isl', 'returned', 'imported')) v(\"schema\", \"type\", origin)")
def type_catalogue(spark, sf_dir):
    return catalogue(spark, SchemaSystem([MapAuthority(_DOCS)]), "common.isl", "line.isl").select("schema", "type", "origin")


@query("SELECT * FROM (VALUES ('bad_occurs', false), ('bad_range', false), ('bad_regex', false), ('good', true), ('unknown_type', false), ('unknown_version', false)) v(\"case\", ok)")
def static_check(spark, sf_dir):
    """Which documents are schemas."""
    cases = {
        "good": "type::{name: t, type: int}",
        "bad_occurs": "type::{name: t, fields: {a: {type: int, occurs: 0}}}",
        "bad_range": "type::{name: t, valid_values: range::[5, 1]}",
        "bad_regex": 'type::{name: t, regex: "a(?=b)"}',
        "unknown_type": "type::{name: t, type: nowhere}",
        "unknown_version": "$ion_schema_4_5",
    }

    documents = spark.createDataFrame(list(cases.items()), "id string, text string")
    return schema_issues(documents).select(F.col("id").alias("case"), "ok")


@query("SELECT * FROM (VALUES (false, 1, false)) v(result, n, has_error)")
def sandbox(spark, sf_dir):
    out = sandbox_validate(spark, "[1, 2, true]", "type::{name: t, type: list, element: int}", "t")
    return out.select("result", F.size("violations").alias("n"), "has_error")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate(table(spark, sf_dir, "lineitem"), "t", schema(RULES), mode="violations")
    return out.select("l_orderkey", "l_linenumber", "is_valid", "violations")


def queries() -> dict[str, Query]:
    from assayer import schema_queries  # noqa: F401  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


"""The command line, conformance files, sources, sinks, streams and the sandbox."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assayer.__main__ import main
from assayer.functions.ion import read_all
from assayer.functions.ionbinary import write_binary
from assayer.operators.api import sandbox_validate, validate, validate_ion
from assayer.plans.conformance import run_file
from assayer.plans.system import MapAuthority, SchemaSystem
from assayer.sources import TableAuthority, catalogue, read_ion, schema_issues, write_ion
from assayer.streaming import quarantine, validate_stream, windowed_validity

SCHEMA = "$ion_schema_2_0 type::{name: t, fields: {a: {type: int, valid_values: range::[0, 9], occurs: required}}}"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "s.isl").write_text(SCHEMA)
    (tmp_path / "bad.isl").write_text("type::{name: t, type: nowhere}")
    (tmp_path / "values.ion").write_text("{a: 5} {a: 12}\n{b: 1}")
    (tmp_path / "good.ion").write_text("{a: 5}")
    return tmp_path


def test_command_line(folder, capsys):
    d = ["-d", str(folder)]
    assert main(["load", *d, "-s", "s.isl"]) == 0
    assert "valid_values" in capsys.readouterr().out
    assert main(["load", *d, "-s", "bad.isl"]) == 2 and main(["load", *d, "-s", "gone.isl"]) == 2
    capsys.readouterr()
    assert main(["validate", *d, "-s", "s.isl", "-t", "t", "-i", str(folder / "values.ion")]) == 1
    out = capsys.readouterr().out
    assert out.count(": Valid") == 1 and out.count(": Invalid") == 2
    assert main(["validate", *d, "-s", "s.isl", "-t", "t", "-i", str(folder / "good.ion")]) == 0
    assert main(["validate", *d, "-s", "s.isl", "-t", "u", "-i", str(folder / "good.ion")]) == 2


CASES = """$ion_schema_2_0
type::{name: t, type: int}
type::{name: d, type: document, element: int}
$test::{description: "schemas", valid_schemas: [($ion_schema_2_0 type::{name: a})], invalid_schemas: [($ion_schema_2_0 type::{name: a, type: b})]}
$test::{description: "types", invalid_types: [{valid_values: 5}, null]}
$test::{type: t, should_accept_as_valid: [1, 2], should_reject_as_invalid: [a, null.int]}
$test::{type: {type: list, element: t}, should_accept_as_valid: [[1]], should_reject_as_invalid: [[a]]}
$test::{type: d, should_accept_as_valid: [document::(1 2)], should_reject_as_invalid: [document::(a), (1)]}
"""


def test_conformance_files():
    outcomes = list(run_file(SchemaSystem([MapAuthority({"c": CASES})]), "c"))
    assert len(outcomes) == 14 and all(o.passed for o in outcomes), [o for o in outcomes if not o.passed]
    wrong = CASES.replace("should_accept_as_valid: [1, 2]", "should_accept_as_valid: [1, x]").replace("invalid_schemas: [($ion_schema_2_0 type::{name: a, type: b})]", "invalid_schemas: [($ion_schema_2_0 type::{name: a})]")
    assert sum(not o.passed for o in run_file(SchemaSystem([MapAuthority({"c": wrong})]), "c")) == 2
    assert [o.passed for o in run_file(SchemaSystem([MapAuthority({})]), "gone")] == [False]


def test_ion_files(spark, folder):
    df = read_ion(spark, str(folder / "values.ion"))
    assert df.count() == 3 and df.where("error is null").count() == 3
    schema = SchemaSystem().new_schema(SCHEMA, "s")
    assert sorted(r["is_valid"] for r in validate_ion(df, "value", "t", schema).collect()) == [False, False, True]
    assert validate_ion(df, "value", "t", schema, mode="filter").count() == 1
    report = validate_ion(df, "value", "t", schema, mode="report").collect()
    assert sorted(r["result"] for r in report) == ["Invalid", "Invalid", "Valid"] and {r["schema"] for r in report} == {"s"}
    (folder / "binary.ion").write_bytes(write_binary(read_all("{a: 5} {a: 12} {b: 1}")))
    assert sorted(r["value"] for r in read_ion(spark, str(folder / "binary.ion")).collect()) == sorted(r["value"] for r in df.collect())
    (folder / "binary.isl").write_bytes(write_binary(read_all(SCHEMA)))
    assert main(["validate", "-d", str(folder), "-s", "binary.isl", "-t", "t", "-i", str(folder / "binary.ion")]) == 1
    (folder / "broken.ion").write_text("{a: ")
    assert read_ion(spark, str(folder / "broken.ion")).first()["error"]
    assert read_ion(spark, str(folder / "values.ion"), lines=True).count() == 3
    write_ion(df, str(folder / "out"))
    assert read_ion(spark, str(folder / "out")).count() == 3


def test_broken_and_missing_texts_are_invalid(spark):
    df = spark.createDataFrame([("{a: 1}",), ("{a:",), (None,), ("1 2",)], "v string")
    rows = validate_ion(df, "v", "t", SchemaSystem().new_schema(SCHEMA, "s"), mode="violations").collect()
    assert [r["is_valid"] for r in rows] == [True, False, False, False]
    assert {r["violations"][0]["code"] for r in rows[1:]} == {"ion_error"}
    whole = validate_ion(df, "v", "t", SchemaSystem().new_schema("$ion_schema_2_0 type::{name: t, type: document, container_length: 2}", "s"), document=True)
    assert [r["is_valid"] for r in whole.collect()] == [False, False, False, True]


def test_schemas_in_a_table(spark):
    table = spark.createDataFrame([("s.isl", SCHEMA)], "id string, text string")
    system = SchemaSystem([TableAuthority(table)])
    assert [tuple(r)[:3] for r in catalogue(spark, system, "s.isl").collect()] == [("s.isl", "t", "defined")]


def test_schema_issues(spark):
    table = spark.createDataFrame([(1, SCHEMA), (2, "type::{"), (3, "type::{name: t, type: gone}"), (4, None), (None, 'type::{name: t, type: {id: "base", type: u}}')], "id int, text string")
    rows = {r["id"]: r for r in schema_issues(table, system=SchemaSystem([MapAuthority({"base": "type::{name: u}"})])).collect()}
    assert {k: r["ok"] for k, r in rows.items()} == {1: True, 2: False, 3: False, 4: True, None: True}
    assert "gone" in rows[3]["issue"] and rows[1]["issue"] is None


def test_report_and_modes(spark):
    df = spark.createDataFrame([(1,), (20,), (None,)], "a int")
    schema = SchemaSystem().new_schema(SCHEMA, "s")
    assert [r["result"] for r in validate(df, "t", schema, mode="report").collect()] == ["Valid", "Invalid", "Invalid"]
    assert [len(r["violations"]) for r in validate(df, "t", schema, mode="violations").collect()] == [0, 1, 1]


def test_recursive_types_are_interpreted(spark):
    schema = SchemaSystem().new_schema("$ion_schema_2_0 type::{name: t, one_of: [int, {type: list, element: t}]}", "s")
    df = spark.createDataFrame([("[1, [2, [3]]]",), ("[1, [2, [true]]]",), ("5",)], "x string").withColumn("v", F.parse_json("x"))
    assert [r["is_valid"] for r in validate(df, "t", schema, "v").collect()] == [True, False, True]
    assert validate(df, "t", schema, "v", mode="filter").count() == 2


def test_sandbox(spark):
    one = sandbox_validate(spark, "{a: 12}", SCHEMA, "t").first()
    assert one["result"] is False and one["violations"][0]["path"] == "( a )" and not one["has_error"]
    assert sandbox_validate(spark, "{a: 1}", SCHEMA, "t").first()["result"] is True
    assert sandbox_validate(spark, "1 2", "type::{name: t, type: document}", "t", is_document=True).first()["result"] is True
    for ion, schema, name in (("1 2", SCHEMA, "t"), ("1", "type::{", "t"), ("1", SCHEMA, "u")):
        row = sandbox_validate(spark, ion, schema, name).first()
        assert row["has_error"] and row["error"]


def test_streams(spark, tmp_path):
    spark.range(20).select(F.col("id").alias("a"), F.timestamp_seconds(F.col("id") * 60).alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = SchemaSystem().new_schema(SCHEMA, "s")

    def stream():
        return spark.readStream.schema("a bigint, at timestamp").parquet(str(tmp_path / "in"))

    quarantine(stream(), "t", schema, *(str(tmp_path / d) for d in ("good", "bad", "mark"))).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 10
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert bad.count() == 10 and bad.where("size(violations) = 1").count() == 10
    # A batch that is replayed replaces what it wrote.
    import shutil

    shutil.rmtree(tmp_path / "mark")
    quarantine(stream(), "t", schema, *(str(tmp_path / d) for d in ("good", "bad", "mark")), trigger={"once": True}).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 10
    kept = validate_stream(stream(), "t", schema, mode="filter").writeStream.format("memory").queryName("kept").trigger(availableNow=True).start()
    kept.awaitTermination()
    assert spark.table("kept").count() == 10
    counted = windowed_validity(stream(), "t", schema, "at", "10 minutes", "1 minute").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert sorted((r["n_valid"], r["n_invalid"]) for r in spark.table("counted").collect()) == [(0, 10), (10, 0)]


def test_columns_of_the_caller_are_kept(spark):
    """By modes that add none, whatever their names; also where a type is interpreted."""
    schema = SchemaSystem().new_schema("$ion_schema_2_0 type::{name: t, one_of: [int, {type: list, element: t}]}", "s")
    df = spark.createDataFrame([("[1]", "x", 7, 1.5), ("[a]", "y", 8, 2.5)], "j string, _ion string, is_valid int, _valid double").withColumn("v", F.expr("try_parse_json(replace(j, 'a', '\"a\"'))"))
    for mode, want in (("filter", ("x", 7, 1.5)), ("reject", ("y", 8, 2.5))):
        out = validate(df, "t", schema, "v", mode=mode)
        assert out.columns == df.columns and [(r["_ion"], r["is_valid"], r["_valid"]) for r in out.collect()] == [want]
    flagged = validate(df, "t", schema, "v").select("_ion", "is_valid").collect()
    assert sorted(map(tuple, flagged)) == [("x", True), ("y", False)]

"""Ion text in and out of Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from assayer.functions.ion import Element, IonError, read_all, write
from assayer.functions.ionbinary import read_any
from assayer.plans.system import SchemaSystem


def read_ion(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, position, value (Ion text) and error of the top-level values of files, text or binary.

    lines: each line of text files is read by itself, so large files are split
    among tasks; otherwise a file is one task's row and has to fit its memory.  What isn't Ion gives one row
    with an error.
    """
    if lines:
        source = spark.read.text(path).selectExpr("_metadata.file_path AS file", "cast(value AS binary) AS value")
    else:
        source = spark.read.format("binaryFile").load(path).selectExpr("path AS file", "content AS value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(file, k, write(e), None) for k, e in enumerate(read_any(data))]
                except IonError as e:
                    rows.append((file, 0, data.decode("utf-8", "replace"), str(e)))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["file", "position", "value", "error"])

    return source.mapInArrow(run, "file string, position int, value string, error string")


def write_ion(df: DataFrame, path: str, col: str = "value") -> None:
    """One value a line."""
    df.select(df[col].cast("string").alias("value")).write.mode("overwrite").text(path)


class TableAuthority:
    """Schema documents in a DataFrame of (id, text): one is fetched by a filter when it is asked for."""

    def __init__(self, df: DataFrame):
        self.df = df

    def elements(self, schema_id: str) -> list[Element]:
        found = self.df.where(self.df["id"] == schema_id).select("text").head(1)
        if not found:
            raise FileNotFoundError(schema_id)
        return read_all(found[0]["text"])


def schema_issues(df: DataFrame, id: str = "id", text: str = "text", system: SchemaSystem | None = None) -> DataFrame:
    """id, ok and issue of schema documents in a table; issue says which rule a document breaks.

    Imports are looked up through the authorities of `system`.
    """
    system = system or SchemaSystem()
    kind = dict(df.dtypes)[id]

    def issue(name, body: str | None) -> str | None:
        try:
            system.new_schema(body or "", str(name))
        except (ValueError, LookupError, RecursionError) as e:
            return f"{type(e).__name__}: {e}"
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [issue(n, t) for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x is None for x in found]), pa.array(found, pa.string())], ["id", "ok", "issue"])

    return df.select(id, text).mapInArrow(run, f"id {kind}, ok boolean, issue string")


def catalogue(spark: SparkSession, system: SchemaSystem, *schema_ids: str) -> DataFrame:
    """schema, type, origin and text of all types of the schemas."""
    rows = [r for s in schema_ids for r in system.load_schema(s).rows]
    return spark.createDataFrame(rows, "schema string, type string, origin string, text string")

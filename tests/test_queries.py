"""Every query of the catalogue against its SQL in DuckDB, and the plans that matter."""

from __future__ import annotations

import math
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from assayer import queries as catalogue

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    found = rows_of(df.columns, df.collect())
    assert found
    sql = catalogue.oracle_sql().get(name)
    if sql:
        result = duck.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert found == rows_of(names, result.fetchall())


def test_every_query_has_sql():
    assert set(catalogue.oracle_sql()) == set(catalogue.queries())


def test_entry_has_a_stable_schema(spark):
    df = driver.entry(spark)
    assert df.columns == ["l_orderkey", "l_linenumber", "is_valid", "violations"]
    assert set(catalogue.queries()) <= set(driver.queries())


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_filters_reach_the_scan(spark):
    plan = plan_of(catalogue.validate_filter(spark, SF))
    pushed = next(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(l_quantity,10.0)" in pushed and "EqualTo(l_returnflag,A)" in pushed
    assert "l_extendedprice" not in pushed.split("ReadSchema")[1]


def test_row_validation_does_not_shuffle(spark):
    for name in ("all_of", "violations_rows", "fields_required", "element", "ion_text"):
        plan = plan_of(catalogue.queries()[name](spark, SF))
        assert "Exchange" not in plan


def test_documents_are_combined_before_the_shuffle(spark):
    plan = plan_of(catalogue.document_element(spark, SF))
    assert "partial_bool_and" in plan or "partial_min" in plan or "partial_every" in plan


def test_regex_dialect_equals_sql_beyond_ascii(spark, tmp_path):
    texts = ["é a é", "à côté.", "a bé", "a b é", "٣x", "3٣", "x the x", "qü", "Data ſ", "È" + "x" * 40, "é."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("regex_dialect", "regex_flags"):
        df = catalogue.queries()[name](spark, str(tmp_path))
        result = con.execute(catalogue.oracle_sql()[name])
        assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in result.description], result.fetchall())

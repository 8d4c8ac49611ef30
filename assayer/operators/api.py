"""Validation of DataFrames.

``validate`` works row by row and is one projection or filter: no shuffle, no
aggregate, usable on streams.  ``validate_document`` takes the whole frame (or
each group) as one value of type document and needs only partial aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.ion import Element, IonError
from assayer.operators import interpret
from assayer.operators.compile import LEAF, Automaton, Compiler, NotCompilable
from assayer.operators.documents import ordered_documents
from assayer.operators.views import Options, Row, Typed, Variant, View, both, column, sure
from assayer.plans.system import BUILTINS, Schema, SchemaSystem, Type

__all__ = ["Options", "document_length", "explain_violations", "is_valid", "sandbox_validate", "validate", "validate_document", "validate_ion", "violations"]


def _type(schema: Schema | None, type_: str | Type) -> Type:
    return type_ if isinstance(type_, Type) else schema[type_] if schema is not None else BUILTINS[type_]


def _view(df: DataFrame, col: str | Column | None, options: Options) -> View:
    if col is None:
        return Row(df.schema, options)
    expr = F.col(col) if isinstance(col, str) else col
    dtype = df.select(expr.alias("x")).schema["x"].dataType
    if isinstance(dtype, T.VariantType):
        return Variant(expr, options)
    return Typed(expr, dtype, options, col if isinstance(col, str) else "")


def is_valid(df: DataFrame, type_: str | Type, schema: Schema | None = None, col: str | Column | None = None, options: Options | None = None) -> Column:
    """A non-null boolean Column: whether each row (or a column of it) is of the type."""
    options = options or Options()
    return column(Compiler(options).valid(_type(schema, type_), _view(df, col, options)))


def violations(df: DataFrame, type_: str | Type, schema: Schema | None = None, col: str | Column | None = None, options: Options | None = None) -> Column:
    """The leaves of each row's violations, sorted; empty for a valid row."""
    options = options or Options()
    return F.sort_array(Compiler(options).leaves(_type(schema, type_), _view(df, col, options)).cast(LEAF))


def validate(df: DataFrame, type_: str | Type, schema: Schema | None = None, col: str | Column | None = None, mode: str = "flag", options: Options | None = None) -> DataFrame:
    """mode: flag adds is_valid, filter keeps valid rows, reject keeps the others, violations adds is_valid and violations, report gives result, value, schema and violation.

    A type that expressions can't say (recursive, over a VARIANT) is interpreted
    on the JSON text of the value, which is Ion text too.  Modes flag and
    violations replace columns of those names; filter and reject keep all
    columns as they are.
    """
    t = _type(schema, type_)
    try:
        truth = is_valid(df, t, schema, col, options)
    except NotCompilable:
        return _interpreted(df, t, col, mode, schema)
    if mode == "flag":
        return df.withColumn("is_valid", truth)
    if mode == "filter":
        compiler = Compiler(options)
        return df.where(column(both(compiler.implied(t, _view(df, col, compiler.options)), truth)))
    if mode == "reject":
        return df.where(~truth)
    leaves = violations(df, t, schema, col, options)
    if mode == "violations":
        return df.withColumn("violations", leaves).withColumn("is_valid", F.size("violations") == 0)
    value = F.to_json(F.struct("*")) if col is None else F.to_json(F.struct(F.col(col) if isinstance(col, str) else col))
    return df.select(value.alias("value"), leaves.alias("leaves")).select(
        F.when(F.size("leaves") == 0, "Valid").otherwise("Invalid").alias("result"),
        "value",
        F.lit(schema.id if schema is not None else "").alias("schema"),
        F.when(F.size("leaves") > 0, F.array_join(F.transform("leaves", lambda x: F.concat_ws(" ", x["code"], x["path"])), "; ")).alias("violation"),
    )


def _unused(name: str, df: DataFrame) -> str:
    while name in df.columns:
        name += "_"
    return name


def _interpreted(df: DataFrame, t: Type, col, mode: str, schema: Schema | None) -> DataFrame:
    expr = F.struct(*df.columns) if col is None else F.col(col) if isinstance(col, str) else col
    text = _unused("_ion", df)
    out = validate_ion(df.withColumn(text, F.to_json(expr)), text, t, mode=mode, schema=schema)
    return out if mode == "report" else out.drop(text)


def _once(texts: pa.Array, check: Callable) -> tuple[list[str | None], list, pa.Array]:
    """A batch's texts without repeats, what check says of each, and which of them each row has."""
    coded = texts.dictionary_encode(null_encoding="encode")
    distinct = coded.dictionary.to_pylist()
    return distinct, [check(x) for x in distinct], coded.indices


def validate_ion(df: DataFrame, col: str, type_: str | Type, schema: Schema | None = None, mode: str = "flag", document: bool = False) -> DataFrame:
    """Validates Ion text exactly, in Arrow batches, each text of a batch once.  A text that is no Ion, or null, is invalid with code ion_error."""
    t = _type(schema, type_)
    name = schema.id if schema is not None else ""

    def check(text: str | None) -> interpret.Violation | None:
        try:
            if text is None:
                raise IonError("no text")
            return interpret.validate(interpret.read_value(text, document), t)
        except IonError as e:
            return interpret.Violation("ion", "ion_error", str(e), "( )")

    if mode == "report":

        def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, found, at = _once(b.column(0), check)
                columns = [["Invalid" if v else "Valid" for v in found], texts, [name] * len(texts), [v.tree() if v else None for v in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()).take(at) for c in columns], ["result", "value", "schema", "violation"])

        return df.select(col).mapInArrow(report, "result string, value string, schema string, violation string")
    verdict = _unused("_valid", df) if mode in ("filter", "reject") else "is_valid"
    rest = [c for c in df.columns if c not in (verdict, "violations" if mode == "violations" else verdict)]
    df = df.select(*rest)
    at = rest.index(col)
    leaf = pa.list_(pa.struct([(k, pa.string()) for k in ("constraint", "code", "message", "path")]))

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, found, places = _once(b.column(at), check)
            more = [pa.array([v is None for v in found], pa.bool_()).take(places)]
            if mode == "violations":
                rows = [sorted(x.row() for x in v.leaves()) if v else [] for v in found]
                more.append(pa.array([[dict(zip(("constraint", "code", "message", "path"), x, strict=True)) for x in r] for r in rows], leaf).take(places))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*rest, verdict, *["violations"] * (mode == "violations")])

    schema_ = T.StructType([*df.schema.fields]).add(verdict, "boolean")
    if mode == "violations":
        schema_ = schema_.add("violations", T._parse_datatype_string(LEAF))
    out = df.mapInArrow(flag, schema_)
    if mode in ("filter", "reject"):
        return out.where(F.col(verdict) if mode == "filter" else ~F.col(verdict)).drop(verdict)
    return out


def validate_document(df: DataFrame, type_: str | Type, schema: Schema | None = None, col: str | Column | None = None, by: list[str] | None = None, order_by: str | None = None, options: Options | None = None) -> DataFrame:
    """is_valid for the frame, or each group of `by`, as one document whose values are the rows (or a column).

    All constraints but ordered_elements need counts and minima only and are
    combined before the shuffle.  For ordered_elements rows are dealt out by
    range, so a document may be of any length.
    """
    options = options or Options()
    t = _type(schema, type_)
    compiler, view = Compiler(options), _view(df, col, options)
    made: list[Column] = []
    ordered: list[DataFrame] = []

    def aggregate(x: Column) -> Column:
        made.append(x)
        return F.col(f"_{len(made) - 1}")

    def document(t: Type) -> bool | Column:
        if t.kind == "document":
            return True
        if t.kind == "atom":
            return False
        return both(*[check(name, arg) for name, arg in t.constraints])

    def check(name: str, arg) -> bool | Column:
        if name == "type":
            return document(arg.type)
        if name == "all_of":
            return both(*[document(r.type) for r in arg])
        if name == "any_of":
            return column(sum_(arg) > 0)
        if name == "one_of":
            return column(sum_(arg) == 1)
        if name == "not":
            return ~column(document(arg.type))
        if name == "container_length":
            return compiler._counted(aggregate(F.count("*")), arg)
        if name == "element":
            every = sure(aggregate(F.bool_and(column(compiler.ref(arg[0], view)))))
            every = every | (aggregate(F.count("*")) == 0)
            if arg[1]:
                every = every & (aggregate(F.count_distinct(F.struct(view.col))) == aggregate(F.count("*")))
            return every
        if name == "contains":
            return both(*[sure(aggregate(F.bool_or(column(compiler._valid_values((x,), view))))) for x in arg])
        if name == "ordered_elements":
            if order_by is None:
                raise ValueError("ordered_elements over a document needs order_by")
            auto = Automaton(arg)
            ordered.append(ordered_documents(df, by or [], F.col(order_by), [column(compiler.ref(r, view)) for r in auto.refs], auto))
            # Without rows a document is in the automaton's start.
            return F.coalesce(F.col(f"_ordered_{len(ordered) - 1}"), F.lit(bool(auto.accepting & 1)))
        return False  # guards of other constraints don't take documents

    def sum_(refs) -> Column:
        from functools import reduce

        return reduce(lambda a, b: a + b, [column(document(r.type)).cast("int") for r in refs], F.lit(0))

    truth = column(document(t))
    made = made or [F.count("*")]
    grouped = df.groupBy(*by) if by else df.groupBy()
    found = grouped.agg(*[x.alias(f"_{k}") for k, x in enumerate(made)])
    for k, other in enumerate(ordered):
        own = other.select(*[F.col(f"`{c}`").alias(f"_by_{k}_{c}") for c in by or []], F.col("ok").alias(f"_ordered_{k}"))
        same = F.lit(True)
        for c in by or []:
            same = same & found[f"`{c}`"].eqNullSafe(own[f"`_by_{k}_{c}`"])
        found = found.join(own, same, "left")  # without `by`, one row and one row at most
    return found.select(*[found[f"`{c}`"] for c in by or []], truth.alias("is_valid"))


def document_length(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("length"))


def explain_violations(df: DataFrame) -> DataFrame:
    """Counts by constraint and code of a frame with violations."""
    return df.select(F.explode("violations").alias("v")).groupBy(F.col("v.constraint").alias("constraint"), F.col("v.code").alias("code")).agg(F.count("*").alias("n"))


def sandbox_validate(spark: SparkSession, ion: str, schema_text: str, type_name: str, is_document: bool = False) -> DataFrame:
    """One row: result, violations (path, code, message), value, has_error and error."""
    ddl = "result boolean, violations array<struct<path: string, code: string, message: string>>, value string, has_error boolean, error string"
    try:
        schema = SchemaSystem().new_schema(schema_text, "sandbox")
        value: Element | interpret.Document = interpret.read_value(ion, is_document)
        found = interpret.validate(value, schema[type_name])
        row = (found is None, [(x.path, x.code, x.message) for x in (found.leaves() if found else [])], str(value), False, "")
    except (ValueError, LookupError) as e:
        row = (False, [], ion, True, str(e))
    return spark.createDataFrame([row], ddl)

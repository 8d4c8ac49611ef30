"""ordered_elements over documents of any length.

A document's rows are dealt out by range, so a long one lies in many tasks.  Each
task folds its stretch of a document into a relation: for every bit of the
automaton, the bits that it leads to.  Relations are composed in order, one for
each stretch, so no task holds a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators.compile import Automaton


def ordered_documents(df: DataFrame, by: list[str], order: Column, truths: list[Column], auto: Automaton) -> DataFrame:
    """by and ok: whether the rows of each group, in order, are what the automaton accepts."""
    matched = F.lit(0).cast("long")
    for k, truth in enumerate(truths):
        matched = matched.bitwiseOR(F.when(truth, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    keys = [F.col(f"`{k}`") for k in by]
    rows = df.select(F.struct(F.lit(0).alias("_all"), *keys).alias("group"), order.alias("at"), matched.alias("matched"))
    rows = rows.repartitionByRange("group", "at").sortWithinPartitions("group", "at")
    bits = len(auto.ref) + 1
    start = tuple(1 << b for b in range(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after: dict[tuple[int, int], int] = {}
        moved: dict[tuple[tuple[int, ...], int], tuple[int, ...]] = {}

        def move(relation: tuple[int, ...], m: int) -> tuple[int, ...]:
            for s in relation:
                if (s, m) not in after:
                    after[s, m] = auto.after(s, m)
            return tuple(after[s, m] for s in relation)

        group, stretch, out = None, None, []
        for b in batches:
            for g, at, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if stretch is None or g != group:
                    if stretch is not None:
                        out.append({"group": group, "at": first, "relation": list(stretch)})
                    group, first, stretch = g, at, start
                key = (stretch, m)
                if key not in moved:
                    if len(moved) > 100_000:
                        moved.clear()
                    moved[key] = move(stretch, m)
                stretch = moved[key]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if stretch is not None:
            yield pa.RecordBatch.from_pylist([{"group": group, "at": first, "relation": list(stretch)}], schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = T.StructType([*rows.schema.fields[:2], T.StructField("relation", T.ArrayType(T.LongType()))])
    schema = to_arrow_schema(ddl)
    stretches = rows.mapInArrow(run, ddl).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("at", "relation"))).alias("stretches"))
    zero = F.lit(0).cast("long")

    def compose(state: Column, x: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(bits - 1))
        return F.aggregate(places, zero, lambda found, b: F.when(F.call_function("getbit", state, b) != 0, found.bitwiseOR(F.get(x["relation"], b))).otherwise(found))

    last = F.aggregate("stretches", F.lit(1).cast("long"), compose)
    return stretches.select(*[F.col("group").getField(k).alias(k) for k in by], auto.accepts(last).alias("ok"))

"""Validation of streams.

Row-level validation is stateless, so a stream is validated as it is; both sides
of a split go to their own sinks.  Documents on a stream are windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.operators.api import is_valid, validate

__all__ = ["quarantine", "validate_stream", "windowed_validity"]


def validate_stream(stream: DataFrame, type_, schema=None, **options) -> DataFrame:
    """As validate(): a stateless projection or filter."""
    return validate(stream, type_, schema, **options)


def quarantine(stream: DataFrame, type_, schema, good: str, bad: str, checkpoint: str, col=None, options=None, trigger: dict | None = None) -> StreamingQuery:
    """Valid rows to one Parquet folder, others with their violations to another; each batch is checked once.

    A batch has a folder of its own (batch=number), which a batch that is
    replayed after a failure replaces, so no row comes twice.  trigger: arguments
    of DataStreamWriter.trigger; by default all that is there, and then an end.
    """

    def split(batch: DataFrame, number: int) -> None:
        checked = validate(batch, type_, schema, col, "violations", options).persist()
        try:
            checked.where("is_valid").drop("is_valid", "violations").write.mode("overwrite").parquet(f"{good}/batch={number}")
            checked.where("not is_valid").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        finally:
            checked.unpersist()

    return stream.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed_validity(stream: DataFrame, type_, schema, time: str, window: str, delay: str, col=None, options=None, where: Callable | None = None) -> DataFrame:
    """Valid and invalid rows for each window of event time, with a watermark for late rows."""
    flagged = stream.withColumn("is_valid", is_valid(stream, type_, schema, col, options)).withWatermark(time, delay)
    return flagged.groupBy(F.window(time, window)).agg(F.count_if("is_valid").alias("n_valid"), F.count_if(~F.col("is_valid")).alias("n_invalid"))

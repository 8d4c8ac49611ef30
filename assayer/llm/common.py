"""What the operators of this subpackage share: tables, workspaces, batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The characters that end a word: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \\t\\n\\x0B\\f\\r]+"
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under our own names: columns of the caller's can't clash with ours."""
    return df.select(*[df[source].alias(name) for name, source in wanted.items()])


def id_fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def words(text: Column) -> Column:
    """The words of a text, in order; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def sorted_join(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast.

    Spark estimates a table's size by its compressed file and doesn't count what
    explode() adds, so what passes for small may be many times that, on the driver first.
    """
    return df.hint("merge")


@contextlib.contextmanager
def row_by_row(spark: SparkSession) -> Iterator[None]:
    """What runs inside reads Parquet a row at a time: for rows of megabytes, of which Spark's reader else holds a whole row group."""
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    spark.conf.set(key, 1)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Workspace:
    """Tables in the folder that driver and executors share.

    A written table cuts the lineage and outlives its executors, and unlike
    ``checkpoint()`` it doesn't compute its last stage twice.  The folder is the
    one of ``spark.checkpoint.dir``.  Where that is unset, as in tests, a session
    in one process gets a temporary one; on a cluster it is an error, as
    executors don't share local folders.
    """

    #: The driver's heap as the last collection left it, in bytes.
    left = 0

    def __init__(self, spark: SparkSession):
        self.spark = spark
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not top:
            if not spark.sparkContext.master.partition("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            top = "file://" + tempfile.mkdtemp(prefix="assayer-")
            spark.sparkContext.setCheckpointDir(top)
        self.path = f"{top.rstrip('/')}/assayer-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        self.tidy()
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def tidy(self) -> None:
        """Collects the driver's garbage once its heap takes over half of its limit.

        A heap that grows is kept, and with it every shuffle and broadcast that
        waits for a collection.  A heap that is full of live objects is left
        alone until it grows by a quarter.
        """
        heap = self.spark._jvm.java.lang.Runtime.getRuntime()
        if heap.totalMemory() > max(heap.maxMemory() / 2, Workspace.left * 1.25):
            self.spark._jvm.System.gc()
            Workspace.left = heap.totalMemory()

    def drop(self, *names: str) -> None:
        """Removes tables that nothing will read again."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            with contextlib.suppress(Exception):
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a frame of bounded size, on the driver: as Arrow, without an object a row."""
    found = df.select(*names).toArrow()
    return [found.column(n).to_numpy() for n in names]


#: A task sends and gets batches of about so many bytes.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema), in batches of BATCH_BYTES (a longer row has one of its own) for this session, whatever its rows' number."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(key).rstrip("bB")) != BATCH_BYTES:
        conf.set(key, BATCH_BYTES)

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        free_memory()

    return df.mapInArrow(trimmed, schema)


def free_memory() -> None:
    """Gives a worker's freed memory back: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every libc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of the batches of about max_bytes at most (one row may be larger), so working memory is bounded.

    They are copies, not views: Arrow's ascii_lower takes a view of large
    strings for the whole.
    """
    for batch in batches:
        rows = max(1, int(batch.num_rows * max_bytes / max(1, batch.nbytes)))
        if rows >= batch.num_rows:
            yield batch
            continue
        for start in range(0, batch.num_rows, rows):
            yield batch.take(pa.array(range(start, min(start + rows, batch.num_rows))))
        pa.default_memory_pool().release_unused()

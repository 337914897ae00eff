"""Session settings, shared-folder tables and small helpers of the operators in this subpackage."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .textvec import byte_view

#: Bytes of text that a vectorised step looks at together (one longer text is a step of its own).
STEP_BYTES = 1 << 20
#: Spark's setting for the rows of an Arrow batch, its default, and the rows for jobs that an operator runs itself.
ARROW_KEY, ARROW_DEFAULT, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", 512
#: A side of a join is broadcast up to so many rows of a few bytes (counted first); beyond it both sides are shuffled.
BROADCAST_IDS = 1_000_000
#: The same for stored tables of texts: up to so many compressed bytes.
BROADCAST_BYTES = 8 << 20


def prepare() -> None:
    """Lets functions of this package travel to the workers by value, so that they need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ARROW_ROWS rows for the jobs that run inside, then the session's own again: what lies beside a step in
    a worker's memory is 1 MB of usual texts instead of 20."""
    before = spark.conf.get(ARROW_KEY)
    spark.conf.set(ARROW_KEY, str(ARROW_ROWS))
    try:
        yield
    finally:
        if before == ARROW_DEFAULT:
            spark.conf.unset(ARROW_KEY)
        else:
            spark.conf.set(ARROW_KEY, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local master, whose executors are the
    driver, may do without: there it is a folder in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/stratalog-work"


def _file_system(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def own_path(spark: SparkSession, name: str) -> str:
    """A new, empty folder in the shared one; it is deleted when the application ends, if not before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files, target = _file_system(spark, path)
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts the lineage, survives lost executors.

    Shuffle files of the job that wrote it are dropped when the driver's JVM collects its garbage; it is asked to do so
    here, as disks would else hold the shuffles of all the jobs of a query side by side.
    """
    spark = df.sparkSession
    path = own_path(spark, name)
    with small_batches(spark):
        df.write.mode("append").parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that stored() has made and that no later step reads."""
    for t in tables:
        forget(t.sparkSession, t._stored_path)


def forget(spark: SparkSession, path: str | None = None) -> None:
    """Deletes what stored() has written (all of it, or one path)."""
    files, target = _file_system(spark, path or shared_dir(spark))
    files.delete(target, True)


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether df has at most so many rows (BROADCAST_IDS, if none are given); counts no further than that."""
    rows = BROADCAST_IDS if rows is None else rows
    return df.limit(rows + 1).count() <= rows


def is_light(table: DataFrame) -> bool:
    """Whether the files of a table that stored() has made are within BROADCAST_BYTES: for rows of no bounded size."""
    files, target = _file_system(table.sparkSession, table._stored_path)
    return files.getContentSummary(target).getLength() <= BROADCAST_BYTES


def join_small(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Broadcasts right only if its counted rows are within BROADCAST_IDS; else Spark shuffles both sides."""
    return left.join(F.broadcast(right) if is_small(right) else right, on, how)


def join_light(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Broadcasts a stored table only if its files are within BROADCAST_BYTES; else Spark shuffles both sides."""
    return left.join(F.broadcast(right) if is_light(right) else right, on, how)


def remainder(column: str, of: int) -> F.Column:
    """crc32 of the id as text, modulo: decides which rows are held out."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(of))


def slices(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part has at most `limit` bytes of text, or one row."""
    _, offsets = byte_view(batch.column(column), copy=False)
    at, n = 0, batch.num_rows
    while at < n:
        end = at + 1
        while end < n and offsets[end + 1] - offsets[at] <= limit:
            end += 1
        yield batch.slice(at, end - at)
        at = end


def parts(batches: Iterator[pa.RecordBatch], rows: int = ARROW_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in parts of so many rows, none of them empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def trim() -> None:
    """Gives memory that a task has freed back to the system, which else stays with a worker that waits for its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass


def map_text(
    df: DataFrame, column: str, schema: str | StructType,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]],
) -> DataFrame:
    """mapInArrow over parts of bounded text; make() runs once a task and returns the function for a part."""

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, column):
                if (out := step(part)) is not None and out.num_rows:
                    yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from steps(batches)
        trim()

    return df.mapInArrow(run, schema)

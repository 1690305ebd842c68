"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import cut_lineage, scratch_path, ship_package

#: A side with at most this many rows of a few bytes each may be broadcast; the
#: rows are counted first, and a larger side takes a shuffle join.
BROADCAST_ROWS = 1_000_000

#: Rows of an Arrow batch.
BATCH_ROWS = 1024

#: Stand-in keys for null ids lie above every real id.
NULL_KEY = 1 << 62


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write to the shared checkpoint folder and go on from there.  A ``narrow``
    table (a few numbers a row, straight from a shuffle) is written in an eighth as
    many files as there are shuffle partitions, at least two for each core."""
    if narrow:
        spark = df.sparkSession
        shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, shuffled // 8))
    return cut_lineage(df)


def kept(df: DataFrame) -> DataFrame:
    """Cache a table that is used again soon.  What a lost executor held is computed
    anew from the last cut, so this suits results that are cheap to repeat."""
    return df.persist()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet under the shared checkpoint folder and reread: compressed,
    and later readers take only the columns they need."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows are within ``limit``."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def key_or_hash(key: Column, text: Column) -> Column:
    """The record key; where it is null, a key above 2**62 from the text's hash."""
    spare = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(NULL_KEY - 1)).bitwiseOR(F.lit(NULL_KEY))
    return F.coalesce(key.cast("long"), spare)


def drop_stand_in(key: Column) -> Column:
    """Null again where the key is a stand-in."""
    return F.when(key < F.lit(NULL_KEY), key)


def trim() -> None:
    """Give freed memory back to the system: an idle worker keeps what it once used."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark) -> None:
    """Texts are long rows: where the session has Spark's default of 10,000 rows in
    an Arrow batch, take BATCH_ROWS, in the executors' JVM and in the workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def in_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package on the executors, small batches, and memory
    handed back at the end of each task."""
    ship_package(df.sparkSession)
    small_batches(df.sparkSession)

    def task(batches):
        yield from run(batches)
        trim()

    return df.mapInArrow(task, schema)


def per_batch(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], Iterator[dict]],
              rows: int = 512) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows: ``make`` gets a record
    batch and yields dicts of columns, which become one output batch each."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for columns in make(batch.slice(at, rows)):
                    yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return in_batches(df, run, schema)

"""Sources and sinks: event feed JSON, pass table parquet, run table append,
scoring bundles.  Scratch output goes under the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from touchline.session import FILE_ROWS, checkpoint_dir

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("match_id", T.LongType()),
    T.StructField("index", T.LongType()),
    T.StructField("team", T.StringType()),
    T.StructField("player_id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("location", T.ArrayType(T.DoubleType())),
    T.StructField("pass_end_location", T.ArrayType(T.DoubleType())),
    T.StructField("carry_end_location", T.ArrayType(T.DoubleType())),
    T.StructField("dribble_outcome", T.StringType()),
    T.StructField("shot_outcome", T.StringType()),
    T.StructField("shot_statsbomb_xg", T.DoubleType()),
    T.StructField("pass_height", T.StringType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("pass_body_part", T.StringType()),
    T.StructField("under_pressure", T.BooleanType()),
    T.StructField("pass_outcome", T.StringType()),
])

PASS_SCHEMA = T.StructType([
    T.StructField("pass_id", T.LongType()),
    T.StructField("match_id", T.LongType()),
    T.StructField("start_x", T.DoubleType()),
    T.StructField("start_y", T.DoubleType()),
    T.StructField("end_x", T.DoubleType()),
    T.StructField("end_y", T.DoubleType()),
    T.StructField("length", T.DoubleType()),
    T.StructField("height", T.StringType()),
    T.StructField("angle", T.DoubleType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("body_part", T.StringType()),
    T.StructField("under_pressure", T.BooleanType()),
    T.StructField("outcome", T.StringType()),
])


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never a machine-local path
    on a cluster: ``spark.checkpoint.dir`` names shared storage there)."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def write_events_json(events: DataFrame, spark: SparkSession, name: str) -> str:
    path = scratch(spark, name)
    events.write.mode("errorifexists").json(path)
    return path


def read_events_json(spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA) -> DataFrame:
    """SRC1: event files with an explicit schema (no inference pass over the data)."""
    return spark.read.schema(schema).json(path)


def write_partitioned(df: DataFrame, path: str, partition_by: str | None) -> None:
    """Parquet, in folders by ``partition_by`` if given.  Rebalancing splits the rows
    of a large folder over several tasks and joins small ones, so neither the number
    of folders nor a frequent value sets the number of writing tasks.  Files end after
    ``FILE_ROWS`` rows, which bounds the rows of a task that reads them."""
    rows = df.hint("rebalance", partition_by) if partition_by else df.hint("rebalance")
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_passes(passes: DataFrame, path: str) -> None:
    """SNK1: pass table as parquet partitioned by match, so a hold-out filter
    prunes partitions instead of scanning the table."""
    write_partitioned(passes, path, "match_id")


def read_passes(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: read the pass table (match_id comes back from the folder names)."""
    return spark.read.schema(PASS_SCHEMA).parquet(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """SNK4: append run rows to the run table."""
    runs.write.mode("append").parquet(path)

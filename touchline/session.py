"""Spark session defaults and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: AQE for runtime re-planning and skew splits,
# UTC session zone so timestamps line up with the SQL oracle, ANSI arithmetic.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "touchline") -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster the master and partition counts come from spark-submit; the
    arguments only matter for local runs and tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python
    stages find it wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_touchline_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="touchline-pkg-"), "touchline-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)
    sc._touchline_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session without the setting gets a scratch folder, recorded in the
    session so that every later call agrees on it.  On a cluster such a folder
    would be the driver's own, so the setting is required there.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="touchline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a file at most.  Spark puts at most 32 files into one reading task (128 MB, 4 MB
#: charged a file), so a task's rows stay bounded however well the columns compress.
FILE_ROWS = 32_768


def stored(df: DataFrame, name: str, file_rows: int | None = None) -> DataFrame:
    """Write as Parquet under the shared checkpoint folder and read back: columns are
    compressed, readers take those they need, and tasks grow in number, not in size.
    Files end after ``file_rows`` rows (default: ``FILE_ROWS``)."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.option("maxRecordsPerFile", file_rows or FILE_ROWS).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._touchline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df._touchline_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint dir for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)

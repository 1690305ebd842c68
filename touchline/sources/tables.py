"""Reading the supplied parquet tables.

Reads are lazy and column-pruned by Catalyst: a query that touches two
columns of ``lineitem`` only reads those two from the files.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table_path(sf_dir: str, name: str) -> str:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def require_columns(df: DataFrame, cols) -> None:
    """Raise with the list of absent columns (the reference's missing-feature check)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing selected features: {missing}")

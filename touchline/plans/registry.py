"""Query registry shared by ``__spark_entry__``, ``bench.py`` and the tests.

``register(name, oracle, dbl)`` records a Spark builder ``fn(spark, sf_dir)``
and, when the operator has a SQL equivalent, its DuckDB oracle.  Columns listed
in ``dbl`` are rounded to 6 digits on both sides (transcendental functions and
floating sums differ in the last bits between engines).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def round_sql(sql: str, dbl: list[str], digits: int = 6) -> str:
    if not dbl:
        return sql
    rep = ", ".join(f"round(CAST(\"{c}\" AS DOUBLE), {digits}) + 0.0 AS \"{c}\"" for c in dbl)
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"


def register(name: str, oracle: str | None = None, views: tuple = (), dbl: tuple = (), digits: int = 6):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            if dbl:
                df = df.withColumns({c: F.round(F.col(f"`{c}`").cast("double"), digits) + F.lit(0.0)
                                     for c in dbl})
            return df
        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = round_sql(with_views(oracle, *views), list(dbl), digits)
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so their registrations run."""
    from touchline.plans import (  # noqa: F401
        q_events, q_passes, q_formula, q_stats, q_runs, q_metrics, q_models, q_density, q_io, q_autofe, q_boosting)

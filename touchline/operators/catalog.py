"""Match and competition listings, JSON tag parsing, candidate de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matches(orders: DataFrame) -> DataFrame:
    """Match list view of orders: id, date, stage, home/away team, season."""
    return orders.select(
        F.col("o_orderkey").alias("match_id"), F.col("o_orderdate").alias("match_date"),
        F.col("o_orderpriority").alias("stage"), (F.col("o_custkey") % 32).alias("home_team"),
        ((F.col("o_custkey") + 7) % 32).alias("away_team"), F.col("o_orderstatus").alias("season"))


def matches_by_season(m: DataFrame, season: str) -> DataFrame:
    """SRC2: match list of one season."""
    return m.where(F.col("season") == F.lit(season))


def matches_sorted(m: DataFrame) -> DataFrame:
    """TOP1: newest first (range-partitioned global sort)."""
    return m.orderBy(F.col("match_date").desc(), F.col("match_id"))


def match_filter(m: DataFrame, stage: str, team: int) -> DataFrame:
    """FLT10: one stage, matches of one team (home or away)."""
    return m.where((F.col("stage") == F.lit(stage)) &
                   ((F.col("home_team") == F.lit(team)) | (F.col("away_team") == F.lit(team))))


def union_matches(frames: list[DataFrame]) -> DataFrame:
    """SET1: stack season frames; columns missing in one frame become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def competition_filter(customers: DataFrame, gender: str) -> DataFrame:
    """FLT9: gender, 360-data flag present, international competitions."""
    flag = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return customers.where((F.col("c_mktsegment") == F.lit(gender)) & flag.isNotNull()
                           & (F.col("c_nationkey") % 2 == 0)) \
        .select(F.col("c_custkey").alias("competition_id"), F.col("c_name").alias("competition_name"))


def parse_json_mapping(df: DataFrame, col: str, value_type: str = "int") -> tuple[DataFrame, DataFrame]:
    """SC35: JSON text → one row per key and value, and the rows that were rejected.

    A key's value may be a list of levels (``pos`` counts them from 0) or a single
    value (``pos`` 0).  Text that is null, no JSON or no object is rejected with a
    ``reject_reason``; an empty object gives no row on either side."""
    text = F.col(col)
    parsed = df.withColumn("__m", F.from_json(text, "map<string,string>"))
    is_object = F.coalesce(F.col("__m").isNotNull() & text.rlike(r"^\s*\{"), F.lit(False))
    value = F.col("value")
    levels = F.when(value.rlike(r"^\s*\["), F.from_json(value, "array<string>")).otherwise(F.array(value))
    rows = (parsed.where(is_object).select("*", F.explode("__m").alias("key", "value"))
            .select(*df.columns, "key", F.posexplode(levels).alias("pos", "value")))
    rejects = parsed.where(~is_object).drop("__m").withColumn(
        "reject_reason", F.when(text.isNull(), "missing").when(text.rlike(r"^\s*\{"), "invalid JSON").otherwise("not an object"))
    return rows.withColumn("value", F.col("value").try_cast(value_type)), rejects


def dedupe_scores(cands: DataFrame, id_col: str = "candidate", score_col: str = "score") -> DataFrame:
    """WIN8: equal scores collapse to one candidate (lowest id)."""
    return cands.groupBy(score_col).agg(F.min(id_col).alias(id_col))


def top_scored(cands: DataFrame, n: int, id_col: str = "candidate", score_col: str = "score") -> DataFrame:
    """TOP3: first n by score (ties → lower id); Spark keeps n rows per task before the merge."""
    return cands.orderBy(F.col(score_col).desc(), F.col(id_col)).limit(n)

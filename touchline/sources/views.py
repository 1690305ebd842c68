"""Derived views the operators run on.

The supplied tables hold no match data, so passes (P), match events (E),
starting line-ups (L), experiment runs (R) and scored passes (S) are derived
from them by deterministic SQL expressions.  The same expression text is used
on the Spark side (``selectExpr``: column-pruned, pushed-down scans) and as
CTEs in the DuckDB oracle, so both engines start from identical rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.session import checkpoint_dir
from touchline.sources.io import write_partitioned
from touchline.sources.tables import read_table

# Hold-out match of the derived pass table.
HOLDOUT_MATCH_ID = 7

# ---- P: passes, from lineitem -------------------------------------------------
P_INNER = [
    "((l_orderkey*8+l_linenumber)*20000+l_partkey)*1000+l_suppkey AS pass_id",
    "l_orderkey % 64 AS match_id",
    "CAST((l_partkey*7919+l_linenumber*104729) % 1201 AS DOUBLE)/1e1 AS start_x",
    "CAST((l_suppkey*6151+l_linenumber*3571) % 801 AS DOUBLE)/1e1 AS start_y",
    "CAST((l_partkey*4409+l_suppkey*193) % 1201 AS DOUBLE)/1e1 AS end_x",
    "CAST((l_orderkey*2803+l_linenumber*617) % 801 AS DOUBLE)/1e1 AS end_y",
    "CASE l_returnflag WHEN 'A' THEN 'Ground Pass' WHEN 'N' THEN 'Low Pass' ELSE 'High Pass' END AS height",
    "CASE WHEN l_quantity < 2 THEN 0e0 ELSE l_quantity/2e1 END AS duration",
    "CASE l_partkey % 8 WHEN 0 THEN 'Right Foot' WHEN 1 THEN 'Left Foot' WHEN 2 THEN 'Head' "
    "WHEN 3 THEN 'Drop Kick' WHEN 4 THEN 'Keeper Arm' WHEN 5 THEN 'Other' "
    "WHEN 6 THEN 'Right Foot' ELSE NULL END AS body_part",
    "CASE WHEN l_suppkey % 5 = 0 THEN TRUE ELSE NULL END AS under_pressure",
    "l_discount AS disc",
]
P_OUTER = [
    "pass_id", "match_id", "start_x", "start_y", "end_x", "end_y",
    "sqrt((end_x-start_x)*(end_x-start_x)+(end_y-start_y)*(end_y-start_y)) AS length",
    "height", "atan2(end_y-start_y, end_x-start_x) AS angle",
    "duration", "body_part", "under_pressure",
    "CASE WHEN disc >= 9e-2 OR (disc >= 3e-2 AND (end_x-start_x)*(end_x-start_x)"
    "+(end_y-start_y)*(end_y-start_y) > 49e2) THEN 'Incomplete' ELSE NULL END AS outcome",
]
P_SQL = (f"SELECT {', '.join(P_OUTER)} FROM (SELECT {', '.join(P_INNER)} "
         f"FROM lineitem) t")

# ---- E: match events, from events ----------------------------------------------
E_INNER = [
    "event_id", "user_id", "value",
    "CASE event_type WHEN 'click' THEN 'Pass' WHEN 'view' THEN 'Carry' WHEN 'error' THEN 'Dribble' "
    "WHEN 'purchase' THEN 'Shot' ELSE 'Ball Receipt' END AS type",
    "CASE WHEN event_id % 17 <> 0 THEN CAST((event_id*37) % 1201 AS DOUBLE)/1e1 END AS loc_x",
    "CASE WHEN event_id % 17 <> 0 THEN CAST((user_id*53+event_id*7) % 801 AS DOUBLE)/1e1 END AS loc_y",
]
E_OUTER = [
    "event_id", "event_id % 8 AS match_id", "event_id AS index",
    "CASE WHEN user_id % 2 = 0 THEN 'Home' ELSE 'Away' END AS team", "user_id AS player_id", "type",
    "loc_x", "loc_y",
    "CASE WHEN type='Pass' AND event_id % 19 <> 0 THEN CAST((event_id*61) % 1201 AS DOUBLE)/1e1 END AS pass_end_x",
    "CASE WHEN type='Pass' AND event_id % 19 <> 0 THEN CAST((event_id*43) % 801 AS DOUBLE)/1e1 END AS pass_end_y",
    "CASE WHEN type='Carry' AND event_id % 23 <> 0 THEN CAST((event_id*71) % 1201 AS DOUBLE)/1e1 END AS carry_end_x",
    "CASE WHEN type='Carry' AND event_id % 23 <> 0 THEN CAST((event_id*29) % 801 AS DOUBLE)/1e1 END AS carry_end_y",
    "CASE WHEN type='Dribble' THEN CASE event_id % 3 WHEN 0 THEN 'Complete' WHEN 1 THEN 'Incomplete' END END "
    "AS dribble_outcome",
    "CASE WHEN type='Shot' THEN CASE event_id % 5 WHEN 0 THEN 'Goal' WHEN 1 THEN 'Saved' WHEN 2 THEN 'Off T' "
    "WHEN 3 THEN 'Blocked' END END AS shot_outcome",
    "CASE WHEN type='Shot' THEN least(value/5e2, 99e-2) END AS shot_xg",
    "CASE WHEN type='Pass' THEN CASE event_id % 3 WHEN 0 THEN 'Ground Pass' WHEN 1 THEN 'Low Pass' ELSE 'High Pass' END "
    "END AS pass_height",
    "CASE WHEN event_id % 13 <> 0 THEN value/1e2 END AS duration",
    "CASE WHEN type='Pass' THEN CASE event_id % 5 WHEN 0 THEN 'Right Foot' WHEN 1 THEN 'Left Foot' WHEN 2 THEN 'Head' END "
    "END AS pass_body_part",
    "CASE WHEN user_id % 5 = 0 THEN TRUE END AS under_pressure",
    "CASE WHEN type='Pass' AND event_id % 4 = 0 THEN 'Incomplete' END AS pass_outcome",
]
E_SQL = (f"SELECT {', '.join(E_OUTER)} FROM (SELECT {', '.join(E_INNER)} "
         f"FROM events) t")

# ---- L: starting line-ups (up to 11 lowest player ids per team and match) -------
LINEUP_SIZE = 11
L_SQL = (
    "SELECT match_id, team, player_id, player_id + 1 AS jersey_number, "
    "concat('Player ', CAST(player_id AS VARCHAR(20))) AS player_name "
    "FROM (SELECT match_id, team, player_id, row_number() OVER (PARTITION BY match_id, team "
    "ORDER BY player_id) AS rn FROM (SELECT DISTINCT match_id, team, player_id FROM match_events) d) r "
    "WHERE rn <= 11")

# ---- R: experiment runs, from orders ----------------------------------------------
R_COLS = [
    "CAST(o_orderkey AS STRING) AS run_id",
    "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderkey - o_orderkey % 50 AS STRING) END "
    "AS parent_run_id",
    "CASE o_orderkey % 7 WHEN 6 THEN NULL ELSE CASE o_orderkey % 3 WHEN 0 THEN 'lightgbm' "
    "WHEN 1 THEN 'xgboost' ELSE 'catboost' END END AS model_type",
    "CASE o_orderstatus WHEN 'F' THEN 'True' WHEN 'O' THEN 'true' ELSE 'False' END AS feature_engineering",
    "CASE WHEN o_orderpriority = '5-LOW' THEN 'OHE' ELSE 'native' END AS categorical_handling",
    "CASE WHEN o_orderpriority = '1-URGENT' THEN 'True' ELSE 'False' END AS openfe",
    "CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') AND o_custkey % 2 = 0 THEN 'True' "
    "WHEN o_custkey % 11 = 0 THEN NULL ELSE 'False' END AS hyperparameter_tuning",
    "CASE o_orderpriority WHEN '2-HIGH' THEN 'start_x,angle,ofe_col_1' WHEN '3-MEDIUM' THEN NULL "
    "ELSE 'start_x,angle' END AS selected_features",
    "CASE WHEN o_orderkey % 101 = 0 THEN 'n/a' ELSE CAST(o_totalprice/1e6 AS STRING) END AS log_loss",
    "o_orderdate AS start_time", "o_custkey % 4000 AS seconds",
    "CAST(o_orderdate AS STRING) AS start_text",
]
# end_text: start_time + seconds, written as text; every 97th run is unparsable.
R_END_SPARK = ("CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE "
               "CAST(timestampadd(SECOND, o_custkey % 4000, o_orderdate) AS STRING) END AS end_text")
R_END_DUCK = ("CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE "
              "CAST(o_orderdate + to_seconds(o_custkey % 4000) AS VARCHAR) END AS end_text")
R_SQL = (f"SELECT {', '.join(c.replace('AS STRING', 'AS VARCHAR') for c in R_COLS)}, {R_END_DUCK} "
         f"FROM orders")

# ---- S: scored passes, from P -----------------------------------------------------
S_INNER = [
    "pass_id", "match_id", "CASE WHEN outcome IS NULL THEN 1 ELSE 0 END AS y",
    "CAST(floor(1e3*(2e-2+96e-2/(1e0+length/4e1))) AS DOUBLE)/1e3 AS p",
]
S_OUTER = ["pass_id", "match_id", "y", "p", "CASE WHEN p >= 5e-1 THEN 1 ELSE 0 END AS prediction"]
S_SQL = f"SELECT {', '.join(S_OUTER)} FROM (SELECT {', '.join(S_INNER)} FROM passes) t"

_VIEW_SQL = {"passes": P_SQL, "match_events": E_SQL, "lineups": L_SQL, "runs": R_SQL,
             "scored": S_SQL}
_VIEW_DEPS = {"lineups": ["match_events"], "scored": ["passes"]}


def with_views(sql: str, *views: str) -> str:
    """Prefix an oracle query with the CTEs of the derived views it uses."""
    order: list[str] = []

    def add(v):
        for d in _VIEW_DEPS.get(v, []):
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    if not order:
        return sql
    ctes = ",\n".join(f"{v} AS ({_VIEW_SQL[v]})" for v in order)
    body = sql.lstrip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{sql}"


# ---- Spark builders ---------------------------------------------------------------
#
# The derived views are long expression chains over the raw tables.  Like the
# reference, which extracts its pass table once and then reads parquet, each
# view is materialised once per session into the shared checkpoint folder
# (passes partitioned by match, so hold-out filters prune files) and read back
# with an explicit schema.  ``touchline.views.materialize=false`` keeps them as
# pure lazy projections instead.

MATERIALIZE_CONF = "touchline.views.materialize"
_MATERIALIZED: dict = {}


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _fingerprint(spark: SparkSession, df: DataFrame) -> str:
    """Names, sizes and change times of the files behind ``df`` and the plan's text:
    a source that grew or a changed definition gets a view of its own."""
    files = sorted(df.inputFiles())
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marks = []
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        marks.append(f"{f}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.md5("\n".join([*marks, *df.columns]).encode()).hexdigest()[:16]


def _materialized(spark: SparkSession, sf_dir: str, name: str, build, partition_by: str | None) -> DataFrame:
    df = build()
    if spark.conf.get(MATERIALIZE_CONF, "true").lower() != "true":
        return df
    key = (spark.sparkContext.applicationId, name, _fingerprint(spark, df))
    path = _MATERIALIZED.get(key)
    if path is None or not _fs_exists(spark, f"{path}/_SUCCESS"):
        path = f"{checkpoint_dir(spark)}/views/{name}-{key[2]}"
        if not _fs_exists(spark, f"{path}/_SUCCESS"):
            write_partitioned(df, path, partition_by)
        _MATERIALIZED[key] = path
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P: one row per pass (pass_id unique at sf>=0.01)."""
    return _materialized(spark, sf_dir, "passes", lambda: passes_lazy(spark, sf_dir), "match_id")


def passes_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").selectExpr(*P_INNER).selectExpr(*P_OUTER)


def match_events_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E with flat coordinates (same columns as the oracle view)."""
    return _materialized(spark, sf_dir, "match_events", lambda: match_events_lazy(spark, sf_dir), None)


def match_events_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").selectExpr(*E_INNER).selectExpr(*E_OUTER)


def _pair(x: str, y: str):
    return F.when(F.col(x).isNotNull() & F.col(y).isNotNull(),
                  F.array(F.col(x), F.col(y)))


def match_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E as the event feed shapes it: coordinates packed into ``array<double>``."""
    flat = match_events_flat(spark, sf_dir)
    return flat.select(
        "event_id", "match_id", "index", "team", "player_id", "type",
        _pair("loc_x", "loc_y").alias("location"),
        _pair("pass_end_x", "pass_end_y").alias("pass_end_location"),
        _pair("carry_end_x", "carry_end_y").alias("carry_end_location"),
        "dribble_outcome", "shot_outcome", F.col("shot_xg").alias("shot_statsbomb_xg"),
        "pass_height", "duration", "pass_body_part", "under_pressure", "pass_outcome",
    )


def starting_xi_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two "Starting XI" events per match (Home first), each with a nested line-up.

    The top-11 filter is a ``row_number() <= 11`` window, which Spark plans with a
    partial per-task group limit before the shuffle, so a huge team group never
    reaches one task whole.  The collected line-up is bounded by 11 entries.
    """
    from pyspark.sql import Window
    ev = match_events_flat(spark, sf_dir)
    players = ev.select("match_id", "team", "player_id").distinct()
    w = Window.partitionBy("match_id", "team").orderBy("player_id")
    top = players.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= LINEUP_SIZE)
    entry = F.struct(
        (F.col("player_id") + 1).alias("jersey_number"),
        F.struct(F.col("player_id").alias("id"),
                 F.concat(F.lit("Player "), F.col("player_id").cast("string")).alias("name"))
        .alias("player"),
        F.col("rn").alias("position_order"),
    )
    grouped = top.groupBy("match_id", "team").agg(
        F.array_sort(F.collect_list(entry)).alias("lineup"))
    return grouped.select(
        "match_id",
        F.when(F.col("team") == "Home", F.lit(0)).otherwise(F.lit(1)).alias("index"),
        F.lit("Starting XI").alias("type"), "team",
        F.struct(F.col("lineup")).alias("tactics"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R: experiment-run table with string tags, text timestamps and a text metric."""
    return _materialized(spark, sf_dir, "runs",
                         lambda: read_table(spark, sf_dir, "orders").selectExpr(*R_COLS, R_END_SPARK), None)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S: label y and a probability p with many ties."""
    return _materialized(spark, sf_dir, "scored",
                         lambda: passes(spark, sf_dir).selectExpr(*S_INNER).selectExpr(*S_OUTER), "match_id")

"""Pass-table operators: preprocessing, geometry, splits, payloads, validation.

Everything here is a projection or a filter: narrow, codegen'd, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import scalar as S
from touchline.sources.tables import require_columns
from touchline.sources.views import HOLDOUT_MATCH_ID

# Scoring-request vocabulary.
HEIGHTS = ["Ground Pass", "Low Pass", "High Pass"]
BODY_PARTS = ["Right Foot", "Left Foot", "Head", "Drop Kick", "Keeper Arm", "No Touch", "Other"]
# Labels the drawing UI sends; "Keeper Arm" and "Drop Kick" fall back to "Other".
UI_BODY_PART = {"Right Foot": "Right Foot", "Left Foot": "Left Foot", "Head": "Head",
                "No Touch": "No Touch", "Other": "Other"}
UI_HEIGHT = {"Ground Pass": "Ground Pass", "Low Pass": "Low Pass", "High Pass": "High Pass"}

PASS_COLUMNS = ["match_id", "start_x", "start_y", "end_x", "end_y", "length", "height",
                "angle", "duration", "body_part", "under_pressure", "outcome"]

GEOMETRY_COLUMNS = ["log_velocity", "angle_sin", "angle_cos", "start_distance_to_goal",
                    "end_distance_to_goal", "progressive_distance", "direction_to_goal",
                    "direction_to_goal_cos", "duration_x_under_pressure",
                    "log_velocity_x_under_pressure", "length_x_under_pressure"]


def preprocess_passes(df: DataFrame) -> DataFrame:
    """SC25/SC26: body_part null → 'Unknown'; under_pressure null → false → 0/1;
    outcome → 1 when completed (null outcome) else 0."""
    return df.withColumns({
        "body_part": F.coalesce(F.col("body_part"), F.lit("Unknown")),
        "under_pressure": F.coalesce(F.col("under_pressure").cast("boolean"), F.lit(False)).cast("long"),
        "outcome": F.when(F.col("outcome").isNull(), F.lit(1)).otherwise(F.lit(0)),
    })


def pass_geometry(df: DataFrame) -> DataFrame:
    """SC12–SC20 on a preprocessed pass table: metres, log velocity, angle parts,
    distances to goal, progressive distance, direction to goal, interactions."""
    length_m = F.col("length") * F.lit(S.YARDS_TO_METRES)
    d = df.withColumn("length", length_m)
    lv = S.log_velocity("length", "duration")
    sd = S.distance_to_goal("start_x", "start_y")
    ed = S.distance_to_goal("end_x", "end_y")
    dtg = F.col("angle") - S.goal_angle("start_x", "start_y")
    up = F.col("under_pressure").cast("double")
    return d.withColumns({
        "log_velocity": lv,
        "angle_sin": F.sin("angle"),
        "angle_cos": F.cos("angle"),
        "start_distance_to_goal": sd,
        "end_distance_to_goal": ed,
        "progressive_distance": sd - ed,
        "direction_to_goal": dtg,
        "direction_to_goal_cos": F.cos(dtg),
        "duration_x_under_pressure": F.col("duration") * up,
        "log_velocity_x_under_pressure": lv * up,
        "length_x_under_pressure": F.col("length") * up,
    })


def log_velocity_raw(df: DataFrame) -> DataFrame:
    """SC14: velocity from the raw (yards) length; zero duration → 0."""
    return df.withColumn("log_velocity", S.log_velocity_raw("length", "duration"))


def log_columns(df: DataFrame, cols=("length", "duration")) -> DataFrame:
    """SC15: log1p of the given columns, as ``log_<col>``."""
    return df.withColumns({f"log_{c}": F.log1p(F.col(c)) for c in cols})


def pass_deltas(df: DataFrame) -> DataFrame:
    """SC21: dx, dy; the four coordinates are dropped."""
    return df.withColumns({"dx": F.col("end_x") - F.col("start_x"),
                           "dy": F.col("end_y") - F.col("start_y")}) \
        .drop("start_x", "start_y", "end_x", "end_y")


def invert_orientation(df: DataFrame, x_cols=("start_x", "end_x"), y_cols=("start_y", "end_y")) -> DataFrame:
    """SC22: mirror coordinates, (120 − x, 80 − y); pass only x or y columns for one axis."""
    return df.withColumns({**{c: S.invert_x(c) for c in x_cols}, **{c: S.invert_y(c) for c in y_cols}})


def holdout_split(df: DataFrame, holdout: int = HOLDOUT_MATCH_ID) -> tuple[DataFrame, DataFrame]:
    """FLT5: train = other matches, test = hold-out match; match_id dropped; null ids in neither.
    Both sides are filters over the same scan (partition-pruned when stored by match_id)."""
    train = df.where(F.col("match_id") != F.lit(holdout)).drop("match_id")
    test = df.where(F.col("match_id") == F.lit(holdout)).drop("match_id")
    return train, test


def labelled_split(df: DataFrame, holdout: int = HOLDOUT_MATCH_ID) -> DataFrame:
    """Both sides of FLT5 in one frame with a ``split`` column (train/test)."""
    return df.where(F.col("match_id").isNotNull()).withColumn(
        "split", F.when(F.col("match_id") == F.lit(holdout), F.lit("test")).otherwise(F.lit("train")))


def select_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """FLT12: projection by a runtime list with the missing-column error."""
    require_columns(df, features)
    return df.select(*keep, *features)


def feature_aliases(df: DataFrame, formulas: list[str], prefix: str = "autoFE_f_") -> DataFrame:
    """FLT13: copy each formula column to ``<prefix><i>`` when that name is absent."""
    add = {f"{prefix}{i}": F.col(f"`{f}`") for i, f in enumerate(formulas)
           if f"{prefix}{i}" not in df.columns and f in df.columns}
    return df.withColumns(add) if add else df


def rename_all(df: DataFrame, prefix: str = "autoFE-") -> DataFrame:
    """FLT14: rename every column to ``<prefix><i>``."""
    return df.toDF(*[f"{prefix}{i}" for i in range(len(df.columns))])


def validate_requests(df: DataFrame) -> DataFrame:
    """FLT15: predicate columns ``is_valid`` and ``reject_reason`` (first failing
    rule); rows are split on them, never failing the job."""
    num = ["start_x", "start_y", "end_x", "end_y", "length", "angle", "duration"]
    rules = [(F.col(c).isNull(), F.lit(f"missing {c}")) for c in num]
    rules += [
        (F.col("height").isNull() | ~F.col("height").isin(*HEIGHTS), F.lit("invalid height")),
        (F.col("body_part").isNull() | ~F.col("body_part").isin(*BODY_PARTS), F.lit("invalid body_part")),
        (F.col("under_pressure").isNull() | ~F.col("under_pressure").isin(0, 1),
         F.lit("invalid under_pressure")),
    ]
    reason = None
    for cond, msg in reversed(rules):
        reason = F.when(cond, msg) if reason is None else F.when(cond, msg).otherwise(reason)
    return df.withColumn("reject_reason", reason).withColumn("is_valid", F.col("reject_reason").isNull())


def build_payloads(df: DataFrame, body_map: dict | None = None, height_map: dict | None = None) -> DataFrame:
    """FLT18: request payload as the drawing UI builds it: Euclidean length,
    ``atan2(dy, dx)`` angle, label maps with defaults, boolean pressure → 0/1."""
    body_map = UI_BODY_PART if body_map is None else body_map
    height_map = UI_HEIGHT if height_map is None else height_map
    bm = F.create_map(*[F.lit(x) for kv in body_map.items() for x in kv])
    hm = F.create_map(*[F.lit(x) for kv in height_map.items() for x in kv])
    return df.select(
        "start_x", "start_y", "end_x", "end_y",
        S.euclid("start_x", "start_y", "end_x", "end_y").alias("length"),
        F.atan2(F.col("end_y") - F.col("start_y"), F.col("end_x") - F.col("start_x")).alias("angle"),
        "duration",
        F.coalesce(F.try_element_at(hm, F.col("height")), F.lit("Ground Pass")).alias("height"),
        F.coalesce(F.try_element_at(bm, F.col("body_part")), F.lit("Other")).alias("body_part"),
        F.when(F.coalesce(F.col("under_pressure"), F.lit(False)), F.lit(1)).otherwise(F.lit(0))
        .alias("under_pressure"),
    )


def sequence_filter(df: DataFrame, starts: list[tuple[float, float]]) -> DataFrame:
    """FLT11: passes starting at any of the given (x, y) points."""
    cond = None
    for x, y in starts:
        c = (F.col("start_x") == F.lit(float(x))) & (F.col("start_y") == F.lit(float(y)))
        cond = c if cond is None else (cond | c)
    return df.where(cond)


def grid_occupancy(df: DataFrame, x: str = "start_x", y: str = "start_y") -> DataFrame:
    """AGG31: rows per 16 x 12 pitch cell (partial aggregation map-side)."""
    cx, cy = S.grid_cell(x, y)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()) \
        .groupBy(cx.alias("cell_x"), cy.alias("cell_y")).agg(F.count(F.lit(1)).alias("n"))


def extract_passes(events: DataFrame) -> DataFrame:
    """SRC5/FLT8: the twelve columns of the pass table (and the event's id) from the
    nested event feed, one select, no loop."""
    p = events.where((F.col("type") == "Pass") & F.col("location").isNotNull()
                     & F.col("pass_end_location").isNotNull())
    sx, sy = F.col("location")[0], F.col("location")[1]
    ex, ey = F.col("pass_end_location")[0], F.col("pass_end_location")[1]
    return p.select(
        "event_id", "match_id", sx.alias("start_x"), sy.alias("start_y"),
        ex.alias("end_x"), ey.alias("end_y"),
        F.sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)).alias("length"),
        F.col("pass_height").alias("height"), F.atan2(ey - sy, ex - sx).alias("angle"), "duration",
        F.col("pass_body_part").alias("body_part"), "under_pressure", F.col("pass_outcome").alias("outcome"))


def sample_head(df: DataFrame, order_col: str, n: int = 10) -> DataFrame:
    """TOP8: first n rows in an explicit order (a top-k: Spark keeps n per task)."""
    return df.orderBy(order_col).limit(n)


"""Queries over the pass view P: preprocessing, geometry, splits, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import passes as PS
from touchline.operators.formula import FormulaEncoder
from touchline.plans.registry import register
from touchline.plans.sqlfrag import GEO_SQL, PRE_SQL
from touchline.sources import views as V

GEO_OUT = ["length", "log_velocity", "angle_sin", "angle_cos", "start_distance_to_goal",
           "end_distance_to_goal", "progressive_distance", "direction_to_goal",
           "direction_to_goal_cos", "duration_x_under_pressure",
           "log_velocity_x_under_pressure", "length_x_under_pressure"]


def geometry(spark, sf):
    return PS.pass_geometry(PS.preprocess_passes(V.passes(spark, sf)))


# ---- flagship: grouped mean learned on training matches, applied everywhere ------------
FLAGSHIP_FORMULA = "GroupByThenMean(direction_to_goal_cos,height)"


@register("fitted_groupby_then_mean", views=("passes",),
          dbl=("direction_to_goal_cos", "mean_direction_to_goal_cos_by_height"),
          oracle=f"""
WITH g AS ({GEO_SQL}),
m AS (SELECT height, avg(direction_to_goal_cos) AS v FROM g WHERE match_id <> 7 AND height IS NOT NULL
      GROUP BY height)
SELECT g.pass_id, CASE WHEN g.match_id = 7 THEN 'test' ELSE 'train' END AS split, g.height,
       g.direction_to_goal_cos, m.v AS mean_direction_to_goal_cos_by_height
FROM g LEFT JOIN m ON g.height = m.height""")
def q_fitted_groupby_then_mean(spark, sf):
    """Mean direction-to-goal (cos) by pass height learned on the training matches,
    applied to train and hold-out rows (run 7 of the reference's feature study)."""
    g = PS.labelled_split(geometry(spark, sf))
    enc = FormulaEncoder([FLAGSHIP_FORMULA],
                         names={FLAGSHIP_FORMULA: "mean_direction_to_goal_cos_by_height"})
    fitted = enc.fit_materialized(g.where(F.col("split") == "train"))
    return fitted.transform(g).select("pass_id", "split", "height", "direction_to_goal_cos",
                                      "mean_direction_to_goal_cos_by_height")


@register("scan_passes", "SELECT * FROM passes", views=("passes",), dbl=("length", "angle"))
def q_scan_passes(spark, sf):
    return V.passes(spark, sf)


@register("preprocess_passes", PRE_SQL, views=("passes",), dbl=("length", "angle"))
def q_preprocess_passes(spark, sf):
    return PS.preprocess_passes(V.passes(spark, sf))


@register("pass_geometry", f"SELECT pass_id, {', '.join(GEO_OUT)} FROM ({GEO_SQL}) g",
          views=("passes",), dbl=tuple(GEO_OUT))
def q_pass_geometry(spark, sf):
    return geometry(spark, sf).select("pass_id", *GEO_OUT)


@register("log_velocity_raw",
          "SELECT pass_id, ln(1.0 + CASE WHEN duration <> 0 THEN length/duration ELSE 0.0 END) "
          "AS log_velocity FROM passes", views=("passes",), dbl=("log_velocity",))
def q_log_velocity_raw(spark, sf):
    return PS.log_velocity_raw(V.passes(spark, sf)).select("pass_id", "log_velocity")


@register("log_columns", "SELECT pass_id, ln(1.0 + length) AS log_length, ln(1.0 + duration) AS log_duration "
          "FROM passes", views=("passes",), dbl=("log_length", "log_duration"))
def q_log_columns(spark, sf):
    return PS.log_columns(V.passes(spark, sf)).select("pass_id", "log_length", "log_duration")


@register("pass_deltas", "SELECT pass_id, end_x - start_x AS dx, end_y - start_y AS dy, length FROM passes",
          views=("passes",), dbl=("dx", "dy", "length"))
def q_pass_deltas(spark, sf):
    return PS.pass_deltas(V.passes(spark, sf)).select("pass_id", "dx", "dy", "length")


@register("invert_orientation",
          "SELECT pass_id, 120.0 - start_x AS start_x, 80.0 - start_y AS start_y, 120.0 - end_x AS end_x, "
          "80.0 - end_y AS end_y FROM passes", views=("passes",),
          dbl=("start_x", "start_y", "end_x", "end_y"))
def q_invert_orientation(spark, sf):
    return PS.invert_orientation(V.passes(spark, sf)).select("pass_id", "start_x", "start_y", "end_x", "end_y")


@register("holdout_split",
          "SELECT pass_id, CASE WHEN match_id = 7 THEN 'test' ELSE 'train' END AS split, start_x, outcome "
          "FROM passes WHERE match_id IS NOT NULL", views=("passes",))
def q_holdout_split(spark, sf):
    train, test = PS.holdout_split(V.passes(spark, sf))
    return (train.select("pass_id", F.lit("train").alias("split"), "start_x", "outcome")
            .unionByName(test.select("pass_id", F.lit("test").alias("split"), "start_x", "outcome")))


# Parameters: three build-up start points (x, y) present in the derived pass table.
SEQUENCE_STARTS = [(31.0, 3.2), (28.7, 4.9), (74.4, 27.8)]


@register("sequence_filter",
          "SELECT pass_id, start_x, start_y, end_x, end_y FROM passes WHERE (start_x = 31.0 AND start_y = 3.2) "
          "OR (start_x = 28.7 AND start_y = 4.9) OR (start_x = 74.4 AND start_y = 27.8)", views=("passes",))
def q_sequence_filter(spark, sf):
    return PS.sequence_filter(V.passes(spark, sf), SEQUENCE_STARTS).select(
        "pass_id", "start_x", "start_y", "end_x", "end_y")


SELECTED = ["start_x", "angle", "duration", "height"]


@register("select_features", "SELECT pass_id, start_x, angle, duration, height FROM passes",
          views=("passes",), dbl=("angle",))
def q_select_features(spark, sf):
    return PS.select_features(V.passes(spark, sf), SELECTED, keep=["pass_id"])


@register("feature_aliases",
          "SELECT pass_id, start_x + end_x AS \"(start_x+end_x)\", start_x + end_x AS autoFE_f_0, "
          "abs(start_y - end_y) AS \"abs((start_y-end_y))\", abs(start_y - end_y) AS autoFE_f_1 FROM passes",
          views=("passes",))
def q_feature_aliases(spark, sf):
    from touchline.operators.formula import rowwise_features
    fs = ["(start_x+end_x)", "abs((start_y-end_y))"]
    df = rowwise_features(V.passes(spark, sf).select("pass_id", "start_x", "end_x", "start_y", "end_y"), fs)
    return PS.feature_aliases(df, fs).select("pass_id", *[f"`{f}`" for f in fs], "autoFE_f_0", "autoFE_f_1")


@register("renamed_columns", "SELECT start_x + end_x AS \"autoFE-0\", abs(start_y - end_y) AS \"autoFE-1\" FROM passes",
          views=("passes",))
def q_renamed_columns(spark, sf):
    """FLT14: all columns of a formula frame take numbered names."""
    from touchline.operators.formula import rowwise_features
    fs = ["(start_x+end_x)", "abs((start_y-end_y))"]
    df = rowwise_features(V.passes(spark, sf).select("start_x", "end_x", "start_y", "end_y"), fs)
    return PS.rename_all(df.select(*[f"`{f}`" for f in fs]))


@register("validate_requests", views=("passes",), oracle="""
SELECT pass_id, reject_reason, reject_reason IS NULL AS is_valid FROM (
SELECT pass_id, CASE WHEN start_x IS NULL THEN 'missing start_x' WHEN start_y IS NULL THEN 'missing start_y'
 WHEN end_x IS NULL THEN 'missing end_x' WHEN end_y IS NULL THEN 'missing end_y'
 WHEN length IS NULL THEN 'missing length' WHEN angle IS NULL THEN 'missing angle'
 WHEN duration IS NULL THEN 'missing duration'
 WHEN height IS NULL OR height NOT IN ('Ground Pass','Low Pass','High Pass') THEN 'invalid height'
 WHEN body_part IS NULL OR body_part NOT IN ('Right Foot','Left Foot','Head','Drop Kick','Keeper Arm','No Touch','Other')
   THEN 'invalid body_part'
 WHEN under_pressure IS NULL OR under_pressure NOT IN (0, 1) THEN 'invalid under_pressure' END AS reject_reason
FROM (SELECT pass_id, start_x, start_y, end_x, end_y, length, angle, duration, height, body_part,
      CASE WHEN under_pressure THEN 1 END AS under_pressure FROM passes) r) v""")
def q_validate_requests(spark, sf):
    """Requests as they arrive (under_pressure 1 or missing) checked against the schema."""
    req = V.passes(spark, sf).withColumn("under_pressure", F.when(F.col("under_pressure"), F.lit(1)))
    return PS.validate_requests(req).select("pass_id", "reject_reason", "is_valid")


@register("build_payloads", views=("passes",), dbl=("length", "angle"), oracle="""
SELECT start_x, start_y, end_x, end_y,
  sqrt((end_x-start_x)*(end_x-start_x)+(end_y-start_y)*(end_y-start_y)) AS length,
  atan2(end_y-start_y, end_x-start_x) AS angle, duration,
  coalesce(CASE height WHEN 'Ground Pass' THEN 'Ground Pass' WHEN 'Low Pass' THEN 'Low Pass'
           WHEN 'High Pass' THEN 'High Pass' END, 'Ground Pass') AS height,
  coalesce(CASE body_part WHEN 'Right Foot' THEN 'Right Foot' WHEN 'Left Foot' THEN 'Left Foot' WHEN 'Head' THEN 'Head'
           WHEN 'No Touch' THEN 'No Touch' WHEN 'Other' THEN 'Other' END, 'Other') AS body_part,
  CASE WHEN coalesce(under_pressure, false) THEN 1 ELSE 0 END AS under_pressure
FROM passes""")
def q_build_payloads(spark, sf):
    return PS.build_payloads(V.passes(spark, sf))


@register("sample_head", "SELECT pass_id, match_id, start_x, height FROM passes ORDER BY pass_id LIMIT 10",
          views=("passes",))
def q_sample_head(spark, sf):
    return PS.sample_head(V.passes(spark, sf).select("pass_id", "match_id", "start_x", "height"), "pass_id")


@register("grid_occupancy",
          "SELECT CAST(floor(start_x*16.0/120.0) AS BIGINT) AS cell_x, CAST(floor(start_y*12.0/80.0) AS BIGINT) AS cell_y, "
          "count(*) AS n FROM passes WHERE start_x IS NOT NULL AND start_y IS NOT NULL GROUP BY 1, 2",
          views=("passes",))
def q_grid_occupancy(spark, sf):
    return PS.grid_occupancy(V.passes(spark, sf))

"""SQL text shared by oracles: preprocessed and geometry-enriched passes."""

PRE_SQL = (
    "SELECT pass_id, match_id, start_x, start_y, end_x, end_y, length, height, angle, duration, "
    "coalesce(body_part, 'Unknown') AS body_part, "
    "CAST(coalesce(under_pressure, false) AS BIGINT) AS under_pressure, "
    "CASE WHEN outcome IS NULL THEN 1 ELSE 0 END AS outcome FROM passes")

_GEO_INNER = (
    "SELECT pass_id, match_id, start_x, start_y, end_x, end_y, length*0.9144 AS length, height, angle, "
    "duration, body_part, under_pressure, outcome, "
    "sqrt((start_x-120.0)*(start_x-120.0)+(start_y-40.0)*(start_y-40.0)) AS start_distance_to_goal, "
    "sqrt((end_x-120.0)*(end_x-120.0)+(end_y-40.0)*(end_y-40.0)) AS end_distance_to_goal, "
    "angle - atan2(40.0-start_y, 120.0-start_x) AS direction_to_goal "
    f"FROM ({PRE_SQL}) pre")

GEO_SQL = (
    "SELECT *, ln(1.0 + coalesce(length / nullif(duration, 0.0), 0.0)) AS log_velocity, "
    "sin(angle) AS angle_sin, cos(angle) AS angle_cos, "
    "start_distance_to_goal - end_distance_to_goal AS progressive_distance, "
    "cos(direction_to_goal) AS direction_to_goal_cos, "
    "duration * under_pressure AS duration_x_under_pressure, "
    "ln(1.0 + coalesce(length / nullif(duration, 0.0), 0.0)) * under_pressure AS log_velocity_x_under_pressure, "
    "length * under_pressure AS length_x_under_pressure "
    f"FROM ({_GEO_INNER}) gi")

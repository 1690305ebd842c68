"""Queries over the match-event view E and the line-ups L."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import events as EV
from touchline.plans.registry import register
from touchline.sources import views as V


def ev(spark, sf):
    return V.match_events(spark, sf)


def lineup(spark, sf):
    return EV.starting_xi(V.starting_xi_events(spark, sf))


@register("team_events", "SELECT event_id, match_id, type, loc_x AS x, loc_y AS y FROM match_events "
          "WHERE loc_x IS NOT NULL AND team = 'Home'", views=("match_events",))
def q_team_events(spark, sf):
    return EV.event_xy(EV.team_events(ev(spark, sf), "Home")).select("event_id", "match_id", "type", "x", "y")


@register("events_by_type", "SELECT event_id, match_id, type FROM match_events WHERE type IN ('Pass', 'Carry', 'Shot')",
          views=("match_events",))
def q_events_by_type(spark, sf):
    return EV.events_of_type(ev(spark, sf), "Pass", "Carry", "Shot").select("event_id", "match_id", "type")


@register("complete_dribbles", "SELECT event_id, loc_x AS x, loc_y AS y FROM match_events "
          "WHERE type = 'Dribble' AND dribble_outcome = 'Complete'", views=("match_events",))
def q_complete_dribbles(spark, sf):
    return EV.event_xy(EV.complete_dribbles(ev(spark, sf))).select("event_id", "x", "y")


@register("shot_split", "SELECT event_id, CASE WHEN shot_outcome = 'Goal' THEN 'goal' ELSE 'non_goal' END AS side, "
          "shot_xg AS xg FROM match_events WHERE type = 'Shot' AND shot_outcome IS NOT NULL", views=("match_events",))
def q_shot_split(spark, sf):
    goals, other = EV.shot_split(ev(spark, sf))
    cols = ["event_id", F.col("shot_statsbomb_xg").alias("xg")]
    return goals.select(*cols, F.lit("goal").alias("side")).unionByName(
        other.select(*cols, F.lit("non_goal").alias("side")))


@register("event_xy", "SELECT event_id, loc_x AS x, loc_y AS y FROM match_events WHERE loc_x IS NOT NULL",
          views=("match_events",))
def q_event_xy(spark, sf):
    return EV.event_xy(ev(spark, sf).where(F.col("location").isNotNull())).select("event_id", "x", "y")


POSSESSION_SQL = """
SELECT event_id, match_id, team, kind, x, y FROM (
 SELECT event_id, match_id, team,
   CASE WHEN type = 'Pass' AND loc_x IS NOT NULL AND pass_end_x IS NOT NULL THEN 'pass'
        WHEN type = 'Carry' AND loc_x IS NOT NULL AND carry_end_x IS NOT NULL THEN 'carry'
        WHEN type = 'Dribble' AND dribble_outcome = 'Complete' AND loc_x IS NOT NULL THEN 'dribble' END AS kind,
   CASE WHEN type = 'Pass' THEN pass_end_x WHEN type = 'Carry' THEN carry_end_x ELSE loc_x END AS x,
   CASE WHEN type = 'Pass' THEN pass_end_y WHEN type = 'Carry' THEN carry_end_y ELSE loc_y END AS y
 FROM match_events) t WHERE kind IS NOT NULL"""


@register("possession_points", POSSESSION_SQL, views=("match_events",))
def q_possession_points(spark, sf):
    return EV.possession_points(ev(spark, sf))


@register("starting_xi", "SELECT match_id, CASE WHEN team = 'Home' THEN 0 ELSE 1 END AS team_idx, team, player_id, "
          "jersey_number, player_name FROM lineups", views=("lineups",))
def q_starting_xi(spark, sf):
    return lineup(spark, sf)


@register("starting_xi_events", "SELECT e.event_id, e.match_id, e.team, e.player_id FROM match_events e "
          "WHERE EXISTS (SELECT 1 FROM lineups l WHERE l.match_id = e.match_id AND l.team = e.team "
          "AND l.player_id = e.player_id)", views=("match_events", "lineups"))
def q_starting_xi_events(spark, sf):
    return EV.starting_players_events(ev(spark, sf), lineup(spark, sf)) \
        .select("event_id", "match_id", "team", "player_id")


AVG_SQL = ("SELECT e.match_id, e.team, e.player_id, avg(e.loc_x) AS x, avg(e.loc_y) AS y FROM match_events e "
           "WHERE e.loc_x IS NOT NULL AND EXISTS (SELECT 1 FROM lineups l WHERE l.match_id = e.match_id "
           "AND l.team = e.team AND l.player_id = e.player_id) GROUP BY 1, 2, 3")


@register("avg_position", AVG_SQL, views=("match_events", "lineups"), dbl=("x", "y"))
def q_avg_position(spark, sf):
    return EV.avg_position(ev(spark, sf), lineup(spark, sf))


@register("avg_position_lineup", f"SELECT a.*, l.jersey_number, l.player_name FROM ({AVG_SQL}) a LEFT JOIN lineups l "
          "ON a.match_id = l.match_id AND a.team = l.team AND a.player_id = l.player_id",
          views=("match_events", "lineups"), dbl=("x", "y"))
def q_avg_position_lineup(spark, sf):
    return EV.avg_position_lineup(ev(spark, sf), lineup(spark, sf))


@register("shot_xg_summary", "SELECT match_id, team, count(*) AS goals, sum(shot_xg) AS xg_sum, max(shot_xg) AS xg_max "
          "FROM match_events WHERE type = 'Shot' AND shot_outcome = 'Goal' GROUP BY 1, 2",
          views=("match_events",), dbl=("xg_sum", "xg_max"))
def q_shot_xg_summary(spark, sf):
    return EV.shot_xg_summary(ev(spark, sf))


@register("read_events_json", "SELECT event_id, match_id, type, team, loc_x AS x, loc_y AS y, shot_xg FROM match_events",
          views=("match_events",))
def q_read_events_json(spark, sf):
    """SRC1: the event feed as JSON files on storage, read with an explicit schema."""
    from touchline.sources.io import EVENT_SCHEMA, read_events_json, write_events_json
    path = write_events_json(ev(spark, sf), spark, "events_json")
    e = read_events_json(spark, path, EVENT_SCHEMA)
    return e.select("event_id", "match_id", "type", "team", F.col("location")[0].alias("x"),
                    F.col("location")[1].alias("y"), F.col("shot_statsbomb_xg").alias("shot_xg"))


@register("extract_passes", "SELECT event_id, match_id, loc_x AS start_x, loc_y AS start_y, pass_end_x AS end_x, "
          "pass_end_y AS end_y, sqrt((pass_end_x-loc_x)*(pass_end_x-loc_x)+(pass_end_y-loc_y)*(pass_end_y-loc_y)) "
          "AS length, pass_height AS height, atan2(pass_end_y-loc_y, pass_end_x-loc_x) AS angle, duration, "
          "pass_body_part AS body_part, under_pressure, pass_outcome AS outcome FROM match_events "
          "WHERE type = 'Pass' AND loc_x IS NOT NULL AND pass_end_x IS NOT NULL",
          views=("match_events",), dbl=("length", "angle"))
def q_extract_passes(spark, sf):
    from touchline.operators.passes import extract_passes
    return extract_passes(ev(spark, sf))

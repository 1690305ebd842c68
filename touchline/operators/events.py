"""Match-event operators: team and type filters, coordinates, line-ups,
average positions, shots/xG and possession points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions import scalar as S

POSSESSION_KINDS = ("pass", "carry", "dribble")


def team_events(events: DataFrame, team: str) -> DataFrame:
    """FLT1: events with a location for one team."""
    return events.where(F.col("location").isNotNull() & (F.col("team") == F.lit(team)))


def events_of_type(events: DataFrame, *types: str) -> DataFrame:
    """FLT2: event-type filter."""
    return events.where(F.col("type").isin(*types))


def complete_dribbles(events: DataFrame) -> DataFrame:
    """FLT3: completed dribbles, location kept."""
    return events.where((F.col("type") == "Dribble") & (F.col("dribble_outcome") == "Complete")) \
        .select("event_id", "location")


def shot_split(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT4: goals and non-goals; a shot with a null outcome is in neither."""
    shots = events.where(F.col("type") == "Shot")
    return (shots.where(F.col("shot_outcome") == "Goal"),
            shots.where(F.col("shot_outcome") != "Goal"))


def event_xy(events: DataFrame, loc: str = "location") -> DataFrame:
    """FLT7: array location → x, y."""
    return events.withColumns({"x": F.col(loc)[0], "y": F.col(loc)[1]})


def possession_points(events: DataFrame, team: str | None = None, invert: bool = False,
                      kinds=POSSESSION_KINDS) -> DataFrame:
    """FLT6 + SET2: end points of passes and carries (start and end present) and
    locations of completed dribbles, in one scan with a CASE on the type.
    An unknown kind is an error."""
    bad = [k for k in kinds if k not in POSSESSION_KINDS]
    if bad:
        raise ValueError(f"Unsupported event type(s) {bad}; use pass, carry or dribble")
    e = events if team is None else events.where(F.col("team") == F.lit(team))
    kind = (F.when((F.col("type") == "Pass") & F.col("location").isNotNull()
                   & F.col("pass_end_location").isNotNull(), F.lit("pass"))
            .when((F.col("type") == "Carry") & F.col("location").isNotNull()
                  & F.col("carry_end_location").isNotNull(), F.lit("carry"))
            .when((F.col("type") == "Dribble") & (F.col("dribble_outcome") == "Complete")
                  & F.col("location").isNotNull(), F.lit("dribble")))
    pt = (F.when(kind == "pass", F.col("pass_end_location"))
          .when(kind == "carry", F.col("carry_end_location"))
          .otherwise(F.col("location")))
    out = e.select("event_id", "match_id", "team", kind.alias("kind"), pt.alias("__pt")) \
        .where(F.col("kind").isin(*kinds))
    x, y = F.col("__pt")[0], F.col("__pt")[1]
    if invert:
        x, y = S.invert_x(x), S.invert_y(y)
    return out.select("event_id", "match_id", "team", "kind", x.alias("x"), y.alias("y"))


def starting_xi(xi_events: DataFrame) -> DataFrame:
    """WIN3 + SC36: explode the line-up of the "Starting XI" events; team index
    0 for the first such event of the match (by event index), 1 otherwise.
    The window holds two rows per match."""
    xi = xi_events.where(F.col("type") == "Starting XI")
    w = Window.partitionBy("match_id").orderBy("index")
    xi = xi.withColumn("team_idx", F.row_number().over(w) - 1)
    ex = xi.select("match_id", "team_idx", "team", F.explode("tactics.lineup").alias("p"))
    return ex.select("match_id", F.when(F.col("team_idx") == 0, 0).otherwise(1).alias("team_idx"), "team",
                     F.col("p.player.id").alias("player_id"), F.col("p.jersey_number").alias("jersey_number"),
                     F.col("p.player.name").alias("player_name"))


def starting_players_events(events: DataFrame, lineup: DataFrame) -> DataFrame:
    """JN2: events of starting players only (left-semi join; the line-up side is
    at most 11 rows per team and match)."""
    return events.join(lineup.select("match_id", "team", "player_id"), ["match_id", "team", "player_id"],
                       "left_semi")


def avg_position(events: DataFrame, lineup: DataFrame, team: str | None = None) -> DataFrame:
    """AGG1: mean x, y per starting player (per match and team)."""
    e = events.where(F.col("location").isNotNull())
    if team is not None:
        e = e.where(F.col("team") == F.lit(team))
    e = starting_players_events(e, lineup)
    return e.groupBy("match_id", "team", "player_id").agg(
        F.avg(F.col("location")[0]).alias("x"), F.avg(F.col("location")[1]).alias("y"))


def avg_position_lineup(events: DataFrame, lineup: DataFrame, team: str | None = None) -> DataFrame:
    """JN1: average positions with jersey number and name (left join)."""
    pos = avg_position(events, lineup, team)
    return pos.join(lineup.select("match_id", "team", "player_id", "jersey_number", "player_name"),
                    ["match_id", "team", "player_id"], "left")


def shot_xg_summary(events: DataFrame) -> DataFrame:
    """AGG30: xG of goals, summed and counted per match and team."""
    goals, _ = shot_split(events)
    return goals.groupBy("match_id", "team").agg(
        F.count(F.lit(1)).alias("goals"), F.sum("shot_statsbomb_xg").alias("xg_sum"),
        F.max("shot_statsbomb_xg").alias("xg_max"))

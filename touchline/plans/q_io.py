"""Source/sink and catalogue queries: matches, competitions, JSON tags, candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import catalog as C
from touchline.plans.registry import register
from touchline.sources import views as V
from touchline.sources.tables import read_table

M_SQL = ("SELECT o_orderkey AS match_id, o_orderdate AS match_date, o_orderpriority AS stage, "
         "o_custkey % 32 AS home_team, (o_custkey + 7) % 32 AS away_team, o_orderstatus AS season FROM orders")


def m(spark, sf):
    return C.matches(read_table(spark, sf, "orders"))


@register("matches_by_season", f"SELECT * FROM ({M_SQL}) m WHERE season = 'F'")
def q_matches_by_season(spark, sf):
    return C.matches_by_season(m(spark, sf), "F")


@register("matches_sorted", f"SELECT * FROM ({M_SQL}) m ORDER BY match_date DESC, match_id")
def q_matches_sorted(spark, sf):
    return C.matches_sorted(m(spark, sf))


@register("match_filter", f"SELECT * FROM ({M_SQL}) m WHERE stage = '1-URGENT' AND (home_team = 5 OR away_team = 5)")
def q_match_filter(spark, sf):
    return C.match_filter(m(spark, sf), "1-URGENT", 5)


@register("union_matches", f"""SELECT match_id, match_date, stage, season FROM ({M_SQL}) m WHERE season = 'F'
UNION ALL SELECT match_id, match_date, NULL AS stage, season FROM ({M_SQL}) m WHERE season = 'O'
UNION ALL SELECT match_id, match_date, stage, season FROM ({M_SQL}) m WHERE season = 'P'""")
def q_union_matches(spark, sf):
    """SET1 with schema drift: the 'O' season frame has no stage column."""
    mm = m(spark, sf).select("match_id", "match_date", "stage", "season")
    return C.union_matches([
        C.matches_by_season(mm, "F"),
        C.matches_by_season(mm, "O").drop("stage"),
        C.matches_by_season(mm, "P")])


@register("competition_filter", "SELECT c_custkey AS competition_id, c_name AS competition_name FROM customer "
          "WHERE c_mktsegment = 'BUILDING' AND (CASE WHEN c_acctbal > 0 THEN c_acctbal END) IS NOT NULL "
          "AND c_nationkey % 2 = 0")
def q_competition_filter(spark, sf):
    return C.competition_filter(read_table(spark, sf, "customer"), "BUILDING")


@register("parse_category_mapping", """SELECT event_id, k AS key, CAST(json_extract_string(props, '$."' || k || '"')
  AS INTEGER) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events
  WHERE json_valid(props)) t""")
def q_parse_category_mapping(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "props")
    return C.parse_json_mapping(ev, "props")[0].select("event_id", "key", "value")


@register("category_mapping_levels", """SELECT p_partkey, 'brand' AS key, CAST(0 AS INTEGER) AS pos, p_brand AS value FROM part
  WHERE p_partkey % 5 < 3 UNION ALL SELECT p_partkey, 'sizes', CAST(0 AS INTEGER), CAST(p_size AS VARCHAR) FROM part WHERE p_partkey % 5 < 3
  UNION ALL SELECT p_partkey, 'sizes', CAST(1 AS INTEGER), p_type FROM part WHERE p_partkey % 5 < 3""")
def q_category_mapping_levels(spark, sf):
    """SC35: a mapping of lists, one row per level; invalid text goes to the rejects."""
    return C.parse_json_mapping(_mappings(spark, sf), "tag", "string")[0].select("p_partkey", "key", "pos", "value")


@register("category_mapping_rejects", """SELECT p_partkey, CASE p_partkey % 5 WHEN 3 THEN 'invalid JSON' ELSE 'missing' END
  AS reject_reason FROM part WHERE p_partkey % 5 >= 3""")
def q_category_mapping_rejects(spark, sf):
    """SC35: the rejected side, with reasons."""
    return C.parse_json_mapping(_mappings(spark, sf), "tag", "string")[1].select("p_partkey", "reject_reason")


def _mappings(spark, sf):
    """A JSON tag per part: a brand and a list; every fifth text is cut off, every fifth missing."""
    p = read_table(spark, sf, "part")
    tag = F.to_json(F.struct(F.col("p_brand").alias("brand"),
                             F.array(F.col("p_size").cast("string"), F.col("p_type")).alias("sizes")))
    kind = F.col("p_partkey") % 5
    return p.select("p_partkey", F.when(kind < 3, tag).when(kind == 3, F.substring(tag, 1, 9)).alias("tag"))


@register("dedupe_scores", "SELECT p_size / 5e1 AS score, min(p_partkey) AS candidate FROM part GROUP BY 1")
def q_dedupe_scores(spark, sf):
    cands = read_table(spark, sf, "part").select(F.col("p_partkey").alias("candidate"),
                                                  (F.col("p_size") / F.lit(50.0)).alias("score"))
    return C.dedupe_scores(cands)


@register("top_features", "SELECT p_partkey AS candidate, p_size / 5e1 AS score FROM part "
          "ORDER BY score DESC, candidate LIMIT 10")
def q_top_features(spark, sf):
    cands = read_table(spark, sf, "part").select(F.col("p_partkey").alias("candidate"),
                                                  (F.col("p_size") / F.lit(50.0)).alias("score"))
    return C.top_scored(cands, 10)


@register("write_read_passes", "SELECT pass_id, match_id, start_x, height, under_pressure, outcome FROM passes",
          views=("passes",))
def q_write_read_passes(spark, sf):
    """SNK1 + SRC4: pass table written partitioned by match, read back with a schema."""
    from touchline.sources.io import read_passes, scratch, write_passes
    path = scratch(spark, "passes")
    write_passes(V.passes(spark, sf), path)
    return read_passes(spark, path).select("pass_id", "match_id", "start_x", "height", "under_pressure", "outcome")

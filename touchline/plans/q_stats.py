"""Statistics, encoder and fold queries over the pass view P."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import encoders as EN
from touchline.operators import folds as FO
from touchline.operators import information as IN
from touchline.operators import stats as ST
from touchline.operators.formula import derive_features
from touchline.operators.passes import preprocess_passes
from touchline.plans.registry import register
from touchline.plans.sqlfrag import PRE_SQL
from touchline.sources import views as V

NUM = ["start_x", "start_y", "end_x", "end_y", "length", "angle", "duration"]


def p(spark, sf):
    return V.passes(spark, sf)


def labelled(spark, sf):
    return p(spark, sf).withColumn("y", F.when(F.col("outcome").isNull(), 1).otherwise(0))


@register("value_shares", "SELECT body_part, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM passes "
          "WHERE body_part IS NOT NULL GROUP BY body_part", views=("passes",), dbl=("share",))
def q_value_shares(spark, sf):
    return ST.value_shares(p(spark, sf), "body_part")


DESCRIBE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
    f"AS null_count, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, "
    f"quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50, quantile_cont({c}, 0.75) AS q75 FROM passes"
    for c in NUM)


@register("describe_numeric", DESCRIBE_SQL, views=("passes",),
          dbl=("mean", "std", "min", "max", "q25", "q50", "q75"))
def q_describe_numeric(spark, sf):
    return ST.describe_numeric(p(spark, sf), NUM)


@register("distinct_values", "SELECT DISTINCT body_part FROM passes", views=("passes",))
def q_distinct_values(spark, sf):
    return ST.distinct_values(p(spark, sf), "body_part")


CORR_COLS = ["start_x", "end_x", "length", "angle", "duration"]
CORR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM passes"
                              for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i:])


@register("correlation_pairs", CORR_SQL, views=("passes",), dbl=("corr",))
def q_correlation_pairs(spark, sf):
    return ST.correlation_pairs(p(spark, sf), CORR_COLS)


def _hist_sql(col, bins_expr, extra_cte=""):
    return f"""WITH v AS (SELECT CAST({col} AS DOUBLE) AS v FROM passes WHERE {col} IS NOT NULL AND NOT isnan({col})),
{extra_cte}
r AS (SELECT min(v) AS lo, max(v) AS hi, {bins_expr} AS nb FROM v{', s' if extra_cte else ''}),
b AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) * nb / (hi - lo)), nb - 1) END AS BIGINT) AS bin,
      lo, hi, nb FROM v, r)
SELECT bin, lo + bin * ((hi - lo) / nb) AS lo, lo + (bin + 1) * ((hi - lo) / nb) AS hi, count(*) AS n,
  CAST(nb AS BIGINT) AS n_bins FROM b GROUP BY bin, b.lo, b.hi, nb"""


@register("histogram_fixed", _hist_sql("length", "20"), views=("passes",), dbl=("lo", "hi"))
def q_histogram_fixed(spark, sf):
    return ST.histogram_fixed(p(spark, sf), "length", 20)


AUTO_CTE = """s AS (SELECT quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, count(*) AS n, min(v) AS mn,
   max(v) AS mx FROM v),"""
AUTO_BINS = ("CASE WHEN max(mx) - max(mn) > 0 THEN CAST(ceil((max(mx) - max(mn)) / CASE WHEN 2.0 * max(iqr) * "
             "pow(max(n), -1.0/3.0) > 0 THEN least(2.0 * max(iqr) * pow(max(n), -1.0/3.0), (max(mx) - max(mn)) / "
             "(log2(max(n)) + 1.0)) ELSE (max(mx) - max(mn)) / (log2(max(n)) + 1.0) END) AS BIGINT) ELSE 1 END")


@register("histogram_auto", _hist_sql("duration", AUTO_BINS, AUTO_CTE), views=("passes",), dbl=("lo", "hi"))
def q_histogram_auto(spark, sf):
    return ST.histogram_auto(p(spark, sf), "duration")


@register("category_counts", "SELECT 'height' AS \"column\", height AS value, count(*) AS n FROM passes "
          "WHERE height IS NOT NULL GROUP BY 2 UNION ALL SELECT 'body_part', body_part, count(*) FROM passes "
          "WHERE body_part IS NOT NULL GROUP BY 2", views=("passes",))
def q_category_counts(spark, sf):
    return ST.category_counts(p(spark, sf), ["height", "body_part"])


def _mi_sql(src):
    return f"""WITH l AS ({src}),
xy AS (SELECT "column", value, y, count(*) AS nxy FROM l WHERE value IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT "column", value, sum(nxy) AS nx FROM xy GROUP BY 1, 2),
yy AS (SELECT "column", y, sum(nxy) AS ny FROM xy GROUP BY 1, 2),
n AS (SELECT "column", sum(nxy) AS n FROM xy GROUP BY 1)
SELECT xy."column", sum((CAST(nxy AS DOUBLE) / n) * ln(CAST(nxy AS DOUBLE) * n / (CAST(nx AS DOUBLE) * ny)))
  AS mutual_info FROM xy JOIN x USING ("column", value) JOIN yy USING ("column", y) JOIN n USING ("column")
GROUP BY 1"""


MI_SRC = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, CASE WHEN outcome IS NULL THEN 1 ELSE 0 END AS y "
    f"FROM passes" for c in ["height", "body_part", "under_pressure"])


@register("mutual_info_discrete", _mi_sql(MI_SRC), views=("passes",), dbl=("mutual_info",))
def q_mutual_info_discrete(spark, sf):
    return ST.mutual_info_discrete(labelled(spark, sf), ["height", "body_part", "under_pressure"], "y")


MI_BIN_COLS = ["length", "end_y", "duration"]
MI_BIN_SRC = " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST((SELECT count(*) FROM e WHERE e.c = '{c}'
  AND e.edge < t.{c}) AS VARCHAR) AS value, CASE WHEN outcome IS NULL THEN 1 ELSE 0 END AS y FROM passes t
  WHERE t.{c} IS NOT NULL""" for c in MI_BIN_COLS)
MI_EDGES = " UNION ALL ".join(f"""SELECT DISTINCT '{c}' AS c, v AS edge FROM (SELECT {c} AS v,
  row_number() OVER (ORDER BY {c}) - 1 AS pos, count(*) OVER () AS n FROM passes WHERE {c} IS NOT NULL) s, range(1, 64) k(k)
  WHERE pos = (k * (n - 1)) // 64""" for c in MI_BIN_COLS)


@register("mutual_info_binned", _mi_sql(MI_BIN_SRC).replace("WITH l AS", f"WITH e AS ({MI_EDGES}), l AS", 1),
          views=("passes",), dbl=("mutual_info",))
def q_mutual_info_binned(spark, sf):
    """AGG21 default: continuous features cut at 63 exact quantile edges, then contingency MI."""
    return ST.mutual_info_binned(labelled(spark, sf), MI_BIN_COLS, "y")


PROFILE_COLS = ["start_x", "length", "end_x", "duration", "under_pressure", "height", "body_part"]
PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, "
    + (f"CASE WHEN '{c}' IN ('height', 'body_part') THEN 'categorical' WHEN count(DISTINCT {c}) <= 100 "
       f"THEN 'ordinal' ELSE 'numerical' END AS kind FROM passes")
    for c in PROFILE_COLS) + (" UNION ALL SELECT 'y', count(DISTINCT y), CASE WHEN count(DISTINCT y) < 20 THEN "
                              "CASE WHEN count(DISTINCT y) > 2 THEN 'multiclass' ELSE 'binary' END ELSE 'regression' "
                              "END FROM (SELECT CASE WHEN outcome IS NULL THEN 1 ELSE 0 END AS y FROM passes) t")


@register("profile_columns", PROFILE_SQL, views=("passes",))
def q_profile_columns(spark, sf):
    return ST.profile_columns(labelled(spark, sf), PROFILE_COLS, label="y", categorical=["height", "body_part"])


@register("init_scores", "SELECT avg(CAST(outcome AS DOUBLE)) AS mean_label, ln(avg(CAST(outcome AS DOUBLE)) / "
          f"(1.0 - avg(CAST(outcome AS DOUBLE)))) AS init_score FROM ({PRE_SQL}) t",
          views=("passes",), dbl=("mean_label", "init_score"))
def q_init_scores(spark, sf):
    return ST.init_scores(preprocess_passes(p(spark, sf)), "outcome")


S1 = {"(length/duration)": "speed", "GroupByThenMean(length,height)": "mean_len_by_height",
      "freq(body_part)": "freq_body"}


@register("stage1_corr", """WITH f AS (SELECT CASE WHEN outcome IS NULL THEN 1 ELSE 0 END AS y,
  CASE WHEN duration <> 0 THEN length / duration END AS speed,
  CASE WHEN height IS NOT NULL THEN avg(length) OVER (PARTITION BY height) END AS mean_len_by_height,
  CASE WHEN body_part IS NOT NULL THEN CAST(count(*) OVER (PARTITION BY body_part) AS DOUBLE) END AS freq_body
  FROM passes)
SELECT 'speed' AS feature, abs(corr(coalesce(speed, 0.0), y)) AS score FROM f
UNION ALL SELECT 'mean_len_by_height', abs(corr(coalesce(mean_len_by_height, 0.0), y)) FROM f
UNION ALL SELECT 'freq_body', abs(corr(coalesce(freq_body, 0.0), y)) FROM f""", views=("passes",), dbl=("score",))
def q_stage1_corr(spark, sf):
    d = derive_features(labelled(spark, sf), list(S1), names=S1, keep=["y"])
    return ST.stage1_corr(d, list(S1.values()), "y")


FOLD_SQL = """WITH c AS (SELECT CASE WHEN outcome IS NULL THEN 1 ELSE 0 END AS y, count(*) AS n FROM passes GROUP BY 1)
SELECT y, CAST(f AS INTEGER) AS fold, CAST((n - f + 4) // 5 AS BIGINT) AS n_rows FROM c, range(5) t(f)
WHERE (n - f + 4) // 5 > 0"""


@register("stratified_folds", FOLD_SQL, views=("passes",))
def q_stratified_folds(spark, sf):
    """WIN5: rows per (label, fold) of a seeded stratified 5-fold assignment."""
    f = FO.stratified_folds(labelled(spark, sf), "pass_id", "y", k=5, seed=42)
    return f.groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n_rows"))


FOLD_ROWS_SQL = """SELECT pass_id, y, CAST((row_number() OVER (PARTITION BY y ORDER BY h, pass_id) - 1) % {k} AS INTEGER) AS fold
  FROM (SELECT pass_id, {label} AS y, CAST('0x' || substr(md5('42:' || pass_id), 1, 15) AS BIGINT) AS h FROM passes{where}) t"""
LABEL_SQL = "CASE WHEN outcome IS NULL THEN 1 ELSE 0 END"


@register("fold_assignment", FOLD_ROWS_SQL.format(k=5, label=LABEL_SQL, where=""), views=("passes",))
def q_fold_assignment(spark, sf):
    """WIN5: the fold of every row."""
    return FO.stratified_folds(labelled(spark, sf), "pass_id", "y", k=5, seed=42).select("pass_id", "y", "fold")


@register("split_assignment", f"""SELECT pass_id, y, CASE WHEN r * 10 < ceil(n / 5.0) * 10 THEN 'test' ELSE 'train' END AS split
  FROM (SELECT pass_id, y, row_number() OVER (PARTITION BY y ORDER BY h, pass_id) - 1 AS r, count(*) OVER (PARTITION BY y) AS n
  FROM (SELECT pass_id, {LABEL_SQL} AS y, CAST('0x' || substr(md5('42:' || pass_id), 1, 15) AS BIGINT) AS h FROM passes) t) u""",
          views=("passes",))
def q_split_assignment(spark, sf):
    """WIN6: the side of every row."""
    return FO.stratified_split(labelled(spark, sf), "pass_id", "y", 2, seed=42).select("pass_id", "y", "split")


@register("block_assignment", """SELECT pass_id, CAST(CASE WHEN r < l THEN 0 WHEN r < 2 * l THEN 1 WHEN r < 4 * l THEN 2 ELSE 3 END AS INTEGER)
  AS block FROM (SELECT pass_id, row_number() OVER (ORDER BY h, pass_id) - 1 AS r, count(*) OVER () // 8 AS l FROM (SELECT pass_id,
  CAST('0x' || substr(md5('42:' || pass_id), 1, 15) AS BIGINT) AS h FROM passes) t) u""", views=("passes",))
def q_block_assignment(spark, sf):
    """WIN7: the nested block of every row."""
    return FO.nested_blocks(p(spark, sf), "pass_id", 8, seed=42).select("pass_id", "block")


@register("stratified_split", """WITH c AS (SELECT CASE WHEN outcome IS NULL THEN 1 ELSE 0 END AS y, count(*) AS n
  FROM passes GROUP BY 1)
SELECT y, 'test' AS split, CAST((n * 2 + 9) // 10 AS BIGINT) AS n_rows FROM c
UNION ALL SELECT y, 'train', CAST(n - (n * 2 + 9) // 10 AS BIGINT) FROM c""", views=("passes",))
def q_stratified_split(spark, sf):
    """WIN6: rows per (label, side) of a seeded stratified 80/20 split."""
    s = FO.stratified_split(labelled(spark, sf), "pass_id", "y", 2, seed=42)
    return s.groupBy("y", "split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("nested_blocks", """WITH c AS (SELECT count(*) AS n, count(*) // 8 AS l FROM passes)
SELECT 0 AS block, CAST(l AS BIGINT) AS n_rows FROM c UNION ALL SELECT 1, CAST(l AS BIGINT) FROM c
UNION ALL SELECT 2, CAST(2 * l AS BIGINT) FROM c UNION ALL SELECT 3, CAST(n - 4 * l AS BIGINT) FROM c""",
          views=("passes",))
def q_nested_blocks(spark, sf):
    """WIN7: rows per nested-subsample level (8 blocks → sizes N/8, N/8, N/4, rest)."""
    b = FO.nested_blocks(p(spark, sf), "pass_id", 8, seed=42)
    return b.groupBy("block").agg(F.count(F.lit(1)).alias("n_rows"))


HEIGHTS = ["Ground Pass", "High Pass", "Low Pass"]
BODIES = ["Drop Kick", "Head", "Keeper Arm", "Left Foot", "Other", "Right Foot", "Unknown"]


@register("one_hot", "SELECT pass_id, " + ", ".join(
    [f"CAST(height IS NOT DISTINCT FROM '{h}' AS DOUBLE) AS \"height_{h}\"" for h in HEIGHTS]
    + [f"CAST(body_part IS NOT DISTINCT FROM '{b}' AS DOUBLE) AS \"body_part_{b}\"" for b in BODIES])
    + f" FROM ({PRE_SQL}) t", views=("passes",))
def q_one_hot(spark, sf):
    """FE5: levels fitted on training matches, applied to all passes."""
    pre = preprocess_passes(p(spark, sf))
    m = EN.OneHotModel.fit(pre.where(F.col("match_id") != 7), ["height", "body_part"])
    out = m.transform(pre)
    return out.select("pass_id", *[c for c in out.columns if c.startswith(("height_", "body_part_"))])


@register("dummy_encode", "SELECT pass_id, " + ", ".join(
    [f"CAST(coalesce(height = '{h}', false) AS INTEGER) AS \"height_{h.replace(' ', '_')}\"" for h in HEIGHTS]
    + [f"CAST(coalesce(body_part = '{b}', false) AS INTEGER) AS \"body_part_{b.replace(' ', '_')}\""
       for b in BODIES if b != "Unknown"]
    + ["CAST(body_part IS NULL AS INTEGER) AS body_part_null"]) + " FROM passes", views=("passes",))
def q_dummy_encode(spark, sf):
    """FE6 + SC27: dummies of the levels present, spaces → '_', null level → ``_null``."""
    out = EN.dummy_encode(p(spark, sf).select("pass_id", "height", "body_part"), ["height", "body_part"])
    return out


@register("category_codes", "SELECT pass_id, CASE height " + " ".join(
    f"WHEN '{h}' THEN {i}" for i, h in enumerate(HEIGHTS)) + " ELSE -1 END AS height_code, CASE body_part "
    + " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate([b for b in BODIES if b != "Unknown"]))
    + " ELSE -1 END AS body_part_code FROM passes", views=("passes",))
def q_category_codes(spark, sf):
    """FE7: sorted-level codes learned on training matches; unknown or null → −1."""
    raw = p(spark, sf)
    cc = EN.CategoryCodes.fit(raw.where(F.col("match_id") != 7), ["height", "body_part"])
    return cc.codes(raw).select("pass_id", "height_code", "body_part_code")


@register("apply_category_mapping", "SELECT pass_id, height, body_part FROM passes", views=("passes",))
def q_apply_category_mapping(spark, sf):
    """FE8: mapping saved at training time (JSON), re-applied at scoring; unknown → null."""
    raw = p(spark, sf)
    saved = EN.CategoryCodes.fit(raw.where(F.col("match_id") != 7), ["height", "body_part"]).to_json()
    return EN.CategoryCodes.from_json(saved).apply(raw).select("pass_id", "height", "body_part")


def _psi(v):
    """The series of ``stats.digamma`` as SQL."""
    z = f"({v} + 6.0)"
    return (f"(ln{z} - 1.0/(2*{z}) - 1.0/(12*pow({z},2)) + 1.0/(120*pow({z},4)) - 1.0/(252*pow({z},6)) + 1.0/(240*pow({z},8))"
            + "".join(f" - 1.0/({v} + {j}.0)" for j in range(6)) + ")")


def _steps(c):
    return f"CAST(coalesce(round(({c} - min({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0) * 1073741824.0), 0) AS BIGINT)"


def _mi_classes_sql(feature):
    """k-NN estimate from (label, value) counts: k-th neighbour by rank lookups, points
    inside its radius from running counts met at both ends."""
    return f"""SELECT '{feature}' AS feature, greatest(0.0, {_psi('sum(c)')} + sum(c * {_psi('k_i')})/sum(c) - sum(c * {_psi('n_lab')})/sum(c)
    - sum(c * {_psi('m')})/sum(c)) AS mutual_info, CAST(sum(c) AS BIGINT) AS n FROM (
  WITH cnt AS (SELECT lab, x, count(*) AS c FROM (SELECT CASE WHEN outcome IS NULL THEN 1 ELSE 0 END AS lab, {_steps(feature)} AS x
      FROM passes WHERE {feature} IS NOT NULL) b GROUP BY lab, x),
    rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY x) AS r, sum(c) OVER (PARTITION BY lab) AS n_lab
      FROM cnt) w WHERE n_lab > 1),
    near AS (SELECT a.lab, a.x, a.c, a.n_lab, least(3, a.n_lab - 1) AS k_i, abs(b.x - a.x) AS d,
        sum(b.c) OVER (PARTITION BY a.lab, a.x ORDER BY abs(b.x - a.x)) AS upto
      FROM (SELECT *, r + unnest(generate_series(-3, 3)) AS r2 FROM rk) a JOIN rk b ON a.lab = b.lab AND a.r2 = b.r),
    rad AS (SELECT lab, x, c, n_lab, k_i, min(d) AS r FROM near WHERE upto >= k_i + 1 GROUP BY ALL),
    cum AS (SELECT x AS v, sum(sum(c)) OVER (ORDER BY x) AS upto FROM rad GROUP BY x),
    ends AS (SELECT *, CASE WHEN r = 0 THEN x ELSE x + r - 1 END AS hi, CASE WHEN r = 0 THEN x - 1 ELSE x - r END AS lo FROM rad)
  SELECT e.c, e.n_lab, e.k_i, h.upto - coalesce(l.upto, 0) AS m FROM ends e ASOF JOIN cum h ON e.hi >= h.v
    ASOF LEFT JOIN cum l ON e.lo >= l.v) q"""


@register("mutual_info_knn", _mi_classes_sql("length") + " UNION ALL " + _mi_classes_sql("end_y"), views=("passes",), dbl=("mutual_info",))
def q_mutual_info_knn(spark, sf):
    """AGG21 exact: k-NN (k = 3) mutual information of pass length and end y with completion."""
    df = labelled(spark, sf)
    return IN.mutual_info_classes(df, "length", "y", 3).unionByName(IN.mutual_info_classes(df, "end_y", "y", 3))


PLAYER_SQL = ("SELECT match_id, player_id, avg(loc_x) AS mean_x, max(loc_x) AS furthest_x FROM match_events "
              "WHERE loc_x IS NOT NULL GROUP BY match_id, player_id")
MI_NUMBERS_SQL = f"""WITH pl AS (SELECT {_steps('mean_x')} AS x, {_steps('furthest_x')} AS y FROM ({PLAYER_SQL}) p),
  pts AS (SELECT x, y, count(*) AS c FROM pl GROUP BY x, y),
  near AS (SELECT a.x, a.y, a.c, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS d,
      sum(b.c) OVER (PARTITION BY a.x, a.y ORDER BY greatest(abs(a.x - b.x), abs(a.y - b.y))) AS upto FROM pts a CROSS JOIN pts b),
  rad AS (SELECT x, y, c, min(d) AS r FROM near WHERE upto >= 4 GROUP BY x, y, c),
  inside AS (SELECT a.x, a.y, a.c, sum(CASE WHEN abs(a.x - b.x) < a.r OR a.x = b.x THEN b.c ELSE 0 END) AS n_x,
      sum(CASE WHEN abs(a.y - b.y) < a.r OR a.y = b.y THEN b.c ELSE 0 END) AS n_y FROM rad a CROSS JOIN pts b GROUP BY a.x, a.y, a.c)
  SELECT 'mean_x' AS feature, greatest(0.0, {_psi('sum(c)')} + {_psi('3')} - sum(c * {_psi('n_x')})/sum(c) - sum(c * {_psi('n_y')})/sum(c))
    AS mutual_info, CAST(sum(c) AS BIGINT) AS n FROM inside"""


@register("mutual_info_regression", MI_NUMBERS_SQL, views=("match_events",), dbl=("mutual_info",))
def q_mutual_info_regression(spark, sf):
    """AGG21 exact, regression form: what a player's mean x in a match tells of the furthest x."""
    ev = V.match_events_flat(spark, sf).where("loc_x IS NOT NULL")
    players = ev.groupBy("match_id", "player_id").agg(F.avg("loc_x").alias("mean_x"), F.max("loc_x").alias("furthest_x"))
    return IN.mutual_info_numbers(players, "mean_x", "furthest_x", 3)


@register("mutual_info_regression_passes")
def q_mutual_info_regression_passes(spark, sf):
    """AGG21 exact, regression form over every pass: length and end y with duration (too many
    pairs for a SQL self join)."""
    df = p(spark, sf)
    return IN.mutual_info_numbers(df, "length", "duration", 3).unionByName(IN.mutual_info_numbers(df, "end_y", "duration", 3))


@register("category_codes_large", """WITH o AS (SELECT l_orderkey, l_linenumber, l_orderkey % 64 AS match_id, 'order ' || l_orderkey AS name FROM lineitem),
  levels AS (SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT name FROM o WHERE match_id <> 7) d)
  SELECT l_orderkey, l_linenumber, coalesce(code, -1) AS name_code FROM o LEFT JOIN levels USING (name)""")
def q_category_codes_large(spark, sf):
    """FE7, a column with more levels than a list takes: codes by sorted training level from a lookup table."""
    from touchline.sources.tables import read_table
    rows = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 64).alias("match_id"),
                                                    F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("name"))
    codes = EN.CategoryCodes.fit(rows.where(F.col("match_id") != 7), ["name"])
    return codes.codes(rows).select("l_orderkey", "l_linenumber", "name_code")

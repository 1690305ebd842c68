"""Automatic feature generation queries over the pass view P."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import autofe as AF
from touchline.operators.folds import nested_blocks
from touchline.operators.passes import pass_geometry, preprocess_passes
from touchline.plans.q_stats import FOLD_ROWS_SQL
from touchline.plans.registry import register
from touchline.plans.sqlfrag import PRE_SQL
from touchline.sources import views as V

PROFILE = ["start_x", "length", "duration", "under_pressure", "height", "body_part"]
CATS = ["height", "body_part"]


def pre(spark, sf):
    return preprocess_passes(V.passes(spark, sf))


def with_split(df):
    return df.withColumn("split", F.when(F.col("match_id") == 7, "valid").otherwise("train"))


_UN = ["abs", "log", "sqrt", "square", "sigmoid", "round", "residual"]
_CN = ["GroupByThenMin", "GroupByThenMax", "GroupByThenMean", "GroupByThenMedian", "GroupByThenStd",
       "GroupByThenRank"]
CAND_SQL = f"""WITH pre AS ({PRE_SQL}),
nd AS (SELECT count(DISTINCT start_x) AS a, count(DISTINCT length) AS b, count(DISTINCT duration) AS c,
  count(DISTINCT under_pressure) AS d FROM pre),
cols AS (SELECT 'start_x' AS name, 0 AS ord, CASE WHEN a <= 100 THEN 'ordinal' ELSE 'numerical' END AS kind FROM nd
  UNION ALL SELECT 'length', 1, CASE WHEN b <= 100 THEN 'ordinal' ELSE 'numerical' END FROM nd
  UNION ALL SELECT 'duration', 2, CASE WHEN c <= 100 THEN 'ordinal' ELSE 'numerical' END FROM nd
  UNION ALL SELECT 'under_pressure', 3, CASE WHEN d <= 100 THEN 'ordinal' ELSE 'numerical' END FROM nd
  UNION ALL SELECT 'height', 4, 'categorical' UNION ALL SELECT 'body_part', 5, 'categorical'),
num AS (SELECT name, CASE WHEN kind = 'numerical' THEN ord ELSE 100 + ord END AS pos FROM cols
  WHERE kind IN ('numerical', 'ordinal')),
cat AS (SELECT name, CASE WHEN kind = 'categorical' THEN ord ELSE 100 + ord END AS pos FROM cols
  WHERE kind IN ('categorical', 'ordinal')),
un AS (SELECT * FROM (VALUES {', '.join(f"('{o}')" for o in _UN)}) t(o)),
ar AS (SELECT * FROM (VALUES ('+'), ('-'), ('*'), ('/')) t(o)),
mm AS (SELECT * FROM (VALUES ('min'), ('max')) t(o)),
cn AS (SELECT * FROM (VALUES {', '.join(f"('{o}')" for o in _CN)}) t(o)),
cc AS (SELECT * FROM (VALUES ('Combine'), ('CombineThenFreq')) t(o))
SELECT DISTINCT 'freq(' || name || ')' AS formula, 'freq' AS operator FROM (SELECT name FROM num UNION SELECT name FROM cat) f
UNION ALL SELECT o || '(' || name || ')', o FROM un, num
UNION ALL SELECT '(' || a.name || o || b.name || ')', o FROM ar, num a, num b WHERE a.pos < b.pos
UNION ALL SELECT o || '(' || a.name || ',' || b.name || ')', o FROM mm, num a, num b WHERE a.pos < b.pos
UNION ALL SELECT o || '(' || f.name || ',' || c.name || ')', o FROM cn, num f, cat c WHERE f.name <> c.name
UNION ALL SELECT o || '(' || a.name || ',' || b.name || ')', o FROM cc, cat a, cat b WHERE a.pos < b.pos
UNION ALL SELECT 'GroupByThenNUnique(' || a.name || ',' || b.name || ')', 'GroupByThenNUnique' FROM cat a, cat b
  WHERE a.name <> b.name"""


#: Two rounds: results of the first are arguments of the second, ``Combine`` ids as categories and all others as numbers.
_PAIRS = ["+", "-", "*", "/", "min", "max"]
CAND_SECOND_SQL = f"""WITH one AS ({CAND_SQL}),
s AS (SELECT count(*) FILTER (operator = 'abs') AS a, count(*) FILTER (operator = 'freq') AS f, count(*) AS k,
  count(*) FILTER (operator = 'Combine') AS m,
  CAST(round((1 + sqrt(1 + 4 * count(*) FILTER (operator = 'GroupByThenNUnique'))) / 2) AS BIGINT) AS c FROM one),
p AS (SELECT a + k - m AS nn, c + m AS nc, f + k AS na, a + c - f AS both_kinds FROM s)
SELECT operator, CAST(n AS BIGINT) AS n FROM (
  SELECT 'freq' AS operator, na AS n FROM p
  UNION ALL SELECT o, nn FROM p, (VALUES {', '.join(f"('{o}')" for o in _UN)}) t(o)
  UNION ALL SELECT o, nn * (nn - 1) // 2 FROM p, (VALUES {', '.join(f"('{o}')" for o in _PAIRS)}) t(o)
  UNION ALL SELECT o, nn * nc - both_kinds FROM p, (VALUES {', '.join(f"('{o}')" for o in _CN)}) t(o)
  UNION ALL SELECT o, nc * (nc - 1) // 2 FROM p, (VALUES ('Combine'), ('CombineThenFreq')) t(o)
  UNION ALL SELECT 'GroupByThenNUnique', nc * (nc - 1) FROM p) q"""


def candidates(spark, sf):
    return AF.enumerate_candidates(*AF.profile_kinds(pre(spark, sf), PROFILE, CATS))


@register("candidate_features", CAND_SQL, views=("passes",))
def q_candidate_features(spark, sf):
    """FE9: candidate formulas from the profiled pass columns (ordinal = ≤100 distinct)."""
    nodes = candidates(spark, sf)
    return spark.createDataFrame([(n.text(), n.op) for n in nodes], "formula string, operator string")


S1 = ["(length/duration)", "GroupByThenMean(length,height)", "freq(body_part)", "abs((end_y-start_y))",
      "CombineThenFreq(height,body_part)"]
S1_SQL = f"""WITH pre AS ({PRE_SQL}),
f AS (SELECT CASE WHEN match_id = 7 THEN 'valid' ELSE 'train' END AS split, CAST(outcome AS DOUBLE) AS y,
  CASE WHEN duration <> 0 THEN length / duration END AS c0,
  CASE WHEN height IS NOT NULL THEN avg(length) OVER (PARTITION BY height) END AS c1,
  CASE WHEN body_part IS NOT NULL THEN CAST(count(*) OVER (PARTITION BY body_part) AS DOUBLE) END AS c2,
  abs(end_y - start_y) AS c3,
  CASE WHEN height IS NOT NULL AND body_part IS NOT NULL THEN CAST(count(*) OVER (PARTITION BY height, body_part)
    AS DOUBLE) END AS c4 FROM pre),
l AS (SELECT split, y, 'c0' AS cand, c0 AS v FROM f UNION ALL SELECT split, y, 'c1', c1 FROM f
  UNION ALL SELECT split, y, 'c2', c2 FROM f UNION ALL SELECT split, y, 'c3', c3 FROM f
  UNION ALL SELECT split, y, 'c4', c4 FROM f),
tv AS (SELECT cand, v, row_number() OVER (PARTITION BY cand ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY cand) AS n
  FROM l WHERE split = 'train' AND v IS NOT NULL),
e AS (SELECT DISTINCT cand, v AS edge FROM tv, range(1, 16) k(k) WHERE pos = (k * (n - 1)) // 16),
b AS (SELECT l.cand, l.split, l.y, CASE WHEN l.v IS NULL THEN -1 ELSE (SELECT count(*) FROM e WHERE e.cand = l.cand
  AND e.edge < l.v) END AS bin FROM l),
p0 AS (SELECT avg(y) AS p0 FROM f WHERE split = 'train'),
c AS (SELECT cand, bin, split, sum(y) AS pos, count(*) AS n FROM b GROUP BY 1, 2, 3),
w AS (SELECT cand, bin, (pos - n * p0) / (n * p0 * (1 - p0) + 1.0) AS w FROM c, p0 WHERE split = 'train'),
va AS (SELECT c.cand, c.pos, c.n, coalesce(w.w, 0.0) AS w, p0 FROM c JOIN p0 ON true LEFT JOIN w
  ON c.cand = w.cand AND c.bin = w.bin WHERE c.split = 'valid'),
q AS (SELECT *, least(greatest(1.0 / (1 + exp(-(ln(p0 / (1 - p0)) + w))), 1e-15), 1 - 1e-15) AS q FROM va),
s AS (SELECT cand, (sum(-(pos * ln(p0) + (n - pos) * ln(1 - p0))) - sum(-(pos * ln(q) + (n - pos) * ln(1 - q))))
  / sum(n) AS score FROM q GROUP BY 1)
SELECT CASE cand {' '.join(f"WHEN 'c{i}' THEN '{f}'" for i, f in enumerate(S1))} END AS feature, score FROM s"""


@register("stage1_scores", S1_SQL, views=("passes",), dbl=("score",))
def q_stage1_scores(spark, sf):
    """FE10: hold-out-match gain of a one-step 16-bin scorer for each candidate, one pass."""
    return AF.stage1_scores(with_split(pre(spark, sf)), S1, "outcome", "split")


@register("stage1_select")
def q_stage1_select(spark, sf):
    """FE11: successive halving of all enumerated candidates over 4 nested row blocks."""
    df = nested_blocks(with_split(pre(spark, sf)), "pass_id", 4, seed=42).cache()
    forms = [n.text() for n in candidates(spark, sf)]
    return AF.stage1_select(df, forms, "outcome", "split", "block", n_levels=3, min_features=8,
                            order_col="pass_id")


BASE_NUM = ["length", "angle", "duration", "start_x", "end_x"]


@register("stage2_select")
def q_stage2_select(spark, sf):
    """FE12: gain importance of candidates inside one boosted model with the base features."""
    df = pre(spark, sf).withColumn("outcome", F.col("outcome").cast("double"))
    return AF.stage2_rank(df.where(F.col("match_id") != 7), BASE_NUM, ["height"], S1, "outcome",
                          {"maxIter": 10, "maxDepth": 3, "stepSize": 0.2})


@register("auto_features")
def q_auto_features(spark, sf):
    """FE13: enumerate → stage-1 halving → stage-2 ranking → top 5."""
    df = nested_blocks(with_split(pre(spark, sf)), "pass_id", 2, seed=42) \
        .withColumn("outcome", F.col("outcome").cast("double")).cache()
    forms = [n.text() for n in candidates(spark, sf)]
    s1 = AF.stage1_select(df, forms, "outcome", "split", "block", n_levels=2, min_features=10, order_col="pass_id")
    top = [r["feature"] for r in s1.orderBy(F.col("score").desc(), "feature").collect()]
    s2 = AF.stage2_rank(df.where(F.col("split") == "train"), BASE_NUM, ["height"], top, "outcome",
                        {"maxIter": 10, "maxDepth": 3, "stepSize": 0.2}, order_col="pass_id")
    return s2.orderBy(F.col("importance").desc(), "feature").limit(5)


@register("two_stage_selection")
def q_two_stage_selection(spark, sf):
    """ML10: the same two stages over existing columns (identity formulas)."""
    g = with_split(pass_geometry(preprocess_passes(V.passes(spark, sf)))) \
        .withColumn("outcome", F.col("outcome").cast("double"))
    cols = ["length", "angle", "duration", "start_x", "end_x", "log_velocity", "progressive_distance",
            "direction_to_goal_cos"]
    s1 = AF.stage1_scores(g, cols, "outcome", "split")
    scored = s1.orderBy(F.col("score").desc(), "feature").collect()
    ranked, keep = [r["feature"] for r in scored], [r["feature"] for r in scored if r["score"] > 0]
    n_min = max(1, int(0.2 * len(cols)))        # at least this share of the columns goes on
    keep = keep if len(keep) >= n_min else ranked[:n_min]
    return AF.stage2_rank(g.where(F.col("split") == "train"), [], [], keep, "outcome",
                          {"maxIter": 10, "maxDepth": 3, "stepSize": 0.2})


@register("oof_margin_rows", FOLD_ROWS_SQL.format(k=5, label="CASE WHEN outcome IS NULL THEN 1 ELSE 0 END", where="")
          .replace("SELECT pass_id, y, CAST((row", "SELECT pass_id, CAST((row"), views=("passes",))
def q_oof_margin_rows(spark, sf):
    """FE15: every row has one margin, from the model that did not see its fold."""
    return q_oof_margin(spark, sf).where(F.col("margin").isNotNull()).select("pass_id", "fold")


@register("oof_margin")
def q_oof_margin(spark, sf):
    """FE15: out-of-fold raw margins of a base model (the boosting start score for generated features)."""
    from touchline.operators import modeling as ML
    df = pass_geometry(preprocess_passes(V.passes(spark, sf))).withColumn("outcome", F.col("outcome").cast("double"))
    spec = ML.ModelSpec(BASE_NUM, ["height"], "outcome", {"maxIter": 10, "maxDepth": 3, "stepSize": 0.2})
    return ML.oof_margins(spec, df, "pass_id", k=5, seed=42)


@register("fold_features", f"""WITH f AS (SELECT *, CAST((row_number() OVER (PARTITION BY outcome ORDER BY h, pass_id) - 1) % 3 AS INTEGER) AS fold
    FROM (SELECT *, CAST('0x' || substr(md5('42:' || pass_id), 1, 15) AS BIGINT) AS h FROM ({PRE_SQL}) p0) p1),
  k AS (SELECT DISTINCT fold FROM f),
  m AS (SELECT k.fold, f.height, avg(f.length) AS v FROM f, k WHERE f.fold <> k.fold AND f.height IS NOT NULL GROUP BY 1, 2),
  c AS (SELECT k.fold, f.body_part, CAST(count(*) AS DOUBLE) AS v FROM f, k WHERE f.fold <> k.fold AND f.body_part IS NOT NULL GROUP BY 1, 2)
  SELECT f.pass_id, f.fold, m.v AS mean_length, c.v AS n_body_part, f.length / m.v AS ratio FROM f LEFT JOIN m ON m.fold = f.fold AND m.height = f.height
    LEFT JOIN c ON c.fold = f.fold AND c.body_part = f.body_part""", views=("passes",), dbl=("mean_length", "ratio"))
def q_fold_features(spark, sf):
    """FE13/ML4: features of each fold's rows from state that was learned on the other folds only."""
    from touchline.operators.folds import stratified_folds
    from touchline.operators.formula import fold_features
    names = {"GroupByThenMean(length,height)": "mean_length", "freq(body_part)": "n_body_part", "(length/GroupByThenMean(length,height))": "ratio"}
    folds = stratified_folds(pre(spark, sf), "pass_id", "outcome", k=3, seed=42)
    return fold_features(folds, list(names), "pass_id", 3, names=names)


@register("candidate_features_second", CAND_SECOND_SQL, views=("passes",))
def q_candidate_features_second(spark, sf):
    """FE9, order 2: how many formulas of each operator two rounds of enumeration give over the six profiled columns."""
    nodes = AF.enumerate_candidates(*AF.profile_kinds(pre(spark, sf), PROFILE, CATS), order=2)
    frame = spark.createDataFrame([(n.op, n.text()) for n in nodes], "operator string, formula string")
    return frame.groupBy("operator").agg(F.count_distinct("formula").alias("n"))

"""Boosting from start margins, more than two classes, and regression over the pass view P."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from touchline.operators import autofe as AF
from touchline.operators import boosting as B
from touchline.operators import metrics as MT
from touchline.operators import modeling as ML
from touchline.operators import stats as ST
from touchline.operators.folds import plain_folds
from touchline.plans.q_autofe import BASE_NUM, pre, with_split
from touchline.plans.registry import register
from touchline.plans.sqlfrag import PRE_SQL
from touchline.session import stored

#: Classes in the order of their names (fixed values).
HEIGHTS = ["Ground Pass", "High Pass", "Low Pass"]
SMALL = {"maxIter": 8, "maxDepth": 3, "stepSize": 0.3}
HASH_SQL = "CAST('0x' || substr(md5('42:' || pass_id), 1, 15) AS BIGINT)"
CLASS_SQL = f"SELECT *, CASE height {' '.join(f'WHEN {h!r} THEN {i}' for i, h in enumerate(HEIGHTS))} END AS class FROM ({PRE_SQL}) p0"


def classed(spark, sf):
    """Passes whose label is the height, three classes."""
    number = F.array_position(F.array(*[F.lit(h) for h in HEIGHTS]), F.col("height")) - 1
    return pre(spark, sf).withColumn("class", F.when(number >= 0, number).cast("double"))


# ---- start margins --------------------------------------------------------------------

#: Each pass starts from the log odds of its body part in the other folds.
MARGIN_SQL = f"""folds AS (SELECT *, CAST((row_number() OVER (PARTITION BY outcome ORDER BY h, pass_id) - 1) % 5 AS INTEGER) AS fold
    FROM (SELECT *, {HASH_SQL} AS h FROM ({PRE_SQL}) p0) p1),
  sums AS (SELECT body_part, fold, sum(outcome) AS pos, count(*) AS n FROM folds GROUP BY 1, 2),
  others AS (SELECT body_part, fold, sum(pos) OVER w - pos AS pos, sum(n) OVER w - n AS n FROM sums WINDOW w AS (PARTITION BY body_part)),
  started AS (SELECT f.*, ln((o.pos + 1.0) / (o.n - o.pos + 1.0)) AS margin FROM folds f JOIN others o USING (body_part, fold))"""


def started(spark, sf):
    df = pre(spark, sf)
    margins = ML.oof_group_margins(df, "pass_id", "body_part", "outcome", k=5, seed=42)
    return with_split(margins)


@register("oof_group_margin", f"WITH {MARGIN_SQL} SELECT pass_id, fold, margin FROM started", views=("passes",), dbl=("margin",))
def q_oof_group_margin(spark, sf):
    """FE15: out-of-fold log odds of each pass's body part, a start score without the row's own label."""
    return started(spark, sf).select("pass_id", "fold", "margin")


FORMULAS = ["(length/duration)", "abs((end_y-start_y))", "start_x"]
BINS_SQL = f"""{MARGIN_SQL},
  q AS (SELECT *, CASE WHEN match_id = 7 THEN 'valid' ELSE 'train' END AS split, CAST(outcome AS DOUBLE) AS y,
    least(greatest(1.0 / (1.0 + exp(-margin)), 1e-15), 1 - 1e-15) AS p FROM started),
  l AS (SELECT split, y, p, margin, 'c0' AS cand, CASE WHEN duration <> 0 THEN length / duration END AS v FROM q
    UNION ALL SELECT split, y, p, margin, 'c1', abs(end_y - start_y) FROM q
    UNION ALL SELECT split, y, p, margin, 'c2', start_x FROM q),
  tv AS (SELECT cand, v, row_number() OVER (PARTITION BY cand ORDER BY v) - 1 AS pos, count(*) OVER (PARTITION BY cand) AS n
    FROM l WHERE split = 'train' AND v IS NOT NULL),
  e AS (SELECT DISTINCT cand, v AS edge FROM tv, range(1, 16) k(k) WHERE pos = (k * (n - 1)) // 16),
  b AS (SELECT l.*, CASE WHEN l.v IS NULL THEN -1 ELSE (SELECT count(*) FROM e WHERE e.cand = l.cand AND e.edge < l.v) END AS bin FROM l),
  s AS (SELECT cand, bin, count(*) AS n, sum(y - p) AS g, sum(p * (1 - p)) AS h FROM b WHERE split = 'train' GROUP BY 1, 2)"""
NAMED_SQL = f"CASE cand {' '.join(f'WHEN {chr(39)}c{i}{chr(39)} THEN {f!r}' for i, f in enumerate(FORMULAS))} END"


@register("stage1_gradients", f"WITH {BINS_SQL} SELECT {NAMED_SQL} AS feature, CAST(bin AS INTEGER) AS bin, n, g, h FROM s",
          views=("passes",), dbl=("g", "h"))
def q_stage1_gradients(spark, sf):
    """FE10/FE15: sums of gradients and hessians by candidate and bin around each row's own start margin."""
    df = started(spark, sf)
    obj = B.Binary()
    bins = AF.binned_gradients(df, FORMULAS, "outcome", "split", obj, obj.priors(df.where("split = 'train'"), "outcome"), "margin")
    names = F.create_map(*[x for c, f in zip(bins.names, bins.formulas) for x in (F.lit(c), F.lit(f))])
    return bins.sums.select(names[F.col("cand")].alias("feature"), "bin", "n", F.col("g0").alias("g"), F.col("h0").alias("h"))


@register("stage1_boosted", f"""WITH {BINS_SQL},
  m AS (SELECT b.cand, b.y, b.p, b.margin + coalesce(s.g / (s.h + 1.0), 0.0) AS m FROM b LEFT JOIN s ON s.cand = b.cand AND s.bin = b.bin WHERE split = 'valid'),
  r AS (SELECT *, least(greatest(1.0 / (1.0 + exp(-m)), 1e-15), 1 - 1e-15) AS q FROM m)
  SELECT {NAMED_SQL} AS feature, avg(-(y * ln(p) + (1 - y) * ln(1 - p)) + (y * ln(q) + (1 - y) * ln(1 - q))) AS score FROM r GROUP BY cand""",
          views=("passes",), dbl=("score",))
def q_stage1_boosted(spark, sf):
    """FE10/FE15: validation gain of each candidate on top of the out-of-fold start margin."""
    return AF.stage1_gains(started(spark, sf), FORMULAS, "outcome", "split", start="margin")


@register("stage2_boosted")
def q_stage2_boosted(spark, sf):
    """FE12: candidates ranked by one-scan permutations of a model that goes on from the margins of a boosted base
    model (out of fold), stops early, and leaves one base column out."""
    df = pre(spark, sf).withColumn("outcome", F.col("outcome").cast("double"))
    spec = ML.ModelSpec(BASE_NUM, ["height"], "outcome", SMALL)
    margins = ML.oof_margins(spec, df, "pass_id", k=3).drop("fold")
    return AF.stage2_select(with_split(df.join(margins, "pass_id")), BASE_NUM, ["height"], FORMULAS, "outcome", SMALL, method="permutation",
                            repeats=2, row_id="pass_id", start="margin", drop=["angle"], split_col="split", patience=2)


# ---- three classes --------------------------------------------------------------------

@register("init_scores_classes", f"""SELECT CAST(class AS DOUBLE) AS class, count(*) / sum(count(*)) OVER () AS prior,
  ln(count(*) / sum(count(*)) OVER ()) AS init_score FROM ({CLASS_SQL}) c WHERE class IS NOT NULL GROUP BY class""",
          views=("passes",), dbl=("prior", "init_score"))
def q_init_scores_classes(spark, sf):
    """AGG33, three classes: shares and start margins."""
    return ST.init_scores(classed(spark, sf), "class", task="multiclass")


@register("softmax_first_round", f"""WITH c AS (SELECT under_pressure, class FROM ({CLASS_SQL}) x WHERE class IS NOT NULL),
  k AS (SELECT class, count(*) / sum(count(*)) OVER () AS p FROM c GROUP BY class),
  leaf AS (SELECT under_pressure, k.class, k.p, sum(CASE WHEN c.class = k.class THEN 1 ELSE 0 END - k.p) / sum(k.p * (1 - k.p)) AS step
    FROM c, k GROUP BY 1, 2, 3)
  SELECT CAST(under_pressure AS BIGINT) AS under_pressure, CAST(class AS INTEGER) AS class, ln(p) + 0.5 * step AS margin FROM leaf""",
          views=("passes",), dbl=("margin",))
def q_softmax_first_round(spark, sf):
    """ML1, three classes: margins after one round of stumps on pressure, the log priors plus half a Newton step a leaf."""
    df = VectorAssembler(inputCols=["under_pressure"], outputCol="features").transform(classed(spark, sf))
    model = B.boost(df, B.Softmax(3), "class", rounds=1, depth=1, step=0.5)
    leaves = model.transform(df.select("under_pressure", "features").distinct())
    return leaves.select("under_pressure", F.posexplode("margins").alias("class", "margin"))


def class_spec(**kw):
    return ML.ModelSpec(["start_x", "start_y", "length", "angle", "duration"], ["body_part"], "class", {**SMALL, **kw}, "multiclass", 3)


@register("multiclass_fit")
def q_multiclass_fit(spark, sf):
    """ML1/ML13, three classes: fit on the training matches, probabilities and arg-max class of the hold-out match."""
    df = classed(spark, sf)
    return ML.fit_predict(class_spec(), df.where(F.col("match_id") != 7), df.where(F.col("match_id") == 7), ["pass_id"])


@register("multiclass_margins")
def q_multiclass_margins(spark, sf):
    """FE15, three classes: an out-of-fold margin a class for every pass."""
    return ML.oof_margins(class_spec(maxIter=4), classed(spark, sf), "pass_id", k=3)


# ---- regression -----------------------------------------------------------------------

@register("init_scores_number", f"SELECT avg(length) AS mean_label, avg(length) AS init_score FROM ({PRE_SQL}) t", views=("passes",),
          dbl=("mean_label", "init_score"))
def q_init_scores_number(spark, sf):
    """AGG33, regression: the mean label."""
    return ST.init_scores(pre(spark, sf), "length", task="regression")


@register("regression_folds", f"""WITH f AS (SELECT pass_id, duration AS y, under_pressure AS u, CAST((row_number() OVER (ORDER BY h, pass_id) - 1) % 4 AS INTEGER) AS fold
    FROM (SELECT *, {HASH_SQL} AS h FROM ({PRE_SQL}) p0) p1),
  whole AS (SELECT g.fold, avg(f.y) AS prior FROM f, (SELECT DISTINCT fold FROM f) g WHERE f.fold <> g.fold AND f.y IS NOT NULL GROUP BY 1),
  leaf AS (SELECT w.fold, f.u, w.prior + 0.5 * avg(f.y - w.prior) AS pred FROM f, whole w WHERE f.fold <> w.fold AND f.y IS NOT NULL GROUP BY w.fold, f.u, w.prior)
  SELECT f.fold, count(*) AS n, avg(f.y) AS mean_label, 1 - sum((f.y - l.pred) * (f.y - l.pred)) / (var_pop(f.y) * count(*)) AS r2
  FROM f JOIN leaf l ON l.fold = f.fold AND l.u = f.u WHERE f.y IS NOT NULL GROUP BY f.fold""", views=("passes",), dbl=("mean_label", "r2"))
def q_regression_folds(spark, sf):
    """ML1/AGG35, regression: mean label and R² of each fold, scored by one half-step stump fitted on the other folds."""
    vector = VectorAssembler(inputCols=["under_pressure"], outputCol="features").transform
    folds = stored(plain_folds(pre(spark, sf).select("pass_id", "duration", "under_pressure"), "pass_id", 4, seed=42), "folds")
    parts = None
    for i in range(4):
        model = B.boost(folds.where(F.col("fold") != i), B.Squared(), "duration", rounds=1, depth=1, step=0.5, features=vector)
        part = model.transform(vector(folds.where((F.col("fold") == i) & F.col("duration").isNotNull()))).select("fold", "duration", F.col("margins")[0].alias("pred"))
        parts = part if parts is None else parts.unionByName(part)
    means = parts.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("duration").alias("mean_label"))
    return means.join(F.broadcast(MT.r2_score(parts, "duration", "pred", ["fold"])), "fold")


def number_spec(**kw):
    return ML.ModelSpec(["start_x", "start_y", "length", "angle"], ["height", "body_part"], "duration", {**SMALL, **kw}, "regression")


@register("regression_fit")
def q_regression_fit(spark, sf):
    """ML1, regression: fit the duration on the training matches, predict the hold-out match."""
    df = pre(spark, sf).where("duration is not null")
    return ML.fit_predict(number_spec(), df.where(F.col("match_id") != 7), df.where(F.col("match_id") == 7), ["pass_id"])


@register("forward_selection_r2")
def q_forward_selection_r2(spark, sf):
    """ML9, regression: forward selection by the mean R² of two folds."""
    df = pre(spark, sf).where("duration is not null and match_id <> 7")
    return ML.forward_selection(number_spec(), df, "pass_id", k=2, step=2, metric="r2")


@register("param_search_number")
def q_param_search_number(spark, sf):
    """ML5, regression: seeded search by the root of the mean squared error over inner folds."""
    df = pre(spark, sf).where("duration is not null and match_id <> 7")
    return ML.param_search(number_spec(), df, "pass_id", n_trials=3, k=2)

"""Model training, selection and scoring queries (rows-only checks: no SQL equivalent)."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import metrics as MT
from touchline.operators import modeling as ML
from touchline.operators.passes import pass_geometry, preprocess_passes
from touchline.plans.q_autofe import S1, S1_SQL, pre, with_split
from touchline.plans.q_stats import FOLD_ROWS_SQL
from touchline.plans.registry import register
from touchline.sources.io import scratch
from touchline.sources import views as V

NUMERIC = ["start_x", "start_y", "end_x", "end_y", "length", "angle", "duration", "under_pressure",
           "log_velocity", "angle_sin", "angle_cos", "progressive_distance", "direction_to_goal_cos"]
CATEGORICAL = ["height", "body_part"]
SMALL = {"maxIter": 10, "maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 1.0}


def frame(spark, sf):
    g = pass_geometry(preprocess_passes(V.passes(spark, sf)))
    return g.withColumnRenamed("outcome", "label").withColumn("label", F.col("label").cast("double"))


def spec(**kw):
    return ML.ModelSpec(NUMERIC, CATEGORICAL, "label", {**SMALL, **kw})


@register("gbt_fit_predict")
def q_gbt_fit_predict(spark, sf):
    """ML1: fit on the training matches, score the hold-out match."""
    f = frame(spark, sf)
    return ML.fit_predict(spec(), f.where(F.col("match_id") != 7), f.where(F.col("match_id") == 7), ["pass_id"])


@register("gbt_early_stop")
def q_gbt_early_stop(spark, sf):
    """ML2: rounds used when boosting stops on a 20 % stratified validation side."""
    f = frame(spark, sf).where(F.col("match_id") != 7)
    s = spec(maxIter=30)
    model, used, _ = ML.early_stopped(s, f, "pass_id")
    return spark.createDataFrame([(int(s.params["maxIter"]), int(used))], "max_rounds int, rounds_used int")


@register("loss_curve")
def q_loss_curve(spark, sf):
    """ML3: train and validation log loss per boosting round."""
    return ML.loss_curve(spec(), frame(spark, sf).where(F.col("match_id") != 7), "pass_id")


@register("nested_cv")
def q_nested_cv(spark, sf):
    """ML4/SNK2: out-of-fold probabilities (row, fold, p) from a seeded stratified 3-fold loop."""
    return ML.cross_val_oof(spec(), frame(spark, sf), "pass_id", k=3)


@register("nested_cv_rows", FOLD_ROWS_SQL.format(k=3, label="CAST(CASE WHEN outcome IS NULL THEN 1 ELSE 0 END AS DOUBLE)", where="")
          .replace(" y, CAST((row", " y AS label, CAST((row"), views=("passes",))
def q_nested_cv_rows(spark, sf):
    """ML4/SNK2: the nested evaluation (inner search and early-stopped refit per outer fold), its out-of-fold rows
    written and read back: every row once, in its own fold."""
    rows, _ = ML.nested_evaluation(spec(), frame(spark, sf), "pass_id", scratch(spark, "oof"), outer=3, inner=2, n_trials=2)
    return rows.select("pass_id", "label", "fold")


@register("nested_cv_auto")
def q_nested_cv_auto(spark, sf):
    """ML4/FE13: nested evaluation whose automatic features are chosen and fitted inside each outer fold; loss of the
    out-of-fold rows by fold."""
    from touchline.operators.autofe import choose_formulas
    df = frame(spark, sf).where(F.col("match_id") != 7)
    small = ML.ModelSpec(["length", "angle", "duration"], ["height"], "label", {**SMALL, "maxIter": 5})

    def pick(train):
        return choose_formulas(train, ["length", "duration"], ["height"], "label", "pass_id", n=3, min_features=6)

    rows, _ = ML.nested_evaluation(small, df, "pass_id", scratch(spark, "oof"), outer=2, inner=2, n_trials=2, formulas=pick, order_col="pass_id")
    return ML.fold_losses(rows, "label")


@register("param_search")
def q_param_search(spark, sf):
    """ML5: seeded random search, mean inner-fold log loss per trial."""
    return ML.param_search(spec(), frame(spark, sf).where(F.col("match_id") != 7), "pass_id", n_trials=4, k=2)


@register("tune_and_train")
def q_tune_and_train(spark, sf):
    """ML6: 80/20 split → search on the 80 → refit with early stopping → score the 20."""
    from touchline.operators.folds import stratified_split
    from touchline.session import stored
    f = frame(spark, sf).where(F.col("match_id") != 7)
    s = stored(stratified_split(f, "pass_id", "label", 2, seed=42).select("pass_id", *NUMERIC, *CATEGORICAL, "label", "split"), "sides")
    train, test = s.where(F.col("split") == "train"), s.where(F.col("split") == "test")
    trials = ML.param_search(spec(), train, "pass_id", n_trials=2, k=2)
    model, _ = ML.refit(spec(**ML.best_params(trials)), train, "pass_id")
    pred = ML.positive_probability(model.transform(test)).withColumnRenamed("label", "y")
    ll = MT.log_loss(pred).withColumn("k", F.lit(1))
    auc = MT.roc_auc(pred).withColumn("k", F.lit(1))
    return ll.join(auc, "k").drop("k")


@register("final_train")
def q_final_train(spark, sf):
    """ML7: final fit on all training rows; training log loss."""
    f = frame(spark, sf).where(F.col("match_id") != 7)
    model = ML.fit(spec(), f)
    scored = ML.positive_probability(model.transform(f.select("pass_id", *NUMERIC, *CATEGORICAL, "label")))
    return MT.log_loss(scored.withColumnRenamed("label", "y"))


@register("rfe")
def q_rfe(spark, sf):
    """ML8: recursive elimination of all features down to 4, three per step."""
    return ML.rfe(spec(), frame(spark, sf).where(F.col("match_id") != 7), 4, step=3)


@register("forward_selection")
def q_forward_selection(spark, sf):
    """ML9: forward selection over all features by importance, three at a time, while the mean score of the folds gains ≥ 0.001."""
    return ML.forward_selection(spec(), frame(spark, sf).where(F.col("match_id") != 7), "pass_id", k=2, step=3)


@register("permutation_importance")
def q_permutation_importance(spark, sf):
    """ML12: loss increase per permuted feature on the hold-out rows."""
    f = frame(spark, sf)
    s = spec()
    model = ML.fit(s, f.where(F.col("match_id") != 7))
    return ML.permutation_importance(model, s, f.where(F.col("match_id") == 7), "pass_id")


@register("scored_rows", "SELECT pass_id, 'gbt' AS model, true AS in_range FROM passes", views=("passes",))
def q_scored_rows(spark, sf):
    """ML13: every pass is scored once, with a probability of the arg-max class between 0.5 and 1."""
    f = frame(spark, sf)
    rows = ML.batch_score(ML.fit(spec(), f.where(F.col("match_id") != 7)), f, ["pass_id"], "gbt")
    return rows.select("pass_id", "model", F.col("probability").between(0.5, 1.0).alias("in_range"))


@register("batch_score")
def q_batch_score(spark, sf):
    """ML13: arg-max label, probability, timestamp and model name for every pass."""
    f = frame(spark, sf)
    model = ML.fit(spec(), f.where(F.col("match_id") != 7))
    return ML.batch_score(model, f, ["pass_id"], "gbt")


# ---- inference frame, bundles, scored formulas, streaming --------------------------------
ROWWISE = ["(start_x+end_x)"]
FITTED = "GroupByThenMean(length,height)"
INF_FEATURES = ["length", "duration", "direction_to_goal_cos", "height", "autoFE_f_0", "autoFE_f_1"]


def _fit_transformers(spark, sf):
    from touchline.operators.encoders import CategoryCodes
    from touchline.operators.formula import FormulaEncoder
    g = frame(spark, sf)
    train = g.where(F.col("match_id") != 7)
    fitted = FormulaEncoder([FITTED]).fit_materialized(train)
    mapping = CategoryCodes.fit(V.passes(spark, sf).where(F.col("match_id") != 7), ["height"])
    return fitted, mapping


@register("inference_frame", views=("passes",), dbl=("length", "direction_to_goal_cos", "autoFE_f_1"), oracle="""
WITH g AS (SELECT pass_id, match_id, length * 0.9144 AS length, duration, height, start_x, end_x,
  cos(angle - atan2(40.0 - start_y, 120.0 - start_x)) AS direction_to_goal_cos FROM passes),
m AS (SELECT height, avg(length) AS v FROM g WHERE match_id <> 7 AND height IS NOT NULL GROUP BY 1)
SELECT g.pass_id, g.length, g.duration, g.direction_to_goal_cos,
  CASE WHEN g.height IN (SELECT DISTINCT height FROM g WHERE match_id <> 7) THEN g.height END AS height,
  g.start_x + g.end_x AS autoFE_f_0, m.v AS autoFE_f_1 FROM g LEFT JOIN m ON g.height = m.height""")
def q_inference_frame(spark, sf):
    """FE16: the frame a scorer sees, built from raw passes with training-time state."""
    from touchline.operators.inference import inference_frame
    fitted, mapping = _fit_transformers(spark, sf)
    return inference_frame(V.passes(spark, sf), ROWWISE, fitted, INF_FEATURES, mapping, keep=["pass_id"])


def _bundle(spark, sf):
    from touchline.operators.inference import inference_frame, save_bundle
    fitted, mapping = _fit_transformers(spark, sf)
    raw = V.passes(spark, sf)
    fr = inference_frame(raw.where(F.col("match_id") != 7), ROWWISE, fitted, INF_FEATURES, mapping,
                         keep=["pass_id", "outcome"])
    fr = fr.withColumn("label", F.when(F.col("outcome").isNull(), 1.0).otherwise(0.0))
    spec = ML.ModelSpec(["length", "duration", "direction_to_goal_cos", "autoFE_f_0", "autoFE_f_1"], ["height"],
                        "label", dict(SMALL))
    model = ML.fit(spec, fr)
    path = scratch(spark, "bundle")
    save_bundle(path, model, fitted, ROWWISE, INF_FEATURES, mapping, spark)
    return path


@register("bundle_roundtrip")
def q_bundle_roundtrip(spark, sf):
    """SNK3 + SRC7: train, freeze a bundle, load it back, score the hold-out match."""
    from touchline.operators.inference import inference_frame, load_bundle
    path = _bundle(spark, sf)
    model, fitted, rowwise, feats, mapping = load_bundle(spark, path)
    fr = inference_frame(V.passes(spark, sf).where(F.col("match_id") == 7), rowwise, fitted, feats, mapping,
                         keep=["pass_id"])
    return ML.batch_score(model, fr, ["pass_id"], "gbt")


@register("load_scored_formulas", S1_SQL.replace("END AS feature, score FROM s", "END AS formula, score FROM s"),
          views=("passes",), dbl=("score",))
def q_load_scored_formulas(spark, sf):
    """FE17: stage-1 scores written as text lines, read back and parsed (bad lines skipped)."""
    from touchline.operators.autofe import stage1_scores
    from touchline.operators.inference import parse_scored_formulas
    s = stage1_scores(with_split(pre(spark, sf)), S1, "outcome", "split")
    lines = s.select(F.concat_ws(" ", "feature", F.col("score").cast("string")).alias("value"))
    lines = lines.unionByName(spark.createDataFrame([("not-a-formula 1.0",), ("",)], "value string"))
    path = scratch(spark, "formulas_txt")
    lines.write.text(path)
    return parse_scored_formulas(spark.read.text(path))


@register("streaming_score")
def q_streaming_score(spark, sf):
    """STR1: passes arrive as parquet files; a streaming job validates, builds the
    inference frame and scores them with a frozen bundle (availableNow)."""
    from touchline.operators.inference import load_bundle
    from touchline.sources.io import write_passes
    from touchline.streaming.score import start_scoring
    path = _bundle(spark, sf)
    model, fitted, rowwise, feats, mapping = load_bundle(spark, path)
    src, sink, ck = scratch(spark, "arrivals"), scratch(spark, "scored"), scratch(spark, "stream-ckpt")
    write_passes(V.passes(spark, sf), src)
    q = start_scoring(spark, src, sink, ck, model, fitted, rowwise, feats, mapping, max_files=16)
    q.awaitTermination()
    return spark.read.parquet(f"{sink}/scored")

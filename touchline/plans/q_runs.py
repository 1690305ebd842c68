"""Queries over the experiment-run view R."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.functions.scalar import try_cast
from touchline.operators import runs as RU
from touchline.plans.registry import register
from touchline.sources import views as V

TS = "'%Y-%m-%d %H:%M:%S'"
PREP_SQL = f"""
t AS (SELECT *, coalesce(lower(trim(feature_engineering)) = 'true', false) AS fe,
        coalesce(lower(trim(openfe)) = 'true', false) AS ofe,
        coalesce(lower(trim(hyperparameter_tuning)) = 'true', false) AS hp
      FROM runs WHERE parent_run_id IS NOT NULL),
u AS (SELECT *, (ofe OR contains(coalesce(selected_features, ''), 'ofe_col_')) AS openfe_effective,
        CAST(date_diff('second', try_strptime(start_text, {TS}), try_strptime(end_text, {TS})) AS DOUBLE)
          AS training_time_sec
      FROM t WHERE model_type IS NOT NULL),
v AS (SELECT *, CASE concat_ws('|', lower(CAST(fe AS VARCHAR)), lower(categorical_handling),
        lower(CAST(openfe_effective AS VARCHAR)), lower(CAST(hp AS VARCHAR)))
        WHEN 'false|native|false|false' THEN 'Baseline' WHEN 'true|native|false|false' THEN 'FE+Cat'
        WHEN 'true|ohe|false|false' THEN 'FE+OHE' WHEN 'true|native|true|false' THEN 'FE+Cat+OFE'
        WHEN 'true|native|true|true' THEN 'FE+Cat+OFE+HP' END AS experiment_label FROM u),
prepared AS (SELECT *, CASE experiment_label WHEN 'Baseline' THEN 0 WHEN 'FE+Cat' THEN 1 WHEN 'FE+OHE' THEN 2
        WHEN 'FE+Cat+OFE' THEN 3 WHEN 'FE+Cat+OFE+HP' THEN 4 ELSE 999 END AS experiment_order
      FROM v WHERE experiment_label IS NOT NULL)"""


def runs(spark, sf):
    return V.runs(spark, sf)


def prepared(spark, sf):
    return RU.prepared_runs(runs(spark, sf))


@register("prepared_runs", f"WITH {PREP_SQL} SELECT run_id, model_type, experiment_label, experiment_order, "
          "openfe_effective, training_time_sec FROM prepared", views=("runs",))
def q_prepared_runs(spark, sf):
    return prepared(spark, sf).select("run_id", "model_type", "experiment_label", "experiment_order",
                                      "openfe_effective", "training_time_sec") \
        .orderBy("experiment_order", "model_type")


METRIC_SQL = """SELECT model_type, experiment_label, avg(m) AS mean, stddev_samp(m) AS std, count(m) AS count,
  min(experiment_order) AS experiment_order, 1.96 * stddev_samp(m) AS error_bar
FROM (SELECT *, {expr} AS m FROM prepared {where}) x WHERE m IS NOT NULL GROUP BY 1, 2"""


@register("metric_by_experiment",
          f"WITH {PREP_SQL} " + METRIC_SQL.format(expr="try_cast(log_loss AS DOUBLE)", where=""),
          views=("runs",), dbl=("mean", "std", "error_bar"))
def q_metric_by_experiment(spark, sf):
    return RU.metric_by_experiment(prepared(spark, sf)).orderBy("experiment_order", "model_type")


@register("time_by_experiment",
          f"WITH {PREP_SQL} " + METRIC_SQL.format(expr="ln(training_time_sec)", where="WHERE training_time_sec > 0"),
          views=("runs",), dbl=("mean", "std", "error_bar"))
def q_time_by_experiment(spark, sf):
    return RU.time_by_experiment(prepared(spark, sf))


@register("distinct_labels", f"WITH {PREP_SQL} SELECT DISTINCT experiment_label, experiment_order FROM prepared",
          views=("runs",))
def q_distinct_labels(spark, sf):
    """AGG36."""
    return prepared(spark, sf).select("experiment_label", "experiment_order").dropDuplicates() \
        .orderBy("experiment_order")


GEN_SQL = """SELECT k.parent_run_id AS parent, count(k.loss) AS n, avg(k.loss) AS mean, stddev_samp(k.loss) AS std,
  stddev_pop(k.loss) AS std_pop, 1.96 * stddev_samp(k.loss) / sqrt(count(k.loss)) AS ci_half_width
FROM (SELECT parent_run_id, try_cast(log_loss AS DOUBLE) AS loss FROM runs WHERE parent_run_id IS NOT NULL) k
JOIN (SELECT run_id FROM runs WHERE parent_run_id IS NULL) p ON k.parent_run_id = p.run_id
WHERE k.loss IS NOT NULL GROUP BY 1"""


@register("generalisation_error", GEN_SQL, views=("runs",), dbl=("mean", "std", "std_pop", "ci_half_width"))
def q_generalisation_error(spark, sf):
    return RU.generalisation_error(runs(spark, sf))


@register("fold_summary", f"SELECT parent, mean, std_pop FROM ({GEN_SQL}) g", views=("runs",),
          dbl=("mean", "std_pop"))
def q_fold_summary(spark, sf):
    """AGG4: mean and population std of fold losses per parent."""
    return RU.generalisation_error(runs(spark, sf)).select("parent", "mean", "std_pop")


@register("training_seconds",
          f"SELECT run_id, CAST(date_diff('second', try_strptime(start_text, {TS}), try_strptime(end_text, {TS})) "
          "AS DOUBLE) AS training_time_sec FROM runs", views=("runs",))
def q_training_seconds(spark, sf):
    return runs(spark, sf).select("run_id", RU.training_seconds().alias("training_time_sec"))


@register("log_training_time",
          f"SELECT run_id, ln(t) AS log_training_time FROM (SELECT run_id, CAST(date_diff('second', "
          f"try_strptime(start_text, {TS}), try_strptime(end_text, {TS})) AS DOUBLE) AS t FROM runs) x WHERE t > 0",
          views=("runs",), dbl=("log_training_time",))
def q_log_training_time(spark, sf):
    """SC30."""
    r = runs(spark, sf).select("run_id", RU.training_seconds().alias("t"))
    return r.where(F.col("t") > 0).select("run_id", F.ln("t").alias("log_training_time"))


@register("selected_features",
          "SELECT run_id, CAST(generate_subscripts(string_split(selected_features, ','), 1) - 1 AS INTEGER) AS pos, "
          "unnest(string_split(selected_features, ',')) AS feature FROM runs WHERE selected_features IS NOT NULL",
          views=("runs",))
def q_selected_features(spark, sf):
    return RU.selected_features(runs(spark, sf))


LR_SQL = "CASE WHEN seconds % 13 = 0 THEN NULL ELSE seconds / 1e4 END"


@register("typed_params", f"""SELECT run_id, model_type,
  CASE WHEN model_type IN ('lightgbm','xgboost','catboost') THEN coalesce({LR_SQL}, 0.1) END AS learning_rate,
  CASE WHEN model_type IN ('lightgbm','xgboost') THEN CAST(100 AS BIGINT) END AS n_estimators,
  CASE WHEN model_type = 'lightgbm' THEN CAST(seconds % 60 + 2 AS BIGINT) END AS num_leaves,
  CASE WHEN model_type = 'xgboost' THEN CAST(seconds % 10 + 1 AS BIGINT) END AS max_depth,
  CASE WHEN model_type = 'catboost' THEN CAST(seconds % 8 + 2 AS BIGINT) END AS depth,
  CASE WHEN model_type = 'catboost' THEN CAST(100 AS BIGINT) END AS iterations
FROM runs""", views=("runs",), dbl=("learning_rate",))
def q_typed_params(spark, sf):
    return RU.typed_params(RU.params_map(runs(spark, sf)))


@register("effective_params", f"""SELECT run_id, model_type,
  CASE WHEN model_type IN ('lightgbm','xgboost','catboost') THEN {LR_SQL} END AS learning_rate,
  CASE WHEN model_type IN ('lightgbm','xgboost') THEN CAST(seconds % 300 + 1 AS VARCHAR) END AS n_estimators,
  CASE WHEN model_type = 'lightgbm' THEN CAST(seconds % 60 + 2 AS VARCHAR) END AS num_leaves,
  CASE WHEN model_type = 'xgboost' THEN CAST(seconds % 10 + 1 AS VARCHAR) END AS max_depth,
  CASE WHEN model_type = 'catboost' THEN CAST(seconds % 8 + 2 AS VARCHAR) END AS depth,
  CAST(CASE WHEN model_type IN ('lightgbm','xgboost') THEN 3 WHEN model_type = 'catboost' THEN 2 ELSE 0 END AS BIGINT)
    AS n_keys
FROM runs""", views=("runs",), dbl=("learning_rate",))
def q_effective_params(spark, sf):
    e = RU.effective_params(RU.params_map(runs(spark, sf)))
    p = F.col("effective_params")
    return e.select("run_id", "model_type",
                    try_cast(F.try_element_at(p, F.lit("learning_rate")), "double").alias("learning_rate"),
                    *[F.try_element_at(p, F.lit(k)).alias(k) for k in ("n_estimators", "num_leaves", "max_depth",
                                                                       "depth")],
                    F.size(p).cast("bigint").alias("n_keys"))


@register("latest_parent_run", "SELECT run_id, start_time, model_type FROM runs WHERE parent_run_id IS NULL "
          "ORDER BY start_time DESC, run_id LIMIT 1", views=("runs",))
def q_latest_parent_run(spark, sf):
    return RU.latest_parent_run(runs(spark, sf)).select("run_id", "start_time", "model_type")


@register("best_trial", """WITH k AS (SELECT parent_run_id, run_id, try_cast(log_loss AS DOUBLE) AS loss FROM runs
  WHERE parent_run_id IS NOT NULL AND try_cast(log_loss AS DOUBLE) IS NOT NULL),
m AS (SELECT parent_run_id, min(loss) AS ml FROM k GROUP BY 1)
SELECT k.parent_run_id, min(k.run_id) AS best_run_id, min(k.loss) AS best_loss FROM k JOIN m
  ON k.parent_run_id = m.parent_run_id AND k.loss = m.ml GROUP BY 1""", views=("runs",))
def q_best_trial(spark, sf):
    return RU.best_trial(runs(spark, sf))


@register("experiment_runs", "SELECT run_id, start_time, model_type FROM runs ORDER BY start_time DESC, run_id",
          views=("runs",))
def q_experiment_runs(spark, sf):
    """SRC6: the whole listing, newest first."""
    return RU.experiment_runs(runs(spark, sf)).select("run_id", "start_time", "model_type")


@register("append_runs", "SELECT run_id, parent_run_id, model_type, log_loss FROM runs", views=("runs",))
def q_append_runs(spark, sf):
    """SNK4: child rows written, parent rows appended, table read back."""
    from touchline.sources.io import append_runs, scratch
    path = scratch(spark, "runs")
    r = runs(spark, sf).select("run_id", "parent_run_id", "model_type", "log_loss")
    append_runs(r.where(F.col("parent_run_id").isNotNull()), path)
    append_runs(r.where(F.col("parent_run_id").isNull()), path)
    return spark.read.parquet(path)

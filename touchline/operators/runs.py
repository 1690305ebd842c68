"""Experiment-run tables: tag parsing, labels, training time, metric summaries,
parameters and run selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalar import tolerant_bool, try_cast

# Tag configuration (feature_engineering, categorical_handling, openfe,
# hyperparameter_tuning) → experiment label.
EXPERIMENT_LABELS = {
    (False, "native", False, False): "Baseline",
    (True, "native", False, False): "FE+Cat",
    (True, "OHE", False, False): "FE+OHE",
    (True, "native", True, False): "FE+Cat+OFE",
    (True, "native", True, True): "FE+Cat+OFE+HP",
}
LABEL_ORDER = ["Baseline", "FE+Cat", "FE+OHE", "FE+Cat+OFE", "FE+Cat+OFE+HP"]
UNLISTED_ORDER = 999

# Accepted parameters and defaults per learner.
PARAM_DEFAULTS = {
    "lightgbm": {"colsample_bytree": 1.0, "learning_rate": 0.1, "num_leaves": 31, "n_estimators": 100,
                 "reg_alpha": 0.0, "reg_lambda": 0.0, "subsample": 1.0},
    "xgboost": {"n_estimators": 100, "max_depth": 6, "grow_policy": "depthwise", "learning_rate": 0.1,
                "subsample": 1.0, "colsample_bytree": 1.0, "reg_alpha": 0.0, "reg_lambda": 0.0},
    "catboost": {"iterations": 100, "depth": 6, "learning_rate": 0.1, "reg_lambda": 0.0},
}
CI_Z = 1.96


def _key(fe, cat, ofe, hp) -> str:
    return f"{str(fe).lower()}|{cat.lower()}|{str(ofe).lower()}|{str(hp).lower()}"


def training_seconds(start_text: str = "start_text", end_text: str = "end_text"):
    """SC29: text → timestamp (bad text → null); difference in whole seconds of wall
    clock (timestamp_ntz, so the session time zone and DST cannot shift it)."""
    s = F.try_to_timestamp(F.col(start_text)).cast("timestamp_ntz")
    e = F.try_to_timestamp(F.col(end_text)).cast("timestamp_ntz")
    return F.timestamp_diff("SECOND", s, e).cast("double")


def prepared_runs(runs: DataFrame, labels=LABEL_ORDER, model_col: str = "model_type") -> DataFrame:
    """ML18: child runs with parsed tags, effective automatic-feature flag, experiment label
    and order, training seconds.  Label lookup is a literal map (5 entries)."""
    label_map = F.create_map(*[F.lit(x) for k, v in EXPERIMENT_LABELS.items() for x in (_key(*k), v)])
    order_map = F.create_map(*[F.lit(x) for i, lab in enumerate(labels) for x in (lab, i)])
    fe = tolerant_bool("feature_engineering")
    ofe = tolerant_bool("openfe")
    hp = tolerant_bool("hyperparameter_tuning")
    sel = F.coalesce(F.col("selected_features"), F.lit(""))
    ofe_eff = ofe | sel.contains("ofe_col_")
    key = F.concat_ws("|", F.lower(fe.cast("string")), F.lower(F.col("categorical_handling")),
                      F.lower(ofe_eff.cast("string")), F.lower(hp.cast("string")))
    df = (runs.where(F.col("parent_run_id").isNotNull())
          .withColumns({"feature_engineering_flag": fe, "openfe_flag": ofe, "hyperparameter_tuning_flag": hp,
                        "openfe_effective": ofe_eff,
                        "training_time_sec": training_seconds()})
          .where(F.col(model_col).isNotNull())
          .withColumn("experiment_label", F.try_element_at(label_map, key))
          .where(F.col("experiment_label").isNotNull())
          .withColumn("experiment_order",
                      F.coalesce(F.try_element_at(order_map, F.col("experiment_label")), F.lit(UNLISTED_ORDER))))
    return df


def metric_by_experiment(prepared: DataFrame, metric: str = "log_loss", model_col: str = "model_type") -> DataFrame:
    """AGG2/ML19: mean, sample std, count and order per (model, label); a metric that
    does not parse as a number is dropped.  Error bar = 1.96 · std."""
    m = try_cast(F.col(metric).cast("string"), "double") if metric in prepared.columns else None
    df = prepared.withColumn("__m", m).where(F.col("__m").isNotNull() & F.col(model_col).isNotNull())
    return df.groupBy(model_col, "experiment_label").agg(
        F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("std"), F.count("__m").alias("count"),
        F.min("experiment_order").alias("experiment_order"),
    ).withColumn("error_bar", F.lit(CI_Z) * F.col("std"))


def time_by_experiment(prepared: DataFrame, model_col: str = "model_type") -> DataFrame:
    """ML19 time form: metric = ln(training seconds) for runs with time > 0 (SC30)."""
    p = prepared.where(F.col("training_time_sec") > 0).withColumn(
        "log_training_time", F.ln(F.col("training_time_sec")))
    return metric_by_experiment(p, "log_training_time", model_col)


def generalisation_error(runs: DataFrame, metric: str = "log_loss") -> DataFrame:
    """AGG3 + JN5: children of each parent run (self join) → n, mean, sample std,
    95 % half width 1.96·std/√n; population std as the fold summary (AGG4)."""
    parents = runs.where(F.col("parent_run_id").isNull()).select(F.col("run_id").alias("parent"))
    kids = runs.where(F.col("parent_run_id").isNotNull()).select(
        F.col("parent_run_id").alias("parent"), try_cast(F.col(metric), "double").alias("loss"))
    j = kids.join(parents, "parent", "inner").where(F.col("loss").isNotNull())
    return j.groupBy("parent").agg(
        F.count("loss").alias("n"), F.avg("loss").alias("mean"),
        F.stddev_samp("loss").alias("std"), F.stddev_pop("loss").alias("std_pop"),
    ).withColumn("ci_half_width", F.lit(CI_Z) * F.col("std") / F.sqrt(F.col("n")))


def latest_parent_run(runs: DataFrame, model: str | None = None) -> DataFrame:
    """TOP2: newest run without a parent (optionally of one model); ties → lowest run id."""
    r = runs.where(F.col("parent_run_id").isNull())
    if model is not None:
        r = r.where(F.col("model_type") == F.lit(model))
    return r.orderBy(F.col("start_time").desc(), F.col("run_id")).limit(1)


def best_trial(runs: DataFrame, metric: str = "log_loss") -> DataFrame:
    """TOP7: per parent, the child with the minimum loss (ties → lowest run id);
    one ``min`` over a (loss, run_id) struct, so no window or sort."""
    k = runs.where(F.col("parent_run_id").isNotNull()).select(
        "parent_run_id", "run_id", try_cast(F.col(metric), "double").alias("loss")) \
        .where(F.col("loss").isNotNull())
    best = k.groupBy("parent_run_id").agg(F.min(F.struct("loss", "run_id")).alias("b"))
    return best.select("parent_run_id", F.col("b.run_id").alias("best_run_id"), F.col("b.loss").alias("best_loss"))


def params_map(runs: DataFrame) -> DataFrame:
    """Parameter map of each run as the run table stores it (text values)."""
    s = F.col("seconds")
    lr = F.when(s % 13 == 0, F.lit("bad")).otherwise((s / F.lit(1e4)).cast("string"))
    return runs.withColumn("params", F.create_map(
        F.lit("learning_rate"), lr,
        F.lit("n_estimators_used"), (s % 300 + 1).cast("string"),
        F.lit("num_leaves"), (s % 60 + 2).cast("string"),
        F.lit("max_depth"), (s % 10 + 1).cast("string"),
        F.lit("depth"), (s % 8 + 2).cast("string"),
        F.lit("unused"), F.lit("1")))


def effective_params(runs_with_params: DataFrame, model_col: str = "model_type") -> DataFrame:
    """FLT17: keep only keys the learner accepts; ``n_estimators := n_estimators_used``
    where the learner has ``n_estimators``."""
    acc = F.create_map(*[x for m, d in PARAM_DEFAULTS.items()
                         for x in (F.lit(m), F.array(*[F.lit(k) for k in d]))])
    accepted = F.coalesce(F.try_element_at(acc, F.col(model_col)), F.array().cast("array<string>"))
    kept = F.map_filter("params", lambda k, v: F.array_contains(accepted, k) & (k != F.lit("n_estimators")))
    used = F.try_element_at(F.col("params"), F.lit("n_estimators_used"))
    add = F.when(F.array_contains(accepted, F.lit("n_estimators")) & used.isNotNull(),
                 F.create_map(F.lit("n_estimators"), used)) \
        .otherwise(F.create_map().cast("map<string,string>"))
    return runs_with_params.withColumn("effective_params", F.map_concat(kept, add))


def typed_params(runs_with_params: DataFrame, model_col: str = "model_type") -> DataFrame:
    """SC34: typed parameters from text with the learner's defaults."""
    def num(key, typ, default):
        v = try_cast(F.try_element_at(F.col("params"), F.lit(key)), typ)
        return F.coalesce(v, F.lit(default).cast(typ))
    m = F.col(model_col)
    lr = num("learning_rate", "double", 0.1)
    return runs_with_params.select(
        "run_id", model_col,
        F.when(m.isin(*PARAM_DEFAULTS), lr).alias("learning_rate"),
        F.when(m.isin("lightgbm", "xgboost"), num("n_estimators", "bigint", 100)).alias("n_estimators"),
        F.when(m == "lightgbm", num("num_leaves", "bigint", 31)).alias("num_leaves"),
        F.when(m == "xgboost", num("max_depth", "bigint", 6)).alias("max_depth"),
        F.when(m == "catboost", num("depth", "bigint", 6)).alias("depth"),
        F.when(m == "catboost", num("iterations", "bigint", 100)).alias("iterations"),
    )


def selected_features(runs: DataFrame) -> DataFrame:
    """SC33: comma list → one row per feature (with its position)."""
    return runs.where(F.col("selected_features").isNotNull()).select(
        "run_id", F.posexplode(F.split("selected_features", ",")).alias("pos", "feature"))


def experiment_runs(runs: DataFrame, page_size: int | None = None, page: int = 0) -> DataFrame:
    """SRC6: runs of an experiment, newest first: all of them, or one page."""
    out = runs.orderBy(F.col("start_time").desc(), F.col("run_id"))
    return out if page_size is None else out.offset(page * page_size).limit(page_size)

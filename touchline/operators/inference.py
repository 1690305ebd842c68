"""Inference frames and scoring bundles.

A bundle is a folder: the fitted formula state (lookup tables), the model
(feature stages and trees), the selected feature list, the category mapping and a one-row
manifest, all written with Spark writers and read back on any node.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.operators.encoders import CategoryCodes
from touchline.operators.formula import FittedFormulas, rowwise_features
from touchline.operators.passes import feature_aliases, pass_geometry, preprocess_passes
from touchline.sources.tables import require_columns


def inference_frame(raw: DataFrame, rowwise: list[str], fitted: FittedFormulas | None, features: list[str],
                    mapping: CategoryCodes | None, keep: list[str] = ()) -> DataFrame:
    """FE16: geometry → row-wise formulas → fitted formulas → legacy aliases →
    feature selection (missing → error) → saved category mapping."""
    g = pass_geometry(preprocess_passes(raw)) if "log_velocity" not in raw.columns else raw
    if rowwise:
        g = rowwise_features(g, rowwise)
    if fitted is not None:
        g = fitted.transform(g)
    formulas = list(rowwise) + ([f for f in fitted.formulas] if fitted is not None else [])
    g = feature_aliases(g, formulas)
    require_columns(g, features)
    out = g.select(*keep, *[F.col(f"`{f}`") for f in features])
    return mapping.apply(out) if mapping is not None else out


def save_bundle(path: str, model, fitted: FittedFormulas | None, rowwise: list[str],
                features: list[str], mapping: CategoryCodes, spark: SparkSession, model_type: str = "gbt") -> None:
    """SNK3: freeze everything scoring needs."""
    model.save(os.path.join(path, "model"), spark)
    if fitted is not None:
        fitted.save(os.path.join(path, "formulas"))
    manifest = {"model_type": model_type, "rowwise": rowwise, "selected_features": features,
                "categorical_mapping": json.loads(mapping.to_json()), "has_formulas": fitted is not None}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1) \
        .write.mode("overwrite").text(os.path.join(path, "manifest"))


def load_bundle(spark: SparkSession, path: str):
    """SRC7: read a bundle; ``best_features`` / ``params`` fall back to their older
    names ``selected_features`` / ``best_params``."""
    try:
        manifest = json.loads(spark.read.text(os.path.join(path, "manifest")).first()[0])
    except Exception as e:  # missing folder → a clear error instead of an analysis stack
        raise FileNotFoundError(f"bundle at {path} has no manifest") from e
    feats = manifest.get("best_features") or manifest.get("selected_features")
    from touchline.operators.modeling import GradientModel
    model = GradientModel.load(os.path.join(path, "model"), spark)
    fitted = FittedFormulas.load(spark, os.path.join(path, "formulas")) if manifest.get("has_formulas") else None
    mapping = CategoryCodes(manifest.get("categorical_mapping", {}))
    return model, fitted, manifest.get("rowwise", []), feats, mapping


def parse_scored_formulas(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """FE17: ``formula score`` lines → (formula, score); lines without a score or
    whose formula does not end with ')' are skipped."""
    parts = F.split(F.col(text_col), " ")
    f = parts.getItem(0)
    ok = (F.size(parts) > 1) & (F.length(f) > 0) & f.endswith(")")
    return lines.where(ok).select(f.alias("formula"), parts.getItem(1).try_cast("double").alias("score"))

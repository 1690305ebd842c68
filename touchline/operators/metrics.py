"""Evaluation metrics as aggregations over a scored table (label y, probability p).

All metrics are one ``groupBy().agg`` (partial aggregation map-side) except the
ROC family, which needs cumulative counts over the score order: scores are
grouped first (ties collapse), then an exact two-level prefix sum
(``ordinal.prefix_sum``) replaces a one-partition window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.ordinal import prefix_sum
from touchline.session import cut_lineage

EPS = 2.220446049250313e-16          # float64 machine epsilon, the probability clip
# Inner bin edges of a 10-bin uniform calibration curve, as i * 0.1 in float64.
CALIBRATION_EDGES = [i * 0.1 for i in range(1, 10)]


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))


def log_loss_of(y: Column, p: Column) -> Column:
    pc = _clip(p)
    return -F.when(y == 1, F.ln(pc)).otherwise(F.ln(F.lit(1.0) - pc))


def log_loss_expr(y: str = "y", p: str = "p") -> Column:
    return log_loss_of(F.col(y), F.col(p))


def log_loss(df: DataFrame, by: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """AGG23: mean negative log-likelihood of the true class (binary).  Rows without
    a label or a probability are left out."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(F.avg(log_loss_expr(y, p)).alias("log_loss"), F.count(F.lit(1)).alias("n"))


def softmax_log_loss(df: DataFrame, margins: str, label: str, by: list[str] = ()) -> DataFrame:
    """AGG24 multiclass: softmax over an array of margins (max-shifted), −ln of the
    true class, averaged.  Array work stays in JVM higher-order functions."""
    m = F.col(margins)
    mx = F.array_max(m)
    lse = mx + F.ln(F.aggregate(m, F.lit(0.0), lambda acc, x: acc + F.exp(x - mx)))
    true_m = F.element_at(m, F.col(label).cast("int") + 1)
    nll = F.least(lse - true_m, F.lit(-math.log(EPS)))
    return df.groupBy(*by).agg(F.avg(nll).alias("multi_log_loss"), F.count(F.lit(1)).alias("n"))


def rmse(df: DataFrame, y: str, pred: str, by: list[str] = ()) -> DataFrame:
    d = F.col(y).cast("double") - F.col(pred)
    return df.groupBy(*by).agg(F.sqrt(F.avg(d * d)).alias("rmse"))


def r2_score(df: DataFrame, y: str, pred: str, by: list[str] = ()) -> DataFrame:
    """AGG35: 1 − SS_res/SS_tot in one pass; the total is the centred variance times
    the rows, which large values do not wash out.  Rows without a label or a
    prediction are left out; a constant label has no R² (null)."""
    yy = F.col(y).cast("double")
    d = yy - F.col(pred)
    ss_tot = F.var_pop(yy) * F.count(yy)
    rows = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    return rows.groupBy(*by).agg((F.lit(1.0) - F.try_divide(F.sum(d * d), ss_tot)).alias("r2"))


def score_counts(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Positives and negatives per distinct score (ties collapse before any ordering).
    Rows without a label or a score are left out."""
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*by, p).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"),
                                  F.sum(F.when(F.col(y) == 1, 0).otherwise(1)).alias("neg"))


def roc_points(df: DataFrame, by: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """AGG26 data: for each distinct threshold (descending), cumulative true and
    false positives → tpr, fpr.  Every distinct threshold is kept (no collinear-point
    thinning)."""
    by = list(by)
    sc = cut_lineage(score_counts(df, by, y, p))                         # for cut points, totals and sums
    cum = prefix_sum(sc, by, [p], {"tp": F.col("pos"), "fp": F.col("neg")}, descending=True, inclusive=True,
                     totals={"n_pos": "tp", "n_neg": "fp"})
    return cum.select(*by, F.col(p).alias("threshold"), "tp", "fp",
                    F.try_divide(F.col("tp"), F.col("n_pos")).cast("double").alias("tpr"),
                    F.try_divide(F.col("fp"), F.col("n_neg")).cast("double").alias("fpr"), "pos", "neg", "n_pos", "n_neg")


def roc_auc(df: DataFrame, by: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """AGG25: tie-aware AUC = Σ_scores neg · (positives above + pos/2) / (P·N)."""
    by = list(by)
    pts = roc_points(df, by, y, p)
    contrib = F.col("neg").cast("double") * (F.col("tp") - F.col("pos") + F.col("pos") / 2.0)
    pairs = F.first("n_pos").cast("double") * F.first("n_neg").cast("double")
    return pts.groupBy(*by).agg(F.try_divide(F.sum(contrib), pairs).alias("roc_auc"))


def classification_metrics(df: DataFrame, by: list[str] = (), y: str = "y", pred: str = "prediction") -> DataFrame:
    """AGG27: accuracy, precision, recall, F1 from one conditional-sum aggregation;
    empty denominators → 0.  Rows without a label or a prediction are left out."""
    df = df.where(F.col(y).isNotNull() & F.col(pred).isNotNull())
    yy, pp = F.col(y) == 1, F.col(pred) == 1
    agg = df.groupBy(*by).agg(
        F.sum((yy & pp).cast("long")).alias("tp"), F.sum((~yy & pp).cast("long")).alias("fp"),
        F.sum((yy & ~pp).cast("long")).alias("fn"), F.sum((~yy & ~pp).cast("long")).alias("tn"))
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    acc = (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return agg.select(*by, "tp", "fp", "fn", "tn", acc.cast("double").alias("accuracy"),
                      prec.cast("double").alias("precision"), rec.cast("double").alias("recall"),
                      f1.cast("double").alias("f1"))


def evaluation(df: DataFrame, by: list[str], y: str = "y", p: str = "p", pred: str = "prediction") -> DataFrame:
    """ML11: log loss, accuracy, precision, recall, F1 and AUC of scored rows per
    group; three aggregations over one frame, joined on its few groups."""
    base = log_loss(df, by, y, p)
    rates = classification_metrics(df, by, y, pred).select(*by, "accuracy", "precision", "recall", "f1")
    return base.join(rates, by).join(roc_auc(df, by, y, p), by).select(
        *by, "log_loss", "accuracy", "precision", "recall", "f1", "roc_auc", "n")


def calibration_bin(p: str = "p") -> Column:
    """Bin = number of inner edges strictly below p (10 uniform bins)."""
    return sum((F.col(p) > F.lit(e)).cast("int") for e in CALIBRATION_EDGES)


def calibration_curve(df: DataFrame, by: list[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """AGG28: per non-empty bin, mean predicted probability and positive rate."""
    return df.groupBy(*by, calibration_bin(p).alias("bin")).agg(
        F.avg(p).alias("prob_pred"), F.avg(F.col(y).cast("double")).alias("prob_true"),
        F.count(F.lit(1)).alias("n"))


def sequence_probability(df: DataFrame, seq_cols: list[str], p: str = "p", xg: float | str = 0.02415) -> DataFrame:
    """AGG29: P(goal) = xG × Π p over the passes of a sequence: exp(Σ ln p), and 0 as
    soon as one p is 0 (ln 0 is null and would be skipped)."""
    xg_col = F.lit(float(xg)) if not isinstance(xg, str) else F.first(xg)
    chain = F.when(F.min(p) <= 0, F.lit(0.0)).otherwise(F.exp(F.sum(F.ln(F.col(p)))))
    return df.groupBy(*seq_cols).agg(chain.alias("pass_chain_probability"), F.count(F.lit(1)).alias("n_passes"),
                                     (chain * xg_col).alias("goal_probability"))


def true_class_probability(y: str = "y", p: str = "p") -> Column:
    """SC24."""
    return F.when(F.col(y) == 1, F.col(p)).otherwise(F.lit(1.0) - F.col(p))


def predicted_class_probability(pred: str = "prediction", p: str = "p") -> Column:
    """SC23."""
    return F.when(F.col(pred) == 1, F.col(p)).otherwise(F.lit(1.0) - F.col(p))


def argmax_label(probs: Column) -> tuple[Column, Column]:
    """ML13 label rule: arg-max class over a probability array (ties → lower class)
    and its probability."""
    mx = F.array_max(probs)
    return (F.array_position(probs, mx) - 1).cast("int"), mx


def init_metric(df: DataFrame, metric: str, label: str = "y", margin: str = "margin") -> DataFrame:
    """AGG24 dispatch: baseline metric of raw margins by name; any other name raises.
    binary_logloss / auc use sigmoid(margin); multi_logloss expects an array of
    margins; rmse compares the margin with the label."""
    if metric == "binary_logloss":
        return log_loss(df.withColumn("__p", F.lit(1.0) / (1 + F.exp(-F.col(margin)))), y=label, p="__p")
    if metric == "multi_logloss":
        return softmax_log_loss(df, margin, label)
    if metric == "rmse":
        return rmse(df, label, margin)
    if metric == "auc":
        return roc_auc(df.withColumn("__p", F.lit(1.0) / (1 + F.exp(-F.col(margin)))), y=label, p="__p")
    raise NotImplementedError(f"Metric {metric} is not supported; choose binary_logloss, multi_logloss, rmse or auc")

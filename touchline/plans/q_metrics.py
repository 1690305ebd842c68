"""Metric queries over the scored view S."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators import metrics as MT
from touchline.plans.registry import register
from touchline.sources import views as V

EPS = MT.EPS
CLIP = f"least(greatest(p, {EPS!r}), 1.0 - {EPS!r})"
LL_SQL = f"-CASE WHEN y = 1 THEN ln({CLIP}) ELSE ln(1.0 - {CLIP}) END"


def sc(spark, sf):
    return V.scored(spark, sf)


@register("log_loss", f"SELECT match_id, avg({LL_SQL}) AS log_loss, count(*) AS n FROM scored GROUP BY 1",
          views=("scored",), dbl=("log_loss",))
def q_log_loss(spark, sf):
    return MT.log_loss(sc(spark, sf), ["match_id"])


# three-class view of S: class = match_id % 3, margins built from p
MC_MARGINS = "array(p, 1e0 - p, p * p)"


@register("multi_log_loss", """SELECT match_id % 2 AS half, avg(least(lse - tm, 36.04365338911715)) AS multi_log_loss,
  count(*) AS n FROM (SELECT match_id, m0, m1, m2, CASE match_id % 3 WHEN 0 THEN m0 WHEN 1 THEN m1 ELSE m2 END AS tm,
  mx + ln(exp(m0 - mx) + exp(m1 - mx) + exp(m2 - mx)) AS lse FROM (SELECT match_id, p AS m0, 1e0 - p AS m1, p * p AS m2,
  greatest(p, 1e0 - p, p * p) AS mx FROM scored) a) b GROUP BY 1""", views=("scored",), dbl=("multi_log_loss",))
def q_multi_log_loss(spark, sf):
    """AGG24 multiclass: softmax log loss over a 3-margin array."""
    s = sc(spark, sf).select((F.col("match_id") % 2).alias("half"), (F.col("match_id") % 3).alias("cls"),
                             F.expr(MC_MARGINS).alias("m"))
    return MT.softmax_log_loss(s, "m", "cls", ["half"])


@register("rmse", "SELECT match_id, sqrt(avg((y - p) * (y - p))) AS rmse FROM scored GROUP BY 1",
          views=("scored",), dbl=("rmse",))
def q_rmse(spark, sf):
    return MT.rmse(sc(spark, sf), "y", "p", ["match_id"])


@register("r2_score", "SELECT match_id, 1.0 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)) "
          "AS r2 FROM scored GROUP BY 1", views=("scored",), dbl=("r2",))
def q_r2(spark, sf):
    return MT.r2_score(sc(spark, sf), "y", "p", ["match_id"])


@register("accuracy", "SELECT match_id, avg(CASE WHEN y = prediction THEN 1.0 ELSE 0.0 END) AS accuracy "
          "FROM scored GROUP BY 1", views=("scored",), dbl=("accuracy",))
def q_accuracy(spark, sf):
    return MT.classification_metrics(sc(spark, sf), ["match_id"]).select("match_id", "accuracy")


ROC_SQL = """sc AS (SELECT {by} p, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg
  FROM scored GROUP BY {gb} p),
cum AS (SELECT *, sum(pos) OVER (PARTITION BY {part} ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY {part} ORDER BY p DESC) AS fp,
  sum(pos) OVER (PARTITION BY {part}) AS n_pos, sum(neg) OVER (PARTITION BY {part}) AS n_neg FROM sc)"""


@register("roc_curve", "WITH " + ROC_SQL.format(by="match_id,", gb="match_id,", part="match_id") +
          """ SELECT match_id, p AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  CAST(tp AS DOUBLE) / n_pos AS tpr, CAST(fp AS DOUBLE) / n_neg AS fpr FROM cum""",
          views=("scored",), dbl=("tpr", "fpr"))
def q_roc_curve(spark, sf):
    """AGG26 per match: (threshold, tp, fp, tpr, fpr) for every distinct threshold."""
    return MT.roc_points(sc(spark, sf), ["match_id"]).select("match_id", "threshold", "tp", "fp", "tpr", "fpr")


@register("roc_auc", "WITH " + ROC_SQL.format(by="", gb="", part="1") +
          """ SELECT sum(neg * (tp - pos + pos / 2.0)) / (max(n_pos) * max(n_neg)) AS roc_auc FROM cum""",
          views=("scored",), dbl=("roc_auc",))
def q_roc_auc(spark, sf):
    """AGG25 over the whole table (global order without a one-partition window)."""
    return MT.roc_auc(sc(spark, sf))


CM_SQL = """SELECT {by} CAST(sum(CASE WHEN y=1 AND prediction=1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN y<>1 AND prediction=1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN y=1 AND prediction<>1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN y<>1 AND prediction<>1 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM scored {gb}"""
CM_OUT = """SELECT {by} tp, fp, fn, tn, CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) AS accuracy,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0) AS precision,
  coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0) AS recall,
  coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1 FROM ({inner}) c"""


@register("classification_metrics",
          CM_OUT.format(by="match_id,", inner=CM_SQL.format(by="match_id,", gb="GROUP BY match_id")),
          views=("scored",), dbl=("accuracy", "precision", "recall", "f1"))
def q_classification_metrics(spark, sf):
    return MT.classification_metrics(sc(spark, sf), ["match_id"])


EDGES = " + ".join(f"CASE WHEN p > {e!r} THEN 1 ELSE 0 END" for e in MT.CALIBRATION_EDGES)


@register("calibration_curve", f"SELECT CAST({EDGES} AS INTEGER) AS bin, avg(p) AS prob_pred, avg(CAST(y AS DOUBLE)) "
          "AS prob_true, count(*) AS n FROM scored GROUP BY 1", views=("scored",), dbl=("prob_pred", "prob_true"))
def q_calibration_curve(spark, sf):
    return MT.calibration_curve(sc(spark, sf))


@register("sequence_probability", "SELECT pass_id // 160000000 AS sequence_id, exp(sum(ln(p))) AS pass_chain_probability, "
          "count(*) AS n_passes, exp(sum(ln(p))) * 0.02415 AS goal_probability FROM scored GROUP BY 1",
          views=("scored",), dbl=("pass_chain_probability", "goal_probability"), digits=9)
def q_sequence_probability(spark, sf):
    """AGG29: each order's lines form one build-up; P(goal) = xG × Π p."""
    s = sc(spark, sf).withColumn("sequence_id", F.expr("pass_id div 160000000"))
    return MT.sequence_probability(s, ["sequence_id"])


@register("predicted_class_probability", "SELECT pass_id, prediction, CASE WHEN prediction = 1 THEN p ELSE 1.0 - p END "
          "AS probability FROM scored", views=("scored",), dbl=("probability",))
def q_predicted_class_probability(spark, sf):
    return sc(spark, sf).select("pass_id", "prediction", MT.predicted_class_probability().alias("probability"))


@register("true_class_probability", "SELECT pass_id, y, CASE WHEN y = 1 THEN p ELSE 1.0 - p END AS true_class_probability "
          "FROM scored", views=("scored",), dbl=("true_class_probability",))
def q_true_class_probability(spark, sf):
    return sc(spark, sf).select("pass_id", "y", MT.true_class_probability().alias("true_class_probability"))


@register("argmax_label", "SELECT pass_id, CASE WHEN p > 1.0 - p THEN 1 ELSE 0 END AS label, greatest(p, 1.0 - p) "
          "AS probability FROM scored", views=("scored",), dbl=("probability",))
def q_argmax_label(spark, sf):
    s = sc(spark, sf)
    lab, prob = MT.argmax_label(F.array(F.lit(1.0) - F.col("p"), F.col("p")))
    return s.select("pass_id", lab.alias("label"), prob.alias("probability"))


SPLIT_SQL = "SELECT CASE WHEN match_id = 7 THEN 'test' ELSE 'train' END AS split, * FROM scored"


@register("evaluate_model", f"""WITH s AS ({SPLIT_SQL}),
a AS (SELECT split, avg({LL_SQL}) AS log_loss, avg(CASE WHEN y = prediction THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n,
  coalesce(avg(CASE WHEN prediction = 1 THEN y END), 0.0) AS precision, coalesce(avg(CASE WHEN y = 1 THEN prediction END), 0.0) AS recall
  FROM s GROUP BY 1),
k AS (SELECT split, y, rank() OVER (PARTITION BY split ORDER BY p) + (count(*) OVER (PARTITION BY split, p) - 1) / 2.0 AS r FROM s),
u AS (SELECT split, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) AS roc_auc FROM k GROUP BY 1)
SELECT split, log_loss, accuracy, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
  ELSE 0.0 END AS f1, roc_auc, n FROM a JOIN u USING (split)""", views=("scored",),
          dbl=("log_loss", "accuracy", "precision", "recall", "f1", "roc_auc"))
def q_evaluate_model(spark, sf):
    """ML11 given scores: all train and hold-out metrics of one scored frame."""
    return MT.evaluation(with_split(spark, sf), ["split"])


@register("evaluation_roc", "WITH scored_split AS (" + SPLIT_SQL + "), " + ROC_SQL.format(by="split,", gb="split,", part="split")
          .replace("FROM scored", "FROM scored_split") + """ SELECT split, p AS threshold, CAST(tp AS DOUBLE) / n_pos AS tpr,
  CAST(fp AS DOUBLE) / n_neg AS fpr FROM cum""", views=("scored",), dbl=("tpr", "fpr"))
def q_evaluation_roc(spark, sf):
    """ML11: the ROC points of both sides."""
    return MT.roc_points(with_split(spark, sf), ["split"]).select("split", "threshold", "tpr", "fpr")


def with_split(spark, sf):
    return sc(spark, sf).withColumn("split", F.when(F.col("match_id") == 7, "test").otherwise("train"))

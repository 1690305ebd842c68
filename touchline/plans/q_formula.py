"""Formula-operator queries: whole-table and fitted forms on lineitem / orders / passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from touchline.operators.formula import FormulaEncoder, derive_features, rowwise_features
from touchline.plans.registry import register
from touchline.sources import views as V
from touchline.sources.tables import read_table

LI_ROW_ID = "((l_orderkey*8+l_linenumber)*20000+l_partkey)*1000+l_suppkey"
LI_SQL = (f"SELECT {LI_ROW_ID} AS row_id, l_orderkey % 64 AS match_id, l_quantity, l_extendedprice, "
          "l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem")


def li(spark, sf):
    return read_table(spark, sf, "lineitem").selectExpr(
        f"{LI_ROW_ID} AS row_id", "l_orderkey % 64 AS match_id", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def whole(spark, sf, formula, name):
    return derive_features(li(spark, sf), [formula], names={formula: name}, keep=["row_id"])


def fitted(spark, sf, formula, name, order_col=None):
    base = li(spark, sf)
    enc = FormulaEncoder([formula], order_col=order_col, names={formula: name})
    model = enc.fit_materialized(base.where(F.col("match_id") != 7))
    return model.transform(base).select("row_id", name)


def _win(agg, v="l_extendedprice", k="l_returnflag"):
    return (f"WITH li AS ({LI_SQL}) SELECT row_id, CASE WHEN {k} IS NOT NULL THEN "
            f"CAST({agg} OVER (PARTITION BY {k}) AS DOUBLE) END AS feature FROM li")


@register("freq", f"WITH li AS ({LI_SQL}) SELECT row_id, CASE WHEN l_returnflag IS NOT NULL THEN "
          "CAST(count(*) OVER (PARTITION BY l_returnflag) AS DOUBLE) END AS feature FROM li")
def q_freq(spark, sf):
    """AGG5 whole-table: rows sharing the value."""
    return whole(spark, sf, "freq(l_returnflag)", "feature")


@register("fitted_freq", f"""WITH li AS ({LI_SQL}),
m AS (SELECT l_linestatus, CAST(count(*) AS DOUBLE) AS c FROM li WHERE match_id <> 7 AND l_linestatus IS NOT NULL
      GROUP BY l_linestatus)
SELECT row_id, m.c AS feature FROM li LEFT JOIN m ON li.l_linestatus = m.l_linestatus""")
def q_fitted_freq(spark, sf):
    """AGG5 fitted: counts learned on training rows; unseen value → null."""
    return fitted(spark, sf, "freq(l_linestatus)", "feature")


@register("groupby_then_min", _win("min(l_extendedprice)"))
def q_gb_min(spark, sf):
    return whole(spark, sf, "GroupByThenMin(l_extendedprice,l_returnflag)", "feature")


@register("groupby_then_max", _win("max(l_extendedprice)"))
def q_gb_max(spark, sf):
    return whole(spark, sf, "GroupByThenMax(l_extendedprice,l_returnflag)", "feature")


@register("groupby_then_mean", _win("avg(l_extendedprice)"), dbl=("feature",))
def q_gb_mean(spark, sf):
    return whole(spark, sf, "GroupByThenMean(l_extendedprice,l_returnflag)", "feature")


@register("groupby_then_median", _win("quantile_cont(l_extendedprice, 0.5)"), dbl=("feature",))
def q_gb_median(spark, sf):
    """AGG9: exact median (midpoint of the middle pair), skew-safe via prefix counts."""
    return whole(spark, sf, "GroupByThenMedian(l_extendedprice,l_returnflag)", "feature")


@register("groupby_then_std", _win("stddev_samp(l_extendedprice)"), dbl=("feature",))
def q_gb_std(spark, sf):
    return whole(spark, sf, "GroupByThenStd(l_extendedprice,l_returnflag)", "feature")


@register("groupby_then_nunique", f"""WITH li AS ({LI_SQL}),
m AS (SELECT l_returnflag, CAST(count(DISTINCT l_quantity) AS DOUBLE) AS c FROM li GROUP BY l_returnflag)
SELECT row_id, CASE WHEN li.l_returnflag IS NOT NULL THEN m.c END AS feature
FROM li LEFT JOIN m ON li.l_returnflag = m.l_returnflag""")
def q_gb_nunique(spark, sf):
    return whole(spark, sf, "GroupByThenNUnique(l_quantity,l_returnflag)", "feature")


@register("groupby_then_freq", f"""WITH li AS ({LI_SQL})
SELECT row_id, CASE WHEN l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL THEN
  CAST(count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS DOUBLE) END AS feature FROM li""")
def q_gb_freq(spark, sf):
    """AGG12: count of the value inside its group."""
    return whole(spark, sf, "GroupByThenFreq(l_linestatus,l_returnflag)", "feature")


@register("groupby_then_rank", f"""WITH li AS ({LI_SQL})
SELECT row_id, CASE WHEN l_returnflag IS NOT NULL AND l_quantity IS NOT NULL THEN
  (rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
   + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0)
  / count(l_quantity) OVER (PARTITION BY l_returnflag) END AS feature FROM li""", dbl=("feature",))
def q_gb_rank(spark, sf):
    """WIN1: average-tie percentile rank inside the group (skew-safe prefix counts)."""
    return whole(spark, sf, "GroupByThenRank(l_quantity,l_returnflag)", "feature")


@register("combine_then_freq", f"""WITH li AS ({LI_SQL})
SELECT row_id, CASE WHEN l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL THEN
  CAST(count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS DOUBLE) END AS feature FROM li""")
def q_combine_then_freq(spark, sf):
    """AGG13: count of the (a, b) pair, keyed on both columns (no string concat)."""
    return whole(spark, sf, "CombineThenFreq(l_returnflag,l_linestatus)", "feature")


@register("fitted_combine_then_freq", f"""WITH li AS ({LI_SQL}),
m AS (SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS c FROM li WHERE match_id <> 7
      AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2)
SELECT row_id, m.c AS feature FROM li LEFT JOIN m ON li.l_returnflag = m.l_returnflag
  AND li.l_linestatus = m.l_linestatus""")
def q_fitted_combine_then_freq(spark, sf):
    return fitted(spark, sf, "CombineThenFreq(l_returnflag,l_linestatus)", "feature")


UNARY_FORMULAS = {"abs((l_discount-l_tax))": "f_abs", "log(l_discount)": "f_log",
                  "sqrt((l_tax-l_discount))": "f_sqrt", "square(l_quantity)": "f_square",
                  "sigmoid((l_discount-l_tax))": "f_sigmoid", "round((l_extendedprice/l_quantity))": "f_round",
                  "residual((l_extendedprice/l_quantity))": "f_residual"}


@register("unary_features", f"""WITH li AS ({LI_SQL}) SELECT row_id,
  abs(l_discount - l_tax) AS f_abs,
  CASE WHEN l_discount <> 0 THEN ln(abs(l_discount)) END AS f_log,
  sqrt(abs(l_tax - l_discount)) AS f_sqrt,
  l_quantity * l_quantity AS f_square,
  1.0 / (1.0 + exp(-(l_discount - l_tax))) AS f_sigmoid,
  CAST(floor(l_extendedprice / nullif(l_quantity, 0)) AS DOUBLE) AS f_round,
  l_extendedprice / nullif(l_quantity, 0) - floor(l_extendedprice / nullif(l_quantity, 0)) AS f_residual
FROM li""", dbl=tuple(UNARY_FORMULAS.values()))
def q_unary(spark, sf):
    """SC1–SC7: the unary vocabulary (log of 0 → null, round = floor)."""
    return rowwise_features(li(spark, sf), list(UNARY_FORMULAS), names=UNARY_FORMULAS) \
        .select("row_id", *UNARY_FORMULAS.values())


BINARY_FORMULAS = {"max(l_discount,l_tax)": "f_max", "min(l_discount,l_tax)": "f_min",
                   "(l_quantity+l_tax)": "f_add", "(l_extendedprice-l_quantity)": "f_sub",
                   "(l_quantity*l_discount)": "f_mul", "(l_tax/l_discount)": "f_div"}


@register("binary_features", f"""WITH li AS ({LI_SQL}) SELECT row_id,
  CASE WHEN l_discount IS NOT NULL AND l_tax IS NOT NULL THEN greatest(l_discount, l_tax) END AS f_max,
  CASE WHEN l_discount IS NOT NULL AND l_tax IS NOT NULL THEN least(l_discount, l_tax) END AS f_min,
  l_quantity + l_tax AS f_add, l_extendedprice - l_quantity AS f_sub, l_quantity * l_discount AS f_mul,
  CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS f_div
FROM li""", dbl=tuple(BINARY_FORMULAS.values()))
def q_binary(spark, sf):
    """SC8–SC11, SC38: binary vocabulary, null if either side missing, /0 → null."""
    return rowwise_features(li(spark, sf), list(BINARY_FORMULAS), names=BINARY_FORMULAS) \
        .select("row_id", *BINARY_FORMULAS.values())


ORD_SQL = ("SELECT o_orderkey, o_orderkey % 64 AS match_id, o_orderstatus, o_orderpriority FROM orders")


@register("combine", f"""WITH o AS ({ORD_SQL}),
p AS (SELECT o_orderstatus, o_orderpriority, min(o_orderkey) AS first FROM o
      WHERE o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
ids AS (SELECT o_orderstatus, o_orderpriority, CAST(row_number() OVER (ORDER BY first) - 1 AS DOUBLE) AS id FROM p)
SELECT o.o_orderkey, coalesce(ids.id, -1.0) AS feature FROM o LEFT JOIN ids
  ON o.o_orderstatus = ids.o_orderstatus AND o.o_orderpriority = ids.o_orderpriority""")
def q_combine(spark, sf):
    """WIN2: pair → id by first appearance in order-key order; null pair → −1."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    f = "Combine(o_orderstatus,o_orderpriority)"
    return derive_features(o, [f], order_col="o_orderkey", names={f: "feature"}, keep=["o_orderkey"])


@register("fitted_combine", f"""WITH o AS ({ORD_SQL}),
p AS (SELECT o_orderstatus, o_orderpriority, min(o_orderkey) AS first FROM o
      WHERE match_id <> 7 AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL GROUP BY 1, 2),
ids AS (SELECT o_orderstatus, o_orderpriority, CAST(row_number() OVER (ORDER BY first) - 1 AS DOUBLE) AS id FROM p)
SELECT o.o_orderkey, coalesce(ids.id, -1.0) AS feature FROM o LEFT JOIN ids
  ON o.o_orderstatus = ids.o_orderstatus AND o.o_orderpriority = ids.o_orderpriority""")
def q_fitted_combine(spark, sf):
    """FE4 Combine: ids learned on training rows; unseen or null pair → −1."""
    o = read_table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey % 64 AS match_id",
                                                   "o_orderstatus", "o_orderpriority")
    f = "Combine(o_orderstatus,o_orderpriority)"
    model = FormulaEncoder([f], order_col="o_orderkey", names={f: "feature"}) \
        .fit_materialized(o.where(F.col("match_id") != 7))
    return model.transform(o).select("o_orderkey", "feature")


# ---- mixed formulas over passes (FE1, FE2, WIN4/FE14) ------------------------------------
DERIVED = {
    "(start_x+end_x)": "f_sum_x",
    "GroupByThenMean(length,height)": "f_mean_len_by_height",
    "freq(body_part)": "f_freq_body",
    "GroupByThenStd(duration,body_part)": "f_std_dur_by_body",
    "CombineThenFreq(height,body_part)": "f_pair_freq",
    "GroupByThenMax((end_x-start_x),height)": "f_max_dx_by_height",
    "(GroupByThenMean(length,height)-length)": "f_len_minus_mean",
    "GroupByThenNUnique(body_part,height)": "f_nunique_body_by_height",
}


@register("derive_features", views=("passes",), dbl=tuple(DERIVED.values()), oracle="""
SELECT pass_id, start_x + end_x AS f_sum_x,
  CASE WHEN height IS NOT NULL THEN avg(length) OVER (PARTITION BY height) END AS f_mean_len_by_height,
  CASE WHEN body_part IS NOT NULL THEN CAST(count(*) OVER (PARTITION BY body_part) AS DOUBLE) END AS f_freq_body,
  CASE WHEN body_part IS NOT NULL THEN stddev_samp(duration) OVER (PARTITION BY body_part) END AS f_std_dur_by_body,
  CASE WHEN height IS NOT NULL AND body_part IS NOT NULL
       THEN CAST(count(*) OVER (PARTITION BY height, body_part) AS DOUBLE) END AS f_pair_freq,
  CASE WHEN height IS NOT NULL THEN max(end_x - start_x) OVER (PARTITION BY height) END AS f_max_dx_by_height,
  CASE WHEN height IS NOT NULL THEN avg(length) OVER (PARTITION BY height) END - length AS f_len_minus_mean,
  CASE WHEN height IS NOT NULL THEN CAST(count(DISTINCT body_part) OVER (PARTITION BY height) AS DOUBLE) END
    AS f_nunique_body_by_height
FROM passes""")
def q_derive_features(spark, sf):
    """FE1: several formulas, nested ones included; stateful nodes that share a key
    share one aggregation."""
    return derive_features(V.passes(spark, sf), list(DERIVED), names=DERIVED, keep=["pass_id"])


ROWWISE = {"(length/duration)": "f_speed", "log(duration)": "f_log_duration",
           "sigmoid((end_x-start_x))": "f_sig_dx", "max(start_x,end_x)": "f_max_x"}


@register("rowwise_features", views=("passes",), dbl=tuple(ROWWISE.values()), oracle="""
SELECT pass_id, CASE WHEN duration <> 0 THEN length / duration END AS f_speed,
  CASE WHEN duration <> 0 THEN ln(abs(duration)) END AS f_log_duration,
  1.0 / (1.0 + exp(-(end_x - start_x))) AS f_sig_dx,
  CASE WHEN start_x IS NOT NULL AND end_x IS NOT NULL THEN greatest(start_x, end_x) END AS f_max_x
FROM passes""")
def q_rowwise_features(spark, sf):
    """FE2: production row-wise transform (stateful formulas are rejected)."""
    return rowwise_features(V.passes(spark, sf), list(ROWWISE), names=ROWWISE) \
        .select("pass_id", *ROWWISE.values())


TRANSDUCTIVE = {"GroupByThenMean(duration,height)": "f_mean_dur_by_height",
                "freq(height)": "f_freq_height",
                "GroupByThenMin(length,body_part)": "f_min_len_by_body"}


@register("transductive_features", views=("passes",), dbl=tuple(TRANSDUCTIVE.values()), oracle="""
SELECT pass_id, CASE WHEN match_id = 7 THEN 'test' ELSE 'train' END AS split,
  CASE WHEN height IS NOT NULL THEN avg(duration) OVER (PARTITION BY height) END AS f_mean_dur_by_height,
  CASE WHEN height IS NOT NULL THEN CAST(count(*) OVER (PARTITION BY height) AS DOUBLE) END AS f_freq_height,
  CASE WHEN body_part IS NOT NULL THEN min(length) OVER (PARTITION BY body_part) END AS f_min_len_by_body
FROM passes WHERE match_id IS NOT NULL""")
def q_transductive(spark, sf):
    """WIN4/SET3/FE14: train and hold-out stacked, features computed over both."""
    from touchline.operators.passes import holdout_split
    p = V.passes(spark, sf).withColumn("mid", F.col("match_id"))
    train, test = holdout_split(p)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return derive_features(both, list(TRANSDUCTIVE), names=TRANSDUCTIVE, keep=["pass_id", "split"])


@register("fitted_nested_mean", f"""WITH li AS ({LI_SQL}),
f AS (SELECT l_linestatus, count(*) AS c FROM li WHERE match_id <> 7 AND l_linestatus IS NOT NULL GROUP BY 1),
m AS (SELECT l_returnflag, avg(CAST(f.c AS DOUBLE)) AS v FROM li LEFT JOIN f ON li.l_linestatus = f.l_linestatus
  WHERE match_id <> 7 AND l_returnflag IS NOT NULL GROUP BY 1)
SELECT row_id, m.v - f.c AS feature FROM li LEFT JOIN m ON li.l_returnflag = m.l_returnflag
  LEFT JOIN f ON li.l_linestatus = f.l_linestatus""", dbl=("feature",))
def q_fitted_nested_mean(spark, sf):
    """FE4 nested: counts, and means of those counts, both learned on the training matches and applied in that order
    (inner values of new rows come from the training rows, not from the new table)."""
    return fitted(spark, sf, "(GroupByThenMean(freq(l_linestatus),l_returnflag)-freq(l_linestatus))", "feature")

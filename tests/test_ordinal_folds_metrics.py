"""Invariants and brute-force checks: prefix sums, folds, ROC AUC, kernel density."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.operators import metrics as MT
from touchline.operators.folds import nested_blocks, stratified_folds, stratified_split
from touchline.operators.ordinal import prefix_sum, row_number0


def test_row_number_matches_window(spark):
    df = spark.range(0, 5000).withColumn("g", (F.col("id") % 3 == 0).cast("int")) \
        .withColumn("h", F.xxhash64("id", F.lit(1)))
    a = row_number0(df, ["g"], ["h", "id"], n_buckets=16)
    b = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")) - 1)
    assert a.join(b, "id").where(F.col("rank0") != F.col("rn")).count() == 0


def test_prefix_sum_descending(spark):
    df = spark.range(0, 3000).withColumn("k", F.xxhash64("id"))
    got = prefix_sum(df, [], ["k"], {"s": F.col("id")}, descending=True, n_buckets=8)
    exp = df.withColumn("s2", F.coalesce(F.sum("id").over(
        Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    assert got.join(exp, "id").where(F.col("s") != F.col("s2")).count() == 0


def test_folds_cover_once_balanced_and_partition_independent(spark):
    df = spark.range(0, 2000).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    f1 = stratified_folds(df, "id", "y", k=5, seed=3)
    f2 = stratified_folds(df.repartition(7), "id", "y", k=5, seed=3)
    assert f1.count() == 2000 and f1.select("id").distinct().count() == 2000
    counts = {(r["y"], r["fold"]): r["count"] for r in f1.groupBy("y", "fold").count().collect()}
    assert counts[(1, 0)] == 80 and counts[(0, 4)] == 320
    assert f1.join(f2.withColumnRenamed("fold", "fold2"), ["id", "y"]).where("fold <> fold2").count() == 0


def test_nested_block_sizes(spark):
    df = spark.range(0, 1000)
    b = nested_blocks(df, "id", 8, seed=1)
    got = {r["block"]: r["count"] for r in b.groupBy("block").count().collect()}
    # prefixes of 1/8, 1/4, 1/2 and all of the rows
    assert got == {0: 125, 1: 125, 2: 250, 3: 500}


def test_null_labels_are_kept(spark):
    df = spark.range(0, 100).withColumn("y", F.when(F.col("id") < 30, F.lit(None)).otherwise(F.col("id") % 2))
    folds = stratified_folds(df, "id", "y", k=5)
    assert folds.count() == 100 and folds.where("y is null").groupBy("fold").count().where("count <> 6").count() == 0
    split = stratified_split(df, "id", "y")
    assert split.count() == 100 and split.where("y is null and split = 'test'").count() == 6


def test_buckets_follow_crowded_values(spark):
    from touchline.operators.ordinal import _quantile_bucket
    df = spark.range(0, 20000).select((F.col("id") + 1.7e9).alias("v"))
    sizes = [r["count"] for r in _quantile_bucket(df, "v", 64, "b").groupBy("b").count().collect()]
    assert len(sizes) >= 50 and max(sizes) < 1500
    got = row_number0(df, [], ["v"])
    assert got.where(F.col("rank0") != F.col("v") - 1.7e9).count() == 0


def test_edge_values_of_the_metrics(spark):
    chain = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("b", 0.5), ("b", 0.5)], "s string, p double")
    got = {r["s"]: r["pass_chain_probability"] for r in MT.sequence_probability(chain, ["s"]).collect()}
    assert got["a"] == 0.0 and abs(got["b"] - 0.25) < 1e-12
    scored = spark.createDataFrame([(None, 0.9), (1, 0.9), (0, None)], "y int, p double")
    r = MT.log_loss(scored).first()
    assert r["n"] == 1 and abs(r["log_loss"] + np.log(0.9)) < 1e-12
    big = [(1e9 + i, 1e9 + i + 0.5 * (-1) ** i) for i in range(5)]
    r2 = MT.r2_score(spark.createDataFrame(big, "y double, pred double"), "y", "pred").first()["r2"]
    assert abs(r2 - (1 - 5 * 0.25 / 10.0)) < 1e-9


def test_auc_of_counts_beyond_32_bits(spark):
    pts = spark.createDataFrame([(0.9, 4 * 10 ** 9, 0), (0.1, 0, 4 * 10 ** 9)], "p double, pos long, neg long")
    original = MT.score_counts
    MT.score_counts = lambda df, by, y, p: df
    try:
        assert MT.roc_auc(pts).first()["roc_auc"] == 1.0
    finally:
        MT.score_counts = original


def test_roc_auc_brute_force(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    p = np.round(rng.random(300), 2)            # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    got = MT.roc_auc(df).first()["roc_auc"]
    pos, neg = p[y == 1], p[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got - exp) < 1e-12


def test_kde_brute_force(spark):
    from touchline.operators.density import kde_grid
    rng = np.random.default_rng(1)
    pts = np.round(rng.random((200, 2)) * [120, 80], 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double")
    got = kde_grid(df, 6, 4).orderBy("ix", "iy").toPandas()
    cov = np.cov(pts.T) * len(pts) ** (-1 / 3)
    inv, det = np.linalg.inv(cov), np.linalg.det(cov)
    gx, gy = np.linspace(0, 120, 6), np.linspace(0, 80, 4)
    exp = []
    for a in gx:
        for b in gy:
            d = pts - [a, b]
            q = np.einsum("ij,jk,ik->i", d, inv, d)
            exp.append(np.mean(np.exp(-0.5 * q)) / (2 * np.pi * np.sqrt(det)))
    np.testing.assert_allclose(got["density"].to_numpy(), np.array(exp), rtol=1e-9)


def test_mutual_info_knn_brute_force(spark):
    from math import log
    from touchline.operators.information import mutual_info_classes
    rng = np.random.default_rng(5)
    n = 300
    y = rng.integers(0, 2, n)
    x = rng.normal(size=n) + y * 0.8
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y int")
    got = mutual_info_classes(df, "x", "y", 3).first()["mutual_info"]

    def psi(v):
        res = 0.0
        while v < 30:
            res -= 1.0 / v
            v += 1
        return res + log(v) - 1 / (2 * v) - 1 / (12 * v * v) + 1 / (120 * v ** 4) - 1 / (252 * v ** 6)

    k_all, m_all, lab_n = [], [], []
    for i in range(n):
        same = np.sort(np.abs(x[y == y[i]] - x[i]))[1:]
        r = same[2]
        m_all.append(np.sum(np.abs(x - x[i]) < r))
        k_all.append(3)
        lab_n.append(np.sum(y == y[i]))
    exp = psi(n) + np.mean([psi(v) for v in k_all]) - np.mean([psi(v) for v in lab_n]) - np.mean([psi(v) for v in m_all])
    assert abs(got - max(0.0, exp)) < 1e-9


def test_log_bucket_is_monotone(spark):
    from touchline.operators.ordinal import log_bucket
    rng = np.random.default_rng(2)
    vals = list(rng.normal(size=300) * 10.0 ** rng.integers(-8, 8, 300))
    vals += [0.0, -0.0, 1.0, 2.0, 4.0, 8.0, 1024.0, 0.5, 0.25, -1.0, -2.0, -8.0, 7.999999999999999, 8.000000000000002,
             float("inf"), float("-inf"), 5e-324, -5e-324, 1.7976931348623157e308]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    rows = sorted((r["v"], r["b"]) for r in df.select("v", log_bucket(F.col("v"), 512).alias("b")).collect())
    bs = [b for _, b in rows]
    assert bs == sorted(bs)
    assert len(set(bs)) > 100


@pytest.mark.parametrize("ids", ["id", "cast(id as string)", "id div 3", "case when id % 4 > 0 then id end", "cast(null as long)"])
def test_split_equals_ranked_rows(spark, ids):
    """the same test rows as by ranking all of them, in no more than a comparison a row."""
    from touchline.operators.folds import hash_rank
    df = spark.range(997).selectExpr(f"{ids} as id", "case when id % 7 < 3 then 'a' when id % 7 < 6 then 'b' end as y")
    for label in ("y", None):
        got = stratified_split(df, "id", label)
        r = hash_rank(df, "id", label, 42, size="n").withColumn("split", F.when(F.col("__rank") < F.ceil(F.col("n") * 2 / 10), "test").otherwise("train"))
        assert got.columns == ["id", "y", "split"]
        keys = ["y", "split"] if ids in ("id div 3", "cast(null as long)") or "case" in ids else ["id", "y", "split"]
        assert sorted(map(str, got.groupBy(*keys).count().collect())) == sorted(map(str, r.groupBy(*keys).count().collect()))
    plan = stratified_split(spark.range(500).withColumn("y", F.col("id") % 2), "id", "y")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_bucket_steps_equal_the_nested_expression_and_stay_small(spark):
    """Worked out step by step, a row's octave is found once: nested, ``log2`` came 36 times a row."""
    from touchline.operators.folds import plain_folds
    from touchline.operators.ordinal import log_bucket, with_log_bucket
    vals = [0.0, -0.0, 1.0, 0.999999999, 3.0, -3.0, 1e-300, 5e-324, 1e300, -2.5e17, float(1 << 59), float((1 << 60) - 1), math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    for sub in (1, 64, 800):
        rows = with_log_bucket(df.withColumn("nested", log_bucket(F.col("v"), sub)), "v", sub, "b")
        assert rows.columns == ["v", "nested", "b"]
        assert [r.b for r in rows.collect()] == [r.nested for r in rows.collect()]
    plan = plain_folds(spark.range(10), "id", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("LOG2(") <= 2


def test_a_side_of_a_split_is_split_again(spark):
    """F8: a column ``split`` from an earlier split is replaced; it came twice, and no name found it then."""
    df = spark.range(400).selectExpr("id", "id % 2 as y")
    once = stratified_split(df, "id", "y").where("split = 'train'")
    twice = stratified_split(once, "id", "y", seed=43)
    assert twice.columns == ["id", "y", "split"]
    assert {r["split"]: r["count"] for r in twice.groupBy("split").count().collect()} == {"test": 64, "train": 256}

"""Boosting from start margins against numpy, and the selection steps that use it."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from touchline.operators import autofe as AF
from touchline.operators import boosting as B
from touchline.operators import modeling as ML
from touchline.session import stored


def rows(n=400, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        flag, x, g = rng.randrange(2), rng.random(), rng.choice("abc")
        three = rng.choice([0, 1, 2, flag * 2, flag * 2])
        out.append((i, float(flag), x, g, float(rng.random() < 0.3 + 0.4 * flag), float(three), 3 * x + flag + rng.gauss(0, 0.1),
                    None if i % 11 == 0 else rng.gauss(0, 1)))
    return out


COLUMNS = "id long, flag double, x double, g string, y double, three double, z double, start double"


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.createDataFrame(rows(), COLUMNS)
    return VectorAssembler(inputCols=["flag", "x"], outputCol="features").transform(df).cache()


def sigmoid(m):
    return 1 / (1 + math.exp(-m))


def test_gradient_sums_around_a_margin(frame):
    obj = B.Binary()
    prior = obj.priors(frame, "y")
    got = {r.g: r for r in B.gradient_sums(B.with_start(frame, obj, "start", prior), obj, "y", ["g"]).collect()}
    for g in "abc":
        some = [r for r in rows() if r[3] == g]
        ps = [sigmoid(prior[0] if r[7] is None else r[7]) for r in some]
        assert got[g].n == len(some)
        assert got[g].g0 == pytest.approx(sum(r[4] - p for r, p in zip(some, ps)))
        assert got[g].h0 == pytest.approx(sum(p * (1 - p) for p in ps))


def one_flag(spark, df):
    return VectorAssembler(inputCols=["flag"], outputCol="features").transform(df.drop("features"))


def test_first_softmax_round_is_a_newton_step(spark, frame):
    df = one_flag(spark, frame)
    model = B.boost(df, B.Softmax(3), "three", rounds=1, depth=1, step=0.5)
    data = rows()
    share = [sum(r[5] == k for r in data) / len(data) for k in range(3)]
    assert model.priors == pytest.approx([math.log(s) for s in share])
    got = {r.flag: r.margins for r in model.transform(df).select("flag", "margins").distinct().collect()}
    for flag in (0.0, 1.0):
        some = [r for r in data if r[1] == flag]
        for k in range(3):
            leaf = sum((r[5] == k) - share[k] for r in some) / (len(some) * share[k] * (1 - share[k]))
            assert got[flag][k] == pytest.approx(math.log(share[k]) + 0.5 * leaf)


def test_rounds_lower_every_loss(frame):
    for obj, label in ((B.Binary(), "y"), (B.Softmax(3), "three"), (B.Squared(), "z")):
        losses = [B.mean_loss(B.boost(frame, obj, label, rounds=n, depth=2, step=0.3).transform(frame), obj, label).first().loss
                  for n in (0, 3, 8)]
        assert losses[0] > losses[1] > losses[2]


def test_start_margins_are_kept(frame):
    """Boosting goes on from the given margins; without rounds they come back."""
    obj = B.Binary()
    none = B.boost(frame, obj, "y", rounds=0, start="start").transform(frame)
    assert all(r.margins[0] == pytest.approx(r.start) for r in none.where("start is not null").collect())
    base = B.boost(frame, obj, "y", rounds=6, depth=2, step=0.3)
    with_margin = base.transform(frame).withColumn("m", F.col("margins")[0]).drop("margins")
    more = B.boost(with_margin, obj, "y", rounds=4, depth=2, step=0.3, start="m")
    assert B.mean_loss(more.transform(with_margin), obj, "y").first().loss < B.mean_loss(base.transform(frame), obj, "y").first().loss


def test_early_stop_keeps_the_best_round(frame):
    df = frame.withColumn("v", F.col("id") % 4 == 0)
    model = B.boost(df, B.Binary(), "y", rounds=30, depth=4, step=0.8, valid="v", patience=2)
    valid = [v for _, v in model.losses]
    assert len(model.rounds) == valid.index(min(valid)) + 1 < 30


def test_boosting_edges(spark, frame):
    empty = B.boost(frame.where("false"), B.Binary(), "y")
    assert empty.rounds == [] and empty.importances() == []
    no_label = B.boost(frame.withColumn("y", F.when(F.col("id") < 9, F.col("y"))), B.Binary(), "y", rounds=1)
    assert len(no_label.rounds) == 1
    with pytest.raises(ValueError):
        B.objective("multiclass", 2)
    with pytest.raises(ValueError):
        B.objective("ranking")


def test_permutation_jobs_do_not_follow_the_features(spark, frame):
    obj = B.Binary()
    model = B.boost(frame, obj, "y", rounds=4, depth=2, step=0.3)
    got = B.permutation_losses(frame.select("id", "features", "y"), model.transform, obj, "y", "id", 2, repeats=2).collect()
    loss = {(r["feature"], r["repeat"]): r["loss"] for r in got}
    assert set(loss) == {(-1, 0), (0, 0), (1, 0), (0, 1), (1, 1)}
    assert loss[-1, 0] == pytest.approx(B.mean_loss(model.transform(frame), obj, "y").first().loss)
    assert min(loss[0, 0], loss[0, 1]) > loss[-1, 0]      # the flag decides the label


@pytest.mark.parametrize("task,label", [("binary", "y"), ("multiclass", "three"), ("regression", "z")])
def test_stage1_gain_equals_numpy(spark, frame, task, label):
    df = frame.withColumn("split", F.when(F.col("id") % 5 == 0, "valid").otherwise("train"))
    start = "start" if task == "binary" else None
    got = {r.feature: r.score for r in AF.stage1_gains(df, ["x", "flag", "(x*flag)"], label, "split", task=task, classes=3, start=start).collect()}
    data = rows()
    y = np.array([r[{"y": 4, "three": 5, "z": 6}[label]] for r in data])
    train = np.array([r[0] % 5 != 0 for r in data])
    features = {"x": [r[2] for r in data], "flag": [r[1] for r in data], "(x*flag)": [r[1] * r[2] for r in data]}
    k = 3 if task == "multiclass" else 1
    if task == "binary":
        p = y[train].mean()
        margins = np.array([[math.log(p / (1 - p)) if r[7] is None else r[7]] for r in data])
    elif task == "multiclass":
        margins = np.tile([math.log((y[train] == c).mean()) for c in range(3)], (len(y), 1))
    else:
        margins = np.full((len(y), 1), y[train].mean())

    def loss(m):
        if task == "binary":
            q = 1 / (1 + np.exp(-m[:, 0]))
            return -(y * np.log(q) + (1 - y) * np.log(1 - q))
        if task == "regression":
            return (y - m[:, 0]) ** 2
        e = np.exp(m)
        return -np.log((e / e.sum(axis=1, keepdims=True))[np.arange(len(y)), y.astype(int)])

    if task == "regression":
        g, h = (y[:, None] - margins), np.ones_like(margins)
    else:
        q = 1 / (1 + np.exp(-margins)) if k == 1 else np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        g, h = (y[:, None] if k == 1 else np.eye(3)[y.astype(int)]) - q, q * (1 - q)
    for name, v in features.items():
        v = np.array(v)
        ordered = np.sort(v[train])
        edges = np.unique([ordered[(j * (len(ordered) - 1)) // 16] for j in range(1, 16)])
        bins = np.searchsorted(edges, v, side="left")
        new = margins.copy()
        for b in np.unique(bins):
            inside = train & (bins == b)
            new[bins == b] += g[inside].sum(axis=0) / (h[inside].sum(axis=0) + AF.LAMBDA)
        assert got[name] == pytest.approx((loss(margins) - loss(new))[~train].mean(), abs=1e-9)


def test_selection_for_regression_and_classes(spark, frame):
    spec = ML.ModelSpec(["x", "flag", "start"], [], "z", {"maxIter": 5, "maxDepth": 2, "stepSize": 0.5}, task="regression")
    picked = ML.forward_selection(spec, frame.drop("features"), "id", k=2, metric="r2", threshold=0.01).collect()
    assert picked[0].feature == "x" and picked[0].kept and {r.feature for r in picked if r.kept} >= {"x", "flag"}
    trials = ML.param_search(spec, frame.drop("features"), "id", n_trials=2, k=2).collect()
    assert all(0 < r.loss < 1 for r in trials)
    three = ML.ModelSpec(["flag", "x"], ["g"], "three", {"maxIter": 4, "maxDepth": 2, "stepSize": 0.5}, task="multiclass", classes=3)
    oof = ML.cross_val_oof(three, frame.drop("features"), "id", k=2)
    assert oof.count() == 400 and oof.where("size(probabilities) <> 3 or abs(aggregate(probabilities, 0D, (a, v) -> a + v) - 1) > 1e-9").count() == 0
    assert ML.score_table(oof, "three", "accuracy") > 0.4


def test_stage2_ranks(spark, frame):
    df = frame.drop("features").withColumn("split", F.when(F.col("id") % 5 == 0, "valid").otherwise("train"))
    params = {"maxIter": 4, "maxDepth": 2, "stepSize": 0.5}
    gain = AF.stage2_select(df, ["x"], ["g"], ["(x*flag)", "abs(flag)"], "z", params, task="regression")
    assert [r.feature for r in gain.collect()][0] in ("abs(flag)", "(x*flag)")
    perm = AF.stage2_select(df, ["x", "flag"], [], ["(x*flag)"], "y", params, method="permutation", repeats=2, row_id="id",
                            drop=["flag"], start="start").collect()
    assert [r.feature for r in perm] == ["(x*flag)"] and perm[0].importance > 0


def test_one_stump_is_fitted_in_one_scan_without_stored_rows(spark, frame, monkeypatch):
    """Rows that a fit reads a single time are not written; count and start margins come from one job."""
    written = []
    monkeypatch.setattr(B, "stored", lambda df, *a: written.append(a) or stored(df, *a))
    df = one_flag(spark, frame)
    for obj, label in ((B.Squared(), "x"), (B.Softmax(3), "three")):
        model = B.boost(df, obj, label, rounds=1, depth=1, step=0.5)
        assert not written and model.priors == pytest.approx(obj.priors(df, label))
        start = df.withColumn("m", F.array(*[F.lit(p) for p in model.priors]))
        given = B.boost(start if obj.width > 1 else start.withColumn("m", F.col("m")[0]), obj, label, rounds=1, depth=1, step=0.5, start="m")
        assert [t.to_dict() for t in given.rounds[0]] == [t.to_dict() for t in model.rounds[0]]
    B.boost(df, B.Squared(), "x", rounds=2, depth=1)
    assert len(written) == 1


def test_bins_are_counted_without_multiplying_rows(spark):
    """counts by bin and side equal those by expression: nulls, NaN, edges, a missing side or label."""
    df = spark.range(500).selectExpr("case when id % 7 > 0 then id % 23 / 2D end as a", "case when id % 50 = 0 then double('NaN') else id % 5 - 2D end as b",
                                     "case when id % 9 > 0 then double(id % 3 = 0) end as y", "case id % 4 when 0 then 'valid' when 3 then null else 'train' end as s")
    edges = {"a": [0.5, 3.0, 7.5], "b": [-1.0], "c": []}
    df = df.withColumn("c", F.col("a"))
    got = AF.bin_counts(df, edges, "y", "s")
    want = None
    for c, e in edges.items():
        part = df.groupBy(F.lit(c).alias("cand"), AF.bin_of(F.col(c), e).alias("bin"), F.col("s").alias("split")).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
        want = part if want is None else want.unionByName(part)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan

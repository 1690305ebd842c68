"""Histogram trees against MLlib's gradient-boosted trees."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from touchline.operators import boosting as B
from touchline.operators import modeling as ML
from touchline.operators import trees as T

PARAMS = {"maxIter": 6, "maxDepth": 3, "stepSize": 0.2}


@pytest.fixture(scope="module")
def rows(spark):
    """Numbers with few and many values, nulls, a category, labels that depend on all."""
    df = spark.range(1500).select("id", (F.rand(1) * 9).alias("many"), F.floor(F.rand(2) * 5).cast("double").alias("few"),
                                  F.when(F.col("id") % 13 > 0, F.randn(3)).alias("holes"),
                                  F.element_at(F.array(*[F.lit(c) for c in "abcd"]), (F.col("id") % 4 + 1).cast("int")).alias("g"))
    z = F.col("many") * F.when(F.col("g").isin("a", "c"), 1.3).otherwise(0.4) + F.col("few") + F.coalesce("holes", F.lit(2.0)) + F.rand(5)
    return df.withColumn("z", z).withColumn("y", (F.col("z") + F.randn(4) > 7).cast("double")).withColumn("v", F.col("id") % 5 == 0).cache()


def spec(task, label, **kw):
    return ML.ModelSpec(["many", "few", "holes"], ["g"], label, {**PARAMS, **kw}, task)


def by_mllib(s, train, valid=None, **kw):
    learner = GBTRegressor if s.task == "regression" else GBTClassifier
    extra = {"validationIndicatorCol": valid, "validationTol": 0.0} if valid else {}
    gbt = learner(labelCol=s.label, featuresCol="features", seed=ML.SEED, maxBins=64, **{**PARAMS, **kw}, **extra)
    return Pipeline(stages=[*s.assembler().getStages(), gbt]).fit(train)


def test_two_classes_equal_mllib(rows):
    s = spec("binary", "y")
    new, old = ML.fit(s, rows), by_mllib(s, rows)
    got, want = (np.array([r[0] for r in m.transform(rows).orderBy("id").select(vector_to_array("probability")[1]).collect()]) for m in (new, old))
    assert got == pytest.approx(want, abs=1e-9)
    assert new.boosted.importances() == pytest.approx(old.stages[-1].featureImportances.toArray().tolist(), abs=1e-9)
    assert new.boosted.round_losses(new.stages.transform(rows), "y") == pytest.approx(old.stages[-1].evaluateEachIteration(old.transform(rows)), abs=1e-9)


def test_numbers_equal_mllib(rows):
    s = spec("regression", "z")
    got, want = ([r[0] for r in m.transform(rows).orderBy("id").select("prediction").collect()] for m in (ML.fit(s, rows), by_mllib(s, rows)))
    assert got == pytest.approx(want, abs=1e-9)


def test_early_stop_equals_mllib(rows):
    s = spec("binary", "y", maxIter=14, stepSize=0.9)
    new, old = ML.fit(s, rows, "v"), by_mllib(s, rows, "v", maxIter=14, stepSize=0.9)
    assert ML.rounds_used(new) == old.stages[-1].getNumTrees < 14


def test_a_fit_caches_nothing_and_scans_bytes(spark, rows, monkeypatch):
    """A level is one scan of written rows of a byte a feature; no row stays cached."""
    scans, level = [], T.level_sums
    monkeypatch.setattr(T, "level_sums", lambda *a: scans.append(a[0]) or level(*a))
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    ML.fit(spec("binary", "y"), rows)
    B.boost(ML.fit(spec("binary", "y", maxIter=1), rows).stages.transform(rows), B.Softmax(3), "few", rounds=2, depth=2)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    assert len(scans) <= 6 * 3 + 3 + 2 * 2 and all(s.schema["bins"].dataType.simpleString() == "binary" for s in scans)


def test_a_share_of_the_rows_a_round(rows):
    draw = np.random.default_rng(1).integers(0, 1 << 53, 20_000)
    picks = [T.drawn(draw, r, 0.6) for r in range(3)]
    assert all(0.58 < p.mean() < 0.62 for p in picks) and (picks[0] & picks[1]).mean() == pytest.approx(0.36, abs=0.02)
    some = ML.fit(spec("binary", "y", subsamplingRate=0.6), rows)
    assert ML.rounds_used(some) == 6


def test_models_come_back_from_files(spark, rows, tmp_path):
    for s in (spec("binary", "y"), spec("regression", "z")):
        model = ML.fit(s, rows)
        model.save(str(tmp_path / s.task), spark)
        again = ML.GradientModel.load(str(tmp_path / s.task), spark)
        a, b = (m.transform(rows).orderBy("id").select("prediction").collect() for m in (model, again))
        assert a == b


def test_missing_labels_are_refused(rows):
    for bad in (F.when(F.col("id") > 3, F.col("y")), F.col("y") + 1):
        with pytest.raises(ValueError):
            ML.fit(spec("binary", "y"), rows.withColumn("y", bad))


def test_validation_that_never_stops_early(rows):
    """the losses after the last round come from a scan without trees; it failed once every round had been used."""
    s = spec("binary", "y", maxIter=2)
    model = ML.fit(s, rows, "v")
    assert ML.rounds_used(model) == 2 and len(model.boosted.losses) == 2
    own = model.boosted.round_losses(model.stages.transform(rows.where("v")), "y")
    assert [valid for _, valid in model.boosted.losses] == pytest.approx(own, abs=1e-9)


def test_loss_curve_from_the_fit_itself(rows, monkeypatch):
    """both sides' losses come with the fit's own scans and equal those of a model fitted on the training side."""
    from touchline.operators.folds import stratified_split
    s = spec("binary", "y", maxIter=4)
    sides = stratified_split(rows, "id", "y", 2, 42)
    train, valid = sides.where("split = 'train'"), sides.where("split = 'test'")
    model = ML.fit(s, train)
    want = [model.boosted.round_losses(model.stages.transform(side), "y") for side in (train, valid)]
    monkeypatch.setattr(B.Boosted, "round_losses", None)
    got = ML.loss_curve(s, rows, "id").orderBy("round").collect()
    assert [r["round"] for r in got] == [1, 2, 3, 4]
    assert [[r["train_loss"] for r in got], [r["valid_loss"] for r in got]] == [pytest.approx(w, abs=1e-9) for w in want]


def test_threshold_rows_are_chosen_before_vectors_are_made(spark):
    """only the rows that thresholds come from pass through the feature stages for them."""
    from pyspark.ml.feature import VectorAssembler
    df, seen = spark.range(30_000).select((F.col("id") % 997).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("y")), []

    def features(d):
        seen.append(d)
        return VectorAssembler(inputCols=["a"], outputCol="features").transform(d)

    B.boost(df, B.Binary(), "y", rounds=1, depth=1, features=features)
    assert sorted(d.count() > 1.2 * T.SPLIT_ROWS for d in seen) == [False, True]


def test_trials_share_rows_and_scans(spark, rows, monkeypatch):
    """models grown side by side equal those fitted one by one, in as many scans as the longest of them takes."""
    trials = [{"maxIter": 2, "maxDepth": 3, "stepSize": 0.4}, {"maxIter": 11, "maxDepth": 2, "stepSize": 0.1, "subsamplingRate": 0.7}, {"maxIter": 0, "maxDepth": 1}]
    s, scans, level = spec("binary", "y"), [], T.level_sums
    alone = [ML.fit(s.with_params(**{"subsamplingRate": 1.0, **t}), rows) for t in trials]
    monkeypatch.setattr(T, "level_sums", lambda *a: scans.append(1) or level(*a))
    together = ML.fit_trials(s, trials, rows)
    assert len(scans) <= 2 * 3 + 9 * 2
    assert [[[t.to_dict() for t in r] for r in m.boosted.rounds] for m in together] == [[[t.to_dict() for t in r] for r in m.boosted.rounds] for m in alone]
    monkeypatch.setattr(T, "DRIVER_BYTES", 0)       # sums of the tasks by a shuffle
    assert [t.to_dict() for t in ML.fit(s, rows).boosted.rounds[0]][0]["feature"] == [t.to_dict() for t in ML.fit_trials(s, [s.params], rows)[0].boosted.rounds[0]][0]["feature"]
    losses = ML.trial_losses(s, trials[:2], ML.fold_table(s, rows, "id", 2, 1), 2)
    want = [-ML.score_table(ML.cross_val_oof(s.with_params(**{"subsamplingRate": 1.0, **t}), rows, "id", 2, 1), "y", "log_loss") for t in trials[:2]]
    assert losses == pytest.approx(want, rel=1e-9)


def test_a_row_comes_down_a_tree_by_table():
    """Lopsided trees, sets of categories, leaves at every level: as by walking node by node."""
    rng = np.random.default_rng(5)
    for depth in (0, 1, 4):
        tree = T.Tree.empty(depth, 8)
        for node in range(2 ** depth - 1):
            if node == 0 or tree.feature[(node - 1) // 2] >= 0 and rng.random() < 0.7:
                tree.feature[node], tree.left[node] = rng.integers(3), rng.random(8) < 0.5
        tree.value = rng.random(len(tree.value))
        x = rng.integers(0, 8, (3, 200)).astype(np.uint8)

        def walk(r, node=0):
            f = tree.feature[node]
            return tree.value[node] if f < 0 else walk(r, 2 * node + (1 if tree.left[node, x[f, r]] else 2))

        assert tree.predict(x).tolist() == [walk(r) for r in range(200)]
        assert tree.predict(x[:, :0]).tolist() == []

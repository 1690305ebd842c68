"""Model invariants on a small slice of the supplied passes (few rounds)."""

import math

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    from touchline.plans.q_models import frame as mk
    return mk(spark, SF).cache()


def _spec():
    from touchline.operators import modeling as ML
    return ML.ModelSpec(["length", "duration", "start_x"], ["height"], "label",
                        {"maxIter": 3, "maxDepth": 2, "stepSize": 0.3})


def test_oof_covers_each_row_once_and_probabilities_valid(spark, frame):
    from touchline.operators import modeling as ML
    oof = ML.cross_val_oof(_spec(), frame, "pass_id", k=3)
    n = frame.count()
    assert oof.count() == n
    assert oof.select("pass_id", "fold").distinct().count() == frame.select("pass_id").distinct().count() or \
        oof.count() == n
    lo, hi = oof.agg(F.min("p"), F.max("p")).first()
    assert 0.0 <= lo <= hi <= 1.0


def test_importances_sum_to_one(spark, frame):
    from touchline.operators import modeling as ML
    m = ML.fit(_spec(), frame)
    imp = ML.importances(_spec(), m)
    assert abs(sum(v for _, v in imp) - 1.0) < 1e-9


def test_bic_curve_finite(spark):
    from touchline.operators.density import gmm_bic_curve
    from touchline.plans.q_density import pts
    b = gmm_bic_curve(pts(spark, SF), [1, 2], seed=1).collect()
    assert all(math.isfinite(r["bic"]) for r in b)


def test_densities_integrate_to_about_one(spark):
    from touchline.operators.density import kde_grid, mixture_density, pitch_grid
    from touchline.plans.q_density import comps, pts
    cell = (120.0 / 119) * (80.0 / 79)
    g = mixture_density(pitch_grid(spark), comps(spark, SF)).agg(F.sum("density")).first()[0] * cell
    k = kde_grid(pts(spark, SF)).agg(F.sum("density")).first()[0] * cell
    assert 0.7 < g < 1.05 and 0.7 < k < 1.05


def test_batch_score_argmax_rule(spark, frame):
    from touchline.operators import modeling as ML
    m = ML.fit(_spec(), frame)
    out = ML.batch_score(m, frame, ["pass_id"], "gbt")
    bad = out.where(((F.col("prediction") == 1) & (F.col("probability") <= 0.5)) |
                    (F.col("probability") < 0.5)).count()
    assert bad == 0


def _numbers(spark, n):
    return spark.range(n).select("id", (F.col("id") % 7).cast("double").alias("a"), ((F.col("id") * 31) % 11).cast("double").alias("b"),
                                 (F.col("id") % 3 == 0).cast("double").alias("label"))


def test_bic_curve_takes_one_scan_a_step_and_mllibs_values(spark, monkeypatch):
    from touchline.operators import density as D
    rows = spark.range(400).select((F.rand(3) * 10 + F.col("id") % 2 * 30).alias("x"), (F.rand(4) * 8 + F.col("id") % 3 * 20).alias("y")).cache()
    by_mllib = {k: D.fit_gmm(rows, k, 5)[0].summary.logLikelihood for k in (2, 3)}
    steps, em = [], D.em_sums
    monkeypatch.setattr(D, "em_sums", lambda *a: steps.append(len(a[1])) or em(*a))
    found = {r["k"]: r["log_likelihood"] for r in D.gmm_bic_curve(rows, [1, 2, 3], seed=5).collect()}
    for k, ll in by_mllib.items():
        assert found[k] == pytest.approx(ll, rel=1e-9)
    assert len(steps) <= 100 and steps[0] == 2


def test_trials_deal_out_the_folds_once_and_leave_no_files(spark, monkeypatch):
    import os

    from touchline.operators import modeling as ML
    from touchline.session import checkpoint_dir
    spec = ML.ModelSpec(["a", "b"], [], "label", {"maxIter": 1, "maxDepth": 2})
    dealt, deal = [], ML.fold_rows
    monkeypatch.setattr(ML, "fold_rows", lambda *a: dealt.append(1) or deal(*a))
    monkeypatch.setattr(ML, "sample_params", lambda n, seed: [{"maxIter": 1, "maxDepth": 1 + i, "stepSize": 0.1, "subsamplingRate": 1.0} for i in range(n)])
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = {f for f in os.listdir(folder) if f.startswith("folds-")}
    assert ML.param_search(spec, _numbers(spark, 200), "id", n_trials=3, k=2).count() == 3
    ML.forward_selection(spec, _numbers(spark, 200), "id", k=2)
    assert len(dealt) == 2
    assert {f for f in os.listdir(folder) if f.startswith("folds-")} == before


def test_large_folds_are_fitted_one_after_the_other(spark, monkeypatch):
    import threading

    from touchline.operators import modeling as ML
    spec = ML.ModelSpec(["a", "b"], [], "label", {"maxIter": 1, "maxDepth": 1})
    running, most, lock, fit = [], [], threading.Lock(), ML.fit

    def watched(*a):
        with lock:
            running.append(1)
            most.append(len(running))
        try:
            return fit(*a)
        finally:
            with lock:
                running.pop()

    monkeypatch.setattr(ML, "fit", watched)
    monkeypatch.setattr(ML, "ROWS_AT_ONCE", 100)
    assert ML.cross_val_oof(spec, _numbers(spark, 200), "id", k=3).count() == 200
    assert max(most) == 1 and len(most) == 3


def test_files_of_written_rows_are_bounded(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    from touchline import session
    from touchline.sources import io
    monkeypatch.setattr(session, "FILE_ROWS", 100)
    monkeypatch.setattr(io, "FILE_ROWS", 100)
    io.write_partitioned(_numbers(spark, 1000), str(tmp_path / "view"), "label")
    kept = session.stored(_numbers(spark, 1000).coalesce(1), "bounded")
    assert kept.count() == spark.read.parquet(str(tmp_path / "view")).count() == 1000
    files = [f.removeprefix("file://") for f in kept.inputFiles()] + [str(f) for f in (tmp_path / "view").rglob("*.parquet")]
    assert max(pq.ParquetFile(f).metadata.num_rows for f in files) <= 100
    session.discard(kept)


def test_key_counts_hold_one_buffer_column_a_set(spark):
    from touchline.operators import formula as FM
    rows = _numbers(spark, 1000)
    found = FM.key_counts(rows, [("a",), ("b",), ("a", "b")])
    assert 7 <= found["a",] <= 9 and 11 <= found["b",] <= 14 and 77 <= found["a", "b"] <= 92
    assert FM.key_counts(rows.where("id < 0"), [("a",)])["a",] >= 0


def test_em_sums_equal_numpy_near_and_far(spark):
    """one step against sums point by point; a far component, a weight of zero and a covariance of one direction among them."""
    import numpy as np

    from touchline.operators import density as D
    rng = np.random.default_rng(2)
    pts = rng.random((300, 2)) * [120, 80]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double").repartition(3)
    flat = np.array([[4.0, 2.0], [2.0, 1.0]])
    ms = [D.Mixture(np.array([0.6, 0.4, 0.0]), np.array([[20.0, 30.0], [1e5, 9.0], [60.0, 40.0]]), np.array([np.eye(2) * 90, np.eye(2) * 0.01, np.eye(2)])),
          D.Mixture(np.array([0.3, 0.7]), np.array([[60.0, 40.0], [70.0, 10.0]]), np.array([np.eye(2) * 400, flat * 50]))]
    for m, got, ll in zip(ms, *D.em_sums(df, ms, "x", "y")):
        p = np.empty((300, len(m.weights)))
        for k, (w, mean, cov) in enumerate(zip(m.weights, m.means, m.covs)):
            root, logdet = D._root_inverse(cov)
            p[:, k] = D.EPSILON + w * np.exp(-0.5 * (2 * D.LN_2PI + logdet + (((pts - mean) @ root.T) ** 2).sum(axis=1)))
        total = p.sum(axis=1)
        assert ll == pytest.approx(np.log(total).sum(), rel=1e-12)
        x, y = pts.T
        want = (p / total[:, None]).T @ np.stack([np.ones(300), x, y, x * x, x * y, y * y], axis=1)
        assert got == pytest.approx(want, rel=1e-9)

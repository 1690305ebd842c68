"""Registered queries against their DuckDB oracles on the smallest supplied tables."""

import hashlib
import os

import duckdb
import pytest

from touchline.plans import registry
from touchline.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
registry.load_all()
FAST = ["fitted_groupby_then_mean", "pass_geometry", "derive_features", "groupby_then_rank", "groupby_then_median",
        "combine", "fitted_combine", "prepared_runs", "metric_by_experiment", "roc_curve", "roc_auc",
        "calibration_curve", "possession_points", "avg_position_lineup", "describe_numeric", "mutual_info_binned",
        "candidate_features", "stage1_scores", "gmm_pdf_grid", "one_hot", "dummy_encode", "stratified_folds", "mutual_info_knn", "mutual_info_regression"]


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.md5("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    if not os.path.exists(SF):
        pytest.skip("test data not present")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = con.execute(registry.ORACLES[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(df.columns, srows) == _digest(dcols, drows)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)

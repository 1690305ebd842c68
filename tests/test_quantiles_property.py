"""Property test: exact grouped quantiles equal numpy's on random grouped data."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from touchline.operators.stats import grouped_quantiles

QS = [0.1, 0.25, 0.5, 0.75, 0.9]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-50, 50)), min_size=1, max_size=80))
def test_grouped_quantiles_match_numpy(spark, rows):
    df = spark.createDataFrame([(k, float(v)) for k, v in rows], "k string, v double")
    lin = {(r["k"], r["q"]): r["value"] for r in grouped_quantiles(df, "k", "v", QS).collect()}
    disc = {(r["k"], r["q"]): r["value"] for r in grouped_quantiles(df, "k", "v", QS, linear=False).collect()}
    for k in {k for k, _ in rows}:
        vals = np.sort(np.array([v for kk, v in rows if kk == k], dtype=float))
        for q in QS:
            assert abs(lin[(k, q)] - np.quantile(vals, q)) < 1e-9
            assert disc[(k, q)] == vals[int(np.floor(q * (len(vals) - 1)))]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.sampled_from(["p", "q", "r", None])),
                min_size=1, max_size=60))
def test_combine_ids_match_first_appearance(spark, rows):
    import pandas as pd
    from touchline.operators.formula import derive_features
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "rid long, a string, b string")
    got = [r["c"] for r in derive_features(df, ["Combine(a,b)"], order_col="rid", names={"Combine(a,b)": "c"},
                                           keep=["rid"]).orderBy("rid").collect()]
    pairs = pd.Series([f"{a}\x00{b}" if a is not None and b is not None else None for a, b in rows])
    codes, _ = pd.factorize(pairs)
    assert got == [float(c) for c in codes]

"""k-NN mutual information against brute force, with ties, hot values and edge rows."""

import math

import numpy as np
import pytest

from touchline.operators import information as IN


def psi(v):
    res = 0.0
    while v < 30:
        res -= 1.0 / v
        v += 1
    return res + math.log(v) - 1 / (2 * v) - 1 / (12 * v * v) + 1 / (120 * v ** 4) - 1 / (252 * v ** 6)


def steps(v):
    v = np.asarray(v, dtype=float)
    dev = v.std()
    return np.rint((v - v.min()) / dev * 2.0 ** 30).astype(np.int64) if dev else np.zeros(len(v), dtype=np.int64)


def nearer(v, i, r):
    d = np.abs(v - v[i])
    return int(np.sum(d < r)) if r else int(np.sum(d == 0))


def numbers(x, y, k):
    x, y, n = steps(x), steps(y), len(x)
    k = min(k, n - 1)
    a = b = 0.0
    for i in range(n):
        r = np.sort(np.maximum(np.abs(x - x[i]), np.abs(y - y[i])))[k]
        a, b = a + psi(nearer(x, i, r)), b + psi(nearer(y, i, r))
    return max(0.0, psi(n) + psi(k) - a / n - b / n)


def classes(x, y, k):
    sizes = {v: int(np.sum(y == v)) for v in set(y.tolist())}
    x = steps(x)
    few = np.array([sizes[v] > 1 for v in y.tolist()])
    x, y = x[few], y[few]
    a = b = m = 0.0
    for i in range(len(x)):
        size = sizes[y[i]]
        own = min(k, size - 1)
        r = np.sort(np.abs(x[y == y[i]] - x[i]))[own]
        a, b, m = a + psi(own), b + psi(size), m + psi(nearer(x, i, r))
    n = len(x)
    return max(0.0, psi(n) + (a - b - m) / n)


def frame(spark, x, y):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")


def cases():
    rng = np.random.default_rng(11)
    x = rng.normal(size=700)
    hot = rng.normal(size=600)
    hot[:300] = 1.25                                   # half of the rows share one value
    grid = rng.integers(0, 12, 500).astype(float)
    tail = rng.standard_cauchy(400)                    # far outliers visit many strips
    return {"linked": (x, x + 0.3 * rng.normal(size=700)), "hot": (hot, hot + (rng.random(600) < 0.5)),
            "grid": (grid, (grid + rng.integers(0, 3, 500)) % 12), "tail": (tail, np.abs(tail) ** 0.5),
            "flat": (np.full(40, 3.0), rng.normal(size=40)), "same": (np.full(9, 1.0), np.full(9, 2.0)),
            "two": (np.array([0.0, 1.0]), np.array([5.0, 7.0]))}


@pytest.mark.parametrize("name", list(cases()))
def test_numbers_equal_brute_force(spark, name):
    x, y = cases()[name]
    row = IN.mutual_info_numbers(frame(spark, x, y), "x", "y").first()
    assert row["n"] == len(x)
    assert row["mutual_info"] == pytest.approx(numbers(x, y, 3), abs=1e-9)


@pytest.mark.parametrize("name", ["hot", "grid", "same"])
def test_classes_equal_brute_force(spark, name):
    x, _ = cases()[name]
    y = (np.arange(len(x)) * 7 % 5 > 1).astype(int) + (np.asarray(x) > 1.2)
    y[0] = 9                                           # a class of one row is ignored
    row = IN.mutual_info_classes(frame(spark, x, y), "x", "y").first()
    assert row["n"] == len(x) - 1
    assert row["mutual_info"] == pytest.approx(classes(np.asarray(x), y, 3), abs=1e-9)


def test_many_strips_find_all_neighbours(spark):
    """A small reach makes many strips; all radii equal those of the full table."""
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 1000, 1500), rng.integers(0, 40, 1500)
    points = sorted(set(zip(x.tolist(), y.tolist())))
    df = spark.createDataFrame([(a, b, 1 + (a + b) % 3) for a, b in points], "x long, y long, c long")
    got = {(r["x"], r["y"]): r["radius"] for r in IN.neighbour_radius(df, 3, reach=4).collect()}
    px, py = np.array(points).T
    weight = 1 + (px + py) % 3
    for a, b in points:
        d = np.repeat(np.maximum(np.abs(px - a), np.abs(py - b)), weight)
        assert got[(a, b)] == np.sort(d)[3]


def test_missing_values_and_empty_tables(spark):
    rows = [(1.0, 2.0), (None, 1.0), (2.0, None), (float("nan"), 1.0), (3.0, float("inf")), (2.0, 1.0), (4.0, 4.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert IN.mutual_info_numbers(df, "x", "y").first()["n"] == 3
    empty = df.limit(0)
    for found in (IN.mutual_info_numbers(empty, "x", "y").first(), IN.mutual_info_classes(empty, "x", "y").first()):
        assert found["n"] == 0 and found["mutual_info"] is None

"""Mutual information by k nearest neighbours, for a class or a number as the label.

Values are measured in whole steps of 2**-30 standard deviations, so distances
and intervals are exact integers: equal on every engine, and one radius means
the same on both sides of a point.  Equal points are one row with a count
before anything is compared, so a value that most rows share is one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators.ordinal import prefix_sum, row_number0
from touchline.operators.stats import attach_scalars, digamma
from touchline.session import cut_lineage, ship_package

#: Steps a standard deviation.
STEPS = float(1 << 30)
#: Points looked at on each side, in y order, for the first radius.
REACH = 32
#: Point pairs compared at once inside a task.
BLOCK = 1 << 20


def in_steps(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns (output: input) as whole steps above their minimum; a column without
    spread is 0.  A range is at most sqrt(2n) deviations, far inside 64 bits."""
    real = [F.col(c).cast("double") for c in columns.values()]
    facts = df.agg(*[f(c).alias(f"__{kind}{i}") for i, c in enumerate(real)
                     for kind, f in (("low", F.min), ("dev", F.stddev_pop))])
    rows = attach_scalars(df, facts)
    return rows.withColumns({out: F.coalesce(F.round(F.try_divide(c - F.col(f"__low{i}"), F.col(f"__dev{i}")) * STEPS), F.lit(0.0))
                             .cast("long") for i, (out, c) in enumerate(zip(columns, real))}).drop(*facts.columns)


def finite(column: str) -> Column:
    value = F.col(column).cast("double")
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def count_within(points: DataFrame, at: str, radius: str, weight: str, keys: list[str], out: str) -> DataFrame:
    """``points`` with ``out``: the weight of all points nearer than ``radius`` along
    ``at``, the point included; at radius 0 of those with the same value.

    A difference of two prefix sums over points and interval ends, ordered once.
    ``keys`` name a point; the other columns are carried through its two ends."""
    rest = [c for c in points.columns if c not in keys]
    zero = F.col(radius) == 0
    none = [F.lit(None).cast(t).alias(c) for c, t in points.dtypes]
    weights = points.groupBy(F.col(at).alias("__v")).agg(F.sum(weight).alias("__w"))
    own = weights.select("__v", F.lit(1).alias("__place"), "__w", F.lit(None).cast("boolean").alias("__upper"), *none)
    upper = points.select((F.col(at) + F.col(radius)).alias("__v"), F.when(zero, 2).otherwise(0).alias("__place"),
                          F.lit(0).cast("long").alias("__w"), F.lit(True).alias("__upper"), *points.columns)
    lower = points.select((F.col(at) - F.col(radius)).alias("__v"), F.when(zero, 0).otherwise(2).alias("__place"),
                          F.lit(0).cast("long").alias("__w"), F.lit(False).alias("__upper"), *points.columns)
    events = cut_lineage(own.unionByName(upper).unionByName(lower))           # read for cut points, totals and sums
    summed = prefix_sum(events, [], ["__v", "__place"], {"__before": F.col("__w")}).where("__upper is not null")
    ends = F.sum(F.when(F.col("__upper"), F.col("__before")).otherwise(-F.col("__before")))
    return summed.groupBy(*keys).agg(*[F.first(c).alias(c) for c in rest], ends.alias(out))


def mutual_info_classes(df: DataFrame, feature: str, label: str, k: int = 3) -> DataFrame:
    """AGG21 exact mode: k-NN estimator of I(X; Y) for a number X and a class Y.
    One row: feature, mutual_info (0 at least), n.

    MI = ψ(N) + ⟨ψ(k_i)⟩ − ⟨ψ(n_label)⟩ − ⟨ψ(m_i)⟩ with k_i = min(k, n_label − 1),
    the radius to the k_i-th neighbour of the same label and m_i all points nearer
    than that.  Works on the count of each (label, value): the k-th neighbour is a
    copy, or among the k distinct values on either side (2k lookups by rank).
    Rows without a finite value or a label, and labels with one row, are ignored;
    without rows, mutual_info is null and n is 0."""
    base = df.where(finite(feature) & F.col(label).isNotNull()).select(F.col(feature), F.col(label).alias("lab"))
    counts = cut_lineage(in_steps(base, {"x": feature}).groupBy("lab", "x").agg(F.count(F.lit(1)).alias("c")))
    ranked = prefix_sum(counts, ["lab"], ["x"], {"r": F.lit(1), "less": F.col("c")}, totals={"n_lab": "less"})
    ranked = cut_lineage(ranked.where("n_lab > 1").select("lab", "x", "c", "r", "n_lab"))
    offsets = F.array(*[F.lit(o) for o in range(-k, k + 1)])
    look = ranked.select("lab", "x", "c", "n_lab", "r", F.explode(offsets).alias("o")).withColumn("r2", F.col("r") + F.col("o"))
    there = ranked.select("lab", F.col("r").alias("r2"), F.col("x").alias("x2"), F.col("c").alias("c2"))
    near = look.join(there, ["lab", "r2"]).groupBy("lab", "x").agg(
        F.first("c").alias("c"), F.first("n_lab").alias("n_lab"),
        F.array_sort(F.collect_list(F.struct(F.abs(F.col("x2") - F.col("x")).alias("d"), F.col("c2").alias("w")))).alias("near"))
    points = near.withColumn("k_i", F.least(F.lit(k), F.col("n_lab") - 1).cast("long"))
    points = points.select("lab", "x", "c", "n_lab", "k_i", reaching(F.col("near"), F.col("k_i") + 1).alias("radius"))
    counted = count_within(cut_lineage(points), "x", "radius", "c", ["lab", "x"], "m")

    def mean(c: str) -> Column:
        return F.sum(digamma(F.col(c).cast("double")) * F.col("c")) / F.sum("c")
    agg = counted.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), mean("k_i").alias("a"), mean("n_lab").alias("b"), mean("m").alias("m"))
    mi = F.when(F.col("n") > 0, digamma(F.col("n").cast("double")) + F.col("a") - F.col("b") - F.col("m"))
    return agg.select(F.lit(feature).alias("feature"), floored(mi).alias("mutual_info"), "n")


def floored(mi: Column) -> Column:
    return F.when(mi.isNotNull(), F.greatest(mi, F.lit(0.0)))


def reaching(near: Column, wanted: Column) -> Column:
    """The distance at which the weights of (d, w), sorted by d, first reach ``wanted``."""
    start = F.struct(F.lit(0).cast("long").alias("had"), F.lit(0).cast("long").alias("d"))
    return F.aggregate(near, start, lambda s, t: F.when(s["had"] >= wanted, s).otherwise(
        F.struct((s["had"] + t["w"]).alias("had"), t["d"].alias("d"))))["d"]


def _nearest(who: np.ndarray, d: np.ndarray, w: np.ndarray, wanted: int) -> np.ndarray:
    """Rows, by point and distance, that a point needs to reach the weight ``wanted``."""
    order = np.lexsort((d, who))
    who, w = who[order], w[order]
    total = np.cumsum(w)
    first = np.searchsorted(who, who)
    before = total - w - (total[first] - w[first])
    return order[before < wanted]


def _spans(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the span, place) of all places in low..high, about BLOCK at once."""
    size = high - low
    ends = np.cumsum(size)
    at = 0
    while at < len(low):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + BLOCK, side="right")))
        n = size[at:to]
        who = np.repeat(np.arange(at, to), n)
        yield who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + low[who]
        at = to


def _first_radius(table: pa.Table, wanted: int, reach: int) -> pa.Table:
    """A radius within which each point of a strip surely has its neighbours: the
    one among the points next to it in y order."""
    table = table.combine_chunks().sort_by([("y", "ascending"), ("x", "ascending")])
    x, y, c = (table.column(n).to_numpy() for n in ("x", "y", "c"))
    low = np.clip(np.arange(len(x)) - reach, 0, max(0, len(x) - 2 * reach - 1))
    high = np.minimum(low + 2 * reach + 1, len(x))
    radius = np.zeros(len(x), dtype=np.int64)
    for who, place in _spans(low, high):
        d = np.maximum(np.abs(x[place] - x[who]), np.abs(y[place] - y[who]))
        need = _nearest(who, d, c[place], wanted)
        np.maximum.at(radius, who[need], d[need])
    return table.append_column("radius", pa.array(radius))


def _search(seekers: pa.Table, points: pa.Table, wanted: int) -> pa.Table:
    """What each seeker needs of a strip's points: (x, y, c, d, w) rows."""
    points = points.combine_chunks().sort_by("y")
    px, py, pc = (points.column(n).to_numpy() for n in ("x", "y", "c"))
    x, y, c, r = (seekers.column(n).to_numpy() for n in ("x", "y", "c", "radius"))
    found = [[np.zeros(0, dtype=np.int64)] for _ in range(5)]
    for who, place in _spans(np.searchsorted(py, y - r), np.searchsorted(py, y + r, side="right")):
        d = np.maximum(np.abs(px[place] - x[who]), np.abs(py[place] - y[who]))
        inside = d <= r[who]
        who, place, d = who[inside], place[inside], d[inside]
        need = _nearest(who, d, pc[place], wanted)
        for out, part in zip(found, (x[who[need]], y[who[need]], c[who[need]], d[need], pc[place[need]])):
            out.append(part)
    return pa.table({n: np.concatenate(f) for n, f in zip(("x", "y", "c", "d", "w"), found)})


def neighbour_radius(points: DataFrame, k: int, reach: int = REACH) -> DataFrame:
    """(x, y, c, radius): the larger of |dx| and |dy| to each point's k-th neighbour,
    copies included, for distinct points (x, y) with counts c.

    Points are cut by rank into strips of about sqrt(2 * reach * n) points along x.
    Inside its strip a point's neighbours in y order give a first radius; the
    point then visits only the strips that this square meets, where a window in y
    order is searched.  Strips have equal sizes by rank, so tied or crowded values
    make none longer; their borders, about sqrt(n / (2 * reach)) rows, come to the
    driver.  Each visit returns at most k + 1 rows."""
    ship_package(points.sparkSession)
    reach = max(reach, k + 1)
    n = points.count()
    width = max(2 * reach + 1, math.ceil(math.sqrt(2 * reach * n)))
    strips = max(1, n // width)
    order = row_number0(points, [], ["x", "y"], out="__r")
    cut = cut_lineage(order.select("x", "y", "c", F.least(F.floor(F.col("__r") / width), F.lit(strips - 1)).cast("int").alias("strip")))
    first = cut_lineage(cut.groupBy("strip").applyInArrow(lambda t: _first_radius(t, k + 1, reach),
                                                          "x long, y long, c long, strip int, radius long"))
    box = cut.groupBy("strip").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).orderBy("strip").collect()
    names, x0, x1, y0, y1 = (np.array([row[i] for row in box], dtype=np.int64) for i in range(5))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, c, r = (batch.column(i).to_numpy() for i in range(4))
            for who, place in _spans(np.searchsorted(x1, x - r), np.searchsorted(x0, x + r, side="right")):
                meets = (y0[place] <= y[who] + r[who]) & (y1[place] >= y[who] - r[who])
                who, place = who[meets], place[meets]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (x[who], y[who], c[who], r[who], names[place])],
                                                 names=["x", "y", "c", "radius", "strip"])

    seekers = first.select("x", "y", "c", "radius").mapInArrow(visits, "x long, y long, c long, radius long, strip long")
    seekers = seekers.withColumn("strip", F.col("strip").cast("int"))
    found = seekers.groupBy("strip").cogroup(cut.groupBy("strip")).applyInArrow(
        lambda a, b: _search(a, b, k + 1), "x long, y long, c long, d long, w long")
    near = found.groupBy("x", "y").agg(F.first("c").alias("c"), F.array_sort(F.collect_list(F.struct("d", "w"))).alias("near"))
    return near.select("x", "y", "c", reaching(F.col("near"), F.lit(k + 1)).alias("radius"))


def mutual_info_numbers(df: DataFrame, feature: str, label: str, k: int = 3) -> DataFrame:
    """AGG21 exact mode, regression: k-NN estimator of I(X; Y) for two numbers.
    One row: feature, mutual_info (0 at least), n.

    MI = ψ(N) + ψ(k) − ⟨ψ(n_x)⟩ − ⟨ψ(n_y)⟩: both columns are scaled to unit deviation,
    the radius is the larger of |dx| and |dy| to the k-th neighbour (k at most
    N − 1), n_x and n_y are all points nearer than that along one column, the point
    included.  Rows without two finite values are ignored; with fewer than two
    rows, mutual_info is null."""
    base = df.where(finite(feature) & finite(label)).select(F.col(feature).cast("double").alias("__x"), F.col(label).cast("double").alias("__y"))
    points = cut_lineage(in_steps(base, {"x": "__x", "y": "__y"}).groupBy("x", "y").agg(F.count(F.lit(1)).alias("c")))
    n = points.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    if n < 2:
        return points.agg(F.lit(feature).alias("feature"), F.lit(None).cast("double").alias("mutual_info"),
                          F.coalesce(F.sum("c"), F.lit(0)).alias("n"))
    k = min(k, n - 1)
    rows = cut_lineage(neighbour_radius(points, k))
    rows = count_within(rows, "x", "radius", "c", ["x", "y"], "n_x")
    rows = count_within(rows, "y", "radius", "c", ["x", "y"], "n_y")

    def mean(c: str) -> Column:
        return F.sum(digamma(F.col(c).cast("double")) * F.col("c")) / F.sum("c")
    agg = rows.agg(F.sum("c").alias("n"), mean("n_x").alias("a"), mean("n_y").alias("b"))
    mi = digamma(F.col("n").cast("double")) + digamma(F.lit(float(k))) - F.col("a") - F.col("b")
    return agg.select(F.lit(feature).alias("feature"), floored(mi).alias("mutual_info"), "n")

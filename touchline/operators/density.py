"""Spatial densities on the pitch: closed-form Gaussian, mixture density on a grid,
component ellipses, kernel density, MLlib mixture fits and sampling.

Grid evaluation never joins the grid with data rows: a mixture's components
(bounded, checked) ride along as one broadcast array; the kernel density folds
every (exactly de-duplicated) point's kernel over the fixed grid and sums
partial grids per task, so its work is linear in distinct points.
"""

from __future__ import annotations

import math
import sys
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions.scalar import PITCH_X, PITCH_Y
from touchline.operators.stats import attach_scalars
from touchline.session import cut_lineage, ship_package

REG_COVAR = 1e-6          # fixed value: diagonal regulariser of mixture covariances
MAX_COMPONENTS = 1000
POINTS_PER_TASK = 4096    # distinct points whose kernels one task folds over the grid
POINTS_OF_EM = 65_536     # points of one task in an EM step
PAIRS_AT_ONCE = 262_144   # point-component pairs held by a task at once
EPSILON = sys.float_info.epsilon      # MLlib's: added to each component's share of a point
LEAST_LOG = -75.0         # a share below e^-75 is lost beside EPSILON; exp is slow where it underflows
LN_2PI = math.log(2.0 * math.pi)


def gaussian_k1(points: DataFrame, by: list[str] = (), x: str = "x", y: str = "y") -> DataFrame:
    """ML14 with k = 1 in closed form: mean, MLE covariance (+1e-6 on the diagonal),
    log-likelihood and BIC (p = 5 parameters for d = 2)."""
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    g = p.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"),
        F.var_pop(x).alias("sxx"), F.covar_pop(x, y).alias("sxy"), F.var_pop(y).alias("syy"))
    vx = F.col("sxx") + F.lit(REG_COVAR)
    vy = F.col("syy") + F.lit(REG_COVAR)
    det = vx * vy - F.col("sxy") * F.col("sxy")
    # tr(Σ⁻¹ S) with S the MLE covariance
    tr = (vy * F.col("sxx") - 2 * F.col("sxy") * F.col("sxy") + vx * F.col("syy")) / det
    ll = -F.col("n") / 2.0 * (2 * F.lit(LN_2PI) + F.ln(det) + tr)
    return g.select(*by, "n", "mean_x", "mean_y", vx.alias("var_x"), F.col("sxy").alias("cov_xy"),
                    vy.alias("var_y"), ll.alias("log_likelihood"),
                    (-2 * ll + 5 * F.ln(F.col("n"))).alias("bic"))


def mixture_from_groups(k1: DataFrame, id_col: str) -> DataFrame:
    """Weights ∝ points per group: a mixture whose components are per-group Gaussians."""
    tot = k1.agg(F.sum("n").alias("__tot"))
    return attach_scalars(k1, tot).select(
        F.col(id_col).alias("component"), (F.col("n") / F.col("__tot")).alias("weight"),
        "mean_x", "mean_y", "var_x", "cov_xy", "var_y")


def pitch_grid(spark: SparkSession, nx: int = int(PITCH_X), ny: int = int(PITCH_Y)) -> DataFrame:
    """``linspace(0, 120, 120) × linspace(0, 80, 80)`` (spacing 120/119, last point exact)."""
    g = spark.range(nx * ny).select((F.col("id") / ny).cast("int").alias("ix"), (F.col("id") % ny).cast("int")
                                    .alias("iy"))
    sx, sy = PITCH_X / (nx - 1), PITCH_Y / (ny - 1)
    x = F.when(F.col("ix") == nx - 1, F.lit(PITCH_X)).otherwise(F.col("ix") * F.lit(sx))
    y = F.when(F.col("iy") == ny - 1, F.lit(PITCH_Y)).otherwise(F.col("iy") * F.lit(sy))
    return g.select("ix", "iy", x.alias("gx"), y.alias("gy"))


def _normal_pdf(dx, dy, vx, cxy, vy):
    det = vx * vy - cxy * cxy
    q = (vy * dx * dx - 2 * cxy * dx * dy + vx * dy * dy) / det
    return F.exp(-0.5 * q) / (2 * math.pi * F.sqrt(det))


def mixture_density(grid: DataFrame, comps: DataFrame) -> DataFrame:
    """ML15/JN7: Σ wᵢ·N(g; μᵢ, Σᵢ) at every grid point.  Components are gathered into
    one array (count checked) and broadcast with the one-row join."""
    n = comps.count()
    if n > MAX_COMPONENTS:
        raise ValueError(f"{n} components exceed {MAX_COMPONENTS}")
    arr = comps.agg(F.collect_list(F.struct("weight", "mean_x", "mean_y", "var_x", "cov_xy", "var_y"))
                    .alias("__c"))
    g = attach_scalars(grid, arr)
    dens = F.aggregate("__c", F.lit(0.0), lambda acc, c: acc + c["weight"] * _normal_pdf(
        F.col("gx") - c["mean_x"], F.col("gy") - c["mean_y"], c["var_x"], c["cov_xy"], c["var_y"]))
    return g.select("ix", "iy", "gx", "gy", dens.alias("density"))


def ellipses(comps: DataFrame) -> DataFrame:
    """ML16: eigen axes of each 2×2 covariance (larger first), full axis lengths
    2·√λ and the major-axis angle in degrees."""
    a, b, d = F.col("var_x"), F.col("cov_xy"), F.col("var_y")
    half = (a + d) / 2.0
    rad = F.sqrt(((a - d) / 2.0) * ((a - d) / 2.0) + b * b)
    l1, l2 = half + rad, half - rad
    return comps.select("component", "mean_x", "mean_y", (2 * F.sqrt(l1)).alias("width"),
                        (2 * F.sqrt(l2)).alias("height"),
                        F.degrees(F.atan2(b, l1 - d)).alias("angle_deg"))


def _kde_partials(batches, nx: int, ny: int):
    """Per-partition partial grid: Σ count·N(g; p, H)/n over the partition's points
    (numpy inside the task; the points stay partitioned by Spark)."""
    import pandas as pd
    sx, sy = PITCH_X / (nx - 1), PITCH_Y / (ny - 1)
    gx = np.array([PITCH_X if i == nx - 1 else i * sx for i in range(nx)])
    gy = np.array([PITCH_Y if j == ny - 1 else j * sy for j in range(ny)])
    GX, GY = np.meshgrid(gx, gy, indexing="ij")
    GX, GY = GX.ravel(), GY.ravel()
    acc = np.zeros(nx * ny)
    seen = False
    for b in batches:
        if len(b) == 0:
            continue
        seen = True
        hx, hxy, hy, n = (float(b[c].iloc[0]) for c in ("__hx", "__hxy", "__hy", "__n"))
        det = hx * hy - hxy * hxy
        norm = 1.0 / (2 * np.pi * np.sqrt(det) * n)
        px, py, c = b["px"].to_numpy(), b["py"].to_numpy(), b["c"].to_numpy(dtype=float)
        for s in range(0, len(px), 256):            # bounded (256 x grid) working set
            dx = GX[None, :] - px[s:s + 256, None]
            dy = GY[None, :] - py[s:s + 256, None]
            q = (hy * dx * dx - 2 * hxy * dx * dy + hx * dy * dy) / det
            acc += (c[s:s + 256, None] * np.exp(-0.5 * q)).sum(axis=0) * norm
    if seen:
        idx = np.arange(nx * ny)
        yield pd.DataFrame({"ix": (idx // ny).astype("int32"), "iy": (idx % ny).astype("int32"), "partial": acc})


def kde_grid(points: DataFrame, grid_nx: int = int(PITCH_X), grid_ny: int = int(PITCH_Y),
             x: str = "x", y: str = "y") -> DataFrame:
    """JN8: Gaussian kernel density with Scott's bandwidth (covariance · n^(-1/3),
    sample covariance) on the pitch grid.

    Points are first collapsed to exact distinct coordinates with counts (no
    approximation).  Each task folds the kernels of its distinct points into a
    partial grid (vectorised, Arrow batches); partial grids are summed by cell.
    No join between points and grid; work is linear in distinct points and the
    shuffle is one grid per task."""
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("px"), F.col(y).alias("py"))
    stats = p.agg(F.count(F.lit(1)).alias("__n"), F.var_samp("px").alias("__vx"),
                  F.covar_samp("px", "py").alias("__cxy"), F.var_samp("py").alias("__vy"))
    fac = F.pow(F.col("__n"), -1.0 / 3.0)
    stats = stats.select(F.col("__n").cast("double").alias("__n"), (F.col("__vx") * fac).alias("__hx"),
                         (F.col("__cxy") * fac).alias("__hxy"), (F.col("__vy") * fac).alias("__hy"))
    spark = points.sparkSession
    ship_package(spark)
    distinct = cut_lineage(p.groupBy("px", "py").agg(F.count(F.lit(1)).alias("c")))
    # compute-heavy but byte-light: tasks of a bounded number of points, and one per
    # core at least, where AQE would join them by their few bytes
    tasks = max(spark.sparkContext.defaultParallelism, -(-distinct.count() // POINTS_PER_TASK))
    pts = attach_scalars(distinct, stats).repartition(tasks, "px", "py")
    part = pts.mapInPandas(lambda it: _kde_partials(it, grid_nx, grid_ny), "ix int, iy int, partial double")
    sx, sy = PITCH_X / (grid_nx - 1), PITCH_Y / (grid_ny - 1)
    gx = F.when(F.col("ix") == grid_nx - 1, F.lit(PITCH_X)).otherwise(F.col("ix") * F.lit(sx))
    gy = F.when(F.col("iy") == grid_ny - 1, F.lit(PITCH_Y)).otherwise(F.col("iy") * F.lit(sy))
    return part.groupBy("ix", "iy").agg(F.sum("partial").alias("density")) \
        .select("ix", "iy", gx.alias("gx"), gy.alias("gy"), "density")


def fit_gmm(points: DataFrame, k: int, seed: int = 42, x: str = "x", y: str = "y", max_iter: int = 100):
    """ML14: MLlib Gaussian mixture on (x, y); k ≥ 2 (k = 1 is closed form above)."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    vec = VectorAssembler(inputCols=[x, y], outputCol="features").transform(
        points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y))
    return GaussianMixture(k=k, seed=seed, maxIter=max_iter, tol=1e-3).fit(vec), vec


def _root_inverse(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """(root of the pseudo-inverse, log of the pseudo-determinant) as MLlib's
    ``MultivariateGaussian`` has them."""
    values, vectors = np.linalg.eigh(cov)
    held = values > EPSILON * max(values.max(), 0.0) * len(cov)
    if not held.any():
        raise ValueError("covariance matrix has no non-zero singular values")
    scale = np.where(held, 1.0 / np.sqrt(np.where(held, values, 1.0)), 0.0)
    return scale[:, None] * vectors.T, float(np.log(values[held]).sum())


@dataclass
class Mixture:
    """A mixture between two EM steps; ``ll`` is the likelihood found by the last step."""
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    ll: float = -sys.float_info.max
    before: float = 0.0

    def update(self, sums: np.ndarray, ll: float) -> None:
        """``sums``: a row a component, the sums of 1, x, y, xx, xy, yy by responsibility."""
        w = sums[:, 0]
        self.means = sums[:, 1:3] / w[:, None]
        second = sums[:, [3, 4, 4, 5]].reshape(-1, 2, 2)
        self.covs = (second - w[:, None, None] * self.means[:, :, None] * self.means[:, None, :]) / w[:, None, None]
        self.weights = w / w.sum()
        self.before, self.ll = self.ll, ll


def em_sums(points: DataFrame, mixtures: list[Mixture], x: str, y: str) -> tuple[list[np.ndarray], list[float]]:
    """One E step of all mixtures in one scan: each one's ``Mixture.update`` sums and
    log-likelihood.  A task folds its points, some thousand point-component pairs at a
    time, into one row a component; Spark adds those up."""
    ship_package(points.sparkSession)
    sizes = [len(m.weights) for m in mixtures]
    starts = np.cumsum([0, *sizes[:-1]])
    weights, means = np.concatenate([m.weights for m in mixtures]), np.concatenate([m.means for m in mixtures])
    roots, logdets = zip(*[_root_inverse(c) for m in mixtures for c in m.covs])
    # a point's two coordinates in a component's own axes are products of (x, y, 1) with these
    # rows; halved squares and the log of the weight are worked in beforehand
    turned = np.array(roots) * math.sqrt(0.5)
    ends = [*starts[1:].tolist(), len(weights)]
    first, second = (np.column_stack([turned[:, i], -(turned[:, i] * means).sum(axis=1)]) for i in (0, 1))
    with np.errstate(divide="ignore"):
        high = (np.log(weights) - LN_2PI - 0.5 * np.array(logdets))[:, None]
    step = max(16, PAIRS_AT_ONCE // len(weights))

    def run(batches):
        sums, lls = np.zeros((len(weights), 6)), np.zeros(len(sizes))
        one, two = np.empty((len(weights), step)), np.empty((len(weights), step))
        for batch in batches:
            every = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for at in range(0, batch.num_rows, step):
                px, py = (c[at:at + step] for c in every)
                stats, n = np.stack([np.ones_like(px), px, py, px * px, px * py, py * py]), len(px)
                place = stats[[1, 2, 0]]
                p, q = (one, two) if n == step else (np.empty((len(weights), n)), np.empty((len(weights), n)))
                np.matmul(first, place, out=p)
                np.matmul(second, place, out=q)
                p *= p
                q *= q
                p += q
                np.subtract(high, p, out=p)
                np.maximum(p, LEAST_LOG, out=p)
                np.exp(p, out=p)
                p += EPSILON
                total = np.add.reduceat(p, starts, axis=0)
                lls += np.log(total).sum(axis=1)
                for i, (a, b) in enumerate(zip(starts, ends)):
                    sums[a:b] += p[a:b] @ (stats / total[i]).T
        rows = np.concatenate([sums, np.pad(lls[:, None], ((0, 0), (0, 5)))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), *(pa.array(rows[:, i]) for i in range(6))],
                                         names=["c", *(f"s{i}" for i in range(6))])

    parts = points.select(F.col(x).cast("double"), F.col(y).cast("double")).mapInArrow(run, "c long, " + ", ".join(f"s{i} double" for i in range(6)))
    found = np.zeros((len(weights) + len(sizes), 6))
    for r in parts.groupBy("c").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(6)]).collect():
        found[r["c"]] = r[1:]
    return np.split(found[:len(weights)], starts[1:]), found[len(weights):, 0].tolist()


def fit_mixtures(points: DataFrame, starts: list[Mixture], x: str, y: str, max_iter: int = 100, tol: float = 1e-3) -> None:
    """MLlib's EM from the given starts, all mixtures a step at a time: a scan a step in
    place of one a step and mixture.  Each stops by itself as MLlib's does."""
    for _ in range(max_iter):
        active = [m for m in starts if abs(m.ll - m.before) > tol]
        if not active:
            break
        for m, sums, ll in zip(active, *em_sums(points, active, x, y)):
            m.update(sums, ll)


def gmm_bic_curve(points: DataFrame, k_values: list[int], seed: int = 42, x: str = "x", y: str = "y",
                  parallelism: int = 4) -> DataFrame:
    """ML14 BIC curve: −2·LL + (6k − 1)·ln n for each k (k = 1 closed form).  MLlib draws
    each mixture's start from the cached points, several at a time; the mixtures then
    go through EM together (``fit_mixtures``)."""
    spark = points.sparkSession
    base = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y).cache()
    n = base.count()

    def start(k):
        model = fit_gmm(base, k, seed, x, y, max_iter=0)[0]
        parts = model.gaussiansDF.collect()
        return Mixture(np.array(model.weights), np.array([p["mean"].toArray() for p in parts]), np.array([p["cov"].toArray() for p in parts]))

    several = [k for k in k_values if k > 1]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        mixtures = dict(zip(several, pool.map(start, several)))
    if mixtures:
        # compute-heavy but byte-light, as in kde_grid
        spread = base.repartition(max(spark.sparkContext.defaultParallelism, -(-n // POINTS_OF_EM))).cache()
        fit_mixtures(spread, list(mixtures.values()), x, y)
        spread.unpersist()
    lls = {k: mixtures[k].ll if k > 1 else gaussian_k1(base, x=x, y=y).first()["log_likelihood"] for k in k_values}
    rows = [(k, float(lls[k]), float(-2 * lls[k] + (6 * k - 1) * math.log(n)), n) for k in k_values]
    base.unpersist()
    best = min(rows, key=lambda r: (r[2], r[0]))[0]          # TOP6: arg-min, first k wins ties
    rows = [(*r, r[0] == best) for r in rows]
    return spark.createDataFrame(rows, "k int, log_likelihood double, bic double, n long, is_best boolean")


def gmm_components(model) -> DataFrame:
    """Fitted mixture as a component table (weight, mean, covariance)."""
    g = model.gaussiansDF
    spark = g.sparkSession
    rows = []
    for i, (r, w) in enumerate(zip(g.collect(), model.weights)):   # k rows, bounded by the model
        m, c = r["mean"].toArray(), r["cov"].toArray()
        rows.append((i, float(w), float(m[0]), float(m[1]), float(c[0][0]), float(c[0][1]), float(c[1][1])))
    return spark.createDataFrame(rows, "component int, weight double, mean_x double, mean_y double, "
                                       "var_x double, cov_xy double, var_y double")


def gmm_sample(spark: SparkSession, comps: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """ML17: n draws: component by cumulative weight (seeded uniform), point = μ + L·z
    with L the Cholesky factor (z seeded normals)."""
    if comps.count() > MAX_COMPONENTS:
        raise ValueError(f"more than {MAX_COMPONENTS} components")
    c = comps.orderBy("component").agg(F.collect_list(F.struct(
        "weight", "mean_x", "mean_y", "var_x", "cov_xy", "var_y")).alias("__c"))
    draws = spark.range(n).select("id", F.rand(seed).alias("u"), F.randn(seed + 1).alias("z1"),
                                  F.randn(seed + 2).alias("z2"))
    d = attach_scalars(draws, c)
    cum = F.transform("__c", lambda e, i: F.aggregate(F.slice("__c", 1, i + 1), F.lit(0.0),
                                                      lambda acc, z: acc + z["weight"]))
    d = d.withColumn("__cum", cum)
    idx = F.coalesce(F.array_position(F.transform("__cum", lambda w: F.col("u") < w), F.lit(True)),
                     F.size("__c"))
    d = d.withColumn("__k", idx).withColumn("__e", F.element_at("__c", F.col("__k").cast("int")))
    e = F.col("__e")
    l11 = F.sqrt(e["var_x"])
    l21 = e["cov_xy"] / l11
    l22 = F.sqrt(e["var_y"] - l21 * l21)
    return d.select("id", (F.col("__k") - 1).alias("component"),
                    (e["mean_x"] + l11 * F.col("z1")).alias("x"),
                    (e["mean_y"] + l21 * F.col("z1") + l22 * F.col("z2")).alias("y"))

"""Boosting from start margins: binary, three or more classes, and regression.

An objective gives each row a gradient and a hessian around its margins, one margin
for two classes and for regression, one a class for softmax.  A round fits, for each
margin, one regression tree (``trees``) to gradient / hessian with the hessian as weight,
so that a leaf's value is its Newton step: the sum of gradients over the sum of
hessians of its rows.  ``GradientBinary`` and ``GradientSquared`` boost on plain
gradients as MLlib's gradient-boosted trees do.  Rows, binned features and margins are
written to the shared folder; the driver holds the trees and one loss a round.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.operators import trees as T
from touchline.session import cut_lineage, discard, ship_package, stored

EPS = 1e-15
LEAST_HESSIAN = 1e-6
SEED = 165
#: Rounds between two writings of the margins; those since then are added in each scan.
CUT_EVERY = 8


def newton(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps and their weights."""
    h = np.maximum(h, LEAST_HESSIAN)
    return g / h, h


class Objective:
    """``means`` are the averages that the start margins are made from (``start_of``)."""

    def means(self, label: str) -> list[Column]:
        return []

    def start_of(self, means: list) -> list[float]:
        return [0.0] * self.width

    def priors(self, df: DataFrame, label: str) -> list[float]:
        means = self.means(label)
        return self.start_of(list(df.agg(*means).first()) if means else [])


class Binary(Objective):
    """Log loss of a 0/1 label; the margin is the log odds."""
    name, width, first_step = "binary", 1, None

    def means(self, label: str) -> list[Column]:
        return [F.avg(F.col(label).cast("double"))]

    def start_of(self, means: list) -> list[float]:
        p = means[0]
        p = min(max(0.5 if p is None else p, EPS), 1 - EPS)
        return [math.log(p / (1 - p))]

    def probability(self, m: list[Column]) -> Column:
        return F.least(F.greatest(1.0 / (1.0 + F.exp(-m[0])), F.lit(EPS)), F.lit(1 - EPS))

    def steps(self, y: Column, m: list[Column]) -> list[tuple[Column, Column]]:
        p = self.probability(m)
        return [(y - p, p * (1.0 - p))]

    def loss(self, y: Column, m: list[Column]) -> Column:
        p = self.probability(m)
        return -(y * F.ln(p) + (1.0 - y) * F.ln(1.0 - p))

    def _shares(self, m: np.ndarray) -> np.ndarray:
        return np.clip(1.0 / (1.0 + np.exp(-np.maximum(m[:, 0], -700.0))), EPS, 1 - EPS)

    def targets(self, y: np.ndarray, m: np.ndarray, first: bool) -> list[tuple]:
        """For each margin the values that its next tree is fitted to, and weights."""
        p = self._shares(m)
        return [newton(y - p, p * (1.0 - p))]

    def losses(self, y: np.ndarray, m: np.ndarray) -> np.ndarray:
        p = self._shares(m)
        return -(y * np.log(p) + (1.0 - y) * np.log(1.0 - p))


class Squared(Objective):
    """Squared error of a number; the margin is the prediction."""
    name, width, first_step = "regression", 1, None

    def means(self, label: str) -> list[Column]:
        return [F.avg(F.col(label).cast("double"))]

    def start_of(self, means: list) -> list[float]:
        return [float(means[0] or 0.0)]

    def steps(self, y: Column, m: list[Column]) -> list[tuple[Column, Column]]:
        return [(y - m[0], F.lit(1.0))]

    def loss(self, y: Column, m: list[Column]) -> Column:
        return (y - m[0]) * (y - m[0])

    def targets(self, y: np.ndarray, m: np.ndarray, first: bool) -> list[tuple]:
        return [(y - m[:, 0], None)]

    def losses(self, y: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (y - m[:, 0]) ** 2


class Softmax(Objective):
    """Log loss of a class number from 0 to ``width`` - 1; margins start at the logs
    of the class shares."""
    name, first_step = "multiclass", None

    def __init__(self, width: int):
        if not 2 < width <= 100:
            raise ValueError(f"{width} classes: softmax takes 3 to 100")
        self.width = width

    def means(self, label: str) -> list[Column]:
        return [F.avg((F.col(label) == k).cast("double")) for k in range(self.width)]

    def start_of(self, means: list) -> list[float]:
        return [math.log(max(s or 0.0, EPS)) for s in means]

    def probabilities(self, m: list[Column]) -> list[Column]:
        """1 / sum(exp(m_j - m_k)): every margin is named once a class, and no power of a
        high margin overflows into a wrong share (its inverse is then 0)."""
        return [1.0 / sum((F.exp(F.least(x - y, F.lit(700.0))) for j, x in enumerate(m) if j != k), F.lit(1.0)) for k, y in enumerate(m)]

    def steps(self, y: Column, m: list[Column]) -> list[tuple[Column, Column]]:
        return [((y == k).cast("double") - p, p * (1.0 - p)) for k, p in enumerate(self.probabilities(m))]

    def loss(self, y: Column, m: list[Column]) -> Column:
        chosen = F.lit(0.0)
        for k, p in enumerate(self.probabilities(m)):
            chosen = F.when(y == k, p).otherwise(chosen)
        return -F.ln(F.greatest(chosen, F.lit(EPS)))

    def _shares(self, m: np.ndarray) -> np.ndarray:
        e = np.exp(m - m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def targets(self, y: np.ndarray, m: np.ndarray, first: bool) -> list[tuple]:
        p = self._shares(m)
        return [newton((y == k) - p[:, k], p[:, k] * (1.0 - p[:, k])) for k in range(self.width)]

    def losses(self, y: np.ndarray, m: np.ndarray) -> np.ndarray:
        known = (y >= 0) & (y < self.width) & (y == np.floor(y))
        chosen = self._shares(m)[np.arange(len(y)), np.where(known, y, 0).astype(int)]
        return -np.log(np.maximum(np.where(known, chosen, 0.0), EPS))


class GradientBinary(Objective):
    """MLlib's gradient boosting of two classes: the margin is half the log odds, the
    first tree fits the labels -1 and 1 and counts whole, the others the gradient of
    2 log(1 + exp(-2 label margin))."""
    name, width, first_step = "binary", 1, 1.0

    def targets(self, y: np.ndarray, m: np.ndarray, first: bool) -> list[tuple]:
        sign = 2.0 * y - 1.0
        return [(sign if first else 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * m[:, 0], 700.0))), None)]

    def losses(self, y: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 2.0 * np.logaddexp(0.0, -2.0 * (2.0 * y - 1.0) * m[:, 0])


class GradientSquared(Objective):
    """MLlib's gradient boosting of a number: the first tree fits the label and counts
    whole, the others the gradient of the squared error."""
    name, width, first_step = "regression", 1, 1.0

    def targets(self, y: np.ndarray, m: np.ndarray, first: bool) -> list[tuple]:
        return [(y if first else 2.0 * (y - m[:, 0]), None)]

    def losses(self, y: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (y - m[:, 0]) ** 2


def objective(task: str, classes: int = 2):
    """The objective of a task named as ``profile_columns`` names it."""
    if task == "binary":
        return Binary()
    if task == "regression":
        return Squared()
    if task == "multiclass":
        return Softmax(classes)
    raise ValueError(f"task {task!r}: choose binary, multiclass or regression")


def margin_columns(obj, margins: str = "margins") -> list[Column]:
    return [F.col(margins)[k] for k in range(obj.width)]


def with_start(df: DataFrame, obj, start: str | None, priors: list[float], out: str = "margins") -> DataFrame:
    """``out``: an array of start margins, the column ``start`` (a number, or an array
    for softmax) or else the priors.  A null start margin is the prior."""
    prior = F.array(*[F.lit(float(p)) for p in priors])
    if start is None:
        return df.withColumn(out, prior)
    given = F.col(start) if isinstance(df.schema[start].dataType.jsonValue(), dict) else F.array(F.col(start).cast("double"))
    return df.withColumn(out, F.array(*[F.coalesce(F.get(given, F.lit(k)), F.lit(float(priors[k]))) for k in range(obj.width)]))


def gradient_sums(rows: DataFrame, obj, label: str, keys: list[str], margins: str = "margins") -> DataFrame:
    """(keys, n, g0, h0, g1, h1, ...): sums of gradients and hessians around the
    margins.  Partial sums before the shuffle; rows without a label are left out."""
    y = F.col(label).cast("double")
    sums = []
    for k, (g, h) in enumerate(obj.steps(y, margin_columns(obj, margins))):
        sums += [F.sum(g).alias(f"g{k}"), F.sum(h).alias(f"h{k}")]
    return rows.where(F.col(label).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


@dataclass
class Boosted:
    """Trees of each round (one a margin), added to the start margins ``step`` times."""
    objective: object
    priors: list[float]
    step: float
    start: str | None = None
    rounds: list = field(default_factory=list)
    losses: list = field(default_factory=list)      # (train, validation) after each round
    bins: T.Bins | None = None

    def steps(self, first: int = 0) -> list[tuple]:
        """(step, trees) of the rounds from ``first`` on."""
        whole = self.objective.first_step
        return [(whole if whole and i == 0 else self.step, trees) for i, trees in enumerate(self.rounds)][first:]

    def add_rounds(self, df: DataFrame, margins: str = "margins") -> DataFrame:
        """The trees' predictions on ``features`` added to the margins, a batch at a time."""
        steps, bins = self.steps(), self.bins
        if not steps:
            return df
        ship_package(df.sparkSession)

        @F.arrow_udf("array<double>")
        def added(x: pa.Array, m: pa.Array) -> pa.Array:
            if not len(x):
                return m
            out = T.add_trees(T.matrix(m).copy(), bins.of(T.matrix(x)), steps)
            k = out.shape[1]
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, k, dtype=np.int32)), pa.array(out.ravel()))

        return df.withColumn(margins, added(vector_to_array("features"), F.col(margins)))

    def transform(self, df: DataFrame, margins: str = "margins") -> DataFrame:
        """``df`` (with ``features``) and its margins."""
        return self.add_rounds(with_start(df, self.objective, self.start, self.priors, margins), margins)

    def importances(self) -> list[float]:
        """Each feature's share of the trees' gain: the mean of the trees' shares, for
        MLlib's boosting the share of all gain."""
        trees = [t for r in self.rounds for t in r]
        if not trees:
            return []
        gains = [t.importances(len(self.bins.cuts)) for t in trees]
        total = sum(gains) if self.objective.first_step else sum(g / max(g.sum(), EPS) for g in gains)
        return [float(v) for v in total / max(total.sum(), EPS)]

    def round_losses(self, df: DataFrame, label: str) -> list[float]:
        """Mean loss of the rows after each round, in one scan."""
        steps, bins, obj, n = self.steps(), self.bins, self.objective, len(self.rounds)
        ship_package(df.sparkSession)

        def run(batches):
            lost, rows = np.zeros(n), 0
            for b in batches:
                if not len(b):
                    continue
                x, y, m = bins.of(T.matrix(b.column("x"))), b.column("y").to_numpy(zero_copy_only=False), T.matrix(b.column("margins")).copy()
                rows += len(y)
                for i, one in enumerate(steps):
                    lost[i] += obj.losses(y, T.add_trees(m, x, [one])).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, rows)), pa.array(lost)], names=["round", "n", "loss"])

        rows = with_start(df, obj, self.start, self.priors).select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), "margins")
        found = rows.mapInArrow(run, "round long, n long, loss double").groupBy("round").agg(F.try_divide(F.sum("loss"), F.sum("n")).alias("loss"))
        return [r["loss"] for r in found.orderBy("round").collect()]


@dataclass
class Trial:
    """One choice of the parameters of a fit."""
    rounds: int = 20
    depth: int = 4
    step: float = 0.1
    rate: float = 1.0


def boost(df: DataFrame, obj, label: str, rounds: int = 20, depth: int = 4, step: float = 0.1, start: str | None = None,
          valid: str | None = None, patience: int = 0, least_gain: float = 0.0, seed: int = SEED, rate: float = 1.0,
          features: Callable[[DataFrame], DataFrame] | None = None, losses: bool = False) -> Boosted:
    """Fit trees on the rows of ``df`` (``features`` vector, label) that ``valid`` does
    not mark.  ``features`` adds the vector if ``df`` lacks it, so that rows are chosen
    for thresholds before it is made.  ``losses`` keeps each round's, without stopping.  With ``patience``, boosting stops once the validation loss has not
    improved for that many rounds, and the rounds after the best one are dropped; a
    ``patience`` of -1 stops, as MLlib does, at the first round that is worse than the
    best one.  Each round takes a seeded share ``rate`` of the rows.
    Rows without a label are left out; no row fits no tree."""
    return boost_trials(df, obj, label, [Trial(rounds, depth, step, rate)], start, valid, patience, least_gain, seed, features, losses)[0]


@dataclass
class _Lane:
    """A model that is being fitted beside others: its margins start at ``at``."""
    model: Boosted
    trial: Trial
    at: int
    best: tuple = (math.inf, 0)
    going: bool = True


def boost_trials(df: DataFrame, obj, label: str, trials: list[Trial], start: str | None = None, valid: str | None = None,
                 patience: int = 0, least_gain: float = 0.0, seed: int = SEED,
                 features: Callable[[DataFrame], DataFrame] | None = None, losses: bool = False) -> list[Boosted]:
    """``boost`` for several choices of parameters at once: bins are found and rows written
    a single time, and a scan grows a level of every model."""
    features = features or (lambda rows: rows)
    rows = df.where(F.col(label).isNotNull())
    is_valid = F.coalesce(F.col(valid), F.lit(False)) if valid else F.lit(False)
    n, *means = rows.where(~is_valid).agg(F.count(F.lit(1)), *obj.means(label)).first()
    priors = obj.start_of(means)
    models = [Boosted(obj, priors, t.step, start) for t in trials]
    if not n or not any(t.rounds for t in trials):
        return models
    ship_package(df.sparkSession)
    with_draw = any(t.rate < 1 for t in trials)
    draw = F.floor(F.rand(seed) * F.lit(float(1 << 53))).cast("long") if with_draw else F.lit(0).cast("long")
    vectors = features(rows)
    given = ["margins"] if start else []    # without them every row starts from the priors
    vectors = (with_start(vectors, obj, start, priors) if start else vectors).select(
        vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), is_valid.alias("valid"), *given, draw.alias("draw"))
    some = features(T.threshold_rows(rows.where(~is_valid), n, seed))
    bins = T.fit_bins(some.select(vector_to_array("features").alias("x")), n, T.categories_of(some))
    losses, lanes = losses or bool(patience), []
    for m, t in zip(models, trials):
        m.bins = bins
        if t.rounds:
            lanes.append(_Lane(m, t, len(lanes) * obj.width))
    state = T.state_rows(vectors, bins, with_draw, priors, len(lanes))
    once = all(t.rounds * max(t.depth, 1) <= 1 for t in trials) and not losses
    if not once:    # rows that are read a single time go straight into that scan
        state = stored(state, "state", T.FILE_BLOCKS)
    r, held = 0, 0      # rounds so far, and those that the written margins hold
    while lanes:
        scans = []
        for lane in lanes:
            trees, slots = T.planted(obj, bins, lane.trial.depth) if r < lane.trial.rounds else ([], [])
            scans.append(T.Scan(lane.at, lane.model.steps(held), trees, slots, lane.trial.depth, r, lane.trial.rate, losses and r > 0, {}))
        T.grow(state, obj, bins, scans, least_gain, n)
        for lane, scan in zip(lanes, scans):
            lane.going = _next_round(lane, scan, r, losses, patience)
        lanes = [lane for lane in lanes if lane.going]
        r += 1
        if r - held >= CUT_EVERY and any(r < lane.trial.rounds for lane in lanes):
            scans = [T.Scan(lane.at, lane.model.steps(held), [], [], 0, r, 1.0, False, {}) for lane in lanes]
            old, state = state, stored(T.advanced(state, scans, obj.width), "state", T.FILE_BLOCKS)
            held = r
            discard(old)
            for i, lane in enumerate(lanes):
                lane.at = i * obj.width
    if not once:
        discard(state)
    return models


def _next_round(lane: _Lane, scan: T.Scan, r: int, losses: bool, patience: int) -> bool:
    """Keep the losses and trees that a model's scans of round ``r`` gave; whether it goes on."""
    model = lane.model
    going = r + (0 if losses else 1) < lane.trial.rounds
    if losses and r:
        means = {side: loss / n for side, (n, loss) in scan.lost.items()}
        model.losses.append((means.get(False), means.get(True)))
        loss = means.get(True, means.get(False))
        if not patience:
            pass
        elif loss < lane.best[0]:
            lane.best = (loss, r)
        elif r - lane.best[1] >= patience if patience > 0 else loss > lane.best[0]:
            going = False
    if scan.trees and (going or not losses):
        model.rounds.append(scan.trees)
    if patience and not going:
        model.rounds = model.rounds[:lane.best[1]]
    return going


def margins_of(models: list[Boosted], df: DataFrame, out: str) -> DataFrame:
    """``out``: the margins of all models, which share bins and start at the priors, one
    after the other, a batch of ``features`` at a time."""
    ship_package(df.sparkSession)
    bins, plans = models[0].bins, [(m.priors, m.steps()) for m in models]

    @F.arrow_udf("array<double>")
    def found(x: pa.Array) -> pa.Array:
        n = len(x)
        own = bins.of(T.matrix(x)) if n and bins else None
        all_of = [T.add_trees(np.tile(np.array(priors, dtype=np.float64), (n, 1)), own, steps if n else []) for priors, steps in plans]
        flat = np.concatenate(all_of, axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32)), pa.array(flat.ravel()))

    return df.withColumn(out, found(vector_to_array("features")))


def mean_loss(df: DataFrame, obj, label: str, margins: str = "margins", by: list[str] = ()) -> DataFrame:
    """(by, n, loss): the objective's mean loss; rows without a label are left out."""
    loss = obj.loss(F.col(label).cast("double"), margin_columns(obj, margins))
    return df.where(F.col(label).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"))


def permutation_losses(df: DataFrame, score, obj, label: str, row_id: str, n_features: int, repeats: int = 1,
                       seed: int = 7) -> DataFrame:
    """(feature, repeat, loss): mean loss after putting another row's value in place of
    each feature; ``feature`` -1 is the loss of the rows as they are.

    Rows are put in one seeded random order; repeat i takes the values of the row a
    seeded distance further on, one equi-join a repeat.  All features of all repeats
    are scored in one scan, the donor's value put into the feature vector, so the
    number of jobs does not follow the number of features.  ``score`` adds
    ``margins`` to a frame with ``features``.
    """
    from pyspark.ml.functions import array_to_vector

    from touchline.operators.folds import hash_rank
    kept = [c for c in df.columns if c not in (row_id, "features")]
    ranked = cut_lineage(hash_rank(df.where(F.col(label).isNotNull()), row_id, None, seed).select(
        *kept, vector_to_array("features").alias("__own"), F.col("__rank").alias("__r")))
    n = ranked.count()
    cases = None
    for i in range(repeats):
        shift = 1 + (seed * 7919 + i * 104_729) % max(n - 1, 1)
        donors = ranked.select((F.pmod(F.col("__r") - shift, F.lit(max(n, 1)))).alias("__r"), F.col("__own").alias("__other"))
        wanted = F.sequence(F.lit(-1 if i == 0 else 0), F.lit(n_features - 1))
        part = ranked.join(donors, "__r").withColumn("__repeat", F.lit(i)).withColumn("__feature", F.explode(wanted))
        cases = part if cases is None else cases.unionByName(part)
    mixed = F.transform("__own", lambda v, j: F.when(j == F.col("__feature"), F.get(F.col("__other"), j)).otherwise(v))
    scored = score(cases.withColumn("features", array_to_vector(mixed)))
    loss = obj.loss(F.col(label).cast("double"), margin_columns(obj))
    return scored.groupBy(F.col("__feature").alias("feature"), F.col("__repeat").alias("repeat")).agg(F.avg(loss).alias("loss"))

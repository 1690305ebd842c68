"""Regression trees grown from histograms, for boosting over tables of any size.

The features of a row are cut into at most 64 bins once and written as one byte each,
with label and margins, to the shared folder.  A level of a tree is one scan of those
rows: every task sums weights and targets by (tree, node, feature, bin), Spark adds the
tasks' sums up, and the driver picks each node's split from that small table.  Nothing
is cached; what a task holds is one Arrow batch and its histogram, however many rows
there are.

Splits follow MLlib's rules: thresholds are midpoints between values at equal counts of
rows (all rows up to ``SPLIT_ROWS``, a seeded sample of about that many beyond),
categories are ordered by their mean target in the node, and a node splits where the
variance falls most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BINS = 64
#: Rows that thresholds are taken from (MLlib's number).
SPLIT_ROWS = 10_000
#: A gain below this share of the sums it is a difference of is rounding.
ROUNDING = 1e-12
_MIX = (0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def categories_of(df: DataFrame, features: str = "features") -> dict[int, int]:
    """{position: number of categories} of the nominal entries of a feature vector."""
    attrs = df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    return {a["idx"]: len(a["vals"]) for a in attrs.get("nominal", []) if "vals" in a}


def thresholds(values: np.ndarray, n_bins: int = MAX_BINS) -> np.ndarray:
    """Midpoints between neighbouring values; with more values than bins, those where
    the rows below come nearest to equal shares."""
    found, counts = np.unique(values[np.isfinite(values)], return_counts=True)
    if len(found) <= n_bins:
        return (found[:-1] + found[1:]) / 2.0
    stride = counts.sum() / n_bins
    below, wanted, out = np.cumsum(counts), stride, []
    for i in range(1, len(found)):
        if abs(below[i - 1] - wanted) < abs(below[i] - wanted):
            out.append((found[i - 1] + found[i]) / 2.0)
            wanted += stride
    return np.array(out)


@dataclass
class Bins:
    """Thresholds of each numeric feature, the number of categories of each other one."""
    cuts: list
    categories: dict[int, int]

    @property
    def width(self) -> int:
        return max([len(c) + 1 for c in self.cuts] + list(self.categories.values()) + [1])

    def of(self, x: np.ndarray) -> np.ndarray:
        """(features, rows) bytes of a (rows, features) matrix; a value at a threshold lies below it."""
        out = np.empty(x.shape[::-1], dtype=np.uint8)
        for j, cuts in enumerate(self.cuts):
            if j in self.categories:
                out[j] = np.clip(x[:, j], 0, self.categories[j] - 1)
            else:
                out[j] = np.searchsorted(cuts, x[:, j], side="left")
        return out


def threshold_rows(rows: DataFrame, n_rows: int, seed: int) -> DataFrame:
    """Those of the ``n_rows`` training rows that thresholds are taken from."""
    return rows if n_rows <= SPLIT_ROWS else rows.sample(SPLIT_ROWS / n_rows, seed)


def fit_bins(vectors: DataFrame, n_rows: int, categories: dict[int, int]) -> Bins:
    """Bins from the column ``x`` (array of doubles) of ``threshold_rows`` of ``n_rows`` rows."""
    x = matrix(vectors.select("x").toArrow().column("x").combine_chunks())
    if any(n > 256 for n in categories.values()):
        raise ValueError("a categorical feature has more than 256 categories")
    return Bins([np.zeros(0) if j in categories else thresholds(x[:, j], min(MAX_BINS, max(n_rows, 1))) for j in range(x.shape[1])], categories)


def matrix(lists) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


@dataclass
class Tree:
    """Nodes in heap order (children of i: 2i + 1, 2i + 2): feature (-1: leaf), bins that
    go left, value, and gain times weight."""
    depth: int
    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int, width: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(depth, np.full(n, -1), np.zeros((n, width), dtype=bool), np.zeros(n), np.zeros(n))

    def spread(self, bins: np.ndarray, values: np.ndarray) -> np.ndarray:
        """For each row the entry of ``values`` of the node it has come down to.  A step takes
        every row from its node to the next one by a table [node, bin]; leaves stay."""
        n, width = bins.shape[1], self.left.shape[1]
        inner = np.flatnonzero(self.feature >= 0)
        if not len(inner):
            return np.full(n, values[0])
        heap = np.arange(len(self.feature))[:, None]
        step = np.where(self.feature[:, None] < 0, heap, np.where(self.left, 2 * heap + 1, 2 * heap + 2))
        row, flat = np.maximum(self.feature, 0) * n, np.ascontiguousarray(bins).reshape(-1)
        node, at, step = step[0].take(bins[self.feature[0]]), np.arange(n), step.reshape(-1)
        for _ in range((int(inner[-1]) + 1).bit_length() - 1):
            where = row.take(node)
            where += at
            node *= width
            node += flat.take(where)
            node = step.take(node)
        return values.take(node)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.spread(bins, self.value)

    def importances(self, n: int) -> np.ndarray:
        inner = self.feature >= 0
        return np.bincount(self.feature[inner], self.gain[inner], minlength=n)

    def to_dict(self) -> dict:
        return {"depth": self.depth, "feature": self.feature.tolist(), "left": [np.flatnonzero(row).tolist() for row in self.left],
                "value": self.value.tolist(), "gain": self.gain.tolist()}

    @classmethod
    def from_dict(cls, d: dict, width: int) -> Tree:
        tree = cls.empty(d["depth"], width)
        tree.feature, tree.value, tree.gain = np.array(d["feature"]), np.array(d["value"]), np.array(d["gain"])
        for row, some in zip(tree.left, d["left"]):
            row[some] = True
        return tree


def add_trees(margins: np.ndarray, bins: np.ndarray, rounds: list) -> np.ndarray:
    """Margins (rows, width) after ``rounds``: pairs of a step and one tree a margin."""
    for step, trees in rounds:
        for k, tree in enumerate(trees):
            margins[:, k] += step * tree.predict(bins)
    return margins


def drawn(draw: np.ndarray, number: int, rate: float) -> np.ndarray:
    """Rows of a share ``rate``, another one for each number; a row's draw decides."""
    h = draw.view(np.uint64) + np.uint64((number + 1) * _MIX[0] % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    h = (h ^ (h >> np.uint64(27))) * _MIX[2]
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) < rate * 2.0 ** 53


#: Rows of a block at least, and blocks of a file at most.  A block is one row of the
#: written state: rows pass through Spark as a few byte strings, and a task (32 files at
#: most, see ``FILE_ROWS``) reads about a million rows.
BLOCK_ROWS, FILE_BLOCKS = 8192, 4
STATE = "n int, bins binary, y binary, valid binary, margins binary, draw binary"


@dataclass
class Block:
    """Rows side by side: bins (features, rows), label, side, margins (rows, width), and
    the draw that decides in which rounds' shares a row lies (empty: in all)."""
    bins: np.ndarray
    y: np.ndarray
    valid: np.ndarray
    margins: np.ndarray
    draw: np.ndarray

    def packed(self) -> pa.RecordBatch:
        parts = (self.bins, self.y, self.valid, self.margins, self.draw)
        return pa.RecordBatch.from_arrays([pa.array([len(self.y)], pa.int32()), *(pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in parts)],
                                          names=[f.split()[0] for f in STATE.split(", ")])


def state_rows(vectors: DataFrame, bins: Bins, with_draw: bool, priors: list[float], copies: int = 1) -> DataFrame:
    """``STATE`` of rows (x, y, valid, margins, draw); without ``margins`` they are the
    priors.  Margins come once for each of the ``copies`` models that share the rows."""
    started = "margins" in vectors.columns

    def run(batches: Iterator[pa.RecordBatch]):
        parts: list[Block] = []

        def joined() -> pa.RecordBatch:
            x = [np.concatenate(p, axis=-1) for p in zip(*((q.bins, q.y, q.valid, q.margins.T, q.draw) for q in parts))]
            parts.clear()
            return Block(x[0], x[1], x[2], x[3].T, x[4]).packed()

        for b in batches:
            if len(b):
                y, valid, draw = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "valid", "draw"))
                margins = np.tile(matrix(b.column("margins")), (1, copies)) if started else np.tile(np.array(priors, dtype=np.float64), (len(b), copies))
                parts.append(Block(bins.of(matrix(b.column("x"))), y, valid, margins, draw if with_draw else draw[:0]))
                if sum(len(p.y) for p in parts) >= BLOCK_ROWS:
                    yield joined()
        if parts:
            yield joined()

    return vectors.mapInArrow(run, STATE)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for i in range(len(b)):
            n = b.column("n")[i].as_py()
            kinds = (("bins", np.uint8), ("y", np.float64), ("valid", np.bool_), ("margins", np.float64), ("draw", np.int64))
            bins, y, valid, margins, draw = (np.frombuffer(b.column(c)[i].as_buffer(), dtype=t) for c, t in kinds)
            yield Block(bins.reshape(-1, n), y, valid, margins.reshape(n, -1).copy(), draw)


@dataclass
class Scan:
    """What a scan does for one of the models that share its rows: where its margins start,
    the rounds that those do not hold yet, the trees being grown (none: losses only) with
    their open nodes in order, round number and share of the rows, and whether it takes
    losses: ``lost`` is {valid: (rows, loss)}."""
    at: int
    rounds: list
    trees: list
    slots: list
    depth: int
    number: int
    rate: float
    losses: bool
    lost: dict


def advanced(state: DataFrame, scans: list[Scan], width: int) -> DataFrame:
    """The state with the scans' rounds added to their margins, without other margins."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in blocks(batches):
            b.margins = np.concatenate([add_trees(b.margins[:, g.at:g.at + width], b.bins, g.rounds) for g in scans], axis=1)
            yield b.packed()

    return state.mapInArrow(run, STATE)


#: Rows that a scan's task reads at most, about (see ``BLOCK_ROWS``), and bytes of partial sums
#: up to which the driver adds the tasks' sums up itself; beyond, a shuffle does.
TASK_ROWS, DRIVER_BYTES = 1 << 20, 32 << 20


def level_sums(state: DataFrame, obj, bins: Bins, scans: list[Scan], n_rows: int) -> list[list[np.ndarray]]:
    """One scan for several models: for each one's trees the sums [weight or weighted
    target, node, feature, bin] of the open nodes.  Losses after ``rounds`` go to the
    scans that take them.  ``n_rows``: about the rows of the state."""
    d, width, w = len(bins.cuts), bins.width, obj.width
    sizes = [len(slots) for g in scans for slots in g.slots]
    at = np.cumsum([0, *(s * d * width for s in sizes)])
    first = np.cumsum([0, *(len(g.slots) for g in scans)])      # number of a scan's first tree
    places = []
    for g in scans:
        places.append([np.full(len(tree.feature), -1) for tree in g.trees])
        for place, some in zip(places[-1], g.slots):
            place[some] = np.arange(len(some))

    def run(batches: Iterator[pa.RecordBatch]):
        sums, lost = np.zeros((2, at[-1])), np.zeros((2, 2 * len(scans)))
        for b in blocks(batches):
            for i, g in enumerate(scans):
                x, y, margins = b.bins, b.y, b.margins[:, g.at:g.at + w]
                add_trees(margins, x, g.rounds)
                if g.losses:
                    loss = obj.losses(y, margins)
                    lost[:, 2 * i:2 * i + 2] += [[(~b.valid).sum(), b.valid.sum()], [loss[~b.valid].sum(), loss[b.valid].sum()]]
                if not g.trees:
                    continue
                train = ~b.valid
                if g.rate < 1:
                    train &= drawn(b.draw, g.number, g.rate)
                if not train.all():
                    mine = np.flatnonzero(train)
                    x, y, margins = x.take(mine, axis=1), y[mine], margins[mine]
                for k, (target, weight) in enumerate(obj.targets(y, margins, g.number == 0)):
                    j0 = first[i] + k
                    if not sizes[j0]:
                        continue
                    slot = g.trees[k].spread(x, places[i][k])
                    some, mine = slice(None), x
                    if (slot < 0).any():
                        some = np.flatnonzero(slot >= 0)
                        slot, mine = slot[some], x.take(some, axis=1)
                    v = None if weight is None else weight[some]
                    t = target[some] if v is None else target[some] * v
                    n = sizes[j0] * width
                    parts = sums[:, at[j0]:at[j0 + 1]].reshape(2, d, n)
                    slot *= width
                    for j in range(d):
                        key = slot + mine[j]
                        parts[0, j] += np.bincount(key, v, minlength=n)
                        parts[1, j] += np.bincount(key, t, minlength=n)
        key = np.flatnonzero(sums[0] > 0)
        kinds = np.flatnonzero(lost[0] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, -1 - kinds])), pa.array(np.concatenate([sums[0, key], lost[0, kinds]])),
                                          pa.array(np.concatenate([sums[1, key], lost[1, kinds]]))], names=["key", "w", "s"])

    parts = state.mapInArrow(run, "key long, w double, s double")
    tasks = max(state.sparkSession.sparkContext.defaultParallelism, n_rows // TASK_ROWS + 1)
    if 24 * tasks * at[-1] > DRIVER_BYTES:
        parts = parts.groupBy("key").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    found = parts.toArrow()
    key, weights, totals = (found.column(c).to_numpy() for c in ("key", "w", "s"))
    real, out = key >= 0, np.zeros((2, at[-1]))
    if real.any():
        for i, v in enumerate((weights, totals)):
            out[i] = np.bincount(key[real], v[real], minlength=at[-1])
    lost = np.array([np.bincount(-1 - key[~real], v[~real], minlength=2 * len(scans)) for v in (weights, totals)])
    for i, g in enumerate(scans):
        if g.losses:
            g.lost = {bool(j): (lost[0, 2 * i + j], lost[1, 2 * i + j]) for j in range(2) if lost[0, 2 * i + j]}
    tables = [out[:, at[k]:at[k + 1]].reshape(2, d, sizes[k], width) for k in range(len(sizes))]
    return [tables[a:b] for a, b in zip(first, first[1:])]


def _best_split(sums: np.ndarray, categories: dict[int, int], least_gain: float):
    """(gain, feature, bins that go left, sums left, sums right) of a node's sums
    [weight or target, feature, bin], or None; ties go to the first feature and split."""
    best = None
    total = sums[:, 0].sum(axis=1)
    whole = total[1] ** 2 / total[0] if total[0] > 0 else 0.0
    for j in range(sums.shape[1]):
        w, s = sums[0, j], sums[1, j]
        order = np.arange(len(w))
        if j in categories:     # by mean target, categories without rows last
            order = np.argsort(np.where(w > 0, s / np.where(w > 0, w, 1.0), np.inf), kind="stable")
        wl, sl = np.cumsum(w[order])[:-1], np.cumsum(s[order])[:-1]
        rest = np.cumsum(w[order][::-1])[::-1][1:]
        ok = (wl > 0) & (rest > 0)
        if not ok.any():
            continue
        wl, sl, wr, sr = wl[ok], sl[ok], rest[ok], total[1] - sl[ok]
        parts = sl ** 2 / wl + sr ** 2 / wr
        gain = np.where(parts - whole > ROUNDING * parts, (parts - whole) / total[0], 0.0)
        i = int(np.argmax(gain))
        if gain[i] > 0 and gain[i] >= least_gain and (best is None or gain[i] > best[0]):
            left = np.zeros(len(w), dtype=bool)
            left[order[:np.flatnonzero(ok)[i] + 1]] = True
            best = (gain[i], j, left, (wl[i], sl[i]), (wr[i], sr[i]))
    return best


def grow(state: DataFrame, obj, bins: Bins, scans: list[Scan], least_gain: float, n_rows: int) -> None:
    """Grow the scans' trees side by side, a scan of the rows a level for all models."""
    for level in range(max([max(g.depth, 1) for g in scans if g.trees], default=1)):
        open_ones = [g for g in scans if level == 0 or level < g.depth and any(g.slots)]
        if not open_ones:
            break
        for g, tables in zip(open_ones, level_sums(state, obj, bins, open_ones, n_rows)):
            g.losses = False        # taken once, at the root
            for k, (tree, sums) in enumerate(zip(g.trees, tables)):
                opened = []
                for at, node in enumerate(g.slots[k]):
                    mine = sums[:, :, at]
                    if level == 0 and mine.shape[1]:
                        w, s = mine[:, 0].sum(axis=1)
                        tree.value[0] = s / w if w > 0 else 0.0
                    split = _best_split(mine, bins.categories, least_gain) if g.depth and mine.shape[1] else None
                    if split is None:
                        continue
                    gain, feature, left, *sides = split
                    tree.feature[node], tree.left[node], tree.gain[node] = feature, left, gain * (sides[0][0] + sides[1][0])
                    for child, (w, s) in zip((2 * node + 1, 2 * node + 2), sides):
                        tree.value[child] = s / w
                        opened.append(child)
                g.slots[k] = opened


def planted(obj, bins: Bins, depth: int) -> tuple[list, list]:
    """Empty trees, one a margin, and their open nodes: the roots."""
    return [Tree.empty(depth, bins.width) for _ in range(obj.width)], [[0] for _ in range(obj.width)]

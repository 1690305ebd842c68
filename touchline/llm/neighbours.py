"""Operator 1: embedding near-duplicates by NN-descent."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.frames import broadcast_if_small, cut, drop_stand_in, kept, key_or_hash, per_batch
from touchline.session import ship_package

log = logging.getLogger(__name__)

LINK = 0.95
#: Length of a neighbour list before it is enlarged.
LIST = 12
#: Random-hyperplane trees of the first graph, and the rows wanted in a leaf.
TREES, LEAF = 16, 192
#: A leaf or component with more rows than this is compared in parts of this size.
PART = 512
#: Cells whose means (SPLITS numbers each) may be broadcast, about 25 MB.
CROWDS = 100_000
#: Planes a tree holds ready to split crowded leaves about their own middle.
SPLITS = 32
#: Vectors whose links are searched among all rows to measure recall: at least the
#: first number and four times the root of the table's nodes, four times as many
#: after each audit that finds a link missing, up to all of them; the second number
#: is searched in one pass over the rows, the third compared at once, the fourth is
#: how often trees are grown.
AUDIT, AUDIT_MOST, AUDIT_BLOCK, AUDIT_ROUNDS = 1024, 16384, 1024, 8


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows have equal lengths, as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a @ b.T) / (np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :])


def valid_vector(vector: Column) -> Column:
    """Not null, only finite components, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _spanning(ids: np.ndarray, close: np.ndarray) -> np.ndarray:
    """For each row the id of a row it is linked with on the way to its group's
    first row, itself if none: links that keep the group connected."""
    out, seen = ids.copy(), np.zeros(len(ids), dtype=bool)
    for start in range(len(ids)):
        if seen[start]:
            continue
        seen[start] = True
        front = [start]
        while front:
            i = front.pop()
            new = np.flatnonzero(close[i] & ~seen)
            seen[new] = True
            out[new] = ids[i]
            front.extend(new.tolist())
    return out


def _leaf_lists(table: pa.Table, link: float, size: int) -> pa.Table:
    """Within one leaf: each row's nearest others and one spanning link."""
    ids = table.column("node").to_numpy()
    vectors = _matrix(table.column("vector").combine_chunks())
    sims = cosines(vectors, vectors)
    np.fill_diagonal(sims, -2.0)
    k = min(size, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), dtype=np.int64)
    span = _spanning(ids, sims >= link)
    u = np.concatenate([np.repeat(ids, k), ids])
    v = np.concatenate([ids[best].ravel(), span])
    s = np.concatenate([np.take_along_axis(sims, best, axis=1).ravel(), np.full(len(ids), 2.0)])
    keep = u != v
    return pa.table({"u": u[keep], "v": v[keep], "sim": s[keep]})


def leaves(nodes: DataFrame, n: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """(leaf, part, node, vector): each vector once a tree.  A leaf is a tree number
    and the signs of random projections.  Leaves of more than PART rows hold a crowd
    that planes through the origin do not tell apart: see ``split_crowds``."""
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths):
            part = batch.filter(pa.array(lengths == dim))
            planes = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), trees * depth))
            signs = (_matrix(part.column(1)) @ planes > 0).reshape(part.num_rows, trees, depth)
            codes = signs @ (1 << np.arange(depth)) if depth else np.zeros((part.num_rows, trees), dtype=np.int64)
            code = (codes * trees + np.arange(trees)) * 4096 + min(int(dim), 4095)
            yield {"node": part.column(0), "vector": part.column(1),
                   "codes": pa.array(list(code.astype(np.int64)), pa.list_(pa.int64()))}

    coded = per_batch(nodes.select("node", "vector"), "node long, vector array<double>, codes array<long>", make, rows=2048)
    coded = cut(coded)
    sizes = coded.select(F.explode("codes").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("size"))
    large = kept(sizes.where(F.col("size") > PART))
    n_large = large.count()
    rows = coded.select("node", "vector", F.explode("codes").alias("leaf"))
    plain = rows.select("leaf", F.lit(0).cast("long").alias("part"), "node", "vector")
    if not n_large:
        return plain
    plain = plain.join(broadcast_if_small(large.select("leaf"), n_large), "leaf", "left_anti")
    crowds = split_crowds(coded, large, n_large, seed).join(coded.select("node", "vector"), "node")
    return plain.union(crowds.select("leaf", "part", "node", "vector"))


def split_crowds(coded: DataFrame, large: DataFrame, n_large: int, seed: int) -> DataFrame:
    """(leaf, part, node) for the rows of the leaves ``large``.

    Near vectors differ from their crowd's middle in different directions, so a
    crowd is split by planes through its middle (a projection against the leaf's
    mean projection), as many as bring it down to PART rows; cells that are still
    crowded are split again about their own middle.  Where a tree's SPLITS planes
    are used up the rest is dealt at random, differently in each tree."""
    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths):
            part = batch.filter(pa.array(lengths == dim))
            x = _matrix(part.column(1))
            x /= np.linalg.norm(x, axis=1)[:, None]
            codes = part.column(2).flatten().to_numpy().reshape(part.num_rows, -1)
            for tree in range(codes.shape[1]):
                planes = np.random.default_rng([seed, 7, int(dim), tree]).standard_normal((int(dim), SPLITS))
                sides = pa.array((x @ planes).astype(np.float32).ravel())
                at = pa.array(np.arange(0, SPLITS * part.num_rows + 1, SPLITS, dtype=np.int32))
                yield {"node": part.column(0), "leaf": pa.array(codes[:, tree]), "sides": pa.ListArray.from_arrays(at, sides)}

    told = per_batch(coded.select("node", "vector", "codes"), "node long, leaf long, sides array<float>", make, rows=2048)
    wanted = F.ceil(F.log2(F.col("size") / PART)).cast("int")
    rows = told.join(broadcast_if_small(large.select("leaf", "size"), n_large), "leaf")
    rows = cut(rows.select("leaf", F.lit(0).cast("long").alias("part"), "node", "sides", "size", F.lit(0).alias("used")))
    done = None
    while True:
        open_rows = rows.where((F.col("size") > PART) & (F.col("used") < SPLITS))
        if open_rows.isEmpty():
            break
        settled = rows.where((F.col("size") <= PART) | (F.col("used") >= SPLITS)).drop("sides")
        done = settled if done is None else done.union(settled)
        means = kept(open_rows.groupBy("leaf", "part").agg(*(F.avg(F.col("sides")[i]).alias(f"s{i}") for i in range(SPLITS)))
                     .select("leaf", "part", F.array(*(f"s{i}" for i in range(SPLITS))).alias("middle")))
        beside = open_rows.join(broadcast_if_small(means, limit=CROWDS), ["leaf", "part"])
        bits = F.least(wanted, F.lit(SPLITS) - F.col("used"))
        above = F.zip_with("sides", "middle", lambda a, b: (a > b).cast("int"))
        cell = F.concat_ws("", F.slice(above, F.col("used") + 1, bits))
        moved = kept(beside.select("leaf", F.xxhash64("part", cell).alias("part"), "node", "sides", (F.col("used") + bits).alias("used")))
        sizes = moved.groupBy("leaf", "part").agg(F.count("*").alias("size"))
        rows = cut(moved.join(broadcast_if_small(kept(sizes)), ["leaf", "part"])
                   .select("leaf", "part", "node", "sides", "size", "used"))
    rest = rows.drop("sides")
    done = rest if done is None else done.union(rest)
    parts = F.ceil(F.col("size") / PART)
    dealt = F.when(parts > 1, F.xxhash64("part", F.pmod(F.xxhash64("node", "leaf", F.lit(seed)), parts))).otherwise(F.col("part"))
    return done.select("leaf", dealt.alias("part"), "node")


def nearest(found: DataFrame, size: int) -> DataFrame:
    """The ``size`` nearest (u, v, sim) of each u; Spark limits each task's rows
    before the shuffle."""
    first = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    return (found.groupBy("u", "v").agg(F.max("sim").alias("sim"))
            .withColumn("place", F.row_number().over(first)).where(F.col("place") <= size).drop("place"))


def refine(graph: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """One round of NN-descent: all pairs in each vector's list (itself included)
    are compared; pairs better than the worst of either list are proposed."""
    worst = graph.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    worst = worst.select(F.col("u").alias("node"), F.when(F.col("n") >= size, F.col("worst")).otherwise(-2.0).alias("worst"))
    known = nodes.select("node", "vector").join(worst, "node", "left").select("node", "vector", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    members = graph.select(F.col("u").alias("center"), F.col("v").alias("node")).union(
        nodes.select(F.col("node").alias("center"), "node"))
    lists = (members.join(known, "node").groupBy("center")
             .agg(F.collect_list(F.struct("node", "worst", "vector")).alias("m")).where(F.size("m") > 1).select("m"))

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        counts = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
        flat = batch.column(0).flatten()
        ids, least = flat.field("node").to_numpy(), flat.field("worst").to_numpy()
        vectors = _matrix(flat.field("vector"))
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
        ends = np.cumsum(counts)
        us, vs, ss = [], [], []
        for c in np.unique(counts):
            rows = np.flatnonzero(counts == c)
            at = (ends[rows] - c)[:, None] + np.arange(c)
            m = vectors[at]
            sims = m @ m.transpose(0, 2, 1)
            i, j = np.triu_indices(c, 1)
            for a, b in ((i, j), (j, i)):
                s, u, v = sims[:, a, b].ravel(), at[:, a].ravel(), at[:, b].ravel()
                keep = s > least[u]
                us.append(ids[u[keep]])
                vs.append(ids[v[keep]])
                ss.append(s[keep])
        yield {"u": pa.array(np.concatenate(us)), "v": pa.array(np.concatenate(vs)), "sim": pa.array(np.concatenate(ss))}

    return kept(nearest(graph.select("u", "v", "sim").union(per_batch(lists, "u long, v long, sim double", make)), size))


def count_links(members: DataFrame, link: float) -> DataFrame:
    """(node, n): links of each vector inside its component, copies counted.

    Lists that are full of links are enlarged to the component.  Components of up
    to PART vectors share groups; larger ones are cut into parts, and every two
    parts meet in a group of their own.  ``members``: (component, node, m, vector).
    """
    ship_package(members.sparkSession)
    sizes = kept(members.groupBy("component").agg(F.count("*").alias("size")).where("size > 1"))
    small_rows = sizes.where(F.col("size") <= PART).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    groups = max(1, -(-small_rows // PART))
    rows = members.join(broadcast_if_small(sizes), "component")
    parts = F.ceil(F.col("size") / PART).cast("int")
    rows = rows.withColumn("own", F.when(F.col("size") > PART, F.pmod(F.xxhash64("node"), parts)).otherwise(0).cast("int"))
    others = F.when(F.col("size") > PART, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("other", F.explode(others))
    group = F.when(F.col("size") > PART, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(groups)))
    rows = rows.select((F.col("size") > PART).alias("large"), group.alias("g"), F.least("own", "other").alias("i"),
                       F.greatest("own", "other").alias("j"), "own", "component", "node", "m", "vector")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("component")
        comps, ids, weight = (table.column(c).to_numpy() for c in ("component", "node", "m"))
        own, i, j = table.column("own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        vectors = table.column("vector").combine_chunks()
        total = np.zeros(len(ids), dtype=np.int64)
        edges = np.flatnonzero(np.append(True, comps[1:] != comps[:-1]))
        for a, b in zip(edges, np.append(edges[1:], len(ids))):
            x = _matrix(vectors.slice(a, b - a))
            close = cosines(x, x) >= link
            np.fill_diagonal(close, False)
            if i != j:
                close &= own[a:b, None] != own[None, a:b]
            total[a:b] = close @ weight[a:b]
        return pa.table({"node": ids, "n": total})

    found = rows.groupBy("large", "g", "i", "j").applyInArrow(compare, "node long, n long")
    return found.groupBy("node").agg(F.sum("n").alias("n"))


def audit(nodes: DataFrame, n: int, found: DataFrame, link: float, size: int, seed: int) -> tuple[DataFrame, int, int]:
    """Links of a sample of ``size`` of the ``n`` vectors, searched among all rows:
    (those between different components, their number, all links found).  A sample
    beyond AUDIT_MOST is searched in passes of about that many."""
    place = F.xxhash64("node", F.lit(seed))
    if min(size, n) <= AUDIT_MOST:
        samples = [nodes.orderBy(place).limit(size)]
    else:
        slices = -(-n // AUDIT_MOST)
        samples = [nodes.where(F.pmod(place, F.lit(slices)) == k) for k in range(min(slices, -(-size // AUDIT_MOST)))]
    passes = [sample_links(nodes, x, link) for x in samples]
    links = kept(reduce(DataFrame.union, passes))
    names = found.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    other = found.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    marked = links.join(names, "a", "left").join(other, "b", "left")
    missed = kept(marked.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b"))
    return missed, missed.count(), links.count()


def sample_links(nodes: DataFrame, chosen: DataFrame, link: float) -> DataFrame:
    """(a, b): links of the few rows ``chosen`` among all rows, in blocks."""
    sample = chosen.select("node", "vector").toArrow().combine_chunks()
    lengths = pc.list_value_length(sample.column("vector"))
    blocks: list[tuple[int, np.ndarray, np.ndarray]] = []
    for dim in lengths.unique().to_pylist():
        own = sample.filter(pc.equal(lengths, dim)).combine_chunks()
        ids, vectors = own.column("node").to_numpy(), _matrix(own.column("vector").combine_chunks())
        blocks += [(dim, ids[at:at + AUDIT_BLOCK], vectors[at:at + AUDIT_BLOCK]) for at in range(0, len(ids), AUDIT_BLOCK)]

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for dim, ids, vectors in blocks:
            part = batch.filter(pa.array(lengths == dim))
            if part.num_rows:
                a, b = np.nonzero(cosines(vectors, _matrix(part.column(1))) >= link)
                other = part.column(0).to_numpy()[b]
                keep = ids[a] != other
                yield {"a": pa.array(ids[a][keep]), "b": pa.array(other[keep])}

    return cut(per_batch(nodes.select("node", "vector"), "a long, b long", make, rows=2048))


def descend(graph: DataFrame, nodes: DataFrame, link: float, size: int) -> DataFrame:
    """Rounds of NN-descent until the lists gain no further link: a list keeps the
    nearest of a growing set, so its links only grow in number, up to its size."""
    known = -1
    while True:
        graph = refine(graph, nodes, size)
        links = graph.where(F.col("sim") >= link).count()
        if links <= known:
            return graph
        known = links


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", link: float = LINK, size: int = LIST,
                 trees: int = TREES, seed: int = 31) -> DataFrame:
    """(key, n_links, component_id, kept), one row per row of ``table``.

    1. Equal vectors become one node with a count.
    2. Random-hyperplane trees give each node a first list of near nodes, and
       links that join near nodes of a leaf; crowded leaves are split about their middle.
    3. NN-descent: neighbours of neighbours are compared and lists refined until a
       round brings no further link.
    4. List entries at the threshold are links; they give components.  Inside a
       component every list is enlarged to the whole component, compared exactly
       in parts, so that no saturated list hides a link.
    5. The recall of a fresh sample is audited against all rows; missed links are
       added, and more trees are grown and more vectors audited until an audit finds
       none missing or has searched every vector; each audit's recall is logged.

    Vectors that are null, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths.  Null keys stay null and never
    name a component while another key is there.  Repeated rows count as vectors
    of their own.  An empty table gives no rows; other columns are not carried.
    """
    name = key_or_hash(F.col(key), F.col(vector).cast("string"))
    real = F.col(vector).cast("array<double>")
    good = valid_vector(real)
    rows = table.select(name.alias("key"), F.when(good, F.xxhash64(real, F.size(real))).alias("node"), real.alias("vector"))
    nodes = cut(rows.where("node is not null").groupBy("node").agg(
        F.first("vector").alias("vector"), F.min("key").alias("least"), F.count("*").alias("m")))
    n = nodes.count()
    graph, links = None, None
    for turn in range(AUDIT_ROUNDS):
        dealt = leaves(nodes, n, trees, LEAF, seed + turn)
        pairs = cut(dealt.groupBy("leaf", "part").applyInArrow(lambda t: _leaf_lists(t, link, size), "u long, v long, sim double"))
        lists = pairs.where("sim <= 1.5")
        graph = kept(nearest(lists if graph is None else lists.union(graph), size))
        graph = cut(descend(graph, nodes, link, size), narrow=True)
        new = graph.where(F.col("sim") >= link).select(F.col("u").alias("a"), F.col("v").alias("b")).union(
            pairs.where("sim > 1.5").select("u", "v"))
        links = new if links is None else links.union(new)
        found = components(links)
        sample = max(AUDIT, 4 * math.isqrt(n)) * 4 ** turn
        missed, lost, seen = audit(nodes, n, found, link, sample, seed + 1000 + turn)
        recall = 1 - lost / seen if seen else 1.0
        log.log(logging.WARNING if lost else logging.INFO, "op1 audit %d: %d of %d links of %d vectors missing, recall %.5f",
                turn, lost, seen, min(n, sample), recall)
        if not lost:
            break
        links = links.union(missed)
        found = components(links)
        if sample >= n:
            break  # every row was searched: nothing is missing now
    members = nodes.join(found.select(F.col("id").alias("node"), "component"), "node").select("component", "node", "m", "vector")
    counts = count_links(members, link)
    least = nodes.join(found.select(F.col("id").alias("node"), "component"), "node").groupBy("component").agg(F.min("least").alias("first"))
    named = found.join(least, "component").select(F.col("id").alias("node"), "first")
    results = (nodes.select("node", "least", "m").join(counts, "node", "left").join(named, "node", "left")
               .select("node", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("first", "least").alias("component")))
    out = rows.select("key", "node").join(results, "node", "left")
    component = F.coalesce("component", "key")
    return out.select(drop_stand_in(F.col("key")).alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                      drop_stand_in(component).alias("component_id"), (F.col("key") == component).alias("kept"))

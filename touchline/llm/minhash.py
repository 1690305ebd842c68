"""Operator 6: circulant MinHash near-duplicates, confirmed by exact Jaccard."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.frames import broadcast_if_small, cut, drop_stand_in, kept, key_or_hash, per_batch
from touchline.llm.words import WORD_BASE, Powers, mix64, runs, seeded

WIDTH = 5
#: Links have 100 * |A and B| >= LINK_PERCENT * |A or B|.
LINK_PERCENT = 85
#: Coordinates of a signature, unless single ones make too few bands.
COORDINATES = 192
#: Largest probabilities that a pair at the threshold shares no band, and that
#: fewer coordinates than the sketch floor agree.
BAND_MISS, SKETCH_MISS = 3e-7, 1e-7
#: The universe of the two permutations.
UNIVERSE = 1 << 20
#: Buckets up to this many classes compare pairs; larger ones go block by block.
SMALL_BUCKET = 48
BLOCK = 256
_MEMO: dict = {}


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that, as many as BAND_MISS asks for, fit in
    COORDINATES.  85: 32 bands of 6; 80: 38 of 5."""
    same = min(percent, 99) / 100

    def needed(rows: int) -> int:
        return math.ceil(math.log(BAND_MISS) / math.log1p(-same ** rows))
    rows = max((r for r in range(1, COORDINATES + 1) if same ** r > 1e-9 and r * needed(r) <= COORDINATES), default=1)
    return needed(rows), rows


def sketch_floor(percent: int, coordinates: int) -> int:
    """The largest floor that a pair at the threshold stays below with probability
    SKETCH_MISS at most (binomial tail).  85 of 192: 135; 80 of 190: 121."""
    same, below = min(percent, 99) / 100, 0.0
    for floor in range(coordinates):
        below += math.comb(coordinates, floor) * same ** floor * (1 - same) ** (coordinates - floor)
        if below > SKETCH_MISS:
            return floor
    return coordinates


def circulant(width: int, universe: int = UNIVERSE) -> tuple[np.ndarray, np.ndarray]:
    """(sigma, windows): the first permutation, and for every position p the values
    of the second at p, p+1, ..., p+width-1 (circularly): row p holds what element
    p contributes to each coordinate."""
    if (width, universe) not in _MEMO:
        sigma = np.argsort(seeded(101, universe), kind="stable").astype(np.int32)
        pi = np.argsort(seeded(202, universe), kind="stable").astype(np.int32)
        ring = np.concatenate([pi, pi[:width - 1]])
        _MEMO[width, universe] = sigma, np.lib.stride_tricks.sliding_window_view(ring, width)
    return _MEMO[width, universe]


def signature(shingles: np.ndarray, sigma: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Minimum over the set of every shift's values, a few thousand elements at a time."""
    at = sigma[(shingles >> np.uint64(40)).astype(np.int64) % len(sigma)]
    return np.minimum.reduce([windows[at[i:i + 2048]].min(axis=0) for i in range(0, len(at), 2048)])


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.  A text with fewer words
    than ``width`` has its whole sequence as one; without words it has none."""
    for texts in runs(column, lower=True):
        words = texts.word_hashes()
        at, hashes = texts.windows(words, width)
        cut_at = np.searchsorted(at, texts.word_at)
        for i in range(texts.n):
            first, last = texts.word_at[i], texts.word_at[i + 1]
            if last - first >= width:
                yield np.unique(hashes[cut_at[i]:cut_at[i + 1]])
            elif last > first:
                few = words[first:last] * Powers(WORD_BASE, width).at(np.arange(last - first))
                yield mix64(np.array([few.sum() + np.uint64(last - first)], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


SIGNED = "key long, n long, fp1 long, fp2 long, bands array<long>, sketch binary"


def sign(docs: DataFrame, key: Column, text: Column, bands: int, rows: int, width: int = WIDTH) -> DataFrame:
    """Per document: set size, two fingerprints of the whole set, the hash of each
    band of its signature, and the low byte of each coordinate."""
    salt = seeded(303, bands)

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        sigma, windows = circulant(bands * rows)
        n, f1, f2, keys, sketches = [], [], [], [], []
        for s in shingle_sets(batch.column(1), width):
            n.append(len(s))
            f1.append(s.sum(dtype=np.uint64))
            f2.append(mix64(s).sum(dtype=np.uint64))
            if not len(s):
                keys.append(None)
                sketches.append(None)
                continue
            mins = signature(s, sigma, windows)
            powers = Powers(WORD_BASE, rows).at(np.arange(rows))
            keys.append(mix64((mins.reshape(bands, rows).astype(np.uint64) * powers).sum(axis=1) + salt).view(np.int64))
            sketches.append(mins.astype(np.uint8).tobytes())
        yield {"key": batch.column(0), "n": pa.array(n, pa.int64()),
               "fp1": pa.array(np.array(f1, dtype=np.uint64).view(np.int64)),
               "fp2": pa.array(np.array(f2, dtype=np.uint64).view(np.int64)),
               "bands": pa.array(keys, pa.list_(pa.int64())), "sketch": pa.array(sketches, pa.binary())}

    return per_batch(docs.select(key.alias("__key"), text.alias("__text")), SIGNED, make)


def full_sets(docs: DataFrame, key: Column, text: Column, wanted: DataFrame, width: int = WIDTH) -> DataFrame:
    """(id, n, shingles) of the documents whose key is in ``wanted.id``; the whole
    set as sorted 64-bit hashes."""
    rows = docs.select(key.alias("__key"), text.alias("__text"))
    rows = rows.join(broadcast_if_small(wanted.select(F.col("id").alias("__key"))), "__key", "left_semi")

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        sets = list(shingle_sets(batch.column(1), width))
        yield {"id": batch.column(0), "n": pa.array([len(s) for s in sets], pa.int64()),
               "shingles": pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())}

    found = per_batch(rows, "id long, n long, shingles binary", make)
    return found.groupBy("id").agg(F.max_by("n", "shingles").alias("n"), F.max("shingles").alias("shingles"))


def linked(a: bytes, b: bytes, percent: int = LINK_PERCENT) -> bool:
    x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _near_sizes(a: str, b: str, percent: int) -> Column:
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def close_sketches(pairs: DataFrame, sketches: DataFrame, percent: int, floor: int) -> DataFrame:
    """Pairs (a, b) of which size and sketch allow a link."""
    one = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").where(_near_sizes("na", "nb", percent)).select("a", "b", "sa", "sb")

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        left, right = ([np.frombuffer(x, dtype=np.uint8) for x in batch.column(i).to_pylist()] for i in (2, 3))
        keep = pa.array((np.stack(left) == np.stack(right)).sum(axis=1) >= floor)
        yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return per_batch(both, "a long, b long", make, rows=4096)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        keep = pa.array([linked(x.as_py(), y.as_py(), percent) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
        yield {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return per_batch(both, "a long, b long", make, rows=64)


def _pairs_of(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def block_links(members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links between different components inside large clusters.

    ``members`` has (cluster, id, component, n, shingles).  A cluster is cut into
    blocks of about ``block`` sets; every two blocks meet in one group, which
    compares their sets exactly and returns at most one link for each set.
    """
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    cut_up = members.join(broadcast_if_small(sizes), "cluster").withColumns({
        "blocks": F.ceil(F.col("size") / block).cast("int"),
        "own": F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / block)).cast("int")})
    meet = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.least(j, F.col("own")).alias("i"), F.greatest(j, F.col("own")).alias("j"))))
    groups = (cut_up.withColumn("meet", meet)
              .select("cluster", F.col("meet.i").alias("i"), F.col("meet.j").alias("j"), "own", "id", "component", "shingles"))

    def compare(table: pa.Table) -> pa.Table:
        ids, comps, own = (table.column(c).to_numpy() for c in ("id", "component", "own"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sets = [np.frombuffer(x, dtype="<u8") for x in table.column("shingles").to_pylist()]
        n = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        _, token = np.unique(flat, return_inverse=True)
        common = np.bincount(token)[token] > 1
        token, owner = np.unique(token[common], return_inverse=True)[1], owner[common]
        both = np.zeros((len(sets), len(sets)), dtype=np.float32)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        width = 4096
        for first in range(0, int(token[-1]) + 1 if len(token) else 0, width):
            lo, hi = np.searchsorted(token, [first, first + width])
            has = np.zeros((len(sets), width), dtype=np.float32)
            has[owner[lo:hi], token[lo:hi] - first] = 1
            both += has @ has.T
        ok = 100 * both >= percent * (n[:, None] + n[None, :] - both) - 1e-3
        ok &= comps[:, None] != comps[None, :]
        ok &= np.tri(len(sets), k=-1, dtype=bool)
        if i != j:
            ok &= own[:, None] != own[None, :]
        parent = {int(c): int(c) for c in comps}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for x, y in zip(*np.nonzero(ok)):
            p, q = root(int(comps[x])), root(int(comps[y]))
            if p != q:
                parent[p] = q
                out.append((int(ids[x]), int(ids[y])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return groups.groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = LINK_PERCENT,
                    width: int = WIDTH) -> DataFrame:
    """(key, n_shingles, component_id, kept), one row per row of ``docs``.

    1. Sign every document; documents with equal sets form a class.
    2. Classes sharing a band are candidates.  In each bucket the class found in
       the largest buckets meets all others: one pair a class, not all pairs.
    3. Pairs whose sizes and sketches allow it are confirmed on their full sets;
       confirmed links give components.
    4. Buckets whose classes now lie in one component are done.  The others
       compare across components: small buckets by pairs, large ones in blocks.

    Texts without words, and null texts, link with nothing.  A null key stays null
    and never names a component while another key is there; rows sharing a key
    count as one node, so repeated rows get equal results.  An empty table gives
    no rows; other columns are not carried.
    """
    out = _resolve(docs, key, text, percent, width)
    return out.select(drop_stand_in(F.col("key")).alias(key), F.col("n").alias("n_shingles"),
                      drop_stand_in(F.col("component")).alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))


def _resolve(docs: DataFrame, key: str, text: str, percent: int, width: int) -> DataFrame:
    """(key, n, component) per row, keys with stand-ins for nulls."""
    name = key_or_hash(docs[key], docs[text])
    signed = cut(sign(docs, name, docs[text], *banding(percent), width))
    classes = kept(signed.where("n > 0").groupBy("fp1", "fp2", "n")
                  .agg(F.min("key").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    found = components(_links(docs, name, docs[text], classes, percent, width))
    nodes = classes.join(found, "id", "left").select("fp1", "fp2", "n", F.coalesce("component", "id").alias("component"))
    out = signed.select("key", "n", "fp1", "fp2").join(nodes, ["fp1", "fp2", "n"], "left")
    return out.select("key", "n", F.coalesce("component", "key").alias("component"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = LINK_PERCENT,
                         width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates: the one with the
    smallest key (of several rows with that key, the smallest by all columns).
    Texts without words all stay, but for repeated rows.  Only the dropped and the
    repeated keys meet the rows: broadcast if their counted number allows."""
    found = cut(_resolve(docs, key, text, percent, width), narrow=True)
    named = docs.withColumn("__key", key_or_hash(docs[key], docs[text]))
    gone = kept(found.where("key <> component").select(F.col("key").alias("__key")).distinct())
    again = kept(found.where("key = component").groupBy(F.col("key").alias("__key")).agg(F.count("*").alias("c"))
                .where("c > 1").select("__key"))
    left = named.join(broadcast_if_small(gone), "__key", "left_anti")
    again = broadcast_if_small(again)
    once = left.join(again, "__key", "left_anti").select(*docs.columns)
    one = F.min(F.struct(*docs.columns)).alias("one")
    return once.union(left.join(again, "__key", "left_semi").groupBy("__key").agg(one).select("one.*"))


def _links(docs: DataFrame, name: Column, text: Column, classes: DataFrame, percent: int, width: int) -> DataFrame:
    sketches = classes.select("id", "n", "sketch")
    floor = sketch_floor(percent, math.prod(banding(percent)))
    rows = classes.select("id", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    rows = cut(rows.join(sizes, "bucket"), narrow=True)
    weight = rows.groupBy("id").agg(F.sum("size").alias("weight"))
    heads = rows.join(weight, "id").groupBy("bucket").agg(F.max(F.struct("weight", -F.col("id"))).alias("h"))
    heads = heads.select("bucket", (-F.col("h.col2")).alias("head"))
    pairs = rows.join(heads, "bucket").where("id <> head").select(*_pairs_of(F.col("id"), F.col("head"))).distinct()
    pairs = kept(close_sketches(pairs, sketches, percent, floor))
    wanted = kept(rows.select("id").distinct())
    sets = cut(full_sets(docs, name, text, wanted, width))
    links = cut(confirmed(pairs, sets, percent), narrow=True)

    found = components(links)
    rows = rows.join(found, "id", "left").select("bucket", "id", "size", F.coalesce("component", "id").alias("component"))
    live = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    rows = kept(rows.join(live.select("bucket"), "bucket"))
    small = rows.where(F.col("size") <= SMALL_BUCKET)
    left = small.select("bucket", F.col("id").alias("x"), F.col("component").alias("cx"))
    right = small.select("bucket", F.col("id").alias("y"), F.col("component").alias("cy"))
    cross = left.join(right, "bucket").where("x < y and cx <> cy").select(F.col("x").alias("a"), F.col("y").alias("b"))
    cross = close_sketches(cross.distinct().join(pairs, ["a", "b"], "left_anti"), sketches, percent, floor)
    links = links.union(confirmed(kept(cross), sets, percent))

    large = rows.where(F.col("size") > SMALL_BUCKET)
    joint = large.groupBy("bucket").agg(F.min("id").alias("head"))
    clusters = components(large.join(joint, "bucket").select(F.col("id").alias("a"), F.col("head").alias("b")))
    members = (clusters.select("id", F.col("component").alias("cluster"))
               .join(large.select("id", "component").distinct(), "id").join(sets, "id"))
    return links.union(block_links(members, percent))

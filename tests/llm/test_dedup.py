import hashlib
import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import docs_frame, prose, shingles, union_find, words
from touchline.llm import neighbours
from touchline.llm.components import components
from touchline.llm.minhash import BLOCK, banding, drop_near_duplicates, near_duplicates, sketch_floor
from touchline.llm.neighbours import PART, cosines, leaves, near_vectors
from touchline.llm.substrings import remove_repeats, rightmost_minimum


def near_texts(seed=3):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "One two", "one TWO", "a b c d e", "a b c d e f"]
    for _ in range(6):
        base = prose(rng, rng.randrange(30, 160), 5000)
        out.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
            out.append("\n".join(copy))
    out += out[7:12]  # repeated texts under other ids
    out.append(" ".join(prose(rng, 30_000, 10 ** 6)))  # a very long one
    return out


def expected_near(texts):
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(sets)), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return sets, union_find(range(len(sets)), links)


def test_minhash_equals_brute_force(spark):
    texts = near_texts()
    sets, component = expected_near(texts)
    got = {r.doc_id: r for r in near_duplicates(docs_frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, s in enumerate(sets):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), component[i], component[i] == i)


def test_minhash_large_cluster_goes_block_by_block(spark):
    """Copies of one text, each with its own changes: more than a block of them,
    linked through the original or through each other."""
    rng = random.Random(9)
    base = prose(rng, 120, 10 ** 6)
    texts = []
    for _ in range(BLOCK + 60):
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(len(copy))] = f"y{rng.randrange(10 ** 6)}"
        texts.append(" ".join(copy))
    _, component = expected_near(texts)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_frame(spark, texts)).collect()}
    assert got == component


def test_minhash_nulls_repeats_and_empty(spark):
    frame = docs_frame(spark, ["a b c d e f g"] * 3 + ["q r s t u v"], [7, 7, None, None])
    got = sorted((r.doc_id is None, r.component_id or 0, r.kept) for r in near_duplicates(frame).collect())
    assert got == [(False, 7, True), (False, 7, True), (True, 0, True), (True, 7, False)]
    assert drop_near_duplicates(frame).count() == 2
    assert near_duplicates(frame.where("false")).count() == 0


def test_one_document_of_each_group_stays(spark):
    texts = near_texts(5)
    _, component = expected_near(texts)
    frame = docs_frame(spark, texts)
    kept = drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == set(component.values())


def expected_cut(texts, span=35):
    all_words = [words(t) for t in texts]
    seen = Counter(tuple(w[i:i + span]) for w in all_words for i in range(len(w) - span + 1))
    out = []
    for w in all_words:
        gone = [False] * len(w)
        for i in range(len(w) - span + 1):
            if seen[tuple(w[i:i + span])] > 1:
                gone[i:i + span] = [True] * span
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_substrings_equal_brute_force(spark):
    rng = random.Random(4)
    passage, other = prose(rng, 60), prose(rng, 34)
    texts = [None, "", "  ", "short text", " ".join(["same"] * 80), " ".join(prose(rng, 35)), "\t".join(passage) + "\n"]
    for _ in range(25):
        lo, hi = rng.randrange(0, 20), rng.randrange(40, 61)
        texts.append(" ".join(prose(rng, rng.randrange(0, 50)) + passage[lo:hi] + prose(rng, rng.randrange(0, 40)) + other))
    texts += [texts[8], " ".join(prose(rng, 9000)) + " " + " ".join(passage)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(docs_frame(spark, texts)).collect()}
    want = dict(enumerate(expected_cut(texts)))
    assert got == want
    digests = {r.doc_id: r.kept_sha256 for r in remove_repeats(docs_frame(spark, texts), digest=True).collect()}
    assert digests == {i: hashlib.sha256(w[2].encode()).hexdigest() for i, w in want.items()}


def test_substrings_repeated_rows_null_keys_empty(spark):
    text = " ".join(f"w{i}" for i in range(50))
    got = remove_repeats(docs_frame(spark, [text, text, "alone"], [1, 1, None])).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 1, 0), (1, 50, 50), (1, 50, 50)]
    assert remove_repeats(docs_frame(spark, ["a"]).where("false")).count() == 0


def test_rightmost_minimum():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 300).astype(np.uint64)
    got = rightmost_minimum(x, 28)
    for i in range(len(x) - 27):
        w = x[i:i + 28]
        assert got[i] == i + 27 - int(np.argmin(w[::-1]))


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    out = rng.standard_normal((60, 16)).tolist()
    for size in (2, 5, 40):
        center = rng.standard_normal(16)
        out += (center + 0.28 * rng.standard_normal((size, 16))).tolist()
    out += [out[3]] * 4 + [[2 * x for x in out[5]]]
    return out


def test_near_vectors_equal_brute_force(spark):
    data = vectors()
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0], [1.0, 2.0]]
    rows = [(i, v, 0, "x") for i, v in enumerate(data + odd)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")
    m = np.array(data)
    m /= np.linalg.norm(m, axis=1)[:, None]
    close = m @ m.T >= 0.95
    np.fill_diagonal(close, False)
    n = len(data)
    links = [*zip(*np.nonzero(close)), (n + 6, n + 7)]
    component = union_find(range(n + len(odd)), [(int(a), int(b)) for a, b in links])
    degree = [*close.sum(axis=1), 0, 0, 0, 0, 0, 0, 1, 1]
    got = {r.vec_id: r for r in near_vectors(frame).collect()}
    assert len(got) == len(rows)
    for i in range(len(rows)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (degree[i], component[i], component[i] == i)


def test_near_vectors_null_keys_repeats_empty(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.1])], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in near_vectors(frame).collect())
    assert got == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]
    assert near_vectors(frame.where("false")).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 1)], [(2, 1), (2, 3), (5, 4)], [(i, i + 1) for i in range(40)],
                                   [(0, i) for i in range(1, 30)] + [(50, 29), (60, 50)]])
def test_components(spark, links):
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in components(frame).collect()}
    real = [x for x in links if x[0] != x[1]]
    assert got == union_find({i for x in real for i in x}, real)


def test_vectors_audit_counts_every_link(spark):
    """Recall of the operator on a sample with brute force beside it: all links."""
    data = vectors(8)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    m = np.array(data)
    m /= np.linalg.norm(m, axis=1)[:, None]
    assert near_vectors(frame).agg(F.sum("n_links")).first()[0] == int((m @ m.T >= 0.95).sum() - len(data))


def crowded_vectors(crowd, pairs, dim=64):
    """A crowd at cosine about 0.90 in which ``pairs`` vectors have a partner at 0.953."""
    rng = np.random.default_rng(5)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    middle = unit(rng.standard_normal(dim))
    own = rng.standard_normal((crowd, dim))
    own = unit(own - np.outer(own @ middle, middle))
    side = rng.standard_normal((pairs, dim))
    side -= np.outer(side @ middle, middle)
    side = unit(side - (side * own[:pairs]).sum(1, keepdims=True) * own[:pairs])
    near = 0.53 * own[:pairs] + np.sqrt(1 - 0.53 ** 2) * side
    return rng.permutation(np.sqrt(0.9) * middle + np.sqrt(0.1) * np.vstack([own, near]))


def test_no_link_is_lost_in_a_crowd(spark):
    """More rows in a leaf than a part holds, and links that only few trees show."""
    m = crowded_vectors(1500, 300)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    close = cosines(m, m) >= 0.95
    np.fill_diagonal(close, False)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(frame).collect()}
    root = union_find(range(len(m)), zip(*np.nonzero(close)))
    assert {i: n for i, (n, _) in got.items()} == dict(enumerate(close.sum(1)))
    assert {i: c for i, (_, c) in got.items()} == root


def test_crowds_are_split_about_their_middle(spark):
    """Parts stay bounded, hold every row once, and keep near pairs together more often than chance."""
    m = crowded_vectors(3000, 300)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "node long, vector array<double>")
    got = leaves(nodes, len(m), trees=1, leaf=len(m), seed=3).select("leaf", "part", "node").toPandas()
    assert sorted(got.node) == list(range(len(m))) and got.groupby(["leaf", "part"]).size().max() <= 600
    part = got.set_index("node").part
    close = np.argwhere(np.triu(cosines(m, m) >= 0.95, 1))
    together = np.mean([part[a] == part[b] for a, b in close])
    assert together > 1.5 * PART / len(m)


@pytest.mark.parametrize("most", [100, 5000])
def test_audit_of_every_vector_finds_every_missing_link(spark, monkeypatch, most):
    monkeypatch.setattr(neighbours, "AUDIT_MOST", most)
    m = crowded_vectors(300, 40)
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "node long, vector array<double>")
    nothing = spark.createDataFrame([], "id long, component long")
    missed, lost, seen = neighbours.audit(nodes, len(m), nothing, 0.95, len(m), 1)
    want = int((cosines(m, m) >= 0.95).sum()) - len(m)
    assert lost == seen == want and missed.distinct().count() == want


@pytest.fixture
def no_broadcast(monkeypatch):
    """As if every counted side were too large to broadcast."""
    from touchline.llm import minhash, neighbours, substrings
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", -1)
    for module in (minhash, neighbours, substrings):
        monkeypatch.setattr(module, "broadcast_if_small", lambda df, *a, **k: df)


def test_results_do_not_depend_on_broadcasts(spark, no_broadcast):
    texts = near_texts(7)
    _, component = expected_near(texts)
    frame = docs_frame(spark, texts)
    assert {r.doc_id: r.component_id for r in near_duplicates(frame).collect()} == component
    assert {r.doc_id for r in drop_near_duplicates(frame).collect()} == set(component.values())
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in remove_repeats(frame).collect()}
    assert got == dict(enumerate(expected_cut(texts)))


@pytest.mark.parametrize("percent, bands, rows, floor", [(85, 32, 6, 135), (80, 38, 5, 121)])
def test_bands_and_sketch_floor_follow_the_threshold(percent, bands, rows, floor):
    assert banding(percent) == (bands, rows) and sketch_floor(percent, bands * rows) == floor


@pytest.mark.parametrize("percent", [1, 10, 50, 70, 80, 85, 90, 95, 99, 100])
def test_true_pairs_are_rarely_missed_at_any_threshold(percent):
    same = min(percent, 99) / 100
    bands, rows = banding(percent)
    n = bands * rows
    floor = sketch_floor(percent, n)
    assert (1 - same ** rows) ** bands <= 3.0001e-7
    assert sum(math.comb(n, k) * same ** k * (1 - same) ** (n - k) for k in range(floor)) <= 1e-7


def test_pipeline_drops_copies_from_080_on(spark):
    """Planted pairs between 0.80 and 0.85, below 0.80 and above 0.85."""
    rng = random.Random(12)
    texts = []
    for changes in [4] * 40 + [3, 5, 6] * 20:
        base = prose(rng, 204, 10 ** 6)
        copy = list(base)
        for at in range(changes):
            copy[20 + 40 * at if changes < 5 else 20 + 30 * at] = f"z{rng.randrange(10 ** 6)}"
        texts += [" ".join(base), " ".join(copy)]
    sets = [shingles(t) for t in texts]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    between = [2 * i + 1 for i, j in enumerate(alike) if 0.8 <= j < 0.85]
    assert len(between) >= 40 and min(alike) < 0.8 and max(alike) >= 0.85
    links = [(a, b) for a, b in combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    stays = set(union_find(range(len(sets)), links).values())
    frame = docs_frame(spark, texts)
    got = {r.doc_id for r in corpus_pipeline.drop_copies(spark, frame, "").collect()}
    assert got == stays and not got & set(between)
    assert set(between) <= {r.doc_id for r in drop_near_duplicates(frame).collect()}

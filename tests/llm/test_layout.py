import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import docs_frame, prose, shingles, union_find
from touchline.llm.mixing import mix_sources, poisson_tables, source_rates
from touchline.llm.packing import END_ID, assign, pack_documents, powers_of_two
from touchline.llm.sharding import assign_shards, number_slots, shard_digest

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def pack_texts():
    rng = random.Random(1)
    texts = [None, "", "  ", "Hello, World! It's", "we'll.'s a.b,c=\u0338 x.\u0301 3.14 _a_b_ \u201cq\u201d. don't! #tag's", "1-2 a'.", "\x01 \x02 sign  x", "Ünïcödé straße", "a" * 5000]
    texts += ["end <|endoftext|> next", "<|ENDOFTEXT|>x <|startoftext|>", "a<|endoftext|>b<|endoftext|>", " <|startoftext|> ", "<|endoftext"]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|startoftext|>", " ", "word", "A.b", "<|", "|>", "\n"]) for _ in range(8)) for _ in range(100)]
    return texts + [" ".join(prose(rng, rng.randrange(1, 900))) for _ in range(40)] + [" ".join(prose(rng, 9000))] + ["same text"] * 3


def test_packing_is_an_exact_round_trip(spark):
    texts = pack_texts()
    tok = Tokenizer.from_file(TOKENIZER)
    rows = pack_documents(docs_frame(spark, texts), with_ids=True, block_tokens=4096).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and r.length == len(r.ids)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids + [END_ID]
        parts = sorted(by_doc[i], key=lambda r: r.start)
        assert [x for r in parts for x in r.ids] == want
        assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts[:-1]]))
        assert all(r.doc_tokens == len(want) for r in parts)
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == list(np.cumsum([0] + [r.length for r in parts[:-1]]))
        total = sum(r.length for r in parts)
        assert total <= 2048 and total & (total - 1) == 0  # full, or a power of two: no padding at all


def test_packing_edges(spark):
    rows = pack_documents(docs_frame(spark, ["x", "x", None], [5, 5, None])).collect()
    assert Counter(r.doc_id for r in rows) == {5: 2, None: 1}
    assert pack_documents(docs_frame(spark, ["x"]).where("false")).count() == 0


def test_assignment_balances_cost():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 2048, 300)
    full = int(lengths.sum() // 2048)
    placed, left = assign(lengths, [2048] * full)
    cost, room = np.zeros(full), np.zeros(full)
    for _, _, n, s in placed:
        cost[s] += n + n * n / 1024
        room[s] += n
    assert (room == 2048).all() and sum(int(lengths[i]) - s for i, s in left) == lengths.sum() - 2048 * full
    room, plain = [2048] * full, np.zeros(full)  # first fit, descending
    for n in sorted(lengths.tolist(), reverse=True):
        s = next((s for s in range(full) if room[s] >= n), None)
        if s is not None:
            room[s] -= n
            plain[s] += n + n * n / 1024
    assert cost.std() < 0.9 * plain.std()
    assert powers_of_two(11) == [8, 2, 1] and powers_of_two(0) == []


def test_shards(spark):
    texts = ["a", "bé", None, ""] * 200
    frame = docs_frame(spark, texts)
    rows = shard_digest(frame).collect()
    slots = defaultdict(list)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(t) + 16, zlib.crc32(t), "key")
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert len(rows) == 800 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(40))
    moved = sum(r.grown_shard == 40 for r in rows)
    assert 5 < moved < 45
    more = {r.doc_id: r.shard for r in assign_shards(frame, [1.0] * 41).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in rows)


def test_weighted_shards_and_small_groups(spark):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    placed = assign_shards(frame, [1.0, 3.0, 0.0])
    n = Counter(r.shard for r in placed.collect())
    assert 2 not in n and 2.5 < n[1] / n[0] < 3.5
    slots = number_slots(placed.select("doc_id", "shard"), ["doc_id"], group_rows=50).collect()
    for shard in (0, 1):
        assert sorted(r.slot for r in slots if r.shard == shard) == list(range(n[shard]))


def test_shard_edges(spark):
    rows = shard_digest(docs_frame(spark, ["x", "x", "y", None], [3, 3, None, None])).collect()
    assert len(rows) == 4 and len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert shard_digest(docs_frame(spark, ["x"]).where("false")).count() == 0


def test_mixing_meets_the_rates(spark):
    frame = docs_frame(spark, [f"t{i}" for i in range(6000)])
    rates = {r.source: r for r in source_rates(frame).collect()}
    weight = {s: r.n_rows ** 0.5 for s, r in rates.items()}
    for s, r in rates.items():
        assert r.rate == pytest.approx(6000 * weight[s] / sum(weight.values()) / r.n_rows)
    out = mix_sources(frame)
    rows = out.collect()
    assert out.columns == [*frame.columns, "copy", "n_copies", "rate", "shuffle_key"]
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows)
    n = Counter(r.source or "(none)" for r in rows)
    for s, r in rates.items():
        mean = r.rate * r.n_rows
        assert abs(n[s] - mean) < 5 * mean ** 0.5
    copies = Counter(r.doc_id for r in rows)
    assert all(copies[r.doc_id] == r.n_copies and 1 <= r.copy <= r.n_copies for r in rows)
    assert rows == mix_sources(frame).collect()
    # neighbours in the order are not neighbours in the input
    assert abs(np.corrcoef([r.doc_id for r in rows[:-1]], [r.doc_id for r in rows[1:]])[0, 1]) < 0.1


def test_poisson_tables_far_out(spark):
    rates = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 0.7), ("c", 1, 5000.0)], "source string, n_rows long, rate double")
    got = {r.source: r.cdf for r in poisson_tables(rates).collect()}
    assert got["a"][0] == 1.0
    assert got["b"][:3] == pytest.approx([np.exp(-0.7), np.exp(-0.7) * 1.7, np.exp(-0.7) * 1.945])
    assert got["c"][-1] == pytest.approx(1.0) and got["c"][5000] == pytest.approx(0.5, abs=0.01)


def test_mixing_edges(spark):
    frame = docs_frame(spark, ["x", None, None, "y"], [1, None, None, 1])
    weights = spark.createDataFrame([("s0", 1.0), ("s0", 1.0), ("unknown", 9.0), ("s1", -2.0)], "source string, weight double")
    rows = mix_sources(frame, weights, total=40).collect()
    # the two rows of s0 share a key and so a draw, of mean 20
    assert {r.source for r in rows} == {"s0"} and len(rows) % 2 == 0 and 10 < len(rows) < 80
    assert mix_sources(frame.where("false")).count() == 0


def test_pipeline_stages(spark):
    """Each stage on its own input: columns, rows kept and decisions."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from touchline.llm.quality import rate_documents
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "personal data", "mixing", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    first = stages["quality rules"](spark, docs, sf).cache()
    want = {r.doc_id for r in rate_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("kept").collect()}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == want
    second = stages["near duplicates"](spark, first, sf).cache()
    sets = {r.doc_id: shingles(r.text) for r in first.collect()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    roots = union_find(sets, links)
    assert len(links) > 0 and {r.doc_id for r in second.collect()} == {i for i, root in roots.items() if i == root}
    third = stages["personal data"](spark, second, sf).cache()
    assert third.columns == docs.columns and third.count() == second.count()
    assert third.where("text like '%@mail%' or n_chars <> length(text)").count() == 0
    fourth = stages["mixing"](spark, third, sf)
    assert fourth.columns == docs.columns and fourth.join(third, docs.columns, "left_anti").count() == 0
    last = corpus_pipeline.run(spark, sf)
    assert last.agg(F.sum("length")).first()[0] == pack_documents(fourth).agg(F.sum("length")).first()[0]

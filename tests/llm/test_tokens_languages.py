import bisect
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import prose
from touchline.llm.alignment import align, align_digest, pack, unpack
from touchline.llm.collocations import COLLOCATION_SQL, collocations
from touchline.llm.language import LONGEST_GRAM, SMOOTHING, UNKNOWN, identify_documents

SCHEMA = "doc_id long, text string, lang string, hash long, n long, rank string, words int"


def frame(spark, texts, langs=None, ids=None):
    """Documents with further columns whose names clash with inner ones."""
    langs = langs or ["en"] * len(texts)
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, x, 7, 7, "r", 1) for i, t, x in zip(ids, texts, langs)], SCHEMA).repartition(3)


def phrase_texts():
    rng = random.Random(9)
    texts = [None, "", " \t ", "One two. ONE\ttwo;one two\none two", "a,b", "ÄB äb Äb", "\x00 x \x00 x"] * 2
    for _ in range(150):
        texts.append(" ".join(prose(rng, rng.randrange(1, 80), 12)) + rng.choice([".", " ", "\r\n", "!"]) + "New York City is big")
    return texts + ["same same same same same same"] * 4 + [" ".join(prose(rng, 6000, 30))]


@pytest.mark.parametrize("support,top,shard_words", [(20, 2000, 300), (5, 15, 10 ** 6)])
def test_collocations_equal_sql(spark, support, top, shard_words):
    texts = phrase_texts()
    langs = [None if i % 7 == 0 else "en" if i % 3 else "" for i in range(len(texts))]
    docs = frame(spark, texts, langs)
    got = sorted(tuple(r) for r in collocations(docs, support=support, top=top, shard_words=shard_words).collect())
    table = pa.table({"text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string())})
    con = duckdb.connect()
    con.register("docs", table)
    want = con.execute(COLLOCATION_SQL.format(docs="docs", support=support, top=top)).fetchall()
    assert got == sorted(want) and len(got) > 10


def test_collocations_edges(spark):
    assert collocations(frame(spark, ["a b"]).where("false")).count() == 0
    assert collocations(frame(spark, [None, "", "a b c"])).count() == 0
    # the five words occur as often as all their parts, so only they are left
    rows = collocations(frame(spark, ["v w x y z"] * 100)).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows] == [("v w x y z", 100, 100, 100, 500, 5000)]
    # equal scores and counts: byte order of the phrase
    rows = collocations(frame(spark, ["a b. é f. c d. Z q"] * 100)).orderBy("rank").collect()
    assert [r.phrase for r in rows] == ["a b", "c d", "z q", "é f"] and [r.rank for r in rows] == [1, 2, 3, 4]


BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(texts):
    byte, piece = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    byte.encode_special_tokens = True
    out, links = [], []
    for text in texts:
        rows = None
        if text:
            enc = byte.encode(" " + text, add_special_tokens=False)
            whole = (" " + text).encode()
            a_sizes = [len(t) for t in enc.tokens]
            b = piece.encode(text)
            b_bytes = [bytes([int(p[3:5], 16)]) if piece.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in zip(b, piece.id_to_piece(b))]
            if sum(a_sizes) == len(whole) and b"".join(b_bytes) == whole:
                rows = (enc.ids, np.cumsum(a_sizes).tolist(), b, np.cumsum([len(x) for x in b_bytes]).tolist())
        if rows is None:
            out.append([0, 0, 0, 0, ""])
            links.append(Counter())
            continue
        a, a_end, b, b_end = rows
        ends = sorted(set(a_end) & set(b_end))
        groups = [([], []) for _ in ends]
        for side, (ids, at) in enumerate(((a, a_end), (b, b_end))):
            for i, e in zip(ids, at):
                groups[bisect.bisect_left(ends, e)][side].append(str(i))
        found = Counter()
        for i, (lo, hi) in zip(a, pairwise([0, *a_end])):
            for j, (lo2, hi2) in zip(b, pairwise([0, *b_end])):
                if lo < hi2 and lo2 < hi:
                    found[i, j] += 1
        out.append([len(a), len(b), len(ends), sum(found.values()), ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)])
        links.append(found)
    docs = Counter(p for f in links for p in f)
    highest = defaultdict(int)
    for (i, _), n in docs.items():
        highest[i] = max(highest[i], n)
    for row, found in zip(out, links):
        row += [sum(n for p, n in found.items() if docs[p] == highest[p[0]]), sum(n * docs[p] for p, n in found.items())]
    return out, docs, sum(links, Counter())


def token_texts():
    rng = random.Random(4)
    parts = ["a", "é", " ", "  ", "\n", "\t", " \n ", " ", "　", " ", " word", "'s", "don't", "...", "<s>",
             "<|endoftext|>", "<unk>", "▁", "12", "漢字", "\x00", "\x85", "😀", "ﬁ", "İ", "\r\n", "é", ", ", "<0x0A>", "​"]
    texts = [None, "", " ", "\n", " x", "x ", "▁", "plain words here", "plain words here"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(250)]
    return texts + [" ".join(prose(rng, 60, 50)) for _ in range(20)] + ["x" * 700, " ".join(prose(rng, 400, 50)).replace("w1", "\n")]


@pytest.mark.parametrize("block_docs", [1 << 16, 16])
def test_alignment_equals_brute_force(spark, block_docs, monkeypatch):
    from touchline.llm import alignment
    monkeypatch.setattr(alignment, "BLOCK_DOCS", block_docs)
    monkeypatch.setattr(alignment.inverted_index, "__defaults__", (False, block_docs, alignment.BLOCK_BYTES))
    texts = token_texts()
    docs, pairs = align(frame(spark, texts))
    want, n_docs, n_links = brute_alignment(texts)
    for r in docs.collect():
        assert [r.n_a, r.n_b, r.n_groups, r.n_links, r.groups, r.n_best, r.count_sum] == want[r.doc_id], repr(texts[r.doc_id])
    got = {(r.a, r.b): (r.n_docs, r.n_links) for r in pairs.collect()}
    assert got == {p: (n, n_links[p]) for p, n in n_docs.items()}
    digests = {r.doc_id: r.groups_sha256 for r in align_digest(frame(spark, texts)).collect()}
    assert all(digests[i] == (hashlib.sha256(w[4].encode()).hexdigest() if w[4] else "") for i, w in enumerate(want))


def test_alignment_edges(spark):
    rows = align(frame(spark, ["one", "one", None], ids=[3, 3, None]))[0].collect()
    assert sorted((r.doc_id or -1, r.n_a, r.count_sum) for r in rows) == [(-1, 0, 0), (3, 1, 2), (3, 1, 2)]
    assert align(frame(spark, ["one"]).where("false"))[0].count() == 0


def test_bitmaps_round_trip():
    rng = np.random.default_rng(2)
    pairs = np.repeat(np.arange(6), [1, 3, 900, 2, 1000, 40])
    docs = np.concatenate([np.sort(rng.choice(1000, n, replace=False)) for n in (1, 3, 900, 2, 1000, 40)])
    key, n, bitmap = pack(pairs, docs, 1000)
    row, found = unpack(bitmap)
    assert key.tolist() == list(range(6)) and n.tolist() == [1, 3, 900, 2, 1000, 40]
    assert sorted(zip(row.tolist(), found.tolist())) == sorted(zip(pairs.tolist(), docs.tolist()))


def brute_languages(texts, langs, ids, longest=LONGEST_GRAM):
    letters = re.compile(r"[^\W\d_]+")
    words = [letters.findall((t or "").lower()) for t in texts]
    counts = defaultdict(Counter)
    for ws, lang, i in zip(words, langs, ids):
        if lang is None or i is None or zlib.crc32(str(i).encode()) % 3 == 1:
            continue
        for w in ws:
            counts[lang, 0][w] += 1
            s = f"^{w}$"
            for n in range(1, longest + 1):
                grams = [s[j:j + n] for j in range(len(s) - n + 1)]
                counts[lang, n].update(g for g in grams if n > 1 or g not in "^$")
    names = sorted({lang for lang, _ in counts})
    kinds = {n: sum(len(counts[x, n]) for x in names) for n in range(longest + 1)}

    def value(x, n, g):
        c = counts[x, n]
        return math.log((c[g] + SMOOTHING) / (sum(c.values()) + SMOOTHING * kinds[n]))

    def grams_of(word):
        s = f"^{word}$"
        level = {(j, min(longest, len(s))) for j in range(len(s) - min(longest, len(s)) + 1)}
        out = []
        for n in range(min(longest, len(s)), 0, -1):
            down = set()
            for j, _ in sorted(x for x in level if x[1] == n):
                g = s[j:j + n]
                if n == 1 and g in "^$":
                    continue
                if any(g in counts[x, n] for x in names):
                    out.append((n, g))
                elif n > 1:
                    down |= {(j, n - 1), (j + 1, n - 1)}
            level = down
        return out

    result = []
    for ws in words:
        total = dict.fromkeys(names, 0.0)
        for w in ws:
            parts = [(0, w)] if any(w in counts[x, 0] for x in names) else grams_of(w)
            for n, g in parts:
                for x in names:
                    total[x] += value(x, n, g) / len(parts)
        if not ws or not names:
            result.append((UNKNOWN, 0.0))
            continue
        best = max(names, key=lambda x: (round(total[x], 9), [-ord(c) for c in x]))
        result.append((best, 1 / sum(math.exp(total[x] - total[best]) for x in names)))
    return result


def language_texts():
    rng = random.Random(8)
    sounds = {"aa": ["ba", "do", "ki"], "bb": ["ün", "ach", "ei"], "cc": ["que", "do", "ñi"]}
    texts, langs = [None, "", "12 34 !", "漢字", "ba1do_KI", "ba", "ba"], ["aa", "bb", "cc", "aa", None, "bb", "cc"]
    for _ in range(120):
        lang = rng.choice(sorted(sounds))
        texts.append(" ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randrange(1, 4))).title() for _ in range(rng.randrange(1, 9))))
        langs.append(lang if rng.random() < 0.9 else None)
    return texts, langs


def test_languages_equal_brute_force(spark):
    texts, langs = language_texts()
    ids = [*range(len(texts) - 1), None]
    want = {i: w for i, w in zip(ids, brute_languages(texts, langs, ids))}
    rows = identify_documents(frame(spark, texts, langs, ids)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1], abs=1e-6), texts[r.doc_id or 0]
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_languages_learn_nothing_from_held_out(spark):
    texts, langs = language_texts()
    first = sorted(identify_documents(frame(spark, texts, langs)).collect())
    changed = ["zz" if zlib.crc32(str(i).encode()) % 3 == 1 else x for i, x in enumerate(langs)]
    assert first == sorted(identify_documents(frame(spark, texts, changed)).collect())


def test_languages_edges(spark):
    rows = identify_documents(frame(spark, ["abc", None], [None, None])).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {(UNKNOWN, 0.0)}
    assert identify_documents(frame(spark, ["abc"]).where("false")).count() == 0


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify_documents(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right >= 0.98

"""Operator 13: phrase collocations by SON partitioning.

Shards are mined at a support lowered in proportion to their words, the union of
what is frequent somewhere is counted over all shards, and cut scores are exact
integer arithmetic in decimals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.frames import broadcast_if_small, cut, in_batches
from touchline.llm.words import BASE, BYTE_VALUES, LOWER, byte_view, mix64, span_hashes

#: A phrase of 2 to LONGEST words must occur SUPPORT times in its language.
SUPPORT, LONGEST, TOP = 100, 5, 2000
#: A shard ends once it holds this many words; memory of a task follows it.  Small
#: input partitions are read together up to it, as long as every core has two: the
#: larger a shard, the higher its support and the fewer phrases it reports.
SHARD_WORDS = 8_000_000
#: Bits of a filter for each hash it holds, and its size at most (32 MB).  Beyond
#: that size it lets more through, which costs time; counts stay exact.
FILTER_BITS, MOST_FILTER_BITS = 16, 28
#: Characters that end a piece (fixed values), and white space inside pieces.
PIECE_ENDS, GAPS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
NO_LANG = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_RUN_BYTES = 1 << 21
#: A language's phrases are ranked in so many slices before the last ranking.
SLICES = 64

_IS_END = np.isin(np.arange(256), list(PIECE_ENDS))
_IS_GAP = np.isin(np.arange(256), list(GAPS)) | _IS_END


class Words:
    """Words of the texts of one language: a hash of each word and the language, and
    how many words from each one on lie in its piece (counted up to LONGEST + 1)."""

    def __init__(self, data: np.ndarray, text_at: np.ndarray, seed: np.uint64, spans: bool = False):
        data = LOWER[data]
        gap = _IS_GAP[data]
        first = np.zeros(len(data) + 1, dtype=bool)
        first[text_at] = True
        start, stop = ~gap, ~gap
        start[1:] &= gap[:-1] | first[1:-1]
        stop[:-1] &= gap[1:] | first[1:-1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
        values = BYTE_VALUES[data]
        values[gap] = 0
        self.hashes = mix64(span_hashes(values, starts, ends - starts, BASE) + seed)
        # a piece begins behind a piece's end or a text's border
        piece = np.cumsum(_IS_END[data] | first[:-1])[starts] if len(starts) else np.zeros(0, dtype=np.int64)
        self.room = room_left(piece)
        if spans:
            self.data, self.starts, self.ends = data, starts, ends

    def phrase(self, at: int, n: int) -> str:
        return " ".join(self.data[a:b].tobytes().decode("utf-8", "replace")
                        for a, b in zip(self.starts[at:at + n], self.ends[at:at + n]))


def room_left(piece: np.ndarray) -> np.ndarray:
    """Words from each position to the end of its piece, itself included, up to
    LONGEST + 1."""
    if not len(piece):
        return np.zeros(0, dtype=np.int8)
    last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True))
    left = np.repeat(last + 1, np.diff(np.append(-1, last))) - np.arange(len(piece))
    return np.minimum(left, LONGEST + 1).astype(np.int8)


def lang_seed(lang: str) -> np.uint64:
    raw = lang.encode() + b"\x01"
    return span_hashes(BYTE_VALUES[np.frombuffer(raw, dtype=np.uint8)], np.array([0]), np.array([len(raw)]), BASE)[0]


def phrase_hashes(words: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of each run of ``n`` words inside a piece: a polynomial in the
    words' hashes, so that taking the last word off gives the hash of the rest."""
    at = np.flatnonzero(room >= n)
    h = words[at]
    for j in range(1, n):
        h = h * _STEP + words[at + j]
    return at, h


class Filter:
    """Membership of 64-bit hashes in a broadcast table of bits; nothing held is missed."""

    def __init__(self, bits: Broadcast, n_bits: int):
        self.bits, self.shift = bits, np.uint64(64 - n_bits)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes >> self.shift).astype(np.int64)
        return (self.bits.value[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def make_filter(rows: DataFrame) -> Filter:
    """Filter over the column ``hash``.  Spark sets the bits; the driver gets at most
    2**MOST_FILTER_BITS of them, in pieces of 4 KB."""
    n = rows.count()
    n_bits = min(max((FILTER_BITS * max(n, 1) - 1).bit_length(), 16), MOST_FILTER_BITS)
    slot = F.shiftrightunsigned("hash", 64 - n_bits)
    # position p of bucket b (counted from 1) is the value 32768 * (b - 1) + p + 1
    pieces = rows.select((slot + 1).alias("v")).groupBy(F.bitmap_bucket_number("v").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits")).collect()
    bits = np.zeros(1 << (n_bits - 3), dtype=np.uint8)
    for p in pieces:
        raw = np.frombuffer(bytes(p["bits"]), dtype=np.uint8)
        lo = (p["b"] - 1) * 4096
        bits[lo:lo + 4096] = raw[:len(bits) - lo]
    return Filter(rows.sparkSession.sparkContext.broadcast(bits), n_bits)


def _runs(batches, spans: bool = False) -> Iterator[tuple[str, Words]]:
    """The words of a task's documents, a language and some whole texts at a time."""
    seeds: dict[str, np.uint64] = {}
    for batch in batches:
        langs = np.array(batch.column(1).fill_null(NO_LANG).to_pylist(), dtype=object)
        raw, offsets = byte_view(batch.column(0))
        sizes = np.diff(offsets)
        for lang in dict.fromkeys(langs):
            seed = seeds.setdefault(lang, lang_seed(lang))
            rows = np.flatnonzero(langs == lang)
            part = np.cumsum(sizes[rows]) // _RUN_BYTES
            for mine in np.split(rows, np.flatnonzero(np.diff(part)) + 1):
                data = np.concatenate([raw[offsets[r]:offsets[r + 1]] for r in mine])
                yield lang, Words(data, np.append(0, np.cumsum(sizes[mine])), seed, spans)


def _shards(batches, shard_words: int) -> Iterator[dict[str, list[Words]]]:
    """A task's documents in shards of whole texts: for each language, its runs."""
    shard: dict[str, list[Words]] = {}
    held = 0
    for lang, words in _runs(batches):
        shard.setdefault(lang, []).append(words)
        held += len(words.hashes)
        if held >= shard_words:
            yield shard
            shard, held = {}, 0
    if shard:
        yield shard


def _counted(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(different hashes in order, occurrences)."""
    every = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    every.sort()
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[:len(every)])
    return every[first], np.diff(np.append(first, len(every)))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if getattr(c, "dtype", None) == np.uint64 else c)
                                       for c in columns.values()], names=list(columns))


def word_counts(rows: DataFrame, shard_words: int) -> DataFrame:
    """(lang, hash, n): ``lang`` is set on one row a language, its number of words;
    the other rows count words."""
    def run(batches):
        for shard in _shards(batches, shard_words):
            for lang, parts in shard.items():
                hashes, counts = _counted([w.hashes for w in parts])
                yield _batch(lang=pa.array([lang] + [None] * len(hashes), pa.string()),
                             hash=np.append(np.uint64(0), hashes), n=np.append(counts.sum(), counts))

    return in_batches(rows, run, "lang string, hash long, n long").groupBy("lang", "hash").agg(F.sum("n").alias("n"))


def _open_runs(w: Words, words: Filter, pairs: Filter | None) -> np.ndarray:
    """Room of each word when pieces are also cut at words, and at pairs, that are
    not frequent: no frequent phrase reaches across such a place."""
    if not len(w.hashes):
        return w.room
    usable = words(w.hashes)
    joined = np.zeros(len(usable), dtype=bool)
    at, pair = phrase_hashes(w.hashes, w.room, 2)
    joined[at] = (usable[at] & usable[at + 1]) if pairs is None else pairs(pair)
    return room_left(np.append(0, np.cumsum(~joined[:-1]))) * usable


def mine(rows: DataFrame, sizes: tuple[int, ...], total: dict[str, int], words: Filter, pairs: Filter | None,
         support: int, shard_words: int) -> DataFrame:
    """Hashes of the phrases that may be frequent, from shards mined one by one.

    A shard with a share s of a language's words mines the phrases that occur
    ``least = ceil(support * s)`` times in it; whoever reaches ``support`` in all
    reaches that in one shard at least.  Larger sizes extend locally frequent
    smaller ones only.  A shard that does not report a phrase holds it ``least - 1``
    times at most, so the reported counts and those bounds add up to an upper bound
    of the phrase's count; what stays below the support is dropped.
    """
    codes = {lang: i for i, lang in enumerate(sorted(total))}

    def run(batches):
        for shard in _shards(batches, shard_words):
            for lang, parts in shard.items():
                if lang not in total:
                    continue
                n = sum(len(w.hashes) for w in parts)
                least = max(-(-support * n // total[lang]), 1)
                yield _batch(code=[codes[lang]], hash=pa.array([None], pa.int64()), n=[least - 1])
                rooms = [_open_runs(w, words, pairs) for w in parts]
                for size in sizes:
                    hashes, counts = _counted([phrase_hashes(w.hashes, room, size)[1] for w, room in zip(parts, rooms)])
                    keep = counts >= least
                    hashes, counts = hashes[keep], counts[keep]
                    yield _batch(code=np.full(len(hashes), codes[lang]), hash=hashes, n=counts - (least - 1))
                    if least > 1 and size < sizes[-1]:  # longer ones start and end with a frequent one
                        for i, w in enumerate(parts):
                            at, h = phrase_hashes(w.hashes, rooms[i], size)
                            spot = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                            good = np.zeros(len(rooms[i]) + 1, dtype=bool)
                            good[at] = hashes[spot] == h if len(hashes) else False
                            rooms[i] = np.where(good[:-1] & good[1:], rooms[i], np.minimum(rooms[i], size))

    found = cut(in_batches(rows, run, "code long, hash long, n long").groupBy("code", "hash").agg(F.sum("n").alias("n")), narrow=True)
    unseen = found.where("hash is null").select("code", F.col("n").alias("unseen"))
    return found.where("hash is not null").join(F.broadcast(unseen), "code").where(F.col("n") + F.col("unseen") >= support).select("hash")


def count(rows: DataFrame, sizes: tuple[int, ...], total: dict[str, int], words: Filter, pairs: Filter | None,
          candidates: Filter, shard_words: int) -> DataFrame:
    """(hash, code, size, last, n): occurrences in all documents of the phrases that
    pass the filter, with the language's number and the last word's hash."""
    codes = {lang: i for i, lang in enumerate(sorted(total))}

    def run(batches):
        for shard in _shards(batches, shard_words):
            for lang, parts in shard.items():
                if lang not in total:
                    continue
                rooms = [_open_runs(w, words, pairs) for w in parts]
                for size in sizes:
                    found = []
                    for w, room in zip(parts, rooms):
                        at, h = phrase_hashes(w.hashes, room, size)
                        some = candidates(h)
                        found.append((h[some], w.hashes[at[some] + size - 1]))
                    every, last = (np.concatenate(x) for x in zip(*found))
                    hashes, one, n = np.unique(every, return_index=True, return_counts=True)
                    yield _batch(hash=hashes, code=np.full(len(n), codes[lang]), size=np.full(len(n), size), last=last[one], n=n)

    return in_batches(rows, run, "hash long, code long, size long, last long, n long").groupBy("hash").agg(
        *(F.min(c).alias(c) for c in ("code", "size", "last")), F.sum("n").alias("n"))


def spell(rows: DataFrame, wanted: DataFrame, words: Filter, pairs: Filter) -> DataFrame:
    """(hash, phrase) of the hashes wanted; a task tells each one once."""
    wanted_filter = make_filter(wanted)

    def run(batches):
        seen: set[int] = set()
        for _, w in _runs(batches, spans=True):
            room = _open_runs(w, words, pairs)
            out: list[tuple[int, str]] = []
            for size in range(2, LONGEST + 1):
                at, hashes = phrase_hashes(w.hashes, room, size)
                some = np.flatnonzero(wanted_filter(hashes))
                new, first = np.unique(hashes[some], return_index=True)
                out += [(h, w.phrase(i, size)) for h, i in zip(new.view(np.int64).tolist(), at[some[first]].tolist()) if h not in seen]
            seen.update(h for h, _ in out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in out], pa.int64()), pa.array([p for _, p in out], pa.string())],
                                                 names=["hash", "phrase"])

    spelled = in_batches(rows, run, "hash long, phrase string").join(broadcast_if_small(wanted), "hash")
    return spelled.groupBy("hash").agg(F.min("phrase").alias("phrase"))


def _with_prefix(found: DataFrame) -> DataFrame:
    """``prefix``: the hash of a phrase without its last word."""
    back = np.uint64(pow(int(_STEP), -1, 1 << 64))

    def run(batches):
        for batch in batches:
            hashes, last = (batch.column(batch.schema.get_field_index(c)).to_numpy().view(np.uint64) for c in ("hash", "last"))
            yield batch.append_column("prefix", pa.array(((hashes - last) * back).view(np.int64)))

    return in_batches(found, run, "hash long, code long, size long, last long, n long, prefix long")


def _cuts(phrases: DataFrame) -> DataFrame:
    """One row for each place between two words: hashes of the two parts."""
    def run(batches):
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                words = part.column(4).flatten().to_numpy().view(np.uint64).reshape(-1, size)
                for k in range(1, size):
                    left, right = words[:, 0], words[:, k]
                    for j in range(1, k):
                        left = left * _STEP + words[:, j]
                    for j in range(k + 1, size):
                        right = right * _STEP + words[:, j]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(i) for i in range(4)), pa.array(np.full(len(words), k)),
                         pa.array(left.view(np.int64)), pa.array(right.view(np.int64))],
                        names=["hash", "code", "a", "size", "k", "left", "right"])

    return in_batches(phrases.select("hash", "code", F.col("n").alias("a"), "size", "words"), run,
                      "hash long, code long, a long, size long, k long, left long, right long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, top: int = TOP,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    Texts are lower-cased in A-Z, split into pieces at ``. , ; : ! ?`` and line
    ends, and pieces into words at spaces and tabs.  A phrase of 2 to 5 words with
    a >= support occurrences is cut into two parts where floor(1000 * a * n /
    (l * r)) is least (ties: the earliest cut); products are exact decimals of 38
    digits, an overflow fails the job rather than wrap.  A phrase goes if a longer
    phrase that contains it occurs as often; one word more decides that, as every
    phrase between the two occurs as often too.  Order: score, a, then the phrase
    in byte order.

    1. Words are counted; words below the support cut pieces in two.
    2. Pairs: mined shard by shard, their union counted over all shards.
    3. Three to five words: the same, in the stretches of frequent pairs.
    4. Parts are found by hash; only phrases that may be among the first are spelled.

    Null text is empty, null lang is ``und``.  Repeated rows count each.  An empty
    table, and a language below the support, give no rows.  Other columns, whatever
    their names, are not carried.  Phrases are told apart by 64-bit hashes.
    """
    rows = docs.select(F.col(text).alias("__text"), F.col(lang).cast("string").alias("__lang"))
    single = cut(word_counts(rows, shard_words).where(F.col("lang").isNotNull() | (F.col("n") >= support)), narrow=True)
    words = single.where("lang is null").select("hash", "n")
    # a language with fewer words than the support has no phrases
    total = {r["lang"]: r["n"] for r in single.where(F.col("lang").isNotNull() & (F.col("n") >= support)).collect()}
    n_words = sum(total.values())
    rows = rows.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-n_words // shard_words)))
    word_filter, pair_filter, levels = make_filter(words), None, []
    for sizes in ((2,), tuple(range(3, LONGEST + 1))):
        local = make_filter(cut(mine(rows, sizes, total, word_filter, pair_filter, support, shard_words), narrow=True))
        levels.append(cut(count(rows, sizes, total, word_filter, pair_filter, local, shard_words).where(F.col("n") >= support), narrow=True))
        pair_filter = pair_filter or make_filter(levels[0])
    found = levels[0].unionByName(levels[1])
    prefixed = _with_prefix(found)
    known = prefixed.where("size = 2").select("hash", "code", "n", "size", F.array("prefix", "last").alias("words"))
    phrases = known
    for size in range(3, LONGEST + 1):  # the words of a phrase: those of its prefix and the last one
        known = prefixed.where(F.col("size") == size).join(
            known.select(F.col("hash").alias("prefix"), F.col("words").alias("before")), "prefix").select(
            "hash", "code", "n", "size", F.concat("before", F.array("last")).alias("words"))
        phrases = phrases.unionByName(known)
    cuts = cut(_cuts(phrases), narrow=True)
    counts = words.unionByName(found.select("hash", "n"))
    n_counts = counts.count()
    parted = cuts
    for side, name in (("left", "l"), ("right", "r")):
        parted = parted.join(broadcast_if_small(counts.toDF(side, name), rows=n_counts), side)
    langs = docs.sparkSession.createDataFrame([(i, x, total[x]) for i, x in enumerate(sorted(total))], "code long, lang string, n long")
    parted = parted.join(F.broadcast(langs), "code")
    score = F.expr("cast((cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r) as long)")
    best = parted.withColumn("score", score).groupBy("lang", "hash", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # the two phrases one word shorter inside each longer one
    inner = cuts.where("size > 2 and k = 1").select(F.col("right").alias("hash"), "a").union(
        cuts.where("size > 2 and k = size - 1").select("left", "a"))
    covered = inner.groupBy("hash").agg(F.max("a").alias("whole"))
    left = best.join(covered, "hash", "left").where("whole is null or whole < a").select(
        "lang", "hash", "a", "b.l", "b.r", "n", "b.score", (F.xxhash64("hash") % SLICES).alias("slice"))
    order = [F.desc("score"), F.desc("a")]
    for keys in (["lang", "slice"], ["lang"]):  # the best of each slice, then of those; ties stay
        left = left.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    left = cut(left.drop("rank", "slice"), narrow=True)
    ranked = left.join(spell(rows, left.select("hash"), word_filter, pair_filter), "hash").withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of ``collocations`` over ``{docs}``.
COLLOCATION_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) as piece
  from {docs}),
spans as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
totals as (select lang, sum(len(w)) as n from spans group by lang),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from spans),
grams as (select lang, w, i, unnest(range(1, 6)) as m from starts),
counts as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as a
  from grams where i + m - 1 <= len(w) group by all having count(*) >= {support}),
cuts as (
  select c.lang, c.phrase, c.m, c.a, k, string_split(c.phrase, ' ') as w
  from counts c, range(1, 5) t(k) where c.m > 1 and k < c.m),
scored as (
  select c.lang, c.phrase, c.m, c.a, c.k, x.a as l, y.a as r, t.n,
         (1000::hugeint * c.a * t.n) // (x.a::hugeint * y.a) as score
  from cuts c join counts x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ')
  join counts y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:], ' ')
  join totals t on t.lang = c.lang),
best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
  select lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:m - 1], ' '),
                          array_to_string(string_split(phrase, ' ')[2:], ' ')]) as phrase
  from counts where m > 2),
remaining as (
  select b.* from best b where not exists (
    select 1 from longer x where x.lang = b.lang and x.phrase = b.phrase and 100 * x.a >= 100 * b.a))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a,
       l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from remaining qualify rank <= {top}
"""

"""Operator 12: language identification, words first, then shorter and shorter n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.frames import cut, in_batches, per_batch
from touchline.llm.words import mix64

#: Lengths of the character n-grams that stand in for unseen words.
LONGEST_GRAM = 5
#: A word or n-gram is known if it makes up at least this share of the words (of the
#: n-grams of its length) of some language; so a language knows at most
#: 1 / MIN_SHARE of each kind, whatever the size of the corpus.  With many languages
#: the share rises so that no more than MOST_KNOWN entries are known in all.
MIN_SHARE, MOST_KNOWN = 4e-6, 8_000_000
SMOOTHING = 0.5
UNKNOWN = "und"
#: Documents whose crc32(id) has this remainder modulo 3 are held out.
HELD_OUT = 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_RUN_CHARS = 1 << 19
_BORDER = 0x110000


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Of every code point: 2 a letter, 1 a mark inside a word, 0 anything else."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(_BORDER)] + [0], dtype=np.uint8)


class Words:
    """Words of a run of texts: maximal runs of letters and marks with a letter in
    them, lower-cased; ``text`` is the text of each word."""

    def __init__(self, texts: list[str | None]):
        lowered = [(t or "").lower() for t in texts]
        self.n = len(texts)
        codes = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = letter_table()[codes]
        inside = kind > 0
        edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        letters = np.append(0, np.cumsum(kind == 2))
        some = letters[ends] > letters[starts]
        starts, ends = starts[some], ends[some]
        text_ends = np.cumsum([len(t) + 1 for t in lowered])
        self.text = np.searchsorted(text_ends, starts, side="right")
        self.codes, self.starts, self.sizes = codes, starts, ends - starts

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """(code points, start of each word): words in a row, a border sign before
        and after each one."""
        n = self.sizes + 2
        at = np.append(0, np.cumsum(n))
        pick = np.arange(at[-1]) + np.repeat(self.starts - 1 - at[:-1], n)
        signs = self.codes[np.clip(pick, 0, max(len(self.codes) - 1, 0))].astype(np.uint64)
        signs[at[:-1]] = signs[at[1:] - 1] = _BORDER
        return signs, at


def sign_hashes(signs: np.ndarray) -> np.ndarray:
    return mix64(signs + np.uint64(0x632BE59BD9B4E019))


def word_hashes(signs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Order 0: a hash of each whole word."""
    if len(at) < 2:
        return np.zeros(0, dtype=np.uint64)
    place = np.arange(len(signs), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
    return mix64(np.add.reduceat(mix64(sign_hashes(signs) + place * _STEP), at[:-1]))


def gram_hashes(hashed: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` signs from each place on, order n."""
    out = hashed[:max(len(hashed) - n + 1, 0)].copy()
    for j in range(1, n):
        out = out * _STEP + hashed[j:j + len(out)]
    return mix64(out + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def inner_grams(at: np.ndarray, n: int, total: int) -> np.ndarray:
    """Whether an n-gram from each place on lies inside one word and its borders;
    the borders are not n-grams of one sign."""
    left = np.repeat(at[1:], np.diff(at)) - np.arange(total)
    good = left >= n
    if n == 1:
        good &= left > 1
        good[at[:-1]] = False
    return good


def _runs(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of whole texts."""
    lo = held = 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= _RUN_CHARS:
            yield lo, texts[lo:i + 1]
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def remainder(key: Column) -> Column:
    """crc32 of the id as text modulo 3; null without an id."""
    return F.crc32(key.cast("string").cast("binary")) % 3


def learned_counts(docs: DataFrame, text: str, lang: str, longest: int = LONGEST_GRAM) -> DataFrame:
    """(lang, size, hash, n): occurrences of each word (size 0) and n-gram in the
    documents of each language.  A task sums a run of texts before the shuffle."""
    rows = docs.select(F.col(text).alias("__text"), F.col(lang).cast("string").alias("__lang"))

    def count_run(words: Words, lang_of: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        signs, at = words.spelled()
        hashes = word_hashes(signs, at)
        # each different (language, word) once, with its count; then its n-grams
        keys = mix64(hashes + mix64(lang_of[words.text].astype(np.uint64)))
        _, first, n = np.unique(keys, return_index=True, return_counts=True)
        yield 0, lang_of[words.text[first]], hashes[first], n
        small = Words.__new__(Words)
        small.codes, small.starts, small.sizes = words.codes, words.starts[first], words.sizes[first]
        signs, at = small.spelled()
        hashed = sign_hashes(signs)
        owner = np.repeat(np.arange(len(first)), np.diff(at))
        for size in range(1, longest + 1):
            some = np.flatnonzero(inner_grams(at, size, len(signs)))
            grams = gram_hashes(hashed, size)[some]
            code = lang_of[words.text[first[owner[some]]]]
            keys = mix64(grams + mix64(code.astype(np.uint64)))
            _, one, back = np.unique(keys, return_index=True, return_inverse=True)
            yield size, code[one], grams[one], np.bincount(back, weights=n[owner[some]]).astype(np.int64)

    def run(batches):
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, texts in _runs(batch.column(0).to_pylist()):
                words = Words(texts)
                names = sorted(set(langs[lo:lo + len(texts)]))
                lang_of = np.searchsorted(np.array(names, dtype=object), np.array(langs[lo:lo + len(texts)], dtype=object))
                if not len(words.starts):
                    continue
                for size, code, hashes, n in count_run(words, lang_of):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names, pa.string()).take(pa.array(code)), pa.array(np.full(len(n), size, dtype=np.int32)),
                         pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "size", "hash", "n"])

    counts = in_batches(rows.where("__lang is not null"), run, "lang string, size int, hash long, n long")
    return counts.groupBy("lang", "size", "hash").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Log frequencies of what is known, one table for each size (0: words): sorted
    hashes, and for each the languages that know it with what they add to
    ``floor``, the value of a language that does not."""
    langs: list[str]
    floor: dict[int, np.ndarray]
    known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def lookup(self, size: int, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where it is not known."""
        table = self.known[size][0]
        spot = np.searchsorted(table, hashes)
        spot[spot == len(table)] = 0
        found = table[spot] == hashes if len(table) else np.zeros(len(hashes), dtype=bool)
        return np.where(found, spot, -1)

    def add(self, total: np.ndarray, size: int, row: np.ndarray, text: np.ndarray, weight: np.ndarray) -> None:
        """Adds the weighted log frequencies of the rows to their texts."""
        _, at, lang, gain = self.known[size]
        n = at[row + 1] - at[row]
        ends = np.cumsum(n)
        pick = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[row] - (ends - n), n)
        width = len(self.langs)
        total += np.bincount(np.repeat(text, n) * width + lang[pick], weights=gain[pick] * np.repeat(weight, n),
                             minlength=total.size).reshape(total.shape)
        total += np.bincount(text, weights=weight, minlength=len(total))[:, None] * self.floor[size]


def fit(counts: DataFrame, longest: int = LONGEST_GRAM, min_share: float = MIN_SHARE) -> Model:
    """The known words and n-grams come to the driver: at most 1 / min_share of each
    size a language and MOST_KNOWN in all, 14 bytes each."""
    totals = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    sums = {(r["lang"], r["size"]): (r["total"], r["kinds"]) for r in totals.collect()}
    langs = sorted({lang for lang, _ in sums})
    min_share = max(min_share, len(sums) / MOST_KNOWN)
    known = counts.join(F.broadcast(totals.select("lang", "size", "total")), ["lang", "size"]).where(
        F.col("n") >= min_share * F.col("total"))
    codes = F.create_map(*(x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i)))) if langs else F.lit(None)
    table = known.select("size", "hash", (codes[F.col("lang")] if langs else F.lit(0)).cast("short").alias("lang"), "n").toArrow() \
        if langs else None
    floor, tables = {}, {}
    for size in range(longest + 1):
        part = table.filter(pa.compute.equal(table["size"], size)) if langs else None
        empty = np.zeros(0, dtype=np.int64)
        hashes, lang, n = (part[c].to_numpy() for c in ("hash", "lang", "n")) if langs else (empty, empty, empty)
        order = np.lexsort((lang, hashes.view(np.uint64)))
        hashes, lang, n = hashes[order].view(np.uint64), lang[order].astype(np.int64), n[order]
        size_sums = np.array([sums.get((x, size), (0, 0)) for x in langs], dtype=float).reshape(-1, 2)
        kinds = max(size_sums[:, 1].sum(), 1) if langs else 1
        below = size_sums[:, 0] + SMOOTHING * kinds
        floor[size] = np.log(SMOOTHING / below)
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])[:len(hashes)])
        gain = np.log((n + SMOOTHING) / SMOOTHING).astype(np.float32)
        tables[size] = (hashes[first], np.append(first, len(hashes)), lang.astype(np.int16), gain)
    return Model(langs, floor, tables)


def scores(model: Model, words: Words, longest: int = LONGEST_GRAM) -> np.ndarray:
    """Summed log frequencies of each text and language.

    A known word adds its log frequency.  An unseen word adds the mean over what
    stands for it: its n-grams of the longest size, an unknown one giving way to
    the two n-grams one sign shorter inside it, down to single characters.
    """
    total = np.zeros((words.n, len(model.langs)))
    if not len(words.starts):
        return total
    signs, at = words.spelled()
    row = model.lookup(0, word_hashes(signs, at))
    seen = np.flatnonzero(row >= 0)
    model.add(total, 0, row[seen], words.text[seen], np.ones(len(seen)))
    unseen = Words.__new__(Words)
    left = np.flatnonzero(row < 0)
    unseen.codes, unseen.starts, unseen.sizes = words.codes, words.starts[left], words.sizes[left]
    signs, at = unseen.spelled()
    if not len(left):
        return total
    hashed = sign_hashes(signs)
    owner = np.repeat(np.arange(len(left)), np.diff(at))
    lengths = np.diff(at)
    # a word with its borders that is shorter than an n-gram starts at its own size
    wanted = np.zeros(len(signs), dtype=bool)
    used: list[tuple[int, np.ndarray, np.ndarray]] = []
    for size in range(longest, 0, -1):
        starts_here = (lengths >= size) if size == longest else (lengths == size)
        inner = inner_grams(at, size, len(signs))
        wanted |= np.repeat(starts_here, lengths)
        place = np.flatnonzero(wanted & inner)
        grams = gram_hashes(hashed, size)[place]
        found = model.lookup(size, grams)
        good = found >= 0
        used.append((size, found[good], owner[place[good]]))
        wanted = np.zeros(len(signs) + 1, dtype=bool)
        wanted[place[~good]] = True
        wanted[place[~good] + 1] = True
        wanted = wanted[:-1]
    parts = np.bincount(np.concatenate([o for _, _, o in used]), minlength=len(left))
    for size, found, of in used:
        model.add(total, size, found, words.text[left[of]], 1.0 / parts[of])
    return total


def identify(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ("doc_id",),
             longest: int = LONGEST_GRAM) -> DataFrame:
    """The columns ``carry``, ``lang_pred`` and ``score``: the language of the
    highest summed log frequency (ties: the first by name) and its share among the
    languages, all equally likely beforehand.  No shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in carry), "lang_pred string", "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        model = shared.value
        for lo, texts in _runs(batch.column(0).to_pylist()):
            words = Words(texts)
            has_words = np.bincount(words.text, minlength=words.n) > 0
            part = batch.slice(lo, len(texts))
            if model.langs:
                total = np.round(scores(model, words, longest), 9)
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                pred = [model.langs[b] if h else UNKNOWN for b, h in zip(best, has_words)]
            else:
                share, pred = np.zeros(words.n), [UNKNOWN] * words.n
            yield {c: part.column(i + 1) for i, c in enumerate(carry)} | {
                "lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.round(np.where(has_words, share, 0.0), 9))}

    return per_batch(docs.select(F.col(text).alias("__text"), *carry), schema, make)


def identify_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score), one row a document.

    Learned from text and language of every document that names one, save those
    held out (crc32 of the id as text leaves 1 modulo 3) and those without an id.
    Predictions see the text alone.  Text without a letter, or null: ``und``, score
    0; so does every text when nothing is learned.  A text of unknown characters
    only gives the first language by name, at an equal share.  Repeated rows get
    equal rows; an empty table gives none; other columns are not carried.
    """
    train = docs.where(F.coalesce(remainder(F.col(key)) != HELD_OUT, F.lit(False)))
    model = fit(cut(learned_counts(train, text, lang), narrow=True))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"),
                       F.coalesce(remainder(F.col(key)) == HELD_OUT, F.lit(False)).alias("held_out"))
    return identify(rows, model, carry=("key", "held_out")).withColumnRenamed("key", key)

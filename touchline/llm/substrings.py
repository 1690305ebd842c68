"""Operator 8: repeated passages by seed and extend."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.frames import BROADCAST_ROWS, broadcast_if_small, cut, kept, per_batch, stored
from touchline.llm.words import WORD_BASE, Powers, Texts, mix64, runs, window_hashes

#: A repeat has at least SPAN words; anchors are SEED_WORDS-grams, so that winnowing
#: over SPAN - SEED_WORDS + 1 of them leaves one inside every window of SPAN words.
SPAN, SEED_WORDS = 35, 8


def rightmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of ``values[i : i + width]`` (the last one of
    equals) for every i, by doubling."""
    best, at, size = values, np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        left, right = best[:-step], best[step:]
        take = right <= left
        best = np.where(take, right, left)
        at = np.where(take, at[step:], at[:-step])
        size += step
    return at


def seeds(texts: Texts, words: np.ndarray, span: int = SPAN, width: int = SEED_WORDS):
    """The winnowed anchors of a run of texts and the windows each stands for.

    Every window of ``span`` words has one anchor, its smallest ``width``-gram; a
    run of windows with the same anchor is a segment.  Returns arrays (first
    window, number of windows, anchor hash, hash of the segment's words and of the
    anchor's place in it).
    """
    grams = window_hashes(words, width, WORD_BASE)
    end = np.repeat(texts.word_at[1:], texts.n_words)
    n = len(words) - span + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    anchor = rightmost_minimum(grams, span - width + 1)[:n]
    window = np.flatnonzero(np.arange(n) + span <= end[:n])
    anchor = anchor[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(window) != 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(window)))
    lo, anchor = window[first], anchor[first]
    powers = Powers(WORD_BASE ^ 0x5DEECE66A, len(words) + 1)
    scaled, total = words.copy(), np.zeros(len(words) + 1, dtype=np.uint64)
    powers.scale(scaled)
    np.cumsum(scaled, out=total[1:])
    content = (total[lo + count + span - 1] - total[lo]) * powers.inverse(lo)
    place = ((anchor - lo) * 64 + count).astype(np.uint64)
    return lo, count, grams[anchor], mix64(content + mix64(place))


def _row_key(docs: DataFrame, key: str, text: str) -> Column:
    """Names a row by key and text; repeated rows share a name and a result."""
    return F.xxhash64(docs[key], F.coalesce(docs[text], F.lit("")), F.lit(8))


def _anchors(rows: DataFrame, span: int) -> DataFrame:
    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        names = batch.column(0).to_numpy()
        for texts in runs(batch.column(1)):
            lo, count, seed, content = seeds(texts, texts.word_hashes(), span)
            text = np.searchsorted(texts.word_at, lo, side="right") - 1
            yield {"row": pa.array(names[texts.row0 + text]), "lo": pa.array((lo - texts.word_at[text]).astype(np.int32)),
                   "n": pa.array(count.astype(np.int32)), "seed": pa.array(seed.view(np.int64)),
                   "content": pa.array(content.view(np.int64))}

    return per_batch(rows, "row long, lo int, n int, seed long, content long", make)


def _with_marks(rows: DataFrame, marks: DataFrame, keep_rest: bool) -> DataFrame:
    """``rows`` (row, text) with each row's list of marks.  Only rows that have
    some are shuffled when their names' counted number allows a broadcast."""
    marks = cut(marks, narrow=True)
    names = marks.select("row")
    if names.count() > BROADCAST_ROWS:
        return rows.join(marks, "row", "left" if keep_rest else "inner")
    some = rows.join(F.broadcast(names), "row", "left_semi").join(marks.hint("merge"), "row")
    if not keep_rest:
        return some
    rest = rows.join(F.broadcast(names), "row", "left_anti")
    return some.unionByName(rest, allowMissingColumns=True)


def _extend(rows: DataFrame, segments: DataFrame, span: int) -> DataFrame:
    """(row, at, window): anchors extended both ways, one hash for each window of
    the listed segments."""
    listed = segments.groupBy("row").agg(F.collect_set(F.struct("lo", "n", "seed")).alias("marks"))

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        names = batch.column(0).to_numpy()
        marks = batch.column(2)
        for texts in runs(batch.column(1)):
            part = marks.slice(texts.row0, texts.n)
            text = np.repeat(np.arange(texts.n), part.value_lengths().to_numpy(zero_copy_only=False))
            flat = part.flatten()
            lo, n, seed = (flat.field(f).to_numpy() for f in ("lo", "n", "seed"))
            windows = window_hashes(texts.word_hashes(), span, WORD_BASE)
            first = texts.word_at[text] + lo
            total = np.append(0, np.cumsum(n))
            at = np.arange(total[-1]) + np.repeat(first - total[:-1], n)
            hashes = mix64(windows[at] ^ mix64(np.repeat(seed.view(np.uint64), n)))
            owner = np.repeat(text, n)
            yield {"row": pa.array(names[texts.row0 + owner]), "at": pa.array((at - texts.word_at[owner]).astype(np.int32)),
                   "window": pa.array(hashes.view(np.int64))}

    return per_batch(_with_marks(rows, listed, keep_rest=False).select("row", "text", "marks"),
                     "row long, at int, window long", make, rows=256)


def _covered(rows: DataFrame, span: int) -> DataFrame:
    """(row, lo, n): runs of windows whose words start elsewhere too."""
    counts = _anchors(rows, span).groupBy("seed").agg(
        F.count("*").alias("c"), F.min("content").alias("a"), F.max("content").alias("b"))
    repeated = cut(counts.where("c > 1").select("seed", (F.col("a") < F.col("b")).alias("mixed")), narrow=True)
    found = _anchors(rows, span).join(repeated, "seed")
    found = stored(found.select("row", "lo", "n", "mixed", F.when(F.col("mixed"), F.col("seed")).alias("seed"),
                                F.when(F.col("mixed"), F.col("content")).alias("content")), "anchors")
    mixed = found.where("mixed")
    classes = kept(mixed.groupBy("seed", "content").agg(F.count("*").alias("c"), F.min(F.struct("row", "lo", "n")).alias("one")))
    ones = classes.select("one.row", "one.lo", "one.n", "seed")
    windows = stored(_extend(rows, ones, span), "windows")
    again = kept(windows.groupBy("window").agg(F.count("*").alias("c")).where("c > 1").select("window"))
    partly = windows.join(broadcast_if_small(again), "window").select("row", F.col("at").alias("lo"), F.lit(1).alias("n"))
    several = broadcast_if_small(classes.where("c > 1").select("seed", "content"))
    whole = mixed.join(several, ["seed", "content"], "left_semi")
    return found.where("not mixed").select("row", "lo", "n").union(whole.select("row", "lo", "n")).union(partly)


def _marked(docs: DataFrame, key: str, text: str, span: int) -> DataFrame:
    rows = docs.select(_row_key(docs, key, text).alias("row"), F.col(text).alias("text"))
    covered = _covered(rows, span).groupBy("row").agg(F.collect_set(F.struct("lo", "n")).alias("marks"))
    return _with_marks(docs.select(_row_key(docs, key, text).alias("row"), F.col(key).alias("key"), F.col(text).alias("text")),
                       covered, keep_rest=True).select("key", "text", "marks")


def _removed(texts: Texts, marks: pa.Array, span: int) -> np.ndarray:
    """Which words of the run are covered by a marked window."""
    text = np.repeat(np.arange(texts.n), np.nan_to_num(marks.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    flat = marks.flatten()
    step = np.zeros(len(texts.starts) + 1, dtype=np.int64)
    lo = texts.word_at[text] + flat.field("lo").to_numpy()
    np.add.at(step, lo, 1)
    np.add.at(step, lo + flat.field("n").to_numpy() + span - 1, -1)
    return np.cumsum(step)[:-1] > 0


def _join_words(texts: Texts, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the texts): kept words, each followed by one space."""
    starts, lengths = texts.starts[keep], (texts.ends - texts.starts)[keep] + 1
    total = np.append(0, np.cumsum(lengths))
    at = np.arange(total[-1]) + np.repeat(starts - total[:-1], lengths)
    out = texts.data[np.minimum(at, max(len(texts.data) - 1, 0))] if len(at) else np.zeros(0, dtype=np.uint8)
    out[total[1:] - 1] = 32
    kept_at = np.append(0, np.cumsum(keep))[texts.word_at]
    return out, total[kept_at]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN,
                   digest: bool = False) -> DataFrame:
    """Per row of ``docs``: ``key``, ``n_words``, ``n_removed`` and the words left
    (``kept_text``, joined by single spaces; with ``digest`` their SHA-256).

    A word goes if a window of ``span`` words that covers it also starts anywhere
    else in ``docs``, the same text included; all copies go.

    1. Seed: winnowing gives each window one anchor; a run of windows with the same
       anchor is a segment.  Anchors seen once cannot be repeats and go no further.
    2. Where all segments of an anchor read alike, all their windows are repeats.
    3. Extend: for other anchors, segments that read alike form a class; a class of
       two or more is repeated whole, and one member of each class is extended both
       ways over all its windows, which are matched across classes.  Pairs are never
       listed, so an anchor in many documents costs its classes, not their square.
    4. Repeated windows of a text are merged into maximal repeats and cut out.

    Null and empty texts have no words.  Repeated rows repeat each other's passages.
    An empty table gives no rows; other columns are not carried; a null key stays.
    """
    kind = dict(docs.dtypes)[key]
    last = "kept_sha256 string" if digest else "kept_text string"

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for texts in runs(batch.column(1)):
            gone = _removed(texts, batch.column(2).slice(texts.row0, texts.n), span)
            out, at = _join_words(texts, ~gone)
            raw = out.tobytes()
            pieces = [raw[at[i]:max(at[i], at[i + 1] - 1)] for i in range(texts.n)]
            counts = np.append(0, np.cumsum(gone))[texts.word_at]
            yield {key: batch.column(0).slice(texts.row0, texts.n), "n_words": pa.array(texts.n_words.astype(np.int64)),
                   "n_removed": pa.array(np.diff(counts).astype(np.int64)),
                   last.split()[0]: pa.array([hashlib.sha256(p).hexdigest() if digest else p.decode() for p in pieces], pa.string())}

    return per_batch(_marked(docs, key, text, span), f"{key} {kind}, n_words long, n_removed long, {last}", make)

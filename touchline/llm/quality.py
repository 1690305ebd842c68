"""Operator 2: quality rules and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.frames import broadcast_if_small, cut, in_batches, per_batch
from touchline.llm.words import BASE, BYTE_VALUES, IS_SPACE, LOWER, Texts, mix64, runs, span_hashes, window_hashes

#: Hash buckets of the two multinomials (unigrams and bigrams share them), and
#: the count added to each.  The model is two numbers a bucket at any input size.
BUCKETS = 1 << 15
SMOOTHING = 1.0
#: Documents whose mean log ratio is below this go.
THRESHOLD = -0.25
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Characters counted as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
_PAIR_BASE = 0x9FB21C651E98DF25


def _class_table() -> np.ndarray:
    """Byte classes of the n-gram tokens: 0 white space, 1 letters, digits and
    every non-ASCII byte, 2 the other ASCII characters."""
    table = np.full(256, 2, dtype=np.uint8)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = 1
    table[IS_SPACE] = 0
    return table


CLASS = _class_table()
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def per_text(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` between consecutive offsets ``at``."""
    total = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(counts, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def seen_before(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items in text order: (an equal one came earlier in the text, it is one
    of several equal ones)."""
    keys = mix64(hashes + mix64(text.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    earlier, several = np.empty(len(keys), dtype=bool), np.empty(len(keys), dtype=bool)
    earlier[order] = same[:-1]
    several[order] = same[:-1] | same[1:]
    return earlier, several


def rule_counts(texts: Texts) -> dict[str, np.ndarray]:
    """The base counts of each text in the run."""
    inside = ~texts.space & ((texts.data & 0xC0) != 0x80)
    words = texts.word_hashes()
    at, triples = texts.windows(words, 3)
    covered = np.zeros(len(words) + 3, dtype=bool)
    repeated = at[seen_before(np.searchsorted(texts.word_at, at, side="right"), triples)[1]]
    for j in range(3):
        covered[repeated + j] = True
    # lines: cut after every \n and at the texts' borders; keep those with a word
    cuts = np.unique(np.concatenate([np.flatnonzero(texts.data == 10) + 1, texts.text_at]))
    cuts = cuts[cuts < len(texts.data)]
    values = BYTE_VALUES[texts.data]
    values[texts.data == 10] = 0
    ends = np.append(cuts[1:], len(texts.data))
    lengths = ends - cuts - ((texts.data[ends - 1] == 10) if len(cuts) else 0)
    has_word = np.diff(np.searchsorted(texts.starts, np.append(cuts, len(texts.data)))) > 0
    text = np.searchsorted(texts.text_at, cuts, side="right") - 1
    lines = span_hashes(values, cuts, lengths, BASE)[has_word]
    text = text[has_word]
    again = seen_before(text, lines)[0]
    return {"n_words": texts.n_words.astype(np.int64),
            "word_chars": per_text(inside, texts.text_at),
            "n_symbols": per_text(IS_SYMBOL[texts.data], texts.text_at),
            "n_dup_lines": np.bincount(text[again], minlength=texts.n)[:texts.n].astype(np.int64),
            "n_repeat_words": per_text(covered[:len(words)], texts.word_at)}


def ngram_buckets(texts: Texts, n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets of the texts): hashed unigrams and bigrams of each text,
    ASCII letters lower-cased.  A token is a run of letters or of other signs
    inside a word; a text's unigrams come first, then its bigrams."""
    data = LOWER[texts.data]
    kind = CLASS[data]
    border = np.ones(len(kind), dtype=bool)
    border[1:] = kind[1:] != kind[:-1]
    border[texts.text_at[:-1][texts.text_at[:-1] < len(data)]] = True
    starts = np.flatnonzero(border & (kind > 0))
    every = np.append(np.flatnonzero(border), len(data))
    lengths = every[np.searchsorted(every, starts, side="right")] - starts
    values = BYTE_VALUES[data]
    values[kind == 0] = 0
    tokens = span_hashes(values, starts, lengths, BASE)
    at = np.searchsorted(starts, texts.text_at)
    pairs = window_hashes(tokens, 2, _PAIR_BASE)
    end = np.repeat(at[1:], np.diff(at))
    pair_at = np.flatnonzero(np.arange(len(pairs)) + 2 <= end[:len(pairs)])
    text = np.concatenate([np.repeat(np.arange(texts.n), np.diff(at)),
                           np.searchsorted(at, pair_at, side="right") - 1])
    hashed = np.concatenate([tokens, pairs[pair_at]])
    order = np.argsort(text, kind="stable")
    counts = np.bincount(text, minlength=texts.n)
    return (hashed[order] % np.uint64(n_buckets)).astype(np.int64), np.append(0, np.cumsum(counts))


def ngram_counts(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text",
                 n_buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts of all documents and of the trusted
    ones.  Each task sums its documents before the shuffle."""
    ids = trusted.select(F.col(key).alias("__id")).where("__id is not null").distinct().withColumn("__target", F.lit(True))
    rows = docs.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    rows = rows.join(broadcast_if_small(ids), "__id", "left").select("__text", F.coalesce("__target", F.lit(False)).alias("t"))

    def run(batches):
        raw, target = np.zeros(n_buckets, dtype=np.int64), np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            marks = np.asarray(batch.column(1))
            for texts in runs(batch.column(0)):
                buckets, at = ngram_buckets(texts, n_buckets)
                raw += np.bincount(buckets, minlength=n_buckets)
                mark = np.repeat(marks[texts.row0:texts.row0 + texts.n], np.diff(at))
                target += np.bincount(buckets[mark], minlength=n_buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, raw[some], target[some])], names=["bucket", "raw", "target"])

    counts = in_batches(rows, run, "bucket long, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, n_buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """ln(p_target / p_raw) of every bucket; zeros where nothing is trusted.  At
    most ``n_buckets`` rows come to the driver, whatever the input."""
    raw, target = np.zeros(n_buckets), np.zeros(n_buckets)
    for row in counts.collect():
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(n_buckets)
    both = [(x + smoothing) / (x.sum() + smoothing * n_buckets) for x in (target, raw)]
    return np.log(both[0] / both[1])


SCORED = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, score double, kept boolean")


def score_documents(docs: DataFrame, ratios: np.ndarray, text: str = "text", carry: tuple[str, ...] = ("doc_id",),
                    threshold: float = THRESHOLD, min_words: int = MIN_WORDS,
                    max_repeat: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """The columns ``carry``, the base counts, ``score`` (mean log ratio of the
    document's n-grams; 0 without any) and the verdicts.  No shuffle."""
    rows = docs.select(F.col(text).alias("__text"), *carry)
    n_buckets = len(ratios)
    values = docs.sparkSession.sparkContext.broadcast(ratios)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in carry), *SCORED.split(", ")])

    def make(batch: pa.RecordBatch) -> Iterator[dict]:
        for texts in runs(batch.column(0)):
            out = rule_counts(texts)
            buckets, at = ngram_buckets(texts, n_buckets)
            n = np.diff(at)
            total = np.append(0.0, np.cumsum(values.value[buckets]))
            score = np.round((total[at[1:]] - total[at[:-1]]) / np.maximum(n, 1), 9) + 0.0
            failed = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > max_repeat * out["n_words"])
            out |= {"base_failed": failed, "score": score, "kept": ~failed & (score >= threshold)}
            part = batch.slice(texts.row0, texts.n)
            yield {c: part.column(i + 1) for i, c in enumerate(carry)} | {k: pa.array(v) for k, v in out.items()}

    return per_batch(rows, schema, make)


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic (null toxic counts as not toxic)."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def rate_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base counts, score and verdict.

    The target multinomial is counted over every labelled good document, the raw
    one over the whole corpus; both scans count all n-grams of whole texts.  Null
    text: no words, base_failed.  Repeated rows get equal rows.  No trusted
    document, or an empty table: scores are 0.  A null id never is trusted.
    """
    counts = cut(ngram_counts(docs, trusted_documents(labels)))
    return score_documents(docs, log_ratios(counts), threshold=threshold)

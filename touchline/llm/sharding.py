"""Operator 10: sharding by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.frames import cut, key_or_hash

SEED = 20_011
#: Rows per (shard, bucket) that one window group numbers.
GROUP_ROWS = 2_000


def rendezvous(key: Column, weights: Sequence[float], seed: int = SEED) -> Column:
    """The shard with the highest score for ``key``.  A shard's score depends on
    the key, the shard's number and its weight alone, so a further shard takes
    rows only into itself.  Scores are -w / ln(u) with u uniform in (0, 1)."""
    def score(shard: int, weight: float) -> Column:
        bits = F.xxhash64(key, F.lit(shard), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1))
        uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((F.lit(-float(weight)) / F.log(uniform)).alias("score"), F.lit(shard).alias("shard"))
    scores = [score(i, w) for i, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("at least one shard needs a positive weight")
    return (scores[0] if len(scores) == 1 else F.greatest(*scores))["shard"]


def assign_shards(records: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text",
                  seed: int = SEED) -> DataFrame:
    """``records`` with the columns ``shard`` and ``grown_shard`` (with one more
    shard of the mean weight); no shuffle.

    The key decides.  A null key is no stable key: such a record goes by the hash
    of its text (null text: as empty), so that a source without keys still
    spreads.  Repeated records share a shard.  Columns of these two names are
    replaced.
    """
    by = key_or_hash(records[key], records[text])
    mean = sum(weights) / len(weights)
    shard, grown = rendezvous(by, weights, seed), rendezvous(by, [*weights, mean], seed)
    return records.withColumns({"shard": shard, "grown_shard": grown})


def number_slots(records: DataFrame, order: Sequence[str], shard: str = "shard",
                 group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... inside each shard, without one task per shard.

    Rows of a shard fall into hash buckets of about ``group_rows`` rows; bucket
    totals (one row per shard and bucket) give each bucket's first slot, and a
    window numbers the rows inside a bucket.  Rows equal in ``order`` are
    interchangeable.
    """
    kept = cut(records)
    rows, shards = kept.agg(F.count("*"), F.countDistinct(shard)).first()
    buckets = max(1, -(-rows // (max(shards, 1) * group_rows)))
    kept = kept.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = kept.groupBy(shard, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(shard, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(shard, "__bucket").orderBy(*order)
    return (kept.join(first, [shard, "__bucket"])
            .withColumn("slot", (F.col("__first") + F.row_number().over(inside) - 1).cast("long"))
            .drop("__bucket", "__first"))


def shard_digest(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """One row per document: its shard under law ``key``, slot and text digest.

    An empty table gives no rows; repeated rows get slots of their own; further
    columns of ``docs`` are not carried.
    """
    placed = assign_shards(docs.select("doc_id", "text"), [1.0] * n_shards)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = placed.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"),
                         F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"),
                         F.col("shard").cast("int"), F.col("grown_shard").cast("int"))
    return (number_slots(rows, ["doc_id", "text_crc32", "size"])
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))

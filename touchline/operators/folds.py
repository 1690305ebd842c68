"""Seeded, stratified row assignment: k folds, hold-out split, nested blocks.

Rows are ranked inside their label by a seeded digest of the row id (60 bits of
MD5, so that any engine can check the assignment) with the exact two-level
ordinal (no one-partition window).  The same seed gives the same assignment
whatever the partitioning, because only row ids feed the digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordinal import prefix_sum
from touchline.operators.stats import attach_scalars
from touchline.session import cut_lineage


def seeded_order(row_id, seed: int):
    """60 bits of md5("seed:row id") as a number."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_rank(df: DataFrame, row_id: str, label: str | None, seed: int, size: str | None = None) -> DataFrame:
    """``__rank`` in the seeded order of the label's rows and, as ``size``, their number."""
    d = df.withColumn("__h", seeded_order(F.col(row_id), seed))
    return prefix_sum(d, [label] if label else [], ["__h", row_id], {"__rank": F.lit(1)}, method="hash",
                      totals={size: "__rank"} if size else None).drop("__h")


def stratified_folds(df: DataFrame, row_id: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """WIN5: fold = (rank inside label) mod k → folds balanced per label within one row;
    rows without a label are dealt out like a label of their own."""
    return hash_rank(df, row_id, label, seed).withColumn("fold", (F.col("__rank") % k).cast("int")) \
        .drop("__rank")


def plain_folds(df: DataFrame, row_id: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds for a label that is a number: rank of all rows in the seeded order mod k."""
    return hash_rank(df, row_id, None, seed).withColumn("fold", (F.col("__rank") % k).cast("int")).drop("__rank")


#: Slices of the seeded order (bits), and labels for which a split looks up where its test side ends.
SLICE_BITS, MOST_LABELS = 16, 1000


def _test_ends(df: DataFrame, row_id: str, label: str | None, tenths: int, seed: int) -> DataFrame | None:
    """(__label, __end_h, __end_id): the last row of each label's test side in the order of
    hash and row id.  Rows are counted by slice of the order; only the slice in which a
    test side ends is ordered.  None if a test side ends among rows of the same id, or
    there are more labels than ``MOST_LABELS``."""
    name = F.col(label) if label else F.lit(0)
    keys = df.select(name.alias("__label"), seeded_order(F.col(row_id), seed).alias("__h"), F.col(row_id).alias("__id")) \
        .withColumn("__s", F.shiftright("__h", 60 - SLICE_BITS))
    part = Window.partitionBy("__label")
    slices = keys.groupBy("__label", "__s").agg(F.count(F.lit(1)).alias("__n")).withColumns({
        "__upto": F.sum("__n").over(part.orderBy("__s")), "__need": F.ceil(F.sum("__n").over(part) * tenths / 10)})
    ends = cut_lineage(slices.where("__upto - __n < __need and __need <= __upto").select(
        F.col("__label").alias("__l"), F.col("__s").alias("__e"), (F.col("__need") - F.col("__upto") + F.col("__n")).alias("__need")))
    if ends.count() > MOST_LABELS:
        return None
    last = keys.join(F.broadcast(ends), F.col("__label").eqNullSafe(F.col("__l")) & (F.col("__s") == F.col("__e")))
    order = part.orderBy("__h", F.col("__id").asc_nulls_last())
    last = last.select("__label", "__h", "__id", "__need", F.row_number().over(order).alias("__r"), F.lead("__h").over(order).alias("__next_h"),
                       F.lead("__id").over(order).alias("__next")).where("__r = __need")
    ends = cut_lineage(last.select("__label", F.col("__h").alias("__end_h"), F.col("__id").alias("__end_id"),
                                   (F.col("__next_h").eqNullSafe(F.col("__h")) & F.col("__next").eqNullSafe(F.col("__id"))).alias("__tie")))
    return None if ends.where("__tie").count() else ends.drop("__tie")


def stratified_split(df: DataFrame, row_id: str, label: str | None, test_fraction_tenths: int = 2,
                     seed: int = 42) -> DataFrame:
    """WIN6: per label, the first ceil(n·f) rows of the hash order are the test side.
    Rows without a label are a stratum of their own; without a label column all rows
    are one.  The rows stay where they are: each is compared with the last one of its
    label's test side.  Where that one's row id comes again behind it, all rows are
    ranked instead, so that the test side has its exact size."""
    ends = _test_ends(df, row_id, label, test_fraction_tenths, seed)
    if ends is None:
        r = hash_rank(df, row_id, label, seed, size="__n")
        n_test = F.ceil(F.col("__n") * test_fraction_tenths / 10)
        return r.withColumn("split", F.when(F.col("__rank") < n_test, "test").otherwise("train")).drop("__rank", "__n")
    h, row = F.col("__h"), F.col(row_id)
    within = (h < F.col("__end_h")) | ((h == F.col("__end_h")) & (F.col("__end_id").isNull() | (row <= F.col("__end_id"))))
    rows = df.withColumn("__h", seeded_order(row, seed))
    joined = rows.join(F.broadcast(ends), (F.col(label) if label else F.lit(0)).eqNullSafe(F.col("__label")))
    return joined.withColumn("split", F.when(within, "test").otherwise("train")).select(*dict.fromkeys([*df.columns, "split"]))


def nested_blocks(df: DataFrame, row_id: str, n_blocks: int = 8, seed: int = 42) -> DataFrame:
    """WIN7: nested prefixes of one seeded order, each twice the one before, the
    smallest 1/``n_blocks`` of the rows; ``block`` = the smallest prefix with the row.

    With q = rank div floor(n / n_blocks), prefix i holds q < 2**i, so the block is
    the bit length of q; whatever lies beyond the last full prefix is in the last."""
    last = n_blocks.bit_length() - 1
    rows = attach_scalars(hash_rank(df, row_id, None, seed), df.agg(F.count(F.lit(1)).alias("__n")))
    q = F.floor(F.col("__rank") / F.greatest(F.floor(F.col("__n") / n_blocks), F.lit(1)))
    bits = F.when(q > 0, F.length(F.bin(q))).otherwise(0)
    return rows.withColumn("block", F.least(bits, F.lit(last)).cast("int")).drop("__rank", "__n")

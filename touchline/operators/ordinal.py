"""Exact ranks and prefix sums without a one-partition window.

A plain ``row_number().over(Window.orderBy(x))`` (no partition) or a window
partitioned by a hot key sends all of those rows through one task.  Here the
order key is first cut into order-preserving range buckets, so a group of any
size is spread over many (group, bucket) tasks.  Values get cut points from a
quantile sketch of the data (``method="quantile"``, the default); hashes, which
are spread evenly by themselves, get slices of binary octaves, computed per row
with no pass over the data (``method="hash"``):

1. bucket every row (range-preserving);
2. total the weight per (group, bucket): a small table;
3. exclusive prefix sum of those totals over buckets inside each group;
4. join the offsets back and finish with a window over (group, bucket).

The result is exact; only the balance of work depends on the buckets.  Null
partition keys form a partition of their own.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKETS = None     # None: scale with the cluster (see bucket_count)
BUCKETS_CONF = "touchline.ordinal.buckets"
MAX_CUTS = 2048            # cut points that the quantile sketch is asked for at most


def bucket_count(spark) -> int:
    """Range buckets per ordering: the session setting ``touchline.ordinal.buckets``
    if present, else 4 × spark.sql.shuffle.partitions (at least 64, at most 16384),
    so a hot group is cut into more pieces on a bigger cluster.  Bucket bounds only
    steer balance; results are exact for any count."""
    v = spark.conf.get(BUCKETS_CONF, None)
    if v:
        return int(v)
    sp = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(64, min(16384, 4 * sp))


def _quantile_bucket(df: DataFrame, key: str, n_buckets: int, out: str) -> DataFrame:
    """Range buckets of a double column at cut points that follow the data (one
    sketch job): values crowded into a narrow band spread over many buckets, equal
    values share one.  NaN and null go last."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    found = df.approxQuantile(key, probs, 1.0 / (2 * n_buckets)) if probs else []
    cuts = sorted({q for q in found if q is not None and math.isfinite(q)})
    last = F.lit(len(cuts) + 2).cast("long")
    if not cuts:
        null = F.col(key).isNull() | F.isnan(key)
        return df.withColumn(out, F.when(null, last).otherwise(F.lit(0).cast("long")))
    b = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=key, outputCol="__q", handleInvalid="keep")
    return b.transform(df).withColumn(out, F.coalesce(F.col("__q").cast("long"), last)).drop("__q")


_OCT_OFFSET = 1100            # octaves of a double span about -1075…1024


def log_bucket(c: Column, sub: int = 64) -> Column:
    """Order-preserving bucket of a number, computed per row with no pass over the
    data: the binary octave of |v| (exact: ``log2`` corrected against powers of two)
    and ``sub`` equal-width slices inside the octave; negative values mirror.
    NaN and null sort last, ±∞ at the ends.  Monotone by construction."""
    v = c.cast("double")
    a = F.abs(v)
    o0 = F.floor(F.log2(a))
    o1 = F.when(F.pow(F.lit(2.0), o0) > a, o0 - 1).otherwise(o0)
    octv = F.when(F.pow(F.lit(2.0), o1 + 1) <= a, o1 + 1).otherwise(o1)
    frac = a / F.pow(F.lit(2.0), octv) - 1.0
    slot = F.least(F.greatest(F.floor(frac * F.lit(float(sub))), F.lit(0)), F.lit(sub - 1))
    mag = (octv + _OCT_OFFSET) * sub + slot + 1
    top = (2 * _OCT_OFFSET + 2) * sub
    b = (F.when(v.isNull() | F.isnan(v), F.lit(top + 2))
         .when(v == F.lit(float("inf")), F.lit(top + 1))
         .when(v == F.lit(float("-inf")), F.lit(-top - 1))
         .when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0))).cast("long")
    # non-nullable on purpose: a nullable join key makes the optimizer infer an
    # ``isnotnull(key)`` filter and push the whole key expression below aggregates
    return F.coalesce(b, F.lit(top + 2).cast("long"))


def with_log_bucket(df: DataFrame, key: str, sub: int, out: str) -> DataFrame:
    """``log_bucket`` of the column ``key`` as the column ``out``, in steps that are
    columns of their own: Spark works each out once a row, while steps nested into one
    another are worked out again at every place that names them."""
    v, a, octv, inf = F.col(key).cast("double"), F.col("__lb_a"), F.col("__lb_o"), F.lit(float("inf"))
    two = F.lit(2.0)
    d = df.withColumn("__lb_a", F.when(~F.isnan(v) & (F.abs(v) < inf), F.abs(v))) \
        .withColumn("__lb_o", F.floor(F.log2(a))) \
        .withColumn("__lb_o", F.when(F.pow(two, octv) > a, octv - 1).otherwise(octv)) \
        .withColumn("__lb_o", F.when(F.pow(two, octv + 1) <= a, octv + 1).otherwise(octv))
    slot = F.least(F.greatest(F.floor((a / F.pow(two, octv) - 1.0) * F.lit(float(sub))), F.lit(0)), F.lit(sub - 1))
    d = d.withColumn("__lb_o", (octv + _OCT_OFFSET) * sub + slot + 1)
    top = (2 * _OCT_OFFSET + 2) * sub
    b = (F.when(v.isNull() | F.isnan(v), F.lit(top + 2))
         .when(v == inf, F.lit(top + 1))
         .when(v == -inf, F.lit(-top - 1))
         .when(v > 0, octv).when(v < 0, -octv).otherwise(F.lit(0))).cast("long")
    return d.withColumn(out, F.coalesce(b, F.lit(top + 2).cast("long"))).drop("__lb_a", "__lb_o")


def prefix_sum(df: DataFrame, partition_cols: list[str], order_cols: list[str],
               weights: dict[str, Column | str] | None = None, descending: bool = False,
               n_buckets: int | None = DEFAULT_BUCKETS, inclusive: bool = False,
               method: str = "quantile", totals: dict[str, str] | None = None) -> DataFrame:
    """Add, for every row, the sum of each weight over the rows of its partition
    that come before it in ``order_cols`` order (exclusive unless ``inclusive``).

    ``order_cols[0]`` must be numeric; the full ``order_cols`` must order rows of a
    partition uniquely (pre-aggregate ties).  ``weights`` maps output column →
    weight expression; without weights the output ``rank0`` is the 0-based row
    number.  Null order values sort last; null partition keys are kept.  ``totals``
    maps further output columns to weights: the weight's sum over the whole
    partition, taken from the bucket totals (no join on the bare key).
    """
    weights = dict(weights or {"rank0": F.lit(1)})
    n_buckets = n_buckets or bucket_count(df.sparkSession)
    sign = -1.0 if descending else 1.0
    wcols = {name: f"__w{i}" for i, name in enumerate(weights)}
    tmp = df.withColumns({wcols[n]: F.col(w) if isinstance(w, str) else w for n, w in weights.items()})
    tmp = tmp.withColumn("__ord", F.col(order_cols[0]).cast("double") * F.lit(sign))
    if method == "quantile":
        tmp = _quantile_bucket(tmp, "__ord", min(n_buckets, MAX_CUTS), "__b")
    elif method == "hash":
        tmp = with_log_bucket(tmp, "__ord", n_buckets, "__b")
    else:
        raise ValueError(f"unknown method {method!r}")
    part = list(partition_cols)
    sums = tmp.groupBy(*part, "__b").agg(*[F.sum(c).alias(c) for c in wcols.values()])
    whole = {out: wcols[name] for out, name in (totals or {}).items()}
    wb = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"__p{i}") for i, c in enumerate(part)], F.col("__b").alias("__ob"),
        *[F.coalesce(F.sum(c).over(wb), F.lit(0)).alias(f"{c}_off") for c in wcols.values()],
        *[F.sum(c).over(Window.partitionBy(*part)).alias(f"__total_{out}") for out, c in whole.items()])
    same = F.col("__b") == F.col("__ob")
    for i, c in enumerate(part):
        same = same & F.col(c).eqNullSafe(F.col(f"__p{i}"))
    joined = tmp.join(offsets, same, "inner")
    ordering = [(F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()) for c in order_cols]
    end = Window.currentRow if inclusive else -1
    wi = Window.partitionBy(*part, "__b").orderBy(*ordering).rowsBetween(Window.unboundedPreceding, end)
    return joined.select(*df.columns, *[
        (F.col(f"{wc}_off") + F.coalesce(F.sum(wc).over(wi), F.lit(0))).alias(name) for name, wc in wcols.items()],
        *[F.col(f"__total_{out}").alias(out) for out in whole])


def row_number0(df: DataFrame, partition_cols: list[str], order_cols: list[str], out: str = "rank0",
                descending: bool = False, n_buckets: int | None = DEFAULT_BUCKETS, method: str = "quantile") -> DataFrame:
    """0-based row number inside each partition (exact, skew-safe)."""
    return prefix_sum(df, partition_cols, order_cols, {out: F.lit(1)}, descending=descending, n_buckets=n_buckets,
                      method=method)

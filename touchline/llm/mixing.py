"""Operator 7: mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.frames import broadcast_if_small, cut

SEED = 7
#: Default weights: each source's share of the rows to this power, normalised.
TEMPERATURE = 0.5
#: Sources up to this count may be broadcast with their tables.
BROADCAST_SOURCES = 10_000
NO_SOURCE = "(none)"


def _bits(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None,
                 source: str = "source", temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n_rows, rate): the mean repetition of each source's rows.

    ``weights`` has columns (source, weight), any scale; sources without a
    positive weight get rate 0.  By default a source's weight is its row count to
    ``temperature``.  ``total`` is the wanted number of rows (default: as many as
    there are).  Rate = total * weight share / rows of the source.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source), F.lit(NO_SOURCE)).alias("source")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("n_rows").cast("double"), F.lit(temperature)))
    else:
        named = weights.select(F.coalesce("source", F.lit(NO_SOURCE)).alias("source"),
                               F.greatest(F.col("weight").cast("double"), F.lit(0.0)).alias("weight"))
        sizes = sizes.join(named.groupBy("source").agg(F.max("weight").alias("weight")), "source", "left")
        sizes = sizes.fillna(0.0, ["weight"])
    sizes = cut(sizes)
    all_rows, all_weight = sizes.agg(F.sum("n_rows"), F.sum("weight")).first()  # two numbers
    rows = float((all_rows or 0) if total is None else total)
    share = F.col("weight") / F.lit(float(all_weight)) if all_weight else F.lit(0.0)
    return sizes.select("source", "n_rows", (F.lit(rows) * share / F.col("n_rows")).alias("rate"))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """(source, n_rows, rate, cdf): the Poisson distribution function of each rate
    at 0, 1, 2, ..., as far as a double can tell from 1.  Terms come from sums of
    logarithms, so a large rate does not underflow."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    terms = rates.withColumn("k", F.explode(F.sequence(F.lit(0), last)))
    upto = Window.partitionBy("source").orderBy("k")
    log_k = F.sum(F.when(F.col("k") > 0, F.log(F.col("k").cast("double"))).otherwise(F.lit(0.0))).over(upto)
    mass = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.log(F.col("rate")) - F.col("rate") - log_k))
    terms = terms.withColumn("p", F.coalesce(mass, F.when(F.col("k") == 0, 1.0).otherwise(0.0)))
    terms = terms.withColumn("c", F.sum("p").over(upto))
    cdf = F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"])
    return terms.groupBy("source", "n_rows", "rate").agg(cdf.alias("cdf"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, total: int | None = None, key: str = "doc_id",
                source: str = "source", text: str = "text", seed: int = SEED,
                temperature: float = TEMPERATURE) -> DataFrame:
    """Every row of ``docs`` repeated by its own Poisson draw, in a global shuffle.

    The draw inverts the source's Poisson distribution at a uniform number that
    the key and the seed decide, so a rerun gives the same rows.  Added columns:
    ``copy`` (1, 2, ...), ``n_copies``, ``rate``, ``shuffle_key`` (the rows' order);
    columns of these names in ``docs`` are replaced.  Null source: a source of its
    own.  Null key: the text's digest stands in (null text: as empty).  Repeated
    rows draw alike.  A source's rows are never gathered: the small table of
    rates goes to the rows if its counted size allows, else the join splits the
    large sources.
    """
    tables = cut(poisson_tables(source_rates(docs, weights, total, source, temperature)))
    tables = tables.select(F.col("source").alias("__source"), F.col("rate").alias("__rate"), "cdf")
    name = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    clean = docs.drop("copy", "n_copies", "rate", "shuffle_key", "cdf")
    rows = (clean.withColumns({"__source": F.coalesce(F.col(source), F.lit(NO_SOURCE)), "__name": name})
            .join(broadcast_if_small(tables, limit=BROADCAST_SOURCES), "__source"))
    drawn = (_bits(F.concat_ws(":", F.lit(str(seed)), "__name"), 13).cast("double") + 0.5) / float(1 << 52)
    rows = rows.withColumn("__u", drawn).withColumn("n_copies", F.size(F.filter("cdf", lambda c: c <= F.col("__u"))))
    rows = rows.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    order = _bits(F.concat_ws(":", F.lit(str(seed)), "__name", F.col("copy").cast("string")), 15)
    return (rows.withColumns({"rate": F.col("__rate"), "shuffle_key": order})
            .select(*clean.columns, "copy", "n_copies", "rate", "shuffle_key").orderBy("shuffle_key", key, "copy"))


MIX_SQL = f"""
WITH d AS (SELECT *, coalesce(source, '{NO_SOURCE}') AS src,
                  coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS nm FROM {{docs}}),
s AS (SELECT src, count(*) AS n, pow(count(*), {TEMPERATURE}) AS w FROM d GROUP BY src),
r AS (SELECT src, n, (SELECT sum(n) FROM s) * (w / (SELECT sum(w) FROM s)) / n AS rate FROM s),
k AS (SELECT src, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INT))) AS k FROM r),
p AS (SELECT src, k, sum(exp(k * ln(rate) - rate - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END))
             OVER (PARTITION BY src ORDER BY k) AS c FROM k),
u AS (SELECT d.*, r.rate,
             (CAST('0x' || substr(md5('{SEED}:' || nm), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
      FROM d JOIN r USING (src)),
t AS (SELECT src, list(c ORDER BY k) AS cdf FROM p GROUP BY src),
c AS (SELECT u.*, CAST(len(list_filter(cdf, lambda x: x <= u.u)) AS INT) AS n_copies FROM u JOIN t USING (src)),
e AS (SELECT *, unnest(generate_series(1, n_copies)) AS copy FROM c WHERE n_copies > 0)
SELECT {{columns}}, CAST(copy AS INT) AS copy, n_copies, {{rate}}
       CAST('0x' || substr(md5('{SEED}:' || nm || ':' || copy), 1, 15) AS BIGINT) AS shuffle_key
FROM e
"""

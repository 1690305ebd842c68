"""Table statistics: shares, describe, correlations, histograms, category counts,
mutual information, profiling, initial scores, candidate correlation scores.

Multi-column statistics melt the columns into (column, value) rows with
``unpivot`` and aggregate per column, so one job covers any number of columns.
Quantiles are exact and skew-safe (prefix counts over distinct values, see
``ordinal``); nothing gathers a column into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.ordinal import prefix_sum
from touchline.session import cut_lineage

#: A lookup of at most this many narrow rows, counted first, is broadcast.
BROADCAST_ROWS = 200_000


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as scalar subqueries: no
    join, and more than one row is an error.  A dropped or renamed column of the
    same name in ``df`` is replaced."""
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])


def broadcast_if_counted(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` with a broadcast hint once its counted rows are few."""
    return F.broadcast(table) if table.count() <= limit else table


def melt(df: DataFrame, cols: list[str], ids: list[str] = (), value_type: str = "double") -> DataFrame:
    return df.select(*ids, *[F.col(c).cast(value_type).alias(c) for c in cols]) \
        .unpivot(list(ids), cols, "column", "value")


def grouped_quantiles(df: DataFrame, key: str, val: str, qs: list[float], linear: bool = True,
                      weight: str | None = None) -> DataFrame:
    """Exact quantiles per key.  linear: value at position q·(n−1) interpolated
    between neighbours; otherwise the value at position floor(q·(n−1)).
    Output: key, q, value.

    Works on (key, value) counts with exclusive prefix counts (skew-safe, see
    ``ordinal``); each count row tests the literal quantile list against its own
    position range, so only the one or two rows around each target survive —
    no join of rows with targets.  ``weight`` names a row-count column when the
    input is already aggregated."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    cnt = cut_lineage(df.where(F.col(key).isNotNull() & F.col(val).isNotNull())
                      .groupBy(key, val).agg(w.alias("__c")))     # read for cut points, totals and ranks
    pre = prefix_sum(cnt, [key], [val], {"__less": F.col("__c")}, totals={"__n": "__less"})
    qarr = F.array(*[F.lit(float(q)) for q in qs])
    lo, hi = F.col("__less"), F.col("__less") + F.col("__c") - 1

    def covers(q):
        pos = q * (F.col("__n") - 1)
        return ((F.floor(pos) >= lo) & (F.floor(pos) <= hi)) | ((F.ceil(pos) >= lo) & (F.ceil(pos) <= hi))

    hits = pre.select(key, val, "__less", "__c", "__n", F.explode(F.filter(qarr, covers)).alias("q"))
    pos = F.col("q") * (F.col("__n") - 1)
    in1 = (F.floor(pos) >= lo) & (F.floor(pos) <= hi)
    in2 = (F.ceil(pos) >= lo) & (F.ceil(pos) <= hi)
    sel = hits.groupBy(key, "q", "__n").agg(F.max(F.when(in1, F.col(val))).alias("v1"),
                                            F.max(F.when(in2, F.col(val))).alias("v2"))
    frac = F.col("q") * (F.col("__n") - 1) - F.floor(F.col("q") * (F.col("__n") - 1))
    value = (F.col("v1") + (F.col("v2") - F.col("v1")) * frac) if linear else F.col("v1")
    return sel.select(key, "q", value.cast("double").alias("value"))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """AGG14: share of rows per value (nulls excluded, like value_counts)."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return attach_scalars(counts, total).select(col, "n", (F.col("n") / F.col("__total")).alias("share"))


def describe_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG15: count, null count, mean, std, min, quartiles (linear), max per column."""
    # rows are read once: everything else comes from the counts of the distinct values
    counts = cut_lineage(melt(df, cols).groupBy("column", "value").agg(F.count(F.lit(1)).alias("c")))
    real = F.when(F.col("value").isNotNull(), F.col("c"))
    base = counts.groupBy("column").agg(
        F.coalesce(F.sum(real), F.lit(0)).alias("count"),
        F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)).alias("null_count"),
        F.try_divide(F.sum(real * F.col("value")), F.sum(real)).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    centred = counts.join(F.broadcast(base.select("column", "mean", "count")), "column")     # a row per listed column
    spread = centred.groupBy("column").agg(F.sqrt(F.try_divide(
        F.sum(F.col("c") * F.pow(F.col("value") - F.col("mean"), 2)), F.nullif(F.first("count") - 1, F.lit(0)))).alias("std"))
    base = base.join(F.broadcast(spread), "column").select("column", "count", "null_count", "mean", "std", "min", "max")
    q = grouped_quantiles(counts, "column", "value", [0.25, 0.5, 0.75], weight="c")
    qw = q.groupBy("column").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("value"))
    qw = qw.toDF("column", "q25", "q50", "q75")
    return base.join(qw, "column", "left")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """AGG16."""
    return df.select(col).distinct().orderBy(col)


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG17: Pearson for every pair (pairwise-complete), all in one aggregation;
    NaN → null first so it cannot poison a pair."""
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols])
    exprs, names = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            exprs.append(F.corr(a, b).alias(f"{a}__{b}"))
            names.append((a, b))
    wide = clean.agg(*exprs)
    stack = ", ".join(f"'{a}', '{b}', `{a}__{b}`" for a, b in names)
    return wide.selectExpr(f"stack({len(names)}, {stack}) AS (col_a, col_b, corr)")


def histogram_fixed(df: DataFrame, col: str, bins: int) -> DataFrame:
    """AGG18: equal-width bins over [min, max]; the maximum falls in the last bin."""
    v = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    rng = v.agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    return _bin_counts(attach_scalars(v, rng.withColumn("__bins", F.lit(bins).cast("bigint"))))


def _bin_counts(v: DataFrame) -> DataFrame:
    width = (F.col("__hi") - F.col("__lo")) / F.col("__bins")
    raw = F.floor((F.col("v") - F.col("__lo")) * F.col("__bins") / (F.col("__hi") - F.col("__lo")))
    b = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(F.least(raw, F.col("__bins") - 1))
    return v.groupBy(b.cast("bigint").alias("bin"), F.col("__lo"), F.col("__hi"), F.col("__bins")).agg(
        F.count(F.lit(1)).alias("n")).select(
        "bin", (F.col("__lo") + F.col("bin") * width).alias("lo"),
        (F.col("__lo") + (F.col("bin") + 1) * width).alias("hi"), "n", F.col("__bins").alias("n_bins"))


def histogram_auto(df: DataFrame, col: str) -> DataFrame:
    """AGG18 ``auto``: bin width = min(Sturges, Freedman–Diaconis) (Sturges if IQR = 0)."""
    v = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    q = grouped_quantiles(v.withColumn("__k", F.lit(0)), "__k", "v", [0.25, 0.75])
    iqr = q.groupBy("__k").agg((F.max("value") - F.min("value")).alias("__iqr")).drop("__k")
    st = v.agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"), F.count(F.lit(1)).alias("__n"))
    st = attach_scalars(st, iqr)
    ptp = F.col("__hi") - F.col("__lo")
    sturges = ptp / (F.log2(F.col("__n")) + 1.0)
    fd = 2.0 * F.col("__iqr") * F.pow(F.col("__n"), -1.0 / 3.0)
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    st = st.withColumn("__bins", F.when(ptp > 0, F.ceil(ptp / width)).otherwise(F.lit(1)).cast("bigint"))
    return _bin_counts(attach_scalars(v, st.select("__lo", "__hi", "__bins")))


def category_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG19: rows per category for several columns (nulls not counted)."""
    long = melt(df, cols, value_type="string")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def mutual_info_discrete(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """AGG20/AGG22: Σ p(x,y)·ln(p(x,y)/(p(x)p(y))) per feature (nats), descending.
    Contingency counts and both marginals are aggregations; no pairs are formed."""
    long = melt(df.where(F.col(label).isNotNull()), features, ids=[label], value_type="string") \
        .where(F.col("value").isNotNull())
    xy = long.groupBy("column", "value", label).agg(F.count(F.lit(1)).alias("nxy"))
    return _mi_from_counts(xy, label).orderBy(F.col("mutual_info").desc())


def _mi_from_counts(xy: DataFrame, label: str) -> DataFrame:
    xy = cut_lineage(xy)
    x = xy.groupBy("column", "value").agg(F.sum("nxy").alias("nx"))
    y = xy.groupBy("column", label).agg(F.sum("nxy").alias("ny"))
    n = xy.groupBy("column").agg(F.sum("nxy").alias("n"))     # a row per listed column
    j = xy.join(x, ["column", "value"]).join(broadcast_if_counted(y), ["column", label]).join(F.broadcast(n), "column")
    term = (F.col("nxy") / F.col("n")) * F.ln(
        F.col("nxy").cast("double") * F.col("n") / (F.col("nx").cast("double") * F.col("ny")))
    return j.groupBy("column").agg(F.sum(term).alias("mutual_info"))


def mutual_info_binned(df: DataFrame, features: list[str], label: str, n_bins: int = 64) -> DataFrame:
    """AGG21 default: continuous features cut at exact quantile edges (data values at
    positions floor(k·(n−1)/n_bins), distinct), then contingency MI (AGG20).
    Rows are reduced to (column, value, label) counts first; only distinct values
    are binned."""
    long = melt(df.select(*features, label).where(F.col(label).isNotNull()), features, ids=[label]) \
        .where(F.col("value").isNotNull())
    cvy = cut_lineage(long.groupBy("column", "value", label).agg(F.count(F.lit(1)).alias("c")))  # for edges and bins
    edges = grouped_quantiles(cvy, "column", "value", [k / n_bins for k in range(1, n_bins)], linear=False,
                              weight="c")
    e = edges.groupBy("column").agg(F.array_sort(F.collect_set("value")).alias("__edges"))
    j = cvy.join(F.broadcast(e), "column")            # one row per feature column
    b = F.size(F.filter("__edges", lambda x: x < F.col("value")))
    xy = j.groupBy("column", b.cast("string").alias("value"), label).agg(F.sum("c").alias("nxy"))
    return _mi_from_counts(xy, label)


def profile_columns(df: DataFrame, cols: list[str], label: str | None = None,
                    categorical: list[str] = (), ordinal_max: int = 100) -> DataFrame:
    """AGG32: distinct count per column; ≤ 100 distinct → ordinal (numeric columns),
    declared categoricals stay categorical.  Label profile gives the task."""
    long = melt(df, list(cols) + ([label] if label else []), value_type="string")
    nd = long.groupBy("column").agg(F.count_distinct("value").alias("n_distinct"))
    cat = F.col("column").isin(*categorical) if categorical else F.lit(False)
    kind = (F.when(cat, "categorical").when(F.col("n_distinct") <= ordinal_max, "ordinal")
            .otherwise("numerical"))
    out = nd.withColumn("kind", kind)
    if label:
        out = out.withColumn("kind", F.when(F.col("column") == label,
                                            F.when(F.col("n_distinct") < 20,
                                                   F.when(F.col("n_distinct") > 2, "multiclass")
                                                   .otherwise("binary")).otherwise("regression"))
                             .otherwise(F.col("kind")))
    return out


def init_scores(df: DataFrame, label: str, by: list[str] = (), task: str = "binary") -> DataFrame:
    """AGG33, where boosting starts: the logit of the positive rate; for regression the
    mean; for more classes one row a class with its share and the log of it."""
    m = F.avg(F.col(label).cast("double"))
    if task == "regression":
        return df.groupBy(*by).agg(m.alias("mean_label"), m.alias("init_score"))
    if task == "multiclass":
        counts = df.where(F.col(label).isNotNull()).groupBy(*by, F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
        whole = F.sum("n").over(Window.partitionBy(*by))      # over the few class counts
        return counts.select(*by, "class", (F.col("n") / whole).alias("prior"), F.ln(F.col("n") / whole).alias("init_score"))
    if task != "binary":
        raise ValueError(f"task {task!r}: choose binary, multiclass or regression")
    return df.groupBy(*by).agg(m.alias("mean_label"), F.ln(m / (F.lit(1.0) - m)).alias("init_score"))


def check_init_scores(df: DataFrame, score: str) -> bool:
    """AGG33 check: supplied initial scores that all lie in [0, 1] look like
    probabilities rather than margins; warn (returns True when suspicious)."""
    import warnings
    lo, hi = df.agg(F.min(score), F.max(score)).first()
    suspicious = lo is not None and 0.0 <= lo and hi <= 1.0
    if suspicious:
        warnings.warn("initial scores are all within [0, 1]: they look like probabilities, not margins")
    return suspicious


def stage1_corr(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """AGG34: |corr(coalesce(f, 0), y)| for all candidates in one aggregation."""
    wide = df.agg(*[F.abs(F.corr(F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)),
                                 F.col(label).cast("double"))).alias(f"c{i}") for i, f in enumerate(features)])
    stack = ", ".join(f"'{f}', c{i}" for i, f in enumerate(features))
    return wide.selectExpr(f"stack({len(features)}, {stack}) AS (feature, score)")


def digamma(x):
    """ψ(x) for x ≥ 1 as a Column: shift by 6 with the recurrence, then the
    asymptotic series (accurate to ~1e-12 there)."""
    x = F.col(x) if isinstance(x, str) else x
    z = x + 6.0
    series = (F.ln(z) - 1.0 / (2 * z) - 1.0 / (12 * z * z) + 1.0 / (120 * F.pow(z, 4))
              - 1.0 / (252 * F.pow(z, 6)) + 1.0 / (240 * F.pow(z, 8)))
    return series - sum(1.0 / (x + float(j)) for j in range(6))

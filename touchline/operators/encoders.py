"""Categorical encoders with a fit/transform split (fit on training rows only).

Fitted state of a column with at most ``MAX_LEVELS`` levels is a list (metadata);
applying it is a projection, no join or shuffle.  A column with more keeps its levels
in a table of (level, code), numbered by exact prefix sums; applying it is a lookup
join, broadcast when the table is known to be small, and one-hot forms are sparse
vectors instead of one column a level.  No such list comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators.formula import _lookup_join
from touchline.operators.ordinal import row_number0
from touchline.session import cut_lineage

MAX_LEVELS = 10_000


def level_table(train: DataFrame, col: str) -> DataFrame:
    """(level, code): distinct non-null values in order, numbered from 0.  Text goes by
    its first six bytes, then by the whole value, so no task sorts all levels."""
    levels = cut_lineage(train.where(F.col(col).isNotNull()).select(F.col(col).alias("level")).distinct())
    if dict(train.dtypes)[col] == "string":
        first = F.conv(F.rpad(F.hex("level"), 12, "0"), 16, 10).cast("long")
    else:
        first = F.col("level").cast("double")
    ranked = row_number0(levels.withColumn("__first", first), [], ["__first", "level"], out="code")
    return cut_lineage(ranked.select("level", F.col("code").cast("int").alias("code")))


def fit_levels(train: DataFrame, cols: list[str]) -> tuple[dict[str, list], dict[str, DataFrame], dict[str, int]]:
    """(lists, tables, number of levels): sorted distinct non-null levels of each column,
    as a list where they are few, else as a ``level_table``.  A sketch tells columns far
    from the limit; lists are read up to one level more than the limit."""
    lists, tables, sizes = {}, {}, {}
    near = train.agg(*[F.approx_count_distinct(c, 0.02).alias(c) for c in cols]).first().asDict() if cols else {}
    for c in cols:
        few = [] if near[c] > 2 * MAX_LEVELS else [
            r[0] for r in train.where(F.col(c).isNotNull()).select(c).distinct().limit(MAX_LEVELS + 1).collect()]
        if near[c] > 2 * MAX_LEVELS or len(few) > MAX_LEVELS:
            tables[c] = level_table(train, c)
            sizes[c] = tables[c].count()
        else:
            lists[c], sizes[c] = sorted(few, key=lambda v: v.encode() if isinstance(v, str) else v), len(few)
    return lists, tables, sizes


def lookup_codes(df: DataFrame, col: str, table: DataFrame, n: int, out: str) -> DataFrame:
    """``df`` with the code of each value, null where it is unknown or null."""
    return _lookup_join(df, table.select(F.col("level").alias(col), F.col("code").alias(out)), [col], n)


@dataclass
class OneHotModel:
    """FE5: one 0/1 column per training level (``<col>_<level>``); unknown → all zeros;
    source columns dropped.  A column with more than ``MAX_LEVELS`` levels becomes one
    sparse vector ``<col>_levels`` over its level codes."""
    levels: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)

    @staticmethod
    def fit(train: DataFrame, cols: list[str]) -> "OneHotModel":
        return OneHotModel(*fit_levels(train, cols))

    def transform(self, df: DataFrame) -> DataFrame:
        add = {f"{c}_{lv}": F.col(c).eqNullSafe(F.lit(lv)).cast("double")
               for c, lvs in self.levels.items() for lv in lvs}
        out = df.withColumns(add).drop(*self.levels)
        for c, table in self.tables.items():
            n = self.sizes[c]
            out = lookup_codes(out, c, table, n, "__code").withColumn("__code", F.coalesce("__code", F.lit(n)).cast("double"))
            # code n is no category: kept apart and dropped, it leaves a vector of zeros
            encoder = OneHotEncoder(inputCols=["__code"], outputCols=[f"{c}_levels"], handleInvalid="keep", dropLast=True)
            codes = table.sparkSession.range(n - 1, n).select(F.col("id").cast("double").alias("__code"))
            out = encoder.fit(codes).transform(out).drop("__code", c)
        return out


def dummy_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """FE6: dummies from the levels present (spaces → '_'), null gets ``<col>_null``.
    A column with more than ``MAX_LEVELS`` levels becomes one sparse vector
    ``<col>_levels`` over its level codes, nulls taking one place more at the end."""
    clean = df.withColumns({c: F.regexp_replace(F.col(c).cast("string"), " ", "_") for c in cols})
    lists, tables, sizes = fit_levels(clean, cols)
    has_null = clean.agg(*[F.max(F.col(c).isNull()).alias(c) for c in cols]).first()
    add = {}
    for c, levels in lists.items():
        for lv in levels:
            add[f"{c}_{lv}"] = F.coalesce((F.col(c) == F.lit(lv)).cast("int"), F.lit(0))
        if has_null[c]:
            add[f"{c}_null"] = F.col(c).isNull().cast("int")
    out = clean.withColumns(add).drop(*lists)
    for c, table in tables.items():
        out = lookup_codes(out, c, table, sizes[c], "__code").withColumn("__code", F.coalesce("__code", F.lit(sizes[c])).cast("double"))
        encoder = OneHotEncoder(inputCols=["__code"], outputCols=[f"{c}_levels"], handleInvalid="error", dropLast=False)
        last = table.sparkSession.range(1).select(F.lit(float(sizes[c] - 1 + bool(has_null[c]))).alias("__code"))
        out = encoder.fit(last).transform(out).drop("__code", c)
    return out


@dataclass
class CategoryCodes:
    """FE7/FE8: level schema learned on training rows.  ``codes`` → integer code by
    sorted level (unknown or null → −1); ``apply`` keeps the value when it is a
    known level, else null."""
    levels: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)

    @staticmethod
    def fit(train: DataFrame, cols: list[str]) -> "CategoryCodes":
        return CategoryCodes(*fit_levels(train, cols))

    def codes(self, df: DataFrame, suffix: str = "_code") -> DataFrame:
        add = {}
        for c, lvs in self.levels.items():
            arr = F.array(*[F.lit(v) for v in lvs]) if lvs else F.array().cast("array<string>")
            add[f"{c}{suffix}"] = F.coalesce(
                F.when(F.col(c).isNotNull(), F.array_position(arr, F.col(c)).cast("int") - 1), F.lit(-1))
        out = df.withColumns(add)
        for c, table in self.tables.items():
            name = f"{c}{suffix}"
            out = lookup_codes(out, c, table, self.sizes[c], name).withColumn(name, F.coalesce(name, F.lit(-1)))
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        out = df.withColumns({c: F.when(F.col(c).isin(*lvs), F.col(c)) for c, lvs in self.levels.items()})
        for c, table in self.tables.items():
            out = lookup_codes(out, c, table, self.sizes[c], "__code").withColumn(c, F.when(F.col("__code").isNotNull(), F.col(c))).drop("__code")
        return out.select(*df.columns)

    def save(self, path: str) -> None:
        """Lists as JSON, tables as Parquet, one folder a column."""
        for i, (c, table) in enumerate(self.tables.items()):
            table.write.mode("overwrite").parquet(f"{path}/table={i}")

    def load_tables(self, spark, path: str, cols: list[str]) -> "CategoryCodes":
        """The same lists with the tables of ``cols``, in the order in which they were saved."""
        tables = {c: spark.read.parquet(f"{path}/table={i}") for i, c in enumerate(cols)}
        return CategoryCodes(self.levels, tables, {c: t.count() for c, t in tables.items()})

    def to_json(self) -> str:
        import json
        if self.tables:
            raise ValueError(f"{', '.join(self.tables)}: too many levels for JSON; use save")
        return json.dumps(self.levels)

    @staticmethod
    def from_json(text: str) -> "CategoryCodes":
        import json
        return CategoryCodes(json.loads(text))

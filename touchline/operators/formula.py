"""Feature formulas: text ⇄ tree, row-wise compilation, stateful evaluation.

Formula text follows the reference grammar: ``(a+b)`` for the four arithmetic
operators, ``op(x)`` / ``op(a,b)`` for the rest, bare column names for leaves
(column names must not contain ``()+-*/,``).

Two evaluation forms:

* **whole-table** (``derive_features``): every stateful operator sees all rows
  of the given frame (the reference's transductive path).  Nodes are evaluated
  level by level; stateful nodes that share a key share one ``groupBy`` and one
  join back, so a frame with twenty ``GroupByThen*(…, k)`` formulas costs one
  aggregation on ``k``.
* **fitted** (``FormulaEncoder`` → ``FittedFormulas``): state (counts, group
  aggregates, pair ids) is learned on training rows, kept as small lookup tables
  and applied to any frame with lookup joins; unseen keys give null (``Combine``: −1).
"""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import scalar as S
from touchline.operators.ordinal import prefix_sum, row_number0
from touchline.session import cut_lineage, stored

# Operator vocabulary of the formula language.
ALL_OPERATORS = ["freq"]
NUM_OPERATORS = ["abs", "log", "sqrt", "square", "sigmoid", "round", "residual"]
NUM_NUM_OPERATORS = ["min", "max", "+", "-", "*", "/"]
CAT_NUM_OPERATORS = ["GroupByThenMin", "GroupByThenMax", "GroupByThenMean",
                     "GroupByThenMedian", "GroupByThenStd", "GroupByThenRank"]
CAT_CAT_OPERATORS = ["Combine", "CombineThenFreq", "GroupByThenNUnique"]
SYMMETRIC_OPERATORS = ["min", "max", "+", "-", "*", "/", "Combine", "CombineThenFreq"]
STATEFUL_OPERATORS = ["freq", "GroupByThenMin", "GroupByThenMax", "GroupByThenMean",
                      "GroupByThenMedian", "GroupByThenStd", "GroupByThenRank",
                      "GroupByThenFreq", "Combine", "CombineThenFreq", "GroupByThenNUnique"]
ARITH = "+-*/"
_SPECIAL = set("()+-*/,")

# lookup tables of at most this size (rows times columns times 16 bytes) are broadcast;
# larger ones are shuffle-joined, where AQE splits the rows of a frequent key
BROADCAST_MAX_BYTES = 32 << 20
# medians, ranks and pair ids whose first jobs run side by side
TABLES_AT_ONCE = 6


@dataclass(frozen=True)
class Node:
    op: str | None                 # None for a leaf (column)
    children: tuple = ()
    name: str | None = None        # leaf column

    @property
    def is_leaf(self) -> bool:
        return self.op is None

    def text(self) -> str:
        if self.is_leaf:
            return self.name
        if self.op in ARITH:
            return f"({self.children[0].text()}{self.op}{self.children[1].text()})"
        return f"{self.op}({','.join(c.text() for c in self.children)})"

    def leaves(self) -> set:
        if self.is_leaf:
            return {self.name}
        out = set()
        for c in self.children:
            out |= c.leaves()
        return out

    def is_stateful(self) -> bool:
        return (not self.is_leaf) and (self.op in STATEFUL_OPERATORS or
                                       any(c.is_stateful() for c in self.children))

    def is_rowwise(self) -> bool:
        return not self.is_stateful()


def leaf(name: str) -> Node:
    return Node(None, (), name)


def op(name: str, *children: Node) -> Node:
    return Node(name, tuple(children))


def parse_formula(text: str) -> Node:
    """Recursive-descent parse of the formula text."""
    text = text.strip()
    pos = 0

    def expr():
        nonlocal pos
        if text[pos] == "(":
            pos += 1
            a = expr()
            o = text[pos]
            if o not in ARITH:
                raise ValueError(f"bad formula {text!r} at {pos}")
            pos += 1
            b = expr()
            if text[pos] != ")":
                raise ValueError(f"bad formula {text!r} at {pos}")
            pos += 1
            return op(o, a, b)
        start = pos
        while pos < len(text) and text[pos] not in _SPECIAL:
            pos += 1
        name = text[start:pos]
        if pos < len(text) and text[pos] == "(":
            pos += 1
            args = [expr()]
            while text[pos] == ",":
                pos += 1
                args.append(expr())
            if text[pos] != ")":
                raise ValueError(f"bad formula {text!r} at {pos}")
            pos += 1
            return op(name, *args)
        return leaf(name)

    node = expr()
    if pos != len(text):
        raise ValueError(f"trailing text in formula {text!r}")
    return node


def as_node(f) -> Node:
    return f if isinstance(f, Node) else parse_formula(f)


# ---- row-wise compilation -------------------------------------------------------------

def rowwise_column(node: Node, resolve=None) -> Column:
    """Compile a row-wise tree to one Column.  ``resolve(node)`` may return a
    Column for sub-trees already materialised (used for nested stateful nodes)."""
    if resolve is not None:
        c = resolve(node)
        if c is not None:
            return c
    if node.is_leaf:
        return F.col(f"`{node.name}`")
    kids = [rowwise_column(c, resolve) for c in node.children]
    if node.op in S.UNARY:
        return S.UNARY[node.op](kids[0])
    if node.op in S.BINARY:
        return S.BINARY[node.op](kids[0], kids[1])
    raise ValueError(f"operator {node.op!r} is not row-wise")


def rowwise_features(df: DataFrame, formulas, names: dict | None = None) -> DataFrame:
    """FE2: append one column per row-wise formula (named by its text or ``names``)."""
    nodes = [as_node(f) for f in formulas]
    for n in nodes:
        if n.is_stateful():
            raise ValueError(f"{n.text()} is stateful; use a fitted or whole-table form")
    names = names or {}
    cols = [S.finite_or_null(rowwise_column(n)).alias(names.get(n.text(), n.text()))
            for n in nodes]
    return df.select("*", *cols)


# ---- whole-table evaluation ------------------------------------------------------------

def _depth(n: Node) -> int:
    return 0 if n.is_leaf else 1 + max(_depth(c) for c in n.children)


def _walk(n: Node, acc: dict):
    for c in n.children:
        _walk(c, acc)
    if not n.is_leaf:
        acc.setdefault(n.text(), n)


def _group_table(base: DataFrame, key_cols: list[str], nodes: list, colname) -> tuple[DataFrame, list[str]]:
    """Aggregate table for stateful nodes sharing ``key_cols`` (rows with a null key
    form no group).  Returns the table (keys + one column per node) and the join
    columns."""
    cond = F.col(key_cols[0]).isNotNull()
    for k in key_cols[1:]:
        cond = cond & F.col(k).isNotNull()
    keyed = base.where(cond)
    aggs = []
    for n in nodes:
        o = n.op
        out = colname(n)
        if o in ("freq", "CombineThenFreq"):
            aggs.append(F.count(F.lit(1)).cast("double").alias(out))
        elif o in ("GroupByThenMin", "GroupByThenMax", "GroupByThenMean", "GroupByThenStd",
                   "GroupByThenNUnique"):
            v = F.col(colname(n.children[0]))
            fn = {"GroupByThenMin": F.min, "GroupByThenMax": F.max, "GroupByThenMean": F.avg,
                  "GroupByThenStd": F.stddev_samp, "GroupByThenNUnique": F.count_distinct}[o]
            aggs.append(fn(v).cast("double").alias(out))
    return keyed.groupBy(*key_cols).agg(*aggs), key_cols


def grouped_median(df: DataFrame, key: str, val: str, out: str) -> DataFrame:
    """Exact median per key (midpoint of the two middle values), skew-safe.

    Counts per (key, value) → exclusive prefix counts (two-level, see ordinal) →
    keep the one or two (key, value) rows that cover the middle positions."""
    cnt = cut_lineage(df.where(F.col(key).isNotNull() & F.col(val).isNotNull())
                      .groupBy(key, val).agg(F.count(F.lit(1)).alias("__c")))
    pre = prefix_sum(cnt, [key], [val], {"__less": F.col("__c")}, totals={"__n": "__less"})
    i1 = F.floor((F.col("__n") - 1) / 2)
    i2 = F.ceil((F.col("__n") - 1) / 2)
    hit1 = (F.col("__less") <= i1) & (i1 < F.col("__less") + F.col("__c"))
    hit2 = (F.col("__less") <= i2) & (i2 < F.col("__less") + F.col("__c"))
    sel = pre.where(hit1 | hit2)
    return sel.groupBy(key).agg(
        ((F.max(F.when(hit1, F.col(val))) + F.max(F.when(hit2, F.col(val)))) / 2.0)
        .cast("double").alias(out))


def grouped_rank(df: DataFrame, key: str, val: str, out: str) -> DataFrame:
    """Average-tie percentile rank of each (key, value): (less + (equal+1)/2) / n."""
    cnt = cut_lineage(df.where(F.col(key).isNotNull() & F.col(val).isNotNull())
                      .groupBy(key, val).agg(F.count(F.lit(1)).alias("__c")))
    pre = prefix_sum(cnt, [key], [val], {"__less": F.col("__c")}, totals={"__n": "__less"})
    return pre.select(
        key, val, ((F.col("__less") + (F.col("__c") + 1) / 2.0) / F.col("__n")).alias(out))


def combine_ids(df: DataFrame, a: str, b: str, order_col: str, out: str) -> DataFrame:
    """Pair → id by first appearance in ``order_col`` order (0-based)."""
    pairs = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
             .groupBy(a, b).agg(F.min(order_col).alias("__first")))
    return row_number0(pairs, [], ["__first"], out="__id").select(
        a, b, F.col("__id").cast("double").alias(out))


def key_counts(df: DataFrame, key_sets: list[tuple]) -> dict[tuple, int]:
    """Upper estimates of the distinct keys of each set of columns, in one pass with
    partial aggregation (a sketch of fixed size per set)."""
    if not key_sets:
        return {}
    # one binary buffer a set: approx_count_distinct holds 410 buffer columns a set, whose
    # projections every task builds anew
    found = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[F.col(f"`{c}`") for c in keys]), F.lit(12))).alias(f"k{i}")
                     for i, keys in enumerate(key_sets)]).first()
    return {keys: int((found[i] or 0) * 1.1) + 1 for i, keys in enumerate(key_sets)}


def derive_features(df: DataFrame, formulas, order_col: str | None = None,
                    names: dict | None = None, keep: list[str] | None = None) -> DataFrame:
    """FE1 whole-table evaluation of any formulas (nested allowed).

    ``order_col`` gives row order for ``Combine`` ids.  Output = ``keep`` columns
    (default: all input columns) + one double column per formula.
    """
    names = names or {}
    roots = [as_node(f) for f in formulas]
    nodes: dict[str, Node] = {}
    for r in roots:
        _walk(r, nodes)
    ident = {t: f"__f{i}" for i, t in enumerate(nodes)}

    def colname(n: Node) -> str:
        return n.name if n.is_leaf else ident[n.text()]

    cur = df
    done: set = set()
    by_level: dict[int, list[Node]] = {}
    for n in nodes.values():
        by_level.setdefault(_depth(n), []).append(n)

    def resolve(n: Node):
        if n.is_leaf:
            return F.col(f"`{n.name}`")
        if n.text() in done:
            return F.col(ident[n.text()])
        return None

    for lvl in sorted(by_level):
        level_nodes = by_level[lvl]
        row = [n for n in level_nodes if n.op not in STATEFUL_OPERATORS]
        stateful = [n for n in level_nodes if n.op in STATEFUL_OPERATORS]
        # Aggregates of this level read the frame as it is before this level's joins
        # (for first-order formulas: the input itself), so the plan grows linearly.
        src = cur
        groups: dict[tuple, list[Node]] = {}
        specials: list[Node] = []
        for n in stateful:
            if n.op == "freq":
                groups.setdefault((colname(n.children[0]),), []).append(n)
            elif n.op == "CombineThenFreq":
                groups.setdefault((colname(n.children[0]), colname(n.children[1])), []).append(n)
            elif n.op in ("GroupByThenMedian", "GroupByThenRank", "GroupByThenFreq", "Combine"):
                specials.append(n)
            else:
                groups.setdefault((colname(n.children[1]),), []).append(n)
        pairs = [(colname(n.children[0]), colname(n.children[1])) for n in specials]
        key_sets = {*groups} | {(p[1],) if n.op == "GroupByThenMedian" else p for n, p in zip(specials, pairs)}
        sizes = key_counts(src, sorted(key_sets))

        def special(n: Node) -> tuple[DataFrame, list[str], int]:
            c0, c1 = colname(n.children[0]), colname(n.children[1])
            out = ident[n.text()]
            if n.op == "GroupByThenMedian":
                return grouped_median(src.select(c1, c0), c1, c0, out), [c1], sizes[c1,]
            if n.op == "GroupByThenRank":
                return grouped_rank(src.select(c1, c0), c1, c0, out), [c1, c0], sizes[c0, c1]
            if n.op == "GroupByThenFreq":
                t = (src.where(F.col(c1).isNotNull() & F.col(c0).isNotNull())
                     .groupBy(c1, c0).agg(F.count(F.lit(1)).cast("double").alias(out)))
                return t, [c1, c0], sizes[c0, c1]
            if order_col is None:
                raise ValueError("Combine needs an explicit row order column")
            return combine_ids(src.select(c0, c1, order_col), c0, c1, order_col, out), [c0, c1], sizes[c0, c1]

        # each takes several small jobs before its table can be joined: they run side by side
        with ThreadPoolExecutor(max_workers=TABLES_AT_ONCE) as pool:
            tables = list(pool.map(special, specials))
        # the large tables first, while the rows are still narrow; row-wise columns last
        for n, (table, on, size) in sorted(zip(specials, tables), key=lambda t: -t[1][2]):
            cur = _lookup_join(cur, table, on, size)
            if n.op == "Combine":
                out = ident[n.text()]
                cur = cur.withColumn(out, F.coalesce(F.col(out), F.lit(-1.0)))
        for keys, ns in groups.items():
            need = set(keys) | {colname(n.children[0]) for n in ns if n.op.startswith("GroupByThen")}
            table, on = _group_table(src.select(*[F.col(f"`{c}`") for c in need]), list(keys), ns, colname)
            cur = _lookup_join(cur, table, on, sizes[keys])
        if row:
            cur = cur.select("*", *[S.finite_or_null(rowwise_column(n, resolve)).alias(ident[n.text()])
                                    for n in row])
            done.update(n.text() for n in row)
        done.update(n.text() for n in stateful)

    keep_cols = [F.col(f"`{c}`") for c in (keep if keep is not None else df.columns)]
    outs = [S.finite_or_null(F.col(ident[r.text()]).cast("double")).alias(names.get(r.text(), r.text()))
            if not r.is_leaf else F.col(f"`{r.name}`").cast("double").alias(names.get(r.text(), r.text()))
            for r in roots]
    return cur.select(*keep_cols, *outs)


def _lookup_join(left: DataFrame, table: DataFrame, on: list[str], n_rows: int | None = None) -> DataFrame:
    """Left join of a lookup table on its keys.  Broadcast when its counted (or, with
    a margin, estimated) rows are known to be small; otherwise a shuffle join, which
    AQE splits where a key is skewed."""
    if n_rows is not None and n_rows * len(table.columns) * 16 <= BROADCAST_MAX_BYTES:
        table = F.broadcast(table)
    return left.join(table, on=on, how="left")


# ---- fitted form (train → apply) -------------------------------------------------------

def stateful_nodes(formulas) -> list[Node]:
    """The stateful nodes of all formulas, each once, inner ones before those that use them."""
    found: dict[str, Node] = {}
    for f in formulas:
        _walk(as_node(f), found)
    return sorted((n for n in found.values() if n.op in STATEFUL_OPERATORS), key=_depth)


def _fit_node(n: Node, base: DataFrame, order_col: str | None) -> tuple[list[str], DataFrame]:
    """(key columns, lookup table with ``value``) of a stateful node whose arguments are
    the columns ``__k0`` and ``__k1``."""
    both = F.col("__k0").isNotNull() & F.col("__k1").isNotNull() if len(n.children) > 1 else None
    if n.op == "freq":
        keys, rows, value = ["__k0"], base.where(F.col("__k0").isNotNull()), F.count(F.lit(1))
    elif n.op == "CombineThenFreq":
        keys, rows, value = ["__k0", "__k1"], base.where(both), F.count(F.lit(1))
    elif n.op == "GroupByThenFreq":
        keys, rows, value = ["__k1", "__k0"], base.where(both), F.count(F.lit(1))
    elif n.op == "Combine":
        if not order_col:
            raise ValueError("Combine needs an explicit row order column")
        return ["__k0", "__k1"], combine_ids(base, "__k0", "__k1", order_col, "value")
    elif n.op == "GroupByThenMedian":
        return ["__k1"], grouped_median(base, "__k1", "__k0", "value")
    elif n.op == "GroupByThenRank":
        raise ValueError("GroupByThenRank has no fitted form; use derive_features")
    else:
        fn = {"GroupByThenMin": F.min, "GroupByThenMax": F.max, "GroupByThenMean": F.avg,
              "GroupByThenStd": F.stddev_samp, "GroupByThenNUnique": F.count_distinct}[n.op]
        keys, rows, value = ["__k1"], base.where(F.col("__k1").isNotNull()), fn(F.col("__k0"))
    return keys, rows.groupBy(*keys).agg(value.cast("double").alias("value"))


@dataclass
class FittedFormulas:
    """State learned by ``FormulaEncoder.fit``: one lookup table per stateful node, in
    the order in which they are applied."""
    formulas: list
    tables: dict = field(default_factory=dict)      # node text → DataFrame
    keys: dict = field(default_factory=dict)        # node text → key columns
    sizes: dict = field(default_factory=dict)       # node text → row count
    names: dict = field(default_factory=dict)

    def resolve(self, n: Node):
        """The column that holds an applied node."""
        place = list(self.tables).index(n.text()) if n.text() in self.tables else None
        return None if place is None else F.col(f"__s{place}")

    def apply_node(self, df: DataFrame, n: Node) -> DataFrame:
        """``df`` with the node's lookup column."""
        t = n.text()
        out = f"__s{list(self.tables).index(t)}"
        kids = [f"__k{i}" for i in range(len(n.children))]
        cur = df.select("*", *[rowwise_column(c, self.resolve).alias(k) for c, k in zip(n.children, kids)])
        cur = _lookup_join(cur, self.tables[t].withColumnRenamed("value", out), self.keys[t], self.sizes.get(t))
        if n.op == "Combine":
            cur = cur.withColumn(out, F.coalesce(F.col(out), F.lit(-1.0)))
        return cur.drop(*kids)

    def transform(self, df: DataFrame) -> DataFrame:
        cur = df
        for n in stateful_nodes(self.formulas):
            cur = self.apply_node(cur, n)
        roots = [as_node(f) for f in self.formulas]
        values = [self.resolve(n) if n.op in STATEFUL_OPERATORS else S.finite_or_null(rowwise_column(n, self.resolve)) for n in roots]
        return cur.select(*[F.col(f"`{c}`") for c in df.columns],
                          *[v.alias(self.names.get(n.text(), n.text())) for n, v in zip(roots, values)])

    def save(self, path: str) -> None:
        for i, t in enumerate(self.tables):
            self.tables[t].write.mode("overwrite").parquet(os.path.join(path, f"t{i}"))
        spark = next(iter(self.tables.values())).sparkSession if self.tables else None
        meta = {"formulas": [as_node(f).text() for f in self.formulas], "keys": self.keys,
                "sizes": self.sizes, "names": self.names}
        if spark is not None:
            spark.createDataFrame([(json.dumps(meta),)], "meta string") \
                .coalesce(1).write.mode("overwrite").text(os.path.join(path, "meta"))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedFormulas":
        meta = json.loads(spark.read.text(os.path.join(path, "meta")).first()[0])
        tables = {t: spark.read.parquet(os.path.join(path, f"t{i}")) for i, t in enumerate(meta["keys"])}
        return FittedFormulas(meta["formulas"], tables, meta["keys"], meta["sizes"], meta["names"])


@dataclass
class FormulaEncoder:
    """FE4: learn the state of stateful formulas on training rows.

    Nested formulas are a graph of lookup tables: an inner stateful node is fitted
    first, its table applied to the training rows, and the next table learned from
    the result; ``transform`` applies the tables in the same order, so inner values
    of new rows come from the training rows too.  ``order_col`` orders rows for
    ``Combine`` ids.
    """
    formulas: list
    order_col: str | None = None
    names: dict = field(default_factory=dict)

    def fit(self, train: DataFrame, materialize: bool = False) -> FittedFormulas:
        """With ``materialize`` each table is written to the shared folder and counted,
        so that applying it can broadcast it behind a known size."""
        fitted = FittedFormulas(list(self.formulas), names=dict(self.names))
        nodes = stateful_nodes(self.formulas)
        used = {c.text() for n in nodes for c in n.children if c.is_stateful()}
        inner = {t for n in nodes for t in [n.text()] if any(t in u for u in used)}
        cur = train
        for n in nodes:
            kids = [f"__k{i}" for i in range(len(n.children))]
            extra = [self.order_col] if (n.op == "Combine" and self.order_col) else []
            base = cur.select(*[rowwise_column(c, fitted.resolve).alias(k) for c, k in zip(n.children, kids)], *extra)
            keys, table = _fit_node(n, base, self.order_col)
            if materialize or n.text() in inner:
                table = cut_lineage(table)
                fitted.sizes[n.text()] = table.count()
            fitted.tables[n.text()], fitted.keys[n.text()] = table, keys
            if n.text() in inner:
                cur = fitted.apply_node(cur, n)
        return fitted

    def fit_materialized(self, train: DataFrame) -> FittedFormulas:
        return self.fit(train, materialize=True)


def fold_features(folds: DataFrame, formulas, row_id: str, k: int, order_col: str | None = None,
                  names: dict | None = None, keep: list[str] = ()) -> DataFrame:
    """FE13 inside cross-validation: (``row_id``, fold, ``keep``, one column a formula), where
    each fold's rows get the state learned on the other folds' rows, so that no
    feature has seen the rows that it is judged on.  ``folds`` has a ``fold`` column; what
    is read of it is written once, not dealt out anew for each fold and table."""
    read = set().union(*[as_node(f).leaves() for f in formulas])
    wanted = dict.fromkeys([row_id, "fold", *keep, *([order_col] if order_col else []), *sorted(read)])
    folds = stored(folds.select(*[F.col(f"`{c}`") for c in wanted]), "folds")
    out = None
    for i in range(k):
        fitted = FormulaEncoder(list(formulas), order_col, dict(names or {})).fit(folds.where(F.col("fold") != i), materialize=True)
        part = fitted.transform(folds.where(F.col("fold") == i))
        wanted = [(names or {}).get(as_node(f).text(), as_node(f).text()) for f in formulas]
        part = part.select(*[F.col(f"`{c}`") for c in (row_id, "fold", *keep, *wanted)])
        out = part if out is None else out.unionByName(part)
    return out

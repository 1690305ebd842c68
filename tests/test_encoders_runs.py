"""Category schema, codes, effective parameters, aliases, missing features."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import runs as RU
from touchline.operators.encoders import CategoryCodes
from touchline.operators.passes import feature_aliases, select_features


def test_category_schema_unseen_to_null(spark):
    train = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3)], "team string, value int")
    valid = spark.createDataFrame([("B", 5), ("C", 8)], "team string, value int")
    cc = CategoryCodes.fit(train, ["team"])
    assert cc.levels == {"team": ["A", "B"]}
    assert [r["team"] for r in cc.apply(valid).collect()] == ["B", None]


def test_codes_by_sorted_level(spark):
    df = spark.createDataFrame([(0, "home", 10), (1, "away", 20), (2, "home", 30)], "i int, cat string, num int")
    out = CategoryCodes.fit(df, ["cat"]).codes(df).orderBy("i").collect()
    assert [r["cat_code"] for r in out] == [1, 0, 1]
    assert [r["num"] for r in out] == [10, 20, 30]


def test_effective_params(spark):
    df = spark.createDataFrame([("r1", "lightgbm")], "run_id string, model_type string").withColumn(
        "params", F.create_map(F.lit("learning_rate"), F.lit("0.05"), F.lit("n_estimators_used"), F.lit("15"),
                               F.lit("unused"), F.lit("1")))
    got = RU.effective_params(df).first()["effective_params"]
    assert got == {"learning_rate": "0.05", "n_estimators": "15"}


def test_alias_and_missing(spark):
    df = spark.createDataFrame([(10,), (20,)], "new_formula int")
    out = feature_aliases(df, ["new_formula"])
    assert [r["autoFE_f_0"] for r in out.collect()] == [10, 20]
    with pytest.raises(ValueError, match="Missing selected features"):
        select_features(spark.createDataFrame([(1, 2)], "f1 int, f2 int"), ["f1", "f_missing"])


def test_tolerant_bool_tags(spark):
    df = spark.createDataFrame([(" True ",), ("false",), (None,), ("TRUE",)], "t string")
    from touchline.functions.scalar import tolerant_bool
    assert [r[0] for r in df.select(tolerant_bool("t")).collect()] == [True, False, False, True]


def test_metric_dispatch_and_init_score_check(spark):
    import warnings
    from touchline.operators.metrics import init_metric
    from touchline.operators.stats import check_init_scores
    df = spark.createDataFrame([(1, 0.3), (0, -0.2), (1, 1.5)], "y int, margin double")
    assert init_metric(df, "binary_logloss").first()["log_loss"] > 0
    with pytest.raises(NotImplementedError):
        init_metric(df, "mape")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert check_init_scores(spark.createDataFrame([(0.2,), (0.9,)], "s double"), "s")
        assert w


def test_fifty_thousand_levels(spark, tmp_path):
    """Levels beyond the list limit: codes, mapping and one-hot vectors by lookup table."""
    from touchline.operators.encoders import OneHotModel
    names = sorted({f"{'é' if i % 3 else 'z'}{i * 7919 % 100_003}" for i in range(50_000)}, key=str.encode)
    train = spark.range(50_000).select(F.concat(F.when(F.col("id") % 3 != 0, "é").otherwise("z"),
                                                (F.col("id") * 7919 % 100_003).cast("string")).alias("name"), F.lit(1).alias("code"))
    codes = CategoryCodes.fit(train, ["name"])
    assert codes.levels == {} and codes.sizes == {"name": len(names)}
    place = {v: i for i, v in enumerate(names)}
    some = spark.createDataFrame([(v, 5) for v in [*names[::997], "unknown", None]], "name string, code int")
    rows = codes.codes(some).collect()
    assert all(r.name_code == place.get(r.name, -1) for r in rows) and len(rows) == some.count()
    assert {r.name for r in codes.apply(some).collect()} == {*names[::997], None}
    codes.save(str(tmp_path))
    assert CategoryCodes().load_tables(spark, str(tmp_path), ["name"]).codes(some).collect() == rows
    vectors = {r.name: r.name_levels for r in OneHotModel(codes.levels, codes.tables, codes.sizes).transform(
        some.withColumn("keep", F.col("name")).withColumnRenamed("keep", "x")).withColumnRenamed("x", "name").collect()}
    for v, vec in vectors.items():
        assert vec.size == len(names) and list(vec.indices) == ([place[v]] if v in place else [])
    with pytest.raises(ValueError):
        codes.to_json()


def test_dummies_of_many_levels(spark):
    """Columns beyond the list limit become a sparse vector; nulls have a place of their own."""
    from touchline.operators.encoders import dummy_encode
    rows = spark.range(12_002).select("id", F.when(F.col("id") < 12_000, F.concat(F.lit("no "), F.col("id").cast("string"))).alias("name"),
                                      F.when(F.col("id") % 2 == 0, "x y").alias("side"))
    out = dummy_encode(rows, ["name", "side"])
    assert out.columns == ["id", "side_x_y", "side_null", "name_levels"]
    place = {v: i for i, v in enumerate(sorted(f"no_{i}" for i in range(12_000)))}
    for r in out.collect():
        assert r.name_levels.size == 12_001 and (r.side_x_y, r.side_null) == (1 - r.id % 2, r.id % 2)
        assert list(r.name_levels.indices) == [place.get(f"no_{r.id}", 12_000)]

import math

import pytest
from pyspark.sql import functions as F

from conftest import table
from tabtune.operators import encode as E
from tabtune.operators import scale as S
from tabtune.operators import split as SP
from tabtune.plans import prepare as P


def test_hash_split_disjoint_complete_and_layout_free(spark):
    o = table(spark, "orders", "/root/testdata/sf0.01")
    a = SP.train_test_split(o, "o_orderkey")
    b = SP.train_test_split(o.repartition(7), "o_orderkey")
    ta = {r[0] for r in a.where("split = 'test'").select("o_orderkey").collect()}
    tb = {r[0] for r in b.where("split = 'test'").select("o_orderkey").collect()}
    assert ta == tb and len(ta) == 3016
    assert a.count() == o.count()


def test_exact_and_stratified_sizes(spark):
    o = table(spark, "orders", "/root/testdata/sf0.01")
    ex = SP.train_test_split(o, "o_orderkey", exact=True)
    assert ex.where("split = 'test'").count() == math.ceil(0.2 * 15000)
    st = SP.stratified_split(o, "o_orderstatus", "o_orderkey")
    counts = {r[0]: (r[1], r[2]) for r in st.groupBy("o_orderstatus").agg(
        F.sum(F.when(F.col("split") == "test", 1).otherwise(0)), F.count(F.lit(1))).collect()}
    for cls, (test_n, n) in counts.items():
        assert test_n == math.ceil(0.2 * n)


def test_encoder_sorted_codes_and_roundtrip(spark):
    part = table(spark, "part")
    enc = E.fit_label_encoder(part, ["p_type", "p_brand"])
    types = [r["value"] for r in enc.where("column = 'p_type'").orderBy("code").collect()]
    assert types == sorted(types)
    coded = E.apply_label_encoder(part, enc, ["p_type", "p_brand"])
    back = E.decode(coded, enc, ["p_type", "p_brand"])
    assert back.select("p_partkey", "p_type", "p_brand").exceptAll(
        part.select("p_partkey", "p_type", "p_brand")).count() == 0


def test_unseen_label_error_and_keep(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("a",), ("z",)], "c string")
    enc = E.fit_label_encoder(train, ["c"])
    kept = E.apply_label_encoder(test, enc, ["c"], unseen="keep").collect()
    assert sorted(r[0] for r in kept) == [0, 2]
    with pytest.raises(Exception):
        E.apply_label_encoder(test, enc, ["c"]).collect()


def test_large_mapping_uses_join_path(spark):
    cust = table(spark, "customer", "/root/testdata/sf0.01")
    out, enc = E.encode_all(cust, ["c_name"])
    assert enc.count() == 1500 and out.select("c_name").distinct().count() == 1500


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (6.0, 5.0)], "x double, k double")
    sc = S.fit_scaler(df, ["x", "k"])
    out = S.apply_scaler(df, sc)
    row = out.agg(F.avg("x"), F.stddev_pop("x"), F.max("k")).first()
    assert row[0] == pytest.approx(0.0, abs=1e-12) and row[1] == pytest.approx(1.0)
    assert row[2] == 0.0  # zero std divides by one


def test_transform_supervised_layout(spark):
    o = table(spark, "orders").drop("o_orderdate")
    out, st = P.transform(o, "classification", "o_orderstatus", key="o_orderkey")
    assert out.columns[0] == "o_orderkey" and out.columns[-2:] == ["o_orderstatus", "split"]
    assert st.categorical == ["o_orderpriority"]
    train = out.where("split = 'train'")
    for c in st.features:
        m, s = train.agg(F.avg(c), F.stddev_pop(c)).first()
        assert m == pytest.approx(0, abs=1e-9) and s == pytest.approx(1)
    prof = P.task_profile(out, "classification", st.label, st.features).first()
    assert prof["n_predictors"] == 3 and prof["n_classes"] == 3 and prof["direction"] == "max"


def test_transform_other_task_unchanged(spark):
    o = table(spark, "orders")
    out, _ = P.transform(o, "ranking")
    assert out.columns == o.columns


def test_exact_split_with_equal_keys(spark):
    from tabtune.operators import split as SP
    rows = [("a" if i < 60 else f"k{i}", i % 4, "x") for i in range(100)]
    df = spark.createDataFrame(rows + rows[:20], "k string, v int, c string")
    for seed in range(3):
        for out in (SP.train_test_split(df, "k", 0.2, seed, exact=True), SP.stratified_split(df, "c", "k", 0.2, seed)):
            got = out.groupBy("split").count().collect()
            assert {r[0]: r[1] for r in got} == {"test": 24, "train": 96}
            assert out.columns == ["k", "v", "c", "split"]
    odd = spark.createDataFrame([("x:y", "z"), ("x", "y:z"), ("x:y:z", None)] * 5, "a string, b string")
    assert SP.train_test_split(odd, exact=True).where("split = 'test'").count() == 3


def test_dates_are_categories_with_a_code_for_unseen_ones(spark):
    import datetime
    rows = [(i, datetime.date(2020, 1, 1 + i % 3 if i < 40 else 20 + i % 5), datetime.datetime(2021, 1, 1, i % 2),
             i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, d date, t timestamp, y int")
    out, state = P.transform(df, "classification", "y", key="id")
    assert state.features == ["d", "t"] and set(state.categorical) == {"d", "t"}
    assert out.where("d IS NULL OR t IS NULL").count() == 0
    split = SP.train_test_split(df, "id")
    known = sorted({str(r.d) for r in split.where("split = 'train'").collect()})
    codes = {r.id: (known.index(str(r.d)) if str(r.d) in known else len(known)) for r in split.collect()}
    want = [codes[r.id] for r in split.where("split = 'train'").collect()]
    mean, std = sum(want) / len(want), (sum(w * w for w in want) / len(want) - (sum(want) / len(want)) ** 2) ** 0.5
    assert all(r.d == pytest.approx((codes[r.id] - mean) / std) for r in out.collect())
    assert P.transform(df.drop("y"), "clustering", key="id")[0].count() == 60


def test_nested_columns_are_named_before_any_job(spark):
    df = spark.createDataFrame([(1, [1.0], {"a": 1}, 0)], "id int, v array<double>, m map<string,int>, y int")
    for task in ("regression", "classification", "clustering"):
        with pytest.raises(ValueError, match="v .array.*m .map"):
            P.transform(df, task, "y", key="id")
    out, _ = P.transform(df.drop("v", "m"), "regression", "y", key="id")
    assert "v" not in out.columns

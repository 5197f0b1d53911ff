import pytest
from pyspark.sql import functions as F

from conftest import IRIS, MALL, needs, table
from tabtune.operators import clean as C
from tabtune.sources.tables import read_table


@needs(IRIS)
def test_iris_outlier_gate(spark):
    iris = read_table(spark, IRIS)
    assert C.drop_outliers(iris).count() == 150          # SepalWidth is normal: skipped
    assert C.drop_outliers(iris, gate=False).count() == 146
    cleaned = C.clean(iris, "classification")
    assert cleaned.count() == 150 and "Id" not in cleaned.columns and len(cleaned.columns) == 5


@needs(MALL)
def test_mall_clean(spark):
    mall = read_table(spark, MALL)
    assert C.drop_outliers(mall).count() == 198
    cleaned = C.clean(mall, "clustering")
    assert cleaned.count() == 198 and cleaned.columns == ["Gender", "Age", "Annual Income (k$)",
                                                          "Spending Score (1-100)"]


def test_gate_off_keeps_only_in_bounds(spark):
    ev = table(spark, "events", "/root/testdata/sf0.01").select("event_id", "value")
    b = {r["column"]: r for r in C.column_quartiles(ev, ["value"]).collect()}["value"]
    kept = C.drop_outliers(ev, gate=False, exclude=["event_id"])
    assert kept.where((F.col("value") < b["lower"]) | (F.col("value") > b["upper"])).count() == 0
    assert kept.count() == 10000 - 463


def test_null_is_never_an_outlier(spark):
    rows = [(float(i),) for i in range(20)] + [(1000.0,), (None,)]
    df = spark.createDataFrame(rows, "x double")
    out = C.drop_outliers(df, gate=False)
    vals = [r[0] for r in out.collect()]
    assert None in vals and 1000.0 not in vals and len(vals) == 21


def test_labels_minority_removed(spark):
    labels = table(spark, "labels", "/root/testdata/sf0.01")
    out = C.drop_outliers(labels)
    assert out.count() == 299  # only (quality 1, toxic 0) rows survive
    assert out.where("quality = 0").count() == 0 and out.where("toxic = 1").count() == 0


def test_cardinality_rule(spark):
    orders = table(spark, "orders", "/root/testdata/sf0.01")
    card = {r["column"]: r for r in C.cardinality(orders).collect()}
    assert card["o_orderkey"]["is_id_like"] and card["o_orderkey"]["ratio"] == 1.0
    assert not card["o_totalprice"]["is_id_like"]
    assert card["o_totalprice"]["ratio"] == pytest.approx(0.99993, abs=1e-5)
    sup = C.drop_id_like(table(spark, "supplier", "/root/testdata/sf0.01"))
    assert sup.columns == ["s_nationkey", "s_acctbal"]
    approx = {r["column"]: r["is_id_like"] for r in C.cardinality(orders, approx=True).collect()}
    assert approx == {c: r["is_id_like"] for c, r in card.items()}


def test_null_and_duplicate_drop(spark):
    ev = table(spark, "events", "/root/testdata/sf0.01").select(
        "event_id", F.expr("nullif(event_type, 'error')").alias("event_type"))
    assert C.drop_null_rows(ev).count() == 7986
    li = table(spark, "lineitem").select("l_returnflag", "l_linestatus")
    assert C.drop_duplicate_rows(li).count() == li.distinct().count()


def test_filter_pushes_down_to_parquet(spark):
    ev = table(spark, "events", "/root/testdata/sf0.01").select("event_id", "user_id", "value")
    out = C.drop_outliers(ev)
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln][0]
    assert "PushedFilters: [Or(IsNull(event_id),And(GreaterThanOrEqual(event_id," in scan


def test_nan_is_missing_not_outlier(spark):
    rows = [(float(i),) for i in range(20)] + [(1000.0,), (float("nan"),), (None,)]
    df = spark.createDataFrame(rows, "x double")
    out = [r[0] for r in C.drop_outliers(df, gate=False).collect()]
    assert 1000.0 not in out and len(out) == 22 and any(v != v for v in out if v is not None)

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import IRIS, MALL, needs, table
from tabtune.functions.columns import column_roles, label_last, split_features_target
from tabtune.operators import models as M
from tabtune.plans import prepare as P
from tabtune.sources.models import load_model, save_model
from tabtune.sources.tables import preview, read_table, write_results


@needs(MALL)
def test_csv_types_and_roles(spark):
    mall = read_table(spark, MALL)
    types = dict((f.name, f.dataType.simpleString()) for f in mall.schema.fields)
    assert types == {"CustomerID": "int", "Gender": "string", "Age": "int",
                     "Annual Income (k$)": "int", "Spending Score (1-100)": "int"}
    roles = {r["column"]: r["role"] for r in column_roles(mall).collect()}
    assert roles["Spending Score (1-100)"] == "label" and roles["Gender"] == "categorical"


def test_csv_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="tabtune-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as fh:
        fh.write("a,b,c\n1,x,2.5\nNA,,nan\n3,None,4\n")
    df = read_table(spark, path)
    rows = df.orderBy(F.col("a").asc_nulls_last()).collect()
    assert [r["a"] for r in rows] == [1, 3, None]
    assert rows[2]["b"] is None and rows[2]["c"] is None and rows[1]["b"] is None
    assert dict((f.name, f.dataType.simpleString()) for f in df.schema.fields) == {
        "a": "int", "b": "string", "c": "double"}


def test_label_last_and_preview(spark):
    cust = table(spark, "customer")
    out, feats, label = split_features_target(cust, None)
    assert label == "c_mktsegment" and out.columns[-1] == label and len(feats) == 4
    assert label_last(cust, "c_custkey").columns[-1] == "c_custkey"
    top = preview(cust, 5, order_by="c_custkey").collect()
    keys = sorted(r[0] for r in cust.select("c_custkey").collect())
    assert [r["c_custkey"] for r in top] == keys[:5]


def test_save_load_model_same_predictions(spark):
    o = table(spark, "orders").drop("o_orderdate")
    prep, st = P.transform(o, "classification", "o_orderstatus", key="o_orderkey")
    model = M.fit_forest_classifier(prep.where("split = 'train'"), st.features, st.label,
                                    {"n_estimators": 5, "max_depth": 5})
    path = os.path.join(tempfile.mkdtemp(prefix="tabtune-model-"), "best")
    save_model(model, path)
    again = load_model(path)
    test = prep.where("split = 'test'")
    a = M.predict(model, test).select("o_orderkey", "prediction")
    b = M.predict(again, test).select("o_orderkey", "prediction")
    assert a.exceptAll(b).count() == 0 and a.count() == test.count()
    out = os.path.join(tempfile.mkdtemp(prefix="tabtune-out-"), "metrics")
    write_results(a, out)
    assert spark.read.parquet(out).count() == a.count()


def _forest_rows(spark):
    rows = [(i, i * 37 % 101 / 10.0, i * i % 89, "abc"[i * 7 % 3], float(i * 13 % 97), "xyz"[i * i % 3])
            for i in range(600)]
    return spark.createDataFrame(rows + rows[:20], "id int, a double, b int, c string, v double, y string").repartition(3)


@pytest.mark.parametrize("task", ["regression", "classification"])
def test_counted_fit_holds_one_narrow_copy(spark, monkeypatch, task):
    """The rows counted with the scaler give the layout, and so the trees, of a fit that counts
    them itself; the train rows are cached once, without keys and split."""
    df, label, fit = (_forest_rows(spark).drop("y"), "v", M.fit_forest_regressor) if task == "regression" else (
        _forest_rows(spark).drop("v"), "y", M.fit_forest_classifier)
    prep, st = P.transform(df, task, label, key="id")
    train = prep.where("split = 'train'")
    assert st.n_train == train.count()
    monkeypatch.setattr(M, "FIT_ROWS", 64)        # several partitions
    held, persist = [], type(df).persist
    monkeypatch.setattr(type(df), "persist", lambda self, *a: (held.append(self.columns), persist(self, *a))[1])
    params = {"n_estimators": 4, "max_depth": 4}
    plain = fit(train, st.features, st.label, params).stages[-1].toDebugString
    held.clear()
    counted = fit(train, st.features, st.label, params, n_rows=st.n_train).stages[-1].toDebugString
    assert held == [[*st.features, st.label]]
    assert counted.split("\n", 1)[1] == plain.split("\n", 1)[1]


def test_balanced_fit_keeps_its_weights(spark):
    prep, st = P.transform(_forest_rows(spark).drop("v"), "classification", "y", key="id")
    train = prep.where("split = 'train'")
    params = {"n_estimators": 3, "max_depth": 3, "class_weight": "balanced"}
    a, b = (M.fit_forest_classifier(train, st.features, st.label, params, n_rows=n).stages[-1].toDebugString
            for n in (None, st.n_train))
    assert a.split("\n", 1)[1] == b.split("\n", 1)[1]


def test_walked_trees_equal_cached_ones(spark, monkeypatch):
    prep, st = P.transform(_forest_rows(spark).drop("v"), "classification", "y", key="id")
    train, trees = prep.where("split = 'train'"), []
    for most in (M.NODE_NUMBERS, 100):
        monkeypatch.setattr(M, "NODE_NUMBERS", most)
        model = M.fit_forest_classifier(train, st.features, st.label, {"n_estimators": 5, "max_depth": 6}, n_rows=st.n_train)
        trees.append(model.stages[-1].toDebugString.split("\n", 1)[1])
    assert trees[0] == trees[1]
    shallow, deep = {"n_estimators": 20, "max_depth": 10}, {"n_estimators": 20, "max_depth": None}
    monkeypatch.setattr(M, "NODE_NUMBERS", 2**29)
    assert [M.forest_params(p, 4, "classification", n_rows=n)["cacheNodeIds"] for p, n in (
        (shallow, None), (shallow, 10**6), (shallow, 10**8), (deep, 10**8))] == [True, True, False, True]


def test_regression_search_and_importance(spark):
    from tabtune.operators import importance as I
    from tabtune.plans import search as G
    li = table(spark, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount",
                                         "l_tax", "l_returnflag", "l_extendedprice")
    prep, st = P.transform(li, "regression", "l_extendedprice", key=["l_orderkey", "l_linenumber"])
    board, models, _ = G.compare_strategies(prep, "regression", st.features, st.label,
                                            "l_orderkey", strategies=("pso",), epochs=1, pop_size=2)
    row = board.first()
    assert row["Root Mean Squared Error (RMSE)"] == pytest.approx(
        row["Mean Squared Error (MSE)"] ** 0.5)
    imp = I.tree_importance(models["PSO"], st.features).collect()
    assert sum(r["Importance"] for r in imp) == pytest.approx(1.0)


def test_cluster_views_and_attach(spark):
    cust = table(spark, "customer")
    prep, st = P.transform(cust, "clustering", key="c_custkey")
    model = M.fit_kmeans(prep, st.features, 3, 10, n_init=2)
    lab = M.attach_clusters(prep, model)
    assert lab.select("Cluster").distinct().count() == 3
    views = M.cluster_views(lab, st.features, "Cluster", dims=3, key="c_custkey")
    assert views.count() == prep.count() * 4  # C(4, 3) column triples


def test_csv_like_a_data_frame_reader(spark, tmp_path):
    from tabtune.sources.tables import read_table
    path = tmp_path / "t.csv"
    path.write_text('code,n,text\n1d,1,"two\nlines"\n2f,NA,"a ""quoted"" word"\n3D,3,plain\n')
    df = read_table(spark, str(path))
    assert dict(df.dtypes) == {"code": "string", "n": "int", "text": "string"}
    assert [tuple(r) for r in df.orderBy("code").collect()] == [
        ("1d", 1, "two\nlines"), ("2f", None, 'a "quoted" word'), ("3D", 3, "plain")]
    given = read_table(spark, str(path), schema="code string, n int, text string")
    assert given.orderBy("code").collect() == df.orderBy("code").collect()
    with pytest.raises(ValueError):
        read_table(spark, str(path), schema="code string")


def test_csv_files_are_split_unless_a_quoted_break_needs_the_whole(spark, tmp_path):
    from tabtune.sources.tables import read_table
    plain = "a,b,c\n" + "".join(f'{i},"x, {i}",say ""{i}""\n' for i in range(4000))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one file.csv").write_text(plain)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = read_table(spark, str(tmp_path / "in"))
        assert df.rdd.getNumPartitions() > 4 and df.count() == 4000
        assert dict(df.dtypes)["a"] == "int" and df.where("a = 17").first()["b"] == "x, 17"
        (tmp_path / "in" / "two.csv").write_text('a,b,c\n-1,"line one\nline ""two""",z\n-2,NA,z\n')
        both = read_table(spark, str(tmp_path / "in"))
        assert both.count() == 4002 and both.where("a = -1").first()["b"] == 'line one\nline "two"'
        assert both.where("a = -2").first()["b"] is None and both.rdd.getNumPartitions() > 4
        (tmp_path / "in2").mkdir()
        (tmp_path / "in2" / "two.csv").write_text('a,b\n1,"x\ny"\n')
        assert read_table(spark, str(tmp_path / "in2")).first()["b"] == "x\ny"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

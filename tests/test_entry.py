import inspect
import math

import duckdb
import pytest

import __spark_entry__ as SE

FAST = ["column_quartiles", "drop_outliers_events", "train_test_split_exact", "transform_classification",
        "histograms", "classification_report", "cardinality"]


def test_entry_runs(spark):
    df = SE.entry(spark)
    assert df.columns == ["col_a", "col_b", "r"] and df.count() > 0


def test_every_query_has_twin_or_is_model_based():
    qs, sqls = SE.queries(), SE.oracle_sql()
    assert set(sqls) <= set(qs)
    rows_only = set(SE.QUERIES) - set(sqls)
    assert rows_only <= {"fit_forest_regressor", "fit_forest_classifier", "fit_kmeans",
                         "search_classification", "search_regression", "search_clustering", "search_history",
                         "tree_importance", "importance_report", "permutation_importance"}


@pytest.mark.parametrize("name", FAST)
def test_twins_agree_at_sf0001(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ["customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "labels"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = SE.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(r[c] for c in cols) for r in df.collect())
    res = con.execute(SE.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    exp = sorted(tuple(r[i] for i in idx) for r in res.fetchall())
    assert got == exp


#: Epochs and population of the registered searches, the largest that end (README).
BUDGETS = {"search_classification": (1, 1), "search_regression": (1, 2), "search_clustering": (2, 4),
           "search_history": (2, 4)}


@pytest.mark.parametrize("name", sorted(BUDGETS))
def test_searches_run_all_strategies_with_their_budget(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    signature = inspect.signature(SE.G.compare_strategies)

    def spy(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        raise Seen(bound.arguments)

    monkeypatch.setattr(SE.G, "compare_strategies", spy)
    with pytest.raises(Seen) as got:
        SE.queries()[name](spark, "/root/testdata/sf0.001")
    run = got.value.args[0]
    assert [SE.G.make_strategy(s, 10, 42).name for s in run["strategies"]] == ["ACO", "GA", "PSO", "SA"]
    assert (run["epochs"], run["pop_size"]) == BUDGETS[name] and run["silhouette_sample"] == 1.0
    defaults = signature.parameters
    assert (defaults["epochs"].default, defaults["pop_size"].default) == (10, 10)

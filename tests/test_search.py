import numpy as np
import pytest

from conftest import table
from tabtune.plans import space as SPC
from tabtune.plans import strategies as ST
from tabtune.plans import search as G


def sphere(units):
    return [float(((np.asarray(u) - 0.3) ** 2).sum()) for u in units]


class Stub:
    """A scorer that remembers every fitness it has given."""
    task, space = "regression", [None] * 4

    def __init__(self, nan_every=0):
        self.seen, self.nan_every = [], nan_every

    def params_of(self, u):
        return {"u": [float(x) for x in u]}

    def score(self, units):
        out = sphere(units)
        if self.nan_every:
            out = [float("nan") if (len(self.seen) + i) % self.nan_every == 0 else f for i, f in enumerate(out)]
        self.seen += out
        return out


@pytest.mark.parametrize("name", ["aco", "ga", "pso", "sa"])
def test_search_returns_the_best_of_all_evaluations(name):
    for seed in range(50):
        stub = Stub()
        params, fitness, history = G.run_search(stub, name, 10, 10, seed)
        assert fitness == min(stub.seen)
        assert sphere([params["u"]]) == [fitness]
    again = G.run_search(Stub(), name, 10, 10, 49)
    assert again == (params, fitness, history)


def test_missing_fitness_never_wins(spark):
    stub = Stub(nan_every=3)
    _, fitness, history = G.run_search(stub, "ga", 3, 5, 1)
    assert fitness == min(f for f in stub.seen if f == f)
    assert any(h[3] is None for h in history) and all(h[3] is None or h[3] == h[3] for h in history)
    hist = spark.createDataFrame([("A", 0, 0, float("nan")), ("A", 0, 1, 0.2), ("A", 1, 0, float("nan"))],
                                 "strategy string, generation int, agent int, fitness double")
    rows = G.search_history(hist, "classification").orderBy("generation").collect()
    assert [(r.gen_best, r.best_so_far) for r in rows] == [(0.2, 0.2), (None, 0.2)]
    board = spark.createDataFrame([("A", float("nan")), ("B", 0.5)],
                                  f"`{G.LEADER_NAME}` string, `{G.REFERENCE_METRIC['clustering']}` double")
    assert G.best_model(board, "clustering").first()[0] == "B"


def test_clustering_search_needs_a_key(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    with pytest.raises(ValueError, match="key"):
        G.compare_strategies(df, "clustering", ["a", "b"])


def test_decode_domains():
    space = SPC.space_for("RandomForestClassifier")
    low = SPC.decode([0.0] * len(space), space)
    high = SPC.decode([1.0] * len(space), space)
    assert low["n_estimators"] == 10 and high["n_estimators"] == 100
    assert low["criterion"] == "gini" and high["criterion"] == "log_loss"
    assert low["max_depth"] is None and high["max_features"] == 100
    assert SPC.space_for("RandomForestRegressor")[1].values == ("squared_error",)


def test_decode_dataframe_matches_python(spark):
    space_df = SPC.search_space(spark, "KMeans")
    pop = spark.createDataFrame([("ga", 0, 0, [0.0, 0.5, 0.99]), ("ga", 0, 1, [1.0, 0.0, 0.2])],
                                "strategy string, generation int, agent int, u array<double>")
    got = {(r["agent"], r["param"]): r["value"] for r in SPC.decode_candidates(pop, space_df).collect()}
    space = SPC.space_for("KMeans")
    for agent, u in ((0, [0.0, 0.5, 0.99]), (1, [1.0, 0.0, 0.2])):
        exp = SPC.decode(u, space)
        for k, v in exp.items():
            assert got[(agent, k)] == (None if v is None else str(v))


def test_repair_rules():
    p = SPC.repair({"bootstrap": False, "max_samples": 0.5}, "RandomForestClassifier", 3)
    assert p["max_samples"] is None and p["oob_score"] is False and p["monotonic_cst"] is None


def test_forest_param_mapping():
    from tabtune.operators.models import forest_params
    p = forest_params({"max_depth": 100, "max_features": 1, "criterion": "log_loss",
                       "n_estimators": 20}, 4, "classification")
    assert p["maxDepth"] == 30 and p["featureSubsetStrategy"] == "0.25"
    assert p["impurity"] == "entropy" and p["numTrees"] == 20
    with pytest.raises(ValueError):
        forest_params({"criterion": "poisson"}, 4, "regression")


def test_clustering_search_leaderboard(spark, tmp_path):
    from tabtune.operators import models as M
    from tabtune.sources.models import load_model, save_model
    from pyspark.sql import functions as F
    from tabtune.plans import prepare as P
    emb = table(spark, "embeddings")
    x = emb.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(4)])
    prep, st = P.transform(x, "clustering", key="vec_id")
    board, models, hist = G.compare_strategies(prep, "clustering", st.features, None, "vec_id",
                                               strategies=("ga", "sa"), epochs=1, pop_size=2)
    rows = board.collect()
    assert [r[G.LEADER_NAME] for r in rows] == ["GA", "SA"] and set(models) == {"GA", "SA"}
    # the best model is an ordinary Spark ML model: saved, read back, same labels
    save_model(models["GA"], str(tmp_path / "m"))
    again = M.predict(load_model(str(tmp_path / "m")), prep, "Cluster").orderBy("vec_id")
    assert again.collect() == M.predict(models["GA"], prep, "Cluster").orderBy("vec_id").collect()
    best = G.best_model(board, "clustering").first()
    assert best["Silhouette Score"] == max(r["Silhouette Score"] for r in rows)
    h = G.search_history(hist, "clustering").orderBy("strategy", "generation").collect()
    for s in ("GA", "SA"):
        bs = [r["best_so_far"] for r in h if r["strategy"] == s]
        assert bs == sorted(bs)


def test_restart_cache_equals_plain_fits(spark):
    """Over cut and converged fits, in any order of asking."""
    from pyspark.ml.clustering import KMeans
    from tabtune.operators import models as M
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.6, (40, 2)) for c in ((0, 0), (4, 0), (0, 4), (5, 5))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").coalesce(1)
    data = M.vectors(df, ["a", "b"]).persist()
    cache = M.RestartCache(data)
    wanted = [(k, m, n) for k in (2, 4) for m in (30, 1, 3, 100) for n in (1, 3)]
    fits = 0
    while todo := cache.missing(wanted):
        fits += len(todo)
        for job in todo:
            cache.fit(job)
    assert fits < sum(n for *_, n in wanted)
    for k, m, n in wanted:
        plain = [KMeans(k=k, maxIter=m, seed=M.SEED + r, featuresCol="features").fit(data) for r in range(n)]
        best = min(plain, key=lambda f: f.summary.trainingCost)
        got = cache.best(k, m, n)
        assert got.cost == best.summary.trainingCost
        assert np.array_equal(got.model.clusterCenters(), best.clusterCenters())


def test_restarts_run_together_equal_plain_fits(spark):
    """Cut, resumed and converged fits; one job an iteration for all of them."""
    from tabtune.operators import models as M
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.8, (60, 2)) for c in ((0, 0), (4, 0), (0, 4), (5, 5))])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(3)
    df = df.persist()
    data = M.vectors(df, ["a", "b"]).persist()
    plain, cache = M.RestartCache(data), M.RestartCache(data)
    jobs = []
    for wanted in ([(3, 2, 2), (3, 5, 1), (6, 40, 2)], [(3, 60, 2), (3, 1, 1), (6, 3, 3)]):
        while todo := cache.missing(wanted):
            jobs += todo
            cache.fit_many(todo, wanted)
        while todo := plain.missing(wanted):
            for job in todo:
                plain.fit(job)
        for k, m, n in wanted:
            a, b = plain.best(k, m, n), cache.best(k, m, n)
            assert a.name == b.name and a.cost == pytest.approx(b.cost, rel=1e-9)
            assert np.allclose(a.centers, b.centers, rtol=0, atol=1e-9)
            assert np.allclose(cache.model(b).clusterCenters(), b.centers, rtol=0, atol=1e-9)
            labelled, (name,) = M.label_many([b], df, ["a", "b"])
            alone = M.predict(M.kmeans_pipeline(["a", "b"], a.model), labelled, "Cluster")
            assert alone.where(f"Cluster <> {name}").count() == 0 and labelled.count() == 240
    assert set(plain.converged) == set(cache.converged) and set(plain.cut) == set(cache.cut)
    assert len(cache.starts) == len({j[:2] for j in jobs})


def test_report_takes_the_known_silhouette(spark, monkeypatch):
    from tabtune.operators import cluster_metrics as CM
    from tabtune.operators import models as M
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.5, (30, 2)) for c in ((0, 0), (4, 4))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double")
    scorer = G.Scorer(df, "clustering", ["a", "b"], key="id")
    units = [[0.0, 0.5, 0.0], [0.2, 0.5, 0.3]]
    fitness = scorer.score(units)
    lab = M.predict(scorer.fit(scorer.params_of(units[0])), scorer.data, "Cluster")
    full = CM.clustering_report(lab, ["a", "b"], "Cluster", "id").first()
    monkeypatch.setattr(CM, "silhouette", lambda *a, **k: pytest.fail("computed again"))
    got, _ = scorer.report(scorer.params_of(units[0]))
    scorer.close()
    assert list(got.values()) == pytest.approx(list(full), rel=1e-9)
    assert fitness[0] == pytest.approx(full["silhouette"], rel=1e-9)


def test_copies_of_one_block_are_made_in_several_tasks(spark, monkeypatch):
    """Whatever number of tasks shares a block, the copies are the same ones."""
    import pyarrow as pa
    from tabtune.operators import importance as I
    from tabtune.operators import models as M
    assert I.shares(1, 64, 12) == 12 and I.shares(1, 3, 12) == 3
    assert I.shares(5, 64, 12) == 3 and I.shares(100, 64, 12) == 1 and I.shares(0, 0, 12) == 1
    rng = np.random.default_rng(6)
    x, label = rng.normal(size=(20, 5)), rng.integers(0, 2, 20).astype(float)

    def copies(n_shares):
        got = {}
        for at in range(2 * n_shares):
            blk = at // n_shares
            some = pa.RecordBatch.from_arrays([pa.array([at] * 10, pa.int64()), pa.array(label[blk * 10:blk * 10 + 10]),
                                               pa.array(list(x[blk * 10:blk * 10 + 10]))], names=["_at", "_label", "_x"])
            for out in I._copies(5, 3, 42, n_shares)(iter([some])):
                f, r = out["_f"][0].as_py(), out["_r"][0].as_py()
                assert (f, r, blk) not in got
                got[f, r, blk] = out["_label"].to_pylist(), out["_x"].to_pylist()
        return got
    assert len(copies(1)) == 5 * 3 * 2 and copies(1) == copies(2) == copies(5)

    x = rng.normal(size=(150, 3))
    df = spark.createDataFrame([(i, int(r[0] > 0), *map(float, r)) for i, r in enumerate(x)],
                               "id int, Cluster int, a double, b double, c double")
    model = M.fit_forest_classifier(df, ["a", "b", "c"], "Cluster", {"n_estimators": 3, "max_depth": 4})
    seen = []
    for n in (3, 1):
        monkeypatch.setattr(I, "shares", lambda *a, n=n: n)
        rows = I.permutation_importance(df, ["a", "b", "c"], "Cluster", "id", model=model).orderBy("Feature").collect()
        seen.append([(r[0], round(r[1], 12), round(r[2], 12)) for r in rows])
    assert len(seen[0]) == 3 and seen[0] == seen[1] and seen[0][0][1] > 0.1


def test_wide_space_domains():
    space = {p.name: p for p in SPC.space_for("RandomForestClassifier", wide=True)}
    assert (space["n_estimators"].lb, space["n_estimators"].ub) == (1, 100)
    assert (space["min_samples_leaf"].lb, space["min_samples_leaf"].ub) == (2, 100)
    assert (space["min_impurity_decrease"].lb, space["min_impurity_decrease"].ub) == (1.0, 100.0)
    assert space["max_samples"].values == ("none", 5, 10, 15)
    assert space["class_weight"].values == ("none", "balanced", "balanced_subsample")
    assert "class_weight" not in {p.name for p in SPC.space_for("RandomForestRegressor", wide=True)}
    kmeans = {p.name: p for p in SPC.space_for("KMeans", wide=True)}
    assert (kmeans["n_clusters"].ub, kmeans["max_iter"].lb, kmeans["n_init"].values[-1]) == (20, 100, 20)
    p = SPC.repair({"bootstrap": False, "oob_score": True, "max_samples": 5, "monotonic_cst": -1,
                    "class_weight": "balanced", "warm_start": True}, "RandomForestClassifier", 2)
    assert p == {"bootstrap": False, "oob_score": False, "max_samples": None, "monotonic_cst": None,
                 "class_weight": "balanced", "warm_start": False}


def test_wide_search_with_weights_and_rows(spark):
    from tabtune.operators import models as M
    labels = table(spark, "labels").withColumnRenamed("toxic", "x")
    from pyspark.sql import functions as F
    prep = labels.withColumn("split", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train"))
    board, _, _ = G.compare_strategies(prep, "classification", ["x"], "quality", "doc_id", strategies=("ga",),
                                       epochs=1, pop_size=2, wide=True)
    assert board.count() == 1 and board.first()["Fits run"] >= 1
    assert M.forest_params({"max_samples": 5}, 3, "regression", n_rows=50)["subsamplingRate"] == 0.1
    rows = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10 + [(None,)] * 2, "y int")
    got = {(r.y, round(r.w, 6)) for r in M.class_weights(rows.where("y IS NOT NULL"), "y", "w").collect()}
    assert got == {(0, round(40 / 60, 6)), (1, 2.0)}


def test_permutation_importance_against_brute_force(spark, monkeypatch):
    """The same permutations made by hand, block by block."""
    from pyspark.sql import functions as F
    from tabtune.operators import importance as I
    from tabtune.operators import models as M
    from tabtune.operators.split import key_text, train_test_split
    monkeypatch.setattr(I, "BLOCK_ROWS", 17)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3)).round(3)
    rows = [(i, *map(float, v), int(v[0] + 0.3 * v[1] > 0)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, Cluster int").repartition(5)
    feats = ["a", "b", "c"]
    split = train_test_split(df, "id")
    model = M.fit_forest_classifier(split.where("split = 'train'"), feats, "Cluster", {"n_estimators": 5, "max_depth": 4})
    got = {r["Feature"]: r for r in I.permutation_importance(df, feats, key="id", n_repeats=3, model=model).collect()}
    test = split.where("split = 'test'").withColumn("h", F.xxhash64(key_text(df, "id"), F.lit(42))).orderBy("h").collect()
    n = len(test)
    blocks = -(-n // 17)
    block = np.array([i * blocks // n for i in range(n)])
    y = np.array([r.Cluster for r in test])

    def accuracy(m):
        frame = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(m)], "i int, a double, b double, c double")
        p = {r.i: r.prediction for r in M.predict(model, frame).collect()}
        return np.mean([p[i] == y[i] for i in range(n)])
    base = np.array([[r.a, r.b, r.c] for r in test])
    for f, name in enumerate(feats):
        drops = []
        for r in range(3):
            m = base.copy()
            for b in range(blocks):
                own = np.flatnonzero(block == b)
                m[own, f] = base[own, f][I.permutation(42, f, r, b, len(own))]
            drops.append(accuracy(base) - accuracy(m))
        assert got[name]["Importance Mean"] == pytest.approx(np.mean(drops), abs=1e-12)
        assert got[name]["Importance Std"] == pytest.approx(np.std(drops), abs=1e-12)


def test_linear_importance(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    from tabtune.operators import importance as I
    df = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i - 5.0 * (i % 3)) for i in range(30)], "a double, b double, y double")
    model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"),
                             LinearRegression(labelCol="y")]).fit(df)
    got = {r["Feature"]: r["Importance"] for r in I.linear_importance(model, ["a", "b"]).collect()}
    assert got["a"] == pytest.approx(2.0, abs=1e-6) and got["b"] == pytest.approx(5.0, abs=1e-6)


def test_forest_strategies_search_side_by_side(spark):
    """Each waits for the others to begin; rows and models are those of a search alone."""
    import threading

    rng = np.random.default_rng(4)
    rows = [(i, *map(float, r), float(r[0] * 3 + r[1]), "test" if i % 5 == 0 else "train")
            for i, r in enumerate(rng.normal(size=(80, 3)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, y double, split string")

    class Fixed(ST.Strategy):
        def __init__(self, name, trees, begun=None):
            super().__init__(2)
            self.name, self.trees, self.begun = name, trees, begun

        def init(self, rng, dim, evaluate):
            if self.begun is not None:
                self.begun.wait(120)
            x = np.full((2, dim), 0.3)      # of depth 10
            x[:, 0] = self.trees
            return ST.Population(x, np.asarray(evaluate(x)))

        def step(self, rng, pop, gen, evaluate):
            return pop

    def plain(board):
        return [{k: v for k, v in r.asDict().items() if k != G.TIME_COL} for r in board.collect()]

    made = {"one": (0.0, 0.05), "two": (0.02, 0.0), "three": (0.0, 0.05)}
    begun = threading.Barrier(3)
    board, models, hist = G.compare_strategies(df, "regression", ["a", "b", "c"], "y", "id", epochs=1, pop_size=2,
                                               strategies=[Fixed(n, t, begun) for n, t in made.items()])
    got, tried = plain(board), [tuple(r) for r in hist.collect()]
    assert [r[G.LEADER_NAME] for r in got] == list(models) == list(made)
    assert [r["Fits run"] for r in got] == [2, 2, 2] and [r["Fits asked"] for r in got] == [3, 3, 3]
    alone, alone_tried = [], []
    for n, t in made.items():
        board, _, hist = G.compare_strategies(df, "regression", ["a", "b", "c"], "y", "id", epochs=1, pop_size=2,
                                              strategies=[Fixed(n, t)])
        alone += plain(board)
        alone_tried += [tuple(r) for r in hist.collect()]
    assert tried == alone_tried
    for a, b in zip(got, alone):
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)

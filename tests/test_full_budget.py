"""The registered searches do the reference's whole work: 10 epochs of 10 candidates for each of
the four strategies, and 25 samples in an epoch of the colony."""
import inspect

import numpy as np
import pytest

import __spark_entry__ as SE

WHOLE = ["search_classification", "search_clustering", "search_regression"]
CANDIDATES = {"ACO": 10 + 10 * 25, "GA": 10 + 10 * 10, "PSO": 10 + 10 * 10, "SA": 10 + 10 * 10}


class Stub:
    task, space = "regression", [None] * 4

    def __init__(self):
        self.seen = 0

    def params_of(self, u):
        return {}

    def score(self, units):
        self.seen += len(units)
        return [float(np.sum(u)) for u in units]


@pytest.mark.parametrize("name", WHOLE)
def test_search_scores_every_candidate_of_the_whole_budget(spark, monkeypatch, name):
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
    run, seen = got.value.args[0], {}
    for spec in run["strategies"]:
        stub = Stub()
        SE.G.run_search(stub, spec, run["epochs"], run["pop_size"], run["seed"])
        seen[SE.G.make_strategy(spec, run["pop_size"], run["seed"]).name] = stub.seen
    assert seen == CANDIDATES and run["silhouette_sample"] == 1.0


def _points(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.7, (30, 2)) for c in ((0, 0), (4, 0), (0, 4), (5, 5))])
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double").repartition(2)


def test_clustering_strategies_search_in_step(spark, monkeypatch):
    """One silhouette job a generation for all strategies; rows, counts of fits and history are those of strategies that search one after the other."""
    from tabtune.operators import cluster_metrics as CM
    from tabtune.operators import models as M
    G, jobs, many = SE.G, [], CM.silhouette_many
    df = _points(spark)
    monkeypatch.setattr(CM, "silhouette_many", lambda *a, **k: (jobs.append(len(a[3])), many(*a, **k))[1])
    board, models, hist = G.compare_strategies(df, "clustering", ["a", "b"], key="id", epochs=1, pop_size=3)
    assert len(jobs) <= 2 and max(jobs) > 3
    jobs.clear()
    shared = G.Scorer(df, "clustering", ["a", "b"], key="id")
    rows, tried = [], []
    for name in ("aco", "ga", "pso", "sa"):
        own = shared.view()
        params, _, some = G.run_search(own, name, 1, 3)
        metrics, _ = own.report(params)
        rows.append((list(metrics.values()), own.n_asked, own.n_fits))
        tried += some
    shared.close()
    assert len(jobs) > 3
    got = board.collect()
    assert [r[G.LEADER_NAME] for r in got] == list(models) == ["ACO", "GA", "PSO", "SA"]
    names = list(G._metric_names("clustering").values())
    for r, (metrics, asked, fits) in zip(got, rows):
        assert [r[n] for n in names] == pytest.approx(metrics, rel=1e-9)
        assert (r["Fits asked"], r["Fits run"]) == (asked, fits)
    history = [tuple(r) for r in hist.collect()]
    assert [h[:3] + h[4:] for h in history] == [h[:3] + h[4:] for h in tried]
    assert [h[3] for h in history] == pytest.approx([h[3] for h in tried], rel=1e-9)


def test_a_failing_round_fails_the_search(spark, monkeypatch):
    from tabtune.operators import cluster_metrics as CM
    monkeypatch.setattr(CM, "silhouette_many", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        SE.G.compare_strategies(_points(spark), "clustering", ["a", "b"], key="id", epochs=1, pop_size=2)

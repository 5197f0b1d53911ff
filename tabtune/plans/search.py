"""Scoring candidate populations as Spark jobs, strategy
comparison, leaderboard, best model and search history.

Scoring (G3): train/test rows are persisted once for the whole search.
Forest candidates of one generation are fitted concurrently (a driver
thread pool submits Spark ML jobs; the FAIR scheduler interleaves them on
the executors).  Strategies over forests know nothing of each other, so they
search side by side; of all of them together at most ``parallelism`` fits are
under way.  The silhouette of the whole generation is computed in *one* job that shares
the pairwise distance blocks between candidates.  K-Means candidates start from
Spark ML's centres (seeded from all rows) and move on together, one job an
iteration; their restarts come from ``models.RestartCache``, so each (k, seed)
is fitted once as far as its iterations allow, and equal centres are scored
once.  The strategies search in step: what all of them want scored next is one
generation of fits and one silhouette job.  A strategy's best restart becomes a Spark ML model for the report, which
takes the silhouette the search has found for it.
The counts of restarts asked for and fitted stand in ``Scorer.n_asked`` and
``Scorer.n_fits``.
Within one strategy, candidates that decode to the same Spark ML parameters
are scored once (memo); the strategies' times overlap.  A fitness that is
not a number counts as missing: it never wins and is null in the history.

The objective follows the reference: test MSE (regression), macro F1 on
the test rows (classification, even for two classes), silhouette over all
rows (clustering); scored on the same test rows as the final report.
"""

from __future__ import annotations

import copy
import json
import math
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabtune.functions.columns import q
from tabtune.operators import cluster_metrics as CM
from tabtune.operators import metrics as K
from tabtune.operators import models as M
from tabtune.plans.prepare import MODEL_OF_TASK, REFERENCE_METRIC
from tabtune.plans.space import decode, repair, space_for
from tabtune.plans.strategies import Strategy, make_strategy

LEADER_NAME = "Metaheuristic Optimizer (Name)"
TIME_COL = "Time taken (s)"
FIT_COLS = ["Fits asked", "Fits run"]
REGRESSION_COLS = ["mse", "rmse", "mae", "mape", "r2", "adjusted_r2", "explained_variance"]
CLASSIFICATION_COLS = ["accuracy", "precision", "recall", "f1"]
CLUSTERING_COLS = ["silhouette", "davies_bouldin", "calinski_harabasz"]


def _metric_names(task):
    if task == "regression":
        return dict(zip(REGRESSION_COLS, K.REGRESSION_METRICS))
    if task == "classification":
        return dict(zip(CLASSIFICATION_COLS, K.CLASSIFICATION_METRICS))
    return dict(zip(CLUSTERING_COLS, K.CLUSTERING_METRICS))


def _memory_gb(text: str) -> float:
    units = {"k": 1 / 1024 ** 2, "m": 1 / 1024, "g": 1.0, "t": 1024.0}
    text = text.strip().lower().rstrip("b")
    return float(text[:-1]) * units[text[-1]] if text[-1] in units else float(text) / 1024 ** 3


def _fit_parallelism(spark: SparkSession, wanted: int) -> int:
    """In local mode every concurrent forest fit lives in the driver heap:
    allow one fit per 4 GB of it.  On a cluster the fits' work sits on the
    executors and ``wanted`` is used as given."""
    conf = spark.sparkContext.getConf()
    if not conf.get("spark.master", "").startswith("local"):
        return wanted
    heap = _memory_gb(conf.get("spark.driver.memory", "1g"))
    return max(1, min(wanted, int(heap // 4)))


class Rounds:
    """Strategies that search in step.  Each hands in what it wants scored next and waits;
    when all that still search have done so, ``run`` gets the wishes of all of them, in
    their order."""

    def __init__(self, run, lanes):
        self.run, self.active, self.waiting, self.error = run, set(lanes), {}, None
        self.turn = threading.Condition()

    def ask(self, lane: int, wish) -> None:
        with self.turn:
            self.waiting[lane] = wish
            self._go()
            self.turn.wait_for(lambda: lane not in self.waiting)
            if self.error is not None:
                raise self.error

    def leave(self, lane: int) -> None:
        with self.turn:
            self.active.discard(lane)
            self._go()

    def _go(self) -> None:
        if self.waiting and self.active <= set(self.waiting):
            try:
                self.run([self.waiting[lane] for lane in sorted(self.waiting)])
            except BaseException as error:      # for all that wait
                self.error = error
            self.waiting.clear()
            self.turn.notify_all()


@dataclass
class Scorer:
    """Turns unit vectors into fitness values (natural direction)."""
    prepared: DataFrame
    task: str
    features: list
    label: str | None = None
    key: str | None = None
    parallelism: int = 4
    wide: bool = False
    silhouette_sample: float = 1.0
    memo: dict = field(default_factory=dict)
    kept: dict = field(default_factory=dict)     # the model of the best forest so far
    n_fits: int = 0
    n_asked: int = 0
    lane: int = 0                                # names the scheduler pools of a strategy
    rounds: Rounds | None = None                 # if K-Means strategies search in step
    asked: list = field(default_factory=list)    # the K-Means fits wanted, in the order of asking

    def __post_init__(self):
        self.lock, self.best = threading.Lock(), math.inf
        if self.task == "clustering" and not self.key:
            raise ValueError("a clustering search needs `key`: the column that identifies a row")
        self.parallelism = _fit_parallelism(self.prepared.sparkSession, self.parallelism)
        self.slots = threading.BoundedSemaphore(self.parallelism)    # forests held by the driver at once
        self.model_name = MODEL_OF_TASK[self.task]
        self.space = space_for(self.model_name, self.wide)
        cols = [c for c in ([self.key] if self.key else []) + list(self.features)
                + ([self.label] if self.label else []) + (
                    ["split"] if "split" in self.prepared.columns else [])]
        base = self.prepared.select(*[F.col(q(c)) for c in dict.fromkeys(cols)])
        # laid out once for all fits (see models.spread)
        self.base = base = M.spread(base, self.key)
        if self.task in ("regression", "classification"):
            self.train = base.where(F.col("split") == "train").persist(StorageLevel.MEMORY_AND_DISK)
            self.test = base.where(F.col("split") == "test").persist(StorageLevel.MEMORY_AND_DISK)
            self.n_classes = (self.train.select(self.label).distinct().count()
                              if self.task == "classification" else None)
            self.n_rows = self.train.count()
        else:
            self.data = base.persist(StorageLevel.MEMORY_AND_DISK)
            self.vectors = M.vectors(self.data, self.features).persist(StorageLevel.MEMORY_AND_DISK)
            self.n_classes = None
            self.restarts = M.RestartCache(self.vectors)
            self.scored = {}       # silhouette of each fitted restart

    def view(self, lane: int = 0) -> "Scorer":
        """The same rows (and K-Means restarts) with a memo, a best forest and counts of
        its own, for one strategy."""
        own = copy.copy(self)
        own.memo, own.kept, own.best, own.lock = {}, {}, math.inf, threading.Lock()
        own.n_asked = own.n_fits = 0
        own.lane, own.asked = lane, []
        return own

    def close(self):
        if self.task == "clustering":
            self.restarts.close()
        for name in ("train", "test", "data", "vectors", "base"):
            if hasattr(self, name):
                getattr(self, name).unpersist()

    # ---- parameters
    def params_of(self, u) -> dict:
        return repair(decode(u, self.space), self.model_name, self.n_classes)

    def _memo_key(self, p):
        if self.task == "clustering":
            return (int(p["n_clusters"]), int(p["max_iter"]), M.n_restarts(p.get("n_init")))
        sp = M.forest_params(p, len(self.features), self.task, n_rows=self.n_rows)
        return (*sorted(sp.items()), p.get("class_weight") not in (None, "none"))

    # ---- fitting
    def _restarts(self, some) -> list:
        """The best restart of each parameter set; what is not cached yet is
        fitted concurrently."""
        wanted = [self._memo_key(p) for p in some]
        self.asked.append(wanted)
        self.n_asked += sum(w[2] for w in wanted)
        while todo := self.restarts.missing(wanted):
            self.n_fits += len(todo)
            self.restarts.fit_many(todo, wanted, lambda fn, jobs: self._concurrently(fn, {t: t for t in jobs}))
        return [self.restarts.best(*w) for w in wanted]

    def fit(self, p):
        if self.task == "clustering":
            return M.kmeans_pipeline(self.features, self.restarts.model(self._restarts([p])[0]))
        key = self._memo_key(p)
        with self.lock:
            self.n_asked += 1
            if key in self.kept:
                return self.kept[key]
            self.n_fits += 1
        if self.task == "regression":
            return M.fit_forest_regressor(self.train, self.features, self.label, p, placed=True, n_rows=self.n_rows)
        return M.fit_forest_classifier(self.train, self.features, self.label, p, placed=True, n_rows=self.n_rows)

    def _in_pool(self, fn, args):
        """Run ``fn`` in its own FAIR scheduler pool, so that concurrent
        candidate fits share the executors instead of queueing FIFO."""
        i, p = args
        sc = self.prepared.sparkSession.sparkContext
        sc.setLocalProperty("spark.scheduler.pool", f"tabtune-{self.lane}-{i % self.parallelism}")
        try:
            return fn(p)
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    def _score_supervised(self, p):
        with self.slots:
            model = self.fit(p)
            pred = M.predict(model, self.test, "prediction")
            if self.task == "regression":
                got = float(K.regression_report(pred, self.label, "prediction", len(self.features))
                            .select("mse").first()[0])
            else:
                got = float(K.macro_f1(pred, self.label, "prediction").first()[0])
            self._keep(p, model, got)
        return got

    def _keep(self, p, model, fitness: float) -> None:
        """Holds the best model, which the report of a strategy needs again."""
        sign = 1.0 if self.task == "regression" else -1.0
        with self.lock:
            if fitness == fitness and sign * fitness < self.best:
                self.best, self.kept = sign * fitness, {self._memo_key(p): model}

    def score(self, units) -> list[float]:
        params = [self.params_of(u) for u in units]
        keys = [self._memo_key(p) for p in params]
        todo = {}
        for k, p in zip(keys, params):
            if k not in self.memo and k not in todo:
                todo[k] = p
        if todo:
            if self.task == "clustering":
                self._score_clustering(todo)
            else:
                self.memo.update(zip(todo, self._concurrently(self._score_supervised, todo)))
        return [self.memo[k] for k in keys]

    def _concurrently(self, fn, todo: dict) -> list:
        workers = self.parallelism
        if self.task == "clustering":     # a K-Means fit keeps only centres on the driver
            workers = max(workers, min(16, self.prepared.sparkSession.sparkContext.defaultParallelism))
        with ThreadPoolExecutor(max_workers=workers) as pool:
            return list(pool.map(lambda a: self._in_pool(fn, a), enumerate(todo.values())))

    def _score_clustering(self, todo: dict):
        # concurrent fits, then one labelling pass and one silhouette job for
        # the restarts of the generation that were not scored before
        if self.rounds is not None:
            self.rounds.ask(self.lane, list(todo.values()))
        best = self._restarts(todo.values())
        self._silhouettes(best)
        self.memo.update(zip(todo, (self.scored[b.name] for b in best)))

    def score_round(self, wishes: list) -> None:
        """Fits and scores the parameter sets that the strategies of a round want."""
        self._silhouettes(self._restarts([p for wish in wishes for p in wish]))

    def _silhouettes(self, best) -> None:
        new = list({b.name: b for b in best if b.name not in self.scored}.values())
        if new:
            labelled, names = M.label_many(new, self.data, self.features)
            sil = CM.silhouette_many(labelled, self.features, self.key, names,
                                     sample=self.silhouette_sample)
            got = {r["cand"]: r["silhouette"] for r in sil.collect()}  # one row per candidate
            for i, b in enumerate(new):
                self.scored[b.name] = float(got.get(i) if got.get(i) is not None else float("nan"))

    def _known_silhouette(self, p) -> float | None:
        """The silhouette of a parameter set's best restart, if the search has it."""
        found = self.scored.get(self.restarts.best(*self._memo_key(p)).name)
        return None if found is None or found != found else found

    # ---- final report of one parameter set (refit, full metrics)
    def report(self, p) -> tuple[dict, object]:
        names = _metric_names(self.task)
        if self.task == "clustering":
            model = self.fit(p)
            lab = M.predict(model, self.data, "Cluster")
            row = CM.clustering_report(lab, self.features, "Cluster", self.key, self._known_silhouette(p),
                                       sample=self.silhouette_sample).first()
        else:
            with self.slots:
                model = self.fit(p)
                pred = M.predict(model, self.test, "prediction")
                if self.task == "regression":
                    row = K.regression_report(pred, self.label, "prediction", len(self.features)).first()
                else:
                    row = K.classification_report(pred, self.label, "prediction", self.n_classes).first()
        return {names[c]: (None if row[c] is None else float(row[c])) for c in names}, model


def run_search(scorer: Scorer, strategy="ga", epochs: int = 10, pop_size: int = 10,
               seed: int = 42):
    """One strategy; returns (best params, best fitness, history rows)."""
    strat = make_strategy(strategy, pop_size, seed)
    direction = K.metric_direction_of(REFERENCE_METRIC[scorer.task])
    sign = 1.0 if direction == "min" else -1.0
    dim = len(scorer.space)
    rng = strat.rng(dim)
    history = []
    gen_counter = {"g": 0}
    best = {"u": None, "f": math.inf}   # over all evaluations, not the last population

    def evaluate(units):
        fit = [float(f) for f in scorer.score(units)]
        for a, (u, f) in enumerate(zip(units, fit)):
            history.append((strat.name, gen_counter["g"], a, f if f == f else None,
                            json.dumps(scorer.params_of(u), default=str)))
            if best["u"] is None or (f == f and sign * f < best["f"]):
                best.update(u=np.array(u, copy=True), f=sign * f if f == f else math.inf)
        return [sign * f if f == f else math.inf for f in fit]

    pop = strat.init(rng, dim, evaluate)
    for g in range(1, epochs + 1):
        gen_counter["g"] = g
        pop = strat.step(rng, pop, g, evaluate)
    fitness = sign * best["f"] if best["f"] < math.inf else None
    return scorer.params_of(best["u"]), fitness, history


def compare_strategies(prepared: DataFrame, task: str, features, label: str | None = None,
                       key: str | None = None, strategies=("aco", "ga", "pso", "sa"),
                       epochs: int = 10, pop_size: int = 10, seed: int = 42,
                       parallelism: int = 4, silhouette_sample: float = 1.0, wide: bool = False):
    """Run every strategy, refit its best parameters, report all metrics.
    Over forests the strategies search side by side, over K-Means in step, as
    they share restarts and distances; a fit counts for the first that asks for it.
    ``wide``: over the wide domains (see ``space``).

    Returns (leaderboard DataFrame, {strategy: PipelineModel}, history DataFrame).
    """
    spark = prepared.sparkSession
    scorer = Scorer(prepared, task, list(features), label, key, parallelism, wide,
                    silhouette_sample=silhouette_sample)
    names = list(_metric_names(task).values())

    def search(spec, lane):
        own = scorer.view(lane)
        t0 = time.perf_counter()
        try:
            params, _, tried = run_search(own, spec, epochs, pop_size, seed)
        finally:
            if own.rounds is not None:
                own.rounds.leave(lane)
        return own, params, time.perf_counter() - t0, tried

    def report(spec, own, params, elapsed, tried):
        metrics, model = own.report(params)
        if task == "clustering":
            own.n_fits = fits.run_for(own.asked)
        name = make_strategy(spec, pop_size, seed).name
        return model, (name, *[metrics[n] for n in names], elapsed, own.n_asked, own.n_fits,
                       json.dumps(params, default=str)), tried

    strategies = list(strategies)
    given = [id(s) for s in strategies if isinstance(s, Strategy)]
    in_turn = len(set(given)) < len(given)   # an instance given twice has one state
    try:
        with ThreadPoolExecutor(max_workers=1 if in_turn else max(1, len(strategies))) as pool:
            if task == "clustering":
                scorer.rounds = None if in_turn else Rounds(scorer.score_round, range(len(strategies)))
                found = list(pool.map(search, strategies, range(len(strategies))))
                fits = M.FitCount(scorer.restarts)
                done = [report(spec, *f) for spec, f in zip(strategies, found)]
            else:
                done = list(pool.map(lambda spec, lane: report(spec, *search(spec, lane)),
                                     strategies, range(len(strategies))))
    finally:
        scorer.close()
    rows, hist = [row for _, row, _ in done], [h for *_, tried in done for h in tried]
    models = {row[0]: model for model, row, _ in done}
    schema = (f"`{LEADER_NAME}` string, " + ", ".join(f"`{n}` double" for n in names)
              + f", `{TIME_COL}` double, " + ", ".join(f"`{n}` long" for n in FIT_COLS) + ", best_params string")
    board = spark.createDataFrame(rows, schema)
    history = spark.createDataFrame(
        hist, "strategy string, generation int, agent int, fitness double, params string")
    return board, models, history


def best_model(leaderboard: DataFrame, task: str) -> DataFrame:
    """The row with the best reference metric (ties: strategy name)."""
    metric = REFERENCE_METRIC[task]
    col = F.nanvl(F.col(q(metric)).cast("double"), F.lit(None).cast("double"))
    order = col.asc_nulls_last() if K.metric_direction_of(metric) == "min" else col.desc_nulls_last()
    return leaderboard.orderBy(order, F.col(q(LEADER_NAME))).limit(1)


def search_history(history: DataFrame, task: str) -> DataFrame:
    """Best fitness per (strategy, generation) and the running best."""
    direction = K.metric_direction_of(REFERENCE_METRIC[task])
    agg = F.min if direction == "min" else F.max
    fitness = F.nanvl(F.col("fitness").cast("double"), F.lit(None).cast("double"))
    per_gen = history.groupBy("strategy", "generation").agg(agg(fitness).alias("gen_best"))
    w = (Window.partitionBy("strategy").orderBy("generation")
         .rowsBetween(Window.unboundedPreceding, 0))
    return per_gen.withColumn("best_so_far", agg("gen_best").over(w))

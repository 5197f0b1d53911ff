import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import table
from tabtune.operators import describe as D
from tabtune.operators import select
from tabtune.operators import split as SP
from tabtune.operators.clean import column_quartiles

PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)


def columns(n, rng):
    return {"normal": rng.normal(size=n), "few": rng.integers(0, 5, n).astype(float),
            "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * 1e6), "flat": np.full(n, 3.0),
            "steep": np.exp(rng.normal(size=n) * 20), "gaps": np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n)),
            "two": np.where(np.arange(n) % 2 == 0, -1.0, 1.0), "none": np.full(n, np.nan)}


@pytest.mark.parametrize("n, gather, accuracy", [(1, 2048, 10000), (2, 2048, 10000), (3001, 2048, 10000),
                                                 (6000, 8, 100), (5000, 1, 50)])
def test_quantiles_against_numpy(spark, monkeypatch, n, gather, accuracy):
    """Also with brackets so coarse and limits so small that they narrow often."""
    monkeypatch.setattr(select, "GATHER", gather)
    monkeypatch.setattr(select, "ACCURACY", accuracy)
    x = columns(n, np.random.default_rng(n))
    rows = list(zip(*[[float(v) for v in c] for c in x.values()]))
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in x)).repartition(4)
    got = select.quantiles(df, list(x), PROBS)
    for c, v in x.items():
        v = v[~np.isnan(v)]
        if not len(v):
            assert c not in got
            continue
        count, least, most, found = got[c]
        assert (count, least, most) == (len(v), v.min(), v.max())
        assert found == pytest.approx(list(np.quantile(v, PROBS)), rel=1e-9)


def test_no_sort_and_no_range_exchange(spark, monkeypatch):
    plans = []
    first = type(spark.range(1)).first
    monkeypatch.setattr(type(spark.range(1)), "first", lambda self: plans.append(
        self._jdf.queryExecution().executedPlan().toString()) or first(self))
    li = table(spark, "lineitem")
    column_quartiles(li).collect()
    D.box_stats(li).collect()
    assert plans and not any("rangepartitioning" in p or "Sort " in p for p in plans)


def order(rows, key, seed=42):
    """Rows in the order of the split's rule."""
    def of(r):
        k = ":".join(str(r[c]) for c in key)
        return hashlib.md5(f"{k}:{seed}".encode()).hexdigest()[:15], k
    return sorted(rows, key=of)


@pytest.mark.parametrize("few", [1 << 16, 3])
def test_exact_split_with_repeated_keys_and_rows(spark, monkeypatch, few):
    """Counting down to the last bits, of hashes and then of digests."""
    monkeypatch.setattr(select, "FEW", few)
    rng = random.Random(few)
    rows = [(rng.randrange(40), rng.choice("ab"), rng.randrange(3)) for _ in range(300)] + [(7, "a", 1)] * 200
    df = spark.createDataFrame(rows, "k int, c string, v int").repartition(6)
    for fraction in (0.0, 0.5, 1.0) if few > 3 else (0.5,):
        got = SP.train_test_split(df, "k", fraction, exact=True).collect()
        test = sorted(r.k for r in got if r.split == "test")
        want = order([{"k": k} for k, *_ in rows], ["k"])[:math.ceil(fraction * 500)]
        assert len(got) == 500 and test == sorted(r["k"] for r in want)
        assert sorted((r.k, r.c, r.v) for r in got) == sorted(rows)
    got = SP.stratified_split(df, "c", "k").collect()
    for c in "ab":
        own = [{"k": k} for k, x, _ in rows if x == c]
        want = sorted(r["k"] for r in order(own, ["k"])[:math.ceil(0.2 * len(own))])
        assert sorted(r.k for r in got if r.split == "test" and r.c == c) == want


def test_exact_split_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, "x"), (None, "y"), (1, None), (2, None), (3, "x")], "k int, c string")
    assert SP.train_test_split(df, "k", 0.4, exact=True).where("split = 'test'").count() == 2
    got = SP.stratified_split(df, "c", "k", 0.5).where("split = 'test'").groupBy("c").count().collect()
    assert {r.c: r["count"] for r in got} == {"x": 1, "y": 1, None: 1}
    assert SP.train_test_split(df.limit(0), "k", 0.4, exact=True).count() == 0

import math

import numpy as np
import pytest

from conftest import IRIS, needs, table
from tabtune.operators.normality import normality_test
from tabtune.operators.ranks import column_value_ranks, linear_quantiles
from tabtune.functions.columns import unpivot_numeric


def _ppnd(p):
    # Acklam's approximation, same constants as the engine (independent code path)
    from tabtune.functions import formulas as fm
    a, b, c, d = fm.ACKLAM_A, fm.ACKLAM_B, fm.ACKLAM_C, fm.ACKLAM_D
    if p < fm.ACKLAM_P_LOW:
        qq = math.sqrt(-2 * math.log(p))
        return np.polyval(c, qq) / np.polyval(d, qq)
    if p > 1 - fm.ACKLAM_P_LOW:
        qq = math.sqrt(-2 * math.log(1 - p))
        return -np.polyval(c, qq) / np.polyval(d, qq)
    qq = p - 0.5
    r = qq * qq
    return qq * np.polyval(a, r) / np.polyval(b, r)


def brute_w(x):
    """Royston's W by the textbook formula on a fully sorted numpy array."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    m = np.array([_ppnd((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = (m * m).sum()
    u = 1 / math.sqrt(n)
    c1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
    c2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
    an = m[-1] / math.sqrt(mm) + np.polyval(c1[::-1], u)
    an1 = m[-2] / math.sqrt(mm) + np.polyval(c2[::-1], u)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
    a = m / math.sqrt(phi)
    a[-1], a[0], a[-2], a[1] = an, -an, an1, -an1
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


@needs(IRIS)
def test_iris_matches_published_values(spark):
    from tabtune.sources.tables import read_table
    iris = read_table(spark, IRIS)
    got = {r["column"]: r for r in normality_test(iris).collect()}
    expect = {"Id": (0.95462, 8.08e-05), "SepalLengthCm": (0.97609, 0.01018),
              "SepalWidthCm": (0.98379, 0.07518), "PetalLengthCm": (0.87642, 7.5e-10),
              "PetalWidthCm": (0.90262, 1.9e-08)}
    for c, (w, p) in expect.items():
        assert got[c]["w"] == pytest.approx(w, abs=1e-5)
        assert got[c]["p"] == pytest.approx(p, rel=0.02)
    assert got["SepalWidthCm"]["is_normal"] and not got["PetalLengthCm"]["is_normal"]


def test_events_value_w(spark):
    ev = table(spark, "events", "/root/testdata/sf0.01")
    r = normality_test(ev, ["value"]).first()
    assert r["n"] == 10000
    assert r["w"] == pytest.approx(0.821319, abs=1e-6)
    assert r["z"] == pytest.approx(18.1795, abs=1e-4)
    assert not r["p_reliable"]


def test_heavy_ties_split_into_chunks_equal_bruteforce(spark):
    # one value holds a third of the rows (more than one rank chunk)
    rng = np.random.default_rng(7)
    x = np.concatenate([np.full(5000, 3.0), rng.normal(size=10000).round(2)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    r = normality_test(df, ["x"]).first()
    assert r["w"] == pytest.approx(brute_w(x), rel=1e-10)


def test_constant_column_is_normal(spark):
    df = spark.createDataFrame([(1.0,)] * 20, "x double")
    r = normality_test(df, ["x"]).first()
    assert r["w"] == 1.0 and r["p"] == 1.0 and r["is_normal"]


def test_small_n_exact_formula(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    r = normality_test(df, ["x"]).first()
    x = np.array([1.0, 2.0, 4.0])
    w = (math.sqrt(0.5) * (x[2] - x[0])) ** 2 / ((x - x.mean()) ** 2).sum()
    assert r["w"] == pytest.approx(w)
    p = max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.pi / 3))
    assert r["p"] == pytest.approx(p, rel=1e-9)


def test_ranks_and_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 50, 3000).astype(float)
    b = rng.normal(size=3000)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    ranked = column_value_ranks(unpivot_numeric(df, ["a", "b"]), partitions=7)
    rows = ranked.where("column = 'a'").orderBy("value").collect()
    vals, counts = np.unique(a, return_counts=True)
    assert [r["value"] for r in rows] == list(vals)
    assert [r["start"] for r in rows] == list(np.concatenate([[0], np.cumsum(counts)[:-1]]))
    qs = {r["column"]: r for r in linear_quantiles(ranked).collect()}
    for c, arr in (("a", a), ("b", b)):
        assert qs[c]["q_25"] == pytest.approx(np.percentile(arr, 25))
        assert qs[c]["q_5"] == pytest.approx(np.percentile(arr, 50))
        assert qs[c]["q_75"] == pytest.approx(np.percentile(arr, 75))


def test_fewer_than_three_values_give_nulls(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, None)], "x double, y double")
    got = {r["column"]: r for r in normality_test(df).collect()}
    assert got["x"]["w"] is None and got["x"]["is_normal"] is None and got["y"]["n"] == 1


# Samples with W and p as statistics packages print them.
KNOWN = [
    ([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.78881, 0.006704),
    ([21.0, 21.0, 22.8, 21.4, 18.7, 18.1, 14.3, 24.4, 22.8, 19.2, 17.8, 16.4, 17.3, 15.2, 10.4, 10.4, 14.7, 32.4,
      30.4, 33.9, 21.5, 15.5, 15.2, 13.3, 19.2, 27.3, 26.0, 30.4, 15.8, 19.7, 15.0, 21.4], 0.94756, 0.1229),
]


@pytest.mark.parametrize("x, w, p", KNOWN)
def test_known_w_and_p(spark, x, w, p):
    r = normality_test(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"]).first()
    assert r["w"] == pytest.approx(w, abs=6e-6) and r["p"] == pytest.approx(p, rel=1e-3)


def test_hot_values_come_from_block_sums(spark):
    """Values repeated far more often than a block has ranks, given as counts."""
    from tabtune.operators.normality import normality_from_summary, shapiro_summaries
    counts = [(-2.0, 3), (-1.0, 400_000), (0.5, 900_000), (1.5, 5000), (3.0, 100_001), (9.0, 1)]
    n = sum(c for _, c in counts)
    rows, start = [], 0
    for v, c in counts:
        rows.append(("x", v, c, start, n))
        start += c
    ranked = spark.createDataFrame(rows, "column string, value double, cnt long, start long, n long")
    r = normality_from_summary(shapiro_summaries(ranked)).first()
    assert r["n"] == n and r["w"] == pytest.approx(brute_fast([v for v, _ in counts], [c for _, c in counts]), rel=1e-9)


def brute_fast(values, counts):
    """W with the engine's quantile formula, vectorised."""
    from tabtune.functions import formulas as fm
    x = np.repeat(values, counts)
    n = len(x)
    p = (np.arange(1, n + 1) - 0.375) / (n + 0.25)
    low, high = p < fm.ACKLAM_P_LOW, p > 1 - fm.ACKLAM_P_LOW
    q = p - 0.5
    m = q * np.polyval(fm.ACKLAM_A, q * q) / np.polyval(fm.ACKLAM_B, q * q)
    for side, tail, sign in ((low, p, 1.0), (high, 1 - p, -1.0)):
        t = np.sqrt(-2 * np.log(tail[side]))
        m[side] = sign * np.polyval(fm.ACKLAM_C, t) / np.polyval(fm.ACKLAM_D, t)
    mm, u = (m * m).sum(), 1 / math.sqrt(n)
    c1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
    c2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
    an = m[-1] / math.sqrt(mm) + np.polyval(c1[::-1], u)
    an1 = m[-2] / math.sqrt(mm) + np.polyval(c2[::-1], u)
    phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
    a = m / math.sqrt(phi)
    a[-1], a[0], a[-2], a[1] = an, -an, an1, -an1
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()

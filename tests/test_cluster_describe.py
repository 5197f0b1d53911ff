import numpy as np
import pytest

from conftest import table
from tabtune.operators import cluster_metrics as CM
from tabtune.operators import describe as D


def brute_silhouette(x, lab):
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    s = np.zeros(n)
    for i in range(n):
        own = lab == lab[i]
        if own.sum() <= 1:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0
    return s.mean()


def brute_db(x, lab):
    labels = sorted(set(lab))
    cents = np.array([x[lab == c].mean(0) for c in labels])
    sp = np.array([np.linalg.norm(x[lab == c] - cents[i], axis=1).mean() for i, c in enumerate(labels)])
    out = []
    for i in range(len(labels)):
        out.append(max((sp[i] + sp[j]) / np.linalg.norm(cents[i] - cents[j])
                       for j in range(len(labels)) if j != i))
    return np.mean(out)


def brute_ch(x, lab):
    labels = sorted(set(lab))
    g = x.mean(0)
    between = sum((lab == c).sum() * ((x[lab == c].mean(0) - g) ** 2).sum() for c in labels)
    within = sum(((x[lab == c] - x[lab == c].mean(0)) ** 2).sum() for c in labels)
    n, k = len(x), len(labels)
    return between * (n - k) / (within * (k - 1))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(0, 1, (40, 3)), rng.normal(4, 1, (30, 3)), [[10.0, 10.0, 10.0]]])
    lab = np.array([0] * 40 + [1] * 30 + [2])  # cluster 2 is a singleton
    rows = [(i, int(l), [float(v) for v in p]) for i, (p, l) in enumerate(zip(x, lab))]
    return x, lab, spark.createDataFrame(rows, "id long, label int, f array<double>")


def test_silhouette_exact_multi_block(blobs):
    x, lab, df = blobs
    got = CM.silhouette(df, "f", "label", "id", block_rows=16).first()[0]
    assert got == pytest.approx(brute_silhouette(x, lab), rel=1e-9)


def test_silhouette_many_labellings_at_once(blobs, spark):
    from pyspark.sql import functions as F
    x, lab, df = blobs
    lab2 = (np.arange(len(lab)) % 3)
    df2 = df.withColumn("l2", (F.col("id") % 3).cast("int"))
    res = {r["cand"]: r["silhouette"] for r in
           CM.silhouette_many(df2, "f", "id", ["label", "l2"], block_rows=20).collect()}
    assert res[0] == pytest.approx(brute_silhouette(x, lab), rel=1e-9)
    assert res[1] == pytest.approx(brute_silhouette(x, lab2), rel=1e-9)


def test_db_and_ch(blobs):
    x, lab, df = blobs
    assert CM.davies_bouldin(df, "f", "label").first()[0] == pytest.approx(brute_db(x, lab))
    assert CM.calinski_harabasz(df, "f", "label").first()[0] == pytest.approx(brute_ch(x, lab))


def test_embeddings_fixture_values(spark):
    emb = table(spark, "embeddings", "/root/testdata/sf0.01")
    rep = CM.clustering_report(emb, "embedding", "label", "vec_id").first()
    assert rep["silhouette"] == pytest.approx(-0.012707, abs=1e-6)
    assert rep["davies_bouldin"] == pytest.approx(10.904416, abs=1e-6)
    assert rep["calinski_harabasz"] == pytest.approx(1.055317, abs=1e-6)


def test_histograms_match_numpy_auto(spark):
    ev = table(spark, "events", "/root/testdata/sf0.01")
    vals = np.array([r[0] for r in ev.select("value").collect()])
    counts, edges = np.histogram(vals, bins="auto")
    got = D.histograms(ev, ["value"]).orderBy("bin").collect()
    assert len(got) == len(counts)
    assert [r["count"] for r in got] == list(counts)
    assert got[0]["lo"] == pytest.approx(edges[0]) and got[-1]["hi"] == pytest.approx(edges[-1])


def test_box_stats_and_corr(spark):
    import pandas as pd
    ev = table(spark, "events", "/root/testdata/sf0.01").select("user_id", "value")
    pdf = pd.DataFrame([r.asDict() for r in ev.collect()])
    b = {r["column"]: r for r in D.box_stats(ev).collect()}["value"]
    v = pdf["value"].to_numpy()
    q1, q3 = np.percentile(v, [25, 75])
    lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert b["whisker_lo"] == v[v >= lo].min() and b["whisker_hi"] == v[v <= hi].max()
    assert b["n_fliers"] == int(((v < lo) | (v > hi)).sum()) == 463
    corr = {(r[0], r[1]): r[2] for r in D.correlation_matrix(ev).collect()}
    assert corr[("user_id", "value")] == pytest.approx(pdf.corr().loc["user_id", "value"])
    assert len(corr) == 4


def test_eda_report_and_flag_union(spark):
    from pyspark.sql import functions as F
    from tabtune.operators import clean as C
    from tabtune.plans.eda import eda_report
    ev = table(spark, "events").select("event_id", "user_id", "value")
    rep = eda_report(ev, key="event_id")
    assert set(rep) >= {"correlation", "box", "histograms", "pairs", "fliers"}
    assert rep["correlation"].count() == 4 and rep["pairs"].count() == 2 * ev.count()
    rep["_input"].unpersist()
    flags = {r["column"]: r for r in C.outlier_flags(ev).collect()}
    b = flags["value"]
    manual = ev.where((F.col("value") < b["lower"]) | (F.col("value") > b["upper"])).count()
    assert b["n_outliers"] == manual
    assert b["n_rows_flagged"] == ev.count() - C.drop_outliers(ev).count()


def test_correlation_is_pairwise_at_every_width(spark):
    """More than 200 columns, with nulls, NaN, constant and far-off columns."""
    import numpy as np
    import pandas as pd
    from tabtune.operators import describe as D
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 210)) + rng.normal(size=(150, 1))
    x[:, 3] = 1e9 + x[:, 3]
    x[:, 4] = 0.1
    x[rng.random(x.shape) < 0.1] = np.nan
    cols = [f"c{i}" for i in range(x.shape[1])]
    rows = [[None if np.isnan(v) and j % 2 else float(v) for j, v in enumerate(r)] for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(5)
    got = {(r.col_a, r.col_b): r.r for r in D.correlation_matrix(df).collect()}
    want = pd.DataFrame(x, columns=cols).corr()
    assert len(got) == 210 * 210
    for a in cols:
        for b in cols:
            w = want.loc[a, b]
            assert got[a, b] is None if a == "c4" or b == "c4" else abs(got[a, b] - w) < 1e-6
    assert {D.correlation_matrix(df.limit(0)).where("r IS NOT NULL").count()} == {0}


def test_histogram_with_a_far_outlier(spark):
    """All bins of the rule, also where nearly all of them are empty."""
    import collections
    import math
    from tabtune.operators import describe as D
    top = 1e8
    x = [float(i) for i in range(1000)] + [top]
    out = D.histograms(spark.createDataFrame([(v,) for v in x], "x double")).collect()
    width = min(2 * 500.0 * 1001 ** (-1 / 3), top / (math.log2(1001) + 1))
    bins = math.ceil(top / width)
    assert bins > 100_000
    want = collections.Counter(min(math.floor(v * (bins / top)), bins - 1) for v in x)
    assert sorted(r.bin for r in out) == list(range(bins))          # empty ones too
    assert {r.bin: r["count"] for r in out if r["count"]} == want and max(r.hi for r in out) == top
    small = [float(v) for v in (1, 2, 2, 3, 3, 3, 9)]
    import numpy as np
    counts, _ = np.histogram(small, bins=8)     # Freedman-Diaconis; numpy from 2.3 on limits 'auto' of few values
    got = {r.bin: r["count"] for r in D.histograms(spark.createDataFrame([(v,) for v in small], "x double")).collect()}
    assert got == dict(enumerate(counts))


def test_summary_of_clusters_against_formulas(spark):
    import numpy as np
    from tabtune.operators import cluster_metrics as CM
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 3)) * 0.1 + 1e6
    lab = rng.integers(0, 4, 90)
    rows = [(*map(float, r), int(k), i) for i, (r, k) in enumerate(zip(x, lab))]
    rows += [(None, 1.0, 1.0, 0, 900), (1.0, 1.0, 1.0, None, 901)]
    df = spark.createDataFrame(rows, "a double, b double, c double, l int, id int")
    cents = [x[lab == k].mean(0) for k in range(4)]
    within = sum(((x[lab == k] - cents[k]) ** 2).sum() for k in range(4))
    between = sum((lab == k).sum() * ((cents[k] - x.mean(0)) ** 2).sum() for k in range(4))
    s = [np.sqrt(((x[lab == k] - cents[k]) ** 2).sum(1)).mean() for k in range(4)]
    db = np.mean([max((s[i] + s[j]) / np.linalg.norm(cents[i] - cents[j]) for j in range(4) if i != j) for i in range(4)])
    assert CM.calinski_harabasz(df, ["a", "b", "c"], "l").first()[0] == pytest.approx((between / 3) / (within / 86), rel=1e-6)
    assert CM.davies_bouldin(df, ["a", "b", "c"], "l").first()[0] == pytest.approx(db, rel=1e-6)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    sil = []
    for i in range(90):
        own = lab == lab[i]
        a = d[i, own].sum() / max(1, own.sum() - 1)
        b = min(d[i, lab == k].mean() for k in range(4) if k != lab[i])
        sil.append((b - a) / max(a, b))
    for block in (2048, 20, 7):
        got = CM.silhouette(df.where("id < 900"), ["a", "b", "c"], "l", "id", block_rows=block).first()[0]
        assert got == pytest.approx(np.mean(sil), abs=1e-4)      # squared by a dot product, 10^6 from 0


def test_davies_bouldin_in_blocks(spark, monkeypatch):
    from tabtune.operators import cluster_metrics as CM
    rows = [(float(i % 5), float(i % 3), i % 6) for i in range(60)]
    df = spark.createDataFrame(rows, "x double, y double, l int")
    want = CM.davies_bouldin(df, ["x", "y"], "l").first()[0]
    monkeypatch.setattr(CM, "CLUSTER_BLOCK", 2)
    assert abs(CM.davies_bouldin(df, ["x", "y"], "l").first()[0] - want) < 1e-9


def test_silhouette_carries_each_point_a_bounded_number_of_times(spark):
    """More points make larger blocks, not more of them; the value stays."""
    from tabtune.operators import cluster_metrics as CM
    assert CM.n_blocks(10_000, 2048, 64) == 5 and CM.n_blocks(2048, 2048, 64) == 1
    assert CM.n_blocks(100_000, 2048, 64) == CM.n_blocks(600_000, 2048, 64) == CM.BLOCKS
    assert CM.n_blocks(10 ** 7, 2048, 64) * CM.MOST_ROWS >= 10 ** 7          # memory of a task is bounded
    assert CM.n_blocks(600_000, 2048, 4096) * CM.MOST_VALUES >= 600_000 * 4096
    rng = np.random.default_rng(3)
    x, lab = rng.normal(size=(400, 3)) + 1e5, rng.integers(0, 3, 400)
    rows = [(i, int(k), [float(v) for v in p]) for i, (p, k) in enumerate(zip(x, lab))]
    df = spark.createDataFrame(rows, "id long, l int, f array<double>")
    got = CM.silhouette(df, "f", "l", "id", block_rows=5).first()[0]         # 80 blocks before
    assert got == pytest.approx(brute_silhouette(x, lab), rel=1e-6)

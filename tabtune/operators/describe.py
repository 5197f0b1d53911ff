"""Descriptive statistics behind the EDA plots.

Plot drawing is not part of the engine; these operators produce the numbers
each plot shows, as DataFrames.  Every per-column statistic is fused into a
single aggregation over all numeric columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtune.functions.columns import numeric_columns, q, unpivot_numeric
from tabtune.operators.clean import column_quartiles
from tabtune.operators.select import WIDTH, doubles, quantiles
from tabtune.operators.split import hash_unit

#: A column whose squared deviations from its mean are this small a share of its
#: squares does not vary, up to rounding.
FLAT = 1e-12
#: Bins of a histogram that a row stands for before they are listed, at least.
BIN_RUN = 1 << 16


def _gram(width: int):
    """Sums over the rows of a partition for every pair i <= j: rows that have
    both, sums and squares of either one over these rows, and products."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            mask = there.astype(float)
            total += [mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x]
        n, s, q2, c = total
        i, j = np.triu_indices(width)
        for at in range(0, len(i), 1 << 16):
            a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v) for v in (a.astype(np.int32), b.astype(np.int32), n[a, b], s[a, b], s[b, a],
                                       q2[a, b], q2[b, a], c[a, b])],
                names=["i", "j", "n", "si", "sj", "qi", "qj", "c"])
    return run


def correlation_matrix(df: DataFrame, cols=None) -> DataFrame:
    """Long Pearson matrix (col_a, col_b, r) over every ordered pair,
    diagonal included; nulls are skipped pairwise, at every width.

    Two scans for any number of columns: the means, then blocks of sums and
    cross products of the centred columns, one for each task, which add up.
    A column without variation (in the rows of a pair) has no correlation."""
    cols = list(cols or numeric_columns(df))
    x = doubles(df, cols)
    stats = df.agg(F.array(*[F.avg(v) for v in x]).alias("mean"),
                   F.array(*[F.min(v) == F.max(v) for v in x]).alias("flat")).first()
    centred = [v - F.lit(m if m is not None else 0.0) for v, m in zip(x, stats["mean"])]
    sums = (df.select(F.array(*centred).alias("x"))
            .mapInArrow(_gram(len(cols)), "i int, j int, n double, si double, sj double, qi double, qj double, c double")
            .groupBy("i", "j").agg(*[F.sum(v).alias(v) for v in ("n", "si", "sj", "qi", "qj", "c")]))
    flat = F.array(*[F.lit(bool(v) if v is not None else True) for v in stats["flat"]])
    vi, vj = (F.col(f"q{k}") - F.col(f"s{k}") * F.col(f"s{k}") / F.col("n") for k in "ij")
    varies = ((F.col("n") > 1) & ~F.get(flat, F.col("i")) & ~F.get(flat, F.col("j"))
              & (vi > FLAT * F.col("qi")) & (vj > FLAT * F.col("qj")))
    r = (F.col("c") - F.col("si") * F.col("sj") / F.col("n")) / F.sqrt(vi * vj)
    pairs = sums.select("i", "j", F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))
    both = pairs.unionAll(pairs.where("i <> j").select("j", "i", "r"))
    names = F.array(*[F.lit(c) for c in cols])
    return both.select(F.get(names, F.col("i")).alias("col_a"), F.get(names, F.col("j")).alias("col_b"), "r")


def _bounds(df, cols, k):
    quart = column_quartiles(df, cols, k=k)
    # one row per column reaches the driver
    return {r["column"]: r for r in quart.collect()}


def box_stats(df: DataFrame, cols=None, k: float = 1.5) -> DataFrame:
    """(column, q1, median, q3, whisker_lo, whisker_hi, n_fliers, min, max).

    Whiskers are the most extreme values inside [q1 - k*iqr, q3 + k*iqr].
    Quartiles come from selection, the rest from one more aggregation."""
    cols = list(cols or numeric_columns(df))
    quart = {r["column"]: r for r in column_quartiles(df, cols, k=k).collect()}  # one row per column
    rows = []
    for at in range(0, len(cols), WIDTH):
        some = [(c, v) for c, v in zip(cols[at:at + WIDTH], doubles(df, cols[at:at + WIDTH])) if c in quart]
        if not some:
            continue
        aggs = []
        for i, (c, v) in enumerate(some):
            lo, hi = F.lit(quart[c]["lower"]), F.lit(quart[c]["upper"])
            aggs += [F.min(F.when(v >= lo, v)).alias(f"l{i}"), F.max(F.when(v <= hi, v)).alias(f"h{i}"),
                     F.count(F.when((v < lo) | (v > hi), 1)).alias(f"n{i}"), F.min(v).alias(f"a{i}"),
                     F.max(v).alias(f"z{i}")]
        got = df.agg(*aggs).first()
        rows += [(c, quart[c]["q1"], quart[c]["median"], quart[c]["q3"], *[got[f"{x}{i}"] for x in "lhnaz"])
                 for i, (c, _) in enumerate(some)]
    return df.sparkSession.createDataFrame(
        rows, "column string, q1 double, median double, q3 double, whisker_lo double, whisker_hi double, "
        "n_fliers long, min double, max double")


def histogram_params(df: DataFrame, cols=None, bins="auto") -> DataFrame:
    """(column, n, lo, hi, bins) per column; ``bins='auto'`` is the larger
    of the Sturges and Freedman-Diaconis bin counts (numpy's 'auto').
    Range and IQR come from selection."""
    cols = cols or numeric_columns(df)
    spark = df.sparkSession
    found = quantiles(df, list(cols), (0.25, 0.75) if bins == "auto" else ())
    stats = {c: (n, lo, hi, got[1] - got[0] if got else None) for c, (n, lo, hi, got) in found.items()}
    rows = []
    for c in cols:
        if c not in stats:
            continue
        n, lo, hi, iqr = stats[c]
        lo, hi = float(lo), float(hi)
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        if bins == "auto":
            sturges = (hi - lo) / (math.log2(n) + 1.0)
            fd = 2.0 * iqr * n ** (-1.0 / 3.0)
            width = min(fd, sturges) if fd else sturges
            nb = max(1, math.ceil((hi - lo) / width)) if width > 0 else 1
        else:
            nb = int(bins)
        rows.append((c, n, lo, hi, nb))
    return spark.createDataFrame(rows, "column string, n long, lo double, hi double, bins long")


def _grid(params: DataFrame) -> DataFrame:
    """(column, lo, hi, bins, bin) of every bin: runs of bins are dealt to the
    tasks, which list them, so no array holds more than a run."""
    step = F.greatest(F.lit(BIN_RUN), F.ceil(F.sqrt("bins"))).cast("long")
    last = F.col("bins") - 1
    runs = params.select("column", "lo", "hi", "bins", step.alias("step"),
                         F.explode(F.sequence(F.lit(0).cast("long"), last, step)).alias("start"))
    return (runs.repartition("column", "start")
            .select("column", "lo", "hi", "bins", F.explode(F.sequence(
                F.col("start"), F.least(F.col("start") + F.col("step") - 1, last))).alias("bin")))


def histograms(df: DataFrame, cols=None, bins="auto") -> DataFrame:
    """D3: (column, bin, lo, hi, count) including empty bins, whatever their
    number (a far outlier makes many); the last bin is closed on the right."""
    cols = cols or numeric_columns(df)
    params = histogram_params(df, cols, bins)
    long = unpivot_numeric(df, cols)
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    place = F.floor((F.col("value") - F.col("lo")) * (F.col("bins") / (F.col("hi") - F.col("lo"))))
    binned = (long.join(F.broadcast(params), "column")  # one row per column
              .withColumn("bin", F.least(place, F.col("bins") - 1).cast("long"))
              .groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count")))
    return (_grid(params).join(binned, ["column", "bin"], "left")
            .select("column", "bin", (F.col("lo") + F.col("bin") * width).alias("lo"),
                    F.when(F.col("bin") == F.col("bins") - 1, F.col("hi"))
                    .otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def pair_points(df: DataFrame, cols=None, key=None, fraction: float = 1.0,
                seed: int = 42) -> DataFrame:
    """Scatter points (col_x, col_y, key, x, y) for every ordered pair of
    distinct numeric columns; ``fraction < 1`` keeps a hash sample of rows."""
    cols = cols or numeric_columns(df, exclude=[key] if key else ())
    src = df
    if fraction < 1.0:
        src = df.where(hash_unit(df, key, seed) < F.lit(float(fraction)))
    keycol = F.col(q(key)) if key else F.lit(None).cast("string")
    entries = [F.struct(F.lit(a).alias("col_x"), F.lit(b).alias("col_y"),
                        F.col(q(a)).cast("double").alias("x"), F.col(q(b)).cast("double").alias("y"))
               for a in cols for b in cols if a != b]
    return (src.select(keycol.alias("key"), F.explode(F.array(*entries)).alias("s"))
            .select("s.col_x", "s.col_y", "key", "s.x", "s.y"))


def fliers(df: DataFrame, cols=None, key=None, k: float = 1.5) -> DataFrame:
    """(column, key, value) of every point outside the whiskers."""
    cols = cols or numeric_columns(df, exclude=[key] if key else ())
    spark = df.sparkSession
    b = _bounds(df, cols, k)
    bounds = spark.createDataFrame([(c, b[c]["lower"], b[c]["upper"]) for c in cols if c in b],
                                   "column string, lower double, upper double")
    keycol = F.col(q(key)) if key else F.lit(None).cast("string")
    wide = df.select(keycol.alias("key"), *[F.col(q(c)).cast("double").alias(c) for c in cols])
    long = wide.unpivot(["key"], [F.col(q(c)) for c in cols], "column", "value")
    return (long.join(F.broadcast(bounds), "column")  # one row per column
            .where(((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
                   & ~F.isnan("value"))
            .select("column", "key", "value"))

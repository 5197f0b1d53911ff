"""Cleaning operators B1-B3, B5-B9.

Per-column statistics are fused: one unpivot (Expand) and one ranked
distinct-value table serve quartiles *and* the normality gate for every
numeric column; the resulting literal bounds become a single ``filter``
that Catalyst pushes into the Parquet scan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtune.functions.columns import (numeric_columns, q, resolve_label,
                                       unpivot_numeric)
from tabtune.operators.normality import normality_from_summary, shapiro_summaries
from tabtune.operators.ranks import column_value_ranks, linear_quantiles, small_result
from tabtune.operators.select import quantiles


def drop_null_rows(df: DataFrame) -> DataFrame:
    """B1: drop rows holding any missing value (null or NaN)."""
    return df.na.drop(how="any")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """B2: full-row distinct; nulls compare equal.  Map-side partial
    aggregation collapses hot duplicates before the shuffle."""
    return df.dropDuplicates()


def column_quartiles(df: DataFrame, cols=None, k: float = 1.5, approx: bool = False,
                     ranked: DataFrame | None = None) -> DataFrame:
    """(column, n, q1, median, q3, iqr, lower, upper), linear interpolation.

    Exact by default, by selection (``ranked``: from ranks that are there
    already); ``approx=True`` uses ``percentile_approx`` (returns an existing
    value, no interpolation).
    """
    cols = cols or numeric_columns(df)
    if approx:
        long = unpivot_numeric(df, cols)
        qs = (long.groupBy("column")
              .agg(F.count(F.lit(1)).alias("n"),
                   F.percentile_approx("value", [0.25, 0.5, 0.75], 10000).alias("qs")))
        qs = qs.select("column", "n", F.col("qs")[0].alias("q_25"),
                       F.col("qs")[1].alias("q_5"), F.col("qs")[2].alias("q_75"))
    elif ranked is None:
        found = quantiles(df, cols, (0.25, 0.5, 0.75))
        qs = df.sparkSession.createDataFrame([(c, n, *got) for c, (n, _, _, got) in found.items()],
                                             "column string, n long, q_25 double, q_5 double, q_75 double")
    else:
        qs = linear_quantiles(ranked, (0.25, 0.5, 0.75))
    iqr = F.col("q_75") - F.col("q_25")
    return qs.select(
        "column", F.col("n").cast("long").alias("n"),
        F.col("q_25").alias("q1"), F.col("q_5").alias("median"), F.col("q_75").alias("q3"),
        iqr.alias("iqr"),
        (F.col("q_25") - F.lit(float(k)) * iqr).alias("lower"),
        (F.col("q_75") + F.lit(float(k)) * iqr).alias("upper"))


def outlier_bounds(df: DataFrame, cols=None, alpha: float = 0.05, k: float = 1.5,
                   gate: bool = True, exclude=()) -> DataFrame:
    """Summary behind B5: one row per numeric column with its IQR bounds,
    normality result and whether the IQR rule applies (not normal)."""
    cols = [c for c in (cols or numeric_columns(df)) if c not in set(exclude)]
    ranked = column_value_ranks(unpivot_numeric(df, cols)) if gate else None
    quart = small_result(column_quartiles(df, cols, k=k, ranked=ranked))
    if gate:
        norm = small_result(normality_from_summary(shapiro_summaries(ranked), alpha))
        out = quart.join(norm.drop("n"), "column", "left")
        applies = ~F.coalesce(F.col("is_normal"), F.lit(False))
    else:
        out = (quart.withColumn("w", F.lit(None).cast("double"))
               .withColumn("z", F.lit(None).cast("double"))
               .withColumn("p", F.lit(None).cast("double"))
               .withColumn("is_normal", F.lit(None).cast("boolean"))
               .withColumn("p_reliable", F.lit(None).cast("boolean")))
        applies = F.lit(True)
    return small_result(out.withColumn("applies", applies), ranked)


INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _outside(c: str, lower: float, upper: float):
    """Outlier flag; null and NaN are missing, never outliers."""
    col = F.col(q(c))
    out = (col < F.lit(lower)) | (col > F.lit(upper))
    return F.coalesce(out & ~F.isnan(col.cast("double")), F.lit(False))


def _keep(df: DataFrame, c: str, lower: float, upper: float, has_nan: bool):
    """Row predicate 'not an outlier in c', written so that Parquet can take
    it as a pushed filter: integral columns compare with integer literals,
    and the NaN test is only added for columns that hold NaN."""
    col = F.col(q(c))
    dt = df.schema[c].dataType.simpleString()
    if dt in INTEGRAL:
        lo, hi = math.ceil(lower), math.floor(upper)
        inside = (col >= F.lit(lo).cast(dt)) & (col <= F.lit(hi).cast(dt))
    elif dt in ("float", "double"):
        inside = (col >= F.lit(lower).cast(dt)) & (col <= F.lit(upper).cast(dt))
        if has_nan:
            inside = inside | F.isnan(col)
    else:
        inside = (col.cast("double") >= F.lit(lower)) & (col.cast("double") <= F.lit(upper))
    return col.isNull() | inside


def _bounds_rows(bounds: DataFrame):
    # at most one row per numeric column reaches the driver
    return [r for r in bounds.select("column", "lower", "upper", "applies").collect()]


def _nan_columns(df: DataFrame, cols) -> set:
    """Floating columns that hold NaN (one pruned aggregation)."""
    fl = [c for c in cols if df.schema[c].dataType.simpleString() in ("float", "double")]
    if not fl:
        return set()
    row = df.agg(*[F.max(F.isnan(F.col(q(c))).cast("int")).alias(f"_n{i}")
                   for i, c in enumerate(fl)]).first()
    return {c for i, c in enumerate(fl) if row[f"_n{i}"]}


def drop_outliers(df: DataFrame, alpha: float = 0.05, k: float = 1.5, gate: bool = True,
                  exclude=(), cols=None, bounds: DataFrame | None = None) -> DataFrame:
    """Drop every row that is an IQR outlier in at least one numeric
    column whose distribution fails the Shapiro-Wilk gate (``p <= alpha``).

    Bounds come from the unfiltered table; a null never counts as an outlier.
    """
    if bounds is None:
        bounds = outlier_bounds(df, cols, alpha=alpha, k=k, gate=gate, exclude=exclude)
    rows = [r for r in _bounds_rows(bounds) if r["applies"] and r["lower"] is not None]
    if not rows:
        return df
    nan_cols = _nan_columns(df, [r["column"] for r in rows])
    keep = None
    for r in rows:
        kc = _keep(df, r["column"], r["lower"], r["upper"], r["column"] in nan_cols)
        keep = kc if keep is None else keep & kc
    return df.where(keep)


def outlier_flags(df: DataFrame, alpha: float = 0.05, k: float = 1.5, gate: bool = True,
                  exclude=(), cols=None) -> DataFrame:
    """Per column (lower, upper, applies, n_outliers) plus the number of
    rows flagged in at least one applicable column (``n_rows_flagged``)."""
    bounds = outlier_bounds(df, cols, alpha=alpha, k=k, gate=gate, exclude=exclude)
    rows = _bounds_rows(bounds)
    aggs = []
    any_out = F.lit(False)
    for i, r in enumerate(rows):
        if r["lower"] is None:
            aggs.append(F.lit(0).cast("long").alias(f"_n{i}"))
            continue
        out = _outside(r["column"], r["lower"], r["upper"])
        aggs.append(F.sum(F.when(out, 1).otherwise(0)).cast("long").alias(f"_n{i}"))
        if r["applies"]:
            any_out = any_out | out
    aggs.append(F.sum(F.when(any_out, 1).otherwise(0)).cast("long").alias("_any"))
    counts = df.agg(*aggs)  # one scan for all columns
    stacked = counts.select(F.explode(F.array(*[
        F.struct(F.lit(r["column"]).alias("column"), F.col(f"_n{i}").alias("n_outliers"))
        for i, r in enumerate(rows)])).alias("s"), F.col("_any").alias("n_rows_flagged"))
    stacked = stacked.select("s.column", "s.n_outliers", "n_rows_flagged")
    return bounds.select("column", "lower", "upper", "applies").join(stacked, "column")


def cardinality(df: DataFrame, label: str | None = None, threshold: float = 0.99999,
                approx: bool = False, approx_margin: float = 0.05) -> DataFrame:
    """(column, n, n_distinct, ratio, is_id_like) for every column.

    ``n`` counts all rows (nulls too), ``n_distinct`` non-null distinct
    values, id-like means ``ratio > threshold`` (strict) and not the label.
    Exact counts use one unpivot and a two-level ``groupBy`` (both levels
    partially aggregated map-side) that also yields the row count, so the
    table is scanned once.  ``approx=True`` first estimates with
    ``approx_count_distinct`` and counts exactly only near-unique columns.
    """
    label = resolve_label(df, label)
    cols = list(df.columns)
    spark = df.sparkSession
    approx_ratio = {}
    exact_cols = cols
    n = None
    if approx:
        est = df.agg(F.count(F.lit(1)).alias("_rows"),
                     *[F.approx_count_distinct(F.col(q(c)), 0.01).alias(f"_a{i}")
                       for i, c in enumerate(cols)]).first()
        n = int(est["_rows"])
        approx_ratio = {c: (est[f"_a{i}"] / n if n else 0.0) for i, c in enumerate(cols)}
        exact_cols = [c for c in cols if approx_ratio[c] > threshold - approx_margin]
    present, rows_seen = {}, None
    if exact_cols:
        as_text = []
        for c in exact_cols:
            col = F.col(q(c))
            dt = df.schema[c].dataType.simpleString()
            if dt in ("float", "double"):  # -0.0 equals 0.0, NaN is missing
                col = F.when(col == 0, F.lit(0.0)).when(F.isnan(col), F.lit(None)).otherwise(col)
            as_text.append(col.cast("string").alias(c))
        wide = df.select(*as_text)
        long = wide.unpivot([], [F.col(q(c)) for c in exact_cols], "column", "value")
        # level 1 keeps null as a value so that sum(cnt) is the row count:
        # rows and distinct values come out of the same pass
        per = (long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
               .groupBy("column").agg(F.count("value").alias("n_distinct"),
                                      F.sum("cnt").alias("rows")))
        got = per.collect()  # <= #columns rows
        present = {r[0]: r[1] for r in got}
        rows_seen = max((int(r[2]) for r in got), default=0)
    if n is None:
        n = rows_seen if rows_seen is not None else df.count()
    out = []
    for c in cols:
        nd = int(present.get(c, 0)) if c in exact_cols else int(round(approx_ratio[c] * n))
        ratio = nd / n if n else 0.0
        out.append((c, int(n), nd, float(ratio), bool(ratio > threshold and c != label)))
    return spark.createDataFrame(
        out, "column string, n long, n_distinct long, ratio double, is_id_like boolean")


def drop_id_like(df: DataFrame, label: str | None = None, threshold: float = 0.99999,
                 approx: bool = False) -> DataFrame:
    """Drop columns flagged id-like by B7."""
    card = cardinality(df, label, threshold, approx=approx)
    ids = [r[0] for r in card.where("is_id_like").select("column").collect()]
    return df.drop(*ids)


@dataclass
class CleanReport:
    bounds: DataFrame | None
    dropped_columns: list
    persisted: DataFrame | None = None  # unpersist when the cleaned table is done with


def clean(df: DataFrame, task: str = "classification", label: str | None = None,
          drop_nulls: bool = True, drop_dups: bool = True, alpha: float = 0.05,
          k: float = 1.5, gate: bool = True, exclude=(), threshold: float = 0.99999,
          return_report: bool = False, keep=()):
    """Drop nulls -> drop duplicates -> drop outliers -> drop id-like columns.

    ``drop_nulls``/``drop_dups`` default to True (the stated intent); set
    them False to keep every row as the original pipeline effectively did.
    ``keep`` names row-identifier columns that stay even when id-like (they
    still take part in the outlier rule, like every numeric column).
    """
    label = resolve_label(df, label)
    out = df
    if drop_nulls:
        out = drop_null_rows(out)
    persisted = None
    if drop_dups:
        # the distinct shuffle feeds the statistics passes and every later
        # consumer: compute it once (recomputable from lineage on executor loss)
        out = drop_duplicate_rows(out).persist(StorageLevel.MEMORY_AND_DISK)
        persisted = out
    bounds = outlier_bounds(out, alpha=alpha, k=k, gate=gate, exclude=exclude)
    out = drop_outliers(out, bounds=bounds)
    card = cardinality(out, label, threshold)
    ids = [r[0] for r in card.where("is_id_like").select("column").collect()]
    out = out.drop(*[c for c in ids if c not in set(keep)])
    if return_report:
        return out, CleanReport(bounds, ids, persisted)
    return out

"""Label encoding of categorical columns.

A fitted encoder is a DataFrame ``(column, value, code)``: the sorted
distinct values of each column get codes 0..k-1 (code-point order, which is
Spark's binary string order).  Codes come from distributed ranks over the
distinct values, so a column with millions of categories is not sorted in
one task.

Applying an encoder: tiny maps (<= ``LITERAL_MAX`` entries) become a literal
map lookup (no join); larger ones are joined, broadcast
only when their counted size is under ``BROADCAST_MAX`` rows, else a
shuffle join.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtune.functions.columns import categorical_columns, q
from tabtune.operators.ranks import value_ranks
from tabtune.operators.select import near

LITERAL_MAX = 64


def fit_label_encoder(df: DataFrame, cols=None) -> DataFrame:
    """(column, value, code) from the rows of ``df`` (train rows)."""
    cols = cols if cols is not None else categorical_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, value string, code int")
    wide = df.select(*[F.col(q(c)).cast("string").alias(c) for c in cols])
    long = wide.unpivot([], [F.col(q(c)) for c in cols], "column", "value")
    distinct = (long.where(F.col("value").isNotNull()).distinct()
                .withColumn("cnt", F.lit(1).cast("long")))
    ranked = value_ranks(distinct, "column", "value")
    mapping = (ranked.select("column", "value", F.col("start").cast("int").alias("code"))
               .persist(StorageLevel.MEMORY_AND_DISK_DESER))
    mapping.count()
    ranked.unpersist()
    return mapping


def _small_maps(mapping: DataFrame, cols) -> tuple[dict, dict]:
    """Of all columns in one job each: their numbers of values, and the rows of
    those that have at most ``LITERAL_MAX``."""
    own = mapping.where(F.col("column").isin(list(cols)))
    sizes = {r["column"]: r["count"] for r in own.groupBy("column").count().collect()}  # one row a column
    small = [c for c in cols if sizes.get(c, 0) <= LITERAL_MAX]
    rows: dict = {c: [] for c in small}
    for r in own.where(F.col("column").isin(small)).select("column", "value", "code").collect() if small else ():
        rows[r["column"]].append(r)
    return sizes, rows


def _lookup(df: DataFrame, mapping: DataFrame, column: str, src: str, dst: str, unseen: str,
            value_type: str, size: int, rows: list | None):
    """Replace column ``column`` by its mapped value; returns new df."""
    col = F.col(q(column)).cast(value_type if src == "code" else "string")
    kind = "int" if dst == "code" else "string"
    if rows is not None:
        pairs = [F.lit(r[x]) for r in rows for x in (src, dst)]
        mapped = F.lit(None)
        if rows:
            mapped = F.when(col.isNull(), F.lit(None)).otherwise(
                F.try_element_at(F.create_map(*pairs), col))
        return df.withColumn(column, _unseen(mapped, col, column, unseen, size).cast(kind))
    lk = mapping.where(F.col("column") == column).select(F.col(src).alias("_k"), F.col(dst).alias("_v"))
    # broadcast only if its bytes are few (see select.near)
    tmp = df.withColumn("_k", col).join(near(lk.select("_v", "_k") if src == "code" else lk), "_k", "left")
    new = _unseen(F.col("_v"), F.col("_k"), column, unseen, size)
    return tmp.withColumn(column, new.cast(kind)).drop("_k", "_v")


def _unseen(mapped, original, column, unseen, size):
    if unseen == "error":
        return F.when(original.isNotNull() & mapped.isNull(),
                      F.raise_error(F.concat(F.lit(f"unseen label in column {column}: "),
                                             original.cast("string")))).otherwise(mapped)
    if unseen == "keep":
        return F.when(original.isNotNull() & mapped.isNull(), F.lit(size)).otherwise(mapped)
    raise ValueError("unseen must be 'error' or 'keep'")


def _mapped(df: DataFrame, mapping: DataFrame, cols, src: str, dst: str, unseen: str, kind: str) -> DataFrame:
    cols = cols if cols is not None else [
        r[0] for r in mapping.select("column").distinct().collect()]
    cols = [c for c in df.columns if c in set(cols)]
    sizes, rows = _small_maps(mapping, cols) if cols else ({}, {})
    out = df
    for c in cols:
        out = _lookup(out, mapping, c, src, dst, unseen, kind, sizes.get(c, 0), rows.get(c))
    return out


def apply_label_encoder(df: DataFrame, mapping: DataFrame, cols=None,
                        unseen: str = "error") -> DataFrame:
    """C4: replace each encoded column by its integer code."""
    return _mapped(df, mapping, cols, "value", "code", unseen, "string")


def decode(df: DataFrame, mapping: DataFrame, cols=None) -> DataFrame:
    """Map codes back to the original values."""
    return _mapped(df, mapping, cols, "code", "value", "error", "int")


def encode_target(df: DataFrame, label: str, fit_on: DataFrame | None = None):
    """Label -> 0..k-1 fitted on ``fit_on`` (train rows); returns (df, mapping)."""
    mapping = fit_label_encoder(fit_on if fit_on is not None else df, [label])
    return apply_label_encoder(df, mapping, [label]), mapping


def encode_all(df: DataFrame, cols=None):
    """Clustering: encode every categorical column over the whole table."""
    cols = cols if cols is not None else categorical_columns(df)
    mapping = fit_label_encoder(df, cols)
    return apply_label_encoder(df, mapping, cols), mapping

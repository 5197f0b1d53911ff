"""Column roles and projections.

All of these are schema-level: they build ``select``/``drop`` projections
that Catalyst prunes down to the Parquet/CSV scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
#: Dates and times are categories, as in a table read without parsing them; rows
#: to come may hold others, so their encoding has a code for unseen ones.
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
CATEGORICAL_TYPES = (T.StringType, T.BooleanType, *DATE_TYPES)


def q(name: str) -> str:
    """Back-quote a column name for SQL text (names may hold spaces, '$')."""
    return "`" + name.replace("`", "``") + "`"


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if is_numeric(f.dataType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, CATEGORICAL_TYPES) and f.name not in exclude]


def date_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATE_TYPES) and f.name not in exclude]


def require_flat(df: DataFrame, exclude=()) -> None:
    """Nested, binary and other columns that are neither numbers nor categories
    are named in an error before any job runs."""
    other = [f"{f.name} ({f.dataType.simpleString()})" for f in df.schema.fields
             if not is_numeric(f.dataType) and not isinstance(f.dataType, CATEGORICAL_TYPES) and f.name not in exclude]
    if other:
        raise ValueError(f"columns that cannot be features: {', '.join(other)}; project them away or unnest them")


def resolve_label(df: DataFrame, label: str | None) -> str:
    """Missing (or the literal text 'None') label means the last column."""
    if label is None or label == "None":
        return df.columns[-1]
    if label not in df.columns:
        raise ValueError(f"label {label!r} is not a column of the table")
    return label


def column_roles(df: DataFrame, label: str | None = None) -> DataFrame:
    """A2: one row per column: (position, column, type, role)."""
    label = resolve_label(df, label)
    rows = []
    for i, f in enumerate(df.schema.fields):
        if f.name == label:
            role = "label"
        elif is_numeric(f.dataType):
            role = "numeric"
        elif isinstance(f.dataType, CATEGORICAL_TYPES):
            role = "categorical"
        else:
            role = "other"
        rows.append((i, f.name, f.dataType.simpleString(), role))
    spark = df.sparkSession
    return spark.createDataFrame(
        rows, "position int, column string, type string, role string")


def label_last(df: DataFrame, label: str | None = None) -> DataFrame:
    """Move the label to the last position."""
    label = resolve_label(df, label)
    return df.select(*[F.col(q(c)) for c in df.columns if c != label], F.col(q(label)))


def split_features_target(df: DataFrame, label: str | None = None):
    """Features and label stay in the same row; returns (df, features, label)."""
    label = resolve_label(df, label)
    features = [c for c in df.columns if c != label]
    return label_last(df, label), features, label


def select_columns(df: DataFrame, cols) -> DataFrame:
    """Optional projection (``columns_to_plot``)."""
    if not cols:
        return df
    return df.select(*[F.col(q(c)) for c in cols])


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """P4."""
    return df.drop(*cols)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing values are null in this engine; NaN in float columns becomes
    null so that comparisons and aggregates treat it as missing."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            out.append(F.nanvl(F.col(q(f.name)), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(q(f.name)))
    return df.select(*out)


def unpivot_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long form (column, value double) of the numeric columns, nulls removed.
    Uses Spark's Expand (one pass, no shuffle)."""
    wide = df.select(*[F.col(q(c)).cast("double").alias(c) for c in cols])
    long = wide.unpivot([], [F.col(q(c)) for c in cols], "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))

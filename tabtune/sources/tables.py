"""Sources and sinks (A1, A3, A4).

CSV with a header row and inferred types is the reference's input format;
Parquet is read with its own schema (and gets predicate/column pushdown).
Missing values are null: NA-like tokens in CSV text become null on read; a
floating NaN is treated as missing by every operator.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtune.functions.columns import label_last, nan_to_null, q, resolve_label

# Text tokens read as missing (the usual CSV NA spellings).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]


#: Java's casts also take suffixes (1d, 2f) that are text in a CSV file.
NUMBER = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"


def read_table(spark: SparkSession, path: str, fmt: str = "csv",
               schema: T.StructType | str | None = None, na_tokens=None,
               nan_as_null: bool | None = None) -> DataFrame:
    """A1: read a table; CSV gets header + type inference unless a schema is given.

    Columnar sources are returned as scanned (no projection on top), so
    later filters and projections push into the scan; every operator treats
    a floating NaN as missing itself.  ``nan_as_null=True`` rewrites NaN to
    null on read instead (at the price of that pushdown)."""
    if fmt != "csv":
        reader = spark.read
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.parquet(path) if fmt == "parquet" else reader.format(fmt).load(path)
        return nan_to_null(df) if nan_as_null else df
    tokens = NA_TOKENS if na_tokens is None else list(na_tokens)
    text = _csv_text(spark, path)
    cleaned = text.select(*[F.when(F.trim(F.col(q(c))).isin(tokens), F.lit(None))
                            .otherwise(F.col(q(c))).alias(c) for c in text.columns])
    if schema is not None:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        if len(fields) != len(text.columns):
            raise ValueError(f"{path}: {len(text.columns)} columns, the schema has {len(fields)}")
        return nan_to_null(cleaned.select(*[
            (F.col(q(c)) if isinstance(f.dataType, T.StringType) else F.trim(F.col(q(c))).cast(f.dataType))
            .alias(f.name) for c, f in zip(cleaned.columns, fields)]))
    inferred = _infer_types(cleaned)
    return nan_to_null(inferred)


def _same(uri: str) -> str:
    """A file's URI in one spelling: file:/x and file:///x are the same."""
    return re.sub(r"^(\w+):/+", r"\1:/", unquote(uri))


def _csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted fields may hold line breaks and doubled quotes.

    A file with a quoted line break has to be read as a whole.  Such a break
    leaves a line with an odd number of quotes, so the lines are counted first,
    with the splittable text reader; all other files are read in splits."""
    def reader(whole: bool):      # options change a reader in place, so each read has its own
        return (spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"')
                .option("inferSchema", False).option("multiLine", whole))

    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    # one row a file with such a line reaches the driver
    broken = sorted(r[0] for r in lines.where(quotes % 2 == 1).select(
        F.col("_metadata.file_path")).distinct().collect())
    if not broken:
        return reader(False).csv(path)
    odd = {_same(f) for f in broken}
    plain = sorted(unquote(f) for f in lines.inputFiles() if _same(f) not in odd)
    if not plain:
        return reader(True).csv(path)
    names = reader(True).csv(path).schema          # of the first file, as in one read
    return reader(False).schema(names).csv(plain).unionAll(
        reader(True).schema(names).csv([unquote(f) for f in broken]))


def _infer_types(df: DataFrame) -> DataFrame:
    """Per column the narrowest of int, bigint, double, boolean, string that
    every non-null value parses as (one aggregation over all columns)."""
    checks = []
    for i, c in enumerate(df.columns):
        x = F.trim(F.col(q(c)))
        checks += [
            F.min(F.when(x.isNull(), True).otherwise(x.try_cast("int").isNotNull())).alias(f"i{i}"),
            F.min(F.when(x.isNull(), True).otherwise(x.try_cast("bigint").isNotNull())).alias(f"l{i}"),
            F.min(F.when(x.isNull(), True).otherwise(x.rlike(NUMBER) & x.try_cast("double").isNotNull()))
            .alias(f"d{i}"),
            F.min(F.when(x.isNull(), True).otherwise(F.lower(x).isin("true", "false"))).alias(f"b{i}"),
            F.count(x).alias(f"n{i}")]
    flags = df.agg(*checks).first()  # 5 numbers per column
    out = []
    for i, c in enumerate(df.columns):
        x = F.trim(F.col(q(c)))
        if flags[f"n{i}"] == 0:
            out.append(F.col(q(c)).cast("string").alias(c))
        elif flags[f"i{i}"]:
            out.append(x.cast("int").alias(c))
        elif flags[f"l{i}"]:
            out.append(x.cast("bigint").alias(c))
        elif flags[f"d{i}"]:
            out.append(x.cast("double").alias(c))
        elif flags[f"b{i}"]:
            out.append((F.lower(x) == "true").alias(c))
        else:
            out.append(F.col(q(c)).alias(c))
    return df.select(*out)


def preview(df: DataFrame, n: int = 10, order_by=None, label: str | None = None) -> DataFrame:
    """A3: the first ``n`` rows by an explicit key (Spark tables have no file
    order), label moved last.  Plans as TakeOrderedAndProject (top-n per task)."""
    out = label_last(df, resolve_label(df, label)) if label is not False else df
    keys = [order_by] if isinstance(order_by, str) else list(order_by or out.columns)
    return out.orderBy(*[F.col(q(k)) for k in keys]).limit(n)


def write_results(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """A4: write a result table (the previous run's output is replaced)."""
    df.write.mode(mode).format(fmt).save(path)

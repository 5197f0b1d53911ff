"""The EDA report - every plot's numbers for one table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tabtune.functions.columns import numeric_columns, select_columns
from tabtune.operators import describe as D


def eda_report(df: DataFrame, columns=None, key=None, bins="auto",
               pair_fraction: float = 1.0) -> dict:
    """D1-D5 over the (recombined, encoded, scaled) table.

    Returns a dict of DataFrames: correlation, box, histograms, pairs, fliers.
    The input is persisted (memory and disk) while the summaries run; the
    caller unpersists via ``report['_input'].unpersist()``.
    """
    data = select_columns(df, columns).persist(StorageLevel.MEMORY_AND_DISK)
    cols = numeric_columns(data, exclude=[key] if key else ())
    return {
        "correlation": D.correlation_matrix(data, cols),
        "box": D.box_stats(data, cols),
        "histograms": D.histograms(data, cols, bins),
        "pairs": D.pair_points(data, cols, key=key, fraction=pair_fraction),
        "fliers": D.fliers(data, cols, key=key),
        "_input": data,
    }

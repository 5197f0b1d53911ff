"""A5: persist and reload fitted models (Spark ML ``PipelineModel``).

Any Hadoop-compatible path works (local, HDFS, object stores with their
connector on the classpath); no storage client of our own.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)

"""From raw documents to training batches in five stages.

Each stage takes what the one before kept and returns the documents it keeps,
with the columns of ``documents``; the mixture repeats those that it takes for
a second epoch, and the last returns the packed pieces.

Defined results: null texts and hosts, repeated rows and ids, empty tables and
further columns are treated as the stages' operators state; the quality rules
already drop null and wordless texts, as these fail the rule on length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtune.llm import mixing, neardup, packing, pii, quality
from tabtune.llm.frames import saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans in the texts are replaced by their kinds; lengths follow."""
    out = pii.mask(docs, pii.train(docs))
    if "n_chars" in out.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast(kind)))
    return out


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of op2; a document stands once for each epoch that takes it."""
    return mixing.mix_documents(docs, mixing.FRACTION, mixing.EPOCHS)


def length_buckets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mixture", source_mixture),
    ("length_buckets", length_buckets),
]

#: The stage on personal data has a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""train/test split by hashing a row key.

``randomSplit`` depends on partition layout (it changes after a
``repartition``), so it is not used.  A row's side is a pure function of its
key and the seed: ``md5(key || ':' || seed)``; the first 8 hex digits give a
bucket in [0, 10000).  No shuffle, stable under any partitioning, and the
same text runs in DuckDB.

``exact=True`` reproduces the exact test size ``ceil(fraction * n)``
(per class for the stratified split): the threshold of the hash (ties broken
by the key, then by a digest of the row) is selected by counting leading bits.
"""

from __future__ import annotations


from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabtune.functions.columns import q
from tabtune.operators.select import near, radix_threshold

BUCKETS = 10000


def key_text(df: DataFrame, key) -> "F.Column":
    keys = [key] if isinstance(key, str) else list(key or [])
    if not keys:  # no key: all columns identify the row
        keys = df.columns
    return F.concat_ws(":", *[F.col(q(k)).cast("string") for k in keys])


def hash_bucket(df: DataFrame, key, seed: int = 42) -> "F.Column":
    h = F.md5(F.concat_ws(":", key_text(df, key), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % BUCKETS


def hash_unit(df: DataFrame, key, seed: int = 42) -> "F.Column":
    """Uniform number in [0, 1) from 52 bits of the row hash: a sampling
    fraction as small as 1e-15 still selects by hash (no row cap needed)."""
    h = F.md5(F.concat_ws(":", key_text(df, key), F.lit(str(seed))))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def _hash60(text: "F.Column") -> "F.Column":
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def row_text(df: DataFrame) -> "F.Column":
    """The whole row as text: only equal rows have the same."""
    return F.to_json(F.struct(*[F.col(q(c)) for c in df.columns]), {"ignoreNullFields": "false"})


def train_test_split(df: DataFrame, key=None, test_fraction: float = 0.2, seed: int = 42,
                     exact: bool = False) -> DataFrame:
    """Adds ``split`` in {'train', 'test'} (unstratified)."""
    if not exact:
        cut = int(round(test_fraction * BUCKETS))
        return df.withColumn("split", F.when(hash_bucket(df, key, seed) < cut, "test")
                             .otherwise("train"))
    return _exact_split(df, key, None, test_fraction, seed)


def stratified_split(df: DataFrame, label: str, key=None, test_fraction: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Per class, the ``ceil(fraction * n_class)`` rows with the smallest
    hash go to test, so class proportions are kept."""
    return _exact_split(df, key, label, test_fraction, seed)


def _exact_split(df, key, label, test_fraction, seed):
    """Rows in the order of (15 hex digits of the key's hash, key, digest of
    the row); the row at the threshold is found by counting leading bits
    (``select.radix_threshold``), so this is a few narrow scans and no sort."""
    grp = F.coalesce(F.col(q(label)).cast("string") if label else F.lit("all"), F.lit("\u0000null"))
    kt = key_text(df, key)
    h = _hash60(F.concat_ws(":", kt, F.lit(str(seed))))
    digest = _hash60(row_text(df))
    thr = radix_threshold(df.withColumns({"_grp": grp, "_h": h, "_key": kt}), test_fraction,
                          "_grp", "_h", "_key", digest)
    thr = thr.select("_grp", "thr_h", "thr_key", "thr_digest", F.col("cnt").alias("_cnt"),
                     F.col("need").alias("_need"))
    out = df.withColumn("_grp", grp).join(near(thr), "_grp", "left")
    # Key and digest are compared for rows with the threshold's hash only.
    place = (F.when(F.col("thr_h").isNull() | (h > F.col("thr_h")), 1).when(h < F.col("thr_h"), -1)
             .when(kt != F.col("thr_key"), F.when(kt < F.col("thr_key"), -1).otherwise(1))
             .when(digest == F.col("thr_digest"), 0).when(digest < F.col("thr_digest"), -1).otherwise(1))
    out = out.withColumn("_place", place)
    test = F.col("_place") <= 0
    if not thr.where("_cnt > _need").isEmpty():     # of equal rows at a threshold, as many as are needed
        out = out.where("_place <> 0").withColumn("_pos", F.lit(0).cast("long")).unionByName(
            _numbered(out.where("_place = 0"), "_grp", "_pos"))
        test = (F.col("_place") < 0) | ((F.col("_place") == 0) & (F.col("_pos") <= F.col("_need")))
    return (out.withColumn("split", F.when(test, "test").otherwise("train"))
            .drop("_grp", "thr_h", "thr_key", "thr_digest", "_cnt", "_need", "_place", "_pos"))


def _numbered(rows: DataFrame, grp: str, name: str) -> DataFrame:
    """Numbers from 1 within each group of equal rows: a count of each partition
    and the place inside it, so that no group meets in one task."""
    rows = (rows.withColumn("_part", F.spark_partition_id())
            .withColumn("_row", F.monotonically_increasing_id())
            .persist(StorageLevel.MEMORY_AND_DISK))
    sizes = rows.groupBy(grp, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(grp).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(grp, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(grp, "_part").orderBy("_row")      # rows of one task
    return (rows.join(near(starts), [grp, "_part"])
            .withColumn(name, F.col("_start") + F.row_number().over(inside)).drop("_part", "_row", "_start"))

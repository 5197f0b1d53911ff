"""Spark helpers shared by the operators: shared scratch tables, row numbers.

``saved`` is the one way this subpackage cuts lineage: it writes a table
below the folder that the cluster names in ``spark.checkpoint.dir`` and reads
it back, so a lost executor costs a re-read and never a recomputation of
something that could come out differently.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; only
    where that is unset (tests on one machine) a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        where = spark._jvm.org.apache.hadoop.fs.Path(named)
        uri = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
        return re.sub(r"^file:/+", "file:///", uri).rstrip("/")
    if "dir" not in _local:
        _local["dir"] = "file://" + tempfile.mkdtemp(prefix="tabtune-shared-")
    return _local["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    if jvm is not None and not spark.sparkContext._jsc.sc().isStopped():
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver exits."""
    path = f"{shared_dir(spark)}/tabtune/{name}-{uuid.uuid4().hex}"

    def gone() -> None:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass

    atexit.register(gone)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, order: list[str], number: str) -> DataFrame:
    """``df`` with its 0-based global row number in ``order``.

    Range partitions are sorted one by one; the offsets (one row for each
    partition, which bounds the broadcast) make the numbers global.  The
    sorted rows are saved with partition and position first, so both passes
    see the same numbers.
    """
    part, pos = fresh(df, "_part", "_pos")
    rows = (df.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn(part, F.spark_partition_id())
            .withColumn(pos, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    rows = saved(rows, "numbered")
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return (rows.join(F.broadcast(starts), part)
            .withColumn(number, F.col("_start") + F.col(pos)).drop(part, pos, "_start"))


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of a partition that is sorted by two integer columns, its first
    ones, pair by pair."""
    key, some = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(2)]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)]))
        for at, to in zip(heads, np.append(heads[1:], batch.num_rows)):
            own = (int(cols[0][at]), int(cols[1][at]))
            if own != key and some:
                yield key, pa.Table.from_batches(some)
                some = []
            key = own
            some.append(batch.slice(at, to - at))
    if some:
        yield key, pa.Table.from_batches(some)

"""Exact ranks of values within groups, without a single-task window.

A ``Window.partitionBy(column).orderBy(value)`` puts a whole column (or a
whole class) into one task; at 100 TB, or when one group holds a third of
all rows, that task does not finish.  Instead:

1. ``groupBy(group, value).count()`` - map-side partial aggregation, so a
   value repeated a billion times is one row with ``cnt = 1e9``;
2. ``repartitionByRange(group, value)`` + ``sortWithinPartitions`` - the
   distinct values are spread evenly over all tasks, each task holding a
   contiguous value range;
3. ``persist`` - the range bounds live in the shuffle's partitioner, so
   a lost cached partition is recomputed with the same bounds and the same
   contents; the two passes below read one consistent partitioning;
4. per (group, partition) totals - at most ``partitions x groups`` rows -
   become exclusive offsets with a window over that tiny table;
5. a per-partition running sum (``mapInPandas`` over the sorted partition,
   no shuffle) plus the broadcast offset gives each value its first rank;
6. the ranked table is persisted and materialised (its consumers read it
   several times) and the intermediate is released.  Ranks are a function
   of the data alone, so recomputing any lost piece yields the same values.
   Callers ``unpersist`` the result when done (summary operators do it
   themselves and return small, already computed DataFrames).

Result columns: ``group, value, cnt, start`` where ranks ``start+1 ..
start+cnt`` (1-based) hold ``value``; ``n`` = rows of the group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark import StorageLevel



#: Largest table of offsets that is sent to every executor.
BROADCAST_BYTES = 32 << 20


def _local_starts(batches):
    """Exclusive running count per group inside one sorted partition."""
    carried: dict = {}
    for pdf in batches:
        if pdf.empty:
            yield pdf.assign(local_start=pd.Series([], dtype="int64"))
            continue
        grp = pdf["grp"]
        csum = pdf.groupby("grp", sort=False)["cnt"].cumsum() - pdf["cnt"]
        base = grp.map(carried).fillna(0).astype("int64")
        local = (csum + base).astype("int64")
        last = pdf.assign(_end=local + pdf["cnt"]).groupby("grp", sort=False)["_end"].last()
        carried.update(last.to_dict())
        yield pdf.assign(local_start=local)


def value_ranks(counts: DataFrame, group: str, value: str,
                partitions: int | None = None) -> DataFrame:
    """Exact ranks from a pre-aggregated ``(group, value, cnt)`` table.

    ``value`` may be any orderable type (numbers, strings, hashes).
    """
    base = counts.select(F.col(group).alias("grp"), F.col(value).alias("val"),
                         F.col("cnt").cast("long").alias("cnt"))
    parts = [partitions] if partitions else []     # else Spark decides
    ranged = (base.repartitionByRange(*parts, "grp", "val")
              .sortWithinPartitions("grp", "val")
              .withColumn("pid", F.spark_partition_id())
              .persist(StorageLevel.MEMORY_AND_DISK_DESER))

    totals = ranged.groupBy("grp", "pid").agg(F.sum("cnt").alias("part_n"))
    w = Window.partitionBy("grp").orderBy("pid")
    offsets = (totals
               .withColumn("part_start", F.coalesce(
                   F.sum("part_n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).cast("long"))
               .withColumn("n", F.sum("part_n").over(Window.partitionBy("grp")).cast("long"))
               .drop("part_n"))

    schema = T.StructType(ranged.schema.fields + [T.StructField("local_start", T.LongType())])
    local = ranged.mapInPandas(_local_starts, schema)
    # A row for each group and partition: broadcast only if their bytes are few.
    offsets = offsets.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    size = offsets.agg(F.sum(F.coalesce(F.octet_length(F.col("grp").cast("string")), F.lit(0)) + 40)).first()[0]
    near = F.broadcast(offsets) if (size or 0) <= BROADCAST_BYTES else offsets
    out = (local.join(near, ["grp", "pid"])
           .select(F.col("grp").alias(group), F.col("val").alias(value), "cnt",
                   (F.col("part_start") + F.col("local_start")).alias("start"), "n"))
    out = out.persist(StorageLevel.MEMORY_AND_DISK_DESER)
    out.count()  # materialise while the partitioning is cached
    ranged.unpersist()
    offsets.unpersist()
    return out


def small_result(df: DataFrame, *release: DataFrame) -> DataFrame:
    """Compute a small summary (one row per column / class / candidate),
    hand it back as a local DataFrame and release the cached inputs."""
    rows = df.collect()
    out = df.sparkSession.createDataFrame(rows, df.schema)
    for r in release:
        if r is not None:
            r.unpersist()
    return out


def column_value_ranks(long: DataFrame, partitions: int | None = None) -> DataFrame:
    """Ranks of numeric values per column from the long ``(column, value)`` form."""
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return value_ranks(counts, "column", "value", partitions)


def linear_quantiles(ranked: DataFrame, probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Linear-interpolated quantiles (pandas / numpy default, DuckDB
    ``quantile_cont``) per column of a numeric ``column_value_ranks`` table.

    Returns a DataFrame ``(column, n, q_<p>...)`` computed with one
    aggregation over the ranked table; target ranks are computed per row
    from ``n`` so no driver round trip is needed.
    """
    aggs = [F.first("n").alias("n")]
    for p in probs:
        h = (F.col("n") - 1) * F.lit(float(p))
        lo = F.floor(h).cast("long")
        hi = F.least(lo + 1, F.col("n") - 1)
        in_lo = (F.col("start") <= lo) & (lo < F.col("start") + F.col("cnt"))
        in_hi = (F.col("start") <= hi) & (hi < F.col("start") + F.col("cnt"))
        tag = _ptag(p)
        aggs += [F.max(F.when(in_lo, F.col("value"))).alias(f"_lo_{tag}"),
                 F.max(F.when(in_hi, F.col("value"))).alias(f"_hi_{tag}"),
                 F.first((h - F.floor(h)).cast("double")).alias(f"_fr_{tag}")]
    agg = ranked.groupBy("column").agg(*aggs)
    cols = [F.col("column"), F.col("n")]
    for p in probs:
        tag = _ptag(p)
        lo, hi, fr = F.col(f"_lo_{tag}"), F.col(f"_hi_{tag}"), F.col(f"_fr_{tag}")
        cols.append((lo + fr * (hi - lo)).alias(f"q_{tag}"))
    return agg.select(*cols)


def _ptag(p: float) -> str:
    """0.25 -> '25', 0.5 -> '5', 0.0 -> '0', 1.0 -> '1'."""
    text = repr(float(p))
    if text in ("0.0", "1.0"):
        return text[0]
    return text.replace("0.", "").replace(".", "_")

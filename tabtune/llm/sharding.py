"""Reproducible shuffle into shards by a Feistel permutation of row numbers.

Rows get global numbers in the order of their id; a keyed permutation of
0..n-1 (an unbalanced Feistel network over the smallest a x b grid that holds
n, with cycle walking for the few cells beyond n) gives each row its place in
the shuffle.  Place p of s shards is shard ``p % s``, slot ``p div s``: shard
sizes differ by one at most, slots are gapless, and both can be computed from
the row number alone.

Defined results: a null text has size 1 and checksum 0; rows with equal or
null ids (nulls first) are numbered in the order of size and checksum, and
rows equal in all of these are interchangeable; an empty table gives an empty
result; columns other than id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabtune.llm.frames import numbered

ROUNDS = 4


def _round(half: Column, seed: int, i: int) -> Column:
    """Round function: the first 32 bits of the MD5 of "seed:round:half"."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{i}:"), half.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permute(df: DataFrame, value: str, n: int, seed: int, where: Column | None = None) -> DataFrame:
    """``value`` (0 to a b - 1) moved once through the network, where asked."""
    a, b = grid(n)
    out = df.withColumns({"_l": F.col(value) % a, "_r": F.expr(f"{value} div {a}")})
    for i in range(0, ROUNDS, 2):
        out = out.withColumn("_l", (F.col("_l") + _round(F.col("_r"), seed, i)) % a)
        out = out.withColumn("_r", (F.col("_r") + _round(F.col("_l"), seed, i + 1)) % b)
    moved = F.col("_r") * a + F.col("_l")
    moved = moved if where is None else F.when(where, moved).otherwise(F.col(value))
    return out.withColumn(value, moved).drop("_l", "_r")


def walk_steps(spark, n: int, seed: int) -> int:
    """Most extra steps that a walk needs.  A walk that leaves 0..n-1 passes
    only cells beyond n, fewer than sqrt(n) + 1, and never one twice."""
    a, b = grid(n)
    steps, beyond = 0, spark.range(n, a * b).toDF("v")
    while not beyond.isEmpty():
        steps += 1
        beyond = permute(beyond, "v", n, seed).where(f"v >= {n}")
    return steps


def shuffled(df: DataFrame, order: list[str], place: str, seed: int) -> DataFrame:
    """``df`` with each row's place in the seeded shuffle of its ``order``."""
    rows = numbered(df, order, place)
    n = rows.count()
    steps = walk_steps(df.sparkSession, n, seed) if n else 0
    rows = permute(rows, place, max(n, 1), seed)
    for _ in range(steps):
        rows = permute(rows, place, n, seed, F.col(place) >= n)
    return rows


def shard(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id",
          text: str = "text") -> DataFrame:
    """id, size, checksum, shard and slot of every row."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       (F.octet_length(content) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"))
    rows = shuffled(rows, ["doc_id", "size", "text_crc32"], "place", seed)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                       (F.col("place") % shards).cast("int").alias("shard"),
                       F.expr(f"place div {shards}").alias("slot"),
                       F.lit(None).cast("int").alias("grown_shard"))


def query(docs: DataFrame) -> DataFrame:
    return shard(docs)


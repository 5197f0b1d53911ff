"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse integer rows (a dimension is a term).  Candidates form
blocks with one posting list for each term: the rows that have the term, and
their weights.  For some queries at a time, each term's postings are scattered
into dense arrays of scores; the best k of each block are partitioned out,
and the blocks' winners are merged.  Every query meets every block.

A task holds one block of candidates, whole and once, and the groups of
queries pass through it one by one, so candidates are shuffled once and queries
once for each block; a task's memory does not depend on either number.

Defined results: vectors that are null, empty, or hold nulls or non-finite
components (also after scaling), and rows with a null id, take no part; a query's own row is every
row with its id; repeated candidates count as often as they stand; ties go to
the smaller id; vectors of different lengths meet in the dimensions that both
have; scores beyond 64 bits are held at the largest one; other columns are not
read; no queries or no candidates give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabtune.llm.frames import grouped, saved
from tabtune.session import shuffle_partitions

LIMIT = np.iinfo(np.int64).max


def _matrix(table: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (scaled whole components as floats, short ones filled with 0)."""
    vectors = table.column("x").combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) and vectors.num_chunks else vectors
    offs = np.asarray(vectors.offsets)
    size = np.diff(offs)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = np.asarray(vectors.values)[offs[0]:offs[-1]]
    return table.column("id").to_numpy(), np.floor(out * scale)


def postings(rows: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray]]:
    """For each term the rows that have it and their weights; a term that most
    rows have is held densely, as a slice and every row's weight."""
    out = []
    for j in range(rows.shape[1]):
        at = np.flatnonzero(rows[:, j])
        dense = 2 * len(at) > len(rows)
        out.append((slice(None), np.ascontiguousarray(rows[:, j])) if dense else (at, rows[at, j]))
    return out


def accumulate(lists: list, n: int, queries: np.ndarray) -> np.ndarray:
    """Scores (candidates x queries): term by term, postings times weights.
    Each query's scores lie together in memory."""
    scores = np.zeros((len(queries), n), dtype=queries.dtype)
    part = np.empty_like(scores)
    for term, (at, weights) in enumerate(lists[:queries.shape[1]]):
        own = np.flatnonzero(queries[:, term])
        if not len(own) or not len(weights):
            continue
        if isinstance(at, slice) and 2 * len(own) > len(queries):
            scores += np.multiply(queries[:, term, None], weights, out=part)
        elif isinstance(at, slice):
            scores[own] += queries[own, term, None] * weights
        else:
            scores[np.ix_(own, at)] += queries[own, term, None] * weights
    return scores.T


def _exact(a: np.ndarray, b: np.ndarray) -> np.dtype:
    """The narrowest floats in which every sum of products is an exact whole
    number (below 2**24 or 2**53); else Python's integers."""
    bound = max(a.shape[1], 1) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return np.dtype(np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else object)


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and scores of one query, ties to smaller ids."""
    there = ids != own
    if not there.all():
        scores, ids = scores[there], ids[there]
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        scores, ids = scores[some], ids[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int = 20, scale: int = 64,
           cand_block: int = 1 << 16, query_block: int = 512, width: int = 8) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``queries``."""
    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vector).cast("array<double>")
        good = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < F.lit(math.inf))),
                          F.lit(False)) & (F.size(vector) > 0)
        return df.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))

    cands, asked = saved(whole(vectors), "candidates"), saved(whole(queries), "queries")
    n = cands.count()
    few = min(math.ceil(n / 1024), shuffle_partitions(vectors.sparkSession))      # small tables use all cores
    blocks = max(1, math.ceil(n / cand_block), few)
    groups = max(1, math.ceil(asked.count() / query_block))

    def dealt(n: int):          # evenly, whatever the ids are
        return F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).cast("int")

    each = asked.withColumn("g", dealt(groups)).withColumn("b", F.explode(F.expr(f"sequence(0, {blocks - 1})")))
    rows = cands.select(dealt(blocks).alias("b"), F.lit(-1).alias("g"), "id", "x").unionAll(
        each.select("b", "g", "id", "x"))
    rows = rows.repartition(blocks, "b").sortWithinPartitions("b", "g")

    def found(block: tuple, q_ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        _, ids, rows, held = block
        dims = min(q.shape[1], rows.shape[1])
        q, rows = q[:, :dims], rows[:, :dims]
        kind = _exact(q, rows)
        if kind == object:
            q, rows = (np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object) for x in (q, rows))
        q = q.astype(kind, copy=False)
        if (kind, dims) not in held:      # the block's posting lists, for all groups of this kind
            held[kind, dims] = postings(rows.astype(kind, copy=False))
        out: list[tuple] = []
        for at in range(0, len(q_ids), width):
            scores = accumulate(held[kind, dims], len(ids), q[at:at + width])
            for own, row in zip(q_ids[at:at + width], scores.T):
                near, score = best(row, ids, own, k)
                score = np.array([max(-LIMIT - 1, min(LIMIT, int(s))) for s in score], dtype=np.int64) \
                    if kind == object else score.astype(np.int64)
                out.append((np.full(len(near), own), near, score))
        arrays = [np.concatenate(x) for x in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for (b, g), table in grouped(batches):
            if g < 0:
                block = (b, *_matrix(table, scale), {})
            elif block is not None and block[0] == b:
                yield found(block, *_matrix(table, scale))

    met = rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def query(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, embeddings.where("vec_id % 20 = 0"), "vec_id", "embedding")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""

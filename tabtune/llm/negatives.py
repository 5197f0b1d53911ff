"""Hard-negative mining with spanning-tree bounds between anchors.

Anchors stand in groups of ``tree`` similar ones, and each group has a minimum
spanning tree over the distances of its vectors.  A task holds a block of
candidates, whole and once, and the groups of anchors pass through it one by
one.  The root of a group's tree is scored against the block.  For a child,
the scores of its parent plus or minus (length of the edge) x (norm of the
candidate) bound its own scores, as |<child - parent, c>| is no larger.  Where
a parent's score is itself only bounded, the bounds widen.  Only candidates
whose bounds overlap what the anchor looks for are rescored:

 1. positives: candidates of the anchor's label whose upper bound reaches the
    ``positives``-th best score known so far;
 2. negatives: candidates of other labels whose bounds overlap the window of one
    of the anchor's positives.

The blocks' winners are merged by a window over a few rows of each block.
Candidates are shuffled once a pass, anchors once for each block.  Every anchor
meets every block; nothing else is left out than what the bounds exclude.

Defined results: rows with a null id or label, and vectors that are null, empty
or hold nulls or non-finite components (also after scaling), take no part; an
anchor's own row is every row with its id; repeated anchors, candidates and
positives each count; ties go to the smaller id; vectors of different lengths
meet in the dimensions that both have; scores beyond 64 bits are held at the
largest one, also where windows are judged; without anchors or candidates the
result is empty; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabtune.llm.frames import grouped, numbered, saved
from tabtune.session import shuffle_partitions

#: Anchors of one tree; candidates that a task holds, and those bounded at once.
TREE, BLOCK, CHUNK = 256, 1 << 16, 4096
#: Below this, scores are whole numbers that doubles hold with room for bounds.
EXACT = 2.0 ** 50
LARGEST = np.iinfo(np.int64).max
#: Leading dimensions whose signs bring similar anchors together.
SIGNS = 24


def matrix(column: pa.ChunkedArray, scale: int) -> np.ndarray:
    """Vectors as rows of whole numbers, short ones filled with 0."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offs = np.asarray(lists.offsets)
    size = np.diff(offs)
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = np.asarray(lists.values)[offs[0]:offs[-1]]
    return np.floor(out * scale)


def spanning_tree(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of some vectors, grown from the first: the rows in
    the order in which they join, the place of each one's parent in that order
    (-1 for the root), and the length of the edge to it."""
    n = len(rows)
    order, parent, edge = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n)
    near, link = np.full(n, np.inf), np.zeros(n, np.int64)
    out = np.ones(n, dtype=bool)
    at = 0
    for place in range(n):
        order[place], out[at] = at, False
        if place:
            parent[place], edge[place] = link[at], near[at]
        far = np.sqrt(((rows - rows[at]) ** 2).sum(axis=1))
        closer = out & (far < near)
        near[closer], link[closer] = far[closer], place
        if place + 1 < n:
            at = int(np.flatnonzero(out)[near[out].argmin()])
    return order, parent, edge


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to smaller ids."""
    some = np.arange(len(ids))
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


class Scores:
    """Scores of a tree's anchors against some candidates, as far as known."""

    def __init__(self, anchors: np.ndarray, parent: np.ndarray, edge: np.ndarray, cands: np.ndarray) -> None:
        dims = min(anchors.shape[1], cands.shape[1])
        self.norm = np.sqrt((cands ** 2).sum(axis=1))
        self.anchors, self.cands = anchors[:, :dims], cands[:, :dims]
        self.parent, self.edge = parent, edge
        most = [float(np.abs(x).max(initial=0)) for x in (anchors, cands)]
        self.bounded = max(dims, 1) * most[0] * most[1] < EXACT and float(self.norm.max(initial=0)) * max(
            float(edge.max(initial=0)), 1.0) < EXACT
        if not self.bounded:      # Python's integers, and no bounds
            self.anchors, self.cands = ([[int(v) for v in r] for r in x] for x in (self.anchors, self.cands))
        kind = np.float64 if self.bounded else object
        self.low = np.zeros((len(parent), len(cands)), dtype=kind)
        self.high = np.zeros_like(self.low)
        self.rescored = 0

    def exact(self, i: int, some: np.ndarray) -> np.ndarray:
        self.rescored += len(some)
        if self.bounded:
            score = self.cands[some] @ self.anchors[i]
        else:
            score = np.array([sum(x * y for x, y in zip(self.anchors[i], self.cands[c])) for c in some], dtype=object)
        self.low[i, some] = self.high[i, some] = score
        return score

    def bound(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of anchor i's scores; its parent comes first."""
        p = self.parent[i]
        if p < 0 or not self.bounded:
            self.exact(i, np.arange(len(self.norm)))
        else:
            wide = self.edge[i] * (1 + 1e-9) * self.norm + 1
            wide[self.norm * self.edge[i] == 0] = 0      # a copy of its parent
            self.low[i], self.high[i] = self.low[p] - wide, self.high[p] + wide
        return self.low[i], self.high[i]


def _held(score) -> int:
    return max(-LARGEST - 1, min(LARGEST, int(score)))


def _pass(cands: DataFrame, anchors: DataFrame, blocks: int, scale: int, schema: str,
          search: Callable) -> DataFrame:
    """``search`` for each group of anchors and each chunk of candidates.

    A partition has the rows of its blocks in order: first a block's
    candidates (group -1), then every group of anchors."""
    fields = ["b", "g", "place", "aid", "id", "label", "x", "parent", "edge", "found"]
    found = anchors.schema["found"].dataType if "found" in anchors.columns else "int"
    each = anchors.withColumn("b", F.explode(F.expr(f"sequence(0, {blocks - 1})")))
    each = each if "found" in anchors.columns else each.withColumn("found", F.lit(None).cast("int"))
    none = {"g": F.lit(-1), "place": F.lit(0), "aid": F.lit(-1).cast("long"), "parent": F.lit(-1),
            "edge": F.lit(0.0), "found": F.lit(None).cast(found)}
    rows = cands.withColumns(none).select(*fields).unionAll(each.select(*fields))
    rows = rows.repartition(blocks, "b").sortWithinPartitions("b", "g", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for (b, g), table in grouped(batches):
            if g < 0:
                block = (b, np.asarray(table["id"]), np.array(table["label"].to_pylist()), matrix(table["x"], scale))
                continue
            if block is None or block[0] != b:      # a block without candidates
                continue
            _, ids, labels, vectors = block
            for at in range(0, len(ids), CHUNK):
                some = slice(at, at + CHUNK)
                scores = Scores(matrix(table["x"], scale), np.asarray(table["parent"]), np.asarray(table["edge"]),
                                vectors[some])
                out = search(table, scores, ids[some], labels[some])
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([(f.split()[0], {"bigint": pa.int64(), "int": pa.int32()}[f.split()[1]])
                       for f in schema.split(", ")])
    return rows.mapInArrow(run, schema)


def _best_positives(k: int) -> Callable:
    def search(table: pa.Table, scores: Scores, ids: np.ndarray, labels: np.ndarray) -> list[dict]:
        out = []
        for i, (aid, own, label) in enumerate(zip(*(table[c].to_pylist() for c in ("aid", "id", "label")))):
            low, high = scores.bound(i)
            same = np.flatnonzero((labels == label) & (ids != own))
            if scores.bounded and scores.parent[i] >= 0:
                if len(same) > k:
                    scores.exact(i, same[np.argpartition(high[same], len(same) - k)[len(same) - k:]])
                    least = np.partition(low[same], len(same) - k)[len(same) - k]
                    same = same[high[same] >= least]
                scores.exact(i, same[low[same] < high[same]])
            found = same[top(low[same], ids[same], k)] if len(same) else same
            out += [{"aid": aid, "id": int(ids[c]), "score": _held(low[c])} for c in found]
        return out
    return search


def _window_negatives(k: int, low_pct: int, high_pct: int) -> Callable:
    def search(table: pa.Table, scores: Scores, ids: np.ndarray, labels: np.ndarray) -> list[dict]:
        out = []
        for i, (aid, own, label, found) in enumerate(zip(*(
                table[c].to_pylist() for c in ("aid", "id", "label", "found")))):
            low, high = scores.bound(i)
            windows = [(p["rank"], -(-low_pct * p["score"] // 100), high_pct * p["score"] // 100) for p in found or ()]
            windows = [w for w in windows if w[1] <= w[2]]
            overlap = np.zeros(len(ids), dtype=bool)
            for _, least, most in windows:
                overlap |= (high >= least) & (low <= most)
            some = np.flatnonzero(overlap & (labels != label) & (ids != own))
            score = low[some]
            open_ = np.flatnonzero(score < high[some])
            if len(open_):
                score = score.copy()
                score[open_] = scores.exact(i, some[open_])
            for rank, least, most in windows:
                inside = np.flatnonzero((score >= least) & (score <= most))
                for c in inside[top(score[inside], ids[some[inside]], k)] if len(inside) else ():
                    out.append({"aid": aid, "rank": rank, "id": int(ids[some[c]]), "score": _held(score[c])})
        return out
    return search


def _trees(anchors: DataFrame, scale: int, tree: int) -> DataFrame:
    """g, place, parent, edge, aid, id, label, x of the anchors' trees."""
    signs = [F.coalesce(F.get("x", F.lit(i)) > 0, F.lit(False)).cast("int") * (1 << i) for i in range(SIGNS)]
    rows = numbered(anchors.withColumn("sign", sum(signs[1:], signs[0])), ["sign", "id"], "aid")
    rows = rows.withColumn("g", F.expr(f"aid div {tree}").cast("int"))

    def run(table: pa.Table) -> pa.Table:
        order, parent, edge = spanning_tree(matrix(table["x"], scale))
        own = table.select(["g", "aid", "id", "label", "x"]).take(pa.array(order))
        for name, column in (("place", np.arange(len(order))), ("parent", parent)):
            own = own.append_column(name, pa.array(column.astype(np.int32)))
        return own.append_column("edge", pa.array(edge))

    return rows.select("g", "aid", "id", "label", "x").groupBy("g").applyInArrow(
        run, "g int, aid bigint, id bigint, label string, x array<double>, place int, parent int, edge double")


def mine(vectors: DataFrame, anchors: DataFrame, id_col: str, vector: str, label: str, positives: int = 5,
         negatives: int = 3, low_pct: int = 50, high_pct: int = 95, scale: int = 256, tree: int = TREE,
         block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and
    negative_score for the rows of ``anchors``."""
    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vector).cast("array<double>")
        fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < F.lit(math.inf)))
        good = F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0)
        return df.where(good & F.col(id_col).isNotNull() & F.col(label).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), x.alias("x"))

    spark = vectors.sparkSession
    cands = saved(whole(vectors), "candidates")
    n = cands.count()
    blocks = max(1, math.ceil(n / block), min(math.ceil(n / 1024), shuffle_partitions(spark)))
    cands = cands.withColumn("b", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    asked = saved(_trees(whole(anchors), scale, tree), "trees")

    found = _pass(cands, asked, blocks, scale, "aid bigint, id bigint, score bigint", _best_positives(positives))
    order = Window.partitionBy("aid").orderBy(F.desc("score"), "id")
    found = saved(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives),
                  "positives")
    listed = found.groupBy("aid").agg(F.collect_list(F.struct("rank", "score")).alias("found"))  # a few each

    got = _pass(cands, asked.join(listed, "aid", "left"), blocks, scale,
                "aid bigint, rank int, id bigint, score bigint", _window_negatives(negatives, low_pct, high_pct))
    order = Window.partitionBy("aid", "rank").orderBy(F.desc("score"), "id")
    got = got.withColumn("place", F.row_number().over(order)).where(F.col("place") <= negatives)
    own = found.join(asked.select("aid", F.col("id").alias("anchor_id")), "aid").select(
        "aid", "rank", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return got.join(own, ["aid", "rank"]).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def query(embeddings: DataFrame) -> DataFrame:
    """Labels of every seventh id are moved on by one first."""
    rows = embeddings.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return mine(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", "label")


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_dot_product(a.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 3
"""

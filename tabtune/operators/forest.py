"""Random forests whose trees are grown and kept on the executors.

Spark ML grows a forest in the driver: every node of every tree stands there, with the
class counts of itself and its children.  Without a limit of depth a forest has about as
many nodes as it has rows x trees.  Here the driver sees thresholds only:

* values become bins, at most ``MAX_BINS`` a feature, with thresholds chosen from a hashed
  sample of rows as Spark ML chooses them;
* a task gets the whole binned table (a byte a value) and grows its share of the trees,
  level by level in numpy: Poisson bootstrap, a random subset of features at each node,
  the best split by impurity, leaves of one prediction under a node joined, all as in Spark ML;
* a tree is a row: arrays of features, bins and children.

The random numbers are numpy's, keyed by seed and tree, so the trees are not those that
Spark ML draws; without bootstrap and feature subsets they are the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtune.functions.columns import q
from tabtune.operators.split import hash_unit

#: Bins of a feature, rows its thresholds are chosen from, and rows of a block of the table.
MAX_BINS, SAMPLE_ROWS, BLOCK = 32, 10_000, 1 << 14
#: An impurity or gain of this share of the root's impurity is none.
NOTHING = 1e-12
TREES = "tree int, feature binary, cut binary, left binary, pure binary, mixed binary"


def thresholds(values: np.ndarray, max_bins: int = MAX_BINS) -> np.ndarray:
    """Where a feature is cut: between all its values, or near equal shares of them."""
    values, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(values) <= max_bins:
        return (values[:-1] + values[1:]) / 2.0
    stride, out = counts.sum() / max_bins, []
    target, at = stride, np.cumsum(counts)
    for i in range(1, len(values)):
        if abs(at[i - 1] - target) < abs(at[i] - target):
            out.append((values[i - 1] + values[i]) / 2.0)
            target += stride
    return np.array(out)


def feature_thresholds(df: DataFrame, features, n_rows: int, seed: int) -> list[np.ndarray]:
    """``thresholds`` of each feature over a hashed sample of rows (all of few)."""
    some = df if n_rows <= SAMPLE_ROWS else df.where(hash_unit(df, None, seed + 1) < F.lit(SAMPLE_ROWS / n_rows))
    some = some.select(*[F.col(q(f)).cast("double") for f in features]).toArrow()      # SAMPLE_ROWS rows or so
    return [thresholds(np.array(some.column(i).to_numpy(), dtype=np.float64)) for i in range(len(features))]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of rows of values; a missing one is in the last bin."""
    out = np.empty(x.shape, dtype=np.uint8)
    for f, cut in enumerate(cuts):
        out[:, f] = np.searchsorted(cut, x[:, f])
    return out


def _impurity(stats: np.ndarray, kind: str):
    """Rows and impurity of each row of sums: counts of classes, or weight, sum and sum of squares."""
    if kind == "variance":
        n = stats[:, 0]
        safe = np.maximum(n, 1.0)
        return n, np.maximum(stats[:, 2] / safe - (stats[:, 1] / safe) ** 2, 0.0)
    n = stats.sum(1)
    share = stats / np.maximum(n, 1.0)[:, None]
    if kind == "gini":
        return n, np.where(n > 0, 1.0 - (share * share).sum(1), 0.0)
    return n, -(share * np.log2(np.where(share > 0, share, 1.0))).sum(1)


def _best_splits(x, rows, node, stats, sums, kind, min_leaf, choice):
    """The split of each node with the highest gain over its chosen features: gain,
    feature and last bin on the left; a gain of 0 where there is none."""
    count, own = _impurity(sums, kind)
    n_nodes = len(sums)
    gain, feature, cut = np.zeros(n_nodes), np.full(n_nodes, -1, np.int16), np.zeros(n_nodes, np.uint8)
    place = np.arange(len(rows), dtype=np.int64)
    for j in range(choice.shape[1]):
        key = (node.astype(np.int64) << 8) | x[rows, choice[node, j]]
        packed = np.sort((key << 32) | place)
        order, key = packed & 0xFFFFFFFF, packed >> 32
        ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
        upto = np.cumsum(stats[order], axis=0)[ends]
        of = key[ends] >> 8
        first = np.searchsorted(of, np.arange(n_nodes))
        before = np.where((first > 0)[:, None], upto[first - 1], 0.0)
        left = upto - before[of]
        n_left, i_left = _impurity(left, kind)
        right = sums[of] - left
        n_right, i_right = _impurity(right, kind)
        got = own[of] - (n_left * i_left + n_right * i_right) / count[of]
        got[(n_left < min_leaf) | (n_right < min_leaf)] = -1.0
        top = np.maximum.reduceat(got, first)
        at = np.flatnonzero(got == top[of])[::-1]
        where = np.zeros(n_nodes, dtype=np.int64)
        where[of[at]] = at                               # the first of equal ones
        better = top > gain
        gain[better], feature[better] = top[better], choice[better, j]
        cut[better] = key[ends[where[better]]] & 0xFF
    return gain, feature, cut


@dataclass
class Tree:
    """Nodes in the order of their levels; ``feature`` is -1 at a leaf, else bins up to
    ``cut`` go to the child ``left``, others to the one after it.  ``stats``: sums of each node."""
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    stats: np.ndarray


def _predictions(stats: np.ndarray, kind: str) -> np.ndarray:
    return stats[:, 1] / stats[:, 0] if kind == "variance" else stats.argmax(1)


def _joined(levels: list, kind: str) -> Tree:
    """The tree of its levels (feature, cut, stats), sibling leaves of one prediction joined."""
    splits = [np.flatnonzero(f >= 0) for f, _, _ in levels]
    for d in range(len(levels) - 2, -1, -1):
        f, child = levels[d][0], levels[d + 1]
        value, leaf = _predictions(child[2], kind), child[0] < 0
        same = leaf[0::2] & leaf[1::2] & (value[0::2] == value[1::2])
        f[splits[d][same]] = -1
    alive, out, base = np.array([0]), [], 0
    for d, (f, cut, stats) in enumerate(levels):
        split = f[alive] >= 0
        left = np.zeros(len(alive), np.int32)
        left[split] = base + len(alive) + 2 * np.arange(split.sum())
        out.append((f[alive], cut[alive], left, stats[alive]))
        base += len(alive)
        pair = np.searchsorted(splits[d], alive[split])        # its children are 2 x pair and the next
        alive = np.stack([2 * pair, 2 * pair + 1], 1).ravel()
    return Tree(*(np.concatenate(some) for some in zip(*out)))


def grow(x: np.ndarray, stats: np.ndarray, kind: str, max_depth: int, min_leaf: int, n_chosen: int, rng) -> Tree:
    """One tree over binned rows.  ``stats``: of each row what is summed (see ``_impurity``),
    0 of a row that the tree does not see."""
    width = x.shape[1]
    rows = np.flatnonzero(stats[:, 0] if kind == "variance" else stats.any(1))
    stats, node, sums, levels = stats[rows], np.zeros(len(rows), np.int32), stats.sum(0)[None], []
    least = NOTHING * _impurity(sums, kind)[1][0]
    for depth in range(max_depth + 1):
        feature, cut = np.full(len(sums), -1, np.int16), np.zeros(len(sums), np.uint8)
        levels.append((feature, cut, sums))
        going = np.flatnonzero(_impurity(sums, kind)[1] > least) if depth < max_depth else []
        if not len(going):
            break
        number = np.full(len(sums), -1, np.int32)
        number[going] = np.arange(len(going))
        keep = number[node] >= 0
        rows, stats, node = rows[keep], stats[keep], number[node[keep]]
        if n_chosen < width:
            choice = np.argpartition(rng.random((len(going), width), dtype=np.float32), n_chosen - 1, axis=1)[:, :n_chosen]
        else:
            choice = np.broadcast_to(np.arange(width), (len(going), width))
        gain, f, c = _best_splits(x, rows, node, stats, sums[going], kind, min_leaf, choice)
        split = gain > least
        if not split.any():
            break
        feature[going[split]], cut[going[split]] = f[split], c[split]
        number = np.full(len(going), -1, np.int32)
        number[split] = 2 * np.arange(split.sum())
        keep = number[node] >= 0
        rows, stats, node = rows[keep], stats[keep], node[keep]
        node = number[node] + (x[rows, f[node]] > c[node])
        n = 2 * int(split.sum())
        sums = np.stack([np.bincount(node, stats[:, i], n) for i in range(stats.shape[1])], 1)
    return _joined(levels, kind)


def walk(tree: Tree, x: np.ndarray, rows=None, other=None, value=None, used=None) -> np.ndarray:
    """The leaf of each row of bins.  ``rows``: the rows to walk, as often as they stand
    there, each with ``value`` in place of its bin of feature ``other``; ``used``
    (rows x features) marks the features met on the way."""
    rows = np.arange(len(x)) if rows is None else rows
    at, going = np.zeros(len(rows), np.int32), np.arange(len(rows))
    while len(going):
        here = at[going]
        f = tree.feature[here]
        inner = f >= 0
        if not inner.all():
            going, here, f = going[inner], here[inner], f[inner]
        row = rows[going]
        if used is not None:
            used[row, f] = True
        bins = x[row, f]
        if other is not None:
            bins = np.where(f == other[going], value[going], bins)
        at[going] = tree.left[here] + (bins > tree.cut[here])
    return at


def _packed(number: int, tree: Tree) -> tuple:
    """A classification tree as a row of ``TREES``: a class of each leaf of one class,
    shares of the classes of the others."""
    pure = np.where((tree.stats > 0).sum(1) == 1, tree.stats.argmax(1), -1).astype(np.int32)
    mixed = tree.stats[(tree.feature < 0) & (pure < 0)]
    mixed = mixed / np.maximum(mixed.sum(1, keepdims=True), 1e-300)
    return (number, *(a.tobytes() for a in (tree.feature, tree.cut, tree.left, pure, mixed)))


def unpacked(row: dict, n_classes: int) -> tuple[Tree, np.ndarray, np.ndarray]:
    """A tree, of each node the row in the shares of classes, and these shares."""
    tree = Tree(np.frombuffer(row["feature"], np.int16), np.frombuffer(row["cut"], np.uint8),
                np.frombuffer(row["left"], np.int32), None)
    pure, mixed = np.frombuffer(row["pure"], np.int32), np.frombuffer(row["mixed"]).reshape(-1, n_classes)
    other = (tree.feature < 0) & (pure < 0)
    at = np.where(other, n_classes + np.cumsum(other) - 1, pure)
    return tree, at, np.concatenate([np.eye(n_classes), mixed])


def subset_size(n_features: int) -> int:
    """Features of a node of a classification forest: 'sqrt'."""
    return max(1, math.ceil(math.sqrt(n_features)))


def classifier_trees(train: DataFrame, features, label: str, n_rows: int, n_trees: int, n_classes: int, max_depth: int,
                     seed: int) -> tuple[DataFrame, list[np.ndarray]]:
    """The trees (rows of ``TREES``, cached; the caller releases them) of a classification
    forest over ``train`` as it is laid out (see ``models.spread``), and the thresholds."""
    features, width = list(features), len(features)
    cuts = feature_thresholds(train, features, n_rows, seed)
    spark = train.sparkSession
    n_tasks = max(1, min(n_trees, spark.sparkContext.defaultParallelism))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                some = batch.slice(at, BLOCK)
                values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in some.columns[:-1]], 1)
                y = some.column(width).to_numpy(zero_copy_only=False).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                     pa.array([binned(values, cuts).tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())],
                    names=["part", "number", "x", "y"])
                number += 1

    def own_trees(task: int, xs: list, ys: list) -> Iterator[pa.RecordBatch]:
        x = np.frombuffer(b"".join(xs), np.uint8).reshape(-1, width)
        y = np.frombuffer(b"".join(ys), np.int32)
        for t in range(task, n_trees, n_tasks):
            rng = np.random.default_rng([seed, t])
            stats = np.zeros((len(y), n_classes))
            stats[np.arange(len(y)), y] = rng.poisson(1.0, len(y))
            tree = grow(x, stats, "gini", max_depth, 1, subset_size(width), rng)
            yield pa.RecordBatch.from_pylist([dict(zip(
                ("tree", "feature", "cut", "left", "pure", "mixed"), _packed(t, tree)))], schema=pa.schema(
                [("tree", pa.int32()), *((c, pa.binary()) for c in ("feature", "cut", "left", "pure", "mixed"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, xs, ys = None, [], []
        for batch in batches:
            for task, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                if own is not None and task != own:
                    yield from own_trees(own, xs, ys)
                    xs, ys = [], []
                own = task
                xs.append(x)
                ys.append(y)
        if own is not None:
            yield from own_trees(own, xs, ys)

    cols = [F.col(q(f)).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
    table = train.select(*cols, F.col(q(label)).cast("double").alias("y")).mapInArrow(
        blocks, "part int, number int, x binary, y binary").persist(StorageLevel.MEMORY_AND_DISK)
    dealt = table.select(F.explode(F.sequence(F.lit(0), F.lit(n_tasks - 1))).alias("task"), "*")
    trees = (dealt.repartitionByRange(n_tasks, "task").sortWithinPartitions("task", "part", "number")
             .mapInArrow(run, TREES).persist(StorageLevel.MEMORY_AND_DISK))
    trees.count()
    table.unpersist()
    return trees, cuts

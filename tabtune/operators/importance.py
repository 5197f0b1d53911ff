"""Feature importance.

* Tree models: impurity importance from the fitted forest (I1).
* Linear models: absolute coefficients (I2).
* Clustering: permutation importance of a surrogate random forest that
  predicts the cluster label (I3).  The test rows are put in a hashed order and
  numbered once; consecutive numbers form blocks of ``BLOCK_ROWS`` rows, the
  same rule for every table.  Each feature column is permuted ``n_repeats``
  times inside the blocks, by permutations keyed with seed, feature, repeat and
  block.  The copies are made and scored where the block is, so the shuffles
  carry each test row twice whatever the number of features and repeats is.
  Where there are fewer blocks than cores, a block goes to several tasks, each
  of which makes the copies of a share of the features.  A surrogate of many rows
  is grown and kept on the executors (see ``forest``); its trees are sent to the blocks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtune.functions.columns import q
from tabtune.operators import forest as FR
from tabtune.operators import models as M
from tabtune.operators.ranks import small_result
from tabtune.operators.split import key_text, train_test_split


def tree_importance(model: PipelineModel, features) -> DataFrame:
    """(Feature, Importance)."""
    from pyspark.sql import SparkSession
    imp = model.stages[-1].featureImportances.toArray()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)],
                                 "Feature string, Importance double")


def linear_importance(model: PipelineModel, features) -> DataFrame:
    """(Feature, Importance = |coefficient|) of a linear model."""
    from pyspark.sql import SparkSession
    coef = model.stages[-1].coefficients.toArray()
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame([(f, float(abs(v))) for f, v in zip(features, coef)],
                                 "Feature string, Importance double")



#: Rows of a block inside which a feature is permuted.
BLOCK_ROWS = 4096


def permutation(seed: int, feature: int, repeat: int, block: int, size: int) -> np.ndarray:
    """For each place of a block the place whose value it gets."""
    return np.random.default_rng([seed, feature, repeat, block]).permutation(size)


def numbered_blocks(test: DataFrame, order: list, block_rows: int) -> tuple[DataFrame, int]:
    """``test`` with its number ``_i`` (from 0) in the given order and its block
    ``_blk``, and the number of blocks; each block stands whole and in order in one
    partition.

    Range partitions are sorted one by one, a count of each makes the places
    inside them global; no more than one row a partition is collected."""
    rows = (test.repartitionByRange(*order).sortWithinPartitions(*order)
            .withColumn("_part", F.spark_partition_id())
            .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
            .persist(StorageLevel.MEMORY_AND_DISK))
    sizes = sorted(map(tuple, rows.groupBy("_part").count().collect()))
    starts = list(itertools.accumulate([0] + [n for _, n in sizes]))
    total = max(1, starts[-1])
    blocks = max(1, math.ceil(total / block_rows))
    offsets = test.sparkSession.createDataFrame(
        [(p, s) for (p, _), s in zip(sizes, starts)], "_part int, _start long")
    out = (rows.join(F.broadcast(offsets), "_part")          # one row a partition
           .withColumn("_i", F.col("_start") + F.col("_pos"))
           .withColumn("_blk", F.expr(f"_i * {blocks} div {total}").cast("int")).drop("_part", "_pos", "_start"))
    out = out.repartition(min(blocks, MOST_PARTITIONS), "_blk").sortWithinPartitions("_blk", "_i").persist(
        StorageLevel.MEMORY_AND_DISK)
    out.count()
    rows.unpersist()
    return out, blocks


#: Blocks share partitions beyond this number.
MOST_PARTITIONS = 1 << 15


def shares(blocks: int, width: int, slots: int) -> int:
    """Tasks that make the copies of one block, each those of a share of the features:
    as many as keep ``slots`` busy, one where the blocks do so themselves."""
    return max(1, min(width, math.ceil(slots / max(1, blocks))))


def _copies(width: int, n_repeats: int, seed: int, n_shares: int = 1):
    """The permuted copies of each block and share of the features: feature, repeat,
    label, vector.  The first column is block x shares + share."""
    def block_copies(at: int, some: list) -> Iterator[pa.RecordBatch]:
        blk, share = divmod(at, n_shares)
        table = pa.Table.from_batches(some)
        x = np.array(table["_x"].combine_chunks().flatten()).reshape(-1, width)
        label, n = table["_label"].combine_chunks(), len(x)
        offsets = pa.array(np.arange(0, n * width + 1, width, dtype=np.int32))
        for f in range(share, width, n_shares):
            kept = x[:, f].copy()
            for r in range(n_repeats):
                x[:, f] = kept[permutation(seed, f, r, blk, n)]
                lists = pa.ListArray.from_arrays(offsets, pa.array(x.ravel().copy()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, f, np.int32)), pa.array(np.full(n, r, np.int32)), label, lists],
                    names=["_f", "_r", "_label", "_x"])
            x[:, f] = kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some = None, []
        for batch in batches:
            blk = np.asarray(batch.column(0))
            heads = np.flatnonzero(np.concatenate([[True], np.diff(blk) != 0])) if len(blk) else []
            for at, to in zip(heads, [*heads[1:], len(blk)]):
                if some and blk[at] != own:
                    yield from block_copies(own, some)
                    some = []
                own = int(blk[at])
                some.append(batch.slice(at, to - at))
        if some:
            yield from block_copies(own, some)
    return run


#: A surrogate of more rows x trees is not grown in the driver, where Spark ML keeps all its nodes.
DRIVER_NODES = 1 << 20
#: Trees of a surrogate, and most bytes of the votes that one task counts.
SURROGATE_TREES, MOST_VOTES = 100, 1 << 27


def _hits(cuts: list, n_classes: int, n_repeats: int, seed: int, n_shares: int):
    """Counts the hits of a forest on a block and its permuted copies.  Of each ``_at`` (as
    in ``_copies``) come the rows of the block, with a tree of -1, and then all trees;
    feature -1 is the block itself."""
    width = len(cuts)

    def begin(at: int, some: list):
        blk, share = divmod(at, n_shares)
        table = pa.concat_tables(some)
        x = FR.binned(np.array(table["_x"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, width), cuts)
        label = table["_label"].combine_chunks()
        own = range(share, width, n_shares)
        moved = np.stack([[x[permutation(seed, f, r, blk, len(x)), f] for r in range(n_repeats)] for f in own])
        y = label.to_numpy(zero_copy_only=False)
        return {"own": own, "x": x, "y": y[~np.isnan(y)], "known": ~np.isnan(y), "moved": moved, "share": share,
                "votes": np.zeros((len(x), n_classes)),
                "change": np.zeros((len(own) * n_repeats * len(x), n_classes), dtype=np.float32)}

    def add(block: dict, row: dict) -> None:
        tree, at, shares_of = FR.unpacked(row, n_classes)
        x, n = block["x"], len(block["x"])
        used = np.zeros((n, width), dtype=bool)
        plain = at[FR.walk(tree, x, used=used)]
        block["votes"] += shares_of[plain]
        place, rows = np.nonzero(used[:, list(block["own"])].T)     # only these may end in another leaf
        other = np.asarray(block["own"], dtype=np.int16)[place]
        for r in range(n_repeats):
            value = block["moved"][place, r, rows]
            differs = np.flatnonzero(value != x[rows, other])
            to = rows[differs]
            leaf = at[FR.walk(tree, x, to, other[differs], value[differs])]
            differs, to, leaf = (a[leaf != plain[to]] for a in (differs, to, leaf))
            block["change"][(place[differs] * n_repeats + r) * n + to] += shares_of[leaf] - shares_of[plain[to]]

    def end(block: dict) -> pa.RecordBatch:
        known, y, got = block["known"], block["y"], []
        if block["share"] == 0:
            got.append((-1, 0, int((block["votes"].argmax(1)[known] == y).sum()), len(y)))
        change = block["change"].reshape(len(block["own"]), n_repeats, len(known), n_classes)
        for i, f in enumerate(block["own"]):
            for r in range(n_repeats):
                hit = (block["votes"] + change[i, r]).argmax(1)[known] == y
                got.append((f, r, int(hit.sum()), len(y)))
        return pa.RecordBatch.from_pylist([dict(zip(("_f", "_r", "hits", "n"), g)) for g in got], schema=pa.schema(
            [("_f", pa.int32()), ("_r", pa.int32()), ("hits", pa.int64()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, some, block = None, [], None
        for batch in batches:
            ats, trees = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for at in np.unique(ats):
                if some and at != own:
                    yield end(block or begin(own, some))
                    some, block = [], None
                own = int(at)
                here = batch.filter(pa.array((ats == at) & (trees < 0)))
                if len(here):
                    some.append(pa.Table.from_batches([here]))
                for row in np.flatnonzero((ats == at) & (trees >= 0)) if some else ():
                    block = block or begin(own, some)
                    add(block, {c: batch[c][int(row)].as_py() for c in ("feature", "cut", "left", "pure", "mixed")})
        if some:
            yield end(block or begin(own, some))
    return run


def _grown_hits(train: DataFrame, test: DataFrame, blocks: int, features, label: str, n_rows: int, n_repeats: int,
                seed: int) -> DataFrame:
    """Hits and rows of each feature and repeat (feature -1: nothing permuted) of a surrogate
    whose trees never come to the driver."""
    laid = M.spread(train, None, n_rows, [*features, label])
    y = F.col(q(label)).cast("double")
    low, high, odd = laid.agg(F.min(y), F.max(y), F.count_if(y.isNull() | F.isnan(y) | (y != F.floor(y)))).first()
    if odd or low < 0:
        raise ValueError(f"the labels of {label!r} are not the numbers of classes 0, 1, ...")
    n_classes, width = int(high) + 1, len(features)
    trees, cuts = FR.classifier_trees(laid, features, label, n_rows, SURROGATE_TREES, n_classes, M.MAX_DEPTH, M.SEED)
    laid.unpersist()
    slots = test.sparkSession.sparkContext.defaultParallelism
    votes = width * n_repeats * BLOCK_ROWS * n_classes * 4
    n_shares = min(width, max(shares(blocks, width, slots), math.ceil(votes / MOST_VOTES)))
    at = F.col("_blk").cast("long") * n_shares
    rows = test.select(F.explode(F.sequence(at, at + (n_shares - 1))).alias("_at"), F.lit(-1).alias("tree"), "_i", "_label",
                       "_x", *[F.lit(None).cast("binary").alias(c) for c in trees.columns[1:]])
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks * n_shares - 1).cast("long")))
    sent = trees.select(every.alias("_at"), "tree", F.lit(0).cast("long").alias("_i"), F.lit(0.0).alias("_label"),
                        F.lit(None).cast("array<double>").alias("_x"), *trees.columns[1:])
    dealt = rows.unionByName(sent).repartitionByRange(min(blocks * n_shares, MOST_PARTITIONS), "_at")
    hits = dealt.sortWithinPartitions("_at", "tree", "_i").mapInArrow(
        _hits(cuts, n_classes, n_repeats, seed, n_shares), "_f int, _r int, hits long, n long")
    return small_result(hits.groupBy("_f", "_r").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")), trees)


def permutation_importance(df: DataFrame, features, label: str = "Cluster", key=None,
                           n_repeats: int = 5, seed: int = 42, test_fraction: float = 0.2,
                           model: PipelineModel | None = None) -> DataFrame:
    """(Feature, Importance Mean, Importance Std) by accuracy drop.

    ``model`` (an assembler and a classifier) defaults to a surrogate random
    forest (100 trees, seed 42) fitted on the train rows of a hash split of
    ``df``, by Spark ML up to ``DRIVER_NODES`` rows x trees and by ``forest``
    beyond.  A feature is shuffled inside blocks of ``BLOCK_ROWS`` test rows of
    a hashed order: random blocks, so the permuted column is independent of the
    row as in one permutation of all rows, and a table of fewer rows is one block.
    """
    features = list(features)
    split = train_test_split(df, key, test_fraction, seed)
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test").drop("split")
    n_train = train.count() if model is None else 0
    grown = n_train * SURROGATE_TREES > DRIVER_NODES
    if model is None and not grown:
        model = M.fit_forest_classifier(train, features, label,
                                        {"n_estimators": SURROGATE_TREES, "max_features": "sqrt"}, n_rows=n_train)
    x = F.array(*[F.col(q(f)).cast("double") for f in features])
    kt = key_text(test, key)
    test = test.select(F.xxhash64(kt, F.lit(seed)).alias("_h"), kt.alias("_key"),
                       F.col(q(label)).cast("double").alias("_label"), x.alias("_x"))
    test, blocks = numbered_blocks(test, ["_h", "_key", "_x", "_label"], BLOCK_ROWS)
    if grown:
        hits = _grown_hits(train, test, blocks, features, label, n_train, n_repeats, seed)
        b = (hits.where("_f < 0").select(F.try_divide("hits", "n")).first() or [None])[0]
        acc = hits.where("_f >= 0").select("_f", "_r", F.try_divide("hits", "n").alias("acc"))
    else:
        b, acc = _model_hits(model, test, blocks, len(features), n_repeats, seed)
    drop = acc.withColumn("d", F.lit(b) - F.col("acc"))
    names = F.array(*[F.lit(f) for f in features])
    result = (drop.groupBy(F.get(names, F.col("_f")).alias("Feature"))
              .agg(F.avg("d").alias("Importance Mean"), F.stddev_pop("d").alias("Importance Std")))
    return small_result(result, test)  # one row per feature


def _model_hits(model: PipelineModel, test: DataFrame, blocks: int, width: int, n_repeats: int, seed: int):
    """The accuracy of ``model`` on the test rows, and that of each feature and repeat."""
    slots = test.sparkSession.sparkContext.defaultParallelism
    n_shares = shares(blocks, width, slots)
    dealt = test.select((F.col("_blk").cast("long") * n_shares).alias("_at"), "_i", "_label", "_x")
    if n_shares > 1:     # few blocks: several tasks get the same one, for other features
        dealt = dealt.withColumn("_at", F.explode(F.sequence(F.col("_at"), F.col("_at") + (n_shares - 1))))
        dealt = dealt.repartitionByRange(blocks * n_shares, "_at").sortWithinPartitions("_at", "_i")
    copies = dealt.select("_at", "_label", "_x").mapInArrow(
        _copies(width, n_repeats, seed, n_shares), "_f int, _r int, _label double, _x array<double>")

    def hits(rows: DataFrame) -> DataFrame:
        vectors = rows.withColumn("features", array_to_vector("_x"))
        last = model.stages[-1]
        out = last.transform(vectors)
        return out.withColumn("_hit", (F.col(last.getOrDefault("predictionCol")) == F.col("_label")).cast("double"))

    b = hits(test).agg(F.avg("_hit")).first()[0]  # one number
    return b, hits(copies).groupBy("_f", "_r").agg(F.avg("_hit").alias("acc"))


def rank_importance(df: DataFrame, column: str | None = None) -> DataFrame:
    """I4: sort descending (ties by feature name)."""
    col = column or ("Importance" if "Importance" in df.columns else "Importance Mean")
    return df.orderBy(F.col(q(col)).desc(), F.col("Feature"))


def importance_report(models: dict, features, task: str, data: DataFrame | None = None,
                      key=None) -> DataFrame:
    """Importance for the best model of every strategy, with a
    ``strategy`` column; clustering uses permutation importance on the
    cluster labels of ``data``."""
    parts = []
    for name, model in models.items():
        if task == "clustering":
            labelled = M.attach_clusters(data, model).persist(StorageLevel.MEMORY_AND_DISK)
            imp = permutation_importance(labelled, features, "Cluster", key)
            labelled.unpersist()
        else:
            imp = tree_importance(model, features)
        parts.append(imp.withColumn("strategy", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Quality classifier with supervised subword embeddings.

A text is the average of learned vectors of its hashed words and of the 3- and
4-grams of its characters inside words (white space stands at either end as a
border; a character is a code point);
a softmax layer over the average gives the label.  Vectors and layer are
trained together by plain stochastic gradient descent in numpy.

The fit uses at most ``per_label`` labelled texts of each label, chosen by
hash, and all features of each; they lie in a table in the shared folder, from
which the driver reads some texts at a time, in another order for each epoch.
Class weights restore the labels' true
shares.  Scoring uses all features of every whole text: the two outputs
differ by the average of one number for each hash bucket, and only these
numbers travel to the executors.

Defined results: a null or wordless text scores by the bias alone; without
any labelled text all scores are 0.5; a null id is not held out; labels other
than 0 and 1, and ids with both, are not used; of several texts of an id the
smallest is learned from; rows that share an id are scored one by one; an empty table gives none; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabtune.llm import words as W
from tabtune.llm.frames import saved

BITS = 17
GRAMS = (3, 4)
#: Training texts that come to the driver together (1 MB each at most).
TOGETHER = 50
#: Odd multipliers, one for each place of a gram.
_PLACES = [np.uint64((2 * i + 1) * int(W._GOLD) % (1 << 64) | 1) for i in range(max(GRAMS))]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _whole(data: np.ndarray, at: int) -> int:
    """The first place from ``at`` on where a character begins or the data ends."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def gram_hashes(chars: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n characters (code points as 64-bit numbers)."""
    m = len(chars) - n + 1
    own = W.mix((chars + np.uint64(1)) * W._GOLD)
    value = np.full(m, n, dtype=np.uint64)
    for j in range(n):
        value += own[j:j + m] * _PLACES[j]
    return W.mix(value)


def features(part: W.Part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all features of some texts, in pieces: the words, then
    the grams of the characters block by block.  A gram lies in one text, and
    only its first and last character can be white space (all kinds alike)."""
    yield part.doc, _bucket(W.mix(part.hash + W._GOLD))
    at = 0
    while at < len(part.data):
        to = _whole(part.data, at + W.PART_BYTES)
        end = _whole(part.data, to + 4 * (max(GRAMS) - 1))      # room for grams that begin before ``to``
        data = part.data[at:end]
        starts = at + np.flatnonzero(data & 0xC0 != 0x80)
        chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        gap = (chars < 128) & W.SPACE[np.minimum(chars, 255).astype(np.int64)]
        chars = np.where(gap, np.uint64(0x20), chars)
        text = np.searchsorted(part.offs, starts, side="right") - 1 if part.rows > 1 \
            else np.zeros(len(starts), dtype=np.int64)
        mine = int(np.searchsorted(starts, to))
        for n in GRAMS:
            m = min(len(chars) - n + 1, mine)
            if m <= 0:
                continue
            good = text[:m] == text[n - 1:n - 1 + m]
            for j in range(1, n - 1):
                good &= ~gap[j:j + m]
            yield text[:m][good], _bucket(gram_hashes(chars, n)[:m][good])
        at = to


def counted(part: W.Part) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and how often they occur in it."""
    if part.rows == 1:
        total = np.zeros(1 << BITS, dtype=np.int64)
        for _, bucket in features(part):
            total += np.bincount(bucket, minlength=1 << BITS)
        found = np.flatnonzero(total)
        return [(found, total[found])]
    text, bucket = (np.concatenate(x) for x in zip(*features(part)))
    keys, times = np.unique(text << BITS | bucket, return_counts=True)
    ends = np.searchsorted(keys, np.arange(part.rows + 1) << BITS)
    return [(keys[a:b] & ((1 << BITS) - 1), times[a:b]) for a, b in zip(ends, ends[1:])]


class Texts:
    """The training texts (doc_id, y, and the bytes of buckets and counts)."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.seen = np.zeros(2, dtype=np.int64)
        for y, n in rows.groupBy("y").count().collect():
            self.seen[y] = n

    def epoch(self, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Label, buckets and counts of each text, in an order by hash; a
        partition at a time comes to the driver."""
        order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
        count = max(1, math.ceil(int(self.seen.sum()) / TOGETHER))
        rows = self.rows.repartitionByRange(count, *order).sortWithinPartitions(*order)
        for r in rows.toLocalIterator():
            yield r.y, np.frombuffer(r.f, dtype="<i4").astype(np.int64), np.frombuffer(r.m, dtype="<i4").astype(float)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_label: int,
                  seed: int) -> tuple[Texts, np.ndarray]:
    """Features of the chosen texts and the labels' counts."""
    known = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
             .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other"))
             .where("y = other").drop("other"))
    share = np.zeros(2)
    for y, n in known.groupBy("y").count().collect():
        share[y] = n
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    chosen = known.where("y = 0").orderBy(*order).limit(per_label).unionAll(
        known.where("y = 1").orderBy(*order).limit(per_label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.parts(batch.column(2)):
                out = counted(part)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.row, part.rows), batch.column(1).slice(part.row, part.rows),
                     *(pa.array([x[i].astype("<i4").tobytes() for x in out], pa.binary()) for i in (0, 1))],
                    names=["doc_id", "y", "f", "m"])

    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")   # at most 2 per_label rows
            .groupBy("doc_id", "y").agg(F.min("text").alias("text"))
            .repartition(max(1, 2 * per_label // TOGETHER), "doc_id")
            .mapInArrow(run, "doc_id bigint, y int, f binary, m binary"))
    return Texts(saved(rows, "training")), share


def train(rows: Texts, share: np.ndarray, dim: int = 8, epochs: int = 5, rate: float = 0.5,
          seed: int = 42) -> tuple[np.ndarray, float]:
    """Contribution of each bucket to the logit of label 1, and the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / dim, 1.0 / dim, (1 << BITS, dim))
    layer, bias = np.zeros((dim, 2)), np.zeros(2)
    seen, total = rows.seen, int(rows.seen.sum())
    weight = np.where(seen > 0, share / max(share.sum(), 1) * total / np.maximum(seen, 1), 0.0)
    weight = weight / max(weight.max(), 1e-12)
    steps, step = epochs * total, 0
    for epoch in range(epochs if total else 0):
        for y, found, times in rows.epoch(seed + epoch):
            n = times.sum()
            mean = times @ vectors[found] / n if n else np.zeros(dim)
            z = mean @ layer + bias
            grad = np.exp(z - z.max())
            grad /= grad.sum()
            grad[y] -= 1.0
            pace = rate * (1.0 - step / steps) * weight[y]
            step += 1
            back = layer @ grad
            layer -= pace * np.outer(mean, grad)
            bias -= pace * grad
            if n:
                # Along the gradient, but with the counts scaled to length 1
                # and not to sum 1: the rate is set for steps of that size.
                vectors[found] -= pace * times[:, None] / np.sqrt(times @ times) * back
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score for each row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for part in W.parts(batch.column(1)):
                total, n = np.zeros(part.rows), np.zeros(part.rows)
                for text, bucket in features(part):
                    total += np.bincount(text, weights=weights[bucket], minlength=part.rows)
                    n += np.bincount(text, minlength=part.rows)
                z[part.row:part.row + part.rows] = total / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(z + bias, -500, 500))))],
                names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = 1500,
             seed: int = 42) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    rows, share = training_rows(docs, labels, label, per_label, seed)
    weights, bias = train(rows, share, seed=seed)
    return score(docs, weights, bias).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)

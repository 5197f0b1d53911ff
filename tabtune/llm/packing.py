"""Packing into length buckets that minimise padding.

Texts become pieces of at most ``context`` words.  The global histogram of
piece lengths (at most ``context`` rows) goes through a dynamic program that
chooses the bucket boundaries with the least padding in all; inside a bucket,
pieces in seeded order form batches of as many rows as the token budget holds
when each is padded to the bucket's length.

Defined results: null and wordless texts have no pieces; a longer text gives
several pieces, none is cut off; repeated rows give repeated pieces, ordered
by id and position where the seeded order ties; an empty table gives none;
columns other than id and text are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtune.llm.frames import n_words, numbered, saved


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with least padding.

    With C and T the running counts and tokens over the sorted lengths, the
    bucket (i, j] costs length[j] (C[j] - C[i]) - (T[j] - T[i]).  The best
    split point does not move back as j grows, so each layer is solved by
    divide and conquer; of equal costs the smallest split point wins.
    """
    d = len(lengths)
    c = np.concatenate([[0], np.cumsum(counts)]).tolist()
    t = np.concatenate([[0], np.cumsum(counts * lengths)]).tolist()
    size = lengths.tolist()
    best = [0] + [size[j - 1] * c[j] - t[j] for j in range(1, d + 1)]
    cuts = []
    for _ in range(1, min(buckets, d)):
        new, cut = list(best), [0] * (d + 1)
        todo = [(1, d, 0, d - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            top, split = None, first
            for i in range(first, min(last, j - 1) + 1):
                cost = best[i] + size[j - 1] * (c[j] - c[i]) - (t[j] - t[i])
                if top is None or cost < top:
                    top, split = cost, i
            new[j], cut[j] = top, split
            todo += [(lo, j - 1, first, split), (j + 1, hi, split, last)]
        best = new
        cuts.append(cut)
    out, j = [size[d - 1]], d
    for cut in reversed(cuts):
        j = cut[j]
        if j == 0:
            break
        out.append(size[j - 1])
    return out[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", context: int = 2048,
         buckets: int = 8, batch_tokens: int = 16384, seed: int = 42) -> DataFrame:
    """Pieces with their bucket, batch and row: doc_id, piece, start (word
    that it starts with), n_tokens, bucket, pad_to, batch, row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text)).alias("n")).where("n > 0")
    rows = rows.withColumn("piece", F.explode(F.expr(f"sequence(0L, (n - 1) div {context})")))
    rows = rows.select("doc_id", "piece", (F.col("piece") * context).alias("start"),
                       F.least(F.lit(context).cast("long"), F.col("n") - F.col("piece") * context)
                       .alias("n_tokens"))
    rows = saved(rows, "pieces")
    histogram = rows.groupBy("n_tokens").count().orderBy("n_tokens").collect()   # at most context rows
    if not histogram:
        return rows.select("*", F.lit(0).alias("bucket"), F.lit(0).cast("long").alias("pad_to"),
                           F.lit(0).cast("long").alias("batch"), F.lit(0).alias("row"))
    lengths = np.array([r[0] for r in histogram], dtype=np.int64)
    counts = np.array([r[1] for r in histogram], dtype=np.int64)
    tops = boundaries(lengths, counts, buckets)
    bucket, pad, first, per = F.lit(0), F.lit(0), F.lit(0), F.lit(1)
    for i, top in reversed(list(enumerate(tops))):
        below = int(counts[lengths <= (tops[i - 1] if i else 0)].sum())
        near = F.col("n_tokens") <= top
        bucket = F.when(near, i).otherwise(bucket)
        pad = F.when(near, top).otherwise(pad)
        first = F.when(near, below).otherwise(first)
        per = F.when(near, max(1, batch_tokens // top)).otherwise(per)
    rows = rows.withColumns({
        "bucket": bucket.cast("int"),
        "key": F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                                 F.col("piece").cast("string")))})
    rows = numbered(rows, ["bucket", "key", "doc_id", "piece"], "place")
    rows = rows.withColumns({"pad_to": pad.cast("long"), "place": F.col("place") - first, "per": per.cast("long")})
    return rows.select("doc_id", "piece", "start", "n_tokens", "bucket", "pad_to",
                       F.expr("place div per").alias("batch"), F.expr("cast(place % per as int)").alias("row"))


def query(docs: DataFrame) -> DataFrame:
    return pack(docs)

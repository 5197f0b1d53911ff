"""Exact quantiles and thresholds by selection: values are counted, not sorted.

A quantile needs the values at one or two ranks of a column.  ``percentile_approx``
gives brackets that hold them; one scan counts the values below and inside of
every bracket (of all columns and quantiles together); where too many lie
inside, the bracket is narrowed in the same way.  What is left, at most
``GATHER`` values a quantile, is fetched with its counts.  Each step is one
aggregation with partial sums, so nothing but a few numbers a column moves, and
a value that a third of all rows share is one bracket.

A threshold of hashes (``radix_threshold``) is found by counting rows by their
leading bits: only the rows of the bucket with the threshold are counted again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtune.functions.columns import q
from tabtune.session import ensure_checkpoint_dir

#: Inverse of the relative rank error of the first brackets.
ACCURACY = 10_000
#: Values of a bracket that reach the driver at most.
GATHER = 2048
#: Columns of one aggregation.
WIDTH = 48


def doubles(df: DataFrame, cols) -> list[Column]:
    """The columns as doubles, NaN as null."""
    return [F.nanvl(F.col(q(c)).cast("double"), F.lit(None).cast("double")) for c in cols]


@dataclass
class Target:
    """The values at ranks ``lo`` and ``hi`` (from 0) of a column's values; they
    lie in [a, b], below which stand ``below`` values."""
    col: int
    lo: int
    hi: int
    a: float
    b: float
    below: int | None = None
    inside: int | None = None
    found: list = field(default_factory=list)

    def put(self, values) -> None:
        """Takes the values at both ranks from (value, count) pairs of the bracket."""
        at = self.below
        for rank in (self.lo, self.hi):
            place = at
            for v, n in sorted(values):
                place += n
                if rank < place:
                    self.found.append(v)
                    break


def _counted(df: DataFrame, x: list[Column], open_: list[Target]) -> None:
    aggs = []
    for i, t in enumerate(open_):
        v = x[t.col]
        aggs += [F.count(F.when(v < F.lit(t.a), 1)).alias(f"_b{i}"),
                 F.count(F.when((v >= F.lit(t.a)) & (v <= F.lit(t.b)), 1)).alias(f"_i{i}")]
    row = df.agg(*aggs).first()
    for i, t in enumerate(open_):
        t.below, t.inside = row[f"_b{i}"], row[f"_i{i}"]


def _narrowed(df: DataFrame, x: list[Column], open_: list[Target]) -> None:
    aggs = []
    for i, t in enumerate(open_):
        own = F.when((x[t.col] >= F.lit(t.a)) & (x[t.col] <= F.lit(t.b)), x[t.col])
        ends = [max(0.0, (t.lo - t.below) / t.inside - 2 / ACCURACY),
                min(1.0, (t.hi + 1 - t.below) / t.inside + 2 / ACCURACY)]
        aggs.append(F.percentile_approx(own, ends, ACCURACY).alias(f"_p{i}"))
    row = df.agg(*aggs).first()
    for i, t in enumerate(open_):
        t.a, t.b = row[f"_p{i}"]


def _gathered(df: DataFrame, x: list[Column], some: list[Target]) -> None:
    inside = [(x[t.col] >= F.lit(t.a)) & (x[t.col] <= F.lit(t.b)) for t in some]
    any_of = inside[0]
    for c in inside[1:]:
        any_of = any_of | c
    each = F.array(*[F.struct(F.lit(i).alias("t"), F.when(c, x[t.col]).alias("v"))
                     for i, (t, c) in enumerate(zip(some, inside))])
    rows = (df.where(any_of).select(F.explode(each).alias("s")).where("s.v IS NOT NULL")
            .groupBy("s.t", "s.v").agg(F.count(F.lit(1)).alias("n")).collect())   # GATHER each at most
    values: dict = {}
    for r in rows:
        values.setdefault(r["t"], []).append((r["v"], r["n"]))
    for i, t in enumerate(some):
        t.put(values[i])


def quantiles(df: DataFrame, cols, probs) -> dict:
    """{column: (n, min, max, [quantile of each prob])} with linear interpolation;
    nulls and NaN are no values, columns without values are left out."""
    out: dict = {}
    for at in range(0, len(cols), WIDTH):
        out.update(_quantiles(df, list(cols[at:at + WIDTH]), [float(p) for p in probs]))
    return out


def _quantiles(df: DataFrame, cols: list, probs: list) -> dict:
    df = df.select(*[v.alias(f"v{i}") for i, v in enumerate(doubles(df, cols))])
    x = [F.col(f"v{i}") for i in range(len(cols))]
    ends = [e for p in probs for e in (max(0.0, p - 2 / ACCURACY), min(1.0, p + 2 / ACCURACY))]
    aggs = []
    for i, v in enumerate(x):
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"min{i}"), F.max(v).alias(f"max{i}")]
        aggs += [F.percentile_approx(v, ends, ACCURACY).alias(f"p{i}")] if ends else []
    row = df.agg(*aggs).first()
    targets: dict = {}
    for i in range(len(cols)):
        n, least, most = row[f"n{i}"], row[f"min{i}"], row[f"max{i}"]
        for j, p in enumerate(probs if n else []):
            h = (n - 1) * p
            lo = math.floor(h)
            a, b = (row[f"p{i}"][2 * j:2 * j + 2]) if n > GATHER else (least, most)
            targets[i, j] = Target(i, lo, min(lo + 1, n - 1), a, b)
    open_ = list(targets.values())
    while open_:
        _counted(df, x, open_)
        for t in open_:      # a bracket that misses a rank is opened to that side
            if t.lo < t.below:
                t.a, t.inside = row[f"min{t.col}"], None
            if t.inside is not None and t.hi >= t.below + t.inside:
                t.b, t.inside = row[f"max{t.col}"], None
        again = [t for t in open_ if t.inside is None]
        if again:
            _counted(df, x, again)
        some = [t for t in open_ if t.a < t.b and t.inside <= GATHER]
        for t in open_:
            if t.a == t.b:
                t.found = [t.a, t.a]
        if some:
            _gathered(df, x, some)
        open_ = [t for t in open_ if not t.found]
        before = [(t.a, t.b) for t in open_]
        if open_:
            _narrowed(df, x, open_)
        # brackets of few values, each of them frequent, do not narrow
        stuck = [t for t, ab in zip(open_, before) if (t.a, t.b) == ab]
        if stuck:
            _gathered(df, x, stuck)
            open_ = [t for t in open_ if not t.found]
    out = {}
    for i, c in enumerate(cols):
        if not row[f"n{i}"]:
            continue
        got = []
        for j, p in enumerate(probs):
            h = (row[f"n{i}"] - 1) * p
            lo, hi = targets[i, j].found
            got.append(lo + (h - math.floor(h)) * (hi - lo) if hi != lo else lo)
        out[c] = (row[f"n{i}"], row[f"min{i}"], row[f"max{i}"], got)
    return out


# ---------------------------------------------------------------- hash thresholds
#: Bits of a hash (15 hex digits), bits counted in one pass, and rows of a
#: group's bucket that are compared one by one.
BITS, STEP, FEW = 60, 12, 1 << 16


def radix_threshold(rows: DataFrame, fraction: float, grp: str, h: str, key: str, digest: Column) -> DataFrame:
    """For each group, the row at rank ceil(fraction * n) in the order of
    (h, key, digest): ``grp``, ``thr_h``, ``thr_key``, ``thr_digest``, ``cnt``
    (rows equal to it) and ``need`` (how many of these still belong below).

    ``h`` (a column) and ``digest`` (an expression, computed for the rows of a
    threshold's bucket only) are hashes of ``BITS`` bits.  Groups without a row
    below have no threshold."""
    whole = (F.lit(0).cast("long"), F.lit((1 << BITS) - 1).cast("long"))
    state = None
    for column in (h, "_digest"):
        for shift in range(BITS - STEP, -1, -STEP):
            own = rows if state is None else _in_bucket(rows, state, grp, h, digest)
            counts = own.groupBy(grp, F.shiftright(F.col(column), shift).alias("part")).agg(
                F.count(F.lit(1)).alias("cnt"))
            order = Window.partitionBy(grp).orderBy("part")      # 2^STEP rows a group
            counts = counts.withColumn("upto", F.sum("cnt").over(order))
            if state is None:
                total = F.sum("cnt").over(Window.partitionBy(grp))
                counts = counts.withColumn("need", F.ceil(F.lit(float(fraction)) * total).cast("long"))
            else:
                counts = counts.join(near(state.select(grp, "need", "h0", "h1")), grp)
            lo = F.shiftleft(F.col("part"), shift)
            ends = [lo, lo + F.lit((1 << shift) - 1)]
            ends = [*ends, *whole] if column == h else [F.col("h0"), F.col("h1"), *ends]
            state = _local(_hit(counts).select(grp, *_left(), *[
                e.alias(n) for e, n in zip(ends, ("h0", "h1", "d0", "d1"))]))
            most = state.agg(F.max("cnt")).first()[0]
            if most is None or most <= FEW:
                break
        if most is None or most <= FEW:
            break
        if column == h:
            # Rows with one hash have one key, unless hashes collide: then keys decide before digests.
            keys = _in_bucket(rows, state, grp, h, digest).groupBy(grp).agg(
                (F.min(key) != F.max(key)).alias("several"))
            if keys.agg(F.max("several")).first()[0]:
                break
    last = _in_bucket(rows, state, grp, h, digest).groupBy(grp, h, key, "_digest").agg(
        F.count(F.lit(1)).alias("cnt"))
    order = Window.partitionBy(grp).orderBy(h, key, "_digest")       # FEW rows a group, equal rows as one
    last = last.withColumn("upto", F.sum("cnt").over(order)).join(near(state.select(grp, "need")), grp)
    return _local(_hit(last).select(grp, F.col(h).alias("thr_h"), F.col(key).alias("thr_key"),
                                    F.col("_digest").alias("thr_digest"), *_left()))


def _hit(counts: DataFrame) -> DataFrame:
    """The part of each group in which its threshold lies."""
    return counts.where((F.col("need") <= F.col("upto")) & (F.col("need") > F.col("upto") - F.col("cnt")))


def _left() -> list[Column]:
    return [F.col("cnt"), (F.col("need") - F.col("upto") + F.col("cnt")).alias("need")]


#: A table of one row a group is sent to every executor up to this size.
NEAR_BYTES = 32 << 20


#: Tables of one row a group up to this many rows are held as literal rows.
LITERAL_ROWS = 10_000


def _local(df: DataFrame) -> DataFrame:
    """A table of one row a group, computed once and without its lineage: later
    passes would carry the plans of all earlier ones."""
    spark = df.sparkSession
    rows = df.limit(LITERAL_ROWS + 1).collect()
    if len(rows) <= LITERAL_ROWS:
        return spark.createDataFrame(rows, df.schema)
    ensure_checkpoint_dir(spark)
    return df.checkpoint()


def near(df: DataFrame) -> DataFrame:
    """Broadcast only where the table's bytes are counted and few."""
    first = df.columns[0]
    size = df.agg(F.sum(F.coalesce(F.octet_length(F.col(first).cast("string")), F.lit(0)) + 100)).first()[0] or 0
    return F.broadcast(df) if size <= NEAR_BYTES else df


def _in_bucket(rows: DataFrame, state: DataFrame, grp: str, h: str, digest: Column) -> DataFrame:
    """The rows of each group's bucket, with their digests."""
    own = rows.join(near(state.select(grp, "h0", "h1", "d0", "d1")), grp)
    own = own.where(F.col(h).between(F.col("h0"), F.col("h1"))).withColumn("_digest", digest)
    open_ = (F.col("d0") == 0) & (F.col("d1") == (1 << BITS) - 1)
    return own.where(open_ | F.col("_digest").between(F.col("d0"), F.col("d1"))).drop("h0", "h1", "d0", "d1")

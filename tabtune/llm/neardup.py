"""Near-duplicates from bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct shingles of five words; its
sketch the k smallest.  Documents with equal sets form a class, and only one
sketch a class goes on.  Inverted lists (value - classes that retain it) give
the candidates, the sketch of the union estimates each candidate's
similarity, and sets built from the whole texts decide.

Why no link is lost.  Two sets with similarity t or more share, in the sketch
of their union, a number of values that is hypergeometric with mean t k; it
is below ``needed`` = t k - 6 standard deviations in less than one of 10^9
such pairs, and never where the sketches hold whole sets.  So a class of
which fewer values occur elsewhere has no partner.  That screens all classes
by small sketches (K); the few that pass get larger ones (WIDE).  For them it
is enough to look at the first (retained - needed + 1) values in the order of
rising frequency: two partners share one of them.  Values of a passage that
many documents quote come last and drop out.

Why hot lists are no trouble.  A list of many near-copies is not expanded
into pairs.  First every class meets one partner: of the members that come first
(by a hash) in its lists, the one that most of its lists name.  Then, in round
r, about 32^r members of a list are its hubs; every other member is compared
with the hubs unless a known link already joins the two.  After each round, lists whose members are
all joined are done; hubs leave the list, as all their pairs are decided.
The last round has every member left as a hub, so nothing is skipped; the
only pairs never compared are those already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabtune.llm import words as W
from tabtune.llm.components import components
from tabtune.llm.frames import fresh, saved

SHINGLE, K, WIDE = 5, 64, 256
SIGMAS = 6.0
GROWTH = 32
#: Rows whose sets are held together when pairs are verified.
VERIFY_ROWS = 64


def shingle_sets(column: pa.Array) -> Iterator[tuple[W.Part, np.ndarray, np.ndarray]]:
    """For some texts at a time: where each set starts, and the sorted values."""
    for part in W.parts(column, lower=True):
        grams = W.grams_hash(part.hash, SHINGLE)
        at = np.flatnonzero(part.doc[:len(grams)] == part.doc[SHINGLE - 1:])
        first = part.words_of()
        count = np.diff(first)
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        value = np.concatenate([grams[at], W.spans_hash(
            part.hash, first[short], first[short + 1], W.BASES[1])]).view(np.int64)
        doc = np.concatenate([part.doc[at], short])
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[new], doc[new]
        yield part, np.searchsorted(doc, np.arange(part.rows + 1)), value


def sketches(docs: DataFrame, id_col: str, text: str, k: int = K, key: Column | None = None) -> DataFrame:
    """doc, n (set size), s1 and s2 (hash of the set), sketch and, if asked, a
    binary key."""
    schema = "doc bigint, n bigint, s1 bigint, s2 bigint, sketch array<bigint>"
    schema += ", key binary" if key is not None else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, offs, value in shingle_sets(batch.column(1)):
                size = np.diff(offs)
                s1, s2 = set_hashes(offs, value)
                place = np.arange(len(value)) - np.repeat(offs[:-1], size)
                kept = np.concatenate([[0], np.cumsum(np.minimum(size, k))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(kept), pa.array(value[place < k]))
                own = [c.slice(part.row, part.rows) for c in batch.columns]
                yield pa.RecordBatch.from_arrays(
                    [own[0], pa.array(size), pa.array(s1), pa.array(s2), lists, *own[2:]],
                    names=["doc", "n", "s1", "s2", "sketch"] + ["key"] * (len(own) - 2))

    extra = [key.alias("key")] if key is not None else []
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"), *extra).mapInArrow(run, schema)


def set_hashes(offs: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    out = []
    for x in W.BASES:
        total = np.zeros(len(value) + 1, dtype=np.uint64)
        np.cumsum(W.mix(value.view(np.uint64) ^ np.uint64(x)), out=total[1:])
        out.append((total[offs[1:]] - total[offs[:-1]]).view(np.int64))
    return out[0], out[1]


def needed(n: Column, k: int, t: float, sigmas: float | None) -> Column:
    """Values that a set of size n shares with any partner's sketch at least;
    without ``sigmas`` nothing is taken from chance, and one value is enough to
    meet.  (Sketches of sets no larger than k are the sets.)"""
    if sigmas is None:
        return F.when(n <= k * t, F.ceil(t * n)).otherwise(1).cast("int")
    spread = F.sqrt(F.greatest(F.lit(0.0), k * t * (1 - t) * (1 - t * k / n)))
    return F.greatest(F.lit(1), F.floor(F.least(F.ceil(t * n), t * k - sigmas * spread))).cast("int")


def _shared(classes: DataFrame) -> DataFrame:
    """(v, c, n, df) of the retained values that several classes have."""
    postings = classes.select("c", "n", F.explode("sketch").alias("v"))
    often = postings.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return postings.join(often, "v")


def screened(classes: DataFrame, k: int, t: float, sigmas: float | None) -> DataFrame:
    """c of the classes that share enough values with others."""
    counts = _shared(classes).groupBy("c", "n").agg(F.count(F.lit(1)).alias("m"))
    return counts.where(F.col("m") >= needed(F.col("n"), k, t, sigmas)).select("c")


def prefixes(classes: DataFrame, k: int, t: float, sigmas: float | None) -> DataFrame:
    """(v, often, c, n, rest): the values in which a class can meet a partner,
    and how many of its values come no earlier in the order."""
    shared = _shared(classes).groupBy("c", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "v"))).alias("x"))    # k at most
    shared = shared.withColumn("m", F.size("x") - needed(F.col("n"), k, t, sigmas) + 1).where("m > 0")
    placed = shared.select("c", "n", F.size("x").alias("of"),
                           F.posexplode(F.slice("x", F.lit(1), F.col("m"))).alias("i", "x"))
    return placed.select("x.v", F.col("x.df").alias("often"), "c", "n", (F.col("of") - F.col("i")).alias("rest"))


def common(n: Column, m: Column, k: int, t: float, sigmas: float | None) -> Column:
    """Values that the sketches of two sets of sizes n and m with similarity
    t share at least.  The sets share i >= t (n + m) / (1 + t); the sketches
    share the smaller of two numbers, each hypergeometric (see ``needed``)."""
    if sigmas is None:
        return F.lit(1)
    both = t / (1 + t) * (n + m)
    bounds = []
    for size in (n, m):
        held = F.least(F.lit(k), size)
        p = F.least(F.lit(1.0), both / size)
        bounds.append(held * p - sigmas * F.sqrt(held * p * (1 - p) * (1 - held / size)))
    return F.least(*bounds) - 1e-6


def _lists(column: pa.Array, rows: int, width: int) -> np.ndarray:
    """A column of short lists as rows of a matrix, padded with the largest integer."""
    offs = np.asarray(column.offsets)
    size = np.diff(offs)
    out = np.full((rows, width), np.iinfo(np.int64).max)
    out[np.arange(width) < size[:, None]] = np.asarray(column.values)[offs[0]:offs[-1]]
    return out


def estimated(pairs: DataFrame, classes: DataFrame, k: int, t: float, sigmas: float | None) -> DataFrame:
    """Pairs whose union sketch does not rule out similarity t: a, b, est and
    whether est is the exact similarity.

    The k smallest values of the union come out of sorting both sketches as
    one row; a value that stands twice is in both sets."""
    at = round(t * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                some = batch.slice(row, 512)
                m = some.num_rows
                n = [np.asarray(some.column(i)) for i in (2, 3)]
                rows = np.concatenate([_lists(some.column(i), m, k) for i in (4, 5)], axis=1)
                rows.sort(axis=1)
                twice = np.zeros(rows.shape, dtype=bool)
                twice[:, 1:] = rows[:, 1:] == rows[:, :-1]
                here = rows != np.iinfo(np.int64).max
                twice &= here
                whole = (n[0] <= k) & (n[1] <= k)
                rank = np.cumsum(here & ~twice, axis=1, dtype=np.int32)
                inside = here & (whole[:, None] | (rank <= k))
                both = (twice & inside).sum(axis=1)
                size = (~twice & inside).sum(axis=1)
                # A union with similarity t is at most 1 / t as large as the smaller set.
                spread = np.sqrt(np.maximum(0, size * t * (1 - t) * (1 - t * size / np.minimum(*n))))
                fits = np.where(whole, 100 * both >= at * size, sigmas is None or both >= size * t - sigmas * spread - 1e-6)
                keep = pa.array(fits)
                yield pa.RecordBatch.from_arrays(
                    [x.filter(keep) for x in (some.column(0), some.column(1), pa.array(both / size), pa.array(whole))],
                    names=["a", "b", "est", "whole"])

    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("c").alias(side), F.col("n").alias(f"n_{side}"),
                                          F.col("sketch").alias(f"s_{side}")), side)
    return pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(
        run, "a bigint, b bigint, est double, whole boolean")


def verified(pairs: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """(hi, lo) of the pairs whose sets have similarity t or more."""
    at = round(t * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, dtype=bool)
            for row in range(0, batch.num_rows, VERIFY_ROWS):
                some = batch.slice(row, VERIFY_ROWS)
                sets = [[value[offs[i]:offs[i + 1]] for part, offs, value in shingle_sets(some.column(j))
                         for i in range(part.rows)] for j in (2, 3)]
                for i, (x, y) in enumerate(zip(*sets)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    linked[row + i] = 100 * both >= at * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays(
                [c.filter(pa.array(linked)) for c in batch.columns[:2]], names=["hi", "lo"])

    sure = pairs.where("whole").select(F.col("a").alias("hi"), F.col("b").alias("lo"))
    open_ = pairs.where("NOT whole").select("a", "b")
    for side in ("a", "b"):
        open_ = open_.join(texts.select(F.col("c").alias(side), F.col("text").alias(f"text_{side}")), side)
    checked = open_.select("a", "b", "text_a", "text_b").mapInArrow(run, "hi bigint, lo bigint")
    return sure.unionAll(checked)


def _with_root(df: DataFrame, stars: DataFrame | None, node: str, root: str) -> DataFrame:
    if stars is None:        # no class meets another
        return df.withColumn(root, F.col(node))
    s = stars.select(F.col("hi").alias("_n"), F.col("lo").alias("_root"))
    return (df.join(s, df[node] == s["_n"], "left")
            .withColumn(root, F.coalesce("_root", node)).drop("_n", "_root"))


def _in_order(lists: DataFrame) -> DataFrame:
    """The lists' rows with the lists in which their class stands earlier in
    the order of values (as few as a prefix has)."""
    own = lists.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("often", "v", "n", "rest", "rank"))).alias("x"))
    return own.select("c", "x", F.posexplode("x").alias("i", "y")).select(
        "y.v", "c", "y.n", "y.rest", "y.rank",
        F.transform(F.slice("x", F.lit(1), F.col("i")), lambda e: e["v"]).alias("before"))


def _starts(lists: DataFrame) -> DataFrame:
    """One pair (a, b) for each class that is not first in all its lists."""
    first = lists.groupBy("v").agg(F.min_by("c", "rank").alias("h"))
    named = lists.join(first, "v").where("c <> h").groupBy("c", "h").agg(F.count(F.lit(1)).alias("m"))
    best = named.groupBy("c").agg(F.max(F.struct("m", "h")).alias("x"))
    return best.select(F.greatest("c", "x.h").alias("a"), F.least("c", "x.h").alias("b")).distinct()


def link(classes: DataFrame, texts_of, k: int = K, wide: int = WIDE, t: float = 0.75,
         sigmas: float | None = SIGMAS) -> DataFrame | None:
    """Stars (hi, lo) over the classes; ``texts_of`` gives (c, text) for
    classes in a table with column c.  None where nothing meets."""
    texts = saved(texts_of(screened(classes, k, t, sigmas)), "met-texts")
    classes = saved(sketches(texts, "c", "text", wide).select(F.col("doc").alias("c"), "n", "sketch"),
                    "wide-sketches")
    k = wide
    lists = saved(prefixes(classes, k, t, sigmas), "prefixes")
    # Lists of the same members give the same pairs: the first in the order of
    # values, where all of them have the most values left, stands for the rest.
    member = F.xxhash64("c")
    alike = lists.groupBy("v").agg(
        F.min("often").alias("often"), F.count(F.lit(1)).alias("df"), F.bit_xor(member).alias("x"),
        F.sum(F.shiftrightunsigned(member, 24)).alias("y")).where("df > 1")
    size = alike.groupBy("df", "x", "y").agg(F.min(F.struct("often", "v")).alias("z")).select("z.v", "df")
    # A member's place in its lists: uniform in [0, 1), the same in all of them.
    place = member.bitwiseAND((1 << 53) - 1) / F.lit(float(1 << 53))
    lists = lists.join(saved(size, "sizes"), "v").withColumn("rank", place * F.col("df"))
    lists = saved(_in_order(lists), "lists")
    if lists.isEmpty():
        return None
    classes = saved(classes.join(lists.select("c").distinct(), "c", "left_semi"), "met-sketches")

    found = estimated(_starts(lists), classes, k, t, sigmas)
    stars = components(saved(verified(saved(found, "estimated"), texts, t), "links"))
    low, high = 0.0, float(GROWTH)
    while True:
        rows = _with_root(lists.where(F.col("rank") >= low), stars, "c", "root")
        apart = rows.groupBy("v").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y")
        rows = saved(rows.join(apart.select("v"), "v", "left_semi"), "open-lists")
        if rows.isEmpty():
            return stars
        hubs = rows.where(F.col("rank") < high).select("v", F.col("root").alias("h_root"), *[
            F.col(x).alias(f"h_{x}") for x in ("c", "n", "rest", "rank", "before")])
        # Two hubs meet once, not in both orders.  Sets of similarity t differ
        # in size by the factor t at most.  Two classes meet at the first value
        # they share: there, a hub of a later list is one too, or was one in an
        # earlier round.  They share no more than either has from there on.
        pairs = (rows.join(hubs, "v").where("root <> h_root")
                 .where("rank > h_rank OR rank = h_rank AND c > h_c")
                 .where(100 * F.least("n", "h_n") >= round(t * 100) * F.greatest("n", "h_n"))
                 .where(F.least("rest", "h_rest") >= common(F.col("n"), F.col("h_n"), k, t, sigmas))
                 .where(~F.arrays_overlap("before", "h_before"))
                 .select(F.greatest("c", "h_c").alias("a"), F.least("c", "h_c").alias("b")))
        found = saved(estimated(pairs, classes, k, t, sigmas), "estimated")
        links = saved(verified(found, texts, t), "links")
        if not links.isEmpty():
            stars = components(stars.unionAll(links))
        low, high = high, high * GROWTH


def _linked(docs: DataFrame, rows: DataFrame, id_col: str, text: str, k: int, wide: int, t: float,
            sigmas: float | None) -> DataFrame:
    """s1, s2, n, root and component_id of the classes that have an id."""
    classes = (rows.where("n > 0 AND doc IS NOT NULL").groupBy("s1", "s2", "n")
               .agg(F.min("doc").alias("doc"), F.first("sketch").alias("sketch"))
               .withColumn("c", F.monotonically_increasing_id()))
    classes = saved(classes, "classes")

    def texts_of(met: DataFrame) -> DataFrame:
        # One text for each class; a repeated id may stand for several texts.
        own = classes.join(met, "c", "left_semi").select("c", F.col("doc").alias("_doc"), "s1", "s2", "n")
        near = docs.select(F.col(id_col).cast("long").alias("_doc"), F.col(text).alias("text")).join(own, "_doc")
        counted = near.groupBy("c").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        return near.select("c", "text") if counted.isEmpty() else _own_texts(near)

    known = classes.select("c", "s1", "s2", "n", "doc")
    known = _with_root(known, link(classes, texts_of, k, wide, t, sigmas), "c", "root")
    least = known.groupBy("root").agg(F.min("doc").alias("component_id"))
    return known.join(least, "root").select("s1", "s2", "n", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = K, wide: int = WIDE,
                    t: float = 0.75, sigmas: float | None = SIGMAS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of docs.
    ``sigmas=None`` compares all classes that share a retained value.

    Defined results: null or wordless texts have no shingles and stay alone;
    rows with a null id take no part in links and are kept with a null
    component; rows that share an id are compared by their texts and kept or
    not by that id; an empty table gives none; other columns are not read.
    """
    rows = saved(sketches(docs, id_col, text, k), "sketches")
    known = _linked(docs, rows, id_col, text, k, wide, t, sigmas).drop("root")
    linked = rows.select("doc", "n", "s1", "s2").join(known, ["s1", "s2", "n"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return linked.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
                         component.alias("component_id"),
                         F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"))


def _own_texts(near: DataFrame) -> DataFrame:
    """Where ids repeat: the text whose set is the class's, once."""
    schema = "c bigint, text string, s1 bigint, s2 bigint, n bigint, h1 bigint, h2 bigint, m bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3)]
            for part, offs, value in shingle_sets(batch.column(1)):
                at = slice(part.row, part.row + part.rows)
                found[0][at], found[1][at] = set_hashes(offs, value)
                found[2][at] = np.diff(offs)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)],
                                             names=["c", "text", "s1", "s2", "n", "h1", "h2", "m"])

    return (near.select("c", "text", "s1", "s2", "n").mapInArrow(run, schema)
            .where("s1 = h1 AND s2 = h2 AND n = m").dropDuplicates(["c"]).select("c", "text"))


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component, with its columns as they came: the one with
    the smallest id.

    Defined results: of rows that share the smallest id in a component, one
    text stays; rows equal in id and text stand once; wordless texts stay
    alone; a row without an id goes where any other row has the same shingles,
    and of several such rows without an id one stays.
    """
    name, key = fresh(docs, "_id", "_key")
    digest = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    rows = saved(sketches(docs, id_col, text, K, digest), "sketches")
    known = saved(_linked(docs, rows, id_col, text, K, WIDE, 0.75, SIGMAS), "known")
    rows = rows.select("doc", "n", "s1", "s2", "key")
    own, nameless = rows.where("n > 0 AND doc IS NOT NULL"), rows.where("n > 0 AND doc IS NULL")
    first = own.join(known, ["s1", "s2", "n"]).groupBy("root").agg(F.min(F.struct("doc", "key")).alias("x"))
    other = (nameless.join(known.select("s1", "s2", "n"), ["s1", "s2", "n"], "left_anti")
             .groupBy("s1", "s2", "n").agg(F.min("key").alias("key")))
    alone = rows.where("n = 0").select("doc", "key").distinct()
    kept = first.select("x.doc", "x.key").unionAll(other.select(F.lit(None).cast("long"), "key")).unionAll(alone)
    kept = kept.select(F.col("doc").alias("_l"), F.col("key").alias("_r"))
    marked = docs.withColumns({name: F.col(id_col).cast("long"), key: digest})
    out = marked.join(kept, marked[name].eqNullSafe(kept["_l"]) & (marked[key] == kept["_r"]), "left_semi")
    again = rows.groupBy("doc", "key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    out = out if again.isEmpty() else out.dropDuplicates([name, key])
    return out.select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS x FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')]
    ELSE list_distinct(list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' '))) END AS g FROM w
), p AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM p a JOIN p b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (SELECT a, b FROM o WHERE 100 * c >= 75 * (na + nb - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, x.b FROM r JOIN both_ways x ON r.b = x.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN m ON m.a = s.doc_id
"""

"""Substring dedup by relative Lempel-Ziv parsing.

Every document is factored against all documents with a smaller id: a factor
is a stretch of words that stands, word for word, at one place of one of them.
Factors do not overlap; each has at least ``span`` (50) words, a source (the
smallest such document, and the first place in it) and is a duplicate span.

The reference is never scanned per document.  It is indexed in blocks: each
window of 50 words belongs to the 10-gram in it with the smallest hash, its
anchor, and the consecutive windows of one anchor form a run.  All runs with
one anchor, wherever they stand, are one reference block; equal windows
always lie in the same block, so a document is looked up in just the blocks of
its own anchors, one in about twenty words.

 * In a block whose runs are all equal, the whole run stands at one place of
   the smallest document there.
 * Otherwise factors end inside the runs (the copied stretches differ at their
   boundaries).  Then each distinct run of the block is cut into its windows,
   and each window is looked up by its own hash.
 * The parser goes through a document from left to right.  A factor starts at
   the next window that has a source, takes its place there, and grows by a
   word as long as the following window stands at the following place of the
   same source; the next factor starts where it ends.
 * At the boundary of two factors, windows that begin in one and end beyond it
   are checked on their own: those that stand in a smaller document are
   duplicates as well.  So a word is removed exactly where a factor or such a
   window covers it, that is, where any window of 50 words that also starts in
   a smaller document covers it.

Groups of copies are never brought together: runs are pre-aggregated to
minima, and only these come back to the documents.  Words and runs are
compared by 64-bit hashes, windows by 128 bits.

Defined results: null or wordless texts have no words and keep none; rows
with a null id are neither reference nor changed; rows that share an id are
one document for the comparison with others, each with its own text; an empty
table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtune.llm import words as W
from tabtune.llm.frames import saved

SPAN, ANCHOR = 50, 10
#: Windows whose anchors are searched together.
BLOCK = 1 << 16


def anchors(hashes: np.ndarray, span: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of ``span`` words: the first word of its anchor; and the
    hashes of all anchor grams."""
    grams = W.grams_hash(hashes, anchor)
    wide = span - anchor + 1
    n = len(hashes) - span + 1
    out = np.zeros(max(n, 0), dtype=np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        out[at:to] = at + np.arange(to - at) + sliding_window_view(
            grams[at:to + wide - 1], wide).argmin(axis=1)
    return out, grams


def runs(part: W.Part, span: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Text, first and last window (in words of the text), hash of the anchor
    and of the content of each run."""
    place, grams = anchors(part.hash, span, anchor)
    at = np.flatnonzero(part.doc[:len(place)] == part.doc[span - 1:]) if len(place) else place
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(place[at]) != 0) | (np.diff(part.doc[at]) != 0)
    heads = np.flatnonzero(new)
    p, q = at[heads], at[np.append(heads[1:], len(at)) - 1]
    first = part.words_of()[part.doc[p]]
    return (part.doc[p], p - first, q - first, grams[place[p]].view(np.int64),
            W.spans_hash(part.hash, p, q + span, W.BASES[1]).view(np.int64))


def _index(rows: DataFrame, span: int, anchor: int) -> DataFrame:
    names = ["doc", "rid", "p", "q", "a", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.parts(batch.column(2)):
                doc, p, q, a, c = runs(part, span, anchor)
                ids = pa.array(part.row + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(ids), batch.column(1).take(ids), pa.array(p.astype(np.int32)),
                     pa.array(q.astype(np.int32)), pa.array(a), pa.array(c)], names=names)

    return rows.where("doc IS NOT NULL").mapInArrow(run, "doc bigint, rid bigint, p int, q int, a bigint, c bigint")


def _windows(rows: DataFrame, span: int) -> DataFrame:
    """The windows of the listed runs: a, c, j (place in the run), w1, w2, doc and
    pos (first word in the document)."""
    names = ["a", "c", "j", "w1", "w2", "doc", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offs, own = np.asarray(lists.offsets), lists.values
            p, q, a, c = (np.asarray(own.field(i)) for i in range(4))
            for part in W.parts(batch.column(1)):
                lo, hi = offs[part.row], offs[part.row + part.rows]
                doc = np.repeat(np.arange(part.rows), np.diff(offs[part.row:part.row + part.rows + 1]))
                size = q[lo:hi] - p[lo:hi] + 1
                run_of = np.repeat(np.arange(hi - lo), size)
                j = np.arange(len(run_of)) - np.repeat(np.cumsum(size) - size, size)
                pos = p[lo:hi][run_of] + j
                at = part.words_of()[doc][run_of] + pos
                w = [W.spans_hash(part.hash, at, at + span, x).view(np.int64) for x in W.BASES] if len(at) \
                    else [np.zeros(0, np.int64)] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[lo:hi][run_of]), pa.array(c[lo:hi][run_of]), pa.array(j.astype(np.int32)),
                     pa.array(w[0]), pa.array(w[1]),
                     batch.column(0).take(pa.array(part.row + doc[run_of])), pa.array(pos.astype(np.int32))],
                    names=names)

    return rows.select("doc", "text", "runs").mapInArrow(
        run, "a bigint, c bigint, j int, w1 bigint, w2 bigint, doc bigint, pos int")


def matches(rows: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """For each (doc, rid) with a copied window: ``at``, the windows that stand
    in a smaller document, ``ref``, the smallest such document of each, and
    ``src``, the first word of its first place there."""
    source = rows.dropDuplicates(["doc", "rid"]) if _repeated(rows) else rows
    index = saved(_index(source, span, anchor), "runs")
    blocks = index.groupBy("a").agg(F.min(F.struct("doc", "rid", "p")).alias("first"), F.max("doc").alias("d1"),
                                    (F.min("c") != F.max("c")).alias("differ")).where("first.doc < d1")
    # Plain sides, so that hot anchors and runs can be split in the joins.
    blocks = saved(blocks.select("a", F.col("first.doc").alias("d0"), F.col("first.p").alias("p0"), "differ"), "blocks")
    met = saved(index.join(blocks, "a"), "met-runs")
    alike = met.where("NOT differ AND doc > d0").select(
        "doc", "rid", F.sequence("p", "q").alias("at"), F.array_repeat("d0", F.col("q") - F.col("p") + 1).alias("ref"),
        F.sequence("p0", F.col("p0") + F.col("q") - F.col("p")).alias("src"))

    distinct = met.where("differ").groupBy("a", "c").agg(F.min(F.struct("doc", "rid", "p", "q")).alias("x"))
    listed = distinct.groupBy("x.doc", "x.rid").agg(      # no more than a document has runs
        F.collect_list(F.struct("x.p", "x.q", "a", "c")).alias("runs"))
    windows = saved(_windows(source.join(listed, ["doc", "rid"]), span), "windows")
    least = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "pos")).alias("m"))
    known = saved(windows.join(least, ["w1", "w2"]).groupBy("a", "c").agg(   # windows of one run
        F.sort_array(F.collect_list(F.struct("j", "m.doc", "m.pos"))).alias("x")), "known")
    cut = (met.where("differ").select("a", "c", "doc", "rid", "p").join(known, ["a", "c"])
           .withColumn("x", F.filter("x", lambda w: w["doc"] < F.col("doc"))).where(F.size("x") > 0)
           .select("doc", "rid", F.transform("x", lambda w: F.col("p") + w["j"]).alias("at"),
                   F.transform("x", lambda w: w["doc"]).alias("ref"), F.transform("x", lambda w: w["pos"]).alias("src")))
    both = alike.unionAll(cut)
    return both.groupBy("doc", "rid").agg(*[F.flatten(F.collect_list(x)).alias(x) for x in ("at", "ref", "src")])


def _repeated(rows: DataFrame) -> bool:
    """Whether an id stands in several rows."""
    return not rows.where("doc IS NOT NULL").groupBy("doc").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def parse(at: np.ndarray, ref: np.ndarray, src: np.ndarray, span: int) -> list[dict]:
    """Factors of a document, from left to right, from its matched windows in order."""
    new = np.ones(len(at), dtype=bool)      # windows that do not continue the one before at its source
    new[1:] = (np.diff(at) != 1) | (np.diff(ref) != 0) | (np.diff(src) != 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    out, free = [], 0
    for i, j in zip(heads, tails):
        start = max(int(at[i]), free)       # where the last factor ended, if that is inside this stretch
        if start <= at[j]:
            out.append({"start": start, "words": int(at[j]) - start + span, "ref": int(ref[i]),
                        "src": int(src[i]) + start - int(at[i])})
            free = int(at[j]) + span
    return out


def covered(at: np.ndarray, n: int, span: int) -> np.ndarray:
    """Which of n words a matched window covers."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + span, -1)
    return np.cumsum(step[:n]) > 0


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN,
                anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept_sha256 (of the kept words,
    joined by one space), factors (start, words, ref, src: the first word in ref)
    and, if asked, kept_text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("doc", "text")).select("doc", "rid", "text")
    found = matches(rows, span, anchor)
    schema = ("doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, "
              "factors array<struct<start: int, words: int, ref: bigint, src: int>>")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "factors"]
    if with_text:
        schema, names = schema + ", kept_text string", [*names, "kept_text"]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("ref", pa.int64()),
                              ("src", pa.int32())]))

    def one(content: str | None, *found: np.ndarray | None) -> tuple:
        words = (content or "").encode().split()
        n, factors = len(words), []
        if found[0] is not None:
            order = np.argsort(found[0], kind="stable")
            at, ref, src = (x[order] for x in found)
            factors = parse(at, ref, src, span)
            words = list(compress(words, ~covered(at, n, span)))
        left = b" ".join(words)
        return n, n - len(words), hashlib.sha256(left).hexdigest(), factors, left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                some = batch.slice(row, 512)
                out = [one(t.as_py(), *[np.asarray(x.values) if x.is_valid else None for x in found])
                       for t, *found in zip(*some.columns[1:])]
                n, gone, sha, factors, left = zip(*out)
                arrays = [some.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                          pa.array(sha), pa.array(factors, kind)]
                if with_text:
                    arrays.append(pa.array([x.decode() for x in left], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.join(found, ["doc", "rid"], "left").select("doc", "text", "at", "ref", "src").mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return deduplicate(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents
), w AS (
  SELECT doc_id, unnest(range(1, len(x) - 48)) AS p, x FROM d WHERE len(x) >= 50
), h AS (SELECT doc_id, p, md5(array_to_string(x[p:p + 49], ' ')) AS k FROM w),
dup AS (SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS m FROM h) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM dup),
kept AS (
  SELECT d.doc_id, d.i, d.word FROM (SELECT doc_id, unnest(x) AS word, generate_subscripts(x, 1) AS i FROM d) d
  LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.i = d.i WHERE g.i IS NULL
), j AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS s FROM kept GROUP BY doc_id)
SELECT d.doc_id, len(x)::BIGINT AS n_words, (len(x) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN j ON j.doc_id = d.doc_id
"""

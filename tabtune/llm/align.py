"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Tokenizer A is a byte-level BPE, B a piece model with byte fallback.  Both
encode one space and the text (B adds the space itself), so their tokens cut
the same bytes.  For some whole documents at a time:

 * pandas ``merge_asof``, keyed by document, finds for the start of each A token
   the B token that covers it, and for the start of each B token the A token
   that covers it.  The union of both directions is all overlapping pairs.
 * Overlaps with equal ends close the groups: the stretches between two byte
   offsets at which tokens of both sides end.
 * All pairs of one group are linked.  They are counted, not listed: a
   document keeps each linked pair of ids once, with its number of links.  The
   pairs of a long group come from its distinct ids on either side.

How many documents link a pair of ids is one aggregation with partial sums.
The counts go back to the documents in two ways, so that neither needs a table
of unbounded size in a task: the most frequent pairs (``HOT`` at most) are
broadcast, and the rest, which occur in few documents each, are joined by a
shuffle.

Defined results: null and empty texts, and those whose tokens do not spell the
text out again (B's own mark for spaces in the text, for one), have no tokens:
zeros and an empty digest; repeated rows and ids, and rows without an id, are
documents of their own; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtune.llm.frames import saved

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
#: Pairs of ids whose counts are broadcast, at most.
HOT = 1 << 20
#: Bytes of text that are aligned together; a longer text comes alone.
PART_BYTES = 1 << 18
#: Pairs of one group beyond which its distinct ids are paired, some rows at a time.
LARGE = 1 << 16

# Fixed value: how byte-level BPE splits a text before merging.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: visible Latin-1
    characters stand for themselves, the other bytes for the characters from
    256 on, in their order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Byte-level BPE from a ``tokenizers`` file: token bytes and ids of texts."""

    def __init__(self, file: bytes) -> None:
        own = json.loads(file)
        vocab, table = own["model"]["vocab"], byte_of()
        size = 1 + max([*vocab.values(), *(t["id"] for t in own.get("added_tokens", []))], default=0)
        self.tokens = [b""] * size
        for piece, i in vocab.items():
            self.tokens[i] = bytes(table[c] for c in piece)
        self.ranked = self._ranked(own)
        if self.ranked:
            import tiktoken
            self.engine = tiktoken.Encoding("own", pat_str=WORDS, special_tokens={}, mergeable_ranks={
                t: i for i, t in enumerate(self.tokens) if t})
        else:
            from tokenizers import Tokenizer
            self.engine = Tokenizer.from_str(file.decode())
            self.engine.encode_special_tokens = True

    def _ranked(self, own: dict) -> bool:
        """Whether merging by id is merging by the file's list: each token longer
        than a byte comes from one merge, and ids rise along the list."""
        pre, model, vocab = own.get("pre_tokenizer") or {}, own["model"], own["model"]["vocab"]
        if own.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) \
                or pre.get("add_prefix_space") or model.get("ignore_merges") or model.get("dropout"):
            return False
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [vocab.get("".join(m), -1) for m in merges]
        single = [i for piece, i in vocab.items() if len(piece) == 1]
        return (len(single) == 256 and len(made) + 256 == len(vocab) and all(np.diff(made) > 0)
                and min(made, default=256) > max(single))

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.ranked:
            return [self.engine.encode_ordinary(t) for t in texts]
        return [e.ids for e in self.engine.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A ``sentencepiece`` model: token bytes and ids of texts."""

    def __init__(self, file: bytes) -> None:
        import sentencepiece
        self.engine = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.tokens = []
        for i, piece in enumerate(self.engine.id_to_piece(list(range(self.engine.get_piece_size())))):
            if self.engine.is_byte(i):
                self.tokens.append(bytes([int(piece[1:-1], 16)]))
            elif self.engine.is_control(i) or self.engine.is_unknown(i):
                self.tokens.append(b"")
            else:
                self.tokens.append(piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.engine.encode(texts, num_threads=1)


@dataclass
class Side:
    """The tokens of some documents on one side, one after another."""

    ids: np.ndarray
    doc: np.ndarray
    start: np.ndarray    # in the bytes of all these documents
    end: np.ndarray

    @classmethod
    def of(cls, found: list, size: np.ndarray) -> Side:
        count = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(count.sum()))
        end = np.cumsum(size[ids])
        return cls(ids, np.repeat(np.arange(len(found)), count), end - size[ids], end)


def overlaps(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (A token, B token) that share a byte, in order."""
    def covering(own: Side, other: Side) -> np.ndarray:
        left = pd.DataFrame({"at": own.start, "doc": own.doc})
        right = pd.DataFrame({"at": other.start, "doc": other.doc, "token": np.arange(len(other.ids))})
        return pd.merge_asof(left, right, on="at", by="doc")["token"].to_numpy()

    if not len(a.ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    over_a, over_b = covering(a, b), covering(b, a)
    new = np.flatnonzero(a.start[over_b] != b.start)     # equal starts were found from A's side
    i = np.concatenate([np.arange(len(a.ids)), over_b[new]])
    j = np.concatenate([over_a, new])
    order = np.lexsort((j, i))
    return i[order], j[order]


def groups(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray]:
    """The last A and the last B token of each group: overlaps with equal ends."""
    i, j = overlaps(a, b)
    both = a.end[i] == b.end[j]
    return i[both], j[both]


def _counted(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[heads], np.add.reduceat(weight, heads) if len(heads) else weight


def linked(a: Side, b: Side, ends: tuple[np.ndarray, np.ndarray], width: int, span: int) -> tuple:
    """Distinct keys doc * span + A id * width + B id of the linked pairs, and
    the number of links of each."""
    first = [np.concatenate([[0], e + 1]) for e in ends]
    p, q = np.diff(first[0]), np.diff(first[1])
    doc = a.doc[ends[0]]
    small = np.flatnonzero(p * q <= LARGE)
    found, weights = [], []
    limit = np.cumsum((p * q)[small])
    for at in range(0, int(limit[-1]) if len(limit) else 0, 16 * LARGE):
        own = small[np.searchsorted(limit, at, side="right"):np.searchsorted(limit, at + 16 * LARGE, side="right")]
        size = (p * q)[own]
        g = np.repeat(own, size)
        place = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
        x, y = first[0][g] + place // q[g], first[1][g] + place % q[g]
        key, weight = _counted(doc[g] * span + a.ids[x] * width + b.ids[y], np.ones(len(g), dtype=np.int64))
        found.append(key)
        weights.append(weight)
    for g in np.flatnonzero(p * q > LARGE):
        xs, m = np.unique(a.ids[first[0][g]:first[0][g + 1]], return_counts=True)
        ys, n = np.unique(b.ids[first[1][g]:first[1][g + 1]], return_counts=True)
        found.append((doc[g] * span + xs[:, None] * width + ys).ravel())
        weights.append((m[:, None] * n).ravel())
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _counted(np.concatenate(found), np.concatenate(weights))


class Aligner:
    """Both tokenizers, and what a batch of texts gives."""

    def __init__(self, byte_bpe: bytes, pieces: bytes) -> None:
        self.a, self.b = ByteBpe(byte_bpe), Pieces(pieces)
        self.size = [np.array([len(t) for t in x.tokens], dtype=np.int64) for x in (self.a, self.b)]
        # Each id with what follows it in a group's text, first A's, then B's.
        self.parts = [b"%d%b" % (i, mark) for x, marks in ((self.a, (b",", b"|")), (self.b, (b",", b";")))
                      for mark in marks for i in range(len(x.tokens))]

    def sides(self, texts: list[str | None]) -> tuple[Side, Side]:
        """The tokens of all texts that both sides spell out."""
        own = [i for i, t in enumerate(texts) if t]
        whole = [" " + texts[i] for i in own]
        found = (self.a.encode(whole), self.b.encode([texts[i] for i in own])) if own else ([], [])
        lists = [[()] * len(texts), [()] * len(texts)]
        for i, t, *ids in zip(own, whole, *found):
            if all(b"".join(map(x.tokens.__getitem__, y)) == t.encode() for x, y in zip((self.a, self.b), ids)):
                lists[0][i], lists[1][i] = ids
        return Side.of(lists[0], self.size[0]), Side.of(lists[1], self.size[1])

    def digests(self, a: Side, b: Side, ends: tuple, rows: int) -> list[str]:
        """Of each document: SHA-256 of its groups' ids."""
        na, nb = len(self.a.tokens), len(self.b.tokens)
        code = [a.ids.copy(), b.ids + 2 * na]
        code[0][ends[0]] += na
        code[1][ends[1]] += nb
        first = [np.concatenate([[0], e + 1]) for e in ends]
        of = [np.repeat(np.arange(len(ends[0])), np.diff(f)) for f in first]
        order = np.empty(len(a.ids) + len(b.ids), dtype=np.int64)
        order[np.arange(len(a.ids)) + first[1][of[0]]] = code[0]
        order[np.arange(len(b.ids)) + first[0][of[1] + 1]] = code[1]
        borders = (np.searchsorted(a.doc, np.arange(rows + 1)) + np.searchsorted(b.doc, np.arange(rows + 1))).tolist()
        pieces = list(map(self.parts.__getitem__, order.tolist()))
        return [hashlib.sha256(b"".join(pieces[x:y])[:-1]).hexdigest() if x < y else ""
                for x, y in zip(borders[:-1], borders[1:])]

    def rows(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """Counts, digest and linked pairs of each text."""
        n = len(texts)
        a, b = self.sides(texts)
        ends = groups(a, b)
        width = len(self.b.tokens)
        span = len(self.a.tokens) * width
        key, links = linked(a, b, ends, width, span)
        doc = key // span
        borders = np.searchsorted(doc, np.arange(n + 1))
        total = np.concatenate([[0], np.cumsum(links)])
        pairs = pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.StructArray.from_arrays(
            [pa.array(key - doc * span), pa.array(links)], names=["pair", "links"]))
        return {"n_a": pa.array(np.bincount(a.doc, minlength=n)), "n_b": pa.array(np.bincount(b.doc, minlength=n)),
                "n_groups": pa.array(np.bincount(a.doc[ends[0]], minlength=n)),
                "n_links": pa.array(total[borders[1:]] - total[borders[:-1]]),
                "groups_sha256": pa.array(self.digests(a, b, ends, n), pa.string()), "pairs": pairs}

    def spans(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """Of each text: the ids and ends (in bytes) of its tokens, the overlapping
        pairs of token numbers and the numbers of each group's last tokens."""
        n = len(texts)
        a, b = self.sides(texts)
        out = {}
        starts = [np.searchsorted(x.doc, np.arange(n + 1)) for x in (a, b)]
        for name, side, first in (("a", a, starts[0]), ("b", b, starts[1])):
            base = np.concatenate([[0], side.end])[first[:-1]]
            offs = pa.array(first.astype(np.int32))
            out[f"{name}_ids"] = pa.ListArray.from_arrays(offs, pa.array(side.ids))
            out[f"{name}_ends"] = pa.ListArray.from_arrays(offs, pa.array(side.end - base[side.doc]))
        for name, (i, j) in (("overlaps", overlaps(a, b)), ("groups", groups(a, b))):
            offs = np.searchsorted(a.doc[i], np.arange(n + 1)).astype(np.int32)
            own = pa.StructArray.from_arrays([pa.array(i - starts[0][a.doc[i]]), pa.array(j - starts[1][b.doc[j]])],
                                             names=["a", "b"])
            out[name] = pa.ListArray.from_arrays(pa.array(offs), own)
        return out


def _parts(column: pa.Array) -> Iterator[list[str | None]]:
    some: list[str | None] = []
    size = 0
    for text in column.to_pylist():
        if some and size + len(text or "") > PART_BYTES:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text or "")
    if some:
        yield some


def _mapped(docs: DataFrame, id_col: str, text: str, what: str, kinds: str, byte_bpe: str, pieces: str) -> DataFrame:
    """doc_id and what the named method of Aligner gives.  The tokenizers' files
    (a few MB) are read here and sent to the tasks."""
    files = []
    for path in (byte_bpe, pieces):
        with open(path, "rb") as f:
            files.append(f.read())
    sent = docs.sparkSession.sparkContext.broadcast({"files": files})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value       # a worker keeps it, and so the tokenizers, from task to task
        aligner = held.get("aligner") or held.setdefault("aligner", Aligner(*held["files"]))
        for batch in batches:
            at = 0
            for some in _parts(batch.column(1)):
                out = getattr(aligner, what)(some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), *out.values()],
                                                 names=["doc_id", *out])
                at += len(some)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, " + kinds)


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE,
          pieces: str = PIECES) -> DataFrame:
    """The alignment itself, one row for each row of docs: ids and byte ends of
    both sides' tokens, overlaps and groups (see Aligner.spans)."""
    pair = "array<struct<a: bigint, b: bigint>>"
    return _mapped(docs, id_col, text, "spans", "a_ids array<bigint>, a_ends array<bigint>, b_ids array<bigint>, "
                   f"b_ends array<bigint>, overlaps {pair}, groups {pair}", byte_bpe, pieces)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """pair, a, count (documents that link it) and best (no pair of the same A
    id has more)."""
    counts = rows.select(F.inline("pairs")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    counts = saved(counts.withColumn("a", F.expr(f"pair div {width}")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))     # a row for each id of a vocabulary
    return counts.join(F.broadcast(most), "a").select("pair", "a", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE,
          pieces: str = PIECES, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256; one row for each row of docs."""
    with open(pieces, "rb") as f:
        width = len(Pieces(f.read()).tokens)
    rows = saved(_mapped(docs, id_col, text, "rows", "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
                         "groups_sha256 string, pairs array<struct<pair: bigint, links: bigint>>", byte_bpe, pieces)
                 .withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = saved(pair_counts(rows, width), "counts")
    # Pairs by the binary digits of their counts: 64 rows at most.
    levels = counts.groupBy(F.length(F.bin("count")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    least, total = 0, 0
    for level, n in sorted(map(tuple, levels.collect()), reverse=True):
        total += n
        if total > hot:
            least = 1 << level
            break
    held = F.broadcast(counts.where(F.col("count") >= least).select("pair", "count", "best"))
    each = rows.select("row", F.inline("pairs"))
    sums = [F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
            F.sum(F.col("links") * F.col("count")).alias("count_sum")]
    found = each.join(held, "pair").groupBy("row").agg(*sums)
    if least:
        rest = saved(each.join(held.select("pair"), "pair", "left_anti"), "rare-links")
        rare = counts.where(F.col("count") < least).select("pair", "count", "best")
        found = (found.unionAll(rest.join(rare, "pair").groupBy("row").agg(*sums))
                 .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return rows.drop("pairs").join(found, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")


def query(docs: DataFrame) -> DataFrame:
    return align(docs)

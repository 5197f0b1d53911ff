"""Exact dedup: Patricia tries own the groups of equal texts.

Two texts are equal when they are identical after replacing each run of ASCII
white space by one space.  Rows never meet in groups; their texts meet in
compressed radix tries:

 * Each task of the scan inserts the full byte strings of its rows into a trie
   of its own.  A terminal node holds the smallest identifier and the number of
   rows that ended there, so a text that a third of all rows share leaves a
   task as one terminal.  A trie that has grown to ``held`` bytes hands its
   terminals on and starts anew.
 * The terminals go to partitions by length and content hash.  Equal texts
   have both in common, whatever row they come from.  Each partition inserts
   them into its trie, which merges the identifiers.
 * A partition's trie that outgrows ``held`` bytes spills by subtree: the
   heaviest branch leaves with all its terminals, and later strings of that
   branch pass it by.  What is spilled is a table in the shared folder, and
   each spilled branch is a key of the next round's partitions.  A trie keeps
   at least one text, so every round resolves some for good.

The terminals then go back to the rows, by length and SHA-256 of the text.

Defined results: a null text counts as empty and equals it; a text of white
space only equals a single space; the owner of a group is its row with the
smallest id, rows without an id come last; of rows that share that id one
stays, so each group keeps exactly one row; without any id in a group, keep_id
is null; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabtune.llm.frames import fresh, saved

SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that one trie holds, and that one partition gets on average.
HELD, PARTITION = 96 << 20, 48 << 20
#: No shuffle has more partitions; larger ones spill.
MOST_PARTITIONS = 1 << 15
#: Stands for a row without an id: after every id.
NO_ID = 1 << 63
BATCH_BYTES = 4 << 20

_TERMINALS = "bytes bigint, sha binary, text binary, id bigint, same bigint, n bigint"


class Node:
    """An edge label and what lies below; ``own`` is [id, rows with it, rows, sha]
    where a text ends.  A spilled node only has the name of its branch; a node
    above one is ``cut``."""

    __slots__ = ("label", "kids", "own", "spilled", "cut")

    def __init__(self, label: bytes, kids: dict | None = None, own: list | None = None, cut: bool = False):
        self.label, self.kids, self.own, self.spilled, self.cut = label, kids or {}, own, None, cut


def merge(own: list, other: list) -> None:
    if other[0] < own[0]:
        own[0], own[1] = other[0], other[1]
    elif other[0] == own[0]:
        own[1] += other[1]
    own[2] += other[2]


def agree(label: bytes, text: bytes, at: int) -> int:
    """Leading bytes that ``label`` and ``text`` from ``at`` have in common."""
    most, same, step = min(len(label), len(text) - at), 0, 16
    while same < most:
        differ = min(most, same + step)
        if label[same:differ] != text[at + same:at + differ]:
            break
        same, step = differ, 2 * step
    else:
        return most
    while differ - same > 1:
        half = (same + differ) // 2
        if label[same:half] == text[at + same:at + half]:
            same = half
        else:
            differ = half
    return same


class Trie:
    """A compressed radix trie over byte strings."""

    def __init__(self) -> None:
        self.root, self.size = Node(b""), 0

    def insert(self, text: bytes, own: list) -> Node | None:
        """Adds a text; if its branch was spilled, returns that branch instead."""
        node, at, end = self.root, 0, len(text)
        while at < end:
            kid = node.kids.get(text[at])
            if kid is None:
                node.kids[text[at]] = Node(text[at:], own=own)
                self.size += end - at
                return None
            if kid.spilled is not None:
                return kid
            label = kid.label
            if text.startswith(label, at):
                node, at = kid, at + len(label)
                continue
            same = agree(label, text, at)
            fork = Node(label[:same], {label[same]: kid}, cut=kid.cut)
            kid.label = label[same:]
            node.kids[text[at]] = fork
            node, at = fork, at + same
        if node.own is None:
            node.own = own
        else:
            merge(node.own, own)
        return None

    def terminals(self, top: Node | None = None, before: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """Texts and what their terminals hold, below ``top``."""
        stack = [(top or self.root, before)]
        while stack:
            node, before = stack.pop()
            text = before + node.label
            if node.own is not None:
                yield text, node.own
            stack.extend((kid, text) for kid in node.kids.values() if kid.spilled is None)

    def _weight(self, top: Node) -> int:
        """Label bytes of a branch; 0 where no text ends in it."""
        total, ends, stack = 0, False, [top]
        while stack:
            node = stack.pop()
            total += len(node.label)
            ends = ends or node.own is not None
            stack.extend(kid for kid in node.kids.values() if kid.spilled is None)
        return total if ends else 0

    def spill(self) -> tuple[bytes, Node] | None:
        """Cuts the heaviest branch off that leaves other texts behind: the
        bytes before it and the branch.  None where one text is left.  A branch
        that parts were cut from before stays: equal texts must not go out
        under two names."""
        node, before, above, others = self.root, b"", [], False
        while True:
            above.append(node)
            live = [(w, kid.label[0], kid) for kid in node.kids.values()
                    if kid.spilled is None and (w := self._weight(kid))]
            if not live:
                return None
            others = others or len(live) > 1 or node.own is not None
            weight, first, branch = max(live, key=lambda x: x[:2])
            if others and not branch.cut:
                break
            node = branch
            before += branch.label
        gone = Node(branch.label[:1])
        gone.spilled = before + branch.label[:1]
        node.kids[first] = gone
        for node in above:
            node.cut = True
        self.size -= weight
        return before, branch


class _Rows:
    """Terminals on their way out, in batches of bounded size."""

    def __init__(self, branches: bool) -> None:
        self.names = ["bytes", "sha", "text", "id", "same", "n"] + ["branch"] * branches
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, text: bytes, own: list, branch: bytes | None, with_text: bool) -> None:
        self.rows.append((len(text), own[3], text if with_text else None,
                          None if own[0] == NO_ID else own[0], own[1], own[2], branch))
        self.size += (len(text) if with_text else 0) + 128

    def full(self) -> bool:
        return self.size >= BATCH_BYTES

    def take(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        cols = list(zip(*self.rows)) if self.rows else [()] * 7
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)][:len(self.names)], names=self.names)


def _combined(rows: DataFrame, held: int) -> DataFrame:
    """Terminals of the tries of the scan's tasks; rows has id, sha, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), _Rows(False)

        def flush() -> Iterator[pa.RecordBatch]:
            for text, own in trie.terminals():
                out.add(text, own, None, True)
                if out.full():
                    yield out.take()

        for batch in batches:
            for doc, sha, text in zip(*(c.to_pylist() for c in batch.columns)):
                trie.insert(text, [NO_ID if doc is None else doc, 1, 1, sha])
                if trie.size >= held:
                    yield from flush()
                    trie = Trie()
        yield from flush()
        yield out.take()

    return rows.mapInArrow(run, _TERMINALS)


def _resolved(terminals: DataFrame, held: int) -> DataFrame:
    """One round of the partitions' tries.  Rows without a branch are resolved
    (and need no text any more), the others are spilled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(), _Rows(True)
        for batch in batches:
            for _, sha, text, doc, same, n in zip(*(c.to_pylist() for c in batch.columns)):
                own = [NO_ID if doc is None else doc, same, n, sha]
                past = trie.insert(text, own)
                if past is not None:
                    out.add(text, own, past.spilled, True)
                while trie.size > held and (cut := trie.spill()):
                    before, branch = cut
                    name = before + branch.label[:1]
                    for gone, last in trie.terminals(branch, before):
                        out.add(gone, last, name, True)
                        if out.full():
                            yield out.take()
                if out.full():
                    yield out.take()
        for text, own in trie.terminals():
            out.add(text, own, None, False)
            if out.full():
                yield out.take()
        yield out.take()

    return terminals.select("bytes", "sha", "text", "id", "same", "n").mapInArrow(
        run, _TERMINALS + ", branch binary")


def normal(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _groups(rows: DataFrame, total: int, held: int, partition: int) -> DataFrame:
    """bytes, sha, id, same, n of each distinct text."""
    count = min(MOST_PARTITIONS, max(1, math.ceil(total / partition)))
    terminals = _combined(rows, held).repartition(count, "bytes", "sha")
    done = None
    while True:
        found = saved(_resolved(terminals, held), "tries")
        own = found.where("branch IS NULL").select("bytes", "sha", "id", "same", "n")
        done = own if done is None else done.unionAll(own)
        left = found.where("branch IS NOT NULL")
        branches = left.select("branch").distinct().count()
        if not branches:
            return done
        terminals = left.repartition(min(MOST_PARTITIONS, branches), "branch")


def owners(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held: int = HELD,
           partition: int = PARTITION) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (of the normalised
    text): one row for each row of docs."""
    def scan() -> DataFrame:
        own = docs.select(F.col(id_col).cast("long").alias("id"), normal(F.col(text)).alias("text"))
        return own.select("id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
                          F.col("text").cast("binary").alias("text"))

    rows = saved(scan().select("id", "sha", F.octet_length("text").cast("long").alias("bytes"),
                               F.monotonically_increasing_id().alias("row")), "digests")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    groups = saved(_groups(scan(), total, held, partition).toDF("bytes", "sha", "keep_id", "same", "n"), "groups")
    out = rows.join(groups, ["bytes", "sha"], "left")
    first = F.col("id").eqNullSafe(F.col("keep_id"))
    if not groups.where("same > 1").isEmpty():      # several rows of the smallest id: the first of them
        ties = out.where(first & (F.col("same") > 1)).groupBy("bytes", "sha").agg(F.min("row").alias("first"))
        out = out.join(ties, ["bytes", "sha"], "left")
        first = first & F.coalesce(F.col("row") == F.col("first"), F.lit(True))
    return out.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"),
                      first.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with its columns as they came."""
    name, digest = fresh(docs, "_id", "_sha")
    keep = owners(docs, id_col, text).where("kept").select(
        F.col("doc_id").alias(name), F.col("text_sha256").alias(digest))
    sha = F.sha2(normal(docs[text]).cast("binary"), 256)
    marked = docs.withColumn(digest, sha).withColumn(name, F.col(id_col).cast("long"))
    mine, other = marked.alias("l"), keep.alias("r")
    on = [F.col(f"l.{name}").eqNullSafe(F.col(f"r.{name}")), F.col(f"l.{digest}") == F.col(f"r.{digest}")]
    return mine.join(other, on, "left_semi").dropDuplicates([name, digest]).select(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return owners(docs)


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (SELECT t, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""

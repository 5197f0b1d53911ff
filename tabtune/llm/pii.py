"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds to them.

Base spans come from four patterns with checks.  The model is trained on
distinct windows labelled with base spans (at most ``limit`` with a span and
half as many without, chosen by hash, so that copies count once); it reads overlapping windows on a fixed grid
of each text.  Every kind of span has a digit or an @, so windows without
either cannot hold one and are not read.  The windows' spans are reconciled
over the whole text: spans of one kind that overlap are joined, base spans
stay as they are, and model spans that do not touch one are added, surest
first.

Defined results: a null text is empty and has no spans; rows that share an id
are searched one by one; null ids stay null; an empty table gives none; all
columns are kept by ``mask``, and only id and text are read by ``find``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtune.llm import tagger as T
from tabtune.llm import words as W
from tabtune.llm.frames import saved

KINDS = ("email", "ip", "card", "phone")
#: A match begins at the first digit of a run: later ones fail if it does.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TRIGGER = np.zeros(256, dtype=bool)
TRIGGER[list(b"0123456789@")] = True

WINDOW, STRIDE = 48, 24
#: Characters the model knows: printable ASCII, newline, anything else, none.
CHARS = 98
TAGS = 1 + 2 * len(KINDS)
SURE = 0.98
BATCH = 256

Span = tuple[int, int, int]        # start, end, kind


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part ends at its @, so each @ is tried once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, by start and kind."""
    out: list[Span] = [(a, b, 0) for a, b in _emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append((*m.span(), 1))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), 2))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= x <= "9" for x in m[0]) <= 15:
            out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def with_triggers(column: pa.Array) -> np.ndarray:
    """Rows of a text column that hold a digit or an @."""
    offs, data = W._buffer(column)
    out = np.zeros(len(column), dtype=bool)
    for at in range(int(offs[0]), int(offs[-1]), W.PART_BYTES):
        found = at + np.flatnonzero(TRIGGER[data[at:min(at + W.PART_BYTES, int(offs[-1]))]])
        out[np.searchsorted(offs, found, side="right") - 1] = True
    return np.flatnonzero(out)


def encode(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.where((code >= 32) & (code < 127), code - 32, 96)
    return np.where(code == 10, 95, out).astype(np.uint8)


def windows(chars: np.ndarray) -> np.ndarray:
    """Starts of the grid's windows that hold a digit or an @."""
    digit = ((chars >= 16) & (chars <= 25)) | (chars == 32)
    cell = np.unique(np.flatnonzero(digit) // STRIDE)
    return np.unique(np.concatenate([cell, np.maximum(cell - 1, 0)])) * STRIDE


def cut(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    padded = np.concatenate([chars, np.full(WINDOW, 97, dtype=np.uint8)])
    return padded[starts[:, None] + np.arange(WINDOW)]


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    """Begin and inside tags of a text; of overlapping spans the first counts."""
    out = np.zeros(length + WINDOW, dtype=np.uint8)
    for start, end, kind in spans:
        if not out[start:end].any():
            out[start:end] = 2 + 2 * kind
            out[start] = 1 + 2 * kind
    return out


def training_windows(docs: DataFrame, text: str, limit: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tags of a bounded sample of distinct labelled windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chars, tags = [], []
            for i in with_triggers(batch.column(0)):
                content = batch.column(0)[int(i)].as_py()
                own = encode(content)
                starts = windows(own)
                every = tags_of(len(own), base_spans(content))
                chars += [x.tobytes() for x in cut(own, starts)]
                tags += [every[s:s + WINDOW].tobytes() for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array(chars, pa.binary()), pa.array(tags, pa.binary())],
                                             names=["x", "y"])

    rows = docs.select(text).mapInArrow(run, "x binary, y binary").dropDuplicates(["x", "y"])
    rows = saved(rows.select("x", "y", F.xxhash64(F.lit(seed), "x").alias("o"),
                             F.hex("y").rlike("[1-9]").alias("has")), "pii-windows")
    taken = [r for has, n in ((True, limit), (False, limit // 2))
             for r in rows.where(F.col("has") == has).orderBy("o", "x", "y").limit(n).collect()]
    if not taken:
        return np.zeros((0, WINDOW), np.uint8), np.zeros((0, WINDOW), np.uint8)
    return tuple(np.stack([np.frombuffer(r[i], dtype=np.uint8) for r in taken]) for i in (0, 1))


def train(docs: DataFrame, text: str = "text", limit: int = 1200, epochs: int = 8, seed: int = 42) -> T.Params | None:
    chars, tags = training_windows(docs, text, limit, seed)
    if not tags.any():
        return None
    return T.fit(T.create(CHARS, TAGS, seed), chars.astype(np.int64), tags.astype(np.int64), epochs, seed=seed)


def decoded(model: T.Params, chars: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
    """Of each window the spans (start, end, kind, sureness)."""
    e, _ = T.emissions(model, chars.astype(np.int64))
    tags, sure = T.viterbi(model, e), T.marginals(model, e)[3]
    out: list[list] = [[] for _ in chars]
    for w in np.flatnonzero(tags.any(axis=1)):
        row, t = tags[w], 0
        while t < WINDOW:
            if not row[t]:
                t += 1
                continue
            kind, start = (row[t] - 1) // 2, t
            t += 1
            while t < WINDOW and row[t] == 2 + 2 * kind:
                t += 1
            out[w].append((start, t, int(kind), float(min(sure[x, w, row[x]] for x in range(start, t)))))
    return out


def reconciled(text: str, base: list[Span], found: list[tuple[int, int, int, float]]) -> list[Span]:
    """Model spans that stay, given all spans of all windows of a text."""
    joined: list[list] = []
    for start, end, kind, sure in sorted(found, key=lambda s: (s[2], s[0], s[1])):
        if joined and joined[-1][2] == kind and start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
            joined[-1][3] = max(joined[-1][3], sure)
        else:
            joined.append([start, end, kind, sure])
    taken = [(a, b) for a, b, _ in base]
    out = []
    for start, end, kind, sure in sorted(joined, key=lambda s: (-s[3], s[0], s[2])):
        part = text[start:end]
        full = "@" in part.strip("@") if kind == 0 else sum("0" <= x <= "9" for x in part) >= (4, 9, 9)[kind - 1]
        if sure >= SURE and full and all(end <= a or start >= b for a, b in taken):
            taken.append((start, end))
            out.append((start, end, kind))
    return out


def search(texts: list[str], model: T.Params | None) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text."""
    base = [base_spans(t) for t in texts]
    found: list[list] = [[] for _ in texts]
    held: list[tuple[int, int]] = []
    chars: list[np.ndarray] = []

    def decode() -> None:
        if chars:
            for (i, start), spans in zip(held, decoded(model, np.stack(chars))):
                found[i] += [(start + a, start + b, k, s) for a, b, k, s in spans]
        held.clear()
        chars.clear()

    for i, t in enumerate(texts if model is not None else []):
        own = encode(t)
        starts = windows(own)
        for at in range(0, len(starts), BATCH):
            some = starts[at:at + BATCH]
            chars.extend(cut(own, some))
            held.extend((i, int(s)) for s in some)
            if len(chars) >= BATCH:
                decode()
    decode()
    return [(b, reconciled(t, b, f)) for t, b, f in zip(texts, base, found)]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2])))


def find(docs: DataFrame, model: T.Params | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_sha256, and all spans as a string."""
    counts = [f"n_{k}" for k in KINDS]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros((len(KINDS), batch.num_rows), dtype=np.int64)
            sha, spans = [nothing] * batch.num_rows, [""] * batch.num_rows
            rows = with_triggers(batch.column(1))
            for at in range(0, len(rows), 64):
                some = [int(i) for i in rows[at:at + 64]]
                for i, (base, added) in zip(some, search([batch.column(1)[i].as_py() for i in some], model)):
                    for _, _, kind in base:
                        n[kind, i] += 1
                    sha[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    spans[i] = _joined(base + added)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, n), pa.array(sha), pa.array(spans)],
                                             names=["doc_id", *counts, "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text).mapInArrow(
        run, "doc_id bigint, " + ", ".join(f"{c} bigint" for c in counts) + ", base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans at once."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], s[2])):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: T.Params | None, text: str = "text") -> DataFrame:
    """``docs`` with the spans in its text replaced."""
    index = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(index)
            rows = with_triggers(column)
            if len(rows):
                texts = column.to_pylist()
                for at in range(0, len(rows), 64):
                    some = [int(i) for i in rows[at:at + 64]]
                    for i, (base, added) in zip(some, search([texts[i] for i in some], model)):
                        texts[i] = masked(texts[i], base + added)
                column = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays(
                [column if i == index else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame) -> DataFrame:
    return find(docs, train(docs))

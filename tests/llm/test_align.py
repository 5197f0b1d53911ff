import collections
import hashlib
import json
import random

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabtune.llm import align, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, row string, pairs int, n_a string, best string"


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(align.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.PIECES)


def tokens(tools, text):
    """Both sides' (id, bytes) of a text; none where they do not spell it out."""
    a, b = tools
    if not text:
        return [], []
    table = align.byte_of()
    left = [(i, bytes(table[c] for c in a.id_to_token(i)))
            for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        right.append((i, bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return [], []
    return left, right


def cut(side):
    at, out = 0, []
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(tools, texts):
    """Group by group, link by link."""
    docs = []
    for text in texts:
        a, b = (cut(side) for side in tokens(tools, text))
        groups, at = [], 0
        for end in sorted({e for *_, e in a} & {e for *_, e in b}):
            groups.append(([i for i, s, e in a if at <= s and e <= end], [i for i, s, e in b if at <= s and e <= end]))
            at = end
        docs.append((a, b, groups, [(x, y) for g in groups for x in g[0] for y in g[1]]))
    count = collections.Counter(p for *_, links in docs for p in set(links))
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for a, b, groups, links in docs:
        said = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links),
                    sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(tools, rows, got):
    want = collections.Counter((r[0], *x) for r, x in zip(rows, brute(tools, [r[1] for r in rows])))
    assert collections.Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in got) == want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", " ", "  \n\t ", "a", "<|endoftext|>", "<s> </s> <unk>", "x<|endoftext|>y <0x41>", "▁", "a ▁b",
             "naïve café 字漢字 日本語のテキスト", "🙂🙃 family 👩‍👩‍👧", "\u0000nul", "﻿bom", "é combining", "\r\n\r\n",
             " " * 300, "a" * 500, "word " * 3000, "don't we'll 12345 3.14159 --- ===="]
    for _ in range(40):
        texts.append("".join(rng.choice(["the ", "ing", " ", "\n", "é", "字", "Ωμ", "42", ".", "qz", "  ", " "])
                             for _ in range(rng.randint(1, 120))))
    texts += ["the same copied text"] * 20
    out = [(i, t, "r", 1, "n", "b") for i, t in enumerate(texts)]
    return out + [out[20], (None, texts[25], "r", 1, "n", "b"), (3, "another text of id 3", "r", 1, "n", "b")]


@pytest.mark.parametrize("hot", [align.HOT, 20, 0])
def test_align_against_brute_force(spark, tools, rows, hot):
    """Also with most or all counts joined by a shuffle."""
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    same(tools, rows, align.align(docs, hot=hot).collect())


def test_registered_query_against_brute_force(spark, tools):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(tools, docs, queries.QUERIES["op11_merge_asof_alignment"](spark, SF).collect())


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spans(spark, tools, rows):
    """Overlaps are all pairs that share a byte."""
    got = align.spans(spark.createDataFrame(rows[:40], SCHEMA).coalesce(1)).collect()
    for r, (_, text, *_) in zip(got, rows):
        a, b = (cut(side) for side in tokens(tools, text))
        assert list(zip(r.a_ids, r.a_ends)) == [(i, e) for i, _, e in a]
        assert list(zip(r.b_ids, r.b_ends)) == [(i, e) for i, _, e in b]
        if len(a) < 600:
            assert {tuple(x) for x in r.overlaps} == {
                (i, j) for i, (_, s, e) in enumerate(a) for j, (_, t, f) in enumerate(b) if s < f and t < e}
        ends = {e for *_, e in a} & {e for *_, e in b}
        assert [a[x.a][2] for x in r.groups] == [b[x.b][2] for x in r.groups] == sorted(ends)


def test_long_groups_and_both_engines(monkeypatch, tools, rows):
    files = [open(p, "rb").read() for p in (align.BYTE_BPE, align.PIECES)]
    texts = [r[1] for r in rows]
    whole = align.Aligner(*files)
    assert whole.a.ranked
    want = whole.rows(texts)
    monkeypatch.setattr(align, "LARGE", 2)      # nearly every group counts as a long one
    other = json.loads(files[0])
    other["model"]["merges"].append(other["model"]["merges"][-1])      # not a list of ranks any more
    plain = align.Aligner(json.dumps(other).encode(), files[1])
    assert not plain.a.ranked
    got = plain.rows(texts)
    assert all(got[k].equals(want[k]) for k in want)

import random

import numpy as np
import pytest

from tabtune.llm import substrings

SCHEMA = "doc_id bigint, text string"


def numbered(name, n, first=0):
    return [f"{name}{i}" for i in range(first, first + n)]


def run(spark, docs):
    rows = [(i, " ".join(w)) for i, w in docs]
    return {r.doc_id: r for r in substrings.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()}


def stands(docs, row):
    """Factors do not overlap and stand at their places."""
    words, end = dict(docs)[row.doc_id], 0
    for f in row.factors:
        assert f.start >= end and f.words >= 50 and f.ref < row.doc_id
        end = f.start + f.words
        assert words[f.start:end] == dict(docs)[f.ref][f.src:f.src + f.words]


def test_factors_stand_at_one_place(spark):
    p, a, b, c = (numbered(x, n) for x, n in (("p", 50), ("a", 60), ("b", 60), ("c", 60)))
    docs = [(1, p + ["x", "y", "z"] + p[1:] + ["q50"]), (2, p + ["q50"]), (3, a + b), (4, b + c), (5, a + b + c)]
    got = run(spark, docs)
    for row in got.values():
        stands(docs, row)
    assert [tuple(f) for f in got[2].factors] == [(0, 50, 1, 0)] and got[2].n_removed == 51
    assert [tuple(f) for f in got[5].factors] == [(0, 120, 3, 0), (120, 60, 4, 60)] and got[5].n_removed == 180
    assert [tuple(f) for f in got[4].factors] == [(0, 60, 3, 60)] and got[4].kept_text == " ".join(c)


def test_random_texts_against_windows(spark):
    rng = random.Random(6)
    pieces = [numbered(f"k{i}_", rng.randint(20, 90)) for i in range(12)]
    docs = [(i, [w for _ in range(rng.randint(1, 5)) for w in rng.choice(pieces)]) for i in range(40)]
    got = run(spark, docs)
    seen = {}
    for i, words in docs:
        for at in range(len(words) - 49):
            seen.setdefault(tuple(words[at:at + 50]), i)
    for i, words in docs:
        gone = np.zeros(len(words), dtype=bool)
        for at in range(len(words) - 49):
            if seen[tuple(words[at:at + 50])] < i:
                gone[at:at + 50] = True
        stands(docs, got[i])
        assert got[i].kept_text == " ".join(w for w, x in zip(words, gone) if not x)
        assert all(gone[f.start:f.start + f.words].all() for f in got[i].factors)


def test_many_equal_rows(spark):
    text = " ".join(numbered("w", 200))
    rows = [(1, text)] * 30 + [(2, text + " end")] * 30
    got = substrings.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.doc_id, r.n_removed, r.kept_text == text) for r in got} == {(1, 0, True), (2, 200, False)}
    assert len(got) == 60 and {r.kept_text for r in got if r.doc_id == 2} == {"end"}


@pytest.mark.parametrize("at, ref, src, want", [
    ([], [], [], []),
    ([0, 1, 2], [1, 1, 1], [5, 6, 7], [(0, 52, 1, 5)]),
    ([0, 1, 2], [1, 1, 2], [5, 6, 7], [(0, 51, 1, 5)]),
    ([0, 60, 61], [1, 2, 2], [0, 3, 4], [(0, 50, 1, 0), (60, 51, 2, 3)]),
    (list(range(0, 80)), [1] * 10 + [2] * 70, [*range(10), *range(20, 90)], [(0, 59, 1, 0), (59, 70, 2, 69)]),
])
def test_parse(at, ref, src, want):
    got = substrings.parse(*(np.array(x, dtype=np.int64) for x in (at, ref, src)), 50)
    assert [tuple(f.values()) for f in got] == want

import collections
import math
import random

import numpy as np
import pytest

from tabtune.llm import negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, score string, x int, g string, rank int, found string"


def brute(rows, anchors, k=5, m=3, scale=256):
    """Every anchor against every row, in Python's integers."""
    good = [(i, lab, [math.floor(v * scale) for v in e]) for i, e, lab in rows
            if i is not None and lab is not None and e and all(v is not None and math.isfinite(v) for v in e)]
    out = collections.Counter()
    for i, lab, e in [x for x in good if x[0] in anchors]:
        scored = [(sum(a * b for a, b in zip(e, f)), j, other) for j, other, f in good if j != i]
        scored = sorted(((max(-2 ** 63, min(2 ** 63 - 1, s)), j, o) for s, j, o in scored), key=lambda x: (-x[0], x[1]))
        for ps, j, _ in [x for x in scored if x[2] == lab][:k]:
            inside = [x for x in scored if x[2] != lab and 50 * ps <= 100 * x[0] <= 95 * ps][:m]
            out += collections.Counter((i, j, r + 1, c, ps, s) for r, (s, c, _) in enumerate(inside))
    return out


def bag(df):
    return collections.Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score,
                                r.negative_score) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "g", 2, "f") for r in rows], SCHEMA).repartition(3)


def clustered(rng, n, dims, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("tree, block", [(negatives.TREE, negatives.BLOCK), (3, 40), (1, 1 << 16)])
def test_against_brute_force(spark, monkeypatch, tree, block):
    """Ties, repeats, nulls, short vectors and a hot label, in one block or many."""
    monkeypatch.setattr(negatives, "CHUNK", 64)
    rng = random.Random(4)
    rows = clustered(rng, 260, 6, 0.3)
    rows = [(i, e, 0 if i % 3 == 0 else lab) for i, e, lab in rows]
    rows += [(i + 300, rows[i][1], rows[i][2]) for i in range(40)] + rows[:4]     # equal vectors, repeated rows
    rows += [(400, None, 1), (401, [], 1), (402, [1.0, None], 1), (403, [float("nan")], 1), (404, [float("inf")], 0),
             (405, [1.0, 2.0], None), (None, [1.0], 1), (406, [0.5, 0.25], 1), (407, [0.0] * 6, 2), (408, [-1.0] * 9, 2)]
    docs = table(spark, rows)
    anchors = {i for i in range(0, 410, 7)} | {400, 401, 402, 403, 404, 405, 406, 407, 408}
    got = negatives.mine(docs, docs.where(docs.vec_id.isin(*anchors)), "vec_id", "embedding", "label",
                         tree=tree, block=block)
    want = brute(rows, anchors)
    assert len(want) > 100 and bag(got) == want


def test_huge_values(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1.0, -2.0, 3.5]) * 10.0 ** rng.choice([0, 3, 9, 17]) for _ in range(3)], i % 2)
            for i in range(60)] + [(60, [1e18, 2e18], 0), (61, [2 / 64, -1 / 64], 0)]
    anchors = set(range(0, 62, 5)) | {61}
    docs = table(spark, rows)
    got = negatives.mine(docs, docs.where(docs.vec_id.isin(*anchors)), "vec_id", "embedding", "label")
    assert bag(got) == brute(rows, anchors)


def test_empty_tables(spark):
    docs = table(spark, clustered(random.Random(1), 20, 3, 0.1))
    none = docs.where("vec_id < 0")
    for a, b in ((docs, none), (none, docs), (none, none)):
        assert negatives.mine(a, b, "vec_id", "embedding", "label").count() == 0


def test_spanning_tree():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(size=(40, 5)) * 256)
    order, parent, edge = negatives.spanning_tree(rows)
    assert sorted(order) == list(range(40)) and parent[0] == -1 and all(p < i for i, p in enumerate(parent))
    for i in range(1, 40):
        assert edge[i] == pytest.approx(np.linalg.norm(rows[order[i]] - rows[order[parent[i]]]))
    far = np.linalg.norm(rows[:, None] - rows[None], axis=2)
    total, inside = 0.0, {0}
    while len(inside) < 40:      # smallest edge that leaves the tree
        i, j = min(((i, j) for i in inside for j in set(range(40)) - inside), key=lambda e: far[e])
        total += far[i, j]
        inside.add(j)
    assert edge.sum() == pytest.approx(total)


def test_bounds_hold_and_spare_work():
    """Of close anchors in a tree, few candidates are rescored."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16)) * 256
    cands = np.floor(np.concatenate([c + rng.normal(size=(200, 16)) * 8 for c in centres]))
    rows = np.floor(centres[0] + rng.normal(size=(30, 16)) * 4)
    order, parent, edge = negatives.spanning_tree(rows)
    scores = negatives.Scores(rows[order], parent, edge, cands)
    true = rows[order] @ cands.T
    for i in range(30):
        low, high = scores.bound(i)
        assert (low <= true[i]).all() and (true[i] <= high).all()
        best = np.sort(true[i])[-5]
        scores.exact(i, np.flatnonzero(high >= best))
    assert scores.rescored < 0.4 * 30 * len(cands)

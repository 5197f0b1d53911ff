import random
import re

import numpy as np
import pyarrow as pa

from tabtune.llm import neardup, packing, pii, tagger, topk
from tabtune.llm import words as W
from tabtune.llm.quality import measure_column
from tabtune.llm.substrings import parse

TEXTS = [None, "", " \n\t", "a", "a b c a b c a b c", "x\ny\nx\n\nx y", "é ñ|# %% ü\x0bv", "w" * 50,
         "tail word ", "ends", "starts"]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_parts_give_the_words(monkeypatch):
    for size in (1 << 20, 16):          # whole column at once, and tiny blocks
        monkeypatch.setattr(W, "PART_BYTES", size)
        got = [[] for _ in TEXTS]
        seen = {}
        for part in W.parts(pa.array(TEXTS)):
            for d, s, e, h in zip(part.doc, part.start, part.end, part.hash):
                word = part.data[s:e].tobytes().decode()
                got[part.row + d].append(word)
                assert seen.setdefault(word, h) == h
        assert got == [words(t) for t in TEXTS]
        assert len(set(seen.values())) == len(seen)


def test_measures_against_brute_force():
    out = measure_column(pa.array(TEXTS * 3))
    for i, t in enumerate(TEXTS * 3):
        w = words(t)
        grams = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
        covered = {j + x for j, g in enumerate(grams) if grams.count(g) > 1 for x in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""),
                len(lines) - len(set(lines)), len(covered), len(lines)]
        assert [int(x[i]) for x in out] == want


def test_shingle_sets():
    texts = ["a b c d e f a b c d e", "A B C D", "a b c d", None, "a b c d e"]
    sets = [value[offs[i]:offs[i + 1]] for part, offs, value in neardup.shingle_sets(pa.array(texts))
            for i in range(part.rows)]
    assert [len(s) for s in sets] == [6, 1, 1, 0, 1]
    assert sets[1] == sets[2] and sets[4][0] in sets[0] and sets[1][0] not in sets[0]


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(30):
        sizes = sorted(rng.sample(range(1, 60), rng.randint(1, 9)))
        counts = [rng.randint(1, 9) for _ in sizes]
        k = rng.randint(1, 4)

        def cost(tops):
            return sum(c * (min(t for t in tops if t >= s) - s) for s, c in zip(sizes, counts))
        from itertools import combinations
        best = min(cost([*x, sizes[-1]]) for m in range(min(k, len(sizes)))
                   for x in combinations(sizes[:-1], m))
        tops = packing.boundaries(np.array(sizes), np.array(counts), k)
        assert len(tops) <= k and tops[-1] == sizes[-1] and cost(tops) == best


def test_best_and_accumulate():
    rng = np.random.default_rng(2)
    rows = rng.integers(-2, 3, (40, 6)).astype(float)
    q = rng.integers(-2, 3, (7, 6)).astype(float)
    scores = topk.accumulate(topk.postings(rows), 40, q)
    assert (scores == rows @ q.T).all()
    ids = rng.permutation(40)
    for j in range(7):
        found, score = topk.best(scores[:, j], ids, 5, 10)
        want = sorted(((-s, i) for s, i in zip(scores[:, j], ids) if i != 5))[:10]
        assert [(-s, i) for s, i in zip(score, found)] == want


def test_factors():
    at, ref, src = np.array([3, 4, 60, 120, 180]), np.array([1, 1, 2, 1, 1]), np.array([0, 1, 0, 9, 4])
    assert parse(at, ref, src, 50) == [
        {"start": 3, "words": 51, "ref": 1, "src": 0}, {"start": 60, "words": 50, "ref": 2, "src": 0},
        {"start": 120, "words": 50, "ref": 1, "src": 9}, {"start": 180, "words": 50, "ref": 1, "src": 4}]


def brute_spans(text):
    def drop(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return (kind == 1 and any(int(x) > 255 for x in m.split(".")) or kind == 3 and not 9 <= len(digits) <= 15
                or kind == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)))
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    return sorted([(*m.span(), k) for k, p in enumerate(patterns) for m in re.finditer(p, text)
                   if not drop(k, m[0])], key=lambda s: (s[0], s[2]))


def test_base_spans_against_plain_patterns():
    rng = random.Random(3)
    fixed = ["a@b.c@d.e x@y a..b@c-d.e.f@", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111-1111 1111 +1 (20) 345.678-9",
             "@@a@b.co", "é@x.y ü1.1.1.1"]
    alphabet = "a1@. +-(4é"
    for t in fixed + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]:
        assert pii.base_spans(t) == brute_spans(t), t


def test_tagger_gradients_and_learning():
    rng = np.random.default_rng(0)
    p = tagger.create(5, 3, 1, embed=3, hidden=2)
    x, y = rng.integers(0, 5, (4, 6)), rng.integers(0, 3, (4, 6))
    _, g = tagger.gradients(p, x, y)
    for k in p:
        at = tuple(rng.integers(0, s) for s in p[k].shape)
        eps, keep = 1e-5, p[k][at]
        p[k][at] = keep + eps
        up, _ = tagger.gradients(p, x, y)
        p[k][at] = keep - eps
        down, _ = tagger.gradients(p, x, y)
        p[k][at] = keep
        assert abs((up - down) / (2 * eps) - g[k][at]) < 1e-5, k


def test_trained_tagger_finds_held_out_spans():
    rng = random.Random(5)

    def made(n):
        rows = []
        for _ in range(n):
            kind = rng.choice(["{a}@{a}.com", "{d}.{d}.{d}.{d}", "", "{d}{d}{d}"])
            item = re.sub(r"\{(.)\}", lambda m: ("".join(rng.choices("abcdefg", k=4)) if m[1] == "a"
                                                 else str(rng.randint(10, 255))), kind)
            left = "".join(rng.choices("hijk lmn ", k=rng.randint(3, 12)))
            rows.append(f"{left} {item} " + "".join(rng.choices("hijk lmn ", k=8)))
        return rows
    train, test = made(500), made(60)

    def xy(rows):
        return (np.stack([pii.cut(pii.encode(t), np.array([0]))[0] for t in rows]).astype(int),
                np.stack([pii.tags_of(len(t), pii.base_spans(t))[:pii.WINDOW] for t in rows]).astype(int))
    model = tagger.fit(tagger.create(pii.CHARS, pii.TAGS, 1), *xy(train), epochs=12)
    x, y = xy(test)
    got = tagger.viterbi(model, tagger.emissions(model, x)[0])
    assert (got == y).mean() > 0.99
    # What the model adds stays clear of base spans, and base spans stay.
    for base, added in pii.search(test, model):
        assert all(e <= a or s >= b for s, e, _ in added for a, b, _ in base)


def test_reconciled_joins_windows_and_keeps_base():
    text = "x" * 10 + "1.2.3.4" + "y" * 10 + "9.8.7.6"
    base = [(10, 17, 1)]
    found = [(8, 17, 1, 0.99), (27, 31, 1, 0.99), (30, 34, 1, 0.99), (0, 5, 2, 0.999)]
    assert pii.reconciled(text, base, found) == [(27, 34, 1)]
    assert pii.masked(text, base + [(27, 34, 1)]) == "x" * 10 + "<IP>" + "y" * 10 + "<IP>"

import collections
import hashlib
import random
import re

import pytest

from tabtune.llm import exact

SCHEMA = "doc_id bigint, text string, same int, branch string, sha string, keep_id bigint"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    """Per row: keep_id, group size and digest; and the groups."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    out = []
    for r in rows:
        ids = groups[norm(r[1])]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), hashlib.sha256(norm(r[1]).encode()).hexdigest()))
    return collections.Counter(out), groups


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    stem = "".join(rng.choice("abc \n") for _ in range(500))
    texts = [None, "", " ", "\t\n ", "a", "a ", " a", "ab", "abc", "é", "é e", "x" * 40000, "x" * 40000 + "y"]
    texts += [stem[:rng.randint(0, 500)] + rng.choice(["", "q", " \r"]) for _ in range(150)]
    texts += ["hot copy\n of many"] * 200 + ["hot  copy of\tmany"] * 100
    rng.shuffle(texts)
    out = [(i, t, 1, "b", "s", 7) for i, t in enumerate(texts)]
    return out + [out[5], out[5], (None, "no id", 1, "b", "s", 7), (None, "no id", 1, "b", "s", 7),
                  (None, "hot copy of many", 1, "b", "s", 7)]


def check(rows, got):
    want, groups = brute(rows)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert kept == {hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.mark.parametrize("held, partition", [(exact.HELD, exact.PARTITION), (300, 4000), (1, 1 << 30), (5000, 1 << 30)])
def test_owners_against_brute_force(spark, rows, held, partition):
    """Also where every trie spills, down to one text a round."""
    some = rows if held > 1 else rows[:60] + rows[-6:]
    docs = spark.createDataFrame(some, SCHEMA).repartition(3)
    check(some, exact.owners(docs, held=held, partition=partition).collect())


def test_empty_table_and_repeated_ids(spark):
    assert exact.owners(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a  b", 1, "", "", 0), (1, "other", 1, "", "", 0), (2, "a b", 1, "", "", 0), (1, "a b", 1, "", "", 0)]
    check(rows, exact.owners(spark.createDataFrame(rows, SCHEMA)).collect())


def test_deduplicate_keeps_columns_and_one_row_each(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = exact.deduplicate(docs)
    assert out.columns == docs.columns
    got = collections.Counter(norm(r.text) for r in out.collect())
    assert got == {norm(r[1]): 1 for r in rows}


def test_trie_holds_what_a_dictionary_holds():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    trie, want = exact.Trie(), {}
    for i, t in enumerate(texts):
        assert trie.insert(t, [i, 1, 1, b""]) is None
        first, n = want.get(t, (i, 0))
        want[t] = (first, n + 1)
    assert {t: (own[0], own[2]) for t, own in trie.terminals()} == want


@pytest.mark.parametrize("seed", range(5))
def test_spilled_texts_keep_one_name(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    trie, names, left = exact.Trie(), collections.defaultdict(set), collections.Counter()
    for t in texts:
        past = trie.insert(t, [0, 1, 1, b""])
        if past is not None:
            names[t].add(past.spilled)
            left[t] += 1
        while trie.size > 60 and (cut := trie.spill()):
            for gone, own in trie.terminals(cut[1], cut[0]):
                names[gone].add(cut[0] + cut[1].label[:1])
                left[gone] += own[2]
    stay = {t: own[2] for t, own in trie.terminals()}
    assert stay and not set(stay) & set(names) and all(len(x) == 1 for x in names.values())
    assert left + collections.Counter(stay) == collections.Counter(texts)


def test_agree():
    rng = random.Random(2)
    for _ in range(2000):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 5))) + b"c" * rng.randint(0, 60)
        b = a[:rng.randint(0, len(a))] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 5)))
        want = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert exact.agree(a, b"??" + b, 2) == want

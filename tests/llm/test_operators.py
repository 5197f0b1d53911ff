import base64
import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabtune.llm import (classifier, components, mixing, neardup, packing, pii, quality, queries, sharding,
                         substrings, topk, warc)
from tabtune.llm.frames import scratch

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, c string, n_words int, kept string, word string"
LONG = " ".join(f"w{i}" for i in range(30000))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, ties, repeats, copies; further columns."""
    rng = random.Random(7)
    vocab = [f"v{i}" for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))
    passage = prose(70)
    texts = [None, "", "  \n", "one two", "one two", "ONE two", LONG, LONG + " end", passage]
    for _ in range(4):
        base = prose(120)
        texts += [base, base]
        for _ in range(6):
            w = base.split()
            for _ in range(rng.randint(1, 12)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    texts += [prose(rng.randint(5, 60)) + " " + passage + "\n" + prose(rng.randint(5, 60)) for _ in range(10)]
    texts += ["mail a.b@c.de or 10.0.0.1, 4111 1111 1111 1111 and +1 (212) 555-0100."] * 2
    rng.shuffle(texts)
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None]), len(t or ""), "x", 1, "k", "w")
           for i, t in enumerate(texts)]
    return out + [out[3], (None, prose(60), "en", "s1", 1, "x", 1, "k", "w")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def duck(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?)", [r[:4] for r in rows])
    got = con.execute(sql)
    order = sorted(range(len(got.description)), key=lambda i: got.description[i][0])
    return collections.Counter(tuple(r[i] for i in order) for r in got.fetchall())


def bag(df):
    cols = sorted(df.columns)
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


def unique(rows):
    return [r for r in dict.fromkeys(rows) if r[0] is not None]


@pytest.mark.parametrize("query, sql", [
    (quality.query, quality.ORACLE), (mixing.query, mixing.oracle()),
    (substrings.query, substrings.ORACLE), (neardup.query, neardup.ORACLE)], ids=["op1", "op2", "op3", "op5"])
def test_against_sql(spark, rows, query, sql):
    own = unique(rows)
    assert bag(query(spark.createDataFrame(own, SCHEMA).repartition(3))) == duck(own, sql)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_registered_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = con.execute(queries.ORACLE_SQL[name])
    order = sorted(range(len(got.description)), key=lambda i: got.description[i][0])
    want = collections.Counter(tuple(r[i] for i in order) for r in got.fetchall())
    assert bag(queries.QUERIES[name](spark, SF)) == want


def test_quality_keeps_rows_and_columns(docs, rows, none):
    judged, names = quality.judge(docs)
    out = judged.collect()
    assert len(out) == len(rows) and set(docs.columns) <= set(judged.columns)
    assert names["n_words"] != "n_words" and names["kept"] != "kept"
    for r in out:
        assert r[names["n_words"]] == len(words(r.text))
        assert r[names["base_failed"]] or not r[names["kept"]] is None
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.query(none).count() == 0


def test_quality_with_clashing_names(spark):
    rows = [(i, f"text {i} " * 40, "h", "a", True, 5) for i in range(6)] + [(6, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, _host string, rejected boolean, n_docs int")
    out = quality.keep_good(docs)
    assert out.columns == docs.columns and quality.judge(docs)[0].count() == 7


def test_bad_host_is_rejected_and_small_host_shrunk(spark):
    good = " ".join(f"g{i}" for i in range(80))
    rows = [(i, good if i % 10 else "short", "en", f"h{i % 6}") for i in range(600)]
    rows += [(1000 + i, good if i < 5 else "short", "en", "bad") for i in range(60)]
    rows += [(2000, good, "en", "tiny"), (2001, "short", "en", "tiny")]
    got = {r.doc_id: r for r in quality.query(
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert got[1000].host_rejected and not got[1000].kept and not got[1000].base_failed
    assert not got[2000].host_rejected and got[2000].kept and not got[2001].kept


def test_near_duplicates_repeats_and_nulls(docs, rows, none):
    out = neardup.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    assert [r for r in out if r.doc_id is None][0].kept
    assert neardup.near_duplicates(none).count() == 0
    one = neardup.keep_one(docs)
    assert one.columns == docs.columns
    texts = collections.Counter((r.doc_id, r.text) for r in one.collect())
    assert max(texts.values()) == 1


def test_keep_one_of_repeated_rows_and_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    c, d = " ".join(f"c{i}" for i in range(30)), " ".join(f"d{i}" for i in range(30))
    rows = [(1, a), (1, a), (None, a), (2, a), (3, b), (3, c), (None, d), (None, d), (None, d.upper()),
            (4, b), (5, None), (5, None), (6, ""), (None, "")]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, doc string, key int")
    out = neardup.keep_one(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    nameless = [x for x in got if x[0] is None and x[1]]
    assert len(nameless) == 1 and nameless[0][1].lower() == d
    assert {x: n for x, n in got.items() if x not in nameless} == {
        (1, a): 1, (3, b): 1, (3, c): 1, (5, None): 1, (6, ""): 1, (None, ""): 1}


def test_near_duplicates_without_chance(spark):
    """Every shared value counts: the same links as by the sketch bounds."""
    rng = random.Random(21)
    vocab = [f"v{i}" for i in range(900)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(120)]
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                w[rng.randrange(120)] = rng.choice(vocab)
            texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plain = [tuple(r) for r in neardup.near_duplicates(docs).orderBy("doc_id").collect()]
    assert plain == [tuple(r) for r in neardup.near_duplicates(docs, sigmas=None).orderBy("doc_id").collect()]

def test_near_duplicates_of_a_large_group(spark):
    """A chain of edits, a group with one hub, and a passage in many others."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(300)]
    passage = [rng.choice(vocab) for _ in range(120)]
    texts = []
    chain = list(base)
    for _ in range(60):
        chain[rng.randrange(300)] = rng.choice(vocab)
        texts.append(" ".join(chain))
        copy = list(base)
        for _ in range(rng.randint(1, 14)):
            copy[rng.randrange(300)] = rng.choice(vocab)
        texts.append(" ".join(copy))
        texts.append(" ".join([rng.choice(vocab) for _ in range(40)] + passage + [rng.choice(vocab) for _ in range(40)]))
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in neardup.query(
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    sets = [{tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in range(len(sets))}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    stars = {r.hi: r.lo for r in components.components(spark.createDataFrame(edges, "hi bigint, lo bigint")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {x: stars.get(x, x) for x in root} == root


def test_substrings_text_and_factors(docs, rows, none):
    out = substrings.deduplicate(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert len(words(r.kept_text)) == r.n_words - r.n_removed
        assert all(f.words >= 50 and f.ref < r.doc_id for f in r.factors)
    assert substrings.query(none).count() == 0


def test_mixing_whole_rows(docs, none):
    kept = mixing.mix_documents(docs)
    assert kept.columns == docs.columns and 0 < kept.count() <= mixing.EPOCHS * docs.count()
    assert mixing.query(none).count() == 0
    taken = mixing.select(mixing.with_domain(docs), ["domain", "lang", "source"], [{}, {"fr": 0}, {}],
                          fraction=(5, 1), max_epochs=3).collect()
    by = collections.Counter((r.id, r.n_tokens) for r in taken)
    assert not [r for r in taken if r.lang == "fr"]
    assert all(n % 3 == 0 for n in by.values()) and by    # shortage everywhere: all epochs in full


def test_mixed_documents_reach_the_weights(spark):
    rows = [(d * 300 + i, " ".join(["w"] * (5 + i % 7)), "en", f"s{d}") for d in range(10) for i in range(300)]
    rows += [(None, "n n n", "en", "s1"), (None, "n n n n", "en", "s1"), rows[400], rows[400]]
    docs_ = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(3)
    out = corpus_pipeline.source_mixture(spark, docs_, "").collect()
    share = collections.Counter()
    for r in out:
        share[r.source[-1]] += len(r.text.split())
    total = sum(share.values())
    for d, weight in zip("0123456789", [1, 3, 2] + [1] * 7):
        assert abs(share[d] / total - weight / 13) < 0.005
    # One row for each epoch that op2 takes of a row, repeats and null ids included.
    taken = mixing.query(docs_).collect()
    assert collections.Counter((r.doc_id, len(r.text.split()), r.source) for r in out) == \
        collections.Counter((r.doc_id, r.n_tokens, r.source) for r in taken)
    assert max(collections.Counter(r.doc_id for r in out if r.doc_id and r.doc_id != rows[400][0]).values()) == 2


def test_sharding_against_brute_force(spark, docs, rows, none):
    out = sharding.shard(docs, shards=5).collect()
    places = sorted(r.slot * 5 + r.shard for r in out)
    assert places == list(range(len(rows)))
    def crc(t):
        return zlib.crc32((t or "").encode())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in out) == \
        collections.Counter((r[0], len((r[1] or "").encode()) + 1, crc(r[1]), "rows", None) for r in rows)

    n = len(rows)
    a, b = sharding.grid(n)

    def f(i, x):
        return int(hashlib.md5(f"42:{i}:{x}".encode()).hexdigest()[:8], 16)

    def once(v):
        left, right = v % a, v // a
        for i in range(0, sharding.ROUNDS, 2):
            left = (left + f(i, right)) % a
            right = (right + f(i + 1, left)) % b
        return right * a + left
    assert sorted(map(once, range(a * b))) == list(range(a * b))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), crc(r[1])))
    want = {}
    for number, r in enumerate(order):
        v = once(number)
        while v >= n:
            v = once(v)
        want.setdefault(r[0], set()).add((v % 5, v // 5))
    assert all((r.shard, r.slot) in want[r.doc_id] for r in out)
    assert sharding.query(none).count() == 0


def test_packing(docs, rows, none):
    out = packing.pack(docs, context=64, buckets=4, batch_tokens=256).collect()
    need = collections.Counter()
    for r in rows:
        need[r[0]] += len(words(r[1]))
    got = collections.Counter()
    for r in out:
        got[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.pad_to <= 64
    assert +need == got
    batches = collections.defaultdict(list)
    for r in out:
        batches[r.bucket, r.batch].append(r.row)
    for (bucket, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots)))
        assert len(slots) * next(r.pad_to for r in out if r.bucket == bucket) <= 256
    assert packing.query(none).count() == 0


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", None, "", "é" * 3000, "<p>a</p>", "<p>a</p>", LONG]
    rows = [(i, f"http://x/{i} \r\nq" if i % 2 else None, h, "z") for i, h in enumerate(html)]
    rows += [rows[4], (None, "u", "<p>a</p>", "z"), (None, "u", "alone", "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, records string")
    seen = []
    for _ in range(2):
        path = scratch(spark, "warc-test")
        manifest = warc.write_warc(pages.repartition(3), path, shard_bytes=4000, roll_bytes=300)
        seen.append({x: open(f"{path[7:]}/{x}", "rb").read() for x in os.listdir(path[7:]) if x.endswith(".warc.gz")})
        parts = {r.name: r for r in warc.manifest_parts(spark, manifest).collect()}
        assert {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in seen[-1].items()} == {
            n: (r.bytes, r.sha256) for n, r in parts.items()}
        assert sum(r.records for r in parts.values()) == len(rows) and not os.path.exists(f"{path[7:]}/_temporary")
    assert seen[0] == seen[1] and len(seen[0]) > 3          # the same bytes, several files
    out = warc.read_warc(spark, manifest, with_payload=True).collect()
    payload = {0: b"<p>a</p>", 1: b"", 2: b"", 3: ("é" * 3000).encode(), 6: LONG.encode()}
    assert len(out) == len(rows)
    for r in out:
        if r.record_type == "response":
            assert base64.b32encode(hashlib.sha1(r.payload).digest()).decode() == r.payload_digest
            assert len(r.payload) == r.payload_bytes and r.refers_to is None
    kinds = collections.Counter((r.page_id, r.record_type, r.refers_to) for r in out)
    assert kinds == collections.Counter([
        (0, "revisit", 5), (1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "revisit", 5),
        (4, "revisit", 5), (5, "response", None), (6, "response", None), (None, "revisit", 5), (None, "response", None)])
    assert {r.page_id: r.payload for r in out if r.record_type == "response" and r.page_id in payload} == \
        {k: v for k, v in payload.items() if k not in (0, 1)}
    assert warc.query(pages.limit(0)).count() == 0


def test_warc_borders(spark):
    """Ids of any size; every shard but single ids keeps within the bytes."""
    rng = random.Random(9)
    for ids in ([-9 * 10 ** 18, 9 * 10 ** 18, None], [-2 ** 63, 2 ** 63 - 1, 0, -1, 1], list(range(-50, 300)) + [10 ** 15],
                [rng.randrange(-2 ** 63, 2 ** 63) for _ in range(200)], [7] * 50, [3]):
        size = {i: rng.randint(1, 30) for i in ids}
        sizes = spark.createDataFrame([(i, size[i]) for i in ids], "id bigint, bytes bigint")
        cuts = warc.borders(sizes, 100)
        assert cuts == sorted(set(cuts)) and all(-2 ** 63 <= c < 2 ** 63 for c in cuts)
        total, kinds = collections.Counter(), collections.defaultdict(set)
        for i in ids:
            shard = int(np.searchsorted(np.array(cuts), -2 ** 63 if i is None else i))
            total[shard] += size[i]
            kinds[shard].add(i)
        assert all(total[x] <= 100 or len(kinds[x] - {None}) == 1 for x in total)
    wide = spark.createDataFrame([(-9 * 10 ** 18, "u", "a" * 90), (9 * 10 ** 18, "u", "b" * 90), (None, "u", "c")],
                                 "page_id bigint, url string, html string")
    manifest = warc.write_warc(wide, scratch(spark, "warc-test"), shard_bytes=100)
    assert {r.page_id for r in warc.read_warc(spark, manifest).collect()} == {-9 * 10 ** 18, 9 * 10 ** 18, None}


def test_warc_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")],
                                  "page_id bigint, url string, html string")
    path = scratch(spark, "warc-test")
    out = {r.page_id: r.refers_to for r in warc.read_warc(spark, warc.write_warc(pages, path, min_bytes=3)).collect()}
    assert out == {1: None, 2: None, 3: 4, 4: None}


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.1, 5).round(1).tolist(), 1.0) for i in range(120)]
    rows += [rows[7], (200, None, 1.0), (220, [], 1.0), (240, [1.0, None], 1.0), (260, [float("nan")] * 5, 1.0),
             (None, [0.1] * 5, 1.0), (280, [1e30, 1e30, 0.0, 0.0, 0.0], 1.0),
             (300, [2 / 64, -1 / 64], 1.0), (301, [1e18, 2e18], 1.0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score double")
    got = topk.search(df, df.where("vec_id % 20 = 0"), "vec_id", "embedding", k=9, cand_block=50, query_block=3).collect()
    good = [(i, [int(np.floor(64 * x)) for x in v]) for i, v, _ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, qv in good:
        if q % 20 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(qv, v)), -2 ** 63), 2 ** 63 - 1), i)
                            for i, v in good if i != q)
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:9])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.query(df.limit(0)).count() == 0


def test_classifier_held_out(spark, docs, rows, none):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = classifier.query(docs_, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    few = spark.createDataFrame([(3, 1, 0), (None, 0, 0), (4, None, 1), (5, 7, 0)], labels.schema)
    out = classifier.query(docs, few).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    empty = classifier.query(docs, labels.limit(0)).collect()
    assert {r.score for r in empty} == {0.5}
    assert classifier.query(none, labels).count() == 0


def test_classifier_trains_on_all_features(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(n)) + " again" * 40 for n in (3, 900, 2500)]
    texts.append(texts[1] * 200)        # longer than one block
    docs_ = spark.createDataFrame(list(enumerate(texts, 10)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(4)], "doc_id bigint, quality int")
    labels = labels.where(~classifier.held_out(F.col("doc_id")))
    seen, train = {}, classifier.train

    def spy(rows, share, **other):
        seen["rows"] = {r.doc_id: r for r in rows.rows.collect()}
        return train(rows, share, **other)

    monkeypatch.setattr(classifier, "train", spy)
    classifier.classify(docs_, labels).count()
    known = sorted(r.doc_id for r in labels.collect())
    assert sorted(seen["rows"]) == known and len(known) >= 2
    for key in known:
        r = seen["rows"][key]
        found, times = (np.frombuffer(x, dtype="<i4").tolist() for x in (r.f, r.m))
        part = next(classifier.W.parts(classifier.pa.array([texts[key - 10]])))
        want = collections.Counter()
        for _, bucket in classifier.features(part):
            want.update(bucket.tolist())
        assert r.y == (key - 10) % 2 and dict(zip(found, times)) == dict(want)
    assert max(len(r.f) // 4 for r in seen["rows"].values()) > 1024


def test_classifier_steps_follow_the_counts():
    class Rows:
        seen = np.array([0, 1])

        def epoch(self, seed):
            yield 1, found, np.array([1.0, 5.0, 40.0])

    found = np.array([3, 7, 9])
    weights, _ = classifier.train(Rows(), np.array([0, 1]), epochs=3)
    start = np.random.default_rng(42).uniform(-1 / 8, 1 / 8, (1 << classifier.BITS, 8))
    layer = np.linalg.lstsq(start[10:1000], weights[10:1000], rcond=None)[0]
    moved = weights[found] - start[found] @ layer
    assert moved[0] > 0 and np.allclose(moved / moved[0], [1, 5, 40], rtol=1e-3)


def test_classifier_score_against_plain_recomputation(spark, rows, monkeypatch):
    """Words and character grams of each text, one by one."""
    texts = [r[1] for r in rows[:40]] + ["日本語", "a\u00e9\u4e16🙂 b", "x", " ", "né\tà", "🙂" * 5 + "\n\u3000z"]
    weights, bias = np.random.default_rng(1).normal(size=1 << classifier.BITS), 0.3

    def plain(text):
        own = next(classifier.W.parts(classifier.pa.array([text or ""]))).hash
        buckets = classifier._bucket(classifier.W.mix(own + classifier.W._GOLD)).tolist()
        chars = [" " if c in "\t\n\v\f\r" else c for c in text or ""]
        for n in (3, 4):
            for i in range(len(chars) - n + 1):
                if " " not in chars[i + 1:i + n - 1]:
                    code = np.array([ord(c) for c in chars[i:i + n]], dtype=np.uint64)
                    buckets.append(int(classifier._bucket(classifier.gram_hashes(code, n))[0]))
        return 1 / (1 + np.exp(-((weights[buckets].mean() if buckets else 0.0) + bias)))
    for size in (1 << 20, 64):
        monkeypatch.setattr(classifier.W, "PART_BYTES", size)
        some = [t for t in texts if t != LONG and t != LONG + " end"]
        z = np.zeros(len(some))
        for part in classifier.W.parts(classifier.pa.array(some, classifier.pa.string())):
            total, n = np.zeros(part.rows), np.zeros(part.rows)
            for text, bucket in classifier.features(part):
                total += np.bincount(text, weights=weights[bucket], minlength=part.rows)
                n += np.bincount(text, minlength=part.rows)
            z[part.row:part.row + part.rows] = total / np.maximum(n, 1)
        assert np.allclose(1 / (1 + np.exp(-(z + bias))), [plain(t) for t in some])
    docs_ = spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in classifier.score(docs_, weights, bias).collect()}
    assert np.allclose([got[i] for i in range(len(some))], [plain(t) for t in some])


def test_classifier_with_conflicting_labels_and_texts(spark):
    docs_ = [(1, "zeta good words here", 0), (1, "alpha other", 0), (2, "bad bad", 0), (3, "good", 0), (6, "more text", 0)]
    labels = [(1, 1), (2, 0), (2, 0), (3, 0), (3, 1), (6, 0)]
    got = []
    for n in (1, 3):
        d = spark.createDataFrame(docs_, "doc_id bigint, text string, y int").repartition(n)
        rows, share = classifier.training_rows(
            d, spark.createDataFrame(labels, "doc_id bigint, quality int").repartition(n), "quality", 10, 42)
        got.append(sorted((r.doc_id, r.y, bytes(r.f)) for r in rows.rows.collect()))
        assert share.sum() == len(got[-1]) and {r[0] for r in got[-1]} <= {1, 2, 6}
    assert got[0] == got[1]


def test_pii_columns_and_mask(docs, rows, none):
    out = pii.query(docs).collect()
    assert len(out) == len(rows)
    assert sum(r.n_email for r in out) == sum(len(re.findall("@", r[1] or "")) for r in rows)
    for r in out:
        assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() or r.spans
    masked = pii.mask(docs, None)
    assert masked.columns == docs.columns
    texts = [r.text for r in masked.collect()]
    assert sum("<EMAIL> or <IP>, <CARD> and <PHONE>." in (t or "") for t in texts) == 2
    assert collections.Counter(t for t in texts if t is None or "<" not in t) == \
        collections.Counter(r[1] for r in rows if "@" not in (r[1] or ""))
    assert pii.query(none).count() == 0


def test_pii_sample_counts_copies_once(spark):
    rng = random.Random(3)
    lone = [f"write to {''.join(rng.choices('abcdefgh', k=9))}@{i}.example.org today" for i in range(40)]
    docs_ = spark.createDataFrame([(t,) for t in lone + lone[:5] * 300], "text string").repartition(3)
    chars, tags = pii.training_windows(docs_, "text", 40, seed=42)
    both = [(x.tobytes(), y.tobytes()) for x, y in zip(chars, tags)]
    assert len(both) == len(set(both))
    every, marked = pii.training_windows(spark.createDataFrame([(t,) for t in lone], "text string"), "text", 40, 42)
    assert collections.Counter(both) == collections.Counter((x.tobytes(), y.tobytes()) for x, y in zip(every, marked))
    assert marked.any(axis=1).sum() == 40

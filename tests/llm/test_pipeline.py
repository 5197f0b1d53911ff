import collections
import random

import corpus_pipeline as P
from tabtune.llm import neardup, packing, quality
from tabtune.llm.frames import saved

SF = "/root/testdata/sf0.001"


def test_stages_chain_and_match_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in P.STAGES:
        out = saved(stage(spark, before, SF), name)
        if name != P.STAGES[-1][0]:
            assert out.columns == columns
            assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.query(docs).where("kept").collect()}
            assert {r.doc_id for r in out.collect()} == kept
        if name == "near_duplicates":
            groups = collections.Counter(r.component_id for r in neardup.query(before).collect())
            assert {r.doc_id for r in out.collect()} == set(groups)
        if name == "personal_data":
            assert out.count() == before.count()
            assert not out.where("text like '%@%.com%'").count()
            assert not out.where("n_chars <> length(text)").count()
        before = out
    last = collections.Counter(before.collect())
    assert last == collections.Counter(P.run(spark, SF).collect())


def test_stages_chain_over_odd_rows(spark):
    """Nulls, repeats, ties, a long text and clashing names through all stages."""
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(500)]

    def prose(n):
        return " ".join(rng.choice(vocab) for _ in range(n))
    twin, far = prose(90), prose(20000)
    rows = [(i, prose(rng.randint(60, 200)) + f" mail a{i}@b.com", rng.choice(["en", "fr", None]),
             rng.choice(["s1", "s2", None]), 10) for i in range(60)]
    rows += [(100, twin, "en", "s1", 1), (100, twin, "en", "s1", 1), (101, twin, "en", "s1", 1), (None, twin, "en", "s1", 1),
             (102, None, "en", "s1", None), (103, "", None, None, 0), (104, far, "fr", "s2", None),
             (None, prose(80), None, None, 3), (105, prose(70), "en", "s1", 4), (105, prose(75), "en", "s1", 4)]
    docs = spark.createDataFrame([(*r, "h", 7, "k", True) for r in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars int, "
                                 "_host string, n_words int, key string, kept boolean").repartition(3)
    before, seen = docs, {}
    for name, stage in P.STAGES:
        out = saved(stage(spark, before, SF), name)
        if name != P.STAGES[-1][0]:
            assert out.columns == docs.columns
        seen[name] = out.collect()
        before = out
    kept = collections.Counter((r.doc_id, r.text) for r in seen["near_duplicates"])
    assert max(kept.values()) == 1 and kept[100, twin] == 1 and (101, twin) not in kept and (None, twin) not in kept
    assert len([r for r in seen["near_duplicates"] if r.doc_id == 105]) == 2
    assert not any("@" in r.text for r in seen["personal_data"] if r.doc_id is not None and r.doc_id < 60)
    assert len(seen["personal_data"]) == len(seen["near_duplicates"]) and seen["length_buckets"]


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = saved(stage(spark, docs, SF), "empty")
        assert docs.count() == 0


def test_packing_covers_the_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = docs.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+')) AS n").first().n
    assert packing.query(docs).groupBy().sum("n_tokens").first()[0] == total

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tabtune.llm import (align, classifier, exact, mixing, neardup, negatives, packing, pii, quality, sharding,
                         substrings, topk, warc)


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_host_quality_rules(spark, sf):
    return quality.query(_docs(spark, sf))


def op2_hierarchical_mixing(spark, sf):
    return mixing.query(_docs(spark, sf))


def op9_length_buckets(spark, sf):
    return packing.query(_docs(spark, sf))


def op3_relative_lempel_ziv(spark, sf):
    return substrings.query(_docs(spark, sf))


def op4_sharded_warc(spark, sf):
    return warc.query(spark.read.parquet(f"{sf}/pages.parquet"))


def op6_subword_quality(spark, sf):
    return classifier.query(_docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


def op10_bilstm_crf_pii(spark, sf):
    return pii.query(_docs(spark, sf))


def op7_term_at_a_time_top_k(spark, sf):
    return topk.query(spark.read.parquet(f"{sf}/embeddings.parquet"))


def op5_bottom_k_near_duplicates(spark, sf):
    return neardup.query(_docs(spark, sf))


def op8_feistel_shards(spark, sf):
    return sharding.query(_docs(spark, sf))


def op12_patricia_owners(spark, sf):
    return exact.query(_docs(spark, sf))


def op11_merge_asof_alignment(spark, sf):
    return align.query(_docs(spark, sf))


def op13_spanning_tree_negatives(spark, sf):
    return negatives.query(spark.read.parquet(f"{sf}/embeddings.parquet"))


QUERIES = {
    "op1_host_quality_rules": op1_host_quality_rules,
    "op2_hierarchical_mixing": op2_hierarchical_mixing,
    "op9_length_buckets": op9_length_buckets,
    "op3_relative_lempel_ziv": op3_relative_lempel_ziv,
    "op4_sharded_warc": op4_sharded_warc,
    "op7_term_at_a_time_top_k": op7_term_at_a_time_top_k,
    "op6_subword_quality": op6_subword_quality,
    "op10_bilstm_crf_pii": op10_bilstm_crf_pii,
    "op5_bottom_k_near_duplicates": op5_bottom_k_near_duplicates,
    "op8_feistel_shards": op8_feistel_shards,
    "op12_patricia_owners": op12_patricia_owners,
    "op11_merge_asof_alignment": op11_merge_asof_alignment,
    "op13_spanning_tree_negatives": op13_spanning_tree_negatives,
}

ORACLE_SQL = {
    "op1_host_quality_rules": quality.ORACLE,
    "op2_hierarchical_mixing": mixing.oracle(),
    "op4_sharded_warc": warc.ORACLE,
    "op7_term_at_a_time_top_k": topk.ORACLE,
    "op3_relative_lempel_ziv": substrings.ORACLE,
    "op5_bottom_k_near_duplicates": neardup.ORACLE,
    "op12_patricia_owners": exact.ORACLE,
    "op13_spanning_tree_negatives": negatives.ORACLE,
}

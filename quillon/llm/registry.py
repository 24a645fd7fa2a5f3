"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.llm import language_id, line_dedup, lm_score, nbest_pieces, packing, quality_rules, simhash_dedup, topk_search, toxicity, url_filters
from quillon.llm.common import read_table


def op1_language_id(spark, sf_dir):
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    return quality_rules.judge(read_table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op4_topk_search(spark, sf_dir):
    return topk_search.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_lm_score(spark, sf_dir):
    return lm_score.score(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_url_filters(spark, sf_dir):
    return url_filters.judge(read_table(spark, sf_dir, "pages"))


def op8_simhash_dedup(spark, sf_dir):
    return simhash_dedup.find(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup.find(read_table(spark, sf_dir, "documents"))


def op10_nbest_pieces(spark, sf_dir):
    return nbest_pieces.encode(read_table(spark, sf_dir, "documents"), with_ids=False)  # their digests


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_packing": op3_packing,
    "op4_topk_search": op4_topk_search,
    "op5_lm_score": op5_lm_score,
    "op6_toxicity": op6_toxicity,
    "op7_url_filters": op7_url_filters,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_nbest_pieces": op10_nbest_pieces,
}

SQL = {
    "op2_quality_rules": quality_rules.SQL,
    "op4_topk_search": topk_search.SQL,
    "op7_url_filters": url_filters.SQL,
}

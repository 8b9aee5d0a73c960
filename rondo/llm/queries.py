"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers

from rondo.llm import bpe, collocations, compression, decontaminate, divergence, jaccard_join, language_model, line_dedup, personal_data, rules, secret_scan, sharding, suffix_dedup
from rondo.llm.common import small_batches, table


def op1_compression_quality(spark, sf_dir):
    small_batches(spark)
    return compression.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_rules(spark, sf_dir):
    small_batches(spark)
    return rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_automaton(spark, sf_dir):
    small_batches(spark)
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_sampled_splitters(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_line_prefix_doubling(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op6_secret_ownership(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_grouped_prefix_join(spark, sf_dir):
    small_batches(spark)
    return jaccard_join.similar(table(spark, sf_dir, "documents"))


def op7_suffix_arrays(spark, sf_dir):
    small_batches(spark)
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op9_distinct_word_bpe(spark, sf_dir):
    small_batches(spark)
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_log_frequency_filter(spark, sf_dir):
    small_batches(spark)
    return language_model.score(table(spark, sf_dir, "documents"))


def op11_prefix_growth(spark, sf_dir):
    small_batches(spark)
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_span_field(spark, sf_dir):
    small_batches(spark)
    return personal_data.find(table(spark, sf_dir, "documents"))


def op13_term_tiles(spark, sf_dir):
    small_batches(spark)
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_compression_quality, op2_ngram_rules, op5_suffix_automaton, op4_sampled_splitters, op10_line_prefix_doubling, op6_secret_ownership, op8_grouped_prefix_join, op7_suffix_arrays, op9_distinct_word_bpe, op3_log_frequency_filter, op11_prefix_growth, op12_span_field, op13_term_tiles)}
ORACLES: dict[str, str] = {"op5_suffix_automaton": decontaminate.ORACLE, "op4_sampled_splitters": sharding.ORACLE, "op10_line_prefix_doubling": line_dedup.ORACLE, "op6_secret_ownership": secret_scan.ORACLE, "op8_grouped_prefix_join": jaccard_join.ORACLE, "op11_prefix_growth": collocations.ORACLE, "op13_term_tiles": divergence.ORACLE}

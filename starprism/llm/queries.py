"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from starprism.llm import decontamination, langid, lm, packing, secrets, simhash, tokenfiles, topk, toxicity, warc
from starprism.llm.common import table


def op1_sum_of_squares_packing(spark, sf_dir):
    return packing.op1(table(spark, sf_dir, "documents"))


def op2_warc_salvage(spark, sf_dir):
    return warc.op2(table(spark, sf_dir, "pages"))


def op3_simhash_multi_index(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_positional_index_decontamination(spark, sf_dir):
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity_bigru(spark, sf_dir):
    return toxicity.op5(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_bigru(spark, sf_dir):
    return langid.op6(table(spark, sf_dir, "documents"))


def op7_multipart_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_threshold_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_log_bloom_lm(spark, sf_dir):
    return lm.op9(table(spark, sf_dir, "documents"))


def op10_wavelet_token_files(spark, sf_dir):
    return tokenfiles.op10(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


LLM_QUERIES = {
    f.__name__: f
    for f in (op1_sum_of_squares_packing, op2_warc_salvage, op3_simhash_multi_index, op4_positional_index_decontamination, op5_toxicity_bigru, op6_language_bigru, op7_multipart_secrets, op8_threshold_top_k, op9_log_bloom_lm, op10_wavelet_token_files, pipeline)
}
LLM_ORACLES: dict[str, str] = {"op2_warc_salvage": warc.ORACLE, "op4_positional_index_decontamination": decontamination.ORACLE, "op8_threshold_top_k": topk.ORACLE}

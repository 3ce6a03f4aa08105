"""The registered queries of this subpackage and their SQL oracles."""

from . import cotraining, jaccard, mixing, outliers, packing, sharding, substrings, tokens, topk, warc

QUERIES = {
    "op1_warc_salvage": warc.query,
    "op2_size_tiered_compaction": sharding.query,
    "op3_robust_outliers": outliers.query,
    "op4_length_histogram": tokens.query,
    "op5_best_fit_packing": packing.query,
    "op6_cotraining_quality": cotraining.query,
    "op7_systematic_mixing": mixing.query,
    "op8_exact_top_k": topk.query,
    "op9_substring_dedup": substrings.query,
    "op10_ngram_jaccard": jaccard.query,
}
ORACLE = {
    "op1_warc_salvage": warc.SQL,
    "op2_size_tiered_compaction": sharding.SQL,
    "op7_systematic_mixing": mixing.SQL,
    "op8_exact_top_k": topk.SQL,
    "op9_substring_dedup": substrings.SQL,
    "op10_ngram_jaccard": jaccard.SQL,
}

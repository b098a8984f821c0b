"""Registered queries of this package and their SQL."""

from __future__ import annotations

from . import exact_dedup, ngram_join, packing, quality, sampling, token_files, toxicity, unigram, url_filter, vector_search

_MODULES = {
    "op1_sample_segmentations": sampling,
    "op2_toxicity": toxicity,
    "op3_url_filter": url_filter,
    "op4_ngram_components": ngram_join,
    "op5_quality": quality,
    "op6_token_files": token_files,
    "op7_exact_dedup": exact_dedup,
    "op8_pack": packing,
    "op9_token_counts": unigram,
    "op10_exact_topk": vector_search,
}
QUERIES = {name: module.query for name, module in _MODULES.items()}
SQL = {name: module.SQL for name, module in _MODULES.items() if module.SQL}

"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, exact_dedup, license_scan, prefix_trie, url_reputation, vector_codes
from .ann import op5_cross_polytope_ann
from .chat_format import op2_chat_format
from .exact_dedup import op6_exact_dedup
from .license_scan import op12_license_scan
from .mixing import op10_source_mix
from .packing import op4_best_fit_packing
from .prefix_trie import op13_prefix_trie
from .quality import op7_ordinal_quality
from .simhash import op3_simhash_near_dedup
from .suffix_lm import op9_suffix_tree_scoring
from .token_count import op8_token_counts
from .url_reputation import op1_url_reputation
from .vector_codes import op11_vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_reputation": op1_url_reputation,
    "op2_chat_format": op2_chat_format,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_cross_polytope_ann": op5_cross_polytope_ann,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_ordinal_quality": op7_ordinal_quality,
    "op8_token_counts": op8_token_counts,
    "op9_suffix_tree_scoring": op9_suffix_tree_scoring,
    "op10_source_mix": op10_source_mix,
    "op11_vector_codes": op11_vector_codes,
    "op12_license_scan": op12_license_scan,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {
    "op1_url_reputation": url_reputation.ORACLE,
    "op2_chat_format": chat_format.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_license_scan": license_scan.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}

"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.llm.bpe import op9_bpe
from sievework.llm.conversations import op12_conversation_trie
from sievework.llm.divergence import op11_source_divergence
from sievework.llm.embeddings import op6_embedding_near_dedup
from sievework.llm.jaccard import op3_ngram_jaccard
from sievework.llm.media import op2_media_columns
from sievework.llm.oracle import ORACLE_SQL
from sievework.llm.packing import op10_best_fit_packing
from sievework.llm.pii import op8_pii
from sievework.llm.quality import op7_quality
from sievework.llm.recompression import op4_substring_dedup
from sievework.llm.secrets import op5_secret_scans
from sievework.llm.sharding import op13_sharding
from sievework.llm.suffixes import op1_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_media_columns": op2_media_columns,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_secret_scans": op5_secret_scans,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_bpe": op9_bpe,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_sharding": op13_sharding,
}

__all__ = ["ORACLE_SQL", "QUERIES"]

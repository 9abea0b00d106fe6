"""The corpus queries for the driver: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can say them."""

from __future__ import annotations

from .chat_format import OP10_SQL, op10_chat_format
from .decontaminate import op3_decontaminate
from .language_id import op1_language_id
from .language_model import op13_language_model
from .license_scan import op4_license_scan
from .ngram_join import op6_ngram_jaccard_join
from .packing import op8_best_fit_packing
from .prefix_trie import OP12_SQL, op12_conversation_trie
from .quality import OP5_SQL, op5_quality
from .suffix_dedup import op7_suffix_dedup
from .token_counts import op9_token_counts
from .toxicity import op2_toxicity
from .vector_codes import OP11_SQL, op11_vector_codes

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_license_scan": op4_license_scan,
    "op5_quality": op5_quality,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_counts": op9_token_counts,
    "op10_chat_format": op10_chat_format,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_language_model": op13_language_model,
}

ORACLE_SQL = {"op5_quality": OP5_SQL, "op10_chat_format": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_conversation_trie": OP12_SQL}

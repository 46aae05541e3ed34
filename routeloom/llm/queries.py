"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .best_fit_packing import op8_best_fit_packing
from .chat_format import op1_chat_formatting
from .decontamination import op7_benchmark_decontamination
from .external_shuffle import op4_external_shuffle
from .ngram_join import op5_ngram_jaccard_join
from .oracle import ORACLE_SQL
from .quality_rules import op2_quality_rules
from .substring_dedup import op9_substring_dedup
from .suffix_dedup import op10_suffix_array_dedup
from .toxicity import op3_toxicity
from .warc_archive import op6_warc_archive

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_external_shuffle": op4_external_shuffle,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_warc_archive": op6_warc_archive,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
}

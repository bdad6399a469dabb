"""Queries of the training-data operators, by name."""

from __future__ import annotations

from .alignment import op13_tokenizer_alignment
from .decontaminate import op5_decontaminate
from .jaccard_join import op7_jaccard_join
from .line_dedup import op12_line_dedup
from .oracles import ORACLES
from .packing import op3_packing
from .personal_data import op6_personal_data
from .quality_rules import op8_quality_rules
from .secret_scan import op10_secret_scan
from .spelling import op11_spelling_variants
from .substring_dedup import op4_substring_dedup
from .suffix_dedup import op9_suffix_dedup
from .token_file import op1_token_file
from .weak_labels import op2_weak_labels

__all__ = ["ORACLES", "QUERIES"]

QUERIES = {f.__name__: f for f in (op1_token_file, op2_weak_labels, op3_packing, op4_substring_dedup, op5_decontaminate, op6_personal_data, op7_jaccard_join, op8_quality_rules, op9_suffix_dedup, op10_secret_scan, op11_spelling_variants, op12_line_dedup, op13_tokenizer_alignment)}

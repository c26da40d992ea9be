"""Queries of this subpackage, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from .alignment import op13_cross_tokenizer
from .ann import op6_ann
from .decontaminate import OP2_SQL, op2_decontaminate
from .language import language_id_pages, op4_language_id
from .lines import OP8_SQL, op8_line_dedup
from .lm import op10_lm_scores
from .minhash import OP12_SQL, op12_minhash_dedup
from .phrases import OP11_SQL, op11_phrase_collocations
from .pieces import op7_sentencepiece, op9_token_counts
from .pii import op5_pii
from .simhash import op1_simhash_dedup
from .substrings import OP3_SQL, op3_substring_dedup

QUERIES = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_language_id": op4_language_id,
    "op5_pii": op5_pii,
    "op6_ann": op6_ann,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_lm_scores": op10_lm_scores,
    "op11_phrase_collocations": op11_phrase_collocations,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_cross_tokenizer": op13_cross_tokenizer,
    "language_id_pages": language_id_pages,
}
ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op8_line_dedup": OP8_SQL,
    "op11_phrase_collocations": OP11_SQL,
    "op12_minhash_dedup": OP12_SQL,
}

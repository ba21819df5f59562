"""Registered queries of the training-text operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from ferret.llm.conversation_repair import op13_conversation_repair
from ferret.llm.fingerprints import op9_fingerprints
from ferret.llm.html_text import op10_html_extraction
from ferret.llm.jaccard_join import OP1_SQL, op1_jaccard_join
from ferret.llm.language_id import op8_language_id
from ferret.llm.lexical_search import OP11_SQL, op11_lexical_search
from ferret.llm.line_dedup import OP6_SQL, op6_line_dedup
from ferret.llm.mixing import op2_mixing
from ferret.llm.quality_classifier import op7_quality_classifier
from ferret.llm.quality_rules import op3_quality_rules
from ferret.llm.sentencepieces import op4_sentencepiece
from ferret.llm.substring_dedup import OP5_SQL, op5_substring_dedup
from ferret.llm.token_counts import op12_token_counts

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_language_id": op8_language_id,
    "op9_fingerprints": op9_fingerprints,
    "op10_html_extraction": op10_html_extraction,
    "op11_lexical_search": op11_lexical_search,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {"op1_jaccard_join": OP1_SQL, "op5_substring_dedup": OP5_SQL, "op6_line_dedup": OP6_SQL,
                           "op11_lexical_search": OP11_SQL}

"""The dealt operators as queries, and SQL for those that SQL can express."""
from __future__ import annotations

from codecairn.llm import (bpe, conversation_trie, filter_audit, jaccard, langid, licenses, line_rules, mixing, neighbours, novelty,
                           rollups, spotsigs, substrings)

QUERIES = {
    "op1_language": langid.query,
    "op2_line_rules": line_rules.query,
    "op3_substrings": substrings.query,
    "op4_jaccard": jaccard.query,
    "op5_mixing": mixing.query,
    "op6_novelty": novelty.query,
    "op7_rollups": rollups.query,
    "op8_licenses": licenses.query,
    "op9_neighbours": neighbours.query,
    "op10_bpe": bpe.query,
    "op11_conversation_trie": conversation_trie.query,
    "op12_filter_audit": filter_audit.query,
    "op13_spotsigs": spotsigs.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_rules": line_rules.SQL,
    "op7_rollups": rollups.SQL,
    "op8_licenses": licenses.SQL,
    "op11_conversation_trie": conversation_trie.SQL,
    "op12_filter_audit": filter_audit.SQL,
}

"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lectern.llm.bpe_automaton import op7_bpe_automaton
from lectern.llm.chat_format import OP4_SQL, op4_chat_format
from lectern.llm.containment import OP6_SQL, op6_containment
from lectern.llm.filter_audit import OP13_SQL, op13_filter_audit
from lectern.llm.language_id import op10_language_id
from lectern.llm.line_spread import OP3_SQL, op3_line_spread
from lectern.llm.near_dedup import OP5_SQL, op5_near_dedup
from lectern.llm.pii import op12_weak_pii
from lectern.llm.pitman_yor import op1_pitman_yor
from lectern.llm.png_media import op9_png_media
from lectern.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from lectern.llm.rans_tokens import op8_rans_tokens
from lectern.llm.substring_dedup import OP2_SQL, op2_substring_dedup

QUERIES = {
    "op1_pitman_yor": op1_pitman_yor,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_line_spread": op3_line_spread,
    "op4_chat_format": op4_chat_format,
    "op5_near_dedup": op5_near_dedup,
    "op6_containment": op6_containment,
    "op7_bpe_automaton": op7_bpe_automaton,
    "op8_rans_tokens": op8_rans_tokens,
    "op9_png_media": op9_png_media,
    "op10_language_id": op10_language_id,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_weak_pii": op12_weak_pii,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {
    "op2_substring_dedup": OP2_SQL,
    "op3_line_spread": OP3_SQL,
    "op4_chat_format": OP4_SQL,
    "op5_near_dedup": OP5_SQL,
    "op6_containment": OP6_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}

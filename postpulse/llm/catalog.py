"""The operators of this subpackage as queries, and their SQL."""

from __future__ import annotations

from postpulse.llm.byte_pairs import op11_byte_pair_round_trip
from postpulse.llm.licences import op3_licence_automaton
from postpulse.llm.merkle import op12_merkle_manifest
from postpulse.llm.ngram_join import op8_ngram_jaccard_join
from postpulse.llm.oracle import ORACLE
from postpulse.llm.packing import op4_vector_packing
from postpulse.llm.passages import op6_compact_windows
from postpulse.llm.pii import op9_weak_pii
from postpulse.llm.quality import op10_tokeniser_fertility
from postpulse.llm.sharding import op5_lookup_sharding
from postpulse.llm.spelling import op13_spelling_variants
from postpulse.llm.tiling import op2_greedy_tiling
from postpulse.llm.tool_calls import op7_tool_call_linking
from postpulse.llm.warc import op1_warc_normaliser

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {
    "op1_warc_normaliser": op1_warc_normaliser,
    "op2_greedy_tiling": op2_greedy_tiling,
    "op3_licence_automaton": op3_licence_automaton,
    "op4_vector_packing": op4_vector_packing,
    "op5_lookup_sharding": op5_lookup_sharding,
    "op6_compact_windows": op6_compact_windows,
    "op7_tool_call_linking": op7_tool_call_linking,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_weak_pii": op9_weak_pii,
    "op10_tokeniser_fertility": op10_tokeniser_fertility,
    "op11_byte_pair_round_trip": op11_byte_pair_round_trip,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_spelling_variants": op13_spelling_variants,
}

"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, conversation_trie, fingerprints, licenses, line_dedup, mixing, quality, simhash, spelling, substring_dedup, token_counts, token_file, warc

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_line_dedup": line_dedup.query,
    "op4_document_fingerprints": fingerprints.query,
    "op5_byte_bpe": byte_bpe.query,
    "op6_quality_rules": quality.query,
    "op7_warc": warc.query,
    "op8_token_counts": token_counts.query,
    "op9_token_file": token_file.query,
    "op10_simhash": simhash.query,
    "op11_license_scan": licenses.query,
    "op12_spelling_variants": spelling.query,
    "op13_conversation_trie": conversation_trie.query,
}

SQL = {"op1_mixing": mixing.SQL, "op6_quality_rules": quality.SQL, "op3_line_dedup": line_dedup.SQL, "op7_warc": warc.SQL, "op12_spelling_variants": spelling.SQL, "op13_conversation_trie": conversation_trie.SQL}

"""Queries of this subpackage, each over its whole tables, and their SQL where it can be stated."""

from __future__ import annotations

from . import chat, contamination, language, lm_score, media, merkle, mixture, near_dups, page_text, prefix_trie, secret_scan, simhash, token_files, trie_and_manifest_sql

QUERIES = {
    "op1_token_file": token_files.op1_token_file,
    "op2_language_id": language.op2_language_id,
    "op3_source_mixture": mixture.op3_source_mixture,
    "op4_benchmark_leaks": contamination.op4_benchmark_leaks,
    "op5_lm_score": lm_score.op5_lm_score,
    "op6_media_pages": media.op6_media_pages,
    "op7_chat_format": chat.op7_chat_format,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_near_duplicates": near_dups.op9_near_duplicates,
    "op10_page_text": page_text.op10_page_text,
    "op11_simhash_duplicates": simhash.op11_simhash_duplicates,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op3_source_mixture": mixture.mixture_sql(),
    "op7_chat_format": chat.CHAT_SQL,
    "op12_prefix_trie": trie_and_manifest_sql.TRIE_SQL,
    "op13_merkle_manifest": trie_and_manifest_sql.MANIFEST_SQL,
}

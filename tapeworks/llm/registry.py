"""The queries of this subpackage, and SQL for those that it can express."""

from . import chat, decontaminate, embedding_dedup, html_text, language, order_minhash, packing, prefix_trie, secret_scan, simhash, substring_dedup, token_files, whitening

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_decontamination": decontaminate.query,
    "op3_secret_scan": secret_scan.query,
    "op4_best_fit_packing": packing.query,
    "op5_simhash_dedup": simhash.query,
    "op6_chat_formatting": chat.query,
    "op7_language_id": language.query,
    "op8_token_files": token_files.query,
    "op9_embedding_dedup": embedding_dedup.query,
    "op10_html_extraction": html_text.query,
    "op11_conversation_prefix_trie": prefix_trie.query,
    "op12_document_fingerprints": order_minhash.query,
    "op13_embedding_whitening": whitening.query,
}

ORACLES = {
    "op2_decontamination": decontaminate.ORACLE,
    "op6_chat_formatting": chat.ORACLE,
    "op9_embedding_dedup": embedding_dedup.ORACLE,
    "op11_conversation_prefix_trie": prefix_trie.ORACLE,
}

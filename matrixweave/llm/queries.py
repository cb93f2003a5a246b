"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from matrixweave.llm import language_id, line_dedup, secret_scan, sentence_pieces, simhash, span_dedup, string_tiling, suffix_dedup, token_files, vantage_trees

QUERIES = {
    "op1_benchmark_tiling": string_tiling.op1_benchmark_tiling,
    "op2_sentence_pieces": sentence_pieces.op2_sentence_pieces,
    "op3_span_dedup": span_dedup.op3_span_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_token_files": token_files.op5_token_files,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_language_id": language_id.op7_language_id,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_vantage_trees": vantage_trees.op9_vantage_trees,
    "op10_simhash": simhash.op10_simhash,
}

ORACLE_SQL = {
    "op3_span_dedup": span_dedup.OP3_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op9_vantage_trees": vantage_trees.OP9_SQL,
}

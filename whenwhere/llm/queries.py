"""The queries of this subpackage for __spark_entry__.py, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, ann, bpe, decontamination, masked_lm, packing, pii, probminhash, quality, substring_dedup, suffix_dedup, token_files, vector_codes

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1,
    "op2_pii_surrogates": pii.op2,
    "op3_suffix_array_dedup": suffix_dedup.op3,
    "op4_token_file_counts": token_files.op4,
    "op5_probminhash": probminhash.op5,
    "op6_packing": packing.op6,
    "op7_quality_line_frequency": quality.op7,
    "op8_bpe_prefix_dp": bpe.op8,
    "op9_block_matrix_neighbours": ann.op9,
    "op10_masked_lm_scores": masked_lm.op10,
    "op11_tokenizer_alignment": alignment.op11,
    "op12_resident_lloyd_codes": vector_codes.op12,
    "op13_benchmark_decontamination": decontamination.op13,
}

ORACLE = {
    "op9_block_matrix_neighbours": ann.SQL,
    "op7_quality_line_frequency": quality.SQL,
    "op12_resident_lloyd_codes": vector_codes.SQL,
    "op13_benchmark_decontamination": decontamination.SQL,
}

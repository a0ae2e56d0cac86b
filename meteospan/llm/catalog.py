"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from meteospan.llm import bpe, decontaminate, hard_negatives, license_scan, line_dedup, minhash_dedup, ngram_join, pii, prefix_trie, quality_rules, substring_dedup, token_files, warc


def queries() -> dict:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_token_files": token_files.op2_token_files,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_pii": pii.op5_pii,
        "op6_line_dedup": line_dedup.op6_line_dedup,
        "op7_bpe": bpe.op7_bpe,
        "op8_warc": warc.op8_warc,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_license_scan": license_scan.op10_license_scan,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_minhash_dedup": minhash_dedup.op12_minhash_dedup,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.op1_sql(),
        "op4_quality_rules": quality_rules.op4_sql(),
        "op6_line_dedup": line_dedup.op6_sql(),
        "op8_warc": warc.op8_sql(),
        "op9_decontaminate": decontaminate.op9_sql(),
        "op10_license_scan": license_scan.op10_sql(),
        "op11_prefix_trie": prefix_trie.op11_sql(),
        "op12_minhash_dedup": minhash_dedup.op12_sql(),
        "op13_hard_negatives": hard_negatives.op13_sql(),
    }

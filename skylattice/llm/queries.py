"""The queries of this folder and their SQL."""

from __future__ import annotations

from . import byte_bpe, fingerprints, html_extract, license_scan, line_dedup, merkle, ngram_join, quality, simhash, source_mix, token_records, topk_search, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_fingerprints": fingerprints.op5_fingerprints,
    "op6_source_mix": source_mix.op6_source_mix,
    "op7_token_records": token_records.op7_token_records,
    "op8_html_extract": html_extract.op8_html_extract,
    "op9_quality": quality.op9_quality,
    "op10_topk_search": topk_search.op10_topk_search,
    "op11_simhash": simhash.op11_simhash,
    "op12_whitening": whitening.op12_whitening,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_license_scan": license_scan.oracle(),
    "op4_ngram_join": ngram_join.ORACLE,
    "op6_source_mix": source_mix.ORACLE,
    "op10_topk_search": topk_search.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}

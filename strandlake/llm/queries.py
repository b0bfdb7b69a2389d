"""The registry of this subpackage: queries by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

from . import bpe, lang_id, line_dedup, packing, quality_model, quality_rules, secret_scan, simhash, vector_dedup, warc

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_bpe": bpe.op2_bpe,
    "op3_warc": warc.op3_warc,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_simhash": simhash.op5_simhash,
    "op6_packing": packing.op6_packing,
    "op7_quality_model": quality_model.op7_quality_model,
    "op8_vector_dedup": vector_dedup.op8_vector_dedup,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_lang_id": lang_id.op10_lang_id,
}

ORACLES = {
    "op1_secret_scan": secret_scan.oracle(),
    "op3_warc": warc.ORACLE,
}

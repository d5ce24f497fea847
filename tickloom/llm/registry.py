"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import brown, extraction, fingerprints, infill, langid, leaks, mixing, neardup, quality, secrets, tokens, variants, warc

QUERIES = {
    "op1_minhash_neardup": neardup.op1,
    "op2_pfair_mix": mixing.op2,
    "op3_edit_aware_tokens": tokens.op3,
    "op4_lsa_decontamination": leaks.op4,
    "op5_bilstm_extraction": extraction.op5,
    "op6_rule_quality": quality.op6,
    "op7_warc_transactions": warc.op7,
    "op8_weighted_fingerprints": fingerprints.op8,
    "op9_secret_scan": secrets.op9,
    "op10_string_kernel_langid": langid.op10,
    "op11_spelling_variants": variants.op11,
    "op12_fill_in_middle": infill.op12,
    "op13_brown_classes": brown.op13,
}

ORACLES = {
    "op1_minhash_neardup": neardup.ORACLE_OP1,
    "op2_pfair_mix": mixing.ORACLE_OP2,
    "op11_spelling_variants": variants.ORACLE_OP11,
    "op12_fill_in_middle": infill.ORACLE_OP12,
}

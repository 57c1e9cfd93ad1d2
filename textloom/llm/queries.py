"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, exact_dedup, html_extract, katz, license_scan, minhash, mixing, quality, secrets, toxicity

QUERIES = {
    "op5_html_extraction": html_extract.op5_html_extraction,
    "op6_toxicity": toxicity.op6_toxicity,
    "op8_katz": katz.op8_katz,
    "op4_minhash": minhash.op4_minhash,
    "op7_quality_rules": quality.op7_quality_rules,
    "op2_license_scan": license_scan.op2_license_scan,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op1_secret_scans": secrets.op1_secret_scans,
    "op3_mixing": mixing.op3_mixing,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}

ORACLES = {
    "op4_minhash": minhash.OP4_SQL,
    "op2_license_scan": license_scan.OP2_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op1_secret_scans": secrets.OP1_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}

"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, exact_dedup, fingerprints, line_dedup, mixing, near_dedup, pii, quality, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_pii": pii.query,
    "op3_bpe": bpe.query,
    "op4_warc": warc.query,
    "op5_toxicity": toxicity.query,
    "op6_line_dedup": line_dedup.query,
    "op7_quality": quality.query,
    "op8_mix": mixing.query,
    "op9_near_dedup": near_dedup.query,
    "op10_fingerprints": fingerprints.query,
    "fingerprint_classes": fingerprints.classes_query,
}
SQL = {"op1_exact_dedup": exact_dedup.SQL, "op4_warc": warc.SQL, "op6_line_dedup": line_dedup.SQL}

"""The subpackage's queries and SQL, by name."""

from __future__ import annotations

from millrace.llm import bpe, fingerprint, language_id, mixing, quality, secret_scan, simhash, toxicity, url_filter, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_language_id": language_id.op2_language_id,
    "op3_simhash": simhash.op3_simhash,
    "op4_warc": warc.op4_warc,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_secrets": secret_scan.op6_secrets,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_fingerprint": fingerprint.op8_fingerprint,
    "op9_quality": quality.op9_quality,
    "op10_bpe": bpe.op10_bpe,
}

ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_url_filter": url_filter.OP5_SQL,
    "op9_quality": quality.OP9_SQL,
}

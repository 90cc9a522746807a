"""Queries of this subpackage, and the SQL that they are checked against."""

from . import exact_dedup, mixing, quality, secret_scan, sentencepiece_codec, simhash, substring, token_rollup, toxicity, warc

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.query,
    "op2_exact_dedup": exact_dedup.query,
    "op10_secret_scan": secret_scan.query,
    "op3_toxicity": toxicity.query,
    "op4_warc": warc.query,
    "op5_substring": substring.query,
    "op6_token_rollup": token_rollup.query,
    "op7_mixing": mixing.query,
    "mixing_whole": mixing.query_whole,
    "op8_simhash": simhash.query,
    "op9_quality": quality.query,
}
ORACLES = {"op2_exact_dedup": exact_dedup.ORACLE, "op4_warc": warc.ORACLE, "op7_mixing": mixing.ORACLE, "mixing_whole": mixing.ORACLE_WHOLE, "op9_quality": quality.ORACLE}

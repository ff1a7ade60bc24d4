"""Queries and SQL of this subpackage, as __spark_entry__ registers them."""

from __future__ import annotations

from . import byte_shards, class_lm, collision_ann, exact_dedup, packing, quality_gam, shingle_join, source_mix, token_count, url_trust, va_codes, warc, whitening

QUERIES = {
    "op1_url_trust": url_trust.query,
    "op2_packing": packing.query,
    "op3_class_lm": class_lm.query,
    "op4_token_count": token_count.query,
    "op5_warc": warc.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_collision_ann": collision_ann.query,
    "op8_source_mix": source_mix.query,
    "op9_quality_gam": quality_gam.query,
    "op10_shingle_join": shingle_join.query,
    "op11_whitening": whitening.query,
    "op12_va_codes": va_codes.query,
    "op13_byte_shards": byte_shards.query,
}
ORACLES = {
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op8_source_mix": source_mix.ORACLE_SQL,
    "op12_va_codes": va_codes.ORACLE_SQL,
    "op13_byte_shards": byte_shards.ORACLE_SQL,
}

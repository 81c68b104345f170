"""Registered queries of the subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import crosstok, decontam, fingerprint, langid, lexical, neardup, pieces, pitman_yor, secrets, sharding, simhash, urlfilter, warc

QUERIES = {
    "op1_url_filter": urlfilter.op1_url_filter,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_fingerprints": fingerprint.op3_fingerprints,
    "op4_language_id": langid.op4_language_id,
    "op5_language_model": pitman_yor.op5_language_model,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_warc": warc.op7_warc,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_sharding": sharding.op10_sharding,
    "op11_simhash": simhash.op11_simhash,
    "op12_cross_tokenizer": crosstok.op12_cross_tokenizer,
    "op13_lexical_search": lexical.op13_lexical_search,
}

ORACLES = {
    "op1_url_filter": urlfilter.OP1_SQL,
    "op7_warc": warc.OP7_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}

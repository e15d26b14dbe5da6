"""Registered queries of the subpackage and their SQL."""

from ensspark.llm import op01_urls, op02_pii, op03_warc, op04_ngram_join, op05_topk, op06_secrets, op07_quality, op08_sentencepiece, op09_mixing, op10_mixing_lm, op11_tokens, op12_merkle, op13_lexical

QUERIES = {
    "op1_url_filter": op01_urls.query,
    "op2_personal_data": op02_pii.query,
    "op3_warc": op03_warc.query,
    "op4_ngram_join": op04_ngram_join.query,
    "op5_top_k": op05_topk.query,
    "op6_secrets": op06_secrets.query,
    "op7_quality_rules": op07_quality.query,
    "op8_sentencepiece": op08_sentencepiece.query,
    "op9_mixing": op09_mixing.query,
    "op10_context_mixing": op10_mixing_lm.query,
    "op11_token_ids": op11_tokens.query,
    "op12_merkle": op12_merkle.query,
    "op13_lexical_search": op13_lexical.query,
}
ORACLES = {
    "op1_url_filter": op01_urls.ORACLE,
    "op3_warc": op03_warc.ORACLE,
    "op5_top_k": op05_topk.ORACLE,
    "op7_quality_rules": op07_quality.ORACLE,
    "op9_mixing": op09_mixing.ORACLE,
    "op12_merkle": op12_merkle.ORACLE,
    "op13_lexical_search": op13_lexical.ORACLE,
}

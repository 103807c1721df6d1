"""The registered queries of this subpackage."""

import corpus_pipeline

from leadmill.llm import align, bpe, decontaminate, html, lm, neardup, quality, shards, simhash, tokenfiles, toxicity, urls, vectors

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_url_filters": urls.op2_url_filters,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_token_files": tokenfiles.op4_token_files,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_minhash": neardup.op6_minhash,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_lm_scoring": lm.op8_lm_scoring,
    "op9_sharding": shards.op9_sharding,
    "op10_html_extraction": html.op10_html_extraction,
    "op11_vector_codes": vectors.op11_vector_codes,
    "op12_simhash": simhash.op12_simhash,
    "op13_alignment": align.op13_alignment,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op2_url_filters": urls.OP2_SQL, "op3_decontamination": decontaminate.OP3_SQL, "op11_vector_codes": vectors.OP11_SQL}

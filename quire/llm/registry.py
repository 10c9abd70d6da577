"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

from quire.llm import bilinear, media, mixing, neardup, packing, perplexity, quality, tokencount, tokenfile, toxicity

QUERIES = {
    "op1_clause_grammar": toxicity.op1_clause_grammar,
    "op2_token_shards": tokenfile.op2_token_shards,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_perplexity_bands": perplexity.op4_perplexity_bands,
    "op5_state_machine_counts": tokencount.op5_state_machine_counts,
    "op6_log_bilinear": bilinear.op6_log_bilinear,
    "op7_rule_ensemble": quality.op7_rule_ensemble,
    "op8_fair_mix": mixing.op8_fair_mix,
    "op9_wav_fingerprints": media.op9_wav_fingerprints,
    "op10_tensored_minhash": neardup.op10_tensored_minhash,
}

ORACLES = {
    "op8_fair_mix": mixing.SQL,
}

"""The queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from touchline.llm import ann, bpe, fingerprint, langid, mixing, periodic, resampling, secret_scan, simhash, suffix, toxicity, url_rules, warc

QUERIES = {
    "op1_learned_partitions": ann.op1_learned_partitions,
    "op5_budget_mixing": mixing.op5_budget_mixing,
    "op8_weak_toxicity": toxicity.op8_weak_toxicity,
    "op9_iblt_fingerprints": fingerprint.op9_iblt_fingerprints,
    "op2_suffix_repeats": suffix.op2_suffix_repeats,
    "op4_bpe_transducer": bpe.op4_bpe_transducer,
    "op6_language_mixture": langid.op6_language_mixture,
    "op3_warc_archive": warc.op3_warc_archive,
    "op7_url_rules": url_rules.op7_url_rules,
    "op10_simhash_golay": simhash.op10_simhash_golay,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_blob_ledger": secret_scan.op12_blob_ledger,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

ORACLE_SQL = {
    "op5_budget_mixing": mixing.ORACLE,
    "op3_warc_archive": warc.ORACLE,
    "op7_url_rules": url_rules.ORACLE,
    "op11_periodic_runs": periodic.ORACLE,
    "op12_blob_ledger": secret_scan.ORACLE,
    "op13_importance_resampling": resampling.ORACLE,
}

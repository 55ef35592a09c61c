"""The queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from lorespark.llm import bpe, decontaminate, exact, fingerprint, generations, jaccard, langid, licenses, pii, quality, repeats, trie, urls


def queries() -> dict:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_suffix_dedup": repeats.op3_suffix_dedup,
        "op4_pii": pii.op4_pii,
        "op5_bpe_roundtrip": bpe.op5_bpe_roundtrip,
        "op6_fingerprints": fingerprint.op6_fingerprints,
        "op7_jaccard_join": jaccard.op7_jaccard_join,
        "op8_url_filter": urls.op8_url_filter,
        "url_rules": urls.url_rules,
        "op9_language_id": langid.op9_language_id,
        "op10_quality": quality.op10_quality,
        "op11_late_overwrite": generations.op11_late_overwrite,
        "op12_prefix_trie": trie.op12_prefix_trie,
        "op13_exact_dedup": exact.op13_exact_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.OP1_SQL,
        "op2_decontaminate": decontaminate.OP2_SQL,
        "op3_suffix_dedup": repeats.OP3_SQL,
        "op7_jaccard_join": jaccard.OP7_SQL,
        "op13_exact_dedup": exact.OP13_SQL,
        "url_rules": urls.RULES_SQL,
    }

"""Queries of this subpackage and their DuckDB SQL."""

from . import (
    decontam,
    fingerprints,
    importance,
    langid,
    licenses,
    packing,
    pii,
    ranked,
    secret_scan,
    simhash,
    substrings,
    tokens,
    toxicity,
)

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_pseudonyms": pii.op4_pseudonyms,
    "op5_language": langid.op5_language,
    "op6_secrets": secret_scan.op6_secrets,
    "op7_decontaminate": decontam.op7_decontaminate,
    "op8_packing": packing.op8_packing,
    "op9_substrings": substrings.op9_substrings,
    "op10_simhash": simhash.op10_simhash,
    "op11_importance": importance.op11_importance,
    "op12_ranked_search": ranked.op12_ranked_search,
    "op13_licenses": licenses.op13_licenses,
}
ORACLE_SQL: dict[str, str] = {
    "op7_decontaminate": decontam.ORACLE,
    "op11_importance": importance.ORACLE,
    "op12_ranked_search": ranked.ORACLE,
}

"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from docloom.llm import decontamination, fingerprints, languages, linededup, neardup, packing, pii, secrets, sharding, tokencounts


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_fingerprint": fingerprints.op2_fingerprint,
        "op3_line_dedup": linededup.op3_line_dedup,
        "op4_sharding": sharding.op4_sharding,
        "op5_packing": packing.op5_packing,
        "op6_near_dedup": neardup.op6_near_dedup,
        "op7_pii": pii.op7_pii,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_language_id": languages.op9_language_id,
        "op10_token_counts": tokencounts.op10_token_counts,
    }


def oracle_sql() -> dict:
    return {"op3_line_dedup": linededup.SQL, "op4_sharding": sharding.SQL, "op6_near_dedup": neardup.SQL, "op8_decontamination": decontamination.SQL}
